import html
import html.parser
import random
import re
import time

from conceptmill.llm import op9_extract as op


def page(paragraphs, wrap="article", extra=""):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    inner = f"<{wrap} class='post-body'>{body}{extra}</{wrap}>"
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Menu one</a></li></ul></nav><header>Site</header><div class='ad'>Buy this thing now, it is very cheap and very good for all of you.</div>{inner}<aside>More</aside><form>Your mail <input> <button>Go</button></form><div id='comments'><p>I liked it</p></div><footer>&copy; us</footer></body></html>"


def test_article_without_the_rest():
    rng = random.Random(2)
    for wrap in ("article", "main", "div"):
        for n in (1, 3, 20):
            ps = [" ".join(rng.choice(["word", "a&b", "x<y", "é", "“q”"]) for _ in range(rng.choice([12, 40]))) for _ in range(n)]
            assert op.main_text(page(ps, wrap)) == "\n".join(ps)
    short = ["Hi.", "No.", "w " * 300 + "end", "Ok."]
    assert op.main_text(page(short)) == "\n".join(short)


def test_odd_pages():
    assert op.main_text(None) == op.main_text("") == op.main_text("   \n") == op.main_text("<script>x</script>") == op.main_text("<nav>a</nav>") == ""
    assert op.main_text("plain text &amp; more &#233; &nbsp; x") == "plain text & more é x"
    assert op.main_text("a < b and c<3") == "a < b and c<3"
    assert op.main_text("<article><h1>T</h1><p><b>one<br>two<p>three<ul><li>x<li>y</ul></article>") == "T\none\ntwo\nthree\nx\ny"
    assert op.main_text("<article>in <a href=x>a link</a> text<div class='share-buttons'>tweet</div><!-- c --><p>b\n\tc</p></article>").split("\n") == ["in a link text", "b c"]
    assert op.main_text("<article><header><h1>Title</h1></header><p>x</p><section class=comments><p>no</p></section></article>") == "Title\nx"
    assert op.main_text("<p" + " a" * 50_000) == "" and len(op.main_text("<p>" + "w " * 300_000)) == 599_999
    assert op.main_text("<article><p>x <script>if (a</article>b)</script>y</p></article>") == "x y"


def brute_stretches(weights, width, surge):
    """A window of each line; a line belongs to a stretch if a chain of windows that aren't empty leads to one that surges."""
    window = [sum(weights[k : k + width]) for k in range(len(weights))]
    surge = max(1, min(surge, max(window, default=0)))
    found = set()
    for k, n in enumerate(window):
        if n >= surge:
            lo, hi = k, k
            while lo and window[lo - 1]:
                lo -= 1
            while hi + 1 < len(window) and window[hi + 1]:
                hi += 1
            heavy = [i for i in range(lo, hi + 1) if weights[i]]
            found.add((min(heavy), max(heavy) + 1))
    return sorted(found)


def test_surge_and_dive():
    assert op.stretches([0, 0, 100, 5, 90] + [0] * 8 + [70]) == [(2, 5), (13, 14)]
    assert op.stretches([0, 0, 100, 5, 90] + [0] * 8 + [50]) == [(2, 5)]
    assert op.stretches([]) == [] == op.stretches([0, 0]) and op.stretches([3, 0, 0, 2]) == [(0, 4)]
    rng = random.Random(6)
    for _ in range(400):
        weights = [rng.choice([0, 0, 0, 1, 20, 70]) for _ in range(rng.randrange(25))]
        for width, surge in ((3, 60), (2, 90), (1, 1)):
            assert op.stretches(weights, width, surge) == brute_stretches(weights, width, surge)


def test_the_curve_decides():
    links = "".join(f"<div><a href=/{k}>Section number {k}</a></div>" for k in range(6))
    few = "".join(f"<div>{x}</div>" for x in ("Home", "Mon", "12"))
    text = "".join(f"<div>{k} {'word ' * 30}</div>" for k in range(3))
    want = "\n".join(f"{k} {('word ' * 30).strip()}" for k in range(3))
    # nothing is marked or named: links and short lines far from text dive
    assert op.main_text(f"<body>{links}{text}{links}</body>") == want
    assert op.main_text(f"<body>{few}{links}{text}{links}{few}</body>") == want
    # a short list or table in the middle doesn't
    items = "<ul>" + "".join(f"<li>item {k}</li>" for k in range(8)) + "</ul>"
    assert op.main_text(f"<body>{links}{text}{items}{text}</body>") == "\n".join([want, *(f"item {k}" for k in range(8)), want])
    # links at the end of an article are its own
    got = op.main_text(f"<article><h1><a href=x>Title</a></h1><p>Text.</p><p><a href=y>A paragraph.</a></p>{links}</article>{links}")
    assert got == "\n".join(["Title", "Text.", "A paragraph.", *(f"Section number {k}" for k in range(6))])


def test_light_lines_of_the_article_stay():
    text = "".join(f"<p>{k} {'word ' * 30}</p>" for k in range(3))
    want = "\n".join(f"{k} {('word ' * 30).strip()}" for k in range(3))
    items = [f"Reference number {k}" for k in range(6)]
    refs = "<ul>" + "".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(items)) + "</ul>"
    for wrap in ("article", "main", "div", "section"):
        whole = lambda inner, w=wrap: op.main_text(f"<body><nav><a href=x>Menu</a></nav><div class=ad>Buy this, it is cheap.</div><{w}>{inner}</{w}><footer>&copy; us, all of it</footer></body>")
        assert whole(text + refs) == "\n".join([want, *items])
        assert whole(text + "<ul><li><a href=q>only one</a></li></ul>") == want + "\nonly one"
        assert whole(text + refs + text) == "\n".join([want, *items, want])
        assert whole("<div><a href=x>opening</a></div>" + text) == "opening\n" + want
        assert whole(f"<p class=notice>n</p><div id=login>l</div>{text}") == "n\nl\n" + want
        assert whole(f"{text}<div class=reader-comments><p>{'c ' * 100}</p></div>") == want
        assert whole(f"<div class=ad-slot>buy it now</div>{text}<aside>{'more ' * 40}</aside>") == want


def test_marks_change_nothing_that_the_curve_finds(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = op.main_text(r.html)
        for tag in ("div", "section", "td"):
            assert op.main_text(re.sub(r"(</?)(article|main)\b", rf"\g<1>{tag}", r.html)) == want


def test_deep_elements_cost_their_length():
    for tag in ("nav", "div", "b", "li", "p", "section class=ad", "article", "form", "td"):
        began = time.process_time()
        op.main_text(f"<{tag}>x" * 16_000)
        op.main_text("<article>" + f"<{tag}>x" * 8_000 + f"</{tag.split()[0]}>" * 8_000 + "</article>")
        assert time.process_time() - began < 3, tag


def test_names_are_whole_words():
    for name in ("has-sidebar", "with-sidebar", "no-comments", "page nav-closed", "content nav-open", "related-work", "legal"):
        assert op.main_text(f"<div class='{name}' id=legal><p>{'word ' * 30}</p></div>") == ("word " * 30).strip()
    # a name doesn't strike what holds the article, or most of the text
    assert op.main_text("<div class='sidebar'><article><p>x</p></article></div>") == "x"
    assert op.main_text(f"<form class=menu><div class=header><article>y</article></div></form><div class=ad>{'buy ' * 60}</div>") == "y"
    assert op.main_text(f"<div class=notice>{'word ' * 60}</div><div class=ad>{'buy ' * 20}</div>") == ("word " * 60).strip()
    assert op.main_text('<p class=a">A</p><p>He said "yes"</p>') == 'A\nHe said "yes"'
    assert op.main_text('<p title="a > b">A</p>') == "A"


class Article(html.parser.HTMLParser):
    """The article's blocks, for pages without nesting other than p, b and br."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "br", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_all_pages_against_a_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        parser = Article()
        parser.feed(r.html)
        assert op.main_text(r.html) == "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x), r.page_id


def test_table(spark, sf_dir):
    got = op.op9_extract(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in got)
    frame = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>a", 1), (1, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in op.extract(frame).collect()) == ["", "a", "a"] and op.extract(frame.limit(0)).count() == 0
