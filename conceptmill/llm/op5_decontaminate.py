"""Benchmark decontamination with spaced seeds: masks of token positions that ignore some, so that a hit survives substitutions.

Two masks of six selected positions hash every place of the texts and of the benchmark items. Whatever two tokens of thirteen
are replaced, one of the masks finds a place where it selects none of them. Shorter items have masks of their own. Around each hit the item is laid over the text, and
an overlap counts if thirteen aligned tokens differ in two at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, staged, table

#: Selected positions; together they hit every window of 13 with two substitutions (tests try all).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, MOST_DIFFERENT = 13, 2
#: Further masks of items of 8 to 12 tokens, and all masks of items of 7: together they hit an item with one substitution.
SHORT_MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 6, 7))
SEVEN_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4, 5, 6))
#: Least tokens of an item unless short items are asked for.
LEAST = 8
#: Scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han); each of their characters is a token. As ranges, which
#: are faster to match than names of scripts.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\x{20000}-\x{3FFFF}]"


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n tokens: whatever tokens of it are replaced, as far as allowed, one finds a place without them. No
    substitution is allowed in fewer than 7."""
    if n < 7:
        return (tuple(range(n)),) if n else ()
    return SEVEN_MASKS if n == 7 else MASKS + SHORT_MASKS if n < WINDOW else MASKS


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, and single characters of scripts without spaces; null: none."""
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    spaced = F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.regexp_replace(lower, f"({_UNSPACED})", " $1 "))
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def _placed(rows: DataFrame, masks: list[tuple[int, ...]], *keep: str, own: bool = False) -> DataFrame:
    """rows with a column words: a row for each place and mask (own: of those of the row's length), with place and seed, and the
    columns keep. The hashes are made in an array first, so that exploding copies two numbers a row and not the text."""
    least = min(m[-1] for m in masks)
    rows = rows.withColumn("n", F.greatest(F.lit(0), F.size("words") - least))

    def hashes(mask: tuple[int, ...]) -> Column:
        fits = lambda i: i + mask[-1] < F.size("words")
        if own:
            lengths = [n for n in range(1, WINDOW + 1) if mask in masks_of(n)]
            fits = lambda i: (i + mask[-1] < F.size("words")) & F.least(F.size("words"), F.lit(WINDOW)).isin(lengths)
        name = F.lit(",".join(map(str, mask)))
        return F.transform(F.slice(F.sequence(F.lit(0), F.col("n")), F.lit(1), F.col("n")), lambda i: F.when(fits(i), F.xxhash64(name, *[F.get("words", i + o) for o in mask])))

    each = [hashes(mask) for mask in masks]
    # outer: from an inner one Spark would infer a filter that makes the words anew for each hash
    seeds = rows.select(*keep, "n", F.concat(*each).alias("seeds")).select(*keep, "n", F.posexplode_outer("seeds").alias("at", "seed"))
    return seeds.filter("seed is not null").select(*keep, (F.col("at") % F.col("n")).alias("place"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """id, h (XXH64 of the text), found: an array of (item_id, shift: the text's place of the item's first token, n_equal: equal
    tokens of the laid-over item): a row for each text with a verified overlap; rows alike in id and text are one.

    The benchmark is broadcast if its seeds are few enough, and joined by a shuffle otherwise; a test set doesn't grow with
    the corpus. Items of fewer than 13 tokens count if all of them are laid over and differ in 2/13 of them at most; those of
    fewer than 8 only with short_items. The texts are hashed by the masks of the item lengths that occur. Null texts hold nothing, null ids are kept apart from others."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("words"))
    items = staged(items.filter(F.size("words") >= (1 if short_items else LEAST)), "op5-items")
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_of(n)}) or list(MASKS)
    seeds = staged(_placed(items.withColumn("n_item", F.size("words")), masks, "item_id", "n_item", own=True).withColumnsRenamed({"seed": "item_seed", "place": "item_place"}), "op5-seeds")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"), tokens(F.col(text_col)).alias("words"))
    hits = _placed(rows, masks, "id", "h").join(sized(seeds), F.col("seed") == F.col("item_seed"))
    hits = hits.select("id", "h", "item_id", "n_item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    laid = staged(hits.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("item_id", "n_item", "shift")).alias("__laid")), "op5-hits")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(sized(laid), _same_row("id", "text")).dropDuplicates(["__id", "__h"]).select(F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__laid").alias("laid"), tokens(F.col("text")).alias("words"))
    # the text's tokens under each item, a row for each; the text itself goes no further
    under = F.transform("laid", lambda x: F.struct(x["item_id"].alias("item_id"), x["n_item"].alias("n_item"), x["shift"].alias("shift"), _under(F.col("words"), x["shift"], x["n_item"]).alias("under")))
    each = staged(texts.select("id", "h", F.explode(under).alias("x")).select("id", "h", "x.*"), "op5-under")
    named = items.select(F.col("item_id").alias("i"), F.col("words").alias("item"), F.size("words").alias("n")).dropDuplicates(["i", "item"])
    named = each.join(sized(named), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("n_item") == F.col("n")))
    same = _same(F.col("item"), F.col("under"), F.col("shift"))
    good = named.withColumn("same", same).filter(_window(F.col("same"), F.col("n_item")))
    found = F.struct("item_id", "shift", F.aggregate("same", F.lit(0), lambda acc, y: acc + y).alias("n_equal"))
    return staged(good.groupBy("id", "h").agg(F.array_sort(F.collect_set(found)).alias("found")), "op5-overlaps")


def _under(words: Column, shift: Column, n: Column) -> Column:
    """The text's tokens that lie under an item of n tokens laid at shift."""
    lo, hi = F.greatest(F.lit(0), -shift), F.least(n, F.size(words) - shift)
    return F.slice(words, lo + shift + 1, hi - lo)


def _same(item: Column, under: Column, shift: Column) -> Column:
    """1 or 0 for each token of the item that lies over the text."""
    return F.zip_with(F.slice(item, F.greatest(F.lit(0), -shift) + 1, F.size(under)), under, lambda x, y: (x == y).cast("int"))


def _window(same: Column, n: Column) -> Column:
    """Whether some 13 tokens in a row (all, of a shorter item) are equal but for two."""
    need = F.least(F.lit(WINDOW), n)
    most = F.floor(need * MOST_DIFFERENT / WINDOW)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(same) - need + 1))
    return (F.size(same) >= need) & F.exists(starts, lambda s: F.aggregate(F.slice(same, s, need), F.lit(0), lambda acc, x: acc + x) >= need - most)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """id, h, items (ids, ascending), n_equal (most equal tokens of an overlap): a row for each text that holds an overlap.

    A null text holds nothing; a null id is kept apart from others; rows alike in id and text are one; an empty table of documents or
    items gives no row; a null item is skipped; items alike in id count once for each text that they have; other columns don't matter."""
    found = overlaps(docs, benchmark, id_col, text_col, short_items)
    return found.select("id", "h", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"]))).alias("items"), F.array_max(F.transform("found", lambda x: x["n_equal"])).cast("long").alias("n_equal"))


def _same_row(id_col: str, text_col: str) -> Column:
    return F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("__h"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """docs without the rows that hold an overlap with an item; columns stay as they are, whatever their names. Rows with null texts
    stay, repeated rows share their fate, and an empty benchmark drops none."""
    found = staged(contaminated(docs, benchmark, id_col, text_col, short_items).select(F.col("id").alias("__id"), F.col("h").alias("__h")), "op5-found")
    return docs.join(sized(found), _same_row(id_col, text_col), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, contaminated, items, n_equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = staged(contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True), "op5-found")
    marked = docs.join(sized(found.withColumnsRenamed({"id": "__id", "h": "__h"})), _same_row("doc_id", "text"), "left")
    return marked.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"))
