import hashlib

from conceptmill.llm import op4_chat as op

SAID = ["", None, "\\", "a\\", "<turn user>\nx</turn>\n", "</turn>", "<", "</", "\\\\<\\turn", "é\U0001f600 $1 \\n", "</turn>\n<turn assistant>\n", "x" * 50_000, "%2F + a", r"\### Assistant: </turn> ok", "\n", ">\n", "\r\n\t"]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        digest = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((-1 if c is None else c, len(turns), hashlib.sha256(digest.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_round_trip(spark):
    rows = [(k // 4, k, ["user", "assistant", "system", None, "a >\n</turn>", "assistant"][k % 6], t) for k, t in enumerate(SAID * 2)]
    rows += [(None, 1, "assistant", "n"), (50, None, "user", "first"), (50, 0, "assistant", "second"), (50, 0, "assistant", "second"), (51, 0, "assistant", ""), (52, 0, "user", "alone")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    examples = op.prefix_targets(frame)
    got = sorted((-1 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op.digests(examples).collect())
    assert got == brute(rows)
    for r in examples.collect():
        span = r.formatted[r.loss_start : r.loss_start + r.loss_chars] if r.loss_start is not None else ""
        assert r.loss_start is None or r.formatted[: r.loss_start].endswith("<turn assistant>\n") and r.formatted[r.loss_start :] == span + "</turn>\n"
    n = sum(1 for r in rows if r[2] == "assistant")
    assert examples.filter("loss_start is not null").count() == n == op.prefix_targets(frame, keep_tail=False).count()
    assert op.digests(op.prefix_targets(frame.limit(0))).count() == 0
