"""Chat formatting against a plain version."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import empty
from vintara.llm import chat_log
from vintara.llm.queries import op8_chat_log, table


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _wanted(rows):
    """Digests of conversations from rows (conversation, turn, role, text)."""
    grouped: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        grouped.setdefault(conv, []).append((role or "", text or ""))
    out = set()
    for conv, turns in grouped.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out.add((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), _sha(learned)))
    return out


def _result(frame):
    return {tuple(r)[:5] for r in frame.collect()}


def _formatted(frame):
    return chat_log.render(chat_log.fold(chat_log.event_log(frame)))


def test_query(spark, folder):
    text = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert _result(op8_chat_log(spark, folder)) == _wanted([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "~0 ~1 <|end|>\n<|user|>\n[INST] ~"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"),
            (2, None, None, "no role"), (2, 0, "assistant", ""), (None, 3, "assistant", "é🙂" * 2000), (None, 3, "sy<|>\nstem", "x"), (3, 5, "assistant", None),
            (4, 0, "assistant", "y" * 512), (4, 1, "assistant", "z" * 1025)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as event", "3 as tie", "4 as seq")
    formatted = _formatted(frame)
    assert _result(chat_log.digests(chat_log.parse(formatted, "conv_id"))) == _wanted(rows)
    for row in formatted.collect():
        inner = row["formatted"].replace("<|end|>\n", "")
        assert "[" not in inner and "<|end" not in inner
        assert "".join(row["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in row["loss_spans"]) is not None
    assert _formatted(empty(frame)).count() == 0


def test_fold_follows_edits_and_regenerations(spark):
    events = [(0, "open", ""), (1, "delta", "first"), (2, "regenerate", ""), (3, "delta", "se"), (4, "delta", "cond"), (5, "edit", "edited"), (6, "delta", "!")]
    log = spark.createDataFrame([(1, 0, 1, "assistant", *e) for e in reversed(events)], "conv long, turn long, tie int, role string, seq int, kind string, text string")
    assert chat_log.fold(log).first()["text"] == "edited!"
    assert chat_log.fold(log.where("seq < 5")).first()["text"] == "second"
    assert chat_log.fold(log.where("seq < 2")).first()["text"] == "first"


def test_escapes_are_reversible(spark):
    texts = ["~", "~~0", "<~1[", "~2", "[INST]", "", "~01"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_log.escape(F.col("t"))).withColumn("back", chat_log.unescape(F.col("e")))
    assert all(r["t"] == r["back"] and "<" not in r["e"] and "[" not in r["e"] for r in frame.collect())
