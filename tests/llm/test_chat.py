import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refrain.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\", "\\", "<s>\\<s>", " </s>", "[INST]", "a [/INST] b", "", None, "<", "s>", "[INST", "x\n\n </s> \n", "\\\\[/INST]\\", "é😀"]


def rows():
    out = [(1, k, r, t) for k, (r, t) in enumerate([("system", "be"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "end")])]
    out += [(2, 0, "user", "only")] + [(3, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    out += [(4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"), (4, None, None, None), (None, 0, "assistant", "no id"), (5, 0, "[INST] </s>", "odd role")]
    out += [(6, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    return out


def test_examples_read_back(spark):
    data = rows()
    found = chat.examples(spark.createDataFrame(data, SCHEMA).repartition(3))
    found = found.withColumns({"turns": chat.turns_of(F.col("formatted")), "loss": chat.loss_of(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))})
    by = {}
    for r in found.orderBy("conv_id", "example").collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv in {c for c, *_ in data}:
        turns = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in data if c == conv])
        want = [(role, text) for _, _, role, text in turns]
        got = by[conv]
        ends = [i + 1 for i, (role, _) in enumerate(want) if role == "assistant" or i == len(want) - 1]
        assert [r.n_turns for r in got] == ends and [r.last for r in got] == [e == len(want) for e in ends]
        for r in got:
            assert [(t.role, t.text) for t in r.turns] == want[: r.n_turns]
            role, text = want[r.n_turns - 1]
            assert r.loss == (text if role == "assistant" else "")
            raw = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
            assert chat.CLOSE not in raw


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("\\<>/s[]INT ab\n", max_size=30), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u for r in out)
    import re

    assert not any(re.search(r"(?<!\\)" + chat.CONTROL, r.e) for r in out)


def test_long_runs_of_backslashes(spark):
    text = "\\" * 50_000 + "x" + "\\" * 50_000 + "</s>"
    r = spark.createDataFrame([(text,)], "t string").select(chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.op5_chat_format(spark, sf).collect()
    assert {r.conv_id for r in got} == set(turns) and len(got) == len(turns)
    for r in got:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.examples(none).collect() == []
    more = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "parts", "n", "example", "formatted")})
    assert chat.examples(more).count() == chat.examples(spark.createDataFrame(rows(), SCHEMA)).count()
