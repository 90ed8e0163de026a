"""Scalar text rules (strip, first truthy, prompt) and instruction / chat / preference data."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.operators import instruct, scores

WS_ALPHABET = list(T.WHITESPACE) + list("ab é漢😀​")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=WS_ALPHABET, max_size=12), min_size=40, max_size=40))
def test_strip_equals_python(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", T.strip_ws("s").alias("t")).collect()}
    assert got == {i: s.strip() for i, s in enumerate(strings)}


EDGE_INSTR = [
    (1, None, None, None, None),
    (2, "  ", "ctx", "out", None),
    (3, "Do it", None, "", "resp"),
    (4, "Do it", "", " ", "resp"),
    (5, "　Ask\x1f", "　more　", None, "  answer \n"),
]


def test_rows_to_chats_edges(spark):
    rows = spark.createDataFrame(EDGE_INSTR, "id bigint, instruction string, input string, output string, response string")
    chats = {r.id: [(m.role, m.content) for m in r.messages] for r in instruct.rows_to_chats(rows).collect()}
    assert len(chats) == 5  # never drops rows
    assert chats[1] == [("user", ""), ("assistant", "")]
    assert chats[2] == [("user", "\n\nctx"), ("assistant", "out")]
    assert chats[3][1] == ("assistant", "resp")  # empty output falls through
    assert chats[4][1] == ("assistant", "")  # blank output does not fall through, then strips
    assert chats[5] == [("user", "Ask\n\nmore"), ("assistant", "answer")]


def test_seed_prompts_drop_blank_and_take_n(spark):
    rows = spark.createDataFrame(EDGE_INSTR, "id bigint, instruction string, input string, output string, response string")
    out = instruct.seed_prompts(rows, 5, 0, "id").collect()
    assert sorted(r.id for r in out) == [3, 4, 5]
    assert sorted(r.position for r in instruct.seed_prompts(rows, 2, 0, "id").collect()) == [
        p for p in sorted(r.position for r in out) if p < 2
    ]
    import pytest

    with pytest.raises(ValueError):
        instruct.seed_prompts(rows, 6, 0, "id")
    assert instruct.seed_prompts(rows, 0, 0, "id").count() == 0


def test_attach_responses_drops_empty(spark):
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3"), (4, "p4")], "prompt_id bigint, prompt string")
    resp = spark.createDataFrame([(1, None), (2, ""), (3, " 　"), (4, "  ok  ")], "prompt_id bigint, response string")
    got = instruct.attach_responses(prompts, resp, "prompt_id").collect()
    assert [(r.prompt_id, [m.content for m in r.messages]) for r in got] == [(4, ["p4", "ok"])]


def test_render_and_json(spark):
    df = spark.createDataFrame([(1,)], "i int").select(
        T.user_assistant_chat(F.lit("hé \"q\""), F.lit("a")).alias("m"))
    r = df.select(T.render_chat("m", add_generation_prompt=True).alias("r"), T.messages_json("m").alias("j")).first()
    assert r.r == "<|im_start|>user\nhé \"q\"<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n"
    assert json.loads(r.j) == [{"role": "user", "content": "hé \"q\""}, {"role": "assistant", "content": "a"}]
    assert "hé" in r.j  # UTF-8 left unescaped


def test_tuning_mix_sources(spark):
    import pytest

    with pytest.raises(ValueError):
        instruct.tuning_mix()
    chats = spark.createDataFrame([(1, [("user", "u"), ("assistant", "a")])], f"conv_id bigint, messages {T.MESSAGES_TYPE}")
    rows = spark.createDataFrame(EDGE_INSTR, "conv_id bigint, instruction string, input string, output string, response string")
    mix = instruct.tuning_mix(chats=chats, rows=rows)
    assert sorted(r.position for r in mix.collect()) == list(range(6))
    jsonl = spark.createDataFrame([(7, [("user", "x"), ("assistant", "y")])], f"id bigint, messages {T.MESSAGES_TYPE}")
    only = instruct.tuning_mix(chats=chats, rows=rows, jsonl=jsonl)  # a JSONL set replaces both
    assert [r.origin for r in only.collect()] == ["jsonl"]
    lines = spark.createDataFrame([([("user", f"q{i}"), ("assistant", "a")],) for i in range(5)],
                                  f"messages {T.MESSAGES_TYPE}")
    from_file = instruct.tuning_mix(jsonl=lines).collect()
    assert sorted(r.position for r in from_file) == list(range(5)) and len({r.id for r in from_file}) == 5


def test_preference_cap(spark):
    long = "x" * 3000
    pairs = spark.createDataFrame(
        [(1, "p", [("user", "p"), ("assistant", long)], [("user", "p"), ("assistant", "no")])],
        f"pair_id bigint, prompt string, chosen {T.MESSAGES_TYPE}, rejected {T.MESSAGES_TYPE}",
    )
    r = instruct.preference_pairs(pairs, with_tokens=True).first()
    assert r.chosen_truncated and r.chosen_kept == 2048 and len(r.chosen_ids) == 2048
    assert not r.rejected_truncated and r.rejected_kept == r.rejected_tokens == len(r.rejected_ids)


def test_score_table_missing_task(spark):
    s = spark.createDataFrame(
        [("run", "a", 1, 1), ("run", "a", 2, 0), ("baseline", "a", 1, 0), ("run", "b", 1, 1)],
        "tag string, task string, item_id bigint, correct int")
    got = {r.task: r for r in scores.score_table(s).collect()}
    assert got["a"].run == 0.5 and got["a"].baseline == 0.0 and got["a"].delta == 0.5
    assert got["b"].baseline is None and got["b"].delta is None and got["b"].n_baseline == 0


def test_ids_of_a_chat_of_many_exchanges(spark):
    """More than a thousand user turns in one chat: no id is another chat's."""
    turns = spark.range(4600).selectExpr(
        "id div 2300 AS conv_id", "id % 2300 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text"
    )
    from corpuspack.operators import instruct

    rows = instruct.exchange_rows(turns).collect()
    assert len(rows) == len({r["row_id"] for r in rows}) == 2300
    ids = {r["instruction"]: r["row_id"] for r in rows}
    assert ids["t0"] == 0 and ids["t1998"] == 999 and ids["t2300"] == 1000 and ids["t2000"] < 0
