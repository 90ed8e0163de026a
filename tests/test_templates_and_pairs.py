"""Chat templates compiled to expressions, and preference pairs whose sides hold the prompt."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuspack.functions import templates as TP
from corpuspack.functions import text as T
from corpuspack.functions.tokens import ByteTokenizer
from corpuspack.operators import instruct

CHATS = [
    [("system", "Be brief."), ("user", " hi \n"), ("assistant", "yo")], [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", None)], [], [(None, "x"), ("tool", "y")],
    [("user", "{{ no }} {% raw"), ("assistant", "é\n한국어")],
]


def chats(spark):
    return spark.createDataFrame([(i, m) for i, m in enumerate(CHATS)], f"id int, messages {T.MESSAGES_TYPE}")


def rendered(spark, render, **options):
    return [r.t for r in chats(spark).select("id", render("messages", **options).alias("t")).orderBy("id").collect()]


def each(chat):
    return [(r or "", c or "") for r, c in chat]


def test_chatml_with_default_system_text(spark):
    render = TP.compile_template(TP.CHATML_DEFAULT_SYSTEM)
    for chat, got, opened in zip(CHATS, rendered(spark, render), rendered(spark, render, add_generation_prompt=True)):
        want = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in each(chat))
        if chat and chat[0][0] != "system":
            want = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n" + want
        assert got == want and opened == want + "<|im_start|>assistant\n"


def test_conditions_on_roles_and_the_loop(spark):
    render = TP.compile_template(TP.ROLE_TAGS, eos_token="</s>")
    for chat, got in zip(CHATS, rendered(spark, render, add_generation_prompt=True)):
        want = "".join(f"<|{r}|>\n{c}</s>\n" if r in ("user", "system", "assistant") else "" for r, c in each(chat))
        assert got == want + ("<|assistant|>\n" if chat else "")
    assert rendered(spark, render)[1] == "<|user|>\na</s>\n<|assistant|>\nb</s>\n<|user|>\nc</s>\n"


def test_variables_set_under_conditions(spark):
    render = TP.compile_template(TP.HEADER_IDS, bos_token="<s>")
    for chat, got in zip(CHATS, rendered(spark, render)):
        want = "".join(f"<|start_header_id|>{r}<|end_header_id|>\n\n{c.strip()}<|eot_id|>" for r, c in each(chat))
        assert got == ("<s>" + want if chat else "")


def test_system_text_inside_the_first_user_turn(spark):
    """A slice of the messages, ``set`` before the loop, nested conditions and white space taken by ``-``."""
    template = """
    {%- if messages[0]['role'] == 'system' -%}
        {%- set head = '<<SYS>> ' ~ messages[0].content ~ ' <</SYS>> ' -%}{%- set rest = messages[1:] -%}
    {%- else -%}
        {%- set head = '' -%}
    {%- endif -%}
    {%- for m in messages -%}
        {%- if m.role == 'user' -%}
            {{- '[INST] ' -}}{%- if loop.index0 < 2 and not (loop.index0 == 1 and messages[0].role != 'system') -%}{{- head -}}{%- endif -%}{{- m.content | trim -}}{{- ' [/INST]' -}}
        {%- elif m.role in ['assistant', 'tool'] -%}
            {{- ' ' + m.content + eos_token -}}
        {%- endif -%}
    {%- endfor -%}
    """
    with pytest.raises(ValueError, match="rest depends"):
        TP.compile_template(template)
    render = TP.compile_template(template.replace("{%- set rest = messages[1:] -%}", ""), eos_token="$")
    got = rendered(spark, render)
    assert got[0] == "[INST] <<SYS>> Be brief. <</SYS>> hi [/INST] yo$" and got[1] == "[INST] a [/INST] b$[INST] c [/INST]" and got[4] == " y$"
    after = TP.compile_template("{% for m in messages[1:] %}{{ m['content'] }}|{{ loop.index }}{{ messages | length }};{% endfor %}")
    assert rendered(spark, after)[0] == " hi \n|13;yo|23;" and rendered(spark, after)[3] == ""


def test_white_space_of_lines(spark):
    render = TP.compile_template("a\n  {% if true %}\nb\n  {% endif %}\nc {# note #}d\n{{ 'x' }}\ny")
    assert rendered(spark, render)[0] == "a\nb\nc d\nx\ny"


@pytest.mark.parametrize("bad", [
    "{% macro f() %}{% endmacro %}", "{{ message['tool_calls'] }}", "{% for m in messages %}{{ m['name'] }}{% endfor %}", "{% for x in tools %}{% endfor %}",
    "{{ raise_exception('no') }}", "{% if true %}x", "{{ 'a' | upper }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ messages }}", "{{ 'a' +",
])
def test_what_is_not_supported_is_refused(spark, bad):
    with pytest.raises(ValueError):
        TP.compile_template(bad)


def test_rendering_stays_in_the_engine(spark):
    plan = chats(spark).select(TP.compile_template(TP.HEADER_IDS)("messages"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --------------------------------------------------------------------------- pairs


def model_pairs(chat):
    places = [i for i, (r, _) in enumerate(chat) if r == "assistant"]
    return [(chat[:a] + [chat[a]], chat[:a] + [chat[b]]) for a, b in zip(places, places[1:])]


def test_every_assistant_turn_is_used(spark):
    chat = [("user", "q"), ("assistant", "1"), ("assistant", "2"), ("system", "s"), ("user", "r"), ("assistant", "3")]
    df = spark.createDataFrame([(7, chat), (8, chat[:2]), (9, [])], f"conv_id bigint, messages {T.MESSAGES_TYPE}")
    got = instruct.pairs_of_chats(df).orderBy("pair_id").collect()
    plain = lambda m: [(x.role, x.content) for x in m]
    assert [(r.pair_id, plain(r.chosen), plain(r.rejected)) for r in got] == [(7000 + k, *p) for k, p in enumerate(model_pairs(chat))]


def model_prompt(chosen, rejected, max_length, max_prompt):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) - 1 and chosen[n] == rejected[n]:
        n += 1
    turn = lambda m: f"<|im_start|>{m[0] or ''}\n{m[1] or ''}<|im_end|>\n"
    prompt = ("".join(map(turn, chosen[:n])) + "<|im_start|>assistant\n").encode()
    kept = list(prompt[-max_prompt:])
    out = [n, kept, len(prompt) > max_prompt]
    for side in (chosen, rejected):
        text = ((side[n][1] or "") + "".join(map(turn, side[n + 1 :])) if side[n:] else "").encode()
        out += [list(text[: max_length - len(kept)]), len(text) > max_length - len(kept)]
    return tuple(out)


MESSAGE = st.tuples(st.sampled_from(["user", "assistant"]), st.sampled_from(["x", "yy", None, "long " * 30]))


@settings(max_examples=25, deadline=None)
@given(pairs=st.lists(st.tuples(st.none() | st.lists(MESSAGE, max_size=4), st.none() | st.lists(MESSAGE, max_size=4)), min_size=1, max_size=12))
def test_prompts_and_completions_are_capped_apart(spark, pairs):
    M = T.MESSAGES_TYPE
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)], f"pair_id int, chosen {M}, rejected {M}")
    got = {r.pair_id: r for r in instruct.preference_prompts(df, max_length=150, max_prompt=60).collect()}
    for i, (c, r) in enumerate(pairs):
        g = got[i]
        have = (g.n_common, list(g.prompt_ids), g.prompt_truncated, list(g.chosen_ids), g.chosen_truncated, list(g.rejected_ids), g.rejected_truncated)
        assert have == model_prompt(c, r, 150, 60)


def test_prompts_with_a_published_template(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad")])], f"pair_id int, chosen {T.MESSAGES_TYPE}, rejected {T.MESSAGES_TYPE}")
    r = instruct.preference_prompts(df, ByteTokenizer(), render=TP.compile_template(TP.ROLE_TAGS, eos_token="</s>")).first()
    assert (r.n_common, r.prompt_text, r.chosen_text, r.rejected_text) == (1, "<|user|>\nq</s>\n<|assistant|>\n", "good", "bad")


def test_ids_outside_the_vocabulary_fail(spark):
    """The guard stops a task at an id that does not fit."""
    ids = spark.createDataFrame([([1, 256],), ([5],)], "t array<int>")
    assert ids.select(ByteTokenizer().guard("t")).count() == 2
    for bad in ([257], [-1]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            spark.createDataFrame([(bad,)], "t array<int>").select(ByteTokenizer().guard("t").alias("t")).collect()
