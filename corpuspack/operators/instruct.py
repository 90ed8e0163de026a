"""Instruction, chat and preference data (G1-G6, B3-B13 applied to rows).

Rows are never collected: prompts, chats and pairs are column expressions over DataFrames;
the only grouping is per conversation (turns → messages), bounded by a chat's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.functions.tokens import ByteTokenizer, Tokenizer
from corpuspack.operators.windows import take_shuffled, with_positions

MAX_LENGTH = 2048  # tokens per example in both tuning stages


# --------------------------------------------------------------------------- G5


def chats_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Long turn table ``(conv_id, turn, role, text)`` → ``(conv_id, messages)`` in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(ordered.alias("_turns")).select(
        conv, F.transform("_turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .cast(T.MESSAGES_TYPE).alias("messages")
    )


def first_by_role(turns: DataFrame, role: str, conv: str = "conv_id", last: bool = False) -> DataFrame:
    """Text of the first (or last) turn with ``role`` in each conversation (null when none)."""
    pick = F.max_by if last else F.min_by
    return turns.groupBy(conv).agg(
        pick(F.col("text"), F.when(F.col("role") == role, F.col("turn"))).alias(role)
    )


def instruction_rows(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Flat instruction rows from a turn table: first user turn = instruction, first system
    turn = input, first assistant turn = output, last assistant turn = response."""
    is_ = lambda r: F.col("role") == r
    return turns.groupBy(conv).agg(
        F.min_by("text", F.when(is_("user"), F.col("turn"))).alias("instruction"),
        F.min_by("text", F.when(is_("system"), F.col("turn"))).alias("input"),
        F.min_by("text", F.when(is_("assistant"), F.col("turn"))).alias("output"),
        F.max_by("text", F.when(is_("assistant"), F.col("turn"))).alias("response"),
    )


def exchange_id(conv: Column, exchange: Column) -> Column:
    """The id of an exchange (numbered from 0): ``conv * 1000 + exchange`` in a chat's first thousand.

    Further ones, and those of chats whose numbers are negative or too large, are a negative 63-bit hash of both.
    """
    plain = (exchange < 1000) & conv.between(0, 1 << 53)
    return F.when(plain, conv * 1000 + exchange).otherwise(F.xxhash64(conv.cast("long"), exchange.cast("long")).bitwiseOR(F.lit(-(1 << 63))))


def exchange_rows(turns: DataFrame, conv: str = "conv_id", name: str = "row_id") -> DataFrame:
    """Flat instruction rows from a turn table, one for each exchange.

    An exchange is a user turn with the turns behind it up to the next user turn: ``output`` is its
    first assistant turn, ``response`` its last; assistant turns between them are not used, nor system
    turns behind its first. A system turn before the first user turn is the first
    exchange's ``input``, a later one that of the exchange it stands in. ``name`` is
    ``exchange_id``. A chat without a user turn is one exchange without instruction.
    """
    so_far = Window.partitionBy(conv).orderBy("turn")  # one chat: bounded by its length
    is_ = lambda r: F.col("role") == r
    number = F.greatest(F.count(F.when(is_("user"), 1)).over(so_far) - 1, F.lit(0))
    rows = turns.withColumn("_exchange", number).groupBy(conv, "_exchange").agg(
        F.min_by("text", F.when(is_("user"), F.col("turn"))).alias("instruction"),
        F.min_by("text", F.when(is_("system"), F.col("turn"))).alias("input"),
        F.min_by("text", F.when(is_("assistant"), F.col("turn"))).alias("output"),
        F.max_by("text", F.when(is_("assistant"), F.col("turn"))).alias("response"),
    )
    return rows.select(exchange_id(F.col(conv), F.col("_exchange")).alias(name), "instruction", "input", "output", "response")


# --------------------------------------------------------------------------- B10 / G1 / G2


def rows_to_chats(rows: DataFrame, extra: str = "input") -> DataFrame:
    """``instruction, input, output, response`` → two-turn chat; rows are never dropped.

    user = instruction (+ blank line + input when input is not blank), assistant =
    ``(output or response or "").strip()`` — an empty output falls through, a blank one not.
    """
    instr = T.clean("instruction")
    inp = T.clean(extra)
    out = T.strip_ws(T.first_truthy("output", "response"))
    keep = [c for c in rows.columns if c not in ("instruction", "input", "output", "response", extra)]
    return rows.select(*keep, T.user_assistant_chat(T.compose_prompt(instr, inp), out).alias("messages"))


def seed_prompts(rows: DataFrame, n: int, seed: int, id_col: str, extra: str = "input", part: int = 0) -> DataFrame:
    """G1 for one source: take ``n`` of the seeded permutation, strip, drop empty instructions,
    compose the prompt. Returns ``part, position, <id>, prompt`` (``part`` orders the sources)."""
    taken = take_shuffled(rows, n, seed, id_col)
    instr = T.clean("instruction")
    inp = T.clean(extra)
    shaped = taken.select(F.lit(part).alias("part"), "position", id_col, instr.alias("_i"), inp.alias("_x"))
    return shaped.filter(F.col("_i") != "").select(
        "part", "position", id_col, T.compose_prompt("_i", "_x").alias("prompt")
    )


def attach_responses(prompts: DataFrame, responses: DataFrame, id_col: str) -> DataFrame:
    """Join prompts to their generated responses (by id), strip, drop empty, build chats."""
    resp = responses.select(id_col, T.clean("response").alias("_r")).filter(F.col("_r") != "")
    j = prompts.join(resp, id_col)
    return j.select(*[c for c in prompts.columns if c != "prompt"],
                    T.user_assistant_chat("prompt", "_r").alias("messages"))


# --------------------------------------------------------------------------- G3 / G4


def tuning_mix(
    chats: DataFrame | None = None,
    rows: DataFrame | None = None,
    jsonl: DataFrame | None = None,
    seed: int = 42,
    chats_id: str | None = None,
    rows_id: str | None = None,
) -> DataFrame:
    """The tuning set. A JSONL chat set, if given, replaces both sources; else chats ∪
    converted instruction rows. Then a seeded permutation (``position``); neither → error. The id
    columns are those of the scans (``id``) unless named otherwise.

    Output: ``origin, id, position, messages``.
    """
    if jsonl is not None:
        if "id" not in jsonl.columns:  # a set that did not come from a scan
            from corpuspack.sources.registry import with_row_id

            jsonl = with_row_id(jsonl.select("messages"), F.coalesce(T.messages_json("messages"), F.lit("")))
        parts = [jsonl.select(F.lit("jsonl").alias("origin"), F.col("id").cast("bigint").alias("id"), "messages")]
    else:
        parts = []
        named = lambda df, given: given or next(c for c in ("id", "row_id", "conv_id") if c in df.columns)
        if chats is not None:
            chats_id = named(chats, chats_id)
            parts.append(chats.select(F.lit("chats").alias("origin"), F.col(chats_id).cast("bigint").alias("id"),
                                      "messages"))
        if rows is not None:
            rows_id = named(rows, rows_id)
            conv = rows_to_chats(rows)
            parts.append(conv.select(F.lit("rows").alias("origin"), F.col(rows_id).cast("bigint").alias("id"),
                                     "messages"))
    if not parts:
        raise ValueError("no tuning data: give a JSONL set, chats or instruction rows")
    mix = parts[0]
    for p in parts[1:]:
        mix = mix.unionByName(p)
    keyed = mix.withColumn("_key", F.concat_ws(":", "origin", "id"))
    return with_positions(keyed, seed, "_key").select("origin", "id", "position", "messages")


def mix_counts(mix: DataFrame) -> DataFrame:
    """Examples per set."""
    return mix.groupBy("origin").agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"))


# --------------------------------------------------------------------------- B12 / B13 / G6


def capped_examples(
    mix: DataFrame, tokenizer: Tokenizer | None = None, max_length: int = MAX_LENGTH
) -> DataFrame:
    """B12 + B13 on the tuning set: each chat rendered and its ids cut at ``max_length``.

    Adds ``n_tokens`` (of the whole example), ``truncated`` and ``ids``.
    """
    tokenizer = tokenizer or ByteTokenizer()
    rendered = mix.withColumn("_rendered", T.render_chat("messages"))
    n, _, cut = capped_length(F.col("_rendered"), tokenizer, max_length)
    ids = F.slice(tokenizer.encode("_rendered"), 1, max_length)
    return rendered.select(*mix.columns, n.alias("n_tokens"), cut.alias("truncated"), ids.alias("ids"))


def capped_length(rendered, tokenizer: Tokenizer | None = None, max_length: int = MAX_LENGTH):
    """B13 on a rendered string: ``(n_tokens, kept, truncated)`` expressions."""
    tokenizer = tokenizer or ByteTokenizer()
    n = tokenizer.count(rendered) - F.lit(1)  # no end-of-document mark in a chat example
    return n, F.least(n, F.lit(max_length)), n > F.lit(max_length)


def preference_pairs(pairs: DataFrame, tokenizer: Tokenizer | None = None, max_length: int = MAX_LENGTH,
                     with_tokens: bool = False) -> DataFrame:
    """Render both sides of each pair (B12) and cap them at ``max_length`` tokens."""
    tokenizer = tokenizer or ByteTokenizer()
    cols = ["pair_id"]
    out = pairs
    for side in ("chosen", "rejected"):
        r = T.render_chat(side)
        n, kept, cut = capped_length(r, tokenizer, max_length)
        out = out.withColumn(f"{side}_text", r)
        cols += [n.alias(f"{side}_tokens"), kept.alias(f"{side}_kept"), cut.alias(f"{side}_truncated")]
        if with_tokens:
            cols.append(F.slice(tokenizer.encode(F.col(f"{side}_text")), 1, max_length).alias(f"{side}_ids"))
    return out.select(*cols, "chosen_text", "rejected_text")


def pairs_from_turns(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Preference pairs from a turn table: first assistant turn (chosen) against the last
    (rejected), where they differ; prompt = first user turn."""
    rows = instruction_rows(turns, conv)
    diff = rows.filter(F.col("output").isNotNull() & (F.col("output") != F.col("response")))
    prompt = F.coalesce(F.col("instruction"), F.lit(""))
    return diff.select(
        F.col(conv).alias("pair_id"), prompt.alias("prompt"),
        T.user_assistant_chat(prompt, "output").alias("chosen"),
        T.user_assistant_chat(prompt, "response").alias("rejected"),
    )


# --------------------------------------------------------------------------- G6 with the prompt inside


MAX_PROMPT = 1024  # tokens of a prompt, its end


def pairs_of_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Preference sets as they are published: both message lists hold the prompt. Each assistant turn of a chat that
    has a later one is preferred to the next: ``pair_id`` (``exchange_id`` of the chat and the turn's place among
    its assistant turns), ``chosen`` and ``rejected``, which share all turns before the preferred one."""
    places = F.filter(F.sequence(F.lit(1), F.size("messages")), lambda i: F.element_at("messages", i)["role"] == "assistant")
    chats = chats.filter(F.size("messages") > 1).select(F.col(conv).alias("_conv"), "messages", places.alias("_at")).filter(F.size("_at") > 1)
    k = F.col("_k")
    one = chats.select("_conv", "messages", "_at", F.explode(F.sequence(F.lit(1), F.size("_at") - 1)).alias("_k"))
    first, second = F.element_at("_at", k), F.element_at("_at", k + 1)
    before = F.slice("messages", F.lit(1), first - 1)
    side = lambda at: F.concat(before, F.array(F.element_at("messages", at)))
    return one.select(exchange_id(F.col("_conv"), k - 1).alias("pair_id"), side(first).alias("chosen"), side(second).alias("rejected"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many messages two lists begin with in common; each keeps one message of its own at least."""
    least = F.least(F.size(a), F.size(b)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(least < 1, F.lit(0)).otherwise(F.when(differs == 0, least).otherwise(differs - 1))


def preference_prompts(
    pairs: DataFrame, tokenizer: Tokenizer | None = None, max_length: int = MAX_LENGTH, max_prompt: int = MAX_PROMPT, render=None
) -> DataFrame:
    """G6 for pairs whose sides both hold the prompt (``pair_id, chosen, rejected``).

    The prompt is what the two lists begin with in common, rendered with an open assistant turn; the completions
    are the rest. They are capped apart: the prompt keeps its last ``max_prompt`` ids, a completion its first,
    up to ``max_length`` ids of both together. A null or empty side has an empty completion."""
    tokenizer = tokenizer or ByteTokenizer()
    render = render or T.render_chat
    n = F.col("_n")
    whole = lambda c: F.coalesce(F.col(c), F.array().cast(T.MESSAGES_TYPE))
    filled = pairs.select("pair_id", whole("chosen").cast(T.MESSAGES_TYPE).alias("chosen"), whole("rejected").cast(T.MESSAGES_TYPE).alias("rejected"))
    cut = filled.withColumn("_n", common_prefix(F.col("chosen"), F.col("rejected")))
    marked = render("_prompt", add_generation_prompt=True)
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    answer = lambda c: F.concat(T.null_to_empty(F.get(c, F.lit(0))["content"]), F.when(F.size(c) > 1, render(F.slice(c, F.lit(2), F.size(c)))).otherwise(F.lit("")))
    parts = cut.select("pair_id", "_n", F.slice("chosen", F.lit(1), n).alias("_prompt"), rest("chosen").alias("_c"), rest("rejected").alias("_r"))
    texts = parts.select(
        "pair_id", n.alias("n_common"), marked.alias("prompt_text"),
        F.when(F.size("_c") > 0, answer(F.col("_c"))).otherwise("").alias("chosen_text"), F.when(F.size("_r") > 0, answer(F.col("_r"))).otherwise("").alias("rejected_text"),
    )
    ids = texts.withColumn("_ids", tokenizer.encode("prompt_text"))
    kept = F.least(F.size("_ids"), F.lit(max_prompt))
    out = ids.withColumn("prompt_ids", F.slice("_ids", F.size("_ids") - kept + 1, kept)).withColumn("prompt_truncated", F.size("_ids") > max_prompt)
    room = F.lit(max_length) - F.size("prompt_ids")
    for side in ("chosen", "rejected"):
        out = out.withColumn("_ids", tokenizer.encode(f"{side}_text"))
        out = out.withColumn(f"{side}_ids", F.slice("_ids", F.lit(1), room)).withColumn(f"{side}_truncated", F.size("_ids") > room)
    return out.drop("_ids")
