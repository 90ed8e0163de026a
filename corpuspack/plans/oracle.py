"""DuckDB SQL for each registered query, over the fixture tables as views.

Written independently of the Spark plans where a second formulation exists: plain global
windows instead of two-level prefix sums, a cumulative sum over batches instead of the
closed-form cutoff, shard lengths from arithmetic instead of summed pieces.
"""

from __future__ import annotations

from corpuspack.operators.mixture import mixture_budgets
from corpuspack.operators.scores import DEFAULT_TASKS, TAGS
from corpuspack.plans.queries import (
    BATCH_DOCS, BLOCK_TOKENS, BUDGET_SHARE, CORPORA, DIRTY_PADS, GRAD_ACCUM, MICRO_BATCH, RANKS, PARTIAL_TARGETS, SCORE_WINDOW, SEED, SEED_EN, SEED_KO, SEED_MIX, SEQ_LEN,
    SHARD_TOKENS, SMALL_TARGETS, SOURCE_ORDER, STEPS, TARGETS, TRAIN_SEQ_LEN,
)

S = SHARD_TOKENS
B = BATCH_DOCS


def target_values(targets: dict) -> str:
    return ", ".join(f"('{k}', CAST({'NULL' if v is None else v} AS BIGINT))" for k, v in targets.items())


_TARGETS_VALUES = target_values(TARGETS)

DOCS = "SELECT lang AS source, doc_id AS doc_seq, text FROM documents WHERE text IS NOT NULL AND text <> ''"

COUNTS = f"""
SELECT source, doc_seq, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens FROM ({DOCS}) d
"""

OFFSETS = f"""
SELECT source, doc_seq, n_tokens,
       CAST(row_number() OVER w - 1 AS BIGINT) AS rank,
       CAST(coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST((row_number() OVER w - 1) // {B} AS BIGINT) AS batch
FROM ({COUNTS}) c
WINDOW w AS (PARTITION BY source ORDER BY doc_seq)
"""

def cut_sql(targets: dict) -> str:
    return f"""
WITH o AS ({OFFSETS}),
t AS (SELECT * FROM (VALUES {target_values(targets)}) AS t(source, target)),
b AS (SELECT source, batch, sum(n_tokens) AS bt FROM o GROUP BY source, batch),
c AS (SELECT b.source, b.batch, t.target,
             CAST(sum(b.bt) OVER (PARTITION BY b.source ORDER BY b.batch) AS BIGINT) AS cb
      FROM b JOIN t ON b.source = t.source),
hit AS (SELECT source, min(batch) AS hit_batch FROM c WHERE (cb // {S}) * {S} >= target GROUP BY source),
tot AS (SELECT source, count(*) AS n_docs, sum(n_tokens) AS total, max(batch) AS last_batch
        FROM o GROUP BY source),
k AS (
  SELECT tot.source, tot.n_docs, tot.total, t.target, tot.last_batch, hit.hit_batch,
         CASE WHEN hit.hit_batch IS NULL THEN tot.total ELSE (c.cb // {S}) * {S} END AS kept
  FROM tot JOIN t ON tot.source = t.source
  LEFT JOIN hit ON hit.source = tot.source
  LEFT JOIN c ON c.source = hit.source AND c.batch = hit.hit_batch)
SELECT source,
       CAST(n_docs AS BIGINT) AS n_docs,
       CAST(total AS BIGINT) AS total_tokens,
       CAST(target AS BIGINT) AS target,
       CAST(kept AS BIGINT) AS kept_tokens,
       hit_batch IS NOT NULL AS reached,
       CAST(coalesce(hit_batch, last_batch) AS BIGINT) AS stop_batch,
       CAST((kept + {S - 1}) // {S} AS BIGINT) AS n_shards
FROM k
"""


CUT = cut_sql(TARGETS)

def shards_sql(cut: str) -> str:
    return f"""
SELECT k.source, CAST(i AS INTEGER) AS shard_idx,
       CAST(least({S}, k.kept_tokens - i * {S}) AS BIGINT) AS n_tokens,
       CAST(least((i + 1) * {S}, k.kept_tokens) AS BIGINT) AS written,
       k.target
FROM ({cut}) k, range(0, k.n_shards) AS r(i)
"""


SHARDS = shards_sql(CUT)

IDS = """
SELECT lang AS source, doc_id AS doc_seq,
       list_append(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INTEGER), 256) AS ids
FROM documents WHERE text IS NOT NULL AND text <> ''
"""

def pieces_sql(cut: str) -> str:
    return f"""
WITH o AS ({OFFSETS}), k AS ({cut}),
p AS (SELECT o.source, o.doc_seq, o."offset", o.n_tokens, k.kept_tokens,
             unnest(range(o."offset" // {S}, (least(o."offset" + o.n_tokens, k.kept_tokens) - 1) // {S} + 1)) AS shard_idx
      FROM o JOIN k ON o.source = k.source WHERE o."offset" < k.kept_tokens),
q AS (SELECT source, doc_seq, shard_idx, "offset",
             greatest("offset", shard_idx * {S}) AS lo,
             least(least("offset" + n_tokens, kept_tokens), (shard_idx + 1) * {S}) AS hi
      FROM p)
SELECT q.source, CAST(q.shard_idx AS INTEGER) AS shard_idx, CAST(q.lo - q.shard_idx * {S} AS BIGINT) AS pos,
       q.doc_seq, CAST(q.hi - q.lo AS BIGINT) AS n_tokens,
       list_slice(i.ids, q.lo - q."offset" + 1, q.hi - q."offset") AS t
FROM q JOIN ({IDS}) i ON i.source = q.source AND i.doc_seq = q.doc_seq
"""


PIECES = pieces_sql(CUT)

SEGMENTS = f"""
SELECT source, shard_idx, pos, doc_seq, n_tokens, t[1] AS first_id, t[-1] AS last_id,
       CAST(list_sum(t) AS BIGINT) AS id_sum, array_to_string(t, ',') AS tokens_csv
FROM ({PIECES}) x
"""

AUDIT = f"""
WITH o AS ({OFFSETS}), k AS ({CUT})
SELECT o.source,
       CAST(count(*) FILTER (WHERE o."offset" + o.n_tokens <= k.kept_tokens) AS BIGINT) AS docs_kept,
       CAST(count(*) FILTER (WHERE o."offset" < k.kept_tokens AND o."offset" + o.n_tokens > k.kept_tokens) AS BIGINT)
         AS docs_cut,
       CAST(0 AS BIGINT) AS docs_differ
FROM o JOIN k ON o.source = k.source
WHERE o."offset" < k.kept_tokens
GROUP BY o.source
"""

PER_SOURCE = f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_shards, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM ({SHARDS}) s GROUP BY source
"""

WEIGHTS = f"""
SELECT source, n_shards, n_tokens,
       n_shards / sum(n_shards) OVER () AS shard_weight,
       n_tokens / sum(n_tokens) OVER () AS token_share
FROM ({PER_SOURCE}) p
"""

_TPS = MICRO_BATCH * GRAD_ACCUM * RANKS * TRAIN_SEQ_LEN
_TRAINED = STEPS * _TPS
EPOCHS = f"""
WITH p AS ({PER_SOURCE})
SELECT source, n_shards, n_tokens, CAST({_TPS} AS BIGINT) AS tokens_per_step, CAST({STEPS} AS BIGINT) AS steps,
       CAST({_TRAINED} AS BIGINT) AS trained_tokens,
       ({_TRAINED} * n_shards) / (sum(n_shards) OVER () * n_tokens) AS epochs
FROM p
UNION ALL
SELECT '*', CAST(sum(n_shards) AS BIGINT), CAST(sum(n_tokens) AS BIGINT), CAST({_TPS} AS BIGINT),
       CAST({STEPS} AS BIGINT), CAST({_TRAINED} AS BIGINT), {_TRAINED} / sum(n_tokens)
FROM p
"""

_ORDER_VALUES = ", ".join(f"('{s}', {i})" for i, s in enumerate(SOURCE_ORDER))
L = SEQ_LEN
DRAWS = f"""
WITH sh AS (SELECT source, shard_idx, n_tokens FROM ({SHARDS}) s),
ord AS (SELECT * FROM (VALUES {_ORDER_VALUES}) AS o(source, ord)),
per AS (SELECT sh.source, ord.ord, count(*) AS n FROM sh JOIN ord ON sh.source = ord.source GROUP BY sh.source, ord.ord),
base AS (SELECT source, coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
                sum(n) OVER () AS total FROM per),
num AS (SELECT base.base + sh.shard_idx AS shard_no, sh.source, sh.shard_idx, sh.n_tokens AS shard_len, base.total
        FROM sh JOIN base ON sh.source = base.source),
cnt AS (SELECT CAST(sum(n_tokens) // {L} AS BIGINT) AS n_samples FROM sh),
d AS (SELECT r.i AS sample_id FROM cnt, range(0, cnt.n_samples) AS r(i)),
dr AS (SELECT sample_id,
              ('0x' || substr(md5('{SEED}:' || sample_id || ':shard'), 1, 15))::BIGINT % (SELECT max(total) FROM num)
                AS shard_no
       FROM d)
SELECT dr.sample_id, num.source, num.shard_idx, num.shard_len,
       ('0x' || substr(md5('{SEED}:' || dr.sample_id || ':start'), 1, 15))::BIGINT
         % greatest(num.shard_len - {L} - 1, 1) AS start
FROM dr JOIN num ON dr.shard_no = num.shard_no
"""

WINDOW_TOKENS = f"""
WITH tok AS (
  SELECT source, shard_idx, pos + generate_subscripts(t, 1) - 1 AS p, unnest(t) AS id FROM ({PIECES}) x),
d AS ({DRAWS})
SELECT d.sample_id, d.source, d.shard_idx, d.start,
       array_to_string(list(tok.id ORDER BY tok.p) FILTER (WHERE tok.p < d.start + {L}), ',') AS x,
       array_to_string(list(tok.id ORDER BY tok.p) FILTER (WHERE tok.p > d.start), ',') AS y
FROM d JOIN tok ON tok.source = d.source AND tok.shard_idx = d.shard_idx
  AND tok.p >= d.start AND tok.p <= d.start + {L}
GROUP BY d.sample_id, d.source, d.shard_idx, d.start
"""

_PER_RANK = MICRO_BATCH * GRAD_ACCUM
_PER_STEP = _PER_RANK * RANKS
LAYOUT = f"""
SELECT sample_id, source, shard_idx, start,
       sample_id // {_PER_STEP} AS step, (sample_id % {_PER_STEP}) // {_PER_RANK} AS rank,
       (sample_id % {_PER_RANK}) // {MICRO_BATCH} AS micro, sample_id % {MICRO_BATCH} AS slot
FROM ({DRAWS}) d
"""

# --------------------------------------------------------------------------- instruction data

# Every character with the Unicode White_Space property, and the four separators U+001C to U+001F.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "(" + " || ".join(f"chr({n})" for n in _SPACES) + ")"
NL = "chr(10)"


def clean(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WS})"


def hkey(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


def chat_json(user: str, assistant: str) -> str:
    return (f"CAST(to_json([{{'role': 'user', 'content': {user}}}, {{'role': 'assistant', 'content': {assistant}}}])"
            " AS VARCHAR)")


def render(parts: list[tuple[str, str]], open_turn: bool = False) -> str:
    body = " || ".join(f"'<|im_start|>{r}' || {NL} || {c} || '<|im_end|>' || {NL}" for r, c in parts)
    return body + (f" || '<|im_start|>assistant' || {NL}" if open_turn else "")


ROWS = """
SELECT conv_id,
       arg_min(text, turn) FILTER (WHERE role = 'user') AS instruction,
       arg_min(text, turn) FILTER (WHERE role = 'system') AS input,
       arg_min(text, turn) FILTER (WHERE role = 'assistant') AS output,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response
FROM conversations GROUP BY conv_id
"""

EXCHANGES = """
SELECT conv_id * 1000 + e AS row_id,
       arg_min(text, turn) FILTER (WHERE role = 'user') AS instruction,
       arg_min(text, turn) FILTER (WHERE role = 'system') AS input,
       arg_min(text, turn) FILTER (WHERE role = 'assistant') AS output,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response
FROM (SELECT *, greatest((SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn <= c.turn AND p.role = 'user') - 1, 0) AS e
      FROM conversations c) x
GROUP BY conv_id, e
"""

STRIP = f"""
SELECT conv_id, turn, {clean('text')} AS stripped, {clean('text')} <> coalesce(text, '') AS changed
FROM conversations
"""


def _seed_part(part: int, seed: int, limit: str) -> str:
    return f"""
SELECT {part} AS part, position, row_id,
       CASE WHEN x = '' THEN i ELSE i || {NL} || {NL} || x END AS prompt
FROM (SELECT row_id, {clean('instruction')} AS i, {clean('input')} AS x,
             row_number() OVER (ORDER BY {hkey(seed, 'row_id')}, row_id) - 1 AS position
      FROM ({EXCHANGES}) r) s
WHERE position < {limit} AND i <> ''
"""


SEEDS = f"""
{_seed_part(0, SEED_KO, f"(SELECT count(*) FROM ({EXCHANGES}) c)")}
UNION ALL
{_seed_part(1, SEED_EN, f"(SELECT count(*) // 2 FROM ({EXCHANGES}) c)")}
"""

_USER = f"CASE WHEN {clean('input')} = '' THEN {clean('instruction')} ELSE {clean('instruction')} || {NL} || {NL} || {clean('input')} END"
_ASSISTANT = "trim(coalesce(nullif(output, ''), nullif(response, ''), ''), " + WS + ")"
ROW_CHATS = f"SELECT row_id, {chat_json(_USER, _ASSISTANT)} AS messages_json FROM ({EXCHANGES}) r"

TURN_CHATS = """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS messages_json
FROM conversations GROUP BY conv_id
"""

RENDER = f"""
SELECT c.conv_id,
       string_agg('<|im_start|>' || c.role || {NL} || c.text || '<|im_end|>' || {NL}, '' ORDER BY c.turn) AS rendered,
       {render([("user", "coalesce(any_value(r.instruction), '')")], open_turn=True)} AS prompt
FROM conversations c JOIN ({ROWS}) r ON r.conv_id = c.conv_id
GROUP BY c.conv_id
"""

MIX = f"""
WITH u AS (
  SELECT 'chats' AS origin, conv_id AS id, messages_json FROM ({TURN_CHATS}) t
  UNION ALL
  SELECT 'rows' AS origin, row_id AS id, messages_json FROM ({ROW_CHATS}) r)
SELECT origin, id,
       row_number() OVER (ORDER BY {hkey(SEED_MIX, "origin || ':' || id")}, origin || ':' || id) - 1 AS position,
       messages_json
FROM u
"""

MIX_COUNTS = f"SELECT origin, CAST(count(*) AS BIGINT) AS n_examples FROM ({MIX}) m GROUP BY origin"

DISTILLED = f"""
WITH p AS ({SEEDS}),
r AS (SELECT row_id, {clean('output')} AS resp FROM ({EXCHANGES}) x)
SELECT p.part, p.position, p.row_id, {chat_json('p.prompt', 'r.resp')} AS messages_json
FROM p JOIN r ON p.row_id = r.row_id
WHERE r.resp <> ''
"""

_CHOSEN = render([("user", "prompt"), ("assistant", "output")])
_REJECTED = render([("user", "prompt"), ("assistant", "response")])
PREFS = f"""
WITH d AS (SELECT conv_id AS pair_id, coalesce(instruction, '') AS prompt, output, response
           FROM ({ROWS}) r WHERE output IS NOT NULL AND output <> response),
x AS (SELECT pair_id, {_CHOSEN} AS c, {_REJECTED} AS j FROM d)
SELECT pair_id,
       CAST(octet_length(encode(c)) AS BIGINT) AS chosen_tokens,
       CAST(least(octet_length(encode(c)), 2048) AS BIGINT) AS chosen_kept,
       octet_length(encode(c)) > 2048 AS chosen_truncated,
       CAST(octet_length(encode(j)) AS BIGINT) AS rejected_tokens,
       CAST(least(octet_length(encode(j)), 2048) AS BIGINT) AS rejected_kept,
       octet_length(encode(j)) > 2048 AS rejected_truncated,
       md5(c) AS chosen_md5, md5(j) AS rejected_md5
FROM x
"""

_TASKS = ", ".join(f"'{t}'" for t in DEFAULT_TASKS)
_TAGS = ", ".join(f"'{t}'" for t in TAGS)
_SPANS = f"""
SELECT DISTINCT {{key}}, array_to_string(list_slice(w, i, i + {SCORE_WINDOW - 1}), ' ') AS span
FROM (SELECT {{key}}, w, unnest(range(1, len(w) - {SCORE_WINDOW - 2})) AS i
      FROM (SELECT {{key}}, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM {{rows}}) a) b
"""
SCORES = f"""
WITH f AS (
  SELECT b.item_id, 1 AS run, max(CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END) AS baseline
  FROM ({_SPANS.format(key="doc_id", rows="documents")}) d JOIN ({_SPANS.format(key="item_id", rows="benchmark")}) b ON d.span = b.span
  GROUP BY b.item_id),
s AS (
  SELECT tg.tag, ([{_TASKS}])[b.item_id % {len(DEFAULT_TASKS)} + 1] AS task, b.item_id,
         coalesce(CASE tg.tag WHEN 'run' THEN f.run ELSE f.baseline END, 0) AS correct
  FROM benchmark b LEFT JOIN f ON f.item_id = b.item_id, (SELECT unnest([{_TAGS}]) AS tag) tg
  WHERE NOT (([{_TASKS}])[b.item_id % {len(DEFAULT_TASKS)} + 1] = 'haerae' AND tg.tag = 'baseline'))
SELECT task,
       avg(correct) FILTER (WHERE tag = 'run') AS run,
       avg(correct) FILTER (WHERE tag = 'baseline') AS baseline,
       avg(correct) FILTER (WHERE tag = 'run') - avg(correct) FILTER (WHERE tag = 'baseline') AS delta,
       CAST(count(correct) FILTER (WHERE tag = 'run') AS BIGINT) AS n_run,
       CAST(count(correct) FILTER (WHERE tag = 'baseline') AS BIGINT) AS n_baseline
FROM s GROUP BY task
"""

STREAM_TOTALS = f"""
WITH t AS (SELECT * FROM (VALUES {_TARGETS_VALUES}) AS t(source, target)),
a AS (SELECT source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
      FROM ({COUNTS}) c GROUP BY source)
SELECT a.source, a.n_docs, a.n_tokens, CAST(t.target AS BIGINT) AS target,
       coalesce(a.n_tokens >= t.target, false) AS target_reached
FROM a LEFT JOIN t ON a.source = t.source
"""

STREAM_SEGMENTS = "SELECT source, shard_idx, pos, doc_seq, array_to_string(t, ',') AS tokens_csv FROM ({pieces}) x"

BIN_BLOCKS = f"""
WITH tok AS (
  SELECT source, shard_idx, pos + generate_subscripts(t, 1) - 1 AS p, unnest(t) AS id FROM ({PIECES}) x)
SELECT source, shard_idx, CAST(p // {BLOCK_TOKENS} * {BLOCK_TOKENS} AS BIGINT) AS pos,
       array_to_string(list(id ORDER BY p), ',') AS tokens_csv
FROM tok GROUP BY source, shard_idx, p // {BLOCK_TOKENS}
"""

SCAN_JSON = """
SELECT 'the-stack' AS source, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_seq, text FROM documents
"""


def copy_ids(rows: str, content: str, columns: str) -> str:
    """Rows with the id of a scan: the hash of the content and of the number of the copy."""
    return f"""
SELECT ('0x' || substr(md5({content} || ':' || (row_number() OVER (PARTITION BY {content}) - 1)), 1, 15))::BIGINT AS id, {columns}
FROM ({rows}) c
"""


SCAN_CHATS = copy_ids(TURN_CHATS, "messages_json", "messages_json")

SCAN_PREFS = f"""
WITH d AS (SELECT conv_id AS pair_id, coalesce(instruction, '') AS prompt, output, response
           FROM ({ROWS}) r WHERE output IS NOT NULL AND output <> response)
SELECT pair_id, prompt, {chat_json('prompt', 'output')} AS chosen_json, {chat_json('prompt', 'response')} AS rejected_json FROM d
"""


def placed(rows: str) -> str:
    key = "origin || ':' || id"
    return f"SELECT origin, id, row_number() OVER (ORDER BY {hkey(SEED_MIX, key)}, {key}) - 1 AS position, messages_json FROM ({rows}) u"


_ROW_JSON = "CAST(to_json({'instruction': instruction, 'input': input, 'output': output, 'response': response}) AS VARCHAR)"
MIX_SCANNED = placed(f"""
SELECT 'chats' AS origin, id, messages_json FROM ({SCAN_CHATS}) s
UNION ALL
SELECT 'rows' AS origin, id, messages_json
FROM ({copy_ids(f"SELECT {_ROW_JSON} AS content, {chat_json(_USER, _ASSISTANT)} AS messages_json FROM ({EXCHANGES}) r", "content", "messages_json")}) s
""")

_TWICE = f"SELECT messages_json FROM ({TURN_CHATS}) a UNION ALL SELECT messages_json FROM ({TURN_CHATS}) b WHERE conv_id % 5 = 0"
MIX_JSONL = placed(f"SELECT 'jsonl' AS origin, id, messages_json FROM ({copy_ids(_TWICE, 'messages_json', 'messages_json')}) s")

CAPPED = f"""
WITH r AS (
  SELECT 'chats' AS origin, conv_id AS id, rendered FROM ({RENDER}) a
  UNION ALL
  SELECT 'rows', row_id, {render([("user", _USER), ("assistant", _ASSISTANT)])} FROM ({EXCHANGES}) b)
SELECT m.origin, m.id, m.position, CAST(octet_length(encode(r.rendered)) AS BIGINT) AS n_tokens,
       octet_length(encode(r.rendered)) > 2048 AS truncated,
       array_to_string(list_slice(list_transform(regexp_extract_all(hex(encode(r.rendered)), '..'), lambda h: ('0x' || h)::INTEGER), 1, 2048), ',')
         AS ids_csv
FROM ({MIX}) m JOIN r ON r.origin = m.origin AND r.id = m.id
"""

_PADS = "[" + ", ".join("(" + " || ".join(f"chr({ord(c)})" for c in pad) + ")" for pad in DIRTY_PADS) + "]"
DIRTY = f"""
WITH k AS (SELECT conv_id, turn, text, conv_id * 10 + turn AS key FROM conversations),
p AS (SELECT *, {_PADS}[key % {len(DIRTY_PADS)} + 1] AS pad FROM k),
d AS (SELECT *, CASE key % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN pad ELSE pad || text || pad END AS dirty FROM p)
SELECT conv_id, turn, dirty IS NOT NULL AND dirty <> '' AS nonempty, md5(coalesce(dirty, '')) AS filled,
       {clean('dirty')} AS stripped, md5(coalesce(nullif(dirty, ''), nullif(text, ''), '')) AS truthy, {clean('dirty')} <> '' AS kept
FROM d
"""

RENDER_DIRTY = f"""
SELECT conv_id, string_agg('<|im_start|>' || role || {NL} || CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE text END
                           || '<|im_end|>' || {NL}, '' ORDER BY turn) AS rendered
FROM conversations GROUP BY conv_id
"""

# The new version holds de and fr with small budgets and no es; en stays as it was.
RERUN = f"""
SELECT source, shard_idx, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(list_sum(t)) AS BIGINT) AS id_sum FROM (
  SELECT * FROM ({PIECES}) a WHERE source = 'en' UNION ALL SELECT * FROM ({pieces_sql(cut_sql(SMALL_TARGETS))}) b WHERE source IN ('de', 'fr')
) p GROUP BY source, shard_idx
"""

TEMPLATES = f"""
SELECT conv_id,
  CASE WHEN min_by(role, turn) <> 'system' THEN '<|im_start|>system' || {NL} || 'You are a helpful assistant.<|im_end|>' || {NL} ELSE '' END
    || string_agg('<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}, '' ORDER BY turn) || '<|im_start|>assistant' || {NL} AS chatml,
  string_agg('<|' || role || '|>' || {NL} || text || '</s>' || {NL}, '' ORDER BY turn) || '<|assistant|>' || {NL} AS role_tags,
  '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || {NL} || {NL} || {clean('text')} || '<|eot_id|>', '' ORDER BY turn) AS header_ids
FROM conversations GROUP BY conv_id
"""

_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::INTEGER)"
PROMPTS = f"""
WITH t AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, m, list_filter(range(1, len(m) + 1), lambda i: m[i].role = 'assistant') AS places FROM t),
p AS (SELECT conv_id, m, places, unnest(range(1, len(places))) AS k FROM a),
x AS (SELECT conv_id * 1000 + k - 1 AS pair_id, places[k] - 1 AS n,
        array_to_string(list_transform(m[1:places[k] - 1], lambda e: '<|im_start|>' || e.role || {NL} || e.content || '<|im_end|>' || {NL}), '') || '<|im_start|>assistant' || {NL} AS prompt,
        m[places[k]].content AS c, m[places[k + 1]].content AS r FROM p),
i AS (SELECT pair_id, n, {_BYTES.format("prompt")} AS pi, {_BYTES.format("c")} AS ci, {_BYTES.format("r")} AS ri FROM x),
l AS (SELECT *, least(len(pi), 256) AS np FROM i)
SELECT pair_id, CAST(n AS INTEGER) AS n_common, array_to_string(pi[len(pi) - np + 1:], ',') AS prompt_csv,
  array_to_string(ci[1:512 - np], ',') AS chosen_csv, array_to_string(ri[1:512 - np], ',') AS rejected_csv,
  len(pi) > 256 AS prompt_truncated, len(ci) > 512 - np AS chosen_truncated, len(ri) > 512 - np AS rejected_truncated
FROM l
"""

GUARDED = f"""
SELECT source, doc_seq, CAST(len(ids) AS BIGINT) AS n_tokens, list_max(ids) AS max_id, CAST(list_sum(ids) AS BIGINT) AS id_sum FROM ({IDS}) d
"""

_BUDGETS = {lang: mixture_budgets("validate")[name] // BUDGET_SHARE for name, lang in CORPORA.items()}
MIXTURE = f"""
SELECT CASE source {' '.join(f"WHEN '{lang}' THEN '{name}'" for name, lang in CORPORA.items())} END AS source, shard_idx, n_tokens
FROM ({shards_sql(cut_sql(_BUDGETS))}) s
"""


def _step(n: int, what: str, wrote: bool, shards: str, tokens: str) -> str:
    return f"SELECT CAST({n} AS BIGINT) AS step, '{what}' AS what, {wrote} AS wrote, CAST({shards} AS BIGINT) AS n_shards, CAST({tokens} AS BIGINT) AS n_tokens"


def _whole(where: str) -> str:
    return f"(SELECT sum(n_tokens) FROM ({COUNTS}) c WHERE source IN ({where}))"


def _of_de(targets: dict, what: str) -> str:
    return f"(SELECT {what} FROM ({cut_sql(targets)}) k WHERE source = 'de')"


def _half_shards() -> str:
    """The cut of de's budget in shards of half the size, which the batch ends decide anew."""
    half = S // 2
    ends = f"SELECT sum(sum(n_tokens)) OVER (ORDER BY batch) AS c FROM ({OFFSETS}) o WHERE source = 'de' GROUP BY batch"
    return f"(SELECT coalesce(min(CASE WHEN (c // {half}) * {half} >= {TARGETS['de']} THEN (c // {half}) * {half} END), max(c)) FROM ({ends}) e)"


AGAIN = " UNION ALL ".join([
    _step(0, "first", True, _of_de(SMALL_TARGETS, "n_shards"), _of_de(SMALL_TARGETS, "kept_tokens")),
    _step(1, "same", False, _of_de(SMALL_TARGETS, "n_shards"), _of_de(SMALL_TARGETS, "kept_tokens")),
    _step(2, "budget", True, _of_de(TARGETS, "n_shards"), _of_de(TARGETS, "kept_tokens")),
    _step(3, "shards", True, f"ceil({_half_shards()} / {S // 2}.0)", _half_shards()),
    _step(4, "whole", True, f"ceil({_whole(chr(39) + 'de' + chr(39))} / {S}.0)", _whole("'de'")),
    _step(5, "grown", True, f"""ceil({_whole("'de', 'es'")} / {S}.0)""", _whole("'de', 'es'")),
])

SQL: dict[str, str] = {
    "docs_nonempty": DOCS,
    "token_counts": COUNTS,
    "running_offsets": OFFSETS,
    "budget_cutoff": CUT,
    "shard_inventory": f"SELECT source, shard_idx, n_tokens FROM ({SHARDS}) s",
    "shard_progress": f"SELECT source, shard_idx, n_tokens, written, target FROM ({SHARDS}) s",
    "packed_segments": SEGMENTS,
    "roundtrip_audit": AUDIT,
    "mix_weights": WEIGHTS,
    "mix_epochs": EPOCHS,
    "window_draws": DRAWS,
    "window_tokens": WINDOW_TOKENS,
    "rank_layout": LAYOUT,
    "strip_text": STRIP,
    "seed_prompts": SEEDS,
    "rows_to_chats": ROW_CHATS,
    "chats_from_turns": TURN_CHATS,
    "render_chats": RENDER,
    "tuning_mix": MIX,
    "tuning_mix_counts": MIX_COUNTS,
    "distilled_pairs": DISTILLED,
    "preference_pairs": PREFS,
    "score_table": SCORES,
    "bin_shards": BIN_BLOCKS,
    "stream_totals": STREAM_TOTALS,
    "stream_shards": STREAM_SEGMENTS.format(pieces=PIECES),
    "bin_rerun_smaller": f"SELECT source, shard_idx, n_tokens FROM ({shards_sql(cut_sql(SMALL_TARGETS))}) s",
    "stream_shards_partial_targets": STREAM_SEGMENTS.format(pieces=pieces_sql(cut_sql(PARTIAL_TARGETS))),
    "scan_corpus_json": SCAN_JSON,
    "scan_chats": SCAN_CHATS,
    "scan_prefs": SCAN_PREFS,
    "tuning_mix_from_scans": MIX_SCANNED,
    "tuning_mix_jsonl": MIX_JSONL,
    "capped_ids": CAPPED,
    "dirty_text": DIRTY,
    "render_dirty": RENDER_DIRTY,
    "shard_store_ids": BIN_BLOCKS,
    "shard_store_filtered": f"SELECT * FROM ({BIN_BLOCKS}) b WHERE source IN ('en', 'es') AND shard_idx >= 1",
    "shard_store_rerun": RERUN,
    "packed_rerun": RERUN,
    "window_tokens_by_range": WINDOW_TOKENS,
    "render_templates": TEMPLATES,
    "preference_prompts": PROMPTS,
    "guarded_ids": GUARDED,
    "mixture_prepared": MIXTURE,
    "prepared_again": AGAIN,
    "stream_shards_reordered": STREAM_SEGMENTS.format(pieces=PIECES),
    "stream_progress_reordered": f"""
SELECT source, n_docs, total_tokens AS n_tokens, CAST(0 AS BIGINT) AS n_held, CAST(0 AS BIGINT) AS n_late, kept_tokens FROM ({cut_sql(PARTIAL_TARGETS)}) c""",
}
