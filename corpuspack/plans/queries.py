"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

They run the library operators on the fixture tables (see FIXTURES.md for the stand-ins:
``documents`` by ``lang`` are the corpora, ``conversations`` the chat and instruction sets,
``benchmark`` the scored items). Every query reads whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.functions import templates
from corpuspack.functions import text as T
from corpuspack.functions.subwords import DictionaryTokenizer
from corpuspack.functions.tokens import ByteTokenizer
from corpuspack.operators import instruct, mixture, packing, scores, window_reads, windows
from corpuspack.plans import jobs
from corpuspack.session import materialize, scratch_dir
from corpuspack.sources import binshards, registry, sinks, tokenshards, versions
from corpuspack.sources.registry import BENCHMARK_SCHEMA, CONVERSATIONS_SCHEMA, DOCUMENTS_SCHEMA, fixture_docs, spread, table
from corpuspack.streaming import incremental, ordered

# Fixture parameters: small batches so the stop rule is exercised, budgets that
# stop en / de / fr and leave es to end in a tail shard at sf0.01.
BATCH_DOCS = 50
SHARD_TOKENS = 65_536
TARGETS = {"en": 800_000, "de": 200_000, "fr": 100_000, "es": 300_000}
SMALL_TARGETS = {k: v // 4 for k, v in TARGETS.items()}
PARTIAL_TARGETS = {"de": 20_000, "en": None, "fr": None, "es": None}  # None: no budget
BUCKET_DOCS = 64  # small on purpose: the fixtures then take the two-level prefix-sum path

# Training-side parameters (as in the 1.7B run config: 8 × 6 × 4 ranks; 86,500 steps).
SEQ_LEN = 1024
BLOCK_TOKENS = 2048
SEED = 1337
SOURCE_ORDER = ["en", "de", "fr", "es"]
MICRO_BATCH, GRAD_ACCUM, RANKS = 8, 6, 4
STEPS = 86_500
TRAIN_SEQ_LEN = 2048

DIRTY_PADS = ["\u3000", "\u00a0 \t", "\u2028\n", "\u001f\u0085", " "]

# Instruction-data parameters: seeds 0 (Korean prompts), 1 (English prompts), 42 (tuning set).
SEED_KO, SEED_EN, SEED_MIX = 0, 1, 42


def docs_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.nonempty(fixture_docs(spark, sf_dir))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_token_counts(docs_nonempty(spark, sf_dir)).select("source", "doc_seq", "n_tokens")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark, sf_dir)
    _, levels = packing.auto_buckets(counts, width=BUCKET_DOCS)
    return packing.running_offsets(counts, BATCH_DOCS, BUCKET_DOCS, levels)


def packed(spark: SparkSession, sf_dir: str, piece_tokens: int | None = None) -> packing.PackResult:
    """The packing plan of the tables in ``sf_dir``, planned anew by each query."""
    return packing.pack(
        fixture_docs(spark, sf_dir),
        shard_tokens=SHARD_TOKENS,
        targets=TARGETS,
        batch_docs=BATCH_DOCS,
        bucket_docs=BUCKET_DOCS,
        piece_tokens=piece_tokens,
    )


def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).cut.drop("last_seq")


def shard_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).inventory()


def shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).progress()


def packed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = packed(spark, sf_dir).segments()
    return seg.select(
        "source", "shard_idx", "pos", "doc_seq", "n_tokens",
        F.element_at("tokens", 1).alias("first_id"),
        F.element_at("tokens", -1).alias("last_id"),
        F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.array_join("tokens", ",").alias("tokens_csv"),
    )


def roundtrip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild each document from its packed pieces and compare with the source text.

    A kept document must be its whole text and one EOS; a cut one a prefix of its bytes."""
    p = packed(spark, sf_dir)
    tok = ByteTokenizer()
    seg = p.segments()
    per_doc = seg.groupBy("source", "doc_seq").agg(
        F.array_sort(F.collect_list(F.struct("shard_idx", "tokens"))).alias("parts"),
        F.sum("n_tokens").alias("got"),
    )
    rebuilt = per_doc.select(
        "source", "doc_seq", "got", F.flatten(F.transform("parts", lambda x: x["tokens"])).alias("ids")
    )
    docs = p.offsets.select("source", "doc_seq", "n_tokens").join(
        packing.nonempty(fixture_docs(spark, sf_dir)), ["source", "doc_seq"]
    )
    j = rebuilt.join(docs, ["source", "doc_seq"])
    complete = F.col("got") == F.col("n_tokens")
    head = F.substring(F.encode("text", "UTF-8"), F.lit(1), F.size("ids"))
    prefix = tok.decode("ids") == F.make_valid_utf8(head.cast("string"))
    eos_once = (F.element_at("ids", -1) == tok.eos_id) & (F.size(F.filter("ids", lambda x: x == tok.eos_id)) == 1)
    same = eos_once & (tok.decode("ids") == F.col("text"))
    return j.groupBy("source").agg(
        F.count(F.when(complete, 1)).cast("bigint").alias("docs_kept"),
        F.count(F.when(~complete, 1)).cast("bigint").alias("docs_cut"),
        F.count(F.when(F.when(complete, ~same).otherwise(~prefix), 1)).cast("bigint").alias("docs_differ"),
    )


def mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_weights(packed(spark, sf_dir).inventory())


def mix_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_epochs(packed(spark, sf_dir).inventory(), STEPS, MICRO_BATCH, GRAD_ACCUM, RANKS, TRAIN_SEQ_LEN)


def _draws(spark: SparkSession, p: packing.PackResult) -> DataFrame:
    kept = p.cut.agg(F.sum("kept_tokens")).first()[0] or 0
    n_samples = int(kept) // SEQ_LEN  # one epoch of windows: grows with the corpus
    return windows.draw_windows(spark, p.inventory(), n_samples, SEQ_LEN, SEED, SOURCE_ORDER)


def window_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, packed(spark, sf_dir))


def window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packed(spark, sf_dir, piece_tokens=BLOCK_TOKENS)
    draws = _draws(spark, p)
    blocks = windows.aligned_blocks(windows.drawn_shards(p.segments(), draws), BLOCK_TOKENS)
    w = windows.cut_windows(draws, blocks, SEQ_LEN, BLOCK_TOKENS)
    return w.select(
        "sample_id", "source", "shard_idx", "start",
        F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"),
    )


def rank_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _draws(spark, packed(spark, sf_dir)).select("sample_id", "source", "shard_idx", "start")
    return windows.batch_layout(d, MICRO_BATCH, GRAD_ACCUM, RANKS)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", CONVERSATIONS_SCHEMA)


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 / B5 on every turn: Python-equal strip, null as ''."""
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", T.clean("text").alias("stripped"),
                    (T.clean("text") != F.coalesce("text", F.lit(""))).alias("changed"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction row for each exchange of the chats."""
    return instruct.exchange_rows(_turns(spark, sf_dir))


def seed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: Korean-style rows (instruction, input) in full, then English-style rows
    (instruction, context) — half of them, the take-n feature."""
    rows = materialize(_rows(spark, sf_dir), "instruction-rows")  # grouped once
    n = rows.count()
    ko = instruct.seed_prompts(rows, n, SEED_KO, "row_id", "input", part=0)
    en_rows = rows.withColumnRenamed("input", "context")
    en = instruct.seed_prompts(en_rows, n // 2, SEED_EN, "row_id", "context", part=1)
    return ko.unionByName(en)


def rows_to_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = instruct.rows_to_chats(_rows(spark, sf_dir))
    return chats.select("row_id", T.messages_json("messages").alias("messages_json"))


def chats_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = instruct.chats_from_turns(_turns(spark, sf_dir))
    return chats.select("conv_id", F.size("messages").alias("n_turns"),
                        T.messages_json("messages").alias("messages_json"))


def render_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chat rendered, and the first user turn as an open prompt."""
    chats = instruct.chats_from_turns(_turns(spark, sf_dir))
    rows = instruct.instruction_rows(_turns(spark, sf_dir))
    j = chats.join(rows.select("conv_id", "instruction"), "conv_id")
    return j.select(
        "conv_id",
        T.render_chat("messages").alias("rendered"),
        T.render_chat(T.single_turn_chat(F.coalesce("instruction", F.lit(""))), add_generation_prompt=True)
        .alias("prompt"),
    )


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.tuning_mix(
        chats=instruct.chats_from_turns(_turns(spark, sf_dir)), rows=_rows(spark, sf_dir), seed=SEED_MIX
    )


def tuning_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).select("origin", "id", "position", T.messages_json("messages").alias("messages_json"))


def tuning_mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.mix_counts(_mix(spark, sf_dir))


def distilled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G2: seed prompts joined to responses (the first assistant turn of each exchange)."""
    prompts = seed_prompts(spark, sf_dir)
    responses = _rows(spark, sf_dir).select("row_id", F.col("output").alias("response"))
    chats = instruct.attach_responses(prompts, responses, "row_id")
    return chats.select("part", "position", "row_id", T.messages_json("messages").alias("messages_json"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = instruct.pairs_from_turns(_turns(spark, sf_dir))
    out = instruct.preference_pairs(pairs)
    return out.select(
        "pair_id", "chosen_tokens", "chosen_kept", "chosen_truncated",
        "rejected_tokens", "rejected_kept", "rejected_truncated",
        F.md5("chosen_text").alias("chosen_md5"), F.md5("rejected_text").alias("rejected_md5"),
    )


SCORE_WINDOW = 8  # words


def _windows(rows: DataFrame, *columns) -> DataFrame:
    """The windows of ``SCORE_WINDOW`` words of each row's text, as two hashes of their words (128 bits)."""
    words = rows.withColumn("_w", F.array_remove(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), ""))
    at = F.sequence(F.lit(1), F.size("_w") - (SCORE_WINDOW - 1))
    span = lambda i: F.slice("_w", i, SCORE_WINDOW)
    spans = F.transform(at, lambda i: F.struct(F.xxhash64(span(i)).alias("h1"), F.xxhash64(F.lit(1), span(i)).alias("h2")))
    exploded = words.filter(F.size("_w") >= SCORE_WINDOW).select(*columns, F.explode(spans).alias("_s"))
    return exploded.select(*columns, "_s.h1", "_s.h2")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-level scores: an item is ``correct`` under a tag if one of its word windows occurs in the tag's documents.

    ``run`` reads all documents, ``baseline`` those with an even ``doc_id``; items are dealt to the tasks
    by ``item_id``, and ``haerae`` has no ``baseline`` rows (a task missing from one tag). Items and
    documents meet by a join on the window, the items' side being the small one.
    """
    items = table(spark, sf_dir, "benchmark", BENCHMARK_SCHEMA).filter("item_id IS NOT NULL")
    docs = spread(table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA).select("doc_id", "text"))
    found = _windows(docs, "doc_id").join(_windows(items, "item_id"), ["h1", "h2"]).groupBy("item_id").agg(
        F.lit(1).alias("run"), F.max(F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)).alias("baseline")
    )
    task = F.element_at(F.array(*[F.lit(t) for t in scores.DEFAULT_TASKS]), (F.pmod("item_id", F.lit(len(scores.DEFAULT_TASKS))) + 1).cast("int"))
    wide = items.join(found, "item_id", "left").select("item_id", task.alias("task"), *[F.coalesce(t, F.lit(0)).alias(t) for t in scores.TAGS])
    tags = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("correct")) for t in scores.TAGS]))
    long = wide.select("item_id", "task", tags.alias("s")).select("s.tag", "task", "item_id", "s.correct")
    return long.filter(~((F.col("task") == "haerae") & (F.col("tag") == "baseline")))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_table(_scores(spark, sf_dir))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _blocks(spark: SparkSession, out: str) -> DataFrame:
    blocks = binshards.read_bin(spark, [f"{out}/{s}" for s in SOURCE_ORDER], block_tokens=BLOCK_TOKENS)
    return blocks.select("source", "shard_idx", "pos", F.array_join("tokens", ",").alias("tokens_csv"))


def bin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + A7: export the packed shards as flat uint32 files and read them back in blocks of ids."""
    out = _fresh(spark, "bin")
    binshards.export_bin(packed(spark, sf_dir).segments(), out)
    return _blocks(spark, out)


def bin_rerun_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second export with a quarter of each budget replaces the first; none of its shards stay."""
    out = _fresh(spark, "bin")
    binshards.export_bin(packed(spark, sf_dir).segments(), out)
    small = packing.pack(fixture_docs(spark, sf_dir), SHARD_TOKENS, SMALL_TARGETS, BATCH_DOCS, BUCKET_DOCS)
    binshards.export_bin(small.segments(), out)
    files = binshards.bin_files(spark, [f"{out}/{s}" for s in SOURCE_ORDER])
    return files.select("source", "shard_idx", "n_tokens")


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The packed shards in a token store, each shard in the parts that its tasks hold."""
    out = _fresh(spark, "store")
    tokenshards.write_shards(packed(spark, sf_dir).segments(), out, whole_shards=False)
    return out


def _csv_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select("source", "shard_idx", "pos", F.array_join("tokens", ",").alias("tokens_csv"))


def shard_store_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + A7 through the data source: whole-shard files written and read back in blocks of ids."""
    out = _fresh(spark, "store")
    tokenshards.write_shards(packed(spark, sf_dir).segments(), out)
    return _csv_blocks(tokenshards.read_shards(spark, [f"{out}/{s}" for s in SOURCE_ORDER], BLOCK_TOKENS))


def shard_store_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with filters that the source takes over: files of other sources and shards are never opened."""
    out = _fresh(spark, "store")
    tokenshards.write_shards(packed(spark, sf_dir).segments(), out)
    blocks = spark.read.format("token_shards").option("blockTokens", BLOCK_TOKENS).load(out)
    return _csv_blocks(blocks.filter(F.col("source").isin("en", "es") & (F.col("shard_idx") >= 1)))


def shard_store_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of three sources, of which one has become empty, beside one that stays; ids from the
    files of whatever tasks held a shard's parts."""
    out = _store(spark, sf_dir)
    small = packing.pack(fixture_docs(spark, sf_dir).filter("lang <> 'es'"), SHARD_TOKENS, SMALL_TARGETS, BATCH_DOCS, BUCKET_DOCS)
    kept = small.segments().filter("source <> 'en'")
    tokenshards.write_shards(kept, out, sources=["de", "fr", "es"], whole_shards=False)
    blocks = tokenshards.read_shards(spark, [f"{out}/{s}" for s in SOURCE_ORDER], SHARD_TOKENS)
    ids = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return blocks.groupBy("source", "shard_idx").agg(F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"), F.sum(ids).cast("bigint").alias("id_sum"))


def packed_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 as Parquet: the same second version, committed by a manifest."""
    out = _fresh(spark, "packed")
    packed(spark, sf_dir).write(out)
    small = packing.pack(fixture_docs(spark, sf_dir).filter("lang <> 'es'"), SHARD_TOKENS, SMALL_TARGETS, BATCH_DOCS, BUCKET_DOCS)
    small.write(out, sources=["de", "fr", "es"])
    ids = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sinks.read_packed(spark, out).groupBy("source", "shard_idx").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.sum(ids).cast("bigint").alias("id_sum"))


def window_tokens_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 by planned range reads of the shard files: the windows of ``window_tokens``, with no exchange of ids."""
    out = _store(spark, sf_dir)
    files = tokenshards.files_of(None, [f"{out}/{s}" for s in SOURCE_ORDER])
    table_of = tokenshards.files_table(spark, files)
    n_samples = sum(f.n_tokens for f in files) // SEQ_LEN
    draws = windows.draw_windows(spark, packing.shard_inventory(table_of), n_samples, SEQ_LEN, SEED, SOURCE_ORDER)
    w = window_reads.cut_windows_by_range(draws, table_of, SEQ_LEN, n_samples)
    return w.select("sample_id", "source", "shard_idx", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


#: Bytes of text in a file that a query writes from a table, about. A file is one task's work.
FILE_BYTES = 64 << 20


def _files_of(docs: DataFrame, text: str = "text", least: int = 1) -> int:
    """How many files the texts of ``docs`` are dealt over, ``least`` at least; of a larger table there are more, not larger ones."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-int(size) // FILE_BYTES))


def _ordered_files(spark: SparkSession, sf_dir: str, n: int = 4) -> tuple[str, int]:
    """``documents`` written by Spark as ``n`` sets of files, one after the other in ``doc_id`` order; the folder, and the files of
    each set. A small table has one file in a set."""
    docs = table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA)
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.0)
    files = -(-_files_of(docs) // n)
    out, low, store = _fresh(spark, "stream-src"), None, versions.HadoopStore(spark)
    for k, high in enumerate([*cuts, None], 1):
        part = docs.filter(F.lit(True) if low is None else F.col("doc_id") > low)
        part = part.filter(F.lit(True) if high is None else F.col("doc_id") <= high)
        part.repartition(files, "doc_id").sortWithinPartitions("doc_id").write.mode("append").parquet(out)
        # a trigger takes so many files, so a set must not have fewer (tasks without rows write none)
        for _ in range(k * files - sum(name.endswith(".parquet") for name in store.names(out))):
            spark.createDataFrame([], DOCUMENTS_SCHEMA).write.mode("append").parquet(out)
        low = high
    return out, files


def _doc_stream(spark: SparkSession, folder: str, files: int) -> DataFrame:
    raw = incremental.read_doc_stream(spark, folder, DOCUMENTS_SCHEMA, files)
    return raw.select(F.col("lang").alias("source"), F.col("doc_id").alias("doc_seq"), "text")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2: four sets of files as a stream of four triggers; running totals per source (complete mode)."""
    name = f"stream_totals_{uuid.uuid4().hex[:8]}"
    counts = incremental.token_stream(_doc_stream(spark, *_ordered_files(spark, sf_dir)))
    incremental.start_totals(counts, name, targets=TARGETS).awaitTermination()
    return spark.table(name)


def _streamed(spark: SparkSession, sf_dir: str, targets) -> DataFrame:
    out = _fresh(spark, "stream-pack")
    docs = _doc_stream(spark, *_ordered_files(spark, sf_dir))
    seg = incremental.stream_pack(spark, docs, out, SHARD_TOKENS, targets, BATCH_DOCS, BUCKET_DOCS)
    return seg.select("source", "shard_idx", "pos", "doc_seq", F.array_join("tokens", ",").alias("tokens_csv"))


def stream_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: shards appended over four micro-batches with carried offsets, with their ids."""
    return _streamed(spark, sf_dir, TARGETS)


def stream_shards_partial_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 where one source has a small budget and the others none: those are kept whole."""
    return _streamed(spark, sf_dir, PARTIAL_TARGETS)


FILE_SCHEMA = "doc_id BIGINT, text STRING"
ARRIVAL = (2, 0, 3, 1)  # four sets of files of each source, in this order of arrival


def _files_out_of_order(spark: SparkSession, sf_dir: str, files: int = 1) -> str:
    """``documents`` written by Spark as numbered files of each source: four sets of ``files``, the sets in the order ``ARRIVAL``.

    A source's files are numbered without gaps, whether or not it has documents in every set's range of ``doc_id``."""
    docs = table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA)
    n = 4 * files
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.0)
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    placed = docs.select("doc_id", "text", F.col("lang").alias("source"), place.alias("_place"))
    placed = placed.filter("doc_id is not null") if cuts else placed
    number = F.row_number().over(Window.partitionBy("source").orderBy("_place")) - 1  # a row for each file
    numbers = materialize(placed.select("source", "_place").distinct().withColumn("seq", number), "file-numbers")
    out = _fresh(spark, "stream-files")
    for k in ARRIVAL:
        part, own = (df.filter(F.col("_place").between(k * files, k * files + files - 1)) for df in (placed, numbers))
        own = F.broadcast(own.withColumnsRenamed({"source": "_source", "_place": "_own"}))
        part = part.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_place") == F.col("_own")))
        part = part.select("doc_id", "text", "source", "seq").repartition(4 * files, "source", "seq")
        part.write.mode("append").partitionBy("source", "seq").parquet(out)
    return out


def _ordered(spark: SparkSession, sf_dir: str, targets) -> ordered.OrderedAppender:
    docs = table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA)
    files = -(-_files_of(docs) // 4)
    folder = _files_out_of_order(spark, sf_dir, files)
    return ordered.pack_files_in_order(spark, folder, _fresh(spark, "ordered"), FILE_SCHEMA, SHARD_TOKENS, targets, BATCH_DOCS, 4 * files)


def stream_shards_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 for files that arrive out of order, with the carry in the state store: the ids of ``stream_shards``."""
    seg = _ordered(spark, sf_dir, TARGETS).segments()
    return seg.select("source", "shard_idx", "pos", "doc_seq", F.array_join("tokens", ",").alias("tokens_csv"))


def stream_progress_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 from the state store: what each source has received, and its cut; two sources have no budget."""
    return _ordered(spark, sf_dir, PARTIAL_TARGETS).progress()


def scan_corpus_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + B1: the documents as JSON lines in ordered files, scanned with their stream order."""
    out = _fresh(spark, "corpus-json")
    folder, files = _ordered_files(spark, sf_dir)
    docs = spark.read.parquet(folder).select(F.col("text").alias("content"), "doc_id")
    docs.repartitionByRange(4 * files, "doc_id").sortWithinPartitions("doc_id").write.json(f"{out}/train")
    scanned = registry.read_source(spark, "the-stack", out, fmt="json")
    return scanned.select("source", "doc_seq", "text")


def _write_chats(spark: SparkSession, sf_dir: str) -> str:
    """The conversations as a chat set: Parquet (with extra fields), JSON lines with every fifth line twice."""
    out = _fresh(spark, "chats")
    chats = instruct.chats_from_turns(_turns(spark, sf_dir))
    chats.withColumn("note", F.lit("x")).write.parquet(f"{out}/train_sft")
    twice = chats.filter("conv_id % 5 = 0")
    sinks.write_chat_jsonl(chats.unionByName(twice), f"{out}/jsonl")
    return out


def scan_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the chat set's split, with the id that the scan gives each chat."""
    chats = registry.read_chats(spark, _write_chats(spark, sf_dir))
    return chats.select("id", T.messages_json("messages").alias("messages_json"))


def scan_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + G6: preference pairs written as JSON lines and scanned."""
    out = _fresh(spark, "prefs")
    instruct.pairs_from_turns(_turns(spark, sf_dir)).write.json(f"{out}/train_prefs")
    pairs = registry.read_preference_pairs(spark, out)
    side = lambda c: T.messages_json(c).alias(f"{c}_json")
    return pairs.select("pair_id", "prompt", side("chosen"), side("rejected"))


def _scanned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _write_chats(spark, sf_dir)
    rows = _rows(spark, sf_dir).select("instruction", F.col("input").alias("context"), "output", "response")
    rows.write.option("ignoreNullFields", "false").json(f"{out}/rows")
    scanned = registry.read_instruction_rows(spark, f"{out}/rows", rename={"context": "input"})
    return instruct.tuning_mix(chats=registry.read_chats(spark, out), rows=scanned, seed=SEED_MIX)


def tuning_mix_from_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A4 into G3: the tuning set of a scanned chat set and scanned instruction rows."""
    mix = _scanned_mix(spark, sf_dir)
    return mix.select("origin", "id", "position", T.messages_json("messages").alias("messages_json"))


def tuning_mix_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 into G3: the tuning set of a JSONL chat set in which lines repeat."""
    scanned = registry.read_chat_jsonl(spark, f"{_write_chats(spark, sf_dir)}/jsonl")
    mix = instruct.tuning_mix(jsonl=scanned, seed=SEED_MIX)
    return mix.select("origin", "id", "position", T.messages_json("messages").alias("messages_json"))


def capped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 + B13 on the tuning set: rendered examples cut at 2,048 ids, with the ids."""
    capped = instruct.capped_examples(_mix(spark, sf_dir))
    return capped.select("origin", "id", "position", "n_tokens", "truncated", F.array_join("ids", ",").alias("ids_csv"))


def render_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 with three published chat templates, compiled: default system text, conditions on roles and on the loop."""
    chats = instruct.chats_from_turns(_turns(spark, sf_dir))
    return chats.select(
        "conv_id",
        templates.compile_template(templates.CHATML_DEFAULT_SYSTEM)("messages", add_generation_prompt=True).alias("chatml"),
        templates.compile_template(templates.ROLE_TAGS, eos_token="</s>")("messages", add_generation_prompt=True).alias("role_tags"),
        templates.compile_template(templates.HEADER_IDS, bos_token="<|begin_of_text|>")("messages").alias("header_ids"),
    )


def preference_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 on pairs whose sides both hold the prompt, from every assistant turn of every chat: ids capped apart."""
    pairs = instruct.pairs_of_chats(instruct.chats_from_turns(_turns(spark, sf_dir)))
    out = instruct.preference_prompts(pairs, max_length=512, max_prompt=256)
    csv = [F.array_join(f"{c}_ids", ",").alias(f"{c}_csv") for c in ("prompt", "chosen", "rejected")]
    return out.select("pair_id", "n_common", *csv, "prompt_truncated", "chosen_truncated", "rejected_truncated")


def guarded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids checked against the vocabulary on their way."""
    ids = packing.tokenize(docs_nonempty(spark, sf_dir), guard=True)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("source", "doc_seq", "n_tokens", F.array_max("tokens").alias("max_id"), total.alias("id_sum"))


# Fixture stand-ins for the registered corpora, and the share of the validate budgets that fits the fixtures.
CORPORA = {"fineweb-edu": "en", "fineweb-2-kor": "de", "the-stack": "fr"}
BUDGET_SHARE = 10_000


def _corpora(spark: SparkSession, sf_dir: str, least: int = 4) -> dict[str, str]:
    """``documents`` by language as the registered corpora: ordered Parquet files with small row groups."""
    out, docs = _fresh(spark, "corpora"), table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA)
    for name, lang in CORPORA.items():
        text = registry.lookup(name).text_field
        own = docs.filter(F.col("lang") == lang).select("doc_id", F.col("text").alias(text))
        own = own.repartitionByRange(_files_of(own, text, least), "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
        own.write.option("parquet.block.size", 1 << 16).parquet(f"{out}/{name}/train")
    return {name: f"{out}/{name}" for name in CORPORA}


def _validate_budgets() -> dict[str, int]:
    return {name: tokens // BUDGET_SHARE for name, tokens in mixture.mixture_budgets("validate").items()}


def mixture_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E2 + A2: three registered corpora under the validate budgets (scaled), read up to the row group that
    decides each cut, packed as one union."""
    out = _fresh(spark, "mixture")
    jobs.prepare_corpus(spark, _corpora(spark, sf_dir), out, _validate_budgets(), SHARD_TOKENS, BATCH_DOCS, split="train")
    return packing.shard_inventory(sinks.read_packed(spark, out))


def prepared_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: prepared, skipped, prepared again with another budget and shard size, and again when the input has grown."""
    corpora, out = _corpora(spark, sf_dir), _fresh(spark, "again")
    one = {"fineweb-2-kor": corpora["fineweb-2-kor"]}
    rows = []

    def step(what: str, *options) -> None:
        wrote = jobs.prepare_corpus(spark, one, out, *options, BATCH_DOCS, split="train") is not None
        n = packing.shard_inventory(sinks.read_packed(spark, out)).agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
        rows.append((len(rows), what, wrote, n[0], n[1]))

    step("first", SMALL_TARGETS["de"], SHARD_TOKENS)
    step("same", SMALL_TARGETS["de"], SHARD_TOKENS)
    step("budget", TARGETS["de"], SHARD_TOKENS)
    step("shards", TARGETS["de"], SHARD_TOKENS // 2)
    step("whole", None, SHARD_TOKENS)
    more = table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA).filter("lang = 'es'").select("text")
    more.write.mode("append").parquet(f"{one['fineweb-2-kor']}/train")
    step("grown", None, SHARD_TOKENS)
    return spark.createDataFrame(rows, "step BIGINT, what STRING, wrote BOOLEAN, n_shards BIGINT, n_tokens BIGINT")


def _subwords(spark: SparkSession) -> DictionaryTokenizer:
    from pathlib import Path

    import public_tokenizers  # vocabulary files, where they are installed

    return DictionaryTokenizer(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), "<|endoftext|>", spark)


def subword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with a published vocabulary, by a dictionary of the corpus' pre-tokens (tested against its library)."""
    ids = _subwords(spark).tokenize_table(docs_nonempty(spark, sf_dir))
    return ids.select("source", "doc_seq", "n_tokens", F.md5(F.array_join("tokens", ",")).alias("ids_md5"))


def subword_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 into D1-D7: shards of subword ids under the same budgets."""
    p = packing.pack(fixture_docs(spark, sf_dir), SHARD_TOKENS, TARGETS, BATCH_DOCS, tokenizer=_subwords(spark))
    return p.inventory()


def dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, B4, B5, B6, B8 on turns made dirty by their numbers: nulls, empty and blank texts, Unicode padding.

    Every rule changes or drops rows here."""
    t = _turns(spark, sf_dir)
    key = F.col("conv_id") * 10 + F.col("turn")
    pad = F.element_at(F.array(*[F.lit(p) for p in DIRTY_PADS]), (key % len(DIRTY_PADS) + 1).cast("int"))
    padded = F.concat(pad, F.col("text"), pad)
    made = F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 7 == 1, F.lit("")).when(key % 7 == 2, pad).otherwise(padded)
    dirty = t.select("conv_id", "turn", "text", made.alias("dirty"))
    kept = packing.nonempty(dirty, "dirty").select("conv_id", "turn", F.lit(True).alias("nonempty"))
    out = dirty.join(kept, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("nonempty", F.lit(False)).alias("nonempty"), T.null_to_empty("dirty").alias("filled"),
        T.clean("dirty").alias("stripped"), T.first_truthy("dirty", "text").alias("truthy"), (T.clean("dirty") != "").alias("kept"),
    )
    return out.withColumns({c: F.md5(c) for c in ("filled", "truthy")})


def render_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 on chats in which every third message has no content: no message is lost."""
    t = _turns(spark, sf_dir).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.col("text")))
    chats = instruct.chats_from_turns(t)
    return chats.select("conv_id", T.render_chat("messages").alias("rendered"))


QUERIES = {
    "docs_nonempty": docs_nonempty,
    "token_counts": token_counts,
    "running_offsets": running_offsets,
    "budget_cutoff": budget_cutoff,
    "shard_inventory": shard_inventory,
    "shard_progress": shard_progress,
    "packed_segments": packed_segments,
    "roundtrip_audit": roundtrip_audit,
    "mix_weights": mix_weights,
    "mix_epochs": mix_epochs,
    "window_draws": window_draws,
    "window_tokens": window_tokens,
    "rank_layout": rank_layout,
    "strip_text": strip_text,
    "seed_prompts": seed_prompts,
    "rows_to_chats": rows_to_chats,
    "chats_from_turns": chats_from_turns,
    "render_chats": render_chats,
    "tuning_mix": tuning_mix,
    "tuning_mix_counts": tuning_mix_counts,
    "distilled_pairs": distilled_pairs,
    "preference_pairs": preference_pairs,
    "score_table": score_table,
    "bin_shards": bin_shards,
    "stream_totals": stream_totals,
    "stream_shards": stream_shards,
    "bin_rerun_smaller": bin_rerun_smaller,
    "stream_shards_partial_targets": stream_shards_partial_targets,
    "scan_corpus_json": scan_corpus_json,
    "scan_chats": scan_chats,
    "scan_prefs": scan_prefs,
    "tuning_mix_from_scans": tuning_mix_from_scans,
    "tuning_mix_jsonl": tuning_mix_jsonl,
    "capped_ids": capped_ids,
    "dirty_text": dirty_text,
    "render_dirty": render_dirty,
    "shard_store_ids": shard_store_ids,
    "shard_store_filtered": shard_store_filtered,
    "shard_store_rerun": shard_store_rerun,
    "packed_rerun": packed_rerun,
    "window_tokens_by_range": window_tokens_by_range,
    "stream_shards_reordered": stream_shards_reordered,
    "stream_progress_reordered": stream_progress_reordered,
    "render_templates": render_templates,
    "preference_prompts": preference_prompts,
    "guarded_ids": guarded_ids,
    "mixture_prepared": mixture_prepared,
    "prepared_again": prepared_again,
    "subword_ids": subword_ids,
    "subword_shards": subword_shards,
}
