"""Source registry and scans.

A source is read into ``raw_docs(source STRING, doc_seq BIGINT, text STRING)``. ``doc_seq`` is
the stream order: the order of files by path, then the row position inside each file (Parquet
``_metadata.row_index``). Turning that pair into one integer needs only per-file row counts
(one row per file), so it scales with the number of files, not rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpuspack.functions.text import MESSAGES_TYPE, messages_json
from corpuspack.operators.windows import hash_draw
from corpuspack.session import materialize


@dataclass(frozen=True)
class SourceSpec:
    name: str
    dataset: str  # upstream dataset id, for the record
    config: str | None  # upstream config / subset
    text_field: str


# The corpus registry (name, upstream dataset, subset, text field).
REGISTRY: dict[str, SourceSpec] = {
    "fineweb-edu": SourceSpec("fineweb-edu", "HuggingFaceFW/fineweb-edu", "sample-10BT", "text"),
    "fineweb-2-kor": SourceSpec("fineweb-2-kor", "HuggingFaceFW/fineweb-2", "kor_Hang", "text"),
    "the-stack": SourceSpec("the-stack", "bigcode/the-stack-v2-dedup", None, "content"),
    "codeparrot": SourceSpec("codeparrot", "codeparrot/codeparrot-clean", None, "content"),
}


def lookup(name: str, registry: dict[str, SourceSpec] | None = None) -> SourceSpec:
    """A1: registry row for ``name``; unknown names are rejected."""
    registry = REGISTRY if registry is None else registry
    if name not in registry:
        raise ValueError(f"unknown source {name!r}; choose from {sorted(registry)}")
    return registry[name]


def text_scan(spark: SparkSession, spec: SourceSpec, location: str | list[str], fmt: str = "parquet") -> DataFrame:
    """The registry's text field by an explicit schema: ``text`` and each row's place in the stream.

    ``_file, _part, _row``: rows of a Parquet file are placed by their number; a JSON-lines file may
    be read in splits (``_part``), whose rows come in order. A Parquet source without the field, an
    unknown format and a malformed JSON line are errors; a row without the field has a null text.
    """
    paths = [location] if isinstance(location, str) else list(location)
    schema = StructType([StructField(spec.text_field, StringType())])
    file = F.col("_metadata.file_path").alias("_file")
    if fmt == "parquet":
        if spec.text_field not in spark.read.parquet(*paths).columns:
            raise ValueError(f"{spec.name}: there is no column {spec.text_field!r}")
        raw = spark.read.schema(schema).parquet(*paths)
        return raw.select(F.col(spec.text_field).alias("text"), file, F.lit(0).alias("_part"), F.col("_metadata.row_index").alias("_row"))
    if fmt != "json":
        raise ValueError(f"unknown format {fmt!r}")
    raw = spark.read.text(paths).select("value", file, F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_row"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return raw.select(F.when(F.trim("value") != "", parsed[spec.text_field]).alias("text"), "_file", "_part", "_row")


def with_stream_order(scan: DataFrame) -> DataFrame:
    """``doc_seq`` for a ``text_scan``: files in path order, rows in file order, numbered from 0.

    Row counts by file or split (metadata-sized: a row for each) are summed in path order, written,
    and joined back; the planner broadcasts them if their written size allows it.
    """
    parts = scan.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    w = Window.orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_file", "_part", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    bases = materialize(bases, "stream-order")
    seq = (F.col("_base") + F.col("_row") - F.col("_first")).cast("bigint")
    return scan.join(bases, ["_file", "_part"]).select(seq.alias("doc_seq"), "text")


def source_files(spark: SparkSession, path: str, split: str | None = "train", fmt: str = "parquet") -> list[str]:
    """The files of a source in stream order (sorted by path), from the file listing."""
    location = f"{path.rstrip('/')}/{split}" if split else path
    reader = spark.read.schema("value STRING").format("text" if fmt == "json" else fmt)  # a listing needs no schema of the data
    return sorted(reader.load(location).inputFiles())


def read_source(
    spark: SparkSession,
    name: str,
    path: str,
    split: str | None = "train",
    fmt: str = "parquet",
    registry: dict[str, SourceSpec] | None = None,
    files: list[str] | None = None,
    scan: DataFrame | None = None,
) -> DataFrame:
    """A2 + B1: scan a registered corpus at ``path`` into ``raw_docs``.

    ``split`` is a sub-folder (``path/split``, default ``train``; None reads ``path`` itself).
    ``files`` restricts the read to a stream-order prefix of the source's files, ``scan`` to a ``text_scan`` of a
    prefix of its rows.
    The text field is the registry's (see ``text_scan``).
    """
    spec = lookup(name, registry)
    location = f"{path.rstrip('/')}/{split}" if split else path
    # ``files``: a prefix of ``source_files`` in stream order (doc_seq then equals the full read's)
    if scan is None:
        scan = text_scan(spark, spec, files if files is not None else location, fmt)
    ordered = with_stream_order(scan)
    return ordered.select(F.lit(spec.name).alias("source"), "doc_seq", "text")


# --------------------------------------------------------------------------- fixture stand-ins

DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CONVERSATIONS_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
BENCHMARK_SCHEMA = "item_id BIGINT, text STRING"


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than cores (a small table in one file) dealt out evenly; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixture_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as ``raw_docs``: ``lang`` plays the source, ``doc_id`` the stream order."""
    docs = table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA)
    return docs.select(F.col("lang").alias("source"), F.col("doc_id").alias("doc_seq"), "text")


# --------------------------------------------------------------------------- A3-A6

INSTRUCTION_FIELDS = ("instruction", "input", "output", "response")


#: Copies of one row are made again in groups of this many.
COPY_GROUP = 1 << 16


def with_row_id(rows: DataFrame, content: Column, name: str = "id") -> DataFrame:
    """A stable id from the content and the number of the copy: the same however the files are split.

    Equal rows are counted (pre-aggregated by task) and made again from one of them with the numbers
    0, 1, …; which copy gets which number does not matter. No key ever holds all copies of a row.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    groups = counted.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {COPY_GROUP}"))))
    last = F.least(F.col("_n"), (F.col("_group") + 1) * COPY_GROUP) - 1
    copies = groups.repartition(content, "_group").withColumn("_copy", F.explode(F.sequence(F.col("_group") * COPY_GROUP, last)))
    return copies.select(hash_draw(content, F.col("_copy")).alias(name), *columns)


def read_instruction_rows(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    rename: dict[str, str] | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """A3: flat instruction rows ``id, instruction, input, output, response`` by an explicit schema.

    ``rename`` maps upstream names to ours (e.g. ``{"context": "input"}``); absent fields become
    null. ``id`` is the ``id_col`` of the file, or else made from the row (``with_row_id``). A malformed
    JSON line is an error.
    """
    upstream = {ours: theirs for theirs, ours in (rename or {}).items()}
    fields = [StructField(upstream.get(f, f), StringType()) for f in INSTRUCTION_FIELDS]
    if id_col:
        fields.insert(0, StructField(id_col, LongType()))
    reader = spark.read.schema(StructType(fields)).format(fmt)
    raw = (reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(path)
    rows = raw.select(*([F.col(id_col).alias("id")] if id_col else []), *[F.col(upstream.get(f, f)).alias(f) for f in INSTRUCTION_FIELDS])
    if id_col:
        return rows
    return with_row_id(rows, F.to_json(F.struct(*INSTRUCTION_FIELDS), {"ignoreNullFields": "false"})).select("id", *INSTRUCTION_FIELDS)


CHAT_SCHEMA = StructType(
    [
        StructField(
            "messages",
            ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())])),
        )
    ]
)


def _chats(raw: DataFrame) -> DataFrame:
    chats = raw.select(F.col("messages").cast(MESSAGES_TYPE).alias("messages"))
    return with_row_id(chats, F.coalesce(messages_json("messages"), F.lit(""))).select("id", "messages")


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``id, messages`` of one JSON object per line; other fields are ignored, a malformed line is an error."""
    return _chats(spark.read.schema(CHAT_SCHEMA).option("mode", "FAILFAST").json(path))


def read_chats(spark: SparkSession, path: str, split: str = "train_sft", fmt: str = "parquet") -> DataFrame:
    """A4: ``id, messages`` of a chat set's split; other fields are ignored."""
    reader = spark.read.schema(CHAT_SCHEMA).format(fmt)
    return _chats((reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(f"{path.rstrip('/')}/{split}"))


PREFS_SCHEMA = StructType(
    [
        StructField("pair_id", LongType()),
        StructField("prompt", StringType()),
        StructField("chosen", CHAT_SCHEMA["messages"].dataType),
        StructField("rejected", CHAT_SCHEMA["messages"].dataType),
    ]
)


def read_preference_pairs(spark: SparkSession, path: str, split: str = "train_prefs", fmt: str = "json") -> DataFrame:
    """The ``train_prefs`` split of a chosen / rejected set; a malformed JSON line is an error.

    A row without ``pair_id`` gets one from its content.
    """
    reader = spark.read.schema(PREFS_SCHEMA).format(fmt)
    raw = (reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(f"{path.rstrip('/')}/{split}")
    content = F.to_json(F.struct("prompt", "chosen", "rejected"))
    made = with_row_id(raw, content, "_made")
    return made.select(F.coalesce("pair_id", "_made").alias("pair_id"), "prompt", "chosen", "rejected")
