"""Operator 8: I-Match document fingerprints over randomised lexicon subsets (native).

1. Document frequencies of all terms over all whole texts (pre-aggregated by task). The lexicon is
   the terms whose inverse document frequency ``ln(documents / frequency)`` lies in ``BAND``. As a
   term of the lexicon is in at least ``exp(-BAND[1])`` of the documents, the lexicon has at most
   ``exp(BAND[1])`` times as many terms as a document has on average: it does not grow with the corpus.
2. A text keeps its distinct terms of the lexicon, sorted. A text without any keeps all its terms.
3. ``LEVELS * CELLS`` random subsets of the lexicon, whose sizes halve from level to level, each
   give one hash of the text's sorted terms in it. The fingerprint is the list of these hashes;
   long texts differ in every dense subset, so the sparse levels are what compares them.

The likeness of two fingerprints is the share of equal hashes among the subsets in which either
has a term.

A term is its 64-bit hash. The lexicon is looked up in a hash table that is a literal of the plan;
beyond ``TABLE_TERMS`` terms the texts' terms are joined with the lexicon instead. Only DataFrame
functions are used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuspack.llm.common import SPACES
from corpuspack.session import materialize

BAND = (2.3, 6.2)
LEVELS = 8
CELLS = 8
#: The lexicon is a literal of the plan up to this size (a few MB).
TABLE_TERMS = 1 << 18


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text (lower case, closing marks removed) as hashes; null text: none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[.,;:!?]*(?:{SPACES}|$)")
    bare = F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))
    return F.array_distinct(bare)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """A written table ``term, frequency`` of the terms within the band, over all rows of ``docs``."""
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    frequencies = terms.groupBy("term").agg(F.count("*").alias("frequency"))
    rarity = F.log(F.lit(float(max(1, docs.count()))) / F.col("frequency"))
    return materialize(frequencies.filter(rarity.between(*band)), "imatch-lexicon", rebalance=True)


def _table(lexicon_terms: list[int]) -> tuple[Column, int]:
    """The lexicon as an array of buckets, and the mask that picks a term's bucket."""
    size = 1 << max(4, len(lexicon_terms).bit_length())
    buckets: list[list[int]] = [[] for _ in range(size)]
    for t in sorted(lexicon_terms):
        buckets[t & (size - 1)].append(t)
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>"), size - 1


def with_kept_terms(rows: DataFrame, terms: dict[str, str], lexicon_table: DataFrame, table_terms: int = TABLE_TERMS) -> DataFrame:
    """``rows`` with, for each ``text column: new column``, the kept terms of the text (``placed_terms``)."""
    n = lexicon_table.count()
    hashed = rows.withColumns({new: term_hashes(F.col(text)) for text, new in terms.items()})
    if n <= table_terms:
        buckets, mask = _table([r["term"] for r in lexicon_table.select("term").collect()])
        known = lambda t: F.array_contains(F.get(buckets, t.bitwiseAND(mask).cast("int")), t)
        hashed = hashed.withColumns({f"_in_{new}": F.filter(new, known) for new in terms.values()})
    else:
        hashed = materialize(hashed, "imatch-terms").withColumn("_row", F.monotonically_increasing_id())
        for new in terms.values():
            long = hashed.select("_row", F.explode(new).alias("term"))
            found = long.join(lexicon_table.select("term"), "term").groupBy("_row").agg(F.collect_list("term").alias(f"_in_{new}"))
            hashed = hashed.join(found, "_row", "left")
        hashed = hashed.drop("_row")
    kept = lambda new: placed_terms(F.when(F.size(f"_in_{new}") > 0, F.col(f"_in_{new}")).otherwise(F.col(new)))
    return hashed.withColumns({new: kept(new) for new in terms.values()}).drop(*[f"_in_{new}" for new in terms.values()])


def placed_terms(kept: Column) -> Column:
    """The kept terms with the random subset that each lies in, as ascending numbers.

    A term lies in one subset of one level: half the terms in the first level, a quarter in the
    second and so on; the last level takes the rest.
    """
    place = lambda t: F.xxhash64(t, F.lit("subset"))
    level = lambda p: F.least(F.lit(LEVELS - 1), F.bit_count(p.bitwiseXOR(p - 1)) - 1)  # noqa: E731  trailing zeros
    cell = lambda p: (level(p) * CELLS + F.shiftright(p, 50).bitwiseAND(CELLS - 1)).cast("long")
    # A term as one number: its subset above the upper bits of its hash.
    return F.sort_array(F.transform(kept, lambda t: F.shiftleft(cell(place(t)), 57).bitwiseOR(F.shiftrightunsigned(t, 7))))


def subset_hashes(placed: str) -> Column:
    """The hashes of the terms in each random subset (0: no term), as ``array<int>``.

    ``placed``: a column of ``placed_terms``. The second mention of it keeps the optimizer from
    evaluating its expression anew for every level.
    """
    levels, cells = F.array(*[F.lit(k) for k in range(LEVELS)]), F.array(*[F.lit(k) for k in range(CELLS)])
    by_level = F.transform(levels, lambda k: F.filter(F.col(placed), lambda t: F.shiftrightunsigned(t, 60) == k))
    hashed = lambda ts: F.when(F.size(ts) == 0, 0).otherwise(F.greatest(F.lit(1), F.shiftrightunsigned(F.xxhash64(ts), 33).cast("int")))
    own = lambda ts, k: F.filter(ts, lambda t: F.shiftrightunsigned(t, 57).bitwiseAND(CELLS - 1) == k)
    hashes = F.flatten(F.transform(by_level, lambda ts: F.transform(cells, lambda k: hashed(own(ts, k)))))
    return F.when(F.size(placed) > 0, hashes).otherwise(F.array_repeat(F.lit(0), LEVELS * CELLS))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets where either fingerprint has one; two empty ones are equal."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(used == 0, 1.0).otherwise(same / used)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, table_terms: int = TABLE_TERMS) -> DataFrame:
    """``docs`` with ``hashes array<int>`` and ``fingerprint string``; equal texts have equal ones.

    A null text counts as empty; an empty text has the fingerprint of no terms. Repeated rows each
    get their own row; a column of ``docs`` named like a result is replaced.
    """
    terms = lexicon(docs.select("text"), band)
    df = with_kept_terms(docs, {"text": "_kept"}, terms, table_terms)
    return df.withColumn("hashes", subset_hashes("_kept")).withColumn("fingerprint", as_text(F.col("hashes"))).drop("_kept")


def _numbers_of_tasks(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` shuffle partitions a number that is dealt to it, so that as many groups share no task."""
    tried = spark.range(parts * (8 + 2 * parts.bit_length())).select(F.col("id").cast("int").alias("number"))
    tried = tried.groupBy(F.pmod(F.hash("number"), F.lit(parts)).alias("task")).agg(F.min("number").alias("number"))
    found = {r["task"]: r["number"] for r in tried.collect()}  # ``parts`` rows
    spare = iter(sorted(set(range(-parts, 0))))
    return [found[t] if t in found else next(spare) for t in range(parts)]


def compare_with_edits(docs: DataFrame, band: tuple[float, float] = BAND, table_terms: int = TABLE_TERMS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text ends, in place of its last ``floor(n_chars / 2)`` code points, with the first as
    many of the next document by falling ``doc_id`` (null last, ties by a hash of the text; after
    the last the first). Repeated rows follow one another as documents of their own. A null text
    counts as empty. Other columns of ``docs`` are ignored; an empty table gives an empty one.

    The documents are dealt into ranges of the order by quantiles of narrow keys. Each range gets
    a copy of the row that follows it, so the next text is read inside the range and every text
    moves once, each range to a task of its own.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn(
        "key", F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = keyed.select("key").repartitionByRange(parts, F.col("key").desc()).withColumn("part", F.spark_partition_id())
    ranges = narrow.groupBy("part").agg(F.max("key").alias("head")).orderBy(F.col("head").desc())
    heads = [r["head"] for r in ranges.collect()]  # at most ``parts`` keys
    if not heads:
        heads = [(True, 0, 0)]
    firsts = F.from_json(F.lit(json.dumps([{"has": k[0], "id": k[1], "hash": k[2]} for k in heads[1:]])), "array<struct<has:boolean,id:bigint,hash:bigint>>")
    table = lexicon(docs.select("text"), band)
    own = with_kept_terms(keyed, {"text": "_kept"}, table, table_terms).withColumn("hashes", subset_hashes("_kept")).drop("_kept")
    # A key's range: how many heads of later ranges are not below it. It goes by a number that hashes to a task of its own.
    numbers = _numbers_of_tasks(spark, parts)
    at = F.size(F.filter(firsts, lambda f: f >= F.col("key")))
    dealt = own.withColumn("part", F.get(F.array(*[F.lit(n) for n in numbers]), at)).withColumn("ghost", F.lit(False))
    follows = spark.createDataFrame(
        [(numbers[i], *heads[(i + 1) % len(heads)]) for i in range(len(heads))], "part int, has boolean, id long, hash long"
    ).select("part", F.struct("has", "id", "hash").alias("key"))
    ids = sorted({k[1] for k in heads})
    near = keyed.filter(F.col("doc_id").isin(ids) | F.col("doc_id").isNull())
    first_rows = near.join(F.broadcast(follows), "key").dropDuplicates(["part"])
    ghosts = with_kept_terms(first_rows, {"text": "_kept"}, table, table_terms).withColumn("hashes", subset_hashes("_kept"))
    ghosts = ghosts.select(*own.columns, "part", F.lit(True).alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", F.col("key").desc())
    placed = dealt.unionByName(ghosts).withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)})
    placed = placed.filter(~F.col("ghost"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    placed = placed.select("doc_id", n.cast("long").alias("n_chars"), "hashes", "next_hashes", edited.alias("edited"))
    placed = with_kept_terms(placed, {"edited": "_kept"}, table, table_terms).withColumn("edited_hashes", subset_hashes("_kept"))
    return placed.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
