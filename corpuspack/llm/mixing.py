"""Operator 2: mixing sources to target weights by Poisson replication (native).

Each source has a mean repetition rate: the share of the mixed corpus that its weight asks for, by
the characters it has. A document's number of copies is the Poisson quantile, with its source's rate,
of a uniform number hashed from the seed and its ``doc_id``; so each document is drawn alone, the same
way in every run, and no source is cut or counted out. The copies are dealt out and sorted by a hash
of their own, which shuffles the whole mix.

The quantile is read from the source's table of the distribution function. A rate above ``CHUNK`` is
the sum of several draws with smaller rates, so a table stays short however large the rate. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.session import materialize

CHUNK = 32.0
SEED = 17
EXPONENT = 0.7


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) hashed from the parts: 52 bits and a half."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, epochs: float = 1.0) -> DataFrame:
    """A written table of each source's mean repetition: ``_source, source, size, rate, draws, cdf``.

    ``weights`` by source are shares of the mix after division by their sum; a source without one gets
    none. Without ``weights`` a source's weight is its characters to the power ``exponent``. The mix has
    ``epochs`` times the characters of the corpus. A source without any characters stays as it is
    (rate 1).
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(exponent))
    else:
        given = F.from_json(F.to_json(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])), "map<string,double>") if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0)) * F.when(F.col("size") > 0, 1.0).otherwise(0.0)
    sizes = materialize(sizes.withColumn("weight", weight), "mix-sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    rate = F.when(F.col("size") > 0, share * (float(epochs) * float(total["size"] or 0)) / F.col("size")).otherwise(1.0)
    table = sizes.withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    steps = F.sequence(F.lit(1), (mean + 12 * F.sqrt(mean) + 40).cast("int"))
    first = F.exp(-mean)
    cdf = F.aggregate(
        steps,
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"),
            F.array_append(acc["cdf"], acc["c"] + acc["p"] * mean / k).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return materialize(table.select(_key().alias("_source"), "source", "size", "rate", "draws", cdf.alias("cdf")), "mix-rates")


def _key() -> Column:
    return F.to_json(F.struct("source"))


def replicate(docs: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``copy int`` (from 0) and ``shuffle_key string``, a row for each copy, in the order of the shuffle.

    A null ``source`` is a source of its own; a null ``doc_id`` draws as an empty string; rows with equal
    ``doc_id`` have equal numbers of copies. Columns named like a result are replaced. An empty table gives
    an empty one.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = table.select("_source", F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf"))
    drawn = docs.withColumn("_source", _key()).join(own, "_source")
    draw = lambda j: F.size(F.filter("_cdf", lambda c: c < _uniform(F.lit(seed), ident, j.cast("string"))))
    one = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    drawn = drawn.withColumn("_u", _uniform(F.lit(seed), ident, F.lit("0")))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), draw), F.lit(0), lambda a, b: a + b)
    drawn = drawn.withColumn("_copies", F.when(F.col("_draws") == 1, one).otherwise(many)).filter("_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    copies = copies.drop("_source", "_draws", "_cdf", "_u", "_copies")
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))), 1, 16)
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed and shuffled corpus; see ``rates`` and ``replicate``."""
    return replicate(docs, rates(docs.select("source", "text"), weights, exponent, epochs), seed)


#: The same rows in DuckDB, for the default parameters.
MIX_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, pow(size::DOUBLE, {EXPONENT}) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size)::DOUBLE FROM weighed) / size ELSE 1.0 END AS rate
  FROM weighed
), means AS (
  SELECT source, greatest(1, ceil(rate / {CHUNK}))::INT AS draws, rate / greatest(1, ceil(rate / {CHUNK}))::INT AS mean FROM rates
), cdf AS (
  SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS c, mean, CAST(trunc(mean + 12 * sqrt(mean) + 40) AS INT) AS last FROM means
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean, last FROM cdf WHERE k < last
), tables AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source
), draws AS (
  SELECT d.doc_id, d.source, d.text, t.cdf, unnest(range(m.draws)) AS j
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), counts AS (
  SELECT doc_id, source, text, sum(len(list_filter(cdf, lambda c: c < (CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {1 << 52}))) AS copies
  FROM draws GROUP BY doc_id, source, text
)
SELECT doc_id, source, text, copy, substr(md5('{SEED}:order:' || doc_id || ':' || copy), 1, 16) AS shuffle_key
FROM (SELECT doc_id, source, text, unnest(range(copies::BIGINT))::INT AS copy FROM counts WHERE copies > 0)
"""
