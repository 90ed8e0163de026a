"""Operator 10: quality rules with robust multivariate outliers (native).

Every text gets plain counts and a vector of transformed statistics. Texts that fail the base rules
go at once. The others are judged by language and source: the minimum-covariance-determinant
estimate of location and scatter of the group's vectors, and the Mahalanobis distance from it.

The estimate is the deterministic form of the method: it starts from medians and interquartile
ranges and takes concentration steps. A step measures all distances, keeps the ``SUPPORT`` share of
the group with the smallest ones, and takes that share's mean and covariance. The group's distances
are counted in narrow bins with the sums of each bin's vectors and products, so that a step is one
pre-aggregated sum for each group and bin, and the share is read from the running counts of the
bins: no group's rows ever meet in one task. A last step reweights: all vectors within the 97.5 %
chi-square ellipsoid.

Small groups lean on their language: the moments of ``PRIOR`` vectors of the language's kept shares
are added to each group's. ``RESOLUTION`` is the unit of each statistic; one squared unit is added
to every variance, so a statistic that hardly varies in a group cannot blow up small differences. Each
unit is well below what a text can reach, so each statistic alone can reject.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuspack.llm.common import SPACES
from corpuspack.session import materialize

SUPPORT = 0.5
STEPS = 4
PRIOR = 50.0
#: Rejected beyond this chi-square quantile (degrees of freedom: the statistics).
CONFIDENCE = 0.999

#: The statistics and their units: symbols a word, share of repeated words, share of capitals in the
#: words, share of repeated lines, characters a word, exclamation and question marks a word.
RESOLUTION = {"symbols": 0.02, "repeats": 0.05, "capitals": 0.015, "lines": 0.075, "length": 0.175, "marks": 0.03}
NAMES = list(RESOLUTION)
DIM = len(NAMES)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function (series of the lower incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def consistency(p: float, k: int) -> float:
    """What the covariance of the central share ``p`` of a normal sample is too small by."""
    return p / chi2_cdf(chi2_quantile(p, k), k + 2)


def _removed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts (long) and the statistics ``_z_symbols`` ... (double, null without words).

    Columns of ``docs`` that have the name of a count are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")
    df = docs.withColumns({
        "_words": F.array_remove(F.split(text, SPACES), ""),
        "_lines": F.filter(F.split(text, "\n"), has_word),
        "n_symbols": _removed(text, "[^#*$%&|<>]+"),
        "_upper": _removed(text, "[^\\p{Lu}]+"),
        "_marks": _removed(text, "[^!?]+"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_lines")
    n = F.size("_hashes")
    two = F.zip_with("_hashes", F.slice("_hashes", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_pairs", F.when(n >= 3, two))
    three = F.zip_with("_pairs", F.slice("_hashes", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_windows", F.when(n >= 3, F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0))))).drop("_pairs", "_hashes")
    # Only texts with a repeated window sort theirs; equal neighbours are repeated windows.
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(placed))).drop("_windows")
    m = F.size("_sorted")
    df = df.withColumn("_same", F.zip_with(
        F.slice("_sorted", F.lit(1), F.greatest(m - 1, F.lit(0))),
        F.slice("_sorted", F.lit(2), F.greatest(m - 1, F.lit(0))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)).otherwise(F.array().cast("array<int>")),
    )).drop("_sorted")
    df = df.withColumn("n_repeat_words", F.when(F.col("_same").isNotNull(), F.size(F.array_distinct(F.flatten("_same")))).otherwise(0).cast("long")).drop("_same")
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    values = {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("_upper") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "lines": F.col("n_dup_lines") / F.when(F.col("_n_lines") > 0, F.col("_n_lines")),
        "length": F.col("word_chars") / words,
        "marks": F.col("_marks") / words,
    }
    # Shares are skewed to the right, so they enter as log(1 + share); each in its unit.
    return df.withColumns({f"_z_{k}": F.log1p(v) / F.lit(RESOLUTION[k]) if k != "length" else v / F.lit(RESOLUTION[k]) for k, v in values.items()}).drop("_upper", "_marks", "_n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


_GROUP, _LANG = "_group", "_language"
#: Parameters of so many groups (some 40 numbers each) are sent to the rows; those of more meet them in parts.
BROADCAST_GROUPS, SALTS = 20_000, 64


def keyed(measured: DataFrame) -> DataFrame:
    """With the keys of group and language (null language or source: groups of their own)."""
    return measured.withColumns({_GROUP: F.to_json(F.struct("lang", "source")), _LANG: F.to_json(F.struct("lang"))})


# The sums, factors and distances below are SQL text: built column by column they would take longer to
# put together than to run.
_Z = [f"_z_{k}" for k in NAMES]
_MOMENTS = {"_n": "1.0D"} | {f"_s{i}": _Z[i] for i in range(DIM)} | {f"_p{i}_{j}": f"{_Z[i]} * {_Z[j]}" for i in range(DIM) for j in range(i + 1)}


def _summed(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(f"sum({e}) AS {name}") for name, e in expressions.items()]


def _factor(params: DataFrame) -> DataFrame:
    """From means ``_m`` and covariances ``_c`` to the inverse of the lower Cholesky factor, ``_w``.

    ``|w (z - m)|`` is the Mahalanobis distance.
    """
    df = params
    for j in range(DIM):  # column by column: each needs the ones before it
        rest = {i: " - ".join([f"_c{i}_{j} + {float(i == j)}D", *[f"_l{i}_{k} * _l{j}_{k}" for k in range(j)]]) for i in range(j, DIM)}
        root = f"sqrt(greatest({rest[j]}, 1e-6D))"
        df = df.selectExpr("*", *[f"{root} AS _l{i}_{j}" if i == j else f"({rest[i]}) / {root} AS _l{i}_{j}" for i in range(j, DIM)])
    for i in range(DIM):  # row by row
        value = {j: " - ".join([f"{float(i == j)}D", *[f"_l{i}_{k} * _w{k}_{j}" for k in range(j, i)]]) for j in range(i + 1)}
        df = df.selectExpr("*", *[f"({v}) / _l{i}_{i} AS _w{i}_{j}" for j, v in value.items()])
    return df.select(_GROUP, *[f"_m{i}" for i in range(DIM)], *[f"_w{i}_{j}" for i in range(DIM) for j in range(i + 1)])


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Parameters by group from the written sums of the vectors that it keeps, with its language's prior."""
    lang = sums.groupBy(_LANG).agg(*[F.expr(f"sum({c}) AS {c}_lang") for c in _MOMENTS])
    share = lambda c: f"({c} + {PRIOR}D * {c}_lang / _n_lang) / (_n + {PRIOR}D)"
    df = sums.join(lang, _LANG).selectExpr(
        _GROUP, *[f"{share(f'_s{i}')} AS _m{i}" for i in range(DIM)], *[f"{share(c)} AS _q{c[2:]}" for c in _MOMENTS if c.startswith("_p")]
    )
    return _factor(df.selectExpr("*", *[f"{factor!r}D * (_q{i}_{j} - _m{i} * _m{j}) AS _c{i}_{j}" for i in range(DIM) for j in range(i + 1)]))


def _distance() -> Column:
    rows = [" + ".join(f"_w{i}_{j} * ({_Z[j]} - _m{j})" for j in range(i + 1)) for i in range(DIM)]
    return F.expr(" + ".join(f"power({row}, 2)" for row in rows))


def _with_parameters(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Each row with its group's parameters (a written table). Rows are never dealt by group alone, as one group may hold
    a third of them: up to ``BROADCAST_GROUPS`` groups go to the rows, beyond that groups are dealt in ``SALTS`` parts."""
    if params.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), _GROUP, how)
    parts = params.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*_Z), F.lit(SALTS)).cast("int")).join(parts, [_GROUP, "_part"], how).drop("_part")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and interquartile ranges by group, from counts in bins of an eighth of a unit."""
    long = rows.select(_GROUP, F.posexplode(F.array(*[F.floor(F.col(z) * 8) for z in _Z])).alias("_k", "_bin"))
    counts = materialize(long.groupBy(_GROUP, "_k", "_bin").agg(F.count("*").alias("_count")), "mcd-counts")
    w = Window.partitionBy(_GROUP, "_k")
    counts = counts.withColumns({"_up": F.sum("_count").over(w.orderBy("_bin")), "_all": F.sum("_count").over(w)})
    at = lambda p: F.min(F.when(F.col("_up") >= F.col("_all") * p, F.col("_bin"))) / 8 + 1 / 16
    q = counts.groupBy(_GROUP, "_k").agg(*[at(p).alias(f"_q{round(100 * p)}") for p in (0.25, 0.5, 0.75)])
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, c))
    wide = q.groupBy(_GROUP).agg(
        *[pick(k, F.col("_q50")).alias(f"_m{k}") for k in range(DIM)],
        *[pick(k, F.pow((F.col("_q75") - F.col("_q25")) / 1.349, 2)).alias(f"_c{k}_{k}") for k in range(DIM)],
    )
    return _factor(wide.withColumns({f"_c{i}_{j}": F.lit(0.0) for i in range(DIM) for j in range(i)}))


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One step: the sums of the ``SUPPORT`` share of each group that is nearest, in bins of 3 %."""
    near = _with_parameters(rows, params).withColumn("_bin", F.floor(F.log2(1 + _distance()) * 24))
    # Written, so that the sums are dealt by bin and the windows below get one row for each bin.
    bins = materialize(near.groupBy(_GROUP, _LANG, "_bin").agg(*_summed(_MOMENTS)), "mcd-bins")
    w = Window.partitionBy(_GROUP)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = bins.withColumns({"_before": before, "_all": F.sum("_n").over(w)}).filter(F.col("_before") < SUPPORT * F.col("_all"))
    return materialize(kept.groupBy(_GROUP, _LANG).agg(*_summed({c: c for c in _MOMENTS})), "mcd-sums")


def robust_estimate(measured: DataFrame) -> DataFrame:
    """The parameters of each group of a written table of ``keyed(measure(docs))``."""
    rows = measured.filter(~base_failed()).select(_GROUP, _LANG, *_Z)
    params = materialize(_start(rows), "mcd-start")
    for step in range(STEPS):
        params = materialize(_estimate(_concentrate(rows, params), consistency(SUPPORT, DIM)), f"mcd-step{step}")
    inside = _with_parameters(rows, params).filter(_distance() <= chi2_quantile(0.975, DIM))
    sums = materialize(inside.groupBy(_GROUP, _LANG).agg(*_summed(_MOMENTS)), "mcd-sums")
    return materialize(_estimate(sums, consistency(0.975, DIM)), "mcd")


def judge(measured: DataFrame, params: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``measured`` with ``base_failed``, ``distance`` (squared; null for what the base rules reject) and ``kept``."""
    df = _with_parameters(measured, params, "left").withColumn("base_failed", base_failed())
    df = df.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    limit = chi2_quantile(confidence, DIM)
    # A group none of whose vectors lies in its ellipsoid has no estimate: nothing speaks against its rows.
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def quality_rules(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``distance`` and ``kept`` for every row.

    A null text has no words and fails. A null ``lang`` or ``source`` makes a group of its own.
    Repeated rows are judged and count as often as they come. Other columns of ``docs`` play no
    part; an empty table gives an empty table.
    """
    table = materialize(keyed(measure(docs.select("doc_id", "text", "lang", "source"))).drop("text"), "mcd-rows")
    return judge(table, robust_estimate(table), confidence).select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; the text is written once, not shuffled."""
    columns = docs.columns
    table = docs.select(F.struct(*columns).alias("_row"), "text", "lang", "source")
    table = materialize(keyed(measure(table)).drop("text"), "mcd-rows")
    return judge(table, robust_estimate(table), confidence).filter("kept").select("_row.*")
