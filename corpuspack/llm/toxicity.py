"""Operator 4: toxicity with a counterfactual-regularised classifier.

Features of a text are its words and their first four and six bytes (lower case, outer marks
removed, hashed), each present or not. A logistic regression learns from labelled texts. Besides
the labels it is fitted to counterfactuals: every labelled sentence that names an identity group is
written again with another group's name, and in every labelled text a sentence is given one group's name
and then another's at the same place, in four languages. The squared difference of the two raw scores is
penalised. A group's name therefore cannot move the score, only what is said, and neutral mentions
are not taken for abuse, also where the labelled texts hardly name any group.

Fitting uses a sample of ``MAX_ROWS`` labelled rows at most (by a hash of ``doc_id``): Spark
extracts and counts the features and keeps the ``MAX_FEATURES`` that tell the labels apart best; the
driver fits the bounded rest. Scoring covers all texts whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import words as W
from corpuspack.session import materialize

#: At most so many labelled rows are fitted to.
MAX_ROWS = 30_000
MAX_FEATURES = 4_096
FOLDS, HELD_OUT = 5, 0

#: Names of groups in English, German, French and Spanish (fixed values); those of one line may stand for each other.
IDENTITIES = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("mexican", "chinese", "indian", "arab", "american", "french", "german", "spanish", "russian", "turkish"),
    ("muslime", "christen", "juden", "hinduisten", "buddhisten", "atheisten"), ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"), ("frauen", "männer"), ("mädchen", "jungen"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"), ("gehörlose", "blinde", "behinderte", "alte", "junge"),
    ("türken", "russen", "polen", "franzosen", "spanier", "deutsche", "araber", "chinesen"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"), ("femmes", "hommes"), ("filles", "garçons"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"), ("sourds", "aveugles", "handicapés", "vieux", "jeunes"),
    ("turcs", "russes", "polonais", "français", "espagnols", "allemands", "arabes", "chinois"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"), ("mujeres", "hombres"), ("niñas", "niños"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("sordos", "ciegos", "discapacitados", "ancianos", "jóvenes"),
    ("turcos", "rusos", "polacos", "franceses", "españoles", "alemanes", "árabes", "chinos"),
)
#: Sentences of each labelled text that are given names.
PLACED = 2

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # uint64, ascending
    weights: np.ndarray
    bias: float


def text_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of every word and prefix, repeats included."""
    starts, ends, rows = W.word_spans(raw, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    for _ in range(3):  # outer marks
        starts = starts + ((ends > starts) & _EDGE[raw[np.minimum(starts, len(raw) - 1)]])
        ends = ends - ((ends > starts) & _EDGE[raw[np.maximum(ends - 1, 0)]])
    some = ends > starts
    starts, ends, row = starts[some], ends[some], row[some]
    out = [W.hash_spans(raw, starts, ends, True)]
    for k in (4, 6):
        out.append(W.hash_spans(raw, starts, np.minimum(ends, starts + k), True) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.tile(row, 3), np.concatenate(out)


def features_of(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text."""
    raw, offsets = W.text_buffers(pa.array(texts, pa.string()))
    out = []
    for a, b in W.chunks(offsets):
        row, feature = text_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(b - a + 1))
        out += [np.unique(feature[order[x:y]]) for x, y in zip(cuts[:-1], cuts[1:])]
    return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in batches so small that their features take little memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def counterfactuals(text: str, identities=IDENTITIES) -> Iterator[tuple[str, str]]:
    """Each sentence of ``text`` that names a group, and that sentence with the next group's name in its place."""
    after = {name: group[(i + 1) % len(group)] for group in identities for i, name in enumerate(group)}
    named = re.compile(r"\b(" + "|".join(sorted(after, key=len, reverse=True)) + r")\b", re.IGNORECASE)
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        if named.search(sentence):
            yield sentence, named.sub(lambda m: after[m[0].lower()], sentence)


def placed(text: str, identities=IDENTITIES, n: int = PLACED, salt: int = 0) -> Iterator[tuple[str, str]]:
    """``n`` sentences of ``text``, each with a group's name at some word, and with another of its line's there.

    Sentence, place and names follow from a checksum of the text."""
    sentences = [s.split() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    if not sentences:
        return
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"), salt)
    rng = np.random.default_rng([seed, salt])
    for _ in range(n):
        words, group = sentences[rng.integers(len(sentences))], identities[rng.integers(len(identities))]
        at, k = int(rng.integers(len(words) + 1)), int(rng.integers(len(group)))
        other = (k + 1 + int(rng.integers(len(group) - 1))) % len(group)
        yield tuple(" ".join([*words[:at], group[i], *words[at:]]) for i in (k, other))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], features: np.ndarray,
    ridge: float = 1e-4, counter: float = 1.0, steps: int = 800, n_pairs: int | None = None,
) -> Model:
    """Logistic regression by accelerated gradient steps.

    ``rows``: the positions in ``features`` that each text has. ``pairs``: those of a sentence and of its
    counterfactual. The loss is the mean logistic loss with both labels weighing the same, ``ridge / 2``
    times the squared weights and ``counter / 2`` times the mean squared difference of raw scores in
    ``pairs``; of ``n_pairs`` pairs (default: those given) the others have the same features on both sides. Last, the bias moves so that a score of 0.5 is the cut with the fewest errors.
    """
    n, m = len(rows), len(features)
    y = np.asarray(labels, dtype=np.float64)
    if not n or not m or y.min() == y.max():
        return Model(features, np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    flat, at = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    scale = max(1.0, float(np.mean([len(r) for r in rows])))
    p = len(pairs) if n_pairs is None else n_pairs
    swaps = []
    for a, b in pairs:  # what both sentences have cancels out
        a, b = np.setdiff1d(a, b), np.setdiff1d(b, a)
        if len(a) or len(b):
            swaps.append((np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])))
    sf = np.concatenate([np.zeros(0, dtype=np.int64), *(s[0] for s in swaps)]).astype(np.int64)
    ss = np.concatenate([np.zeros(0), *(s[1] for s in swaps)])
    sr = np.repeat(np.arange(len(swaps)), [len(s[0]) for s in swaps]).astype(np.int64)
    w, b, v, vb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    rate = 1.0 / (0.25 * (scale * 2 + 1) + ridge + counter * (max((len(s[0]) for s in swaps), default=0)))
    for _ in range(steps):
        error = share * (1 / (1 + np.exp(-np.clip(np.bincount(at, v[flat], n) + vb, -35, 35))) - y)
        grad = np.bincount(flat, error[at], m) + ridge * v
        if swaps:
            difference = np.bincount(sr, ss * v[sf], len(swaps))
            grad += counter * np.bincount(sf, ss * difference[sr], m) / p
        w2, b2 = v - rate * grad, vb - rate * error.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Model(features, w, b - _best_cut(np.bincount(at, w[flat], n) + b, y))


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The raw score between the labels with the fewest errors; of several, the widest gap's middle."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    errors = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)  # a cut before each row, and after all
    gaps = np.append(np.append(0, np.diff(raw)), 0)
    errors = np.where(gaps > 0, errors, np.inf)
    if not np.isfinite(errors).any():
        return 0.0
    k = int(np.argmax(np.where(errors == errors.min(), gaps, -1)))
    return float((raw[k - 1] + raw[k]) / 2)


def held_out(folds: int, fold: int) -> Column:
    """Rows that no label is learned from: crc32 of the ``doc_id`` as text (null: of an empty text)."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """A written table ``text, label`` of at most ``max_rows`` labelled rows outside the held-out fold."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    marked = marked.filter(~held_out(folds, fold)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    marked = materialize(marked.select("doc_id", "label"), "labelled")
    return materialize(docs.select("doc_id", "text").join(marked, "doc_id").select("text", "label"), "training")


def train(rows: DataFrame, max_features: int = MAX_FEATURES, identities=IDENTITIES, counter: float = 1.0) -> Model:
    """Fit to a written, bounded table ``text, label``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(0).to_pylist()
            own = features_of(texts)
            swaps = [[*counterfactuals(t or "", identities), *placed(t or "", identities)] for t in texts]
            flat = features_of([s for pairs in swaps for pair in pairs for s in pair])
            kept, k = [], 0
            for pairs in swaps:
                kept.append([{"a": flat[k + 2 * i].view(np.int64), "b": flat[k + 2 * i + 1].view(np.int64)} for i in range(len(pairs))])
                k += 2 * len(pairs)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f.view(np.int64) for f in own], longs), pa.array(kept, pa.list_(pa.struct([("a", longs), ("b", longs)])))],
                names=["label", "features", "swaps"],
            )

    schema = "label int, features array<long>, swaps array<struct<a:array<long>,b:array<long>>>"
    found = materialize(rows.select("text", "label").mapInArrow(extract, schema), "toxic-features")
    totals = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    seen = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0")
    )
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    noise = F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    best = seen.filter(F.col("c1") + F.col("c0") >= 2).withColumn("strength", F.abs(odds / noise))
    best = best.orderBy(F.col("strength").desc(), "feature").limit(max_features).select("feature")
    best = materialize(best, "toxic-chosen")
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], dtype=np.int64).view(np.uint64))
    signed = chosen.view(np.int64)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def at(values) -> np.ndarray:
            values = np.asarray(values, dtype=np.int64).view(np.uint64)
            place = np.minimum(np.searchsorted(chosen, values), max(len(chosen) - 1, 0))
            return place[chosen[place] == values].astype(np.int32) if len(chosen) else np.zeros(0, np.int32)

        for batch in small_batches(batches):
            own = [at(f.values.to_numpy()) for f in batch.column(1)]
            pairs = [[(at(s["a"]), at(s["b"])) for s in own_pairs] for own_pairs in batch.column(2).to_pylist()]
            # only what one side has and the other has not is fitted to
            apart = [[{"a": x, "b": y} for a, b in row if len(x := np.setdiff1d(a, b)) + len(y := np.setdiff1d(b, a))] for row in pairs]
            ints = pa.list_(pa.int32())
            swaps, n = pa.array(apart, pa.list_(pa.struct([("a", ints), ("b", ints)]))), pa.array([len(row) for row in pairs], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, ints), swaps, n], names=["label", "features", "swaps", "n"])

    small = found.mapInArrow(select, "label int, features array<int>, swaps array<struct<a:array<int>,b:array<int>>>, n int").toArrow()
    if not len(small):
        return fit([], np.zeros(0), [], signed.view(np.uint64))
    lists = small.column("features").combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    pairs = [(np.array(s["a"], dtype=np.int64), np.array(s["b"], dtype=np.int64)) for row in small.column("swaps").to_pylist() for s in row]
    marked, n_pairs = np.array(small.column("label").to_pylist()), sum(small.column("n").to_pylist())
    del small
    return fit(own, marked, pairs, chosen, counter=counter, n_pairs=n_pairs)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score double`` from 0 to 1; a text without words (null, empty) has the bias's score.

    A column of ``docs`` named ``score`` is replaced; every row keeps its own.
    """
    features, weights, bias = model.features, model.weights, model.bias

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw, offsets = W.text_buffers(texts)
        total = np.full(len(texts), bias)
        if len(features):
            bits = 20
            mask = np.uint64((1 << bits) - 1)
            first = np.full(1 << bits, -1, dtype=np.int32)  # features by their low bits, in chains
            chain = np.full(len(features), -1, dtype=np.int32)
            for i, low in enumerate((features & mask).astype(np.int64)):
                chain[i], first[low] = first[low], i
            for a, b in W.chunks(offsets):
                row, found = text_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = first[(found & mask).astype(np.int64)]
                hit = np.flatnonzero(at >= 0)
                row, found, at = row[hit], found[hit], at[hit]
                keys = []
                while len(at):
                    same = features[at] == found
                    keys.append(row[same] * len(features) + at[same])
                    at = chain[at]
                    more = at >= 0
                    row, found, at = row[more], found[more], at[more]
                once = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                total[a:b] += np.bincount(once // len(features), weights[once % len(features)], b - a)
        return pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return docs.withColumn("score", score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``held_out boolean``, ``score double`` and ``predicted int`` (1: toxic).

    The labels are of the texts of ``labelled`` (default: ``docs``). Those of held-out rows are not learned from; a label other than 0 or 1, or without a ``doc_id``,
    counts as none, and repeated labels count as often as they come. Without labels of both kinds
    every text has the same score. Repeated rows of ``docs`` have equal scores; columns named like a
    result are replaced; an empty table gives an empty one.
    """
    model = train(training_rows(docs if labelled is None else labelled, labels, "toxic", FOLDS, HELD_OUT, max_rows))
    scored = scores(docs, model).withColumn("held_out", held_out(FOLDS, HELD_OUT))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
