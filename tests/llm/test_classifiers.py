import random
import zlib

import numpy as np
import pytest

from corpuspack.llm import ranking, toxicity
from corpuspack.llm.common import documents, labels
from corpuspack.llm.queries import op4_counterfactual_toxicity, op7_bradley_terry_quality
from tests.conftest import SF_MID


@pytest.mark.parametrize(("query", "label", "folds", "fold", "least"), [
    (op4_counterfactual_toxicity, "toxic", 5, 0, 0.9), (op7_bradley_terry_quality, "quality", 3, 1, 0.97),
])
def test_query_on_held_out_labels(spark, query, label, folds, fold, least):
    rows = {r["doc_id"]: r for r in query(spark, SF_MID).collect()}
    assert len(rows) == documents(spark, SF_MID).count()
    for r in rows.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    held = [(r["score"], x[label]) for x in labels(spark, SF_MID).collect() if (r := rows[x["doc_id"]])["held_out"]]
    positive, negative = ([s for s, y in held if y == v] for v in (1, 0))
    area = np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])
    right = np.mean([(s >= 0.5) == y for s, y in held])
    assert area >= least and right >= 0.92


def labelled(spark, rows, label):
    return spark.createDataFrame([(i, y) for i, y in rows], f"doc_id long, {label} int")


@pytest.mark.parametrize(("judge", "label"), [(toxicity.toxicity, "toxic"), (ranking.quality, "quality")])
def test_odd_rows(spark, docs_of, judge, label):
    rows = [(i, f"good plain words number {i} here and there", "en", "a") for i in range(60)] + [(100 + i, f"bad %%% ### {i} *** ***", "en", "a") for i in range(60)]
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, "good plain words"), (3, rows[3][1]), (1003, "bad %%% " * 20000)]
    y = 1 if label == "toxic" else 0
    marks = [(i, 1 - y) for i in range(60)] + [(100 + i, y) for i in range(60)] + [(None, 1), (5, None), (6, 7), (7, 1 - y), (1000, 0)]
    out = judge(docs_of(rows + odd, extra=("score", "label", "held_out", "predicted")), labelled(spark, marks, label)).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(by[3]) == 2 and by[3][0] == by[3][1] and by[1000] == by[1001] == by[1002]
    assert np.mean([(by[100 + i][0] >= 0.5) == (y == 1) for i in range(60)]) > 0.95
    assert np.mean([(by[i][0] >= 0.5) == (y == 0) for i in range(60)]) > 0.95
    assert judge(docs_of([]), labelled(spark, [], label)).count() == 0
    flat = judge(docs_of(rows), labelled(spark, [], label)).collect()
    assert {r["score"] for r in flat} == {0.5}


def test_labels_and_source_are_no_inputs(spark, docs_of):
    rows = [(i, f"text {i % 7} of the same kind", "en", "a") for i in range(50)]
    marks = labelled(spark, [(i, i % 2) for i in range(50)], "toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs_of(rows), marks).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs_of([(i, t, "xx", f"s{i}") for i, t, *_ in rows]), marks).collect()}
    assert a == b


def test_counterfactuals_lower_false_positives(spark):
    """Abuse that mostly names one group: without the penalty the name alone is taken for abuse."""
    rng = random.Random(5)
    filler = [f"word{i}" for i in range(300)]
    insults = ["vermin", "filth"]
    rows = []
    for i in range(600):
        words = rng.choices(filler, k=12)
        toxic = i % 3 == 0
        if toxic:
            words += [rng.choice(insults)] if rng.random() < 0.8 else ["awful"]
            words += ["muslims"] if rng.random() < 0.9 else []
        rows.append((" ".join(rng.sample(words, len(words))) + ".", int(toxic)))
    train = spark.createDataFrame(rows, "text string, label int")
    neutral = spark.createDataFrame([(" ".join(rng.choices(filler, k=12)) + " muslims live here.",) for _ in range(100)], "text string")
    abuse = spark.createDataFrame([(" ".join(rng.choices(filler, k=12)) + " vermin.",) for _ in range(100)], "text string")
    rate = {}
    for strength in (0.0, 1.0):
        model = toxicity.train(train, counter=strength)
        share = lambda df: np.mean([r["score"] >= 0.5 for r in toxicity.scores(df, model).collect()])  # noqa: E731, B023
        rate[strength] = (share(neutral), share(abuse))
    assert rate[0.0][0] > 0.5 and rate[1.0][0] < 0.05 and rate[1.0][1] > 0.95


def test_counterfactual_sentences():
    pairs = list(toxicity.counterfactuals("Nothing here. The Muslims came.\nmen and women! end"))
    assert pairs == [("The Muslims came.", "The christians came."), ("men and women!", "women and men!")]


def test_vectors_count_what_they_say():
    from corpuspack.llm import words as W
    import pyarrow as pa

    texts = ["One two three.\nOne two three.", "", "A A A A ###", "é" * 10, None]
    raw, offsets = W.text_buffers(pa.array(texts))
    x = {name: column for name, column in zip(ranking.FEATURES, ranking.vectors(raw, offsets).T)}
    assert x["repeated_lines"].tolist() == [0.5, 0, 0, 0, 0] and x["adjacent_repeats"][2] == pytest.approx(3 / 5)
    assert np.expm1(x["log_words"]).tolist() == pytest.approx([6, 0, 5, 1, 0]) and x["others"][3] == 1
    assert x["repeated_words"].tolist() == pytest.approx([0.5, 0, 3 / 5, 0, 0]) and x["symbol_endings"][2] == pytest.approx(1 / 5)


def test_chunks_do_not_change_hashes():
    from corpuspack.llm import words as W
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choices(["Ab", "c,", "é", "漢字", "\t", "x" * 50], k=rng.randint(0, 30))) for _ in range(200)]
    raw, offsets = W.text_buffers(pa.array(texts))
    whole, rows = W.word_hashes(raw, offsets)
    parts = [W.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in W.chunks(offsets, 64)]
    assert np.array_equal(whole, np.concatenate(parts))
    names = {}
    import re

    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    for word, h in zip(words, whole.tolist()):
        assert names.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), word), h) == h
    assert len(set(names.values())) == len(names) and len(words) == len(whole) == rows[-1]


def test_placed_names():
    text = "One sentence here. Another one follows it!\nnext line"
    pairs = list(toxicity.placed(text, n=20))
    assert pairs == list(toxicity.placed(text, n=20)) and len(set(pairs)) > 10 and not list(toxicity.placed("  \n"))
    for a, b in pairs:
        a, b = a.split(), b.split()
        at = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        assert a[:at] == b[:at] and a[at + 1 :] == b[at + 1 :] and any(a[at] in g and b[at] in g for g in toxicity.IDENTITIES)
    assert len({n for g in toxicity.IDENTITIES for n in g} & {"juden", "noirs", "mujeres", "women"}) == 4


def _raw(model, texts):
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    return np.array([sum(weights.get(f, 0.0) for f in own.tolist()) for own in toxicity.features_of(texts)])


def test_the_penalty_acts_on_the_given_labels(spark):
    """Names placed in held-out texts, other ones than in training: the penalty lowers the change of the score, and costs nothing."""
    docs, marks = documents(spark, SF_MID), labels(spark, SF_MID)
    rows = toxicity.training_rows(docs, marks, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.MAX_ROWS)
    texts = [r["text"] for r in rows.collect()]
    n_swaps = sum(len([*toxicity.counterfactuals(t), *toxicity.placed(t)]) for t in texts)
    assert n_swaps >= toxicity.PLACED * len(texts) > 500
    held = docs.join(marks, "doc_id").filter(toxicity.held_out(toxicity.FOLDS, toxicity.HELD_OUT)).select("text", "toxic").collect()
    pairs = [p for r in held for p in toxicity.placed(r["text"], n=20, salt=9)]
    gap, right = {}, {}
    for strength in (0.0, 1.0):
        model = toxicity.train(rows, counter=strength)
        gap[strength] = np.abs(_raw(model, [a for a, _ in pairs]) - _raw(model, [b for _, b in pairs])).mean()
        right[strength] = np.mean([(s + model.bias >= 0) == (r["toxic"] == 1) for s, r in zip(_raw(model, [r["text"] for r in held]), held)])
    assert 0 < gap[1.0] < 0.5 * gap[0.0] and right[1.0] >= right[0.0]


def test_toxicity_fit_against_newton():
    """The accelerated steps reach the minimum of the same loss, found by Newton's method over a dense matrix."""
    rng = np.random.default_rng(1)
    x = (rng.random((80, 12)) < 0.3).astype(float)
    y = (rng.random(80) < 1 / (1 + np.exp(-(x[:, 0] * 3 - x[:, 1] * 2)))).astype(float)
    pairs = [(rng.choice(12, 3, replace=False), rng.choice(12, 3, replace=False)) for _ in range(15)]
    ridge, counter = 0.05, 0.7
    model = toxicity.fit([np.flatnonzero(r) for r in x], y, pairs, np.arange(12, dtype=np.uint64), ridge, counter, steps=6000)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (80 - y.sum()))
    d = np.array([np.bincount(a, minlength=12) - np.bincount(b, minlength=12) for a, b in pairs], dtype=float)
    z, w = np.column_stack([x, np.ones(80)]), np.zeros(13)
    fixed = np.zeros((13, 13))
    fixed[:12, :12] = ridge * np.eye(12) + counter * d.T @ d / len(pairs)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (share * p * (1 - p))[:, None]) + fixed, z.T @ (share * (p - y)) + fixed @ w)
    assert np.allclose(model.weights, w[:12], atol=1e-4)
    right = lambda raw: ((raw >= 0) == (y == 1)).sum()
    best = max(right(x @ model.weights - c) for c in np.append(x @ model.weights, np.inf))
    assert right(x @ model.weights + model.bias) == best  # the cut with the fewest errors, all cuts tried


def test_scores_against_plain_words(spark, docs_of):
    """Scores from words and beginnings found one by one in Python, each hashed alone."""
    from corpuspack.llm import words as W

    rows = [(r["doc_id"], r["text"]) for r in documents(spark, "/root/testdata/sf0.001").collect()] + [(10**6, "(Hello), \"w'orld!!!! ÉCOLE...; a"), (10**6 + 1, None)]
    model = toxicity.train(spark.createDataFrame([(t, i % 2) for i, t in rows], "text string, label int"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))

    def hashed(word):
        raw = np.frombuffer(word, dtype=np.uint8)
        return int(W.hash_spans(raw, np.array([0]), np.array([len(raw)]), True)[0])

    marks = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

    def plain(text):
        found = set()
        for word in (text or "").encode().split():
            for _ in range(3):
                word = word[1:] if word[:1] and word[:1] in marks else word
                word = word[:-1] if word[:1] and word[-1:] in marks else word
            if word:
                found.add(hashed(word))
                found |= {hashed(word[:k]) ^ (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in (4, 6)}
        return model.bias + sum(weights.get(f, 0.0) for f in found)

    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs_of(rows), model).collect()}
    assert len(weights) > 100 and all(got[i] == pytest.approx(1 / (1 + np.exp(-plain(t))), abs=1e-9) for i, t in rows)


def test_ranking_fit_against_newton():
    """Bradley-Terry weights from the same pairs by Newton's method, and the threshold from sorted merits."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, len(ranking.FEATURES)))
    good = x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=60) > 0.3
    model = ranking.fit(x, good, pairs=3000, ridge=0.01, steps=4000)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(good), 3000)] - z[draw.choice(np.flatnonzero(~good), 3000)]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / 3000 + 0.01 * np.eye(len(w)), d.T @ (p - 1) / 3000 + 0.01 * w)
    assert np.allclose(model.weights, w, atol=1e-4)
    merits = sorted(z @ w)
    n_bad = int((~good).sum())
    assert model.threshold == pytest.approx((merits[n_bad - 1] + merits[n_bad]) / 2, abs=1e-3)
