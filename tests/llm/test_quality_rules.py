import collections
import math
import random
import re

import numpy as np
import pytest

from corpuspack.llm import quality_rules as Q
from corpuspack.llm.common import documents, labels
from corpuspack.llm.queries import op10_quality_rules
from tests.conftest import SF_MID

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def vector(text):
    n, chars, symbols, dup, repeated = base(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    upper = sum(c.isupper() for c in text)  # the fixtures have no title-case letters
    unit = Q.RESOLUTION
    return [
        math.log1p(symbols / n) / unit["symbols"], math.log1p(repeated / n) / unit["repeats"], math.log1p(upper / chars) / unit["capitals"],
        math.log1p(dup / len(lines)) / unit["lines"], chars / n / unit["length"], math.log1p(len(re.findall("[!?]", text)) / n) / unit["marks"],
    ]


def brute_force_distances(rows):
    """The method row by row in numpy; ``rows``: ``(doc_id, text, lang, source)`` that pass the base rules."""
    z = np.array([vector(r[1]) for r in rows])
    group = np.array([f"{r[2]}|{r[3]}" for r in rows])
    lang = np.array([str(r[2]) for r in rows])
    names = sorted(set(group))

    def moments(kept):
        own = {g: z[kept & (group == g)] for g in names}
        out = {}
        for g in names:
            same = z[kept & (lang == g.split("|")[0])]
            n = len(own[g]) + Q.PRIOR
            m = (own[g].sum(axis=0) + Q.PRIOR * same.mean(axis=0)) / n
            s = (own[g].T @ own[g] + Q.PRIOR * same.T @ same / len(same)) / n
            out[g] = (m, s - np.outer(m, m))
        return out

    def distances(params, factor=1.0):
        d = np.zeros(len(z))
        for g in names:
            m, c = params[g]
            x = z[group == g] - m
            d[group == g] = np.einsum("ij,jk,ik->i", x, np.linalg.inv(factor * c + np.eye(Q.DIM)), x)
        return d

    start = {}
    for g in names:
        x = np.floor(z[group == g] * 8)
        at = lambda p: np.sort(x, axis=0)[max(0, math.ceil(p * len(x)) - 1)] / 8 + 1 / 16  # noqa: E731, B023
        start[g] = (at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2))
    d = distances(start)
    for _ in range(Q.STEPS):
        kept = np.zeros(len(z), dtype=bool)
        for g in names:
            own = np.flatnonzero(group == g)
            bins = np.floor(np.log2(1 + d[own]) * 24)
            before = np.array([(bins < b).sum() for b in bins])
            kept[own[before < Q.SUPPORT * len(own)]] = True
        d = distances(moments(kept), Q.consistency(Q.SUPPORT, Q.DIM))
    return distances(moments(d <= Q.chi2_quantile(0.975, Q.DIM)), Q.consistency(0.975, Q.DIM))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents(spark, SF_MID).collect()]
    got = {r["doc_id"]: r for r in op10_quality_rules(spark, SF_MID).collect()}
    assert len(got) == len(docs)
    passed = []
    for row in docs:
        counts = base(row[1])
        r = got[row[0]]
        assert tuple(r[c] for c in Q.BASE) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if not failed:
            passed.append(row)
    want = brute_force_distances(passed)
    limit = Q.chi2_quantile(Q.CONFIDENCE, Q.DIM)
    have = np.array([got[r[0]]["distance"] for r in passed])
    assert np.median(np.abs(have - want) / (want + 0.01)) < 1e-6  # a bin's border may take a row over
    clear = np.abs(want / limit - 1) > 0.2
    assert all(got[r[0]]["kept"] == (w <= limit) for r, w, c in zip(passed, want, clear) if c) and clear.mean() > 0.98
    marks = {r["doc_id"]: r["quality"] for r in labels(spark, SF_MID).collect()}
    judged = [(got[d]["kept"], marks[d]) for d, *_ in passed if d in marks]
    assert np.mean([k for k, q in judged if q == 1]) > 0.99 and np.mean([k for k, q in judged if q == 0]) < 0.1


def test_chi_square():
    assert Q.chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3) and Q.chi2_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
    assert Q.consistency(1 - 1e-12, 4) == pytest.approx(1, abs=1e-6)


def plain(i, n=80):
    return " ".join(f"{'abcdefghij'[(i * 7 + k) % 10] * (3 + (i + k) % 4)}{k}" for k in range(n))


def test_outliers_of_their_own_group(spark, docs_of):
    """A crowd of outliers (a quarter of the group) does not shift the estimate."""
    rows = [(i, plain(i), "en", "a") for i in range(150)] + [(1000 + i, plain(i) + " %%% $$$" * 20, "en", "a") for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs_of(rows)).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[1000 + i] for i in range(40))


def test_each_statistic_alone_rejects(spark, docs_of):
    """A text that passes the base rules and is far off in one statistic only."""
    def words(i, n=80, end=""):
        return [f"{'abcdefghij'[(i * 7 + k) % 10] * (3 + (i + k) % 4)}{k}{end}" for k in range(n)]

    repeated = " ".join(words(200) + words(200)[:32])  # 57 % of the words: fails the base rules
    some = " ".join(words(200) + words(200)[:24])  # 46 %
    lines = "\n".join([*(" ".join(words(200)[k * 4 : k * 4 + 4]) for k in range(20)), *["x y"] * 30])
    odd = {
        "symbols": " ".join(words(200, end="%")[:30] + words(200)[30:]),
        "repeats": some, "capitals": " ".join(w.upper() for w in words(200)), "lines": lines,
        "length": " ".join(w * 2 for w in words(200)), "marks": " ".join(words(200, end="!")[:30] + words(200)[30:]),
    }
    rows = [(i, plain(i), "en", "a") for i in range(120)] + [(1000 + k, t, "en", "a") for k, t in enumerate(odd.values())]
    rows.append((2000, repeated, "en", "a"))
    got = {r["doc_id"]: r for r in Q.quality_rules(docs_of(rows)).collect()}
    assert all(got[i]["kept"] for i in range(120)) and got[2000]["base_failed"]
    assert [(k, got[1000 + i]["base_failed"], got[1000 + i]["kept"]) for i, k in enumerate(odd)] == [(k, False, False) for k in odd]


def test_keep_good_returns_whole_rows(spark, docs_of):
    rows = [(i, plain(i), "en", "a") for i in range(30)] + [(99, "too short", "en", "a")]
    df = docs_of(rows, extra=("n_words", "kept", "_group", "_z_symbols"))
    out = Q.keep_good(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(30))


def test_odd_rows(spark, docs_of):
    rng = random.Random(2)  # words like those of plain(), no window twice
    long = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) + str(rng.randint(0, 79)) for _ in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, plain(1), "en", "a"), (4, plain(2), None, "a"), (5, plain(2), "en", None), (5, plain(2), "en", None), (6, long, "en", "a"), (7, "a b c " * 40000, "en", "a")]
    got = Q.quality_rules(docs_of(rows, extra=("n_words", "kept", "distance", "_group"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and not any(by[i]["kept"] for i in (1, 2, 3, 7)) and all(by[i]["kept"] for i in (None, 4, 5, 6))
    assert by[7]["n_repeat_words"] == 120000 and by[6]["n_repeat_words"] == base(long)[4] < 100 and by[1]["n_words"] == 0
    assert Q.quality_rules(docs_of([])).count() == 0


def test_more_groups_than_a_broadcast_holds(spark, monkeypatch):
    """The same verdicts when the parameters meet the rows in parts instead of being sent to them."""
    docs = documents(spark, "/root/testdata/sf0.001")
    few = sorted(tuple(r) for r in Q.quality_rules(docs).select("doc_id", "base_failed", "kept").collect())
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    parts = Q.quality_rules(docs)
    assert sorted(tuple(r) for r in parts.select("doc_id", "base_failed", "kept").collect()) == few
