import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuspack.llm import word_runs
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op13_dyadic_runs
from tests.conftest import SF_SMALL


def brute_force(words, least=12):
    """Every period tried at every place; of the periods of one stretch the smallest stays."""
    best, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            first = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - first >= p and i - first + p >= least:
                best.setdefault((first, i - first + p), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def rows_of(catcher):
    return [tuple(r) for r in catcher.runs().tolist()]


def caught(words, step=None, **options):
    catcher = word_runs.SquareCatcher(**options)
    for a in range(0, len(words), step or max(1, len(words))):
        catcher.append(np.array(words[a : a + (step or len(words))], dtype=np.int64))
    return rows_of(catcher)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(0, 40), st.integers(1, 30), st.integers(1, 7))
def test_runs_against_brute_force(words, start, period, step):
    words = words + [words[start % len(words) + (i % period) % max(1, len(words) - start % len(words))] if words else 0 for i in range(30)]
    want = sorted(brute_force(words), key=lambda r: (r[0], r[2]))
    assert caught(words) == caught(words, step) == want


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [thue_morse(600), fibonacci(700), [0] * 300, list(range(50)) * 5 + [1, 2]])
def test_hard_sequences(words):
    want = sorted(brute_force(words, 2), key=lambda r: (r[0], r[2]))
    assert caught(words, least=2) == caught(words, 37, least=2) == want


def test_work_stays_near_linear():
    """A million equal words, and a million words of the richest sequence, are each read in seconds."""
    assert caught([7] * 1_000_000) == [(0, 1_000_000, 1)]
    assert len(caught(fibonacci(300_000))) > 50_000


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = sorted(brute_force(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    text_of = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, milli, hashlib.sha256(text_of.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def key(row):
    return (row[0] is None, row[0] or 0, row[1:] and str(row[1:]))


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF_SMALL).collect()]
    got = [tuple(r) for r in op13_dyadic_runs(spark, SF_SMALL).collect()]
    short = {d for d, t in rows if len((t or "").split()) < 2500}  # the brute force is quadratic
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows)
    assert sorted((r for r in got if r[0] in short), key=key) == sorted((expected(d, t) for d, t in rows if d in short), key=key)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, docs_of):
    periodic = " ".join(["a b c"] * 9) + " x 　 \x1c y"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, periodic), (10, periodic), (10, periodic), (11, "solo"), (12, "x " * 40_000)]
    got = sorted((tuple(r) for r in word_runs.periodic_runs(docs_of(rows, extra=["n_runs", "start"]), planted=True).collect()), key=key)
    want = sorted((expected(d, t) for d, t in rows if d != 12), key=key)
    assert [r for r in got if r[0] != 12] == want
    assert [r[1:6] for r in got if r[0] == 12] == [(1, 0, 40_000, 1, 40_000_000)]
    assert word_runs.periodic_runs(docs_of([])).collect() == []


def test_documents_in_one_chunk_do_not_touch(spark, docs_of):
    """Copies side by side are periodic together, but each document has its own runs only."""
    text = " ".join(f"w{i}" for i in range(20))
    assert {r["n_runs"] for r in word_runs.periodic_runs(docs_of([(i, text) for i in range(30)])).collect()} == {0}
    rng = random.Random(4)
    lists = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(60))] for _ in range(50)]
    for words, runs in zip(lists, word_runs.runs_of_documents(lists)):
        assert [tuple(r) for r in runs.tolist()] == sorted(brute_force(words), key=lambda r: (r[0], r[2]))
