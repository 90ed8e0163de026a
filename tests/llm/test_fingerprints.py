import hashlib

import numpy as np
import pytest

from corpuspack.llm import fingerprints
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op8_imatch_fingerprints
from tests.conftest import SF_SMALL


def brute_force_edits(rows):
    """``rows``: ``(doc_id, text)`` with different ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        after, text = order[(i + 1) % len(order)][1] or "", text or ""
        half = len(text) // 2
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest(), order[(i + 1) % len(order)][0])
    return out


def like(a, b):
    cut = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    pairs = [(x, y) for x, y in zip(cut(a), cut(b)) if x != "0" * 8 or y != "0" * 8]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def check(rows, got):
    want = brute_force_edits(rows)
    by = {r["doc_id"]: r for r in got}
    assert by.keys() == want.keys()
    for doc, (n, digest, after) in want.items():
        r = by[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(like(r["fingerprint"], by[after]["fingerprint"]))
    return by


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF_SMALL).collect()]
    by = check(rows, op8_imatch_fingerprints(spark, SF_SMALL).collect())
    prints = {}
    for doc, text in rows:
        assert prints.setdefault(text, by[doc]["fingerprint"]) == by[doc]["fingerprint"]
    assert len(set(prints.values())) >= 0.98 * len(prints)
    assert np.mean([r["near_edited"] > r["near_next"] for r in by.values() if r["n_chars"] > 200]) > 0.9


def test_the_lexicon_is_the_band(spark, docs_of):
    rows = [(i, f"every t{i} d{i % 50} c{i % 4}.") for i in range(100)]
    terms = fingerprints.lexicon(docs_of(rows), (1.0, 4.0))
    assert sorted(r["frequency"] for r in terms.collect()) == [2] * 50 + [25] * 4  # not "every" (100), not t (1)


def test_both_lookups_agree(spark, docs_of):
    rows = [(i, f"every t{i} d{i % 50} c{i % 4}. only{i}" if i % 9 else f"rare{i} alone{i}") for i in range(120)]
    a = fingerprints.fingerprints(docs_of(rows), (1.0, 4.5)).select("doc_id", "fingerprint").collect()
    b = fingerprints.fingerprints(docs_of(rows), (1.0, 4.5), table_terms=0).select("doc_id", "fingerprint").collect()
    assert sorted(a) == sorted(b) and len({r["fingerprint"] for r in a}) > 50


def test_order_case_and_marks_play_no_part(spark, docs_of):
    rows = [(1, "alpha beta gamma"), (2, "Gamma, beta\nALPHA alpha."), (3, "alpha beta delta"), (4, "")]
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs_of(rows), (0.0, 9.0)).collect()}
    assert f[1] == f[2] != f[3] and f[4] == "0" * 8 * 64 and like(f[1], f[3]) > 0


def test_odd_rows(spark, docs_of):
    rows = [(10, None), (9, ""), (8, "a"), (7, "é🙂x"), (-5, "last one here"), (3, "word " * 60000), (2, "b c d e f")]
    check(rows, fingerprints.compare_with_edits(docs_of(rows, extra=("key", "part", "hashes", "fingerprint"))).collect())
    twins = [(1, "one two three four"), (1, "one two three four"), (1, "other text"), (None, "no id"), (5, "five six")]
    got = fingerprints.compare_with_edits(docs_of(twins)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 5), (1, 10), (1, 18), (1, 18), (5, 8)]
    assert fingerprints.compare_with_edits(docs_of([])).count() == 0
    assert check([(4, "single document")], fingerprints.compare_with_edits(docs_of([(4, "single document")])).collect())[4]["near_next"] == 1.0


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_ranges_share_no_task(spark, parts):
    numbers = fingerprints._numbers_of_tasks(spark, parts)
    assert len(set(numbers)) == len(numbers) == parts
    rows = spark.createDataFrame([(n,) for n in numbers], "part int").repartition(parts, "part")
    assert max(len(p) for p in rows.rdd.glom().collect()) == 1
