import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuspack.llm import personal_data as pd
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op12_bilstm_crf_pii
from corpuspack.llm.tagger import Tagger, spans_of, transitions_allowed
from tests.conftest import SF_SMALL

SF_LARGE = "/root/testdata/sf0.1"


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == len(d) % 2 - 1 or (len(d) - 1 - i) % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)]
        if 16 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-01 5()9\n%é", max_size=60))
def test_base_equals_the_patterns(text):
    assert pd.base_spans(text) == plain_base(text)


def test_base_on_real_and_awkward_texts(spark):
    for r in documents(spark, SF_SMALL).collect():
        assert pd.base_spans(r["text"]) == plain_base(r["text"])
    for text in ("4111111111111111", "4111 1111-1111 1111 2", "+1 (774) 555-1544", "a@b.c@d.e", "x@y", "@a.b", "1.2.3.256", "0001.2.3.4.5.6.7.8", "a@b.c.", "+12", "é" * 9 + "q@w.e"):
        assert pd.base_spans(text) == plain_base(text)
    assert pd.base_spans("a" * 300_000 + "1" * 300_000 + "." * 300_000 + "+" * 100_000) == []  # linear


def test_gradient_against_differences():
    model, rng = Tagger.fresh(10, 2, embed=4, hidden=3), np.random.default_rng(0)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    codes, tags = rng.integers(0, 10, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [1, 1, 2, 0, 3, 4, 4]])
    _, grads = model.gradient(codes, tags)
    places = {"trans": (1, 2), "embed": (int(codes[0, 0]), 1)}
    for name, grad in grads.items():
        w = model.weights[name]
        at = places.get(name) or tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        sides = []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            sides.append(model.gradient(codes, tags)[0])
        w[at] = old
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(grad[at], rel=1e-3, abs=1e-6), name


def test_decoding_against_every_path():
    """Viterbi, also of several lengths together, against all tag sequences."""
    import itertools

    model, rng = Tagger.fresh(5, 1), np.random.default_rng(3)
    model.weights["trans"] = rng.normal(size=(3, 3)).astype(np.float32)
    allowed = transitions_allowed(1)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 4, 2, 6, 3)]
    for e, tags in zip(scores, model.decode(scores)):
        def worth(path, e=e):
            if not allowed[0, path[0]] or any(not allowed[a, b] for a, b in zip(path, path[1:])):
                return -np.inf
            return sum(e[i, t] for i, t in enumerate(path)) + sum(model.weights["trans"][a, b] for a, b in zip(path, path[1:]))

        assert tuple(tags) == max(itertools.product(range(3), repeat=len(e)), key=worth)
    assert spans_of(np.array([0, 1, 2, 2, 1, 0, 3, 4, 1])) == [(0, 1, 4), (0, 4, 5), (1, 6, 8), (0, 8, 9)]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 900), st.lists(st.integers(0, 899), max_size=4))
def test_windows_cover_all_near_a_trigger(n, places):
    text = list("x" * n)
    for p in places:
        if p < n:
            text[p] = "7"
    text = "".join(text)
    numbers = pd.window_numbers(text).tolist()
    covered = {i for j in numbers for i in range(j * pd.STRIDE, j * pd.STRIDE + pd.WINDOW)}
    for m in pd.TRIGGER.finditer(text):
        assert set(range(max(0, m.start() - pd.MARGIN), min(n, m.end() + pd.MARGIN))) <= covered
    assert numbers == sorted(set(numbers)) and all(j * pd.STRIDE < n for j in numbers)


@pytest.fixture(scope="module")
def tagger(spark):
    return pd.train(pd.training_windows(documents(spark, SF_LARGE).filter("doc_id % 2 = 0")))


def test_held_out_spans(spark, tagger):
    """On texts that it was not trained on, the network alone finds what the patterns find, and other writings of it."""
    texts = [r["text"] for r in documents(spark, SF_LARGE).filter("doc_id % 2 = 1 AND text RLIKE '[0-9@]'").limit(400).collect()]
    hit = found = true = 0
    for text, tagged in zip(texts, pd.tag_windows(tagger, texts)):
        want = set(pd.base_spans(text, checked=False))
        hit, found, true = hit + len(want & set(tagged)), found + len(tagged), true + len(want)
    assert true > 100 and hit / true > 0.95 and hit / found > 0.95
    rng, changed = random.Random(1), []
    for text in texts:
        for kind, a, b in pd.base_spans(text)[:1]:
            for new in pd.variants(kind, text[a:b]):
                other = text[:a] + new + text[b:]
                if not any(x < a + len(new) and y > a for _, x, y in pd.base_spans(other)):
                    changed.append((other, kind, a, a + len(new)))
    changed = rng.sample(changed, 150)
    tagged = pd.tag_windows(tagger, [c[0] for c in changed])
    good = sum((k, a, b) in pd.added_spans(t, pd.base_spans(t), own) for (t, k, a, b), own in zip(changed, tagged))
    assert good > 0.9 * len(changed)


def test_query(spark):
    rows = {r["doc_id"]: r["text"] for r in documents(spark, SF_SMALL).collect()}
    got = op12_bilstm_crf_pii(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        text = rows[r["doc_id"]] or ""
        base = plain_base(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in base) for i in range(4)]
        names = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert {s for s in names.split(",") if s} <= set(spans)
        if not re.search("[0-9@]", text):
            assert not spans


def test_spans_across_windows(tagger):
    """Wherever a number stands in the raster of windows, it is found whole and once."""
    number = "(774) 555-1544"
    texts = ["the of and in to " * 8]
    for at in range(40, 130, 7):
        filler = ("the of and in to " * 20)[:at].rsplit(" ", 1)[0]
        texts.append(f"{filler} {number} and the of in to that with")
    tagged = pd.tag_windows(tagger, texts)
    assert pd.added_spans(texts[0], [], tagged[0]) == []
    found = [pd.added_spans(t, [], own) for t, own in zip(texts[1:], tagged[1:])]
    want = [[(3, t.index(number), t.index(number) + len(number))] for t in texts[1:]]
    assert sum(a == b for a, b in zip(found, want)) >= len(want) - 1


def test_odd_rows(spark, docs_of, tagger):
    text = "write to ann.lee.7@mail.example.com or +1 (774) 555-1544 now"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "4111 1111 1111 1111 é 4111 1111 1111 1112"), (5, "9" * 200_000), (6, "a" * 200_000 + " b@c.de")]
    got = pd.personal_data(docs_of(rows, extra=["spans", "kind", "n_ip"]), tagger).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows) and len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[3][0][1:5] == by[None][0][1:5] == (1, 0, 0, 1) and by[3][0]["spans"] == "email:9:35,phone:39:56"
    assert all(by[i][0][1:] == (0, 0, 0, 0, empty, "") for i in (1, 2))
    assert by[4][0]["n_card"] == 1 and by[4][0]["spans"] == "card:0:19"
    assert by[6][0]["n_email"] == 1 and by[5][0]["n_card"] == 0


def test_nothing_to_learn_from(spark, docs_of):
    assert pd.train(pd.training_windows(docs_of([(1, "no data 12 here"), (2, None)]))) is None
    assert [r["spans"] for r in pd.personal_data(docs_of([(1, "no data 12 here")])).collect()] == [""]
    assert pd.personal_data(docs_of([])).collect() == []
