import random
import re

import pytest

from corpuspack.llm import near_dedup
from corpuspack.llm.common import documents
from corpuspack.llm.queries import op3_lsh_forest_dedup
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_force(rows, percent):
    """Every pair of different sets; ``doc_id -> (n, component)``."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    for d, s in sets.items():
        for other in {o for x in s for o in by_shingle[x] if o > d}:
            shared = len(s & sets[other])
            if 100 * shared >= percent * len(s | sets[other]):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF_SMALL).collect()]
    assert result(op3_lsh_forest_dedup(spark, SF_SMALL)) == brute_force(rows, 85)


@pytest.fixture(scope="module")
def hard_groups():
    """A star (copies linked with the base only), a chain, two stars that share a passage, copies, and loners."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = lambda n: [word() for _ in range(n)]

    def edited(base, k):
        out = list(base)
        for i in rng.sample(range(len(base)), k):
            out[i] = word()
        return out

    rows = []
    base = text(300)
    rows += [base] + [edited(base, 4) for _ in range(250)]
    passage = text(180)
    for _ in range(2):
        own = passage + text(60)
        rows += [own] + [edited(own, 3) for _ in range(60)]
    chain = [text(200)]
    for _ in range(12):
        chain.append(edited(chain[-1], 2))
    rows += chain + [text(rng.randint(1, 60)) for _ in range(150)]
    rows = [" ".join(r) for r in rows]
    rows += [rows[0]] * 400 + ["Same Words here"] * 30 + ["same words\there "] * 5
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_stars_chains_and_copies(spark, docs_of, hard_groups, percent):
    assert result(near_dedup.near_duplicates(docs_of(hard_groups), percent)) == brute_force(hard_groups, percent)


def test_keep_one_of_each(spark, docs_of, hard_groups):
    want = {d for d, (_, c) in brute_force(hard_groups, 80).items() if d == c}
    kept = near_dedup.keep_one_of_each(docs_of(hard_groups, extra=("node", "kept")))
    assert {r["doc_id"] for r in kept.collect()} == want
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "kept"]


def test_links_inside_a_dense_region(spark, docs_of, monkeypatch):
    """Hundreds of texts that share a template just below the threshold, and pairs of them above it, in several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 60)
    rng = random.Random(5)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    template = text(200)
    rows = [template + text(19) for _ in range(420)]
    for i in range(40):  # the first words behind the template are those of another text
        rows.append(template + rows[i * 7][200:202] + text(17))
    rows += [rows[50][:-1] + text(1) for _ in range(12)]  # a linked group between them
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = brute_force(rows, 85)
    assert 40 <= sum(c != d for d, (_, c) in want.items()) < 60
    assert result(near_dedup.near_duplicates(docs_of(rows), 85)) == want


def test_odd_rows(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "one two"), (6, long), (7, long + " more"), (8, "É é"), (9, "é é")]
    got = near_dedup.near_duplicates(docs_of(rows, extra=("set_hash", "node", "component"))).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[None] == (1, None, True)
    assert by[7][1] == 6 and by[6] == (39996, 6, True) and by[8][1] == 8 and by[9][1] == 9
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_rows_that_share_a_doc_id(spark, docs_of):
    """Rows are judged by their texts: one copy of each group stays, whatever ids the copies have."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(2, a), (5, b), (5, a + " more"), (7, b + " more"), (5, a + " more"), (9, "c " * 9), (9, None)]
    got = sorted(tuple(r)[:4] for r in near_dedup.near_duplicates(docs_of(rows)).collect())
    want = [(2, 56, 2, True), (5, 56, 5, True), (5, 57, 2, False), (5, 57, 2, False), (7, 57, 5, False), (9, 0, 9, True), (9, 1, 9, True)]
    assert got == sorted(want)
    kept = near_dedup.keep_one_of_each(docs_of(rows, extra=("text_key", "least")))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(2, a), (5, b), (9, "c " * 9)] and kept.count() == 4


@pytest.mark.parametrize(("percent", "common", "seed"), [(80, 64, 1), (85, 3, 2), (80, 2, 3), (85, 8, 4), (80, 12, 5)])
def test_open_regions_against_brute_force(spark, docs_of, monkeypatch, percent, common, seed):
    """One region of texts that no link joins yet: shared passages, edits of them, and a few words of their own."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passages = [[word() for _ in range(80)] for _ in range(3)]
    passages.append(passages[0][:70] + passages[1][:6])
    rows = []
    for _ in range(150):
        text = list(rng.choice(passages))
        if rng.random() < 0.4:
            text[rng.randrange(len(text))] = word()
        text += rng.choice([[], [word()] * 3, [word() for _ in range(rng.randint(1, 25))], passages[2][: rng.randint(1, 20)]])
        rows.append(" ".join(text[rng.randint(0, 3) :]))
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(rows))]
    docs = docs_of(rows)
    shingled = near_dedup.shingled(docs)
    classes = shingled.select(F.col("doc_id").alias("node"), "doc_id", "text_key", F.lit(False).alias("repeated"), "n_shingles")
    open_rows = classes.select(F.lit(1).cast("long").alias("region"), F.lit("k").alias("key"), "node", F.col("node").alias("component"), "n_shingles")
    links = near_dedup.open_links(docs, classes, open_rows, percent)
    sets = {d: shingles(t) for d, t in rows}
    for r in links.collect():  # every link is one
        x, y = sets[r["a"]], sets[r["b"]]
        assert 100 * len(x & y) >= percent * len(x | y)
    got = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    want = {d: c for d, (_, c) in brute_force(rows, percent).items()}
    assert {d: got.get(d, d) for d in sets} == want and 1 < len(set(want.values())) < len(rows)


def test_a_passage_in_many_texts_is_one_set(spark, docs_of, monkeypatch):
    """Texts of a template a little below the threshold, all with the same frequent shingles, are never compared pair by pair."""
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    template = text(120)
    rows = [(i, " ".join(template + text(16))) for i in range(1500)]
    rows += [(2000 + i, rows[i * 30][1] + " x") for i in range(40)]
    compared = []
    whole = near_dedup.passage_pairs
    monkeypatch.setattr(near_dedup, "passage_pairs", lambda standing, percent: compared.append(standing.count()) or whole(standing, percent))
    want = {i: i for i, _ in rows} | {2000 + i: i * 30 for i in range(40)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(rows), 85).collect()}
    assert got == want and sum(compared) <= 5
