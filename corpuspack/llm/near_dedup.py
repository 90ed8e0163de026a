"""Operator 3: near-duplicates with a MinHash LSH forest.

1. A text becomes its set of distinct 5-word shingles (as 64-bit hashes) and a signature of
   ``TREES * DEPTH`` minimum hashes. Texts with equal sets form a class with a number of its own; from here on
   classes are compared, each through one text, so copies never meet each other again.
2. The forest: each tree orders all classes by ``DEPTH`` of their hashes. Classes that share the
   first ``LEAST`` hashes in a tree form a region of it. Two texts with similarity ``s`` share a
   region in some tree with probability ``1 - (1 - s ** LEAST) ** TREES`` (0.99999 at 0.85).
3. Candidates adapt to how dense a region is. First each region's hub, the member that lies in the
   most crowded deepest branches over all trees (the text that the others were copied from), is a
   candidate for all of its members. Then, along the sorted order, each class is a candidate for
   its next ``WIDTH`` neighbours of the region, which share its longest prefixes, unless the links
   so far already connect the two. A sparse region is thus compared whole at depth ``LEAST``, a dense
   one through its hub and at the depth where its branches thin out.
4. Candidates whose signatures rule the similarity out (by six standard deviations) go; the others
   are confirmed on their full sets. Links become components by minimum labels with pointer jumps.
5. Regions that still hold several components and more members than neighbours meet are settled exactly, by
   a join on rare shingles. A text of ``n`` shingles shares at least ``r * n`` of them with whatever it is linked with
   (``r``: the similarity asked for), so it has one of its ``n - ceil(r * n) + 1`` rarest in common with it; where these
   are not frequent, the texts that share one are the candidates. A text whose frequent shingles alone reach
   ``r * n`` (mostly a passage that many share) is known by their set besides: of texts with one such set the shortest is
   linked with all that may be linked by that set alone, and different such sets, of which there are few, are
   compared in pairs of blocks. So any two texts that share a region are linked, connected or compared.

The orders are range-partitioned, no shingle that is joined on has more than ``COMMON`` texts, and blocks are
bounded, so a region may span any number of tasks. The candidates of steps 3 and 4 are at most
``TREES * (1 + WIDTH)`` times the classes, and a passage in a million texts that are not linked is one set in step 5.
All intermediate tables lie in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import words as W
from corpuspack.session import materialize

SHINGLE = 5
TREES = 16
DEPTH = 8
LEAST = 4
WIDTH = 8
#: Rounds of hubs: the second is for the members that the first hub of a region is not linked with.
ROUNDS = 2
HASHES = TREES * DEPTH
#: A shingle of more open texts than this is frequent.
COMMON = 64
#: Frequent shingles are sent to the texts up to this number.
BROADCAST_SHINGLES = 500_000
#: A block of sets of frequent shingles has about so many of them, and so many shingles unless one has more.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 400_000


def signatures(sets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The minimum hashes (16 bits each) of each row's set; all ones for an empty set."""
    out = np.full((len(rows) - 1, HASHES), 0xFFFF, dtype=np.uint16)
    filled = np.flatnonzero(np.diff(rows))
    if not len(filled):
        return out
    steps = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    at = rows[:-1][filled]
    for k in range(HASHES):
        hashed = (sets ^ steps[k]) * (steps[HASHES + k] | np.uint64(1))
        least = np.minimum.reduceat(hashed >> np.uint64(20), at)
        out[filled, k] = (W.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hash binary, signature binary, text_key string`` for each row (set and signature null for
    an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.text_buffers(batch.column(1))
            counts, keys, marks = [], [], []
            for a, b in W.chunks(offsets):
                hashes, rows = W.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets, rows = W.shingle_sets(hashes, rows, SHINGLE)
                signed = signatures(sets, rows).astype(">u2")
                for i in range(b - a):
                    own = sets[rows[i] : rows[i + 1]]
                    counts.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    marks.append(signed[i].tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "set_hash", "signature", "text_key"],
            )

    text = F.col("text").cast("string")
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("text_key"))
    return frame.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary, text_key string")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles array<long>`` of the classes in ``nodes``, each from the text that stands for it.

    ``nodes``: ``node, doc_id, text_key, repeated``; ``repeated`` tells that rows with equal ids and texts exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.text_buffers(batch.column(1))
            for a, b in W.chunks(offsets):
                hashes, rows = W.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets, rows = W.shingle_sets(hashes, rows, SHINGLE)
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(nodes, "doc_id").filter(F.md5("text") == F.col("text_key")).select("node", "text", "repeated")
    once = found.filter(~F.col("repeated")).select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    again = found.filter("repeated").select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, shingles array<long>")
    return once.unionByName(again)


def _alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose signatures agree in at least ``least`` hashes."""
    signs = classes.select("node", "signature")
    both = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    both = both.join(signs.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _texts_of(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where to find the text of each class in ``nodes``."""
    return classes.select("node", "doc_id", "text_key", "repeated").join(nodes, "node", "left_semi")


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """A written table of the ``pairs`` with ``100 * intersection >= percent * union`` on the full sets."""
    p = percent / 100
    least = int(HASHES * (p - 6 * (p * (1 - p) / HASHES) ** 0.5))
    pairs = materialize(_alike(pairs, classes, least), "dedup-alike")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(full_sets(docs, _texts_of(classes, nodes)), "dedup-sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return materialize(both.filter(100 * shared >= percent * union).select("a", "b"), "dedup-links")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links (a, b)``; the component is its smallest node."""
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "dedup-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        after = lower.join(jump, "label").select("node", "old", F.least("label", "jump").alias("component"))
        after = materialize(after, "dedup-labels")
        labels = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def forest(classes: DataFrame) -> DataFrame:
    """A written table ``region, key, node``: the classes of every region with two members or more."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("signature"), t * 2 * DEPTH + 1, F.lit(2 * DEPTH)))
    rows = classes.select("node", F.posexplode(keys).alias("tree", "key"))
    rows = rows.select(F.xxhash64("tree", F.substring("key", 1, 2 * LEAST)).alias("region"), "key", "node")
    shared = rows.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1").select("region")
    return materialize(rows.join(shared, "region", "left_semi"), "dedup-forest")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Each member of a region with the region's hub: ``a, b``. ``rows``: ``region, key, node``."""
    leaves = rows.groupBy("region", "key").agg(F.count("*").alias("crowd"))
    weights = rows.join(leaves, ["region", "key"]).groupBy("node").agg(F.sum("crowd").alias("weight"))
    hubs = rows.join(weights, "node").groupBy("region").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    hubs = hubs.select("region", (-F.col("top.minus")).alias("hub"))
    pairs = rows.join(hubs, "region").filter(F.col("node") != F.col("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def neighbour_pairs(rows: DataFrame) -> DataFrame:
    """Neighbours along the sorted orders that no link connects yet: ``a, b``.

    ``rows``: ``region, key, node, component``. Ranges of the order are compared in place; the first
    and last rows of each range, ``2 * WIDTH`` at most, are compared once more together.
    """

    def compare(edges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent: list[tuple] = []  # the last WIDTH rows
            held, seen = [], 0
            for batch in batches:
                left, right = [], []
                for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    for other in recent:
                        if other[0] == row[0] and other[3] != row[3]:
                            left.append(min(other[2], row[2]))
                            right.append(max(other[2], row[2]))
                    recent = [*recent[-(WIDTH - 1) :], row]
                    if edges and seen < WIDTH:
                        held.append(row)
                    seen += 1
                yield out(left, right, [])
            if edges:
                yield out([], [], held + recent[max(0, 2 * WIDTH - seen) if seen < 2 * WIDTH else 0 :] if seen > WIDTH else held)

        def out(left, right, kept):
            n, m = len(left), len(kept)
            arrays = [pa.array(left + [None] * m, pa.int64()), pa.array(right + [None] * m, pa.int64())]
            for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64())):
                arrays.append(pa.array([None] * n + [r[i] for r in kept], kind))
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "region", "key", "node", "component"])

        return run

    schema = "a long, b long, region long, key binary, node long, component long"
    order, columns = ["region", "key", "node"], ["region", "key", "node", "component"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = materialize(ranged.mapInArrow(compare(True), schema), "dedup-neighbours")
    joints = first.filter("a is null").select(*columns).repartition(1).sortWithinPartitions(*order)
    second = joints.mapInArrow(compare(False), schema)
    return first.filter("a is not null").select("a", "b").unionByName(second.select("a", "b")).distinct()


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of each set of ``x`` with each of ``y`` (exact)."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    flat = [np.concatenate(side) for side in (x, y)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (x, y)]
    common = np.intersect1d(*flat)
    placed = []
    for values, row in zip(flat, rows):  # only what both sides hold, in the order of the shingles
        at = np.searchsorted(common, values)
        held = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == values) if len(common) else np.zeros(0, np.int64)
        order = held[np.argsort(at[held], kind="stable")]
        placed.append((at[order], row[order]))
    for a in range(0, len(common), width):
        dense = []
        for (at, row), side in zip(placed, (x, y)):
            lo, hi = np.searchsorted(at, [a, a + width])
            part = np.zeros((len(side), min(width, len(common) - a)), dtype=np.float32)  # sums up to 4096 are exact
            part[row[lo:hi], at[lo:hi] - a] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def open_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """A written table of links ``a, b`` that join the components inside the regions that are not met in full.

    ``rows``: ``region, key, node, component, n_shingles``. Regions of one component or of ``WIDTH + 1``
    members have been met. Of the others' members any two that are linked are in one component with these links.
    """
    sizes = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("components")).filter((F.col("components") > 1) & (F.col("n") > WIDTH + 1))
    held = rows.join(regions.select("region"), "region", "left_semi").select("node", "component").distinct()
    held = materialize(held, "dedup-open")
    if held.isEmpty():
        return materialize(held.select(F.col("node").alias("a"), F.col("node").alias("b")), "dedup-links")
    sets = materialize(full_sets(docs, _texts_of(classes, held.select("node"))).join(held, "node"), "dedup-sets")
    least = lambda size: F.ceil(size * percent / 100)  # noqa: E731  what a text shares with any text it is linked with
    texts = ranked(sets).withColumn("_least", least(F.col("size")))
    rarest = F.slice("rare", F.lit(1), F.greatest(F.col("size") - F.col("_least") + 1 - F.col("alone"), F.lit(0)).cast("int"))
    first = texts.select("node", "component", "size", F.explode(rarest).alias("_r")).select("node", "component", "size", "_r.shingle")
    first = materialize(first, "dedup-rarest")
    other = first.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "size")])
    near = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b"))
    near &= 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")
    pairs = first.join(other, "shingle").filter(near).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = materialize(pairs, "dedup-pairs").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    heavy = texts.filter(F.size("frequent") >= F.col("_least")).select("node", "component", "size", "frequent")
    found = links.unionByName(passage_links(materialize(heavy, "dedup-heavy"), percent))
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dedup-links")


def ranked(sets: DataFrame) -> DataFrame:
    """``node, component, size, alone, rare, frequent`` of the sets (``node, component, shingles``): how many shingles no other
    set has, those that ``COMMON`` sets or fewer have, the rarest first, and the others."""
    tokens = sets.select("node", F.explode("shingles").alias("shingle"))
    counts = materialize(tokens.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "dedup-counts")
    hot = materialize(counts.filter(F.col("n") > COMMON).select("shingle"), "dedup-frequent")
    if hot.count() <= BROADCAST_SHINGLES:
        hot = F.broadcast(hot)
    frequent = tokens.join(hot, "shingle").groupBy("node").agg(F.array_sort(F.collect_list("shingle")).alias("frequent"))
    rare = tokens.join(hot, "shingle", "left_anti").join(counts.filter(F.col("n") <= COMMON), "shingle")
    rare = rare.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("rare"))
    out = sets.select("node", "component", F.size("shingles").alias("size")).join(rare, "node", "left").join(frequent, "node", "left")
    none = F.array().cast("array<struct<n:bigint,shingle:bigint>>")
    out = out.withColumns({"rare": F.coalesce("rare", none), "frequent": F.coalesce("frequent", F.array().cast("array<bigint>"))})
    return materialize(out.withColumn("alone", F.col("size") - F.size("rare") - F.size("frequent")), "dedup-ranked")


def passage_links(heavy: DataFrame, percent: int) -> DataFrame:
    """Links between texts (``node, component, size, frequent``) that their frequent shingles alone suffice for.

    Two texts that share ``h`` shingles are linked if ``percent * (m + n) <= (100 + percent) * h``, so if two are linked by
    their frequent shingles, so are the shorter ones with the same frequent shingles. Of each set of these the
    shortest text stands for it: its links, and those of the others with the set they fit best, join all components
    that can be joined."""
    key = F.sha2(F.array_join("frequent", ","), 256)
    texts = heavy.withColumn("_set", key)
    one = texts.groupBy("_set", "component").agg(F.min(F.struct("size", "node")).alias("t")).select("_set", "component", "t.size", "t.node")
    standing = texts.groupBy("_set").agg(
        F.min(F.struct("size", "node")).alias("t"), F.first("frequent").alias("frequent"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    # a set of one component is of that component; one of several is compared with all
    standing = standing.select("_set", F.col("t.node").alias("node"), F.col("t.size").alias("size"), "frequent", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("t.node")).alias("component"))
    standing = materialize(standing, "dedup-passages")
    to = standing.select("_set", F.col("node").alias("to"), ((100 + percent) * F.size("frequent") - percent * F.col("size")).alias("room"))
    other = passage_pairs(standing, percent)
    both = other.select(F.col("a").alias("node"), "b", "room_a").unionByName(other.select(F.col("b").alias("node"), F.col("a").alias("b"), F.col("room_b").alias("room_a")))
    best = both.groupBy("node").agg(F.max(F.struct("room_a", "b")).alias("t")).join(standing.select("node", "_set"), "node")
    best = best.select("_set", F.col("t.b").alias("to"), F.col("t.room_a").alias("room"))
    fits = one.join(to.unionByName(best), "_set").filter((F.col("node") != F.col("to")) & (percent * F.col("size") <= F.col("room")))
    return fits.select(F.col("node").alias("a"), F.col("to").alias("b")).unionByName(other.select("a", "b"))


def passage_pairs(standing: DataFrame, percent: int) -> DataFrame:
    """A written table of the pairs ``a, b`` of ``node, size, component, frequent`` that are linked by their frequent shingles, with
    the room that each leaves: a text with ``a``'s frequent shingles is linked with ``b`` if ``percent`` times its size is
    ``room_a`` at most. Sets are dealt to blocks; a pair of blocks is a task. Sets of the component that has most of them
    (blocks from 0) meet the others (below 0) only."""
    blocks = lambda n, weight: max(1, -(-(n or 0) // BLOCK_ROWS), -(-(weight or 0) // BLOCK_SHINGLES))
    by = standing.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("frequent")).alias("weight"))
    top = by.orderBy(F.col("n").desc(), "component").first()
    n, weight = by.agg(F.sum("n"), F.sum("weight")).first()
    if top is None or n < 2:
        return standing.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("room_a"), F.lit(0).cast("long").alias("room_b")).limit(0)
    cores, others = blocks(top["n"], top["weight"]), blocks(n - top["n"], weight - top["weight"])
    is_core = F.col("component") == top["component"]
    mine = F.when(is_core, F.pmod(F.xxhash64("node"), F.lit(cores))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.lit(others)))
    up_to = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    own = -1 - F.col("block")
    met = F.when(is_core, F.transform(up_to(others), lambda k: F.struct(F.col("block").alias("x"), (-1 - k).alias("y")))).otherwise(
        F.concat(
            F.transform(up_to(cores), lambda k: F.struct(k.alias("x"), F.col("block").alias("y"))),
            F.transform(up_to(others), lambda k: F.struct((-1 - F.least(k, own)).alias("x"), (-1 - F.greatest(k, own)).alias("y"))),
        )
    )
    dealt = standing.withColumn("block", mine.cast("long")).select("node", "size", "component", "frequent", "block", F.explode(met).alias("p"))
    dealt = dealt.select("node", "size", "component", "frequent", "block", "p.x", "p.y")

    def compare(table: pa.Table) -> pa.Table:
        block, x, y, node, size, component = (table.column(c).to_numpy() for c in ("block", "x", "y", "node", "size", "component"))
        lists = table.column("frequent").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out = [np.zeros(0, np.int64)] * 4
        if len(left) and len(right):
            shared = (100 + percent) * shared_counts(*([flat[ends[i] : ends[i + 1]] for i in rows] for rows in (left, right)))
            rooms = shared - percent * size[right][None, :], shared - percent * size[left][:, None]
            i, j = np.nonzero((percent * size[left][:, None] <= rooms[0]) & (component[left][:, None] != component[right][None, :]) & (node[left][:, None] != node[right][None, :]))
            out = [node[left][i], node[right][j], rooms[0][i, j], rooms[1][i, j]]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "room_a", "room_b"), out)})

    return materialize(dealt.groupBy("x", "y").applyInArrow(compare, "a long, b long, room_a long, room_b long"), "dedup-passage-pairs")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``, and ``text_key``, the text's MD5.

    Texts with ``100 * intersection >= percent * union`` of their shingle sets are linked;
    ``component_id`` is the smallest ``doc_id`` reachable, and the row with that ``doc_id`` is kept. A text
    without words (null, empty) has no shingles and is linked with nothing, and so is a row with a
    null ``doc_id`` (``component_id`` null, kept). Rows with equal texts and ``doc_id`` give equal results;
    rows that share a ``doc_id`` with different texts are judged by their texts. Other columns of
    ``docs`` are ignored; an empty table gives an empty one.
    """
    rows = materialize(shingled(docs), "dedup-rows")
    usable = rows.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # One text stands for a class: that of its smallest doc_id. A class' number is given when it is written.
    own = usable.groupBy("set_hash", "doc_id", "text_key").agg(F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = own.groupBy("set_hash").agg(
        F.min(F.struct("doc_id", "text_key", (F.col("n") > 1).alias("repeated"))).alias("text"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
    )
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "set_hash", "text.*", "signature", "n_shingles")
    classes = materialize(classes, "dedup-classes")
    trees = forest(classes)
    links = labels = None
    for _ in range(ROUNDS):
        open_rows = _labelled(trees, labels)
        if labels is not None:  # regions without the members that their first hub is linked with
            weight = open_rows.groupBy("region", "component").agg(F.count("*").alias("size"))
            largest = weight.groupBy("region").agg(F.max(F.struct("size", "component")).alias("top"))
            open_rows = open_rows.join(largest.select("region", F.col("top.component").alias("hub_component")), "region")
            open_rows = open_rows.filter("component <> hub_component")
        found = confirm(docs, classes, hub_pairs(open_rows.select("region", "key", "node")), percent)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    links = links.unionByName(confirm(docs, classes, neighbour_pairs(_labelled(trees, labels)), percent))
    labels = components(links)
    unmet = _labelled(trees, labels).join(classes.select("node", "n_shingles"), "node")
    found = open_links(docs, classes, unmet, percent)
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    placed = _labelled(classes.select("set_hash", "node", "doc_id"), labels)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = placed.join(least, "component").select("set_hash", "least")
    out = rows.select("doc_id", "n_shingles", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    # rows without a class (no words, no id) have a key of their own, so that they do not all go to one task
    key = F.coalesce("set_hash", F.concat(F.lit("-"), F.xxhash64("doc_id", "text_key").cast("string")).cast("binary"))
    out = out.withColumn("set_hash", key).join(placed, "set_hash", "left")
    component = F.coalesce("least", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key",
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns. Rows with equal ``doc_id`` and text are one document."""
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select("doc_id", "text_key").distinct()
    gone = materialize(gone, "dedup-gone")
    text = F.md5(docs["text"].cast("string"))
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["doc_id"]) & (text == gone["text_key"]), "left_anti").select(*docs.columns)
