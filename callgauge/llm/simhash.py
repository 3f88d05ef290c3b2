"""SimHash near-duplicates: exact pairs within a Hamming radius by distributed vantage-point trees.

Documents become fingerprints, equal fingerprints become one point, and points are dealt over the leaves of a
vantage-point tree grown on a sample that grows with them. A point lies in the near child of a vantage point if its
distance is at most the cut, else in the far child; far points within the radius of the cut are also copied to the
near child. By the triangle inequality every pair within the radius then meets in some leaf, so what a leaf finds
is exact and whole. A leaf that is larger than a block is compared block against block, each pair of blocks
a task of its own. A task returns a spanning star of each group that it finds, never the pairs,
and stars are joined to components by alternating large-star and small-star rounds.

In 64 random bits distances crowd around 32 by 4, so a radius of 3 copies a quarter of the points a level. Of two
fingerprints that differ in 3 bits, though, one half differs in 1 at most: so two trees are grown, one over the
distances of each half, whose cuts copy a seventh of the points a level and leave 0.57 of them to a child. Copies then
grow as the points to the power 0.23 and comparisons a point as much, against 0.58 for one tree over the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import Scratch, text_of

SAMPLE = 20_000  #: points that a tree is grown on at least, one in SHARE of more, and at most MOST (8 MB on the driver)
SHARE, MOST = 8, 1 << 20
LEAF = 1 << 14  #: points at which a leaf is not cut further, and the size of a block
TRIED = 4_096  #: points of a node's sample on which its vantage points are tried
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
SLAB = 1 << 22  #: comparisons held in memory at once


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased (A-Z) words, repeats included."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(parts) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it."""
    held = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        held += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(held * 2 > len(hashes)).tobytes(), "big")


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for the same shingles (the finaliser of SplitMix64)."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, confirm: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, fp, fp2 (signed longs), n (shingles). fp2 is 0 unless ``confirm``. Without a word: fp 0, n 0."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                out.append((majority(h), majority(remixed(h)) if confirm else 0, len(h)))
            a, b, n = zip(*out, strict=True) if out else ((), (), ())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(a), signed(b), pa.array(n, pa.int64())], ["_id", "fp", "fp2", "n"])

    return rows.mapInArrow(run, rows.select("_id").schema.add("fp", T.LongType()).add("fp2", T.LongType()).add("n", T.LongType()))


class Node:
    """A cut of the tree; a child that is an int is a leaf."""

    __slots__ = ("vantage", "cut", "near", "far")

    def __init__(self, vantage: int, cut: int, near, far):
        self.vantage, self.cut, self.near, self.far = vantage, cut, near, far


def grow(sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, seed: int = 5):
    """A tree over ``total`` points of which ``sample`` is a random part; cuts that don't save a tenth are not made."""
    rng, leaves = np.random.default_rng(seed), iter(range(1 << 30))
    scale = total / max(1, len(sample))

    def node(part: np.ndarray):
        if len(part) * scale <= leaf or len(part) < 64:
            return next(leaves)
        best, some = (0.9, 0, 0), part if len(part) <= TRIED else rng.choice(part, TRIED)
        for vantage in rng.choice(part, 8):
            d = np.bitwise_count(some ^ vantage)
            for cut in np.unique(np.quantile(d, [0.2, 0.35, 0.5, 0.65], method="lower")):
                work = np.mean(d <= cut + radius) ** 2 + np.mean(d > cut) ** 2
                best = min(best, (float(work), int(vantage), int(cut)))
        if best[0] == 0.9:
            return next(leaves)
        _, vantage, cut = best
        d = np.bitwise_count(part ^ np.uint64(vantage))
        return Node(vantage, cut, node(part[d <= cut + radius]), node(part[d > cut]))

    return node(sample)


def route(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``points`` and the leaves that they are dealt to, a point with copies more than once."""
    rows, leaves, open_ = [], [], [(tree, np.arange(len(points)))]
    while open_:
        at, held = open_.pop()
        if isinstance(at, int):
            rows.append(held)
            leaves.append(np.full(len(held), at))
            continue
        d = np.bitwise_count(points[held] ^ np.uint64(at.vantage))
        open_ += [(at.near, held[d <= at.cut + radius]), (at.far, held[d > at.cut])]
    return np.concatenate(rows), np.concatenate(leaves)


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` points is joined to by ``pairs``."""
    up = np.arange(n)

    def flat() -> None:
        while not np.array_equal(over := up[up], up):
            up[:] = over

    for a, b in pairs:
        while True:
            flat()
            ra, rb = up[a], up[b]
            if not (differ := ra != rb).any():
                break
            np.minimum.at(up, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
    flat()
    return up


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``a`` and ``b`` (fp and fp2): within ``radius`` by fp and ``total`` by both."""
    step = max(1, SLAB // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        first = at if same else 0
        d = np.bitwise_count(rows[:, :1] ^ b[first:, 0])
        near = np.flatnonzero(d <= radius)
        if len(near):
            i, j = np.divmod(near, len(b) - first)
            j += first
            ok = d.ravel()[near] + np.bitwise_count(rows[i, 1] ^ b[j, 1]) <= total
            ok &= (i + at < j) if same else True
            if ok.any():
                yield i[ok] + at, j[ok]


def trees_over(points: DataFrame, n: int, radius: int, classes: int = 1) -> tuple[list, int]:
    """Masks with a tree each for ``n`` points (fp first), of which only those of one of ``classes`` are compared, and the radius under a mask."""
    of_class = -(-n // classes)
    most = min(MOST, max(SAMPLE, of_class // SHARE))
    taken = points.filter(F.pmod(F.xxhash64(*points.columns, F.lit(7)), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    # of two halves one differs in half of the radius at most
    masks, within = (HALVES, radius // 2) if of_class > LEAF else ((HALVES[0] | HALVES[1],), radius)
    return [(np.uint64(m), grow(taken & np.uint64(m), of_class, within)) for m in masks], within


def links(points: DataFrame, radius: int, total: int, ratio: float | None, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): links between nodes of ``points`` (node, fp, fp2, lo, hi), a spanning star a group and task.

    With ``ratio`` only texts whose numbers of shingles are at least so alike need be found: points are dealt over
    classes a ratio wide, and each also visits the class above its own.
    """
    scratch = scratch or Scratch(points.sparkSession)
    trees, within = trees_over(points.select("fp", "fp2"), points.count(), radius)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (mask, tree) in enumerate(trees):
                rows, leaves = route(tree, fp & mask, within)
                out = batch.select(["node", "fp", "fp2", "lo", "hi"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaves * len(trees) + k, pa.int64())], ["node", "fp", "fp2", "lo", "hi", "leaf"])

    kind = "node string, fp bigint, fp2 bigint, lo bigint, hi bigint, leaf bigint"
    if ratio:
        size = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / F.lit(float(np.log(1 / ratio)))).cast("int")
        band = F.explode(F.sequence(size("lo"), size("hi") + 1))
    else:
        band = F.lit(0)
    shards = scratch.written(points.select("node", "fp", "fp2", "lo", "hi").mapInArrow(dealt, kind).select("node", "fp", "fp2", "leaf", band.alias("band")), "simhash-shards")
    blocks = shards.groupBy("leaf", "band").count().filter("count > 1").select("leaf", "band", F.ceil(F.col("count") / LEAF).cast("int").alias("_g"))
    own = F.pmod(F.xxhash64("fp", "fp2", F.lit(11)), F.col("_g")).cast("int")
    tasks = (
        shards.join(blocks, ["leaf", "band"]).select("node", "fp", "fp2", "leaf", "band", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other"))
        .select("node", "fp", "fp2", "leaf", "band", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    )

    def compared(group: pa.Table) -> pa.Table:
        node = group.column("node").to_pylist()
        points_ = np.stack([group.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")], 1)
        mine, i, j = (group.column(c).to_numpy() for c in ("_own", "_i", "_j"))
        if i[0] == j[0]:
            pairs = close_pairs(points_, points_, True, radius, total)
        else:
            x, y = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
            pairs = ((x[a], y[b]) for a, b in close_pairs(points_[x], points_[y], False, radius, total))
        root = roots_of(len(node), pairs)
        linked = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array([node[k] for k in linked], pa.string()), "b": pa.array([node[k] for k in root[linked]], pa.string())})

    # one key of all four: rows joined by leaf and band lie together, and grouping by four columns would leave them so
    tasks = tasks.withColumn("_task", F.concat_ws(":", "leaf", "band", "_i", "_j"))
    return tasks.groupBy("_task").applyInArrow(compared, "a string, b string").filter("a <> b")


def class_links(points: DataFrame, classes: int, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between the fingerprints of one class of ``points`` (fp, class from 0; distinct), a spanning star a group and task.

    All classes go through the same trees and part at the leaves.
    """
    trees, within = trees_over(points.select("fp", "class"), points.count(), radius, classes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, of = batch.column("fp").to_numpy(), batch.column("class").to_numpy()
            for k, (mask, tree) in enumerate(trees):
                rows, leaves = route(tree, fp.view(np.uint64) & mask, within)
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array((leaves * len(trees) + k) * classes + of[rows], pa.int64())], ["fp", "leaf"])

    shards = scratch.written(points.select("fp", F.col("class").cast("long").alias("class")).mapInArrow(dealt, "fp bigint, leaf bigint"), "simhash-shards")
    blocks = shards.groupBy("leaf").count().filter("count > 1").select("leaf", F.ceil(F.col("count") / LEAF).cast("int").alias("_g"))
    own = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("_g")).cast("int")
    tasks = shards.join(blocks, "leaf").select("fp", "leaf", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other"))
    # 0 where a block meets itself, else the side of the point
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).cast("byte")
    tasks = tasks.select("fp", side.alias("_side"), F.concat_ws(":", "leaf", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_task"))

    def compared(group: pa.Table) -> pa.Table:
        fp, side = group.column("fp").to_numpy(), group.column("_side").to_numpy()
        prints = np.stack([fp.view(np.uint64), np.zeros(len(fp), np.uint64)], 1)
        if not side[0]:
            pairs = close_pairs(prints, prints, True, radius, radius)
        else:
            x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            pairs = ((x[a], y[b]) for a, b in close_pairs(prints[x], prints[y], False, radius, radius))
        root = roots_of(len(fp), pairs)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[linked]), "b": pa.array(fp[root[linked]])})

    return tasks.groupBy("_task").applyInArrow(compared, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) but the roots, with the smallest node that it reaches."""
    if scratch is None:
        scratch = Scratch(edges.sparkSession)  # whose tables stay
    stars = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "simhash-links")
    while True:
        tangled = stars.groupBy("u").count().filter("count > 1").select("u").unionByName(stars.join(stars.select(F.col("v").alias("_v")), F.col("u") == F.col("_v"), "left_semi").select("u"))
        if tangled.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = scratch.written(large, "simhash-large")
        low = large.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m")
        small = large.join(low, F.col("u") == F.col("_u")).filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        stars = scratch.written(small.unionByName(low.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, total: int | None = None, ratio: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, fingerprint (hex), component_id (the smallest id reachable by links).

    Fingerprints link at ``radius`` or fewer differing bits. With ``total`` a second fingerprint of the same
    shingles has to agree too: both may differ in so many bits together, and the hex has 32 digits. ``ratio``:
    see links(). Null text counts as empty, and texts without a word link to each other by their
    fingerprint zero. A null id is nobody's component_id unless the whole component has none. Repeated rows
    are all returned. Empty input: no rows. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.written(fingerprints(docs, words, total is not None, id_col, text_col), "simhash-fingerprints", keep=True)
        digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
        node = digits("fp") if total is None else F.concat(digits("fp"), digits("fp2"))
        marks = marks.withColumn("node", node)
        points = scratch.written(marks.groupBy("fp", "fp2").agg(F.min("_id").alias("_first"), F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("node", node), "simhash-points")
        roots = components(links(points, radius, radius if total is None else total, ratio, scratch), scratch)
        rooted = points.select("node", "_first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
        named = scratch.written(rooted.select("node", "root").join(smallest, "root").select("node", "component_id"), "simhash-components", keep=True)
    return marks.select("_id", "node").join(named, "node").select(F.col("_id").alias(id_col), F.col("node").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is their component's, with all their columns."""
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_cg_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_cg_gone"), "left_anti")
