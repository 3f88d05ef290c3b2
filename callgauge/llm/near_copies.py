"""Near copies: SimHash fingerprints within a radius propose pairs of texts, the exact Jaccard similarity of their shingles decides.

Texts of equal shingles are one point. Fingerprints of whole texts that are just alike enough differ in 10 of 64 bits on
average, a radius at which no vantage point prunes; so a point has BANDS short fingerprints besides that of its whole text, each the
SimHash of DRAWN of its shingles, drawn by min-wise hashing: two texts of similarity s draw the same ones with probability
s ** DRAWN. All fingerprints go through the vantage-point trees of operator 2, band by band, and those that are joined by
RADIUS or fewer differing bits, itself included, are one. Points that share such a one are joined, by the smallest of them, to groups: a
star a fingerprint and never its pairs. Inside a group the pairs that are near by bits of their whole texts are checked by
their shingles, and only those that pass become links. Groups too large for a block are first compared with a
few leaders, a pass over their members; those that are not joined to the largest part by then are
compared with all members, block by block. A pair that is joined already is not checked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import Scratch, small, text_of
from callgauge.llm.simhash import class_links, components, majority, remixed, roots_of, shingle_hashes

#: At similarity 0.8 a pair shares no fingerprint with probability (1 - 0.8 ** 5) ** 20 = 3.6e-4, at 0.85 8e-6, at 0.9 1.8e-8.
BANDS, DRAWN = 20, 5
RADIUS = 3  #: differing bits of 64 up to which two fingerprints of a band propose their texts
#: Differing bits of 256 up to which a pair is checked. At similarity 0.8 some 39 differ, of texts of five shingles 48; the deviation is 6.
TOTAL = 72
PRINTS = 4
MEMBERS, SHINGLES = 2048, 1 << 20  #: texts and shingles of a block of a group that is checked
LEADERS = 4
DRAWS = np.random.default_rng(43).integers(1, 1 << 63, (BANDS * DRAWN, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MARKS = np.random.default_rng(47).integers(0, 1 << 64, BANDS, dtype=np.uint64)


def drawn(hashes: np.ndarray) -> np.ndarray:
    """Of ``hashes`` the one that is least by each of the draws' own orders (a multiplication by an odd number, mixed before)."""
    mixed = remixed(hashes)
    best, at = np.full(len(DRAWS), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(DRAWS), np.int64)
    for first in range(0, len(mixed), 1024):
        order = DRAWS * mixed[first : first + 1024]
        here = order.argmin(1)
        least = order[np.arange(len(DRAWS)), here]
        less = least < best
        best[less], at[less] = least[less], here[less] + first
    return hashes[at]


def short_prints(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of the bands of sorted distinct hashes: of each bit what most of the drawn have."""
    some = drawn(hashes).astype(">u8").view(np.uint8).reshape(BANDS, DRAWN, 8)
    held = np.unpackbits(some, axis=2).sum(1, dtype=np.int64) * 2 > DRAWN
    return np.packbits(held, axis=1).view(">u8").ravel().astype(np.uint64) ^ BAND_MARKS


def long_print(hashes: np.ndarray) -> np.ndarray:
    out = []
    for _ in range(PRINTS):
        out.append(majority(hashes))
        hashes = remixed(hashes)
    return np.array(out, np.uint64)


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def marked(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _s (SHA-256 of the text), node (hash of the shingles), n (distinct shingles), keys (short fingerprints, and that of the whole text; none of a text without a word)."""
    from xxhash import xxh3_128_digest

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_s", sha(F.col("_t"))).select("_id", "_s", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in batch.column(2):
                h = np.unique(shingle_hashes(text.as_py(), words))
                nodes.append(xxh3_128_digest(h.tobytes()))
                counts.append(len(h))
                keys.append(np.append(short_prints(h), np.uint64(majority(h))).view(np.int64) if len(h) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), listed], ["_id", "_s", "node", "n", "keys"])

    fields = [("_id", rows.schema["_id"].dataType), ("_s", T.BinaryType()), ("node", T.BinaryType()), ("n", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def candidates(marks: DataFrame, ratio: float, scratch: Scratch) -> DataFrame:
    """(a, b): of each group of fingerprints that the vantage-point trees join the star of the points that have one of it."""
    # of fewer shingles only equal ones are so alike, and those are one point
    keyed = marks.filter(F.col("n") >= ratio / (1 - ratio) - 1e-6).select("node", F.posexplode("keys").alias("class", "fp"))
    prints = keyed.groupBy("class", "fp").agg(F.min("node").alias("_least"), (F.min("node") != F.max("node")).alias("_more"))
    prints = scratch.written(prints, "near-prints")
    near = components(class_links(prints, BANDS + 1, RADIUS, scratch), scratch)
    near = scratch.written(near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "_fp"), "near-joined")
    rooted = prints.join(small(near), F.col("fp") == F.col("_fp"), "left").filter("_more OR root IS NOT NULL")
    rooted = scratch.written(rooted.select(F.col("fp").alias("_key"), F.coalesce("root", "fp").alias("root"), "_least"), "near-rooted")
    first = rooted.groupBy("root").agg(F.min("_least").alias("_first"))
    shared = scratch.written(rooted.select("_key", "root").join(first, "root").select("_key", "_first").distinct(), "near-shared")
    return keyed.join(small(shared), F.col("fp") == F.col("_key")).filter("node <> _first").select(F.col("node").alias("a"), F.col("_first").alias("b")).distinct()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sorted distinct shingles have this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    both = int((b[np.searchsorted(b, a).clip(max=len(b) - 1)] == a).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def close_pairs(bits: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray | None, ratio: float, slab: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``a`` and ``b`` (rows of ``bits``; without ``b`` pairs of ``a``) near by bits and by numbers of shingles."""
    a = a[np.argsort(n[a], kind="stable")]
    same = b is None
    b = a if same else b[np.argsort(n[b], kind="stable")]
    if not len(a) or not len(b):
        return
    na, nb = n[a], n[b]
    step = max(1, slab // len(b))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        low = max(int(np.searchsorted(nb, na[at] * ratio - 1e-9)), at if same else 0)
        high = int(np.searchsorted(nb, na[min(at + step, len(a)) - 1] / ratio + 1e-9, "right"))
        if low >= high:
            continue
        d = np.zeros((len(rows), high - low), np.uint16)
        for k in range(PRINTS):
            d += np.bitwise_count(bits[rows, k : k + 1] ^ bits[b[low:high], k])
        i, j = np.divmod(np.flatnonzero(d <= TOTAL), high - low)
        j += low
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        x, y = rows[i], b[j]
        ok = (np.minimum(n[x], n[y]) >= ratio * np.maximum(n[x], n[y]) - 1e-9) & (x != y)
        if ok.any():
            yield x[ok], y[ok]


def star(node: list[bytes], root: np.ndarray) -> pa.Table:
    linked = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array([node[k] for k in linked], pa.binary()), "b": pa.array([node[k] for k in root[linked]], pa.binary())})


LINKS = "a binary, b binary"


class Joined:
    """Texts of one task: which are joined, and the check of pairs that are not."""

    def __init__(self, texts: pa.ChunkedArray, words: int, similarity: float):
        self.up, self.similarity = np.arange(len(texts)), similarity
        self.shingles = [np.unique(shingle_hashes(t.as_py(), words)) for t in texts]
        self.n = np.fromiter(map(len, self.shingles), np.int64, len(texts))
        self.bits = np.stack([long_print(h) for h in self.shingles]) if len(texts) else np.zeros((0, PRINTS), np.uint64)

    def top(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, i: int, j: int) -> None:
        p, q = self.top(i), self.top(j)
        self.up[max(p, q)] = min(p, q)

    def check(self, a: np.ndarray, b: np.ndarray | None) -> None:
        for x, y in close_pairs(self.bits, self.n, a, b, self.similarity):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if self.top(i) != self.top(j) and alike(self.shingles[i], self.shingles[j], self.similarity):
                    self.join(i, j)

    def star(self, node: list[bytes]) -> pa.Table:
        return star(node, roots_of(len(node), iter([(np.arange(len(node)), self.up)])))


def members_of(docs: DataFrame, marks: DataFrame, groups: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """node, root, n, _t: a text of each point of ``groups`` (node, root). Only texts that stand for a point are joined to it."""
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
    stand = marks.groupBy("node").agg(F.min(F.struct("_id", "_s")).alias("_x"), F.min("n").alias("n")).join(members, "node")
    stand = scratch.written(stand.select("node", "root", "n", F.col("_x._id").alias("_i"), F.col("_x._s").alias("_of")), "near-stand")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_s", sha(F.col("_t")))
    found = texts.join(small(stand, 192), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_s") == F.col("_of")))
    return scratch.written(found.select("node", "root", "n", "_t").dropDuplicates(["node"]), "near-members")


def small_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links within groups of one block; several groups share a task."""
    buckets = max(24, -(-(texts.agg(F.sum("n")).first()[0] or 0) // (SHINGLES // 2)))

    def checked(group: pa.Table) -> pa.Table:
        work = Joined(group.column("_t"), words, similarity)
        of = np.array(group.column("root").to_pylist(), object)
        order = np.argsort(of, kind="stable")
        for held in np.split(order, np.flatnonzero(of[order][1:] != of[order][:-1]) + 1):
            work.check(held, None)
        return work.star(group.column("node").to_pylist())

    return texts.withColumn("_task", F.pmod(F.xxhash64("root", F.lit(13)), F.lit(buckets))).groupBy("_task").applyInArrow(checked, LINKS)


def leader_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between members of large groups and their groups' leaders: a pass over the members."""
    rank = F.struct(F.xxhash64("node", F.lit(29)).alias("h"), "node")
    first = texts.groupBy("root").agg(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node", F.lit(31)), F.col("_g")) == 0, rank))).alias("_some"))
    leaders = first.select(F.col("root").alias("_root"), F.explode(F.slice("_some", 1, LEADERS)).alias("_x")).select("_root", F.col("_x.node").alias("_leader"))
    led = texts.join(leaders, F.col("node") == F.col("_leader")).groupBy("_root").agg(F.collect_list(F.struct("node", "_t")).alias("_leaders"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        for batch in batches:
            a, b = [], []
            for root, node, text, leaders_ in zip(*batch.columns, strict=True):
                root, node = root.as_py(), node.as_py()
                if root not in known:
                    known.clear()
                    known[root] = [(x["node"], np.unique(shingle_hashes(x["_t"], words))) for x in leaders_.as_py()]
                own = np.unique(shingle_hashes(text.as_py(), words))
                for leader, shingles in known[root]:
                    if leader != node and alike(own, shingles, similarity):
                        a.append(node)
                        b.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return texts.join(led, F.col("root") == F.col("_root")).select("root", "node", "_t", "_leaders").mapInArrow(checked, LINKS)


def rest_links(texts: DataFrame, parts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Links of large groups between members outside the group's largest part (``parts``: node, root) and all members."""
    placed = texts.join(parts.select(F.col("node").alias("_node"), F.col("root").alias("_part")), F.col("node") == F.col("_node"), "left").withColumn("_part", F.coalesce("_part", "node")).drop("_node")
    placed = scratch.written(placed, "near-placed")
    largest = placed.groupBy("root", "_part").count().groupBy("root").agg(F.max(F.struct("count", "_part")).alias("_x")).select("root", F.col("_x._part").alias("_main"))
    sized = placed.join(largest, "root").withColumn("_rest", F.col("_part") != F.col("_main"))
    rests = sized.filter("_rest").groupBy("root").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    rests = scratch.written(rests.select("root", F.ceil(F.greatest(F.col("_k") / MEMBERS, F.col("_n") / SHINGLES)).cast("int").alias("_r")), "near-rests")
    held = sized.join(rests, "root").drop("_main")
    block = lambda g: F.pmod(F.xxhash64("node", F.lit(11)), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    left = held.filter("_rest").select("root", "node", "_t", "_part", F.lit(True).alias("_left"), block("_r").alias("_i"), every("_g").alias("_j"))
    right = held.select("root", "node", "_t", "_part", F.lit(False).alias("_left"), block("_g").alias("_j"), every("_r").alias("_i")).select(left.columns)

    def checked(group: pa.Table) -> pa.Table:
        work = Joined(group.column("_t"), words, similarity)
        node, lefts, first = group.column("node").to_pylist(), group.column("_left").to_numpy(zero_copy_only=False), {}
        for k, names in enumerate(zip(node, group.column("_part").to_pylist(), strict=True)):
            for name in names:  # a member may stand on both sides, and members of one part are joined
                work.join(first.setdefault(name, k), k)
        work.check(np.flatnonzero(lefts), np.flatnonzero(~lefts))
        return work.star(node)

    return left.unionByName(right).withColumn("_task", F.concat_ws(":", F.hex("root"), "_i", "_j")).groupBy("_task").applyInArrow(checked, LINKS)


def verified(texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): spanning stars of the pairs of each group of ``texts`` (node, root, n, _t) whose shingles are alike."""
    shares = texts.groupBy("root").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    shares = scratch.written(shares.select("root", F.ceil(F.greatest(F.col("_k") / MEMBERS, F.col("_n") / SHINGLES)).cast("int").alias("_g")).filter("_g > 1"), "near-large")
    if shares.isEmpty():
        return scratch.written(small_links(texts, words, similarity).filter("a <> b"), "near-links")
    within = scratch.written(small_links(texts.join(shares, "root", "left_anti"), words, similarity).filter("a <> b"), "near-links")
    large = texts.join(shares, "root")
    led = scratch.written(leader_links(large, words, similarity).filter("a <> b"), "near-links")
    rest = scratch.written(rest_links(large, components(led, scratch), words, similarity, scratch).filter("a <> b"), "near-links")
    return within.unionByName(led).unionByName(rest)


def near_copies(docs: DataFrame, marks: DataFrame, words: int, similarity: float, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(node, root): points that are joined to another by pairs of at least this similarity, but the roots."""
    groups = components(candidates(marks, similarity, scratch), scratch)
    return components(verified(members_of(docs, marks, groups, id_col, text_col, scratch), words, similarity, scratch), scratch)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each group joined by near copies: that of the smallest id.

    Rows are told apart by id and text: a repeated id goes only with the text that is a near copy. A null id ranks
    behind every id; of rows of one id in a group one stays. Null text counts as empty, and texts without a word are alike.
    Empty input: no rows. A very long text is held by one task with its shingles, some 9 bytes a word.
    """
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.written(marked(docs, words, id_col, text_col), "near-marks")
        roots = near_copies(docs, marks, words, similarity, id_col, text_col, scratch)
        rows = marks.groupBy("_id", "_s", "node").agg(F.count(F.lit(1)).alias("_k")).join(roots, "node", "left")
        rows = rows.select("_id", "_s", "_k", F.coalesce("root", "node").alias("root"), F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_s").alias("s")).alias("_rank"))
        first = rows.groupBy("root").agg(F.min("_rank").alias("_first"))
        gone = rows.join(first, "root").select(F.col("_id").alias("_cg_id"), F.col("_s").alias("_cg_of"), (F.col("_rank") == F.col("_first")).alias("_cg_stays"), "_k")
        gone = scratch.written(gone.filter("NOT _cg_stays OR _k > 1").drop("_k"), "near-gone", keep=True)
    # joined by id; only texts whose id is found are hashed
    same = F.col(id_col).eqNullSafe(F.col("_cg_id")) & F.when(F.col("_cg_of").isNotNull(), F.col("_cg_of") == sha(text_of(text_col)))
    held = docs.join(small(gone), same, "left")
    kept = held.filter("_cg_stays IS NULL").select(*docs.columns)
    if gone.filter("_cg_stays").isEmpty():
        return kept
    return kept.unionByName(held.filter("_cg_stays").dropDuplicates(["_cg_id", "_cg_of"]).select(*docs.columns))
