"""Context-triggered piecewise hashing of whole texts.

A rolling hash of the last seven bytes ends a chunk where it is -1 modulo the block size; each chunk gives one
character of a signature. The block size suits the length, and a second signature is made at twice the size, so that
fingerprints of neighbouring block sizes compare. Likeness is the edit distance of signatures (a substitution
counts as a deletion and an insertion) over their lengths, by a bit-parallel longest common subsequence of
many pairs at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import text_of, written

WINDOW, LEAST, LENGTH = 7, 3, 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODE = {c: i for i, c in enumerate(LETTERS)}


def _tables() -> np.ndarray:
    """For each place in the window, what a byte there adds."""
    own = np.random.default_rng(2006).integers(1, 1 << 32, 256, dtype=np.uint64)
    return np.stack([own * np.uint64(pow(0x01000193, k, 1 << 32)) & np.uint64(0xFFFFFFFF) for k in range(WINDOW)]).astype(np.uint32)


TABLES = _tables()


def rolling(data: np.ndarray) -> np.ndarray:
    out = TABLES[0][data]
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += TABLES[k][data[:-k]]
    return out ^ (out >> np.uint32(15))


def signature(data: bytes, ends: np.ndarray) -> str:
    """A letter a chunk; chunks beyond the length of a signature are one."""
    cuts = [0, *(ends[: LENGTH - 1] + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join([LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False)])


def fingerprint(text: str) -> str:
    """block size:signature:signature at twice the size. An empty text: 3::"""
    data = text.encode()
    size = LEAST
    while size * LENGTH < len(data):
        size *= 2
    hashes = rolling(np.frombuffer(data, np.uint8))
    while True:
        ends = np.flatnonzero(hashes % np.uint32(size) == size - 1)
        if size == LEAST or len(ends) + 1 >= LENGTH // 2:
            break
        size //= 2
    twice = ends[hashes[ends] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{signature(data, ends)}:{signature(data, twice)}"


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of signatures."""
    n = len(a)
    rows = np.arange(n)
    places = np.zeros((n, 65), np.uint64)
    coded = [np.full((n, LENGTH), 64) for _ in range(2)]
    for held, texts in zip(coded, (a, b), strict=True):
        for i, s in enumerate(texts):
            held[i, : len(s)] = [CODE[c] for c in s]
    for j in range(LENGTH):
        places[rows, coded[0][:, j]] |= np.uint64(1 << j)
    places[:, 64] = 0
    v = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(LENGTH):
        u = v & places[rows, coded[1][:, j]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def share_run(a: str, b: str) -> bool:
    """A common run of seven letters, of signatures under 14 of half the shorter one: chance alone rarely gives it."""
    k = min(WINDOW, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in runs for i in range(len(b) - k + 1))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints; equal ones 1, of incompatible block sizes 0."""
    out, at, left, right = [0.0] * len(pairs), [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (m, x1, x2), (n, y1, y2) = x.split(":"), y.split(":")
        m, n = int(m), int(n)
        for s, t in ((x1, y1), (x2, y2)) if m == n else ((x1, y2),) if m == 2 * n else ((x2, y1),) if n == 2 * m else ():
            if s and t and share_run(s, t):
                at.append(i)
                left.append(s)
                right.append(t)
    if at:
        for i, s, t, c in zip(at, left, right, common(left, right).tolist(), strict=True):
            out[i] = max(out[i], 2 * c / (len(s) + len(t)))
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _results(rows: list[tuple]) -> list[list]:
    """Columns n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of (text, its fingerprint, next text, its fingerprint)."""
    changed = [edited(t, n) for t, _, n, _ in rows]
    prints = [fingerprint(e) for e in changed]
    return [
        [len(t) for t, *_ in rows], [hashlib.sha256(e.encode()).hexdigest() for e in changed], [f for _, f, *_ in rows], prints,
        likeness([(r[1], p) for r, p in zip(rows, prints, strict=True)]), likeness([(r[1], r[3]) for r in rows]),
    ]


KINDS = (("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64()))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row by ascending id (equal ids by a hash of the text; null ids first) follows, the first one the last.
    Rows are sorted by range partitions; a partition's last row, whose next one is elsewhere, waits with
    its text in the table that the pass writes, a row a partition, for the first row of the next partition
    that has any. Null text: empty. A single row is its own next one. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    fields = [rows.schema["_id"], *[T.StructField(n, t) for n, t, _ in KINDS], T.StructField("part", T.IntegerType()), T.StructField("first_text", T.StringType()), T.StructField("last_text", T.StringType())]
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, first, id_type = TaskContext.get().partitionId(), None, None, pa.int64()

        def made(ids: list, ready: list[tuple], first_text: str | None, last: tuple | None = None) -> pa.RecordBatch:
            columns = _results(ready)
            firsts: list = [None] * len(ready)
            lasts: list = [None] * len(ready)
            if first_text is not None and ready:
                firsts[0], first_text = first_text, None
            if last:
                ids, firsts, lasts = [*ids, last[0]], [*firsts, first_text], [*lasts, last[1]]
                columns = [[*c, x] for c, x in zip(columns, (len(last[1]), None, last[2], None, None, None), strict=True)]
            arrays = [pa.array(ids, id_type), *(pa.array(c, t) for c, (_, _, t) in zip(columns, KINDS, strict=True)), pa.array([part] * len(ids), pa.int32()), pa.array(firsts, pa.string()), pa.array(lasts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, kind.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for some in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ids, ready = [], []
                for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    here = (i, t, fingerprint(t))
                    if waiting:
                        ids.append(waiting[0])
                        ready.append((*waiting[1:], t, here[2]))
                    else:
                        first = t
                    waiting = here
                if ready:
                    yield made(ids, ready, first)
                    first = None
        if waiting:
            yield made([], [], first, waiting)

    # a repeated id is split by its texts, and equal rows, whose order is nobody's matter, by where they stand
    keys = ["_id", "_h", "_nth"]
    rows = rows.select("_id", "_t", F.xxhash64("_t").alias("_h"), F.monotonically_increasing_id().alias("_nth"))
    found = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_t").mapInArrow(run, kind), "ctph")
    # what follows has a row a partition
    heads = found.filter("first_text IS NOT NULL").select(F.col("part").alias("_p"), F.col("first_text").alias("_next"), F.col("fingerprint").alias("_next_print"))
    by_part = Window.orderBy("_p")
    before = F.coalesce(F.lag("_p").over(by_part), F.max("_p").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("_p").withColumn("_before", before).join(heads, "_p").drop("_p")
    pairs = found.filter("last_text IS NOT NULL").select("_id", F.col("last_text").alias("_t"), F.col("fingerprint").alias("_f"), "part").join(heads, F.col("part") == F.col("_before")).select("_id", "_t", "_f", "_next", "_next_print")
    done = T.StructType(kind.fields[: 1 + len(KINDS)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _results(list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(columns, KINDS, strict=True))], done.names)

    whole = found.filter("last_text IS NULL").select(*done.names)
    return whole.unionByName(pairs.mapInArrow(settle, done)).withColumnRenamed("_id", id_col)
