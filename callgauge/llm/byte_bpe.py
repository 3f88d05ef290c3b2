"""Byte-level BPE: overlapping chunks are pre-tokenised apart and stitched where their boundaries meet again.

The pattern looks only forward, so two scans of a text that both start a match at some place agree from there on. A
text within one chunk is encoded where it is. Of a longer text each chunk becomes a row; rows are dealt
over the cluster, pre-tokenised there, and every pre-token of it that the chunk's end can't change is encoded. A
document's rows then meet; a scan is followed up to the first boundary in the overlap that it shares with the next
one. Where none is shared (a run longer than an overlap), the gap is scanned anew from the last sure boundary.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import copies, text_of
from callgauge.llm.tokenizing import unsure

CHUNK = 32_768  #: characters
OVERLAP = 1_024  #: characters a chunk reads beyond its own
PIECES = 100_000  #: pre-tokens remembered by a worker


class Codec:
    """Encoding and decoding by a file of ranks. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find, self.scan = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.bytes_of = {n: t for t, n in ranks.items()}
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = array("I", self.core.encode_single_piece(piece.encode())).tobytes()
            if len(self.known) < PIECES and len(piece) <= 64:
                self.known[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        if unsure(text):  # the library's own pattern engine decides
            return array("I", self.core.encode_ordinary(text)).tobytes()
        known, piece = self.known, self.piece
        return b"".join([known.get(p) or piece(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def sure(codec_: Codec, chunk: str, last: bool) -> tuple[list[int], list[bytes]]:
    """Starts (and the end) of the matches that more text could not change, and their ids.

    A match depends on the character behind it and, where white space ends before its last, one more.
    """
    starts, ids = [], []
    end = 0
    for m in codec_.scan(chunk):
        if not last and m.end() + 1 >= len(chunk):
            break
        starts.append(m.start())
        ids.append(codec_.piece(m.group()))
        end = m.end()
    return [*starts, end], ids


def stitch(codec_: Codec, text: str, scans: list[tuple[list[int], list[bytes]]], chunk: int) -> bytes:
    """The ids of ``text`` from the scans of its chunks; scan k starts at character k * chunk."""
    out: list[bytes] = []
    at = 0  # a sure boundary, up to which ids are out
    for k, (starts, ids) in enumerate(scans):
        base = k * chunk
        starts = [base + s for s in starts]
        if not ids or starts[-1] <= at:
            continue
        if at not in (held := set(starts)):  # scan on from the sure boundary until this chunk agrees
            ahead = False
            for m in codec_.scan(text, at):
                if m.start() in held:
                    ahead = True
                    break
                out.append(codec_.piece(m.group()))
                at = m.end()
                if at >= starts[-1]:
                    ahead = at in held
                    break
            if not ahead or at >= starts[-1]:
                continue
        first = starts.index(at)
        limit = base + chunk
        following = set()
        if k + 1 < len(scans):
            following = {base + chunk + s for s in scans[k + 1][0]}
        for s, i, e in zip(starts[first:], ids[first:], starts[first + 1 :], strict=False):
            if s >= limit and s in following:
                break
            out.append(i)
            at = e
    for m in codec_.scan(text, at):
        out.append(codec_.piece(m.group()))
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, n_tokens, ids (binary).

    As the tiktoken library would encode without special tokens. Null text: empty, no ids. Null ids and
    repeated rows are rows like any other; empty table: no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    kind = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ids = [use.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], kind.names)

    length = F.char_length("_t")
    here = rows.filter(length <= chunk).mapInArrow(short, kind)
    # rows that repeat are one document here and come out as often as they came in
    long = rows.filter(length > chunk).groupBy("_id", F.sha2("_t", 256).alias("_h")).agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("_c")).withColumn("_n", F.ceil(length / chunk).cast("int"))
    cut = long.select("_id", "_h", "_c", "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.substring("_t", (k * chunk + 1).cast("int"), F.lit(chunk + overlap)))).alias("_k", "_c_"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            starts, lengths, ids = [], [], []
            for k, n, c in zip(*(batch.column(x).to_pylist() for x in ("_k", "_n", "_c_")), strict=True):
                s, i = sure(use, c, k + 1 == n)
                starts.append(np.array(s, "<i4").tobytes())
                lengths.append(np.array([len(x) for x in i], "<i4").tobytes())
                ids.append(b"".join(i))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.binary()) for x in (starts, lengths, ids))], [*batch.schema.names, "_s", "_l", "_i"])

    spread = cut.repartition("_h", "_k")
    wide = T.StructType([*spread.schema.fields, *[T.StructField(c, T.BinaryType()) for c in ("_s", "_l", "_i")]])

    def joined(group: pa.Table) -> pa.Table:
        use = codec(path, pattern)
        scans, text = [], []
        for _, c, s, n, i in sorted(zip(*(group.column(x).to_pylist() for x in ("_k", "_c_", "_s", "_l", "_i")), strict=True)):
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(n, "<i4"))]).tolist()
            scans.append((np.frombuffer(s, "<i4").tolist(), [i[b:e] for b, e in zip(ends, ends[1:], strict=False)]))
            text.append(c[:chunk])
        full = "".join(text)
        ids = use.encode(full) if unsure(full) else stitch(use, full, scans, chunk)
        return pa.table([group.column("_id").slice(0, 1), group.column("_c").slice(0, 1), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], names=["_id", "_c", "n_tokens", "ids"])

    once = T.StructType([kind["_id"], T.StructField("_c", T.LongType()), kind["n_tokens"], kind["ids"]])
    stitched = copies(spread.mapInArrow(scanned, wide).groupBy("_id", "_h").applyInArrow(joined, once), "_c").select(*kind.names)
    return here.unionByName(stitched).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with decoded (binary): the raw bytes of its ids, one after another."""
    kind = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([use.decode(i.as_py()) for i in part.column(at)], pa.binary())], kind.names)

    return encoded.mapInArrow(run, kind)
