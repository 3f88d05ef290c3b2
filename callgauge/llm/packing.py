"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

A document longer than a sequence is cut into whole sequences and a rest. Pieces are counted by length; the driver
packs the histogram alone (at most as many rows as a sequence has tokens): longest lengths first, each into the
packs with the least in them that still have room. Equal packs are one run of sequence ids, so a step says which
ranks of a length go to which run at which offset. A piece finds its step by length and rank, where
its rank is the number of pieces of its length in the partitions before its own and before it in its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import text_of, written
from callgauge.llm.tokenizing import ids_of

#: Bytes up to which a table of steps or of ranks is broadcast, and of a row of them at most; beyond it is joined by shuffle.
SMALL, ROW = 10 << 20, 64


def pack_histogram(counts: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, end rank, first sequence, offset) that place every piece of the histogram.

    Packs of one content are a run (used, first sequence, number). A step takes the run with the least used; if its
    room is too small for the length, no run has room and new packs are opened.
    """
    runs: list[tuple[int, int, int]] = []
    steps, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left, grown = 0, counts[length], []
        while left:
            if runs and runs[0][0] + length <= width:
                used, first, many = heapq.heappop(runs)
            else:
                used, first, many = 0, opened, left
                opened += left
            take = min(left, many)
            if take < many:
                heapq.heappush(runs, (used, first + take, many - take))
            steps.append((length, rank, rank + take, first, used))
            grown.append((used + length, first, take))
            rank, left = rank + take, left - take
            if not (runs and runs[0][0] + length <= width) and left:
                for run in grown:  # packs filled in this round may take another of the same length
                    heapq.heappush(runs, run)
                grown = []
        for run in grown:
            heapq.heappush(runs, run)
    return steps


def pieces(docs: DataFrame, tokenizer: str, width: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents in the shared folder: _id, start, length, doc_tokens, part, rank (of its length in the part), ids."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, part, seen = ids_of(tokenizer).packed, TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in batches:
            for some in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                out = []
                for i, text in enumerate(some.column(1)):
                    ids = packed(text.as_py()) + end
                    for at in range(0, len(ids), 4 * width):
                        piece = ids[at : at + 4 * width]
                        n = len(piece) // 4
                        out.append((i, at // 4, n, len(ids) // 4, seen[n], piece))
                        seen[n] += 1
                at, start, length, tokens, rank, piece = zip(*out, strict=True) if out else ((),) * 6
                own = some.column(0).take(pa.array(at, pa.int64()))
                longs = [pa.array(x, pa.int64()) for x in (start, length, tokens)]
                yield pa.RecordBatch.from_arrays([own, *longs, pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64()), pa.array(piece, pa.binary())], ["_id", "start", "length", "doc_tokens", "part", "rank", "ids"])

    kind = T.StructType([T.StructField("_id", rows.schema["_id"].dataType)])
    for name, t in (("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType()), ("ids", T.BinaryType())):
        kind = kind.add(name, t)
    return written(rows.mapInArrow(run, kind), "pieces")


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers).

    A null text is empty: with ``end_id`` it is a piece of that id alone, without it has no piece. Null ids and
    repeated rows are packed like any row; an empty table gives no rows; other columns are ignored. Sequence ids
    run from 0; within a sequence offsets leave no gap.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, width, end_id, id_col, text_col)
    per_part = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``width`` rows
    steps = pack_histogram(counts, width)
    placed = spark.createDataFrame(steps or [(0, 0, 0, 0, 0)], "_length bigint, _from bigint, _to bigint, _first bigint, offset bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select(F.col("length").alias("_l"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    if per_part.count() * ROW <= SMALL:
        ranks = F.broadcast(ranks)
    if len(steps) * ROW <= SMALL:
        placed = F.broadcast(placed)
    ranked = cut.join(ranks, (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p"))).withColumn("_rank", F.col("rank") + F.col("_before"))
    found = ranked.join(placed, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.select(F.col("_id").alias(id_col), "start", "length", "doc_tokens", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset", "ids")
