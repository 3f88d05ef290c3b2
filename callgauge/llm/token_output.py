"""Token ids as canonical, length-limited Huffman code in independent blocks.

One pass tokenises and keeps the ids as a table. Counts of all ids (a row an id) make the code. Range partitions by document
id (and a hash, and a row number, so that a repeated id is split) then join documents to blocks, which are coded there,
a document on a byte boundary, with the bit offset of every 256th id. Files are Parquet rows, a row a block, so that Spark's committer and any Hadoop
file system hold them; a block's bytes and the code book are all that its decoding needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import shared_dir, text_of, written
from callgauge.llm.tokenizing import ids_of, largest_id

LONGEST = 20  #: bits of a code at most, more where the ids in use need it (up to 24: a 32-bit window has to hold it behind 7 bits)
STRIDE = 256  #: ids between checkpoints
BLOCK = 1 << 17  #: ids at which a block ends; documents are whole
PART = 1 << 20  #: ids of a longer document that are coded at a time, each part on a byte boundary (a multiple of STRIDE)
MAGIC = 0x31424743


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    base = counts[order].astype(np.int64)
    weights, levels = base, []
    for _ in range(longest - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([base, pairs])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(base))
        weights = merged[at]
    lengths = np.zeros(len(base), np.int64)
    take = 2 * len(base) - 2
    for own in reversed(levels):  # of the items taken, singles lengthen their symbols and packages open
        singles = int(own[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code = (code + 1) << int(lengths[s] - before) if before else 0
            before, codes[s] = int(lengths[s]), code
    return codes


def pack(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded bytes of documents ``ids[bounds[d]:bounds[d + 1]]``, the byte that each starts at (and the end), and the bit of each id."""
    bits = lengths[ids]
    upto = np.concatenate([[0], np.cumsum(bits)])
    doc_bits = upto[bounds[1:]] - upto[bounds[:-1]]
    starts = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
    at = upto[:-1] + np.repeat(starts[:-1] * 8 - upto[bounds[:-1]], np.diff(bounds))
    word, shift = at >> 5, at & 31
    value = codes[ids] << (64 - bits - shift).astype(np.uint64)
    size = int(starts[-1] // 4 + 3)
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return out.astype(np.uint32).astype(">u4").view(np.uint8)[: starts[-1]], starts, at


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of the longest code's bits: symbol * 32 + length."""
    longest = int(lengths.max(initial=1))
    table = np.zeros(1 << longest, np.int32 if len(lengths) < 1 << 26 else np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    runs = 1 << (longest - lengths[order])
    filled = np.repeat(order * 32 + lengths[order], runs)
    table[: len(filled)] = filled
    return table, longest


def unpack(data: bytes, offsets: np.ndarray, sizes: np.ndarray, table: np.ndarray, longest: int) -> np.ndarray:
    """Ids of the lanes that start at bit ``offsets`` and hold ``sizes`` ids, one lane after another."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    out = np.empty(int(sizes.sum()), np.uint32)
    into = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, into, left = offsets[order].astype(np.int64), into[order], sizes[order]
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, "left"))  # lanes with more than ``step`` ids come first
        at, into = at[:live], into[:live]
        got = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - longest)]
        out[into + step] = got >> 5
        at = at + (got & 31)
    return out


def lanes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the number of ids of each lane of documents with these numbers of ids."""
    per = (tokens + STRIDE - 1) // STRIDE
    doc = np.repeat(np.arange(len(tokens)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return doc, np.minimum(STRIDE, tokens[doc] - nth * STRIDE)


def coded_block(ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code of documents with these numbers of ids, and the bit offset of each lane; documents are coded some PART ids at a time."""
    data, offsets, done = [], [], 0
    ends = np.cumsum(tokens)
    cuts = np.unique(np.concatenate([[0], ends, *(np.arange(e - n, e, PART) for e, n in zip(ends, tokens, strict=True) if n > PART)]))
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + PART, "right")) - 1)
        bounds = cuts[first : last + 1] - cuts[first]
        code, _, at = pack(ids[cuts[first] : cuts[last]], bounds, lengths, codes)
        offsets += [at[b:e:STRIDE] + 8 * done for b, e in zip(bounds, bounds[1:], strict=False)]
        data.append(code.tobytes())
        done += len(code)
        first = last
    return b"".join(data), np.concatenate([np.zeros(0, np.int64), *offsets])


def width(tokenizer: str, end_id: int | None) -> int:
    """Bytes that every id fits in."""
    return 2 if max(largest_id(tokenizer), end_id or 0) < 1 << 16 else 4


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """_id, ids (little-endian unsigned integers of ``width(...)`` bytes), nth (of the row in its task), in the shared folder.

    Beside them a row a task with counted: its ids and their numbers.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    end, size = b"" if end_id is None else int(end_id).to_bytes(4, "little"), width(tokenizer, end_id)
    kind = T.StructType([T.StructField("_id", rows.schema["_id"].dataType)]).add("ids", T.BinaryType()).add("nth", T.LongType()).add("counted", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, held, id_type, nth = ids_of(tokenizer).packed, np.zeros(0, np.int64), pa.int64(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ids = [packed(t.as_py()) + end for t in part.column(1)]
                flat = np.frombuffer(b"".join(ids), "<u4")
                more = np.bincount(flat)
                if len(more) > len(held):
                    held, more = more.astype(np.int64), held
                held[: len(more)] += more
                ends = np.cumsum(np.fromiter((len(x) * size // 4 for x in ids), np.int64, len(ids))).tolist()
                raw = flat.astype(f"<u{size}").tobytes()
                ids = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(range(nth, nth + len(ids)), pa.int64()), pa.nulls(len(ids), pa.binary())], kind.names)
                nth += len(ids)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([np.stack([used, held[used]]).astype("<i8").tobytes()], pa.binary())], kind.names)

    return written(rows.mapInArrow(run, kind), "token-ids")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents: a row an id and task before the sum, a row an id after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                used, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    return tokens.filter("counted IS NOT NULL").select("counted").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("count"))


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts and write blocks below ``path`` (default: the shared folder), documents by ascending id; returns ``path``.

    ``tokenizer``: a file of the tokenizers library; no special tokens are added, and one's string in a text is
    ordinary text. ``end_id`` follows each document. A null text is empty, a null id sorts first,
    repeated rows are all written, an empty table gives no blocks; other columns are ignored. The
    folder holds ``codes`` (id, length) and ``blocks``: part and seq (order), start (ids before it in its
    part), doc_ids, tokens (ids a document) and block. A block is a header of unsigned 64-bit little-endian
    integers (magic, documents, lanes, bytes of code), the number of ids of each document, the bit offset of every
    lane (STRIDE ids of one document, the last one fewer), and the code.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-files")
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    counted = id_counts(tokens).toPandas()  # a row an id of the vocabulary
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    lengths = code_lengths(counts, max(LONGEST, int(np.count_nonzero(counts) - 1).bit_length()))
    codes = canonical(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id bigint, length int").coalesce(1).write.parquet(f"{path}/codes")
    size = width(tokenizer, end_id)
    # coded behind the shuffle, so that sampling for its ranges reads the table and codes nothing; nth splits rows that repeat
    keys = ["_id", F.xxhash64("ids"), "nth"]
    ordered = tokens.filter("counted IS NULL").select("_id", "ids", "nth").repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "ids")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names, held, count = [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.fromiter((len(x) // size for x in held), np.int64, len(held))
            data, offsets = coded_block(np.frombuffer(b"".join(held), f"<u{size}"), tokens, lengths, codes)
            head = np.array([MAGIC, len(tokens), len(offsets), len(data)], "<u8").tobytes()
            whole = b"".join([head, tokens.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), data])
            of = lambda x, t: pa.array([x], t)
            return pa.RecordBatch.from_arrays([of(part, pa.int32()), of(seq, pa.int64()), of(start, pa.int64()), of(count, pa.int64()), of(names, pa.list_(id_type)), of(whole, pa.binary())], ["part", "seq", "start", "tokens", "doc_ids", "block"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(ids.as_py())
                count += len(held[-1]) // size
                if count >= BLOCK:
                    yield block()
                    seq, start, count, names, held = seq + 1, start + count, 0, [], []
        if held:
            yield block()

    out = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("seq", "start", "tokens")], T.StructField("doc_ids", T.ArrayType(tokens.schema["_id"].dataType)), T.StructField("block", T.BinaryType())])
    ordered.mapInArrow(blocked, out).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document of write_tokens(): id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    book = spark.read.schema("id bigint, length int").parquet(f"{path}/codes").toPandas()  # a row an id of the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.int64)
    table, longest = decode_table(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a range partition of the writer: bounded by its shuffle partitions
    placed = blocks.join(F.broadcast(parts.select("part", before.alias("_before"))), "part").select((F.col("start") + F.col("_before")).alias("start"), "doc_ids", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, block in zip(*(c for c in batch.columns), strict=True):
                data = block.as_py()
                magic, docs, n_lanes, size = (int(x) for x in np.frombuffer(data, "<u8", 4))
                if magic != MAGIC or len(data) != 32 + 8 * (docs + n_lanes) + size:
                    raise ValueError("not a whole block")
                tokens = np.frombuffer(data, "<u8", docs, 32).astype(np.int64)
                offsets = np.frombuffer(data, "<u8", n_lanes, 32 + 8 * docs)
                _, sizes = lanes(tokens)
                got = unpack(data[-size:] if size else b"", offsets, sizes, table, longest).astype("<u4").tobytes()
                ends = np.cumsum(tokens)
                begins = ends - tokens
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(begins + start.as_py()), pa.array(tokens), pa.array([got[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())], [id_col, "start", "n_tokens", "ids"]
                )

    kind = T.StructType([T.StructField(id_col, blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return placed.mapInArrow(run, kind)
