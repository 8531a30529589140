"""Token ids in canonical length-limited Huffman code (operator 6).

Format, version 1. A *block* is a string of bytes that can be decoded alone, given the codebook:

    magic "QMH1" | n_docs u32 | n_ids u64 | first_id u64 | step u32 | n_bits u64
    docs      n_docs x (doc_id i64, n_ids u64, flags u8)      flags & 1: doc_id is null
    checkpoints  ceil(n_ids / step) x u64, the bit at which ids 0, step, 2*step, ... of the block begin
    bits      n_bits, most significant first, padded with zeros and eight spare bytes

Numbers are little-endian. A block holds whole documents in ascending doc_id order (null first; equal doc_ids by the CRC of their
ids), about BLOCK_IDS ids. The *codebook* is one byte for each id of the vocabulary, the length of its code or 0; codes are canonical
(by length, then id). A data set is a Parquet table `blocks` (shard, block, n_ids, payload) beside a table `codebook`: Parquet is only
the container, so that Spark's commit protocol, any store and lost executors are taken care of. Shards hold ranges of doc_id in
ascending order.

Cases: null or empty text is a document of the end id alone; a text of any length is one document of one block; documents alike are each
written, and any order among them is the same; a doc_id may be null or repeated, and must be a whole number of 64 bits at most (other types
raise an error); an empty table gives a codebook without codes and no blocks, and reads as an empty table; other columns are ignored.
What the driver holds is the ids' counts and, in `read`, a number for each shard of SHARD_IDS ids.

Decoding is table-driven, and all checkpoints of a block are decoded side by side: one step of the loop decodes one id at each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAGIC = b"QMH1"
HEAD = struct.Struct("<4sIQQIQ")
DOC = np.dtype([("doc_id", "<i8"), ("n_ids", "<u8"), ("flags", "u1")])
BLOCK_IDS = 1 << 19
#: A shard is one task's work; there are more of them the more ids there are.
SHARD_IDS = 50_000_000
STEP = 256
LIMIT = 18


# ---------------------------------------------------------------------------------------------------------------- code

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than `limit` bits (package-merge); 0 for ids that never occur."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        out[symbols] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[order].astype(np.float64) if counts.sum() > 1 << 62 else counts[order].astype(np.int64)
    # level by level: which items of the merged list are single symbols; the lists are sorted, so a count of the singles is enough
    merged, singles = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, packages])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        singles.append(at < n)
    take = 2 * (n - 1)
    length = np.zeros(n, np.uint8)
    for single in reversed(singles):
        k = int(single[:take].sum())
        length[:k] += 1
        take = 2 * (take - k)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, by length and then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `width` bits: the symbol and the length of its code."""
    width = max(1, int(lengths.max(initial=0)))
    symbol, size = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    span = 1 << (width - lengths[order].astype(np.int64))
    filled = int(span.sum())
    symbol[:filled] = np.repeat(order, span)
    size[:filled] = np.repeat(lengths[order], span)
    return symbol, size, width


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of `ids`, and the bit at which each begins (one more at the end)."""
    size = lengths.astype(np.int32)[ids]
    if len(ids) and not size.all():
        raise ValueError("an id has no code")
    at = np.zeros(len(ids) + 1, np.int64 if len(ids) > 1 << 25 else np.int32)
    np.cumsum(size, out=at[1:])
    words = np.zeros((int(at[-1]) >> 5) + 3, np.uint64)
    if len(ids):
        # a code of up to 32 bits lies in two 32-bit words; codes that begin in the same word stand together
        start = at[:-1]
        word = start >> 5
        np.subtract(64 - (start & 31), size, out=size)
        value = codes[ids]
        value <<= size.astype(np.uint64)
        first = np.flatnonzero(word[1:] != word[:-1]) + 1
        first = np.concatenate([[0], first])
        joined = np.bitwise_or.reduceat(value, first)
        words[word[first]] |= joined >> np.uint64(32)
        words[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), at


def unpack_bits(bits: bytes, starts: np.ndarray, n: int, step: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """n ids, from the bits at which ids 0, step, 2*step, ... begin."""
    symbol, size, width = table
    raw = np.frombuffer(bits, ">u4").astype(np.uint64)
    two = (raw[:-1] << np.uint64(32)) | raw[1:]
    pos, lanes = starts.astype(np.int64).copy(), len(starts)
    out = np.zeros((lanes, step), np.uint32)
    last = n - (lanes - 1) * step if lanes else 0
    shift = np.int64(64 - width)
    mask = np.uint64((1 << width) - 1)
    for k in range(step):
        if k == last:  # the last lane is shorter
            pos = pos[:-1]
            if not len(pos):
                break
        look = (two[pos >> 5] >> (shift - (pos & 31)).astype(np.uint64)) & mask
        out[: len(pos), k] = symbol[look]
        pos += size[look]
    return out.reshape(-1)[:n]


# --------------------------------------------------------------------------------------------------------------- blocks

def encode_block(doc_ids: list[int | None], ids: list[np.ndarray], first_id: int, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    bits, at = pack_bits(flat, lengths, codes)
    docs = np.zeros(len(ids), DOC)
    docs["doc_id"] = [0 if x is None else x for x in doc_ids]
    docs["flags"] = [x is None for x in doc_ids]
    docs["n_ids"] = [len(x) for x in ids]
    return HEAD.pack(MAGIC, len(ids), len(flat), first_id, step, int(at[-1])) + docs.tobytes() + at[:-1:step].astype("<u8").tobytes() + bits


def block_docs(block: bytes) -> tuple[np.ndarray, int]:
    """The block's documents and the number of ids before it in its shard."""
    magic, n_docs, _, first, _, _ = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    return np.frombuffer(block, DOC, n_docs, HEAD.size), first


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int], start: int = 0, stop: int | None = None) -> np.ndarray:
    """The block's ids; with start and stop, only those, from the nearest checkpoint on."""
    magic, n_docs, n, _, step, _ = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = HEAD.size + n_docs * DOC.itemsize
    marks = np.frombuffer(block, "<u8", -(-n // step), at)
    lane = start // step
    own = marks[lane : -(-stop // step)]
    got = unpack_bits(block[at + 8 * len(marks) :], own, stop - lane * step, step, table)
    return got[start - lane * step :]


# ---------------------------------------------------------------------------------------------------------------- Spark

def token_rows(docs: DataFrame, spec: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and the ids as little-endian 16-bit (or, for large vocabularies, 32-bit) numbers. Each task ends with
    a row that has only `seen`: the ids that it has met and how often, so that counting them needs no second look."""
    spec_b = docs.sparkSession.sparkContext.broadcast(spec)
    schema = C.schema_of(docs, "doc_id", n_tokens=C.LONG, ids_crc32=C.LONG, ids=C.BIN, seen=C.BIN)

    def run(batches):
        import pyarrow as pa

        enc = C.encoder(spec_b.value, end_id)
        width = _width(enc.size)
        total = np.zeros(enc.size, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in C.slices(batch, C.ENCODE_BYTES):
                raw = enc.encode(part.column(1).to_pylist())
                total += np.bincount(np.frombuffer(b"".join(raw), "<u4"), minlength=enc.size)
                ids = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(raw), pa.binary())], names=schema.names)
        if kind is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([met, total[met]]).astype("<i8").tobytes()], pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def id_counts(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' own counts."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for raw in b.column(0):
                met, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
                total[met] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])

    got = rows.where("seen is not null").select("seen").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each id
    counts = np.zeros(vocabulary, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, spec: str | None = None, end_id: int = 1, shards: int | None = None, limit: int = LIMIT) -> None:
    """Encodes the documents (doc_id, text) and writes the data set `path`: tables `blocks` and `codebook`."""
    import json

    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number")
    spark, spec = docs.sparkSession, spec or C.tokenizer_spec()
    form = json.loads(spec)
    vocabulary = 1 + max([end_id, *form["model"]["vocab"].values(), *(x["id"] for x in form.get("added_tokens", []))])
    rows = C.staged(token_rows(docs, spec, end_id).withColumn("_tie", F.monotonically_increasing_id()), "ids", "snappy")  # rows alike in all else may lie in two ranges
    counts = id_counts(rows, vocabulary)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id)], "lengths binary, end_id int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(lengths.tobytes())
    width, block_ids, step = _width(vocabulary), BLOCK_IDS, STEP
    schema = T.StructType([T.StructField("shard", C.INT), T.StructField("block", C.INT), T.StructField("n_ids", C.LONG), T.StructField("payload", C.BIN)])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId(), np.frombuffer(book.value, np.uint8)
        codes = canonical(own)
        doc_ids, ids, n, first, block = [], [], 0, 0, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([encode_block(doc_ids, ids, first, own, codes, step)], pa.binary())], names=schema.names)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw.as_buffer(), width).astype(np.uint32))
                n += len(ids[-1])
                if n >= block_ids:
                    yield out()
                    first, block = first + n, block + 1
                    doc_ids, ids, n = [], [], 0
        if ids:
            yield out()

    shards = shards or max(C.shuffle_parts(spark), -(-int(counts.sum()) // SHARD_IDS))
    own = rows.where("seen is null").select("doc_id", "ids_crc32", "_tie", "ids").repartitionByRange(shards, "doc_id", "ids_crc32", "_tie").sortWithinPartitions("doc_id", "ids_crc32", "_tie")
    own.select("doc_id", "ids").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    C.drop_stage(rows)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, `ids`, all from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]))
    before, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row for each shard
        before[r["shard"]] = total
        total += r["n"]
    schema = T.StructType([T.StructField("doc_id", C.LONG), T.StructField("start", C.LONG), T.StructField("n_tokens", C.LONG), T.StructField("ids_crc32", C.LONG), *([T.StructField("ids", C.BIN)] if with_ids else [])])

    def run(batches):
        import pyarrow as pa

        table = tables(np.frombuffer(book.value, np.uint8))
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = payload.as_py()
                docs, first = block_docs(block)
                flat = decode_block(block, table).astype("<u4")
                ends = np.cumsum(docs["n_ids"].astype(np.int64))
                starts = ends - docs["n_ids"].astype(np.int64)
                raw = [flat[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], mask=(docs["flags"] & 1).astype(bool)), pa.array(starts + (before[shard] + first)), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in raw], pa.int64()), *([pa.array(raw, pa.binary())] if with_ids else [])], names=schema.names)

    return blocks.select("shard", "payload").mapInArrow(run, schema)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "tokens")
    write(C.documents(spark, sf_dir), path)
    return read(spark, path, with_ids=False)


QUERIES = {"op6_huffman_token_ids": op6_tokens}
SQL: dict[str, str] = {}
