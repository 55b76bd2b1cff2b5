"""Token-ID output: canonical, length-limited Huffman coding of ids from their global counts.

Format. A folder holds two tables. `codebook` lists (id, bits): the code length of each id, from which the canonical codes
follow. `blocks` has a row per independent block of whole documents: `part` and `seq` (its place in ascending order),
`doc_ids` (a list, so that it can hold nulls) and `doc_lengths`, `payload` (32-bit big-endian words of code bits) and `checkpoints` (the bit offset of every
256th id). A block is decoded on its own: all checkpoints of a block are decoded side by side through one lookup table.

Writing: texts are range-partitioned by document id (with a hash of the text, so that repeated ids can be split) and encoded once into a scratch
table of blocks, with a count of ids per task beside them; the counts are summed over at most a vocabulary's ids, and the blocks coded.
Reading: blocks are decoded in parallel; global starts come from sums per part and per block, not from a global sort.

Defined results: a null text counts as empty; every document gets the end id; documents are ordered by id, nulls first, then by hash
of the text; a null id is written and read as null; repeated rows are kept; an empty table writes an empty codebook and no block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.session import discard, materialize, scratch_path

MAX_BITS = 16
CHECKPOINT = 256
BLOCK_IDS = 1 << 20
END_ID = 0
#: The library is slow on words it has not met, so a worker remembers more of them here.
MEMO_ENTRIES, BYTES_AT_ONCE = 1_000_000, 8_000_000


# Codes ----------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge). counts: all over 0, ascending."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, (n - 1).bit_length())
    leaves = counts.astype(np.float64)
    taken_leaves: list[np.ndarray] = []
    level = leaves
    for _ in range(max_bits):
        order = np.argsort(level, kind="stable") if len(taken_leaves) else np.arange(n)
        taken_leaves.append(order < n)
        ordered = level[order]
        pairs = ordered[: len(ordered) // 2 * 2]
        level = np.concatenate((leaves, pairs[0::2] + pairs[1::2]))
    lengths = np.zeros(n, np.int64)
    wanted = 2 * n - 2
    for is_leaf in reversed(taken_leaves):
        from_leaves = int(is_leaf[:wanted].sum())
        lengths[:from_leaves] += 1
        wanted = 2 * (min(wanted, len(is_leaf)) - from_leaves)
    return lengths


class Codebook:
    """Canonical codes: by length, then by id. Decoding looks up the next `width` bits."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.width = int(self.bits.max()) if len(ids) else 1
        step = np.left_shift(1, self.width - self.bits)
        first = np.concatenate(([0], np.cumsum(step)[:-1])) if len(ids) else np.empty(0, np.int64)
        codes = first >> (self.width - self.bits)
        top = int(self.ids.max()) + 1 if len(ids) else 1
        self.code_of, self.bits_of = np.zeros(top, np.uint64), np.zeros(top, np.int32)
        self.code_of[self.ids], self.bits_of[self.ids] = codes, self.bits
        self.next_id = np.zeros(1 << self.width, np.uint32)
        self.next_bits = np.zeros(1 << self.width, np.int64)
        filled = int(step.sum())
        self.next_id[:filled], self.next_bits[:filled] = np.repeat(self.ids, step), np.repeat(self.bits, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """payload and checkpoints of a block."""
        if not len(ids):
            return b"", b""
        bits = self.bits_of[ids]
        # A block's bits fit 31 bits unless one document alone makes it very large.
        wide = np.int32 if len(ids) < 1 << 26 else np.int64
        at = np.cumsum(bits, dtype=wide) - bits
        word = at >> 5
        shifted = self.code_of[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 3, np.uint64)
        out[word[starts]] = np.add.reduceat(shifted >> np.uint64(32), starts)
        ends = np.append(starts[1:], len(ids)) - 1
        out[word[ends] + 1] += shifted[ends] & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes(), at[::CHECKPOINT].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        mask = np.uint64((1 << self.width) - 1)
        last = len(at) * CHECKPOINT - n  # ids that the last lane lacks
        for k in range(CHECKPOINT):
            if k == CHECKPOINT - last:
                at = at[:-1]
            m = len(at)
            peek = (pairs[at >> 5] >> (64 - self.width - (at & 31)).astype(np.uint64)) & mask
            out[k, :m] = self.next_id[peek]
            at = at + self.next_bits[peek]
        return out.T.reshape(-1)[:n]


# Writing --------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _library_encoder(path: str) -> bpe.TextEncoder:
    """This worker's encoder by the tokenizers library: it encodes each distinct word, and whole texts where words can't stand alone."""
    # One thread for each task: Spark has already dealt the work out to the cores.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    newline = tokenizer.encode("\n", add_special_tokens=False).ids
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def texts(items: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def words(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Words hold no newline, so many are encoded as one text with newlines between them.
        if len(newline) != 1:
            each = texts(items)
            return np.frombuffer(b"".join(each), "<u4"), np.fromiter((len(x) // 4 for x in each), np.int64, len(each))
        joined = ["\n".join([*items[k : k + 2000], ""]) for k in range(0, len(items), 2000)]
        coded = [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(coded) if coded else np.empty(0, np.uint32)
        ends = np.flatnonzero(ids == newline[0])
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    return bpe.TextEncoder(words, texts, specials, MEMO_ENTRIES, BYTES_AT_ONCE)


#: A row per block of whole documents, in order; and, with `seq` -1, one per task with how often it met each id (`ids`, `doc_lengths`: counts).
IDS = "part int, seq long, n_ids long, bytes int, doc_ids array<long>, doc_lengths binary, ids binary"


def _id_blocks(docs: DataFrame, path: str, parts: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Blocks of the ids of whole documents, in order, as little-endian unsigned integers of 16 or 32 bits, and the counts of each task."""
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _library_encoder(path), TaskContext.get().partitionId(), 0
        small = len(bpe.load(path).token_lengths) <= 1 << 16
        total = np.zeros(0, np.int64)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def row(seq: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> pa.RecordBatch:
            values = [part, seq, len(ids), width, doc_ids, lengths.astype("<i8").tobytes(), ids.astype(f"<u{width}").tobytes()]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["part", "seq", "n_ids", "bytes", "doc_ids", "doc_lengths", "ids"])

        def block() -> pa.RecordBatch:
            doc_ids, lengths, ids = zip(*held, strict=True)
            return row(seq, pa.concat_arrays(doc_ids).to_pylist(), np.concatenate(lengths), np.concatenate(ids), 2 if small else 4)

        for batch in batches:
            start = 0
            for ids, ends in encoder.flat_slices(batch.column(1)):
                ids = np.insert(ids, ends[1:], end_id)
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                held.append((batch.column(0).slice(start, len(ends) - 1), np.diff(ends) + 1, ids))
                start += len(ends) - 1
                if sum(len(x[2]) for x in held) >= BLOCK_IDS:
                    yield block()
                    held, seq = [], seq + 1
        if held:
            yield block()
        met = np.flatnonzero(total)
        yield row(-1, [], total[met], met, 4)

    return ordered.select("doc_id", "text").mapInArrow(run, IDS)


def _counts(blocks: DataFrame) -> DataFrame:
    """id, n: a row per id of the vocabulary at most, summed over the counts of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), "<u4").astype(np.int64)), pa.array(np.frombuffer(n.as_py(), "<i8"))], ["id", "n"])

    return blocks.where("seq < 0").select("ids", "doc_lengths").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coded(blocks: DataFrame, book: Codebook) -> DataFrame:
    names = ["part", "seq", "n_ids", "doc_ids", "doc_lengths", "payload", "checkpoints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [book.encode(np.frombuffer(ids.as_py(), f"<u{width}")) for ids, width in zip(batch.column(6), batch.column(3).to_pylist(), strict=True)]
            payloads, checkpoints = (pa.array([c[i] for c in coded], pa.binary()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4, 5)), payloads, checkpoints], names)

    schema = "part int, seq long, n_ids long, doc_ids array<long>, doc_lengths binary, payload binary, checkpoints binary"
    return blocks.where("seq >= 0").mapInArrow(run, schema)


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    max_bits: int = MAX_BITS,
    parts: int | None = None,
) -> None:
    """Writes the ids of all documents, in ascending document order, as `out`/codebook and `out`/blocks."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(_id_blocks(docs, tokenizer, parts, id_col, text_col, end_id), "ids", "zstd")
    # At most one row per id of the vocabulary reaches the driver.
    counted = _counts(ids).orderBy("n", "id").toPandas()
    bits = code_lengths(counted["n"].to_numpy(np.int64), max_bits)
    pairs = list(zip(counted["id"].tolist(), bits.tolist(), strict=True))
    spark.createDataFrame(pairs, "id long, bits long").coalesce(1).write.parquet(f"{out}/codebook")
    book = Codebook(counted["id"].to_numpy(np.int64), bits)
    _coded(ids, book).write.option("compression", "none").parquet(f"{out}/blocks")
    discard(ids)


# Reading --------------------------------------------------------------------------------------------------------------


def read_blocks(spark: SparkSession, path: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The decoded documents (part, seq, doc_id, in_block, n_tokens, and ids or their checksum), and the ids before each block (part, seq, offset)."""
    listed = spark.read.parquet(f"{path}/codebook").toPandas()
    book = Codebook(listed["id"].to_numpy(np.int64), listed["bits"].to_numpy(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part, so this window is as small as the number of parts.
    parts = by_part.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    offsets = blocks.select("part", "seq", "n_ids").withColumn("inside", inside).join(parts, "part").select(
        "part", "seq", (F.col("inside") + F.col("before")).alias("offset")
    )
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, n, lengths, payload, checkpoints = (batch.column(i)[k].as_py() for i in (0, 1, 2, 4, 5, 6))
                data = memoryview(book.decode(payload, checkpoints, n).astype("<u4").tobytes())
                lens = np.frombuffer(lengths, "<i8")
                ends = np.cumsum(lens)
                each = (data[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), lens.tolist(), strict=True))
                columns = [pa.array(np.full(len(lens), part, np.int32)), pa.array(np.full(len(lens), seq)), batch.column(3)[k].values, pa.array(ends - lens), pa.array(lens)]
                found = pa.array(map(zlib.crc32, each), pa.int64()) if digest else pa.array(map(bytes, each), pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, found], ["part", "seq", "doc_id", "in_block", "n_tokens", last])

    rows = blocks.mapInArrow(run, f"part int, seq long, doc_id long, in_block long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return rows, offsets


def _placed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("in_block")).alias("start"), "n_tokens", rows.columns[-1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers in one binary value)."""
    return _placed(*read_blocks(spark, path))


def token_report(docs: DataFrame, tokenizer: str, out: str | None = None) -> DataFrame:
    """Writes docs to files, reads them back, and returns doc_id, start, n_tokens and the checksum of the ids read (ids_crc32)."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens")
    write_tokens(docs, out, tokenizer)
    return _placed(*read_blocks(spark, out, digest=True))
