"""Operator 1: token files with canonical length-limited Huffman codes.

Format: a folder with ``blocks``, rows of one independent block each, and ``codebook``, the code length of each
id that occurs. A block's payload is little-endian: magic, documents, tokens, bits; doc ids (int64), whether an id
is null (uint8), tokens of each document (uint32); bit offsets of every 128th token (uint32); the code bits, first
bit highest, in big-endian 32-bit words. Blocks hold whole documents, so any one can be read alone, and within one
all stretches of 128 tokens are decoded at once from their checkpoints by a table lookup for each token. The rows
lie in Parquet files, which Spark commits only when a task has ended: a lost executor leaves no torn file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, partitions, shared_dir, staged
from .tokens import tokenize

MAGIC = 0x5048_4631
STEP = 128
#: Tokens after which a block is closed.
BLOCK = 1 << 18
#: Longest code; the decoder's table has 2 ** LIMIT entries.
LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this code length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    flags, row = [], leaves
    for _ in range(limit):
        level = np.concatenate([leaves, row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)]) if flags else leaves
        by = np.argsort(level, kind="stable")
        flags.append(by < len(leaves))
        row = level[by]
    take = 2 * len(leaves) - 2
    for leaf in reversed(flags):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as uint32."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= n - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), n
    return codes.astype(np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each prefix of as many bits as the longest code: id * 64 + length."""
    most = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.zeros(1 << most, np.uint64)
    filled = np.repeat((order.astype(np.uint64) << np.uint64(6)) | lengths[order].astype(np.uint64), 1 << (most - lengths[order]))
    table[: len(filled)] = filled
    return table, most


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Big-endian words, bit offsets of every STEP-th token, and the number of bits."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 32 + 3, np.uint64)
    if bits:
        word = starts >> 5
        wide = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        joined = np.bitwise_or.reduceat(wide, first)
        at = word[first]
        words[at] |= joined >> np.uint64(32)
        words[at + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4"), starts[::STEP].astype("<u4"), bits


def unpack_bits(words: np.ndarray, offsets: np.ndarray, tokens: int, table: np.ndarray, most: int) -> np.ndarray:
    """All stretches between checkpoints in step: one lookup for each stretch and place."""
    wide = words.astype(np.uint64)
    two = (wide[:-1] << np.uint64(32)) | wide[1:]
    at = offsets.astype(np.uint64)
    out = np.empty((STEP, len(at)), np.uint32)
    last = tokens - STEP * (len(at) - 1)  # of the last stretch; past its end it reads zeros that are cut off
    end, shift, six, low = np.uint64(len(two) - 1), np.uint64(64 - most), np.uint64(6), np.uint64(63)
    for i in range(STEP if len(at) > 1 else last):
        found = table[(two[np.minimum(at >> np.uint64(5), end)] << (at & np.uint64(31))) >> shift]
        out[i] = found >> six
        at += found & low
    return out.T.reshape(-1)[:tokens]


def block_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    words, offsets, bits = pack_bits(ids, codes, lengths)
    null = np.fromiter((x is None for x in doc_ids), np.uint8, len(doc_ids))
    own = np.fromiter((x or 0 for x in doc_ids), "<i8", len(doc_ids))
    head = struct.pack("<IIQQ", MAGIC, len(doc_ids), len(ids), bits)
    return b"".join([head, own.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), offsets.tobytes(), words.tobytes()])


def read_block(data: bytes, table: np.ndarray, most: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all ids, of one block's payload."""
    magic, docs, tokens, _ = struct.unpack_from("<IIQQ", data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = 24

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, n, at)
        at += out.nbytes
        return out

    own, null, counts, offsets = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", -(-tokens // STEP))
    words = np.frombuffer(data, ">u4", -1, at)
    ids = unpack_bits(words, offsets, tokens, table, most) if tokens else np.empty(0, np.uint32)
    return [None if z else int(x) for x, z in zip(own, null, strict=True)], counts.astype(np.int64), ids


def flat_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column as one array, and the number of each row; null rows have none."""
    if not len(column):
        return np.empty(0, dtype), np.empty(0, np.int64)
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return raw.view(dtype), np.diff(offsets).astype(np.int64) // np.dtype(dtype).itemsize


def id_counts(tokens: DataFrame, dtype: str = "<u2") -> DataFrame:
    """id, n over the whole table: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found = np.bincount(flat_ids(batch.column("ids"), dtype)[0], minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(tokens: DataFrame, path: str, dtype: str = "<u2", block: int = BLOCK, limit: int = LIMIT) -> None:
    """Write doc_id, ids rows (as ``tokenize`` gives them) to token files below ``path`` in ascending doc_id order.

    Null ids come first; rows of the same id stand in the order of a hash of their tokens, equal rows in any, so that an id
    or a row that is there very often fills several tasks. ``tokens`` is read twice, so it should be a written table. Only the counts by id, at most as many as the vocabulary, come to the driver.
    """
    spark = tokens.sparkSession
    rows = id_counts(tokens, dtype).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        pending = 0

        def closed() -> pa.RecordBatch:
            nonlocal docs, sizes, held, pending, place, start
            ids = np.concatenate(held) if held else np.empty(0, np.uint16)
            payload = block_bytes(docs, np.concatenate(sizes), ids, codes, lengths)
            row = [[part], [place], [start], [len(docs)], [len(ids)], [payload]]
            place, start = place + 1, start + len(ids)
            docs, sizes, held, pending = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "start_in_part", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            ids, n = flat_ids(batch.column("ids"), dtype)
            keys = batch.column("doc_id").to_pylist()
            ends = np.concatenate([[0], np.cumsum(n)])
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + block - pending, "right")) - 1)
                to = min(to, len(keys))
                docs += keys[at:to]
                sizes.append(n[at:to])
                held.append(ids[ends[at] : ends[to]])
                pending += int(ends[to] - ends[at])
                at = to
                if pending >= block or at < len(keys):
                    yield closed()
        if docs:
            yield closed()

    rows = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "ids").select("doc_id", "ids")
    blocks = ordered.mapInArrow(run, "part int, block long, start_in_part long, n_docs long, n_tokens long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids (binary, little-endian uint32) from token files.

    The driver gets the code lengths and one total for each written partition, not for each block.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]
    table, most = decode_table(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(batch.column("part").to_pylist(), batch.column("start_in_part").to_pylist(), batch.column("payload"), strict=True):
                docs, n, ids = read_block(payload.as_buffer(), table, most)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base[part] + start + ends - n), pa.array(n), _id_rows(ids, n)], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "start_in_part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _id_rows(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    from .tokens import id_bytes

    return id_bytes(ids, counts, "<u4")


def crc32s(values: pa.Array) -> pa.Array:
    """Unsigned crc32 of each binary value."""
    return pa.array([zlib.crc32(v.as_buffer()) if v.is_valid else 0 for v in values], pa.int64())


def token_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of ``read_tokens`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), crc32s(b.column("ids"))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Tokenise whole documents and write them as token files; the ids are staged once, as they are read twice."""
    from .tokens import id_dtype

    tokens = staged(tokenize(docs, tokenizer, end_id), "token-ids")
    write_tokens(tokens, path, id_dtype(tokenizer))
    drop_staged(tokens)


def token_file_query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_corpus(docs, path, tokenizer)
    return token_checksums(read_tokens(spark, path))
