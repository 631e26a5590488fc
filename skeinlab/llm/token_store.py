"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id and a bitmap of those
that go on; level 1 holds the next chunk of these, and so on. A rank directory over each bitmap (ones before
every 512 bits) leads from a position in one level to its place in the next, so any id is read without
decoding others. Blocks of whole documents are rows of a Parquet data set in the shared folder, written and
committed by Spark; the block is the column `blob`."""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.llm import bpe, common

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
BLOCK_IDS = 1 << 19  # a block is closed at the first document that reaches so many ids
ROWS_EACH = 2_000  # documents of a range of ids, up to 10,000 ranges
END_ID = 2

_head, _level = struct.Struct("<4sBBxxQQ"), struct.Struct("<Q")
_pop = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The block of documents with these lengths whose ids follow one another."""
    levels, x = [], ids.astype(np.uint32)
    while len(x) or not levels:
        chunk, rest = (x & 0xFF).astype(np.uint8), x >> CHUNK_BITS
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), dtype=np.uint8)])
        ones = _pop[bits].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(_level.pack(len(x)) + chunk.tobytes() + bits.tobytes() + rank.tobytes())
        x = rest[more]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return _head.pack(MAGIC, CHUNK_BITS, len(levels), len(lengths), len(ids)) + starts.tobytes() + b"".join(levels)


class Block:
    """Reader of one block: single ids, runs of ids, documents."""

    def __init__(self, blob: bytes):
        magic, bits, levels, docs, self.n_ids = _head.unpack_from(blob)
        if magic != MAGIC or bits != CHUNK_BITS:
            raise ValueError("not a block of directly addressable codes")
        at = _head.size
        self.starts = np.frombuffer(blob, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = _level.unpack_from(blob, at)
            at += 8
            words = -(-(-(-n // 8)) // (RANK_BITS // 8))
            chunk, bits_at = np.frombuffer(blob, np.uint8, n, at), at + n
            bitmap = np.frombuffer(blob, np.uint8, words * RANK_BITS // 8, bits_at)
            rank = np.frombuffer(blob, "<u8", words + 1, bits_at + len(bitmap))
            at = bits_at + len(bitmap) + 8 * (words + 1)
            self.levels.append((chunk, bitmap, rank))

    @staticmethod
    def _rank(bitmap: np.ndarray, rank: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        start = i // RANK_BITS
        whole = bitmap[start * RANK_BITS // 8 : i // 8]
        last = int(_pop[bitmap[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0
        return int(rank[start]) + int(_pop[whole].sum()) + last

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK_BITS * k)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bitmap, rank, i)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi: in each level the codes of a run are themselves a run."""
        out = np.zeros(hi - lo, dtype=np.uint32)
        at = np.arange(hi - lo)
        for k, (chunk, bitmap, rank) in enumerate(self.levels):
            if lo >= hi:
                break
            out[at] |= chunk[lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo]
            at = at[bits.astype(bool)]
            lo = self._rank(bitmap, rank, lo)
            hi = lo + len(at)
        return out

    def document(self, d: int) -> np.ndarray:
        return self.tokens(int(self.starts[d]), int(self.starts[d + 1]))


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, rows_each: int = ROWS_EACH) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write blocks in ascending doc_id order to `out`.

    Null ids come first, equal ids by a hash of the text; null and empty texts are the end id alone. Only the
    texts are shuffled, once, to ranges of about rows_each ids cut at approximate percentiles, and a file holds
    ranges that follow one another, so that the files by name hold the ids in order; a range is sorted by Spark (which spills) and streamed, and memory holds one block. A lost task is run again and its
    files committed once. Empty input: a data set without rows."""
    path = path or bpe.vocabulary_path()
    spark = docs.sparkSession
    points = common.size_buckets(docs.select("doc_id"), "doc_id", rows_each)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(common.bucket_of(F.col("doc_id"), points).alias("range"), "doc_id", "text")
    file = F.floor(F.col("range").cast("bigint") * n / (len(points) + 1)).cast("int")
    ordered = rows.repartitionById(n, file).sortWithinPartitions("range", "doc_id", F.xxhash64("text"))

    def run(batches):
        memo = bpe.remembered(path, "ids", lambda ids: array("I", ids).tobytes(), by_library=True)
        end = array("I", [end_id]).tobytes()
        now, part, before = None, 0, 0
        ids: list[bytes] = []
        lengths: list[int] = []
        names: list[int | None] = []

        def block():
            blob = pack(np.frombuffer(b"".join(ids), dtype=np.uint32), np.asarray(lengths, dtype=np.int64))
            total = sum(lengths)
            row = pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([part]), pa.array([before]), pa.array([total]), pa.array([names], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["range", "part", "before", "n_ids", "doc_ids", "blob"],
            )
            ids.clear(), lengths.clear(), names.clear()
            return row, total

        held = 0
        for b in bpe.text_batches(batches):
            for place, doc_id, text in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lengths and (place != now or held >= BLOCK_IDS):
                    row, total = block()
                    yield row
                    part, before, held = part + 1, before + total, 0
                if place != now:
                    now, part, before = place, 0, 0
                (mine,) = memo.joined(memo.bpe.units(text or ""))
                ids.append(mine + end)
                lengths.append(len(mine) // 4 + 1)
                held += lengths[-1]
                names.append(doc_id)
        if lengths:
            yield block()[0]

    schema = "range int, part bigint, before bigint, n_ids bigint, doc_ids array<bigint>, blob binary"
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    The ids of each range (10,000 at most) are summed on the driver; a block knows its place in its range."""
    blocks = spark.read.schema("range int, part bigint, before bigint, n_ids bigint, doc_ids array<bigint>, blob binary").parquet(path)
    totals = {r[0]: r[1] for r in blocks.groupBy("range").agg(F.sum("n_ids")).collect()}
    base, total = {}, 0
    for r in sorted(totals):
        base[r], total = total, total + totals[r]

    def run(batches):
        for big in batches:
            for i in range(big.num_rows):
                b = big.slice(i, 1)
                block = Block(b.column("blob")[0].as_py())
                start = base[b.column("range")[0].as_py()] + b.column("before")[0].as_py() + block.starts[:-1]
                crc = [zlib.crc32(block.document(d).astype("<u4").tobytes()) for d in range(len(start))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[0].values, pa.array(start), pa.array(np.diff(block.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return blocks.select("range", "before", "doc_ids", "blob").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as files of directly addressable codes in the shared folder and reads them
    back: doc_id, start, n_tokens, ids_crc32. Nulls, ties and empty tables as in write_tokens; repeated rows are
    documents of their own; further columns are not read."""
    out = common.scratch(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"), out)
    return read_tokens(spark, out)
