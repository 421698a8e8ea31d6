"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits.  The lowest chunks of all ids form level 0; a bitmap
says which ids go on, and their next chunks form level 1, and so on.  A rank directory counts
the set bits before every block of a bitmap, so the place of any id's next chunk is one lookup and a
few bits away: every id, or range of ids, is read without decoding what lies before it.

A table is written as Parquet files of segments, in ascending order of documents.  A segment
holds whole documents and reads by itself: the levels, and the ids and starts of its documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sizing import running_sums
from .tokens import encoder

#: Ids after which a segment is closed; a longer document is a segment by itself.
SEGMENT = 1 << 18
#: Bits of a bitmap counted together in the rank directory.
BLOCK = 512
WORDS = BLOCK // 64
#: Bytes of a Parquet row group: what one task reads at a time.
ROW_GROUP = 1 << 23
END = b"\0\0\0\0"
#: Texts encoded together.
TEXTS = 1024

# The segment's head (magic, levels, documents, ids) and a level's head (chunks).
MAGIC = b"DAC1"
HEAD = "<4sIQQ"
LEVEL = "<Q"
NO_ID = np.int64(-(1 << 63))


# --- levels ---------------------------------------------------------------------------------------


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def levels_of(ids: np.ndarray) -> list[bytes]:
    """The levels of unsigned 32-bit ids; at least one."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 0xFF
        bits = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, np.uint8)
        bits[: len(rest)] = goes_on
        bitmap = np.packbits(bits, bitorder="little")
        counts = np.bitwise_count(bitmap.view("<u8")).reshape(-1, WORDS).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[np.uint64(0)], np.cumsum(counts)]).astype("<u8")
        chunks = _padded((rest & np.uint32(0xFF)).astype(np.uint8).tobytes())
        out.append(struct.pack(LEVEL, len(rest)) + chunks + bitmap.tobytes() + directory.tobytes())
        rest = rest[goes_on] >> np.uint32(8)
        if not len(rest):
            return out


class Level:
    """One level as views of a segment's bytes."""

    def __init__(self, raw: memoryview, at: int):
        (self.n,) = struct.unpack_from(LEVEL, raw, at)
        at += struct.calcsize(LEVEL)
        self.chunks = np.frombuffer(raw, np.uint8, self.n, at)
        at += self.n + -self.n % 8
        blocks = -(-max(self.n, 1) // BLOCK)
        self.words = np.frombuffer(raw, "<u8", blocks * WORDS, at)
        self.bits = self.words.view(np.uint8)
        at += blocks * BLOCK // 8
        self.directory = np.frombuffer(raw, "<u8", blocks + 1, at)
        self.end = at + 8 * (blocks + 1)

    def rank(self, at: int) -> int:
        """Set bits before ``at``: the directory's count and those of a few words of one block."""
        block, inside = divmod(at, BLOCK)
        count = int(self.directory[block])
        if inside:
            word, bit = divmod(at, 64)
            count += int(np.bitwise_count(self.words[block * WORDS : word]).sum())
            if bit:
                count += (int(self.words[word]) & ((1 << bit) - 1)).bit_count()
        return count

    def goes_on(self, at: int) -> bool:
        return bool(int(self.words[at // 64]) >> (at % 64) & 1)

    def flags(self, start: int, stop: int) -> np.ndarray:
        """The bits of a range."""
        low = start // 8
        return np.unpackbits(self.bits[low : -(-stop // 8)], bitorder="little")[start - 8 * low : stop - 8 * low].view(bool)


class Segment:
    """A segment's documents and ids, read in place."""

    def __init__(self, raw: bytes):
        magic, levels, self.n_docs, self.n_ids = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at, view = struct.calcsize(HEAD), memoryview(raw)
        self.levels = []
        for _ in range(levels):
            self.levels.append(Level(view, at))
            at = self.levels[-1].end
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.has_id = np.frombuffer(raw, np.uint8, self.n_docs, at + 16 * self.n_docs + 8).view(bool)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at + 8 * self.n_docs).astype(np.int64)

    def __getitem__(self, at: int) -> int:
        """The id at a place, by one step per level."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level.chunks[at]) << (8 * k)
            if not level.goes_on(at):
                break
            at = level.rank(at)
        return value

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: on every level one range of chunks, found by rank."""
        out = np.zeros(stop - start, "<u4")
        where = None
        for k, level in enumerate(self.levels):
            chunks = level.chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out |= chunks
            else:
                out[where] |= chunks
            more = np.flatnonzero(level.flags(start, stop)) if stop > start else np.zeros(0, np.int64)
            if not len(more):
                break
            where = more if where is None else where[more]
            start = level.rank(start)
            stop = start + len(more)
        return out


def segment(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    """The bytes of a segment of documents, given their ids as little-endian 32-bit numbers."""
    levels = levels_of(np.frombuffer(b"".join(texts_ids), "<u4"))
    starts = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts_ids], dtype=np.int64)])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    head = struct.pack(HEAD, MAGIC, len(levels), len(doc_ids), int(starts[-1]))
    return head + b"".join(levels) + ids.tobytes() + starts.astype("<u8").tobytes() + known.tobytes()


# --- files ----------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, size: int = SEGMENT) -> None:
    """Tokenize ``docs`` (``doc_id``, ``text``) and write the ids to ``path``, in ascending order of ``doc_id``.

    Every document's ids end with id 0; NULL and empty texts have that one alone.  NULL ids come
    first, equal ids in the order of their texts' hashes.  Rows: ``part`` (ascending files),
    ``segment``, ``first`` (ids of the part before it), ``n_ids``, ``data``.  ``tokenizer`` is the path
    of a byte-level BPE file on the executors.
    """
    tokens = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    names = ["part", "segment", "first", "n_ids", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def write(batches):
        encode, part = encoder(tokens).encode_all, TaskContext.get().partitionId()
        doc_ids, held, n, first, nth = [], [], 0, 0, 0

        def closed():
            row = [part, nth, first, n, segment(doc_ids, held)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts = [text or "" for text in batch.column("text").slice(at, TEXTS).to_pylist()]
                for doc, ids in zip(batch.column("doc_id").slice(at, TEXTS).to_pylist(), encode(texts)):
                    ids += END
                    if held and n + len(ids) // 4 > size:
                        yield closed()
                        doc_ids, held, n, first, nth = [], [], 0, first + n, nth + 1
                    doc_ids.append(doc)
                    held.append(ids)
                    n += len(ids) // 4
        if held:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Equal ids fall apart by text, and equal rows by place, so no key is one task's alone.
    order = {"_text": F.xxhash64("text"), "_place": F.monotonically_increasing_id()}
    rows = rows.withColumns(order).repartitionByRange("doc_id", *order).sortWithinPartitions("doc_id", *order)
    rows = rows.select("doc_id", "text").mapInArrow(write, "part int, segment int, first long, n_ids long, data binary")
    rows.write.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of :func:`write_tokens`: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` (with the end id) and ``ids_crc32`` of its ids as little-endian 32-bit numbers."""
    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]

    def read(batches):
        for batch in batches:
            for part, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "data"))):
                found = Segment(data)
                bounds = found.starts.tolist()
                crcs = [zlib.crc32(found.ids(a, b).tobytes()) for a, b in zip(bounds, bounds[1:])]
                columns = [
                    pa.array(np.full(found.n_docs, part, np.int32)),
                    pa.array(found.doc_ids, mask=~found.has_id),
                    pa.array(first + found.starts[:-1]),
                    pa.array(np.diff(found.starts)),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    segments = spark.read.schema("part int, segment int, first long, n_ids long, data binary").parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = running_sums(sizes, [], "part", {"upto": F.col("n_ids")})  # a row per file
    before = before.select(F.col("part").alias("_part"), (F.col("upto") - F.col("n_ids")).alias("_before"))
    rows = segments.select("part", "first", "data").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = rows.join(before, F.col("part") == F.col("_part"))
    return rows.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the token ids of ``docs`` (``doc_id``, ``text``) and give its documents back as the files hold them.

    ``path`` is a folder that all executors see, by default a new one under the shared folder.  One
    row per input row, see :func:`read_tokens`.  NULL and empty texts have the end id alone; NULL
    ids come first and repeated rows follow one another; other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
