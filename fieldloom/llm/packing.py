"""Packing documents into sequences of a fixed number of tokens.

Texts are tokenized once, giving a small row per piece.  Which lengths go together depends on
the histogram of lengths alone, at most one count per token of a sequence, so
:mod:`bins` packs that on the driver whatever the number of documents.  Its fillings are
then dealt out: the k-th piece of a length takes the k-th place for that length.  The places
are numbered in parts per length, so no task sees all pieces of a common length.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpointed
from .bins import pack
from .tokens import encoder

SEQUENCE = 2048
#: Pieces of one length numbered in one group.
PART = 50_000
END = b"\0\0\0\0"
#: Texts whose pieces are handed on together.
TEXTS = 1024


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document's ids are those of its text followed by id 0; NULL text is empty.  Documents
    longer than ``size`` are cut so that all pieces but the first are full.  ``tokenizer`` is the
    path of a byte-level BPE file on the executors.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches):
        encode = encoder(path).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = []
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                    raw = memoryview(ids + END)
                    n = len(raw) // 4
                    stop, start, piece = (n % size or size) if n > size else n, 0, 0
                    while start < n:
                        rows.append((doc, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + size, piece + 1
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``nth``: the place of a row among those of its ``length``, from 0 and without gaps.

    A length is split by hash into parts of about ``PART`` rows, each numbered by itself and
    moved on by the sizes of the parts before it.
    """
    per_length = rows.groupBy("length").count()
    parts = per_length.select("length", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    salt = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    rows = rows.join(F.broadcast(parts), "length")  # a row per length, of which there are SEQUENCE at most
    rows = rows.withColumn("part", F.pmod(salt, F.col("parts")).cast("int")).drop("parts")
    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    sizes = rows.groupBy("length", "part").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("part")) - F.col("count")
    sizes = sizes.select("length", "part", before.alias("before"))
    rows = rows.join(sizes, ["length", "part"])
    return rows.withColumn("nth", F.col("before") + F.col("place")).drop("part", "place", "before")


class Places:
    """Where the k-th piece of each length goes, as ranges of k."""

    def __init__(self, packed: list, size: int):
        taken = np.zeros(size + 1, np.int64)
        ranges = []
        sequence = 0
        for times, filling in packed:
            offset = 0
            for length, n in filling:
                ranges.append((length, taken[length], sequence, n, offset))
                taken[length] += times * n
                offset += length * n
            sequence += times
        ranges.append((size, 0, sequence, 1, 0))  # full pieces are sequences by themselves
        columns = np.array(sorted(ranges), np.int64).T
        self.length, self.first, self.sequence, self.n, self.offset = columns
        self.key = self._key(self.length, self.first)

    @staticmethod
    def _key(length, nth):
        return length << np.int64(48) | nth

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, self._key(length, nth), side="right") - 1
        after = nth - self.first[at]
        return self.sequence[at] + after // self.n[at], self.offset[at] + after % self.n[at] * length


def pack_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` tokens.

    Takes ``doc_id`` and ``text``; see :func:`pieces` for how texts are cut.  Returns a row per
    piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``,
    the piece's place in its sequence, without gaps from 0.  Empty and NULL texts are one
    piece of one token.  Repeated rows and rows without an id are packed like others.  An
    empty table gives an empty result.
    """
    rows = checkpointed(pieces(docs, size, tokenizer))
    counts = np.zeros(size, np.int64)
    for length, n in rows.where(F.col("length") < size).groupBy("length").count().collect():  # under ``size`` rows
        counts[length] = n
    held = docs.sparkSession.sparkContext.broadcast(Places(pack(counts, size), size))

    def place(batches):
        places = held.value
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            kept = [batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    out = rows.columns
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", sequence_id bigint, offset bigint"
    return numbered(rows).select(*out, "nth").mapInArrow(place, schema)
