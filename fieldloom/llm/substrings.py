"""Removal of repeated passages by fixed-block anchors.

A window of 20 words holds a block of 10 words that starts at a multiple of 10 in its own
document.  So of two equal windows, the blocks of either document are met by the rolling
10-word windows of the other: these are the anchors.

1. *Index and probe.*  Every rolling 10-word hash is a probe; those at multiples of 10 are the
   index as well.  A probe is hit if another place has the same hash and one of them is an
   index block.
2. *Extend.*  Around hits, every 20-word window is identified by the hashes of its two
   halves; of equal windows all but the first are repeats, and adjoining ones make up the
   maximal repeats.

Documents are first gathered into chunks of some hundred thousand words, which are shuffled once
by chunk and read by all steps.  A chunk resolves what repeats inside of it, so a passage counts
once per chunk in a shuffle, however often it occurs.  Hashes travel in sorted blocks of bytes,
one per chunk and hash range.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import run_starts, runs, words_of

WINDOW, BLOCK = 20, 10
#: Bytes of text gathered in a chunk at least, and chunks that a corpus is cut into at most.
CHUNK_BYTES, CHUNKS = 3 << 19, 500_000
#: Bytes of text whose probes meet in one hash range, and bytes that a word takes about.
RANGE_BYTES, WORD_BYTES = 8 << 20, 6
#: Neighbouring places that a hit stands for; smaller numbers travel as fewer bytes.
CELL = 4
#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED = 250_000
LAST = np.iinfo(np.int64).max  # a NULL doc_id sorts after all others
U64 = np.uint64
MULTIPLY, OTHER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


# --- sorted blocks of numbers -----------------------------------------------------------


def to_bytes(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as byte planes (all lowest bytes, then all second ones, ...), so that high bytes
    that are zero compress away; ascending ones as differences."""
    values = values.astype(np.uint64)
    if ascending and len(values):
        values = np.diff(values, prepend=U64(0))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(block: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


# --- chunks -----------------------------------------------------------------------------


def chunked(docs: DataFrame, least_bytes: int) -> DataFrame:
    """Documents gathered by input task: ``chunk``, ``ids`` and ``texts``, ordered by id."""

    def row(chunk: int, docs: list) -> pa.RecordBatch:
        docs.sort(key=lambda d: LAST if d[0] is None else d[0])
        ids, texts = pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())
        whole = pa.array([0, len(docs)], pa.int32())
        columns = [pa.array([chunk]), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, texts)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "texts"])

    def gather(batches):
        chunk = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append(doc)
                size += len(doc[1] or "")
                if size >= least_bytes:
                    yield row(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield row(chunk, held)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(gather, "chunk long, ids array<long>, texts array<string>")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Chunk:
    """The words of a chunk's documents laid end to end."""

    def __init__(self, batch: pa.RecordBatch, row: int, known: WordHashes | None = None):
        self.chunk = batch.column("chunk")[row].as_py()
        self.ids = batch.column("ids")[row].as_py()
        self.words = [words_of(t) for t in batch.column("texts")[row].values.cast(pa.binary()).to_pylist()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.total = int(self.size.sum())
        if known is not None:
            flat = (known[w] for words in self.words for w in words)
            self.hashes = np.fromiter(flat, np.uint64, self.total)
            self.doc = np.repeat(np.arange(len(self.words)), self.size)

    def halves(self) -> np.ndarray:
        """The hash of ``BLOCK`` words from every place on."""
        n = self.total - BLOCK + 1
        made = np.zeros(max(n, 0), np.uint64)
        for k in range(BLOCK if n > 0 else 0):
            made = (made ^ self.hashes[k : k + n]) * MULTIPLY
            made ^= made >> U64(32)
        return made

    def left(self) -> np.ndarray:
        """Words from every place to the end of its document."""
        return self.size[self.doc] - (np.arange(self.total) - self.start[self.doc])


def spread(marks: np.ndarray, width: int) -> np.ndarray:
    """Places with a mark among the ``width`` places that end there."""
    upto = np.cumsum(marks)
    upto[width:] -= upto[:-width].copy()
    return upto > 0


# --- index and probe --------------------------------------------------------------------


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A range number that grows with the hash."""
    return ((hashes >> U64(32)) * U64(ranges)) >> U64(32)


def probes(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Rolling hashes by hash range: ``range``, ``chunk``, ``keys`` (ascending; hash bits and whether it
    is an index block) and ``cells``.  Rows without keys hold ``cells`` hit inside the chunk."""
    names = ["range", "chunk", "keys", "cells"]

    def cut(batches):
        known = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                c = Chunk(batch, row, known)
                halves = c.halves()
                left, n = c.left()[: len(halves)], len(halves)
                place = np.flatnonzero((left >= BLOCK) & (c.size[c.doc[:n]] >= WINDOW))
                index = (place - c.start[c.doc[place]]) % BLOCK == 0
                order = np.argsort(halves[place], kind="stable")
                place, index, key = place[order], index[order], halves[place[order]]
                if not len(key):
                    continue
                new = np.append(True, key[1:] != key[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(key)))
                hit = np.unique(place[np.repeat(many > 1, many)] // CELL)
                index = np.maximum.reduceat(index, first)
                key, place = key[first], place[first]
                range_ = range_of(key, ranges)
                cuts = np.append(np.flatnonzero(np.append(True, range_[1:] != range_[:-1])), len(key))
                code = (key >> U64(64 - bits) << U64(1)) | index
                out = [(int(range_[0]), c.chunk, None, to_bytes(hit, True))] if len(hit) else []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    out.append((int(range_[a]), c.chunk, to_bytes(code[a:b], True), to_bytes(place[a:b] // CELL)))
                yield _batch(out, names, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return chunks.mapInArrow(cut, "range long, chunk long, keys binary, cells binary")


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _by_range(rows: DataFrame, resolve, result: str) -> DataFrame:
    """Run ``resolve`` on all rows of one hash range at a time; gives ``chunk`` and a block of numbers.

    Rows without keys are passed on: making them in a branch of their own would read the
    texts twice.
    """

    def each(batches):
        for table in runs(batches, ["range"], 1):
            starts = run_starts(table, ["range"])
            for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
                part = table.slice(int(a), int(b - a))
                inside = part.column("keys").is_null()
                out = list(zip(*(part.filter(inside).column(c).to_pylist() for c in ("chunk", result))))
                part = part.filter(pc.invert(inside))
                if part.num_rows:
                    chunk, value = resolve(part)
                    order = np.lexsort((value, chunk))
                    chunk, value = chunk[order], value[order]
                    cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
                    out += [(int(chunk[x]), to_bytes(value[x:y], True)) for x, y in zip(cuts, [*cuts[1:], len(chunk)])]
                yield _batch(out, ["chunk", result], [pa.int64(), pa.binary()])

    rows = rows.repartition("range").sortWithinPartitions("range")
    return rows.mapInArrow(each, f"chunk long, {result} binary")


def _joined(table: pa.Table, column: str, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blocks of a column and the chunk of each."""
    blocks = [from_bytes(b, ascending) for b in table.column(column).to_pylist()]
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(b) for b in blocks])
    return np.concatenate(blocks), chunk


def _hit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code, chunk = _joined(table, "keys", True)
    cell, _ = _joined(table, "cells")
    order = np.argsort(code, kind="stable")
    code, chunk, cell = code[order], chunk[order], cell[order]
    key = code >> U64(1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(first, len(key)))
    hit = np.repeat((many > 1) & (np.maximum.reduceat(code & U64(1), first) == 1), many)
    return chunk[hit], cell[hit]


# --- extend -----------------------------------------------------------------------------


def windows(chunks: DataFrame, ranges: int) -> DataFrame:
    """The windows around hits (``cells``, per chunk) by hash range: ``range``, ``chunk``, ``keys``
    (ascending), ``places`` and ``docs`` (document ids), one entry per distinct window of a chunk.
    Rows without keys hold the ``places`` of windows that repeat an earlier one of the chunk."""
    names = ["range", "chunk", "keys", "places", "docs"]

    def cut(batches):
        known = WordHashes()
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            for row in range(batch.num_rows):
                if not cells[row]:
                    continue
                c = Chunk(batch, row, known)
                halves = c.halves()
                marked = np.zeros(c.total + CELL, np.int64)
                for block in cells[row]:
                    cell = from_bytes(block, True).astype(np.int64) * CELL
                    for k in range(CELL):
                        marked[cell + k] = 1
                near = spread(marked[: c.total][::-1], WINDOW - BLOCK + 1)[::-1]  # a hit in one of its blocks
                place = np.flatnonzero(near & (c.left() >= WINDOW))
                if not len(place):
                    continue
                key = (halves[place] * OTHER) ^ halves[place + BLOCK]
                range_ = range_of((halves[place] ^ (halves[place + BLOCK] * MULTIPLY)) * OTHER, ranges)
                key = (key ^ (key >> U64(29))) * MULTIPLY
                order = np.lexsort((place, key, range_))
                place, key, range_ = place[order], key[order], range_[order]
                new = np.append(True, (key[1:] != key[:-1]) | (range_[1:] != range_[:-1]))
                again = np.sort(place[~new])
                place, key, range_ = place[new], key[new], range_[new]
                ids = np.array([LAST if i is None else i for i in c.ids], np.int64)[c.doc[place]]
                out = [(int(range_[0]), c.chunk, None, to_bytes(again, True), None)] if len(again) else []
                cuts = np.append(np.flatnonzero(np.append(True, range_[1:] != range_[:-1])), len(key))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    blocks = to_bytes(key[a:b], True), to_bytes(place[a:b]), to_bytes(ids[a:b].view(np.uint64))
                    out.append((int(range_[a]), c.chunk, *blocks))
                yield _batch(out, names, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return chunks.mapInArrow(cut, "range long, chunk long, keys binary, places binary, docs binary")


def _again(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, chunk = _joined(table, "keys", True)
    place, _ = _joined(table, "places")
    doc = _joined(table, "docs")[0].view(np.int64)
    order = np.lexsort((place, chunk, doc, key))
    again = order[1:][key[order][1:] == key[order][:-1]]
    return chunk[again], place[again]


# --- the operator -----------------------------------------------------------------------


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove the words of every document that lie in a window of ``WINDOW`` words whose words, in
    this order, also start at an earlier place: in a document with a smaller ``doc_id``, or
    earlier in the same one.  Windows are judged on the input.

    Takes ``doc_id`` and ``text``; words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Returns one row per
    input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the other words joined by a
    space).  NULL and empty texts have no words; shorter texts than a window are kept whole.
    A NULL id comes after all others; rows that share an id come in the order in which the input's
    tasks read them.  An empty table gives an empty result.

    The input must read the same rows in the same tasks when it is read again, as files do.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(shuffles, -(-size // RANGE_BYTES))
    bits = min(62, (size // WORD_BYTES + 1).bit_length() + 10)  # under one probe in a thousand meets a wrong block
    chunks = chunked(docs, max(CHUNK_BYTES, size // CHUNKS)).repartition("chunk")

    # Left joins only: an inner one would add a filter below the shuffle of the chunks, and
    # Spark could not read that shuffle's files again for the other uses.
    hits = _by_range(probes(chunks, ranges, bits), _hit, "cells")
    hits = hits.groupBy("chunk").agg(F.collect_list("cells").alias("cells"))  # a bounded chunk's places
    again = _by_range(windows(chunks.join(hits, "chunk", "left"), ranges), _again, "places")
    again = again.groupBy("chunk").agg(F.collect_list("places").alias("places"))

    def keep(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            places = batch.column("places").to_pylist()
            for row in range(batch.num_rows):
                c = Chunk(batch, row)
                repeats = np.zeros(c.total, np.int64)
                for block in places[row] or ():
                    repeats[from_bytes(block, True).astype(np.int64)] = 1
                gone = spread(repeats, WINDOW)
                removed = np.add.reduceat(np.append(gone, 0), c.start) * (c.size > 0) if len(c.size) else c.size
                out = []
                for i, words in enumerate(c.words):
                    if removed[i]:
                        words = compress(words, (~gone[c.start[i] : c.start[i] + c.size[i]]).tolist())
                    out.append((c.ids[i], int(c.size[i]), int(removed[i]), b" ".join(words)))
                yield _batch(out, ["doc_id", "n_words", "n_removed", "kept"], kinds)

    rows = chunks.join(again, "chunk", "left").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept binary")
    return rows.withColumn("kept", F.decode("kept", "UTF-8"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT rn, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d),
again AS (SELECT rn, i FROM (SELECT rn, doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS said FROM starts)
  QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT rn, i + k AS i FROM again, range({WINDOW}) AS r(k)),
each AS (SELECT rn, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS said, count(*) AS n FROM each ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""
