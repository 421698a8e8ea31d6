"""Benchmark decontamination by spaced seeds.

A mask keeps six positions of a short run of words and ignores the others, so a seed hash
survives substitutions at ignored positions.  The five masks are chosen together: wherever three
of 13 words in a row are substituted, one of them keeps clear of all three.  Seeds of benchmark items and of documents are
joined on their hash; each pair of texts and each shift between them that shares a seed is then
verified word by word around the hit, allowing substitutions.

Documents are first held against a bitmap of the benchmark's seeds.  Its size is fixed, so
it can go to every task however large the benchmark is; with a larger benchmark it lets
more through, and the join still decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Positions of a run of words that a seed looks at ("1") and ignores ("0").  Found by search: together they
#: hit all 286 ways to substitute three of 13 words, two of 11 or 12, and one of 9 or 10; of items of 8 words, 5 of 8 ways.
MASKS = ("1101111", "111001011", "1101000111", "11010111", "11110000101")
#: Words in a row that are held against an item (all of a shorter item), and the percentage that must agree.
WINDOW, AGREE = 13, 75
#: Items with fewer words than this must be met word for word: a hash of the whole item is their seed.
SHORT = 8
BITMAP_BITS = 26
#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED = 500_000
WORD = re.compile(r"[^\W_]+")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def under(mask: str, words: np.ndarray, kind: int) -> np.ndarray:
    """The hashes of all runs of word hashes under a mask, by start; ``kind`` tells masks apart."""
    n = max(0, len(words) - len(mask) + 1)
    made = np.full(n, kind, np.uint64)
    for at, look in enumerate(mask):
        if look == "1":
            made = (made ^ words[at : at + n]) * MULTIPLY
            made ^= made >> SHIFT
    return made


def seeds(words: np.ndarray):
    """For every mask, the hashes of all runs of word hashes under it, by start."""
    for which, mask in enumerate(MASKS):
        if len(words) >= len(mask):
            yield under(mask, words, which + 1)


def whole(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words, by start: the seeds of items of that many words."""
    return under("1" * size, words, len(MASKS) + size)


def bits_of(hashes: np.ndarray) -> list[np.ndarray]:
    """Three places in the bitmap for every hash."""
    top = np.uint64(64 - BITMAP_BITS)
    return [h >> top for h in (hashes, hashes << np.uint64(BITMAP_BITS), (hashes ^ (hashes >> SHIFT)) * MULTIPLY)]


def is_set(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def known_places(bitmap: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Where the hashes are that the bitmap knows."""
    at = np.arange(len(made))
    for bit in range(3):
        at = at[is_set(bitmap, bits_of(made[at])[bit])]
        if not len(at):
            break
    return at


def benchmark_items(benchmark: DataFrame, fewest_words: int) -> DataFrame:
    """Distinct items of at least ``fewest_words`` words: ``item`` (a hash of the words), the smallest
    ``item_id`` with that text, and ``item_words`` (their hashes)."""

    def hashed(batches):
        known = WordHashes()
        for batch in batches:
            rows = [known.of(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh64_intdigest(w.tobytes()) - (1 << 63) for w in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(keys, pa.int64()), pa.array([w.view(np.int64) for w in rows], pa.list_(pa.int64()))],
                ["item_id", "item", "item_words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(hashed, "item_id long, item long, item_words array<long>")
    rows = rows.where(F.size("item_words") >= fewest_words)
    return rows.groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("item_words").alias("item_words"))


def item_seeds(items: DataFrame) -> DataFrame:
    """``hash``, ``item`` and ``item_at`` of every seed of the items."""

    def cut(batches):
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("item_words")):
                words = words.values.to_numpy().view(np.uint64)
                for made in seeds(words) if len(words) >= SHORT else [whole(words, len(words))]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made.view(np.int64)), pa.array(np.full(len(made), item)), pa.array(np.arange(len(made), dtype=np.int32))],
                        ["hash", "item", "item_at"],
                    )

    return items.select("item", "item_words").mapInArrow(cut, "hash long, item long, item_at int").distinct()


def bitmap(made: DataFrame) -> np.ndarray:
    """The bits of all seeds, put together on the executors; 8 MB whatever their number."""

    def places(batches):
        for batch in batches:
            bits = np.unique(np.concatenate(bits_of(batch.column("hash").to_numpy().view(np.uint64))))
            value = np.uint64(1) << (bits & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array(value.view(np.int64))], ["place", "bits"]
            )

    rows = made.select("hash").mapInArrow(places, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def documents_with_seeds(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Documents with a seed in the bitmap: ``doc_id``, ``text_key`` (hash of the text), ``same``
    (hash of the words), ``words`` and ``hits`` (``hash`` and ``at``).  ``short`` lists the sizes of short items;
    of equal runs of such a size the first stands for all."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    hit = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(hit)]
    names = ["doc_id", "text_key", "same", "words", "hits"]

    def find(batches):
        bitmap, known = held.value, WordHashes()
        for batch in batches:
            rows = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                words = known.of(text)
                hits = []
                for made in seeds(words):
                    at = known_places(bitmap, made)
                    hits += zip(made[at].view(np.int64).tolist(), at.tolist())
                for size in short:
                    made = whole(words, size)
                    at = known_places(bitmap, made)
                    at = at[np.unique(made[at], return_index=True)[1]]
                    hits += zip(made[at].view(np.int64).tolist(), at.tolist())
                if hits:
                    same = xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63)
                    rows.append((doc, key, same, words.view(np.int64), [{"hash": h, "at": a} for h, a in hits]))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    schema = "doc_id long, text_key long, same long, words array<long>, hits array<struct<hash: long, at: int>>"
    return rows.mapInArrow(find, schema)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Where a document agrees with an item when its word ``shift`` meets the item's first:
    the item's first word of the overlap, its length and the words that agree; None if no window agrees enough.

    The overlap reaches from the first to the last window of ``WINDOW`` words that agrees.  Of an item
    of fewer than ``SHORT`` words all must agree.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if high - low < width:
        return None
    same = item[low:high] == doc[low + shift : high + shift]
    upto = np.concatenate([[0], np.cumsum(same)])
    need = AGREE if len(item) >= SHORT else 100
    good = np.flatnonzero((upto[width:] - upto[:-width]) * 100 >= need * width)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + width
    return low + a, b - a, int(upto[b] - upto[a])


def contaminated(docs: DataFrame, benchmark: DataFrame, fewest_words: int = 1) -> DataFrame:
    """Documents that hold passages of benchmark items, substitutions allowed.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``.  Words are runs of
    letters and digits in lower case.  A document and an item are returned if, at some
    shift, ``AGREE`` percent of ``WINDOW`` words in a row agree (of all words of a shorter
    item).  One row per document and distinct item text: ``doc_id``, ``text_key`` (xxhash64 of the
    document's text), ``item_id`` (the smallest with the item's text), ``doc_start``,
    ``item_start``, ``n_words`` and ``n_agree`` of the largest overlap.

    Every document that agrees so far with an item of at least ``WINDOW`` words is found.  Items of
    fewer words are found for certain verbatim, and with the substitutions listed at ``MASKS``; items of
    fewer than ``SHORT`` words only verbatim (``doc_start`` is the first such place).  Very short items are common
    in texts that hold no benchmark: ``fewest_words`` leaves out items of fewer words.
    NULL and empty texts, and items without words, match nothing.
    Repeated documents each get their rows; documents with the same words are compared once.
    Empty tables give an empty result.
    """
    items = checkpointed(benchmark_items(benchmark, max(1, fewest_words)))
    size = F.size("item_words").alias("size")
    short = sorted(r["size"] for r in items.where(size < SHORT).select(size).distinct().collect())  # under SHORT numbers
    made = checkpointed(item_seeds(items))
    found = checkpointed(documents_with_seeds(docs, bitmap(made), short))
    different = found.dropDuplicates(["same"])
    hits = different.select("same", F.explode("hits").alias("hit")).select("same", "hit.hash", "hit.at")
    pairs = hits.join(made, "hash").select("same", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = pairs.join(different.select("same", "words"), "same").join(items, "item")

    def verify(batches):
        for batch in batches:
            rows = []
            docs, items = batch.column("words"), batch.column("item_words")
            for i, shift in enumerate(batch.column("shift").to_pylist()):
                if (got := overlap(docs[i].values.to_numpy(), items[i].values.to_numpy(), shift)) is not None:
                    rows.append((i, got[0] + shift, *got))
            kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            spans = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(
                [kept.column("same"), kept.column("item_id"), *spans], ["same", "item_id", "doc_start", "item_start", "n_words", "n_agree"]
            )

    schema = "same long, item_id long, doc_start long, item_start long, n_words long, n_agree long"
    overlaps = pairs.select("same", "item_id", "shift", "words", "item_words").mapInArrow(verify, schema)
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_agree"), F.struct("n_agree", -F.col("doc_start"), "item_start"))
    overlaps = overlaps.groupBy("same", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "text_key", "same").join(overlaps, "same").select("doc_id", "text_key", "item_id", "best.*")
