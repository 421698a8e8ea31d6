"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Each language has a tree of byte contexts of up to three bytes.  A byte's code length comes
from the longest known context: ``-log2(n / (total + distinct))`` if the byte was seen there
``n`` times, else an escape of ``-log2(distinct / (total + distinct))`` and the next shorter
context; below the empty context every byte costs eight bits (escape method C, no
exclusions).  A text's language is the one that codes all of its bytes in the fewest bits.
Statistics do not change while scoring, so a byte's cost depends on four bytes only, and
is looked up for whole batches at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import lowest_hashes

#: Labelled documents that each language is learned from, at most.
ROWS_PER_LANGUAGE = 300
#: Bytes of a document that is learned from, at most.
BYTES_PER_ROW = 1 << 16
ORDER = 3
#: Bytes scored in one go.
CHUNK = 4 << 20
UNDETERMINED = "und"

#: Letters in lower case, digits alike, white space and controls alike.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b < 33 or b == 127 else b for b in range(256)
)
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as superscripts, which also match, are none."""
    found = LETTER.search(text)
    while found and not found.group().isalpha():
        found = LETTER.search(text, found.end())
    return found is not None


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the three before it as one number, and where each text's bytes start."""
    pad = b" " * ORDER
    joined = np.frombuffer(b"".join(pad + t.translate(FOLD) for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + ORDER) - sizes - ORDER
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(begins - starts, sizes)
    key = joined[at]
    for k in range(1, ORDER + 1):
        key = key << np.uint32(8) | joined[at + k]
    return key, starts


class Contexts:
    """One language's counts of bytes after contexts of zero to three bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            keep = np.uint32((1 << 8 * (order + 1)) - 1)
            grams, back = np.unique(keys & keep, return_inverse=True)
            n = np.bincount(back, weights=counts)
            contexts, back = np.unique(grams >> np.uint32(8), return_inverse=True)
            self.orders.append((keep, grams, n, contexts, np.bincount(back, weights=n), np.bincount(back)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of the last byte of every key after its first three."""
        cost = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        for keep, grams, n, contexts, total, distinct in self.orders:
            gram = keys & keep
            at, known = _find(contexts, gram >> np.uint32(8))
            size = total[at] + distinct[at]
            here, seen = _find(grams, gram)
            ends = open_ & seen
            cost[ends] -= np.log2(n[here[ends]] / size[ends])
            escapes = open_ & known & ~seen
            cost[escapes] -= np.log2(distinct[at[escapes]] / size[escapes])
            open_ &= ~seen
        cost[open_] += 8.0
        return cost


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


class Model:
    """All languages, with the costs of every four bytes seen in learning worked out ahead."""

    def __init__(self, languages: list[str], contexts: list[Contexts]):
        self.languages, self.contexts = languages, contexts
        keys = np.unique(np.concatenate([c.orders[0][1] for c in contexts]))
        self.costs = self.bits(keys)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint32(32 - size.bit_length() + 1)
        self.slot_key = np.zeros(size, np.uint32)
        self.slot_row = np.full(size, -1, np.int32)
        rows = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(rows):
            free = self.slot_row[slot] < 0
            self.slot_row[slot[free]] = rows[free]
            left = self.slot_row[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (size - 1)
        used = self.slot_row >= 0
        self.slot_key[used] = keys[self.slot_row[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([c.bits(keys) for c in self.contexts], axis=1)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of ``costs`` for each key, -1 where it was not seen in learning."""
        slot = self._slot(keys)
        row = self.slot_row[slot]
        wrong = np.flatnonzero((row >= 0) & (self.slot_key[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.slot_row) - 1)
            row[wrong] = self.slot_row[slot]
            left = (row[wrong] >= 0) & (self.slot_key[slot] != keys[wrong])
            wrong, slot = wrong[left], slot[left]
        return row

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits per text and language; no text may be empty."""
        keys, starts = keys_of(texts)
        return np.add.reduceat(self.byte_costs(keys), starts, axis=0)

    def code_length(self, text: bytes, step: int = CHUNK) -> np.ndarray:
        """Bits of one text per language, ``step`` bytes at a time with the bytes before them as context."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(text), step):
            before = min(at, ORDER)
            keys, _ = keys_of([text[at - before : at + step]])
            total += self.byte_costs(keys[before:]).sum(axis=0)
        return total

    def byte_costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits per byte and language."""
        rows = self.rows(keys)
        new = rows < 0
        costs = self.costs
        if new.any():
            unseen, back = np.unique(keys[new], return_inverse=True)
            rows[new] = len(costs) + back
            costs = np.concatenate([costs, self.bits(unseen)])
        return costs[rows]


def learn(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_row: int = BYTES_PER_ROW) -> Model | None:
    """Learn a model from ``lang`` and ``text``; None if there is no labelled text.

    At most ``rows_per_language`` documents of each language count, each as a whole: of those of at
    most ``bytes_per_row`` bytes the ones whose ``doc_id`` and text hash lowest.  So the
    counts that reach the driver are bounded.  A language that has longer documents only is
    not learned.  Four-byte counts are summed on the executors.
    """
    rows = labelled.select(F.col("lang").cast("string"), "doc_id", F.col("text").cast("string"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text != ''").where(F.octet_length("text") <= bytes_per_row)
    rows = lowest_hashes(rows, "lang", rows_per_language, ["doc_id", "text"]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                keys, n = np.unique(keys_of([text.encode()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"]
                )

    counts = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    parts = [counts[counts["lang"] == name].sort_values("key") for name in languages]
    return Model(languages, [Contexts(p["key"].to_numpy(np.uint32), p["n"].to_numpy(np.float64)) for p in parts])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row of ``docs`` (``doc_id``, ``text``).

    ``score`` is the posterior share of the chosen language under equal priors.  A text that is
    NULL or has no letter gets ``und`` and 0, as does every text if nothing could be learned.
    Equal code lengths go to the language whose name sorts first.  Texts are scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang = np.full(len(texts), UNDETERMINED, object)
            share = np.zeros(len(texts))
            rows = [] if model is None else [i for i, t in enumerate(texts) if t and has_letter(t)]
            at = 0
            while at < len(rows):
                part, size = [], 0
                while at < len(rows) and size < CHUNK:
                    text = texts[rows[at]].encode()
                    if part and len(text) > CHUNK:
                        break
                    part.append((rows[at], text))
                    size += len(text)
                    at += 1
                if size > CHUNK and len(part) == 1:  # a very long text by itself, in pieces
                    bits = model.code_length(part[0][1])[None]
                else:
                    bits = model.code_lengths([t for _, t in part])
                best = bits.argmin(axis=1)
                where = [i for i, _ in part]
                lang[where] = np.array(model.languages, object)[best]
                share[where] = 1.0 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from learning; one without an id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents not held out that have a language, then predict all of them.

    Returns ``doc_id``, ``held_out``, ``lang_pred``, ``score``, one row per input row; an empty table
    gives an empty result.
    """
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()), rows_per_language)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
