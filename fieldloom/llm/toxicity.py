"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words.

The network of :mod:`bigru` is trained on the driver on a bounded sample of labelled
documents.  A label is about a whole document, so training first takes it for all
windows and then, in rounds, for a toxic document's highest-scored window only; a document
none of whose windows looks toxic by then is taken for mislabelled and left out.  Every
window of every document is scored; a document's score is that of its highest window.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import BiGru, sigmoid, trigrams
from .samples import lowest_hashes

#: Words per window, and words from one window's start to the next.
WINDOW, STRIDE = 32, 24
#: Labelled documents of each label that are learned from, at most, and their largest size in bytes.
SAMPLE, SAMPLE_BYTES = 1_000, 16_384
#: Words with a vector of their own: in so many sampled documents at least, and so many in all.
VOCABULARY, IN_DOCUMENTS = 4_000, 5
BATCH, RATE = 128, 0.01
ROUNDS, CLEAN_PER_TOXIC = 6, 8
#: Training steps before the first round and in each round, at least.
FIRST_STEPS, ROUND_STEPS = 50, 40
#: Log odds that a toxic document's highest window must have to be learned from in a round.
SURE = 2.5
#: Windows and words scored in one go.
WINDOWS, WORDS = 4_096, 100_000
WORD = re.compile(r"[^\W_]+")


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows that cover ``n`` words, overlapping; one even if there is none."""
    return np.arange(max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE


def windows_of(ids: np.ndarray, pad: int) -> np.ndarray:
    at = window_starts(len(ids))[:, None] + np.arange(WINDOW)
    return np.append(ids, pad)[np.minimum(at, len(ids))]


class Corpus:
    """Documents as windows over the distinct words that they hold."""

    def __init__(self, texts: list[str | None]):
        known: dict[str, int] = {}
        ids = []
        for text in texts:
            words = words_in(text)
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.words = list(known) or ["\x00"]
        self.ids = ids
        self.grams, self.sizes = trigrams(self.words)
        self.first = np.cumsum(self.sizes) - self.sizes

    def part(self, model: BiGru, rows: np.ndarray):
        """What the network needs of some words only."""
        sizes = self.sizes[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return model.word_rows([self.words[r] for r in rows]), self.grams[at], sizes


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> BiGru | None:
    """Train on whole texts with 0/1 labels; None unless both labels occur."""
    labels = np.asarray(labels, np.float32)
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    rng = np.random.default_rng(seed)
    corpus = Corpus(texts)
    found = Counter(i for ids in corpus.ids for i in np.unique(ids).tolist())
    often = sorted((w for w, n in found.items() if n >= IN_DOCUMENTS), key=lambda w: (-found[w], corpus.words[w]))
    model = BiGru([corpus.words[w] for w in often[:VOCABULARY]], seed)
    pad = len(corpus.words)
    each = [windows_of(ids, pad) for ids in corpus.ids]
    windows = np.concatenate(each)
    doc = np.repeat(np.arange(len(each)), [len(w) for w in each])
    toxic = labels[doc] == 1

    def fit(chosen: np.ndarray, rate: float, epochs: int, steps: int) -> None:
        """Go through the windows a number of times, and more often if that makes too few steps."""
        for _ in range(max(epochs, -(-steps * BATCH // max(1, len(chosen))))):
            order = rng.permutation(chosen)
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                rows, back = np.unique(windows[batch], return_inverse=True)
                back = back.reshape(len(batch), WINDOW)
                if rows[-1] == pad:
                    rows = rows[:-1]
                if len(rows):
                    model.train_step(*corpus.part(model, rows), back, toxic[batch].astype(np.float32), rate)

    clean = np.flatnonzero(~toxic)
    fit(np.concatenate([_some(rng, np.flatnonzero(toxic), 8 * SAMPLE), _some(rng, clean, 8 * SAMPLE)]), RATE, 1, FIRST_STEPS)
    for k in range(ROUNDS):
        logit = score_windows(model, corpus.part(model, np.arange(pad)), windows)
        order = np.lexsort((logit, doc))
        top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        top = top[toxic[top] & (logit[top] > SURE)]
        hard = clean[np.argsort(-logit[clean], kind="stable")[: len(top)]]
        fit(np.concatenate([top, hard, _some(rng, clean, CLEAN_PER_TOXIC * len(top))]), RATE * 0.6**k, 2, ROUND_STEPS)
    return model


def _some(rng, rows: np.ndarray, most: int) -> np.ndarray:
    return rows if len(rows) <= most else rng.choice(rows, most, replace=False)


def score_windows(model: BiGru, inputs, windows: np.ndarray) -> np.ndarray:
    vectors = model.vectors(*inputs)
    parts = [model.forward(vectors, windows[at : at + WINDOWS]) for at in range(0, len(windows), WINDOWS)]
    return np.concatenate(parts)


def score_texts(model: BiGru | None, texts: list[str | None]) -> np.ndarray:
    """The score of every text: the highest chance that one of its windows is toxic."""
    if model is None or not texts:
        return np.zeros(len(texts))
    corpus = Corpus(texts)
    pad = len(corpus.words)
    each = [windows_of(ids, pad) for ids in corpus.ids]
    logit = score_windows(model, corpus.part(model, np.arange(pad)), np.concatenate(each))
    starts = np.cumsum([0, *map(len, each[:-1])])
    return sigmoid(np.maximum.reduceat(logit.astype(np.float64), starts))


def groups(texts: list[str | None]):
    """Ranges of texts of about ``WORDS`` words (by length) each; one text is never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") // 6 + 1
        if size >= WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def held_out() -> Column:
    """Whether a document's label is kept from learning; never so without an id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> BiGru | None:
    """Train on labelled documents that are not held out.

    At most ``sample`` labels of each kind are taken, lowest hashes of the id first, and of their
    documents those of at most ``sample_bytes`` bytes.  A label other than 0 and 1 is ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = lowest_hashes(known.where(~held_out()).distinct(), "toxic", sample, ["doc_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "toxic"])  # 2 x sample small rows at most
    rows = rows.orderBy("doc_id", "toxic").toPandas()
    return train(rows["text"].tolist(), rows["toxic"].to_numpy())


def score(docs: DataFrame, model: BiGru | None, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score of ``text`` added as ``column``, which it must not have yet.

    NULL, empty and wordless texts are scored as a window without words.  Without a model
    every score is 0.  Texts are scored whole, a batch of documents at a time.
    """
    if column in docs.columns:
        raise ValueError(f"the documents have a column {column}")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [score_texts(model, texts[a:b]) for a, b in groups(texts)] or [np.zeros(0)]
            arrays = [*batch.columns, pa.array(np.concatenate(made))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(add, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` (``doc_id``, ``toxic``), then score every document.

    Returns ``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.5 on), one row
    per input row, repeated ones and those without an id included.  An empty table gives an empty result.
    """
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = score(rows, model, "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
