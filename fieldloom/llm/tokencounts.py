"""Token counts under a unigram model, by dynamic programming shared along a trie.

The distinct pre-tokens of a batch, in sorted order, are the depth-first walk of their trie:
each shares with the one before it the nodes of their common prefix.  The best score of a
prefix depends on that prefix alone, so it is worked out once per trie node and kept on a
stack; the count at a word's last node is stored for the word.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import once_per_worker, words_of

#: Marks the start of a word in the pieces.
MARK = "▁"
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Characters of a pre-token that is remembered, at most.
LONGEST = 64
#: Texts whose new pre-tokens are walked together.
TOGETHER = 512
#: Unit of the scores: whole numbers, so that sums and ties are exact.
UNIT = 1000


def piece_costs(path: str) -> tuple[dict[str, int], int]:
    """The cost of every piece of a vocabulary file, and of a byte without one.

    The files hold ranks, not probabilities; a piece of rank ``r`` gets the probability of
    Zipf's law over the ranks, and its cost is minus the logarithm to base 2.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log2(sum(1 / (r + 1) for r in range(len(ids))))
    cost = lambda rank: round(UNIT * (math.log2(rank + 1) + total))
    return {model.id_to_piece(i): cost(r) for r, i in enumerate(ids)}, cost(len(ids))


class Counter:
    """Counts the pieces of pre-tokens on their cheapest split; equal costs go to fewer pieces.

    A character that is no piece is coded by its UTF-8 bytes, one token each.
    """

    def __init__(self, pieces: dict[str, int], byte_cost: int):
        self.pieces, self.byte_cost = pieces, byte_cost
        self.longest = max(map(len, pieces), default=1)
        self.known: dict[str, int] = {}
        self.nodes = 0  # trie nodes worked out so far

    def learn(self, words: set[str]) -> None:
        """Work out the counts of new pre-tokens."""
        pieces, longest = self.pieces, self.longest
        best: list[tuple[int, int]] = [(0, 0)]  # (cost, tokens) of every prefix on the stack
        before = ""
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                options = []
                for start in range(max(0, end - longest), end):
                    cost = pieces.get(word[start:end])
                    if cost is not None:
                        options.append((best[start][0] + cost, best[start][1] + 1))
                if word[end - 1] not in pieces:
                    n = len(word[end - 1].encode())
                    options.append((best[end - 1][0] + n * self.byte_cost, best[end - 1][1] + n))
                best.append(min(options))
                self.nodes += 1
            self.known[word] = best[-1][1]
            before = word

    def count(self, texts: list[list[str]]) -> list[int]:
        """Tokens of texts given as pre-tokens."""
        new = set().union(*texts).difference(self.known) if texts else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        self.learn(new)
        counts = [sum(map(self.known.__getitem__, words)) for words in texts]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        return counts


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of every row of ``docs`` (``doc_id``, ``text``).

    Pre-tokens are words ``[^\\x20\\x09-\\x0D]+`` with a mark in front.  ``vocabulary`` is the path of
    a sentencepiece file on the executors.  NULL, empty and blank texts have no tokens;
    repeated rows each get theirs.  Texts are counted whole.  An empty table gives an empty result.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches):
        counter = once_per_worker(("counter", path), lambda: Counter(*piece_costs(path)))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                raw = [words_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                words = [[MARK + w.decode() for w in ws] for ws in raw]
                n_words = pa.array([len(w) for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), n_words, pa.array(counter.count(words), pa.int64())], ["doc_id", "n_words", "n_tokens"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
