"""Sequence packing: exact round trip of the ids, gapless sequences, few of them."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import packing, tokens
from fieldloom.llm.bins import best_fit, pack, tightest
from fieldloom.llm.packing import numbered, pack_documents, pieces
from fieldloom.llm.tokens import SPLIT, Encoder, cut, starts_of
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_agrees_with_the_library(tokenizer, texts):
    encoder = Encoder(PATH)
    odd = ["it's they'LL 'tis ' s", " \n\n  x\t\ty  ", "a b\x0b\x1cc\x85d", "x<|endoftext|>y", "²½ ٣ Ⅷ ªº ×÷", "_a_ __", "日本語 text", ""]
    for text in [*odd, *(r[1] or "" for r in EDGES if r[0] != 5), *texts.values(), *odd]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(tokenizer, text)[:-1]


def test_bulk_split_matches_the_rule():
    rng = np.random.default_rng(2)
    signs = list("ab's'\"'tdmrelv  \n\t.,!19é€–Ñ")
    for n in rng.integers(1, 15, 20_000).tolist():
        text = "".join(rng.choice(signs, n))
        assert starts_of(text)[0].tolist() == [m.start() for m in SPLIT.finditer(text)], text


def test_bulk_encoding(tokenizer, texts, monkeypatch):
    """Small bulks, cut texts and a short memory give the same ids."""
    monkeypatch.setattr(tokens, "CHARACTERS", 100)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    some = [*texts.values()][:60] + ["", "x" * 5000, "  " * 500, "a b " * 300, "日本語 " * 90, "it's " * 99]
    assert [np.frombuffer(i, "<u4").tolist() for i in Encoder(PATH).encode_all(some)] == [ids_of(tokenizer, t)[:-1] for t in some]
    assert "".join(cut("one two  three  four " * 20, 7)) == "one two  three  four " * 20


def check(rows, docs, tokenizer, size=2048):
    """Pieces hold every document's ids; sequences have no gaps; returns how many there are."""
    cut = defaultdict(list)
    for doc, text in docs:
        ids = ids_of(tokenizer, text)
        stop = (len(ids) % size or size) if len(ids) > size else len(ids)
        start = piece = 0
        while start < len(ids):
            crc = zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())
            cut[doc].append((piece, start, stop - start, crc))
            start, stop, piece = stop, stop + size, piece + 1
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(p) for d, p in cut.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r["length"] for r in rows) // size)


def test_round_trip(small, texts, tokenizer):
    n, least = check(pack_documents(small[0]).collect(), texts.items(), tokenizer)
    assert n <= least + 1


def test_edges(edges, nothing, tokenizer):
    check(pack_documents(edges).collect(), [r[:2] for r in EDGES], tokenizer)
    assert pack_documents(nothing).count() == 0


def test_common_length_in_parts(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    docs = [(k, "same words") for k in range(50)] + [(None, "same words")] * 20 + [(3, "x " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(pack_documents(df).collect(), docs, tokenizer)
    rows = numbered(pieces(df)).collect()
    for length in {r["length"] for r in rows}:
        nth = sorted(r["nth"] for r in rows if r["length"] == length)
        assert nth == list(range(len(nth)))


def exact_bins(items, capacity):
    """The fewest bins, by trying all ways."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= items[k] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best


def test_bins_are_few():
    rng = np.random.default_rng(6)
    for _ in range(40):
        items = rng.integers(1, 20, 11)
        counts = np.bincount(items, minlength=21)
        packed = pack(counts, 20)
        used = np.zeros(21, int)
        for times, filling in packed:
            assert sum(length * n for length, n in filling) <= 20
            for length, n in filling:
                used[length] += times * n
        assert (used == counts).all()
        assert sum(t for t, _ in packed) <= sum(t for t, _ in best_fit(counts, 20))
        assert sum(t for t, _ in packed) == exact_bins(items.tolist(), 20)
    assert pack(np.zeros(10, int), 10) == []


def test_bins_of_many_pieces():
    """Ten to sixty pieces a bin: at most 0.2 % over the lower bound, and every piece is placed."""
    rng = np.random.default_rng(7)
    for low, high, n in ((100, 200, 100_000), (30, 60, 20_000), (30, 290, 20_000), (100, 200, 3_000)):
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=2048)
        packed = pack(counts, 2048)
        used = np.zeros(2048, int)
        for times, filling in packed:
            assert sum(length * many for length, many in filling) <= 2048
            for length, many in filling:
                used[length] += times * many
        assert (used == counts).all()
        least = -(-int((counts * np.arange(2048)).sum()) // 2048)
        assert sum(t for t, _ in packed) <= least + least // 500


def test_tightest_is_a_subset_sum():
    rng = np.random.default_rng(8)
    for _ in range(50):
        items = rng.integers(2, 30, 8).tolist()
        sums = {sum(x for k, x in enumerate(items) if pick >> k & 1) for pick in range(256)}
        space = int(rng.integers(1, 100))
        found = tightest(np.bincount(items, minlength=120), space)
        assert all(not Counter(f) - Counter(items) for f in found)
        assert {sum(f) for f in found} <= {max(s for s in sums if s <= space)} and bool(found) == any(x <= space for x in items)
