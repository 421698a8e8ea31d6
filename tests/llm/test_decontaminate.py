"""Spaced seeds: verbatim and changed passages are found, other texts are left alone."""

from itertools import combinations

import numpy as np
import pytest

from fieldloom.llm.decontaminate import MASKS, contaminated, is_set, bits_of, overlap, seeds
from tests.llm.conftest import EDGES

RNG = np.random.default_rng(5)
VOCABULARY = [f"v{k}" for k in range(3000)]


def words(n):
    return RNG.choice(VOCABULARY, n).tolist()


def benchmark_rows():
    return [(k, " ".join(words(int(RNG.integers(15, 60))))) for k in range(40)]


def brute(docs, items):
    """All pairs, all shifts."""
    out = set()
    for doc, text in docs:
        for item, said in items:
            a, b = (np.array(t.lower().split()) for t in (text, said))
            if len(b) and any(overlap(a, b, s) for s in range(-len(b), len(a))):
                out.add((doc, item))
    return out


def test_passages_are_found(spark):
    items = benchmark_rows()
    docs = [(k, " ".join(words(200))) for k in range(60)]
    planted = set()
    for k, (item, text) in enumerate(items):
        said = text.split()
        if k % 2:
            for at in range(4, len(said), 9):  # a substitution every nine words
                said[at] = "changed"
        before, after = words(30), words(40)
        docs.append((1000 + k, " ".join(before + said + after).upper()))
        planted.add((1000 + k, item))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted == brute(docs, items)
    assert {r["doc_start"] for r in rows} <= {30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40} and len(rows) == len(planted)


def test_on_the_tables(spark, sf):
    """Verbatim items: exactly the documents that hold one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {(d, r["item_id"]) for r in bench.collect() for d, t in texts if r["text"] in t}
    assert want <= got
    assert len(got - want) <= 2  # near copies with a changed word


def test_repeats_and_edges(spark, edges, nothing):
    item = " ".join(f"word{k}" for k in range(10, 25))
    bench = [(3, item), (2, item.upper()), (None, None), (9, ""), (4, "too short"), (5, "one two three")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    rows = contaminated(edges, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_agree"]) for r in rows) == [(0, 2, 15), (1, 2, 15), (1, 2, 15), (1, 5, 3), (1, 5, 3)]
    assert contaminated(nothing, bench).count() == 0
    assert contaminated(edges, bench.limit(0)).count() == 0
    assert len(EDGES) == edges.count()


@pytest.mark.parametrize("n, changed", [(13, 3), (14, 3), (12, 2), (11, 2), (10, 1), (9, 1), (8, 0)])
def test_masks_hit_every_pattern(n, changed):
    """All ways to substitute some of n words leave a seed that sees none of them."""
    for gone in combinations(range(n), changed):
        assert any(
            not {at + k for k, look in enumerate(mask) if look == "1"} & set(gone) for mask in MASKS for at in range(n - len(mask) + 1)
        ), gone


def test_all_substitutions_in_a_passage(spark):
    """A 13-word passage with every triple of words changed, each in a document of its own."""
    item = [f"q{k}" for k in range(13)]
    docs = []
    for n, gone in enumerate(combinations(range(13), 3)):
        said = [f"x{n}" if k in gone else w for k, w in enumerate(item)]
        docs.append((n, " ".join(words(5) + said + words(5))))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(range(286)) and {r["n_agree"] for r in rows} == {10}


def test_short_items_are_found_word_for_word(spark):
    """Items of one to seven words: exactly the documents that hold the run, as a plain search finds it."""
    items = [(n, " ".join(words(n))) for n in range(1, 8)] + [(20, " ".join(["again"] * 3)), (21, " ".join(["again"] * 4))]
    docs = [(k, " ".join(words(60))) for k in range(40)]
    for n, text in items:
        said = text.split()
        changed = [*said[:-1], "changed"]
        docs += [(100 + n, text.upper()), (200 + n, " ".join(words(3) + said + said + words(3))), (300 + n, " ".join(words(3) + changed))]
    docs += [(400, None), (401, ""), (402, docs[1][1])]
    want = {}
    for doc, text in docs:
        said = (text or "").lower().split()
        for item, run in items:
            run = run.split()
            at = [k for k in range(len(said) - len(run) + 1) if said[k : k + len(run)] == run]
            if at:
                want[doc, item] = (at[0], 0, len(run), len(run))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[2]): tuple(r[3:]) for r in contaminated(docs, items).collect()}
    assert got == want and len(want) >= 18
    assert {r["item_id"] for r in contaminated(docs, items, fewest_words=4).collect()} == {4, 5, 6, 7, 21}


def test_overlap():
    item = np.arange(20)
    doc = np.concatenate([np.full(5, -1), item, np.full(3, -2)])
    assert overlap(doc, item, 5) == (0, 20, 20)
    changed = doc.copy()
    changed[[7, 12, 17]] = -3
    assert overlap(changed, item, 5) == (0, 20, 17)
    assert overlap(doc, item, 6) is None and overlap(doc[:10], item, 5) is None


def test_bits():
    made = np.concatenate(list(seeds(np.arange(50, dtype=np.uint64))))
    bitmap = np.zeros(1 << 20, np.uint64)
    for bits in bits_of(made):
        np.bitwise_or.at(bitmap, bits >> np.uint64(6), np.uint64(1) << (bits & np.uint64(63)))
    assert all(is_set(bitmap, bits).all() for bits in bits_of(made))
    assert not list(seeds(np.zeros(0, np.uint64)))
