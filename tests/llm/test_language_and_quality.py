"""Language identification and quality rules."""

import math
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm.langid import FOLD, Contexts, Model, has_letter, identify, keys_of, predict
from fieldloom.llm.quality import bin_of, bin_start, counts_of, judge, repeat_words
from pyspark.sql import functions as F
from tests.llm.conftest import EDGES


class Tree:
    """PPM by the book, a byte at a time."""

    def __init__(self, texts):
        self.after = defaultdict(lambda: defaultdict(int))
        for text in texts:
            padded = b"   " + text.translate(FOLD)
            for k in range(3, len(padded)):
                for order in range(4):
                    self.after[padded[k - order : k]][padded[k]] += 1

    def bits(self, text):
        padded = b"   " + text.translate(FOLD)
        total = 0.0
        for k in range(3, len(padded)):
            for order in (3, 2, 1, 0):
                seen = self.after.get(padded[k - order : k])
                if seen is None:
                    continue
                size = sum(seen.values()) + len(seen)
                if padded[k] in seen:
                    total -= math.log2(seen[padded[k]] / size)
                    break
                total -= math.log2(len(seen) / size)
            else:
                total += 8
        return total


def contexts(texts):
    import numpy as np

    keys, n = np.unique(keys_of(texts)[0], return_counts=True)
    return Contexts(keys, n.astype(float))


def test_code_lengths_match_the_tree():
    learned = {"de": ["Die Straße ist naß.".encode(), b"Das ist ein Haus"], "en": [b"the house is on the street 12", b"a"]}
    model = Model(list(learned), [contexts(t) for t in learned.values()])
    trees = [Tree(t) for t in learned.values()]
    texts = ["Das Haus", "the thing is", "漢字 z 99", "Ñ", "x" * 500]
    got = model.code_lengths([t.encode() for t in texts])
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx([t.bits(text.encode()) for t in trees])


def test_long_texts_in_pieces_cost_the_same(spark, monkeypatch):
    import fieldloom.llm.langid as langid

    model = Model(["de", "en"], [contexts([b"Das ist ein Haus und ein Baum"]), contexts([b"the house is on the street"])])
    text = ("Das Haus is on the Straße, 漢字 " * 9).encode()
    whole = model.code_lengths([text])[0].tolist()
    for step in (1, 2, 3, 4, 50, len(text), 10**6):
        assert model.code_length(text, step).tolist() == pytest.approx(whole)
    rows = [(0, "Das ist"), (1, "das Haus " * 40), (2, "the street"), (3, None), (4, "on the house " * 30), (5, "a" * 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {tuple(r)[:2] for r in predict(docs, model).collect()}
    monkeypatch.setattr(langid, "CHUNK", 20)
    got = {tuple(r)[:2] for r in predict(docs, model).collect()}
    assert got == want and len(got) == len(rows)


def test_long_documents_are_not_learned_from(spark):
    from fieldloom.llm.langid import learn

    rows = [(1, "das Haus", "de"), (2, "the house " * 50, "en"), (3, "la casa", "es")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(labelled, bytes_per_row=100).languages == ["de", "es"]
    assert learn(labelled).languages == ["de", "en", "es"]
    assert learn(labelled, bytes_per_row=1) is None


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in identify(docs).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows) and len(rows) > 250
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) > 0.98 * len(rows)


def test_language_of_edges(spark, edges, nothing):
    rows = identify(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert identify(nothing).count() == 0
    unlearned = predict(edges, None)
    assert {(r["lang_pred"], r["score"]) for r in unlearned.collect()} == {("und", 0.0)}


def test_letters():
    assert [has_letter(t) for t in ("1 ² ½ _ 12", "²½é", "漢", " ", "Ⅷx")] == [False, True, True, False, True]


def test_labels_held_out_are_not_learned_from(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1]
    df = spark.createDataFrame([(k, "some words here", "xx") for k in ids], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify(df).collect()} == {"und"}


def brute_repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_counts():
    for text in ("a b c a b c", "a a a a", "x y z", "", "p q r s p q t p q r"):
        assert repeat_words(text.split()) == brute_repeat_words(text.split())
    assert counts_of("é#\x0b b\n\n b\n b\nb ") == (5, 6, 1, 4, 1, 4)
    assert counts_of(None) == (0, 0, 0, 0, 0, 0)


def test_bins_hold_their_numbers(spark):
    values = spark.range(0, 5000).union(spark.range(10**9, 10**9 + 50))
    rows = values.select("id", bin_of(F.col("id")).alias("b")).withColumn("s", bin_start(F.col("b"))).collect()
    for r in rows:
        assert r["s"] <= r["id"] <= r["s"] * 33 / 32 + 1
    assert sorted(rows, key=lambda r: r["id"]) == sorted(rows, key=lambda r: r["b"])


def test_thresholds_follow_the_group(spark):
    words = " ".join(f"w{k}" for k in range(80))
    noisy = " ".join(f"w{k}#" for k in range(80))
    rows = [(k, words, "en", "plain") for k in range(30)] + [(100, noisy, "en", "plain")]
    rows += [(200 + k, noisy, "en", "tables") for k in range(30)]
    got = {r["doc_id"]: r["kept"] for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(100) and all(got.values())


def test_quality_of_edges(edges, nothing):
    rows = judge(edges).collect()
    assert len(rows) == len(EDGES)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] == 0)
    assert judge(nothing).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    from fieldloom.llm.samples import lowest_hashes

    df = spark.range(5000).selectExpr("id AS k", "CASE WHEN id % 50 = 0 THEN 'rare' ELSE 'hot' END AS g", "0 AS _at")
    got = lowest_hashes(df, "g", 120, ["k"])
    rows = sorted((r.g, r.k) for r in got.collect())
    assert got.columns == df.columns
    assert [g for g, _ in rows] == ["hot"] * 120 + ["rare"] * 100
    assert rows == sorted((r.g, r.k) for r in lowest_hashes(df.repartition(7), "g", 120, ["k"]).collect())
