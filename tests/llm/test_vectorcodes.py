"""Vector codes against plain search and whole-number arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from fieldloom.llm.vectorcodes import Codebooks, compress, encode, learn

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, vector string"


def plain(rows, parts=16, entries=64):
    """The contract, spelled out: rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[k * width : (k + 1) * width]) for k in range(parts)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[cut(first[i])[p] for i in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        moved = []
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                groups.setdefault(near(x, book)[1], []).append(x)
            moved.append([tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(book)])
        books = moved
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, lab in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    return [(i, code, e, sum(f for _, _, f, other in coded if other == lab), digest) for i, code, e, lab in coded]


def found(df):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(([r[n] for n in names] for r in df.collect()), key=repr)


def made(rows):
    return [(i, v, lab, "x", "x", "x") for i, v, lab in rows]


@pytest.mark.parametrize("entries", [1, 2, 7, 64])
def test_search_matches_measuring_all(entries):
    """Small numbers, so that ties and equal entries are common."""
    rng = np.random.default_rng(entries)
    books = Codebooks(rng.integers(-3, 4, (3, entries, 2)))
    vectors = rng.integers(-5, 6, (500, 6))
    index, error = books.nearest(vectors)
    gaps = ((vectors.reshape(500, 3, 1, 2) - books.entries[None]) ** 2).sum(-1)
    assert (index == gaps.argmin(-1)).all() and (error == gaps.min(-1)).all()


def test_search_measures_few():
    rng = np.random.default_rng(1)
    books = Codebooks(rng.integers(-100, 100, (1, 64, 4)))
    books.nearest(rng.integers(-100, 100, (2000, 4)))
    assert books.measured < 0.75 * 2000 * 64


def test_matches_plain(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k) * 3 - 200, [float(x) for x in rng.normal(0, 0.02, 32).astype(np.float32)], int(rng.integers(3)) or None) for k in rng.permutation(150)]
    assert found(compress(spark.createDataFrame(made(rows), SCHEMA).repartition(5))) == sorted(map(list, plain(rows)), key=repr)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = [float(k % 5) - 2.25 for k in range(16)]
    rows = [
        (5, base, 1), (5, base, 1), (5, [x + 1 for x in base], 2), (None, [x / 3 for x in base], None), (None, base, None),
        (2, [-x for x in base], None), (1, None, 1), (3, [None, *base[1:]], 1), (4, [nan, *base[1:]], 1), (6, [*base[1:], -inf], 2), (7, base, 9),
    ]
    df = spark.createDataFrame(made(rows), SCHEMA)
    assert found(compress(df)) == sorted(map(list, plain(rows)), key=repr)
    assert compress(df.limit(0)).count() == 0
    assert compress(df.where("vec_id in (1, 3)")).count() == 0 and learn(df.where("vec_id = 1")) is None
    with pytest.raises(Exception, match="one length"):
        compress(spark.createDataFrame(made([(1, base, 1), (2, base * 2, 1)]), SCHEMA)).count()
    with pytest.raises(Exception, match="not supported"):
        compress(spark.createDataFrame(made([(1, [1e9] * 16, 1)]), SCHEMA)).count()


def test_codes_restore(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = learn(rows)
    vectors = {r["vec_id"]: np.floor(np.array(r["embedding"], np.float64) * 256) for r in rows.collect()}
    for r in encode(rows, books).collect():
        assert ((books.restored(r["code"]) - vectors[r["vec_id"]]) ** 2).sum() == r["error"]


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    from fieldloom.llm import vectorcodes

    rows = [(k, [float((k * 7 + j) % 11) for j in range(16)], k % 4 or None) for k in range(40)]
    monkeypatch.setattr(vectorcodes, "LABELS_SENT", 1)
    assert found(compress(spark.createDataFrame(made(rows), SCHEMA))) == sorted(map(list, plain(rows)), key=repr)
