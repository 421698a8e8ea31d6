"""Directly addressable codes: single ids, ranges, segments, files."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import tokenfiles
from fieldloom.llm.tokenfiles import BLOCK, Segment, read_tokens, segment, token_files, write_tokens
from tests.llm.conftest import EDGES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK, 5000])
@pytest.mark.parametrize("top", [1, 255, 256, 50_257, 1 << 24, (1 << 32) - 1])
def test_every_id_and_range(n, top):
    rng = np.random.default_rng(n + top)
    ids = (rng.integers(0, top, n, endpoint=True) >> rng.integers(0, 33, n)).astype("<u4")
    found = Segment(segment([1], [ids.tobytes()]))
    assert found.n_ids == n and (found.ids(0, n) == ids).all()
    for at in {*range(min(n, 70)), *rng.integers(0, n, min(n, 200)).tolist()}:
        assert found[at] == ids[at]
    for _ in range(30):
        a, b = sorted(rng.integers(0, n, 2, endpoint=True).tolist())
        assert (found.ids(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        found[n]


def test_segment_documents():
    texts = [np.arange(k, dtype="<u4") * 999 for k in (3, 0, 700, 1)]
    found = Segment(segment([5, None, -(1 << 63), 0], [t.tobytes() for t in texts]))
    assert found.doc_ids.tolist()[0::2] == [5, -(1 << 63)] and found.has_id.tolist() == [True, False, True, True]
    for t, a, b in zip(texts, found.starts, found.starts[1:]):
        assert (found.ids(int(a), int(b)) == t).all()
    with pytest.raises(ValueError):
        Segment(b"x" * 100)


def expected(tokenizer, rows):
    """Rows of (doc_id, text), those of the same id in the order given."""
    out, at = [], 0
    for doc, text in rows:
        ids = ids_of(tokenizer, text)
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def found(df):
    return [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()]


@pytest.mark.parametrize("size", [50, tokenfiles.SEGMENT])
def test_files(spark, small, texts, tokenizer, tmp_path, size):
    path = str(tmp_path / "tokens")
    write_tokens(small[0], path, size=size)
    assert sorted(found(read_tokens(spark, path))) == expected(tokenizer, sorted(texts.items()))
    assert spark.read.parquet(path).count() >= (len(texts) // 2 if size == 50 else 1)


def test_edges(edges, nothing, tokenizer):
    rows = sorted(found(token_files(edges)), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((r[0] for r in EDGES), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in rows] == np.cumsum([0, *[r[2] for r in rows[:-1]]]).tolist()
    assert sorted((r[0] or 0, *r[2:]) for r in rows) == sorted((d or 0, *e) for d, _, *e in expected(tokenizer, [r[:2] for r in EDGES]))
    assert token_files(nothing).count() == 0


def test_many_equal_ids_spread(spark, tmp_path):
    path = str(tmp_path / "equal")
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "'the same row' AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tokens(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    starts = sorted(r["start"] for r in read_tokens(spark, path).collect())
    assert len(starts) == 20_000 and np.ptp(np.diff(starts)) == 0
