"""Fill-in-the-middle outputs and their restoration against plain string work."""

import hashlib

import pytest

from fieldloom.llm.middles import Parts, Rule, fill_in_middle, fim_pieces, fim_texts, parts_of
from tests.llm.conftest import EDGES


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    else:
        form, out = "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    sizes = (None, None) if form == "plain" else (a, b - a)
    said = hashlib.sha256(out.encode()).hexdigest()
    return (doc_id, n, form, *sizes, said, hashlib.sha256(text.encode()).hexdigest()), out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


MARKED = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M", "<", "<<P", "<P", "S>", "é😀漢" * 9, "<M>" * 3, "a<" * 40, "\x00z", "<P<S<M"])]


@pytest.mark.parametrize("piece", [1, 3, 1 << 16])
def test_matches_plain(spark, piece):
    docs = [(100 * i + k, t) for i in range(8) for k, t in MARKED] + [(k, "word " * (k % 40)) for k in range(2000, 2100)]
    rows = fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), piece=piece).collect()
    assert ordered(rows) == ordered(plain(d, t)[0] for d, t in docs)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_edges(edges, nothing):
    assert ordered(fill_in_middle(edges, piece=1000).collect()) == ordered(plain(*r[:2])[0] for r in EDGES)
    assert fill_in_middle(nothing).count() == 0


def test_copies_in_one_partition_and_many(spark):
    docs = [(4, "the same text " * 20)] * 50 + [(5, None)] * 3 + [(5, "")] * 2
    for parts in (1, 7):
        rows = fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), piece=30).collect()
        assert ordered(rows) == ordered(plain(d, t)[0] for d, t in docs)


def test_texts(spark, small, texts):
    rows = fim_texts(fim_pieces(small[0], piece=100)).collect()
    assert {r["doc_id"]: (r["form"], r["output"]) for r in rows} == {d: (plain(d, t)[0][2], plain(d, t)[1]) for d, t in texts.items()}


def test_rules(spark):
    rule = Rule(changed=100, spm=100, marks=("[a]", "[bb]", "[c]"))
    docs = [(k, f"text [b {k}" * 3) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fill_in_middle(df, rule, 2).collect()
    assert {r["form"] for r in rows} == {"spm"}
    assert {r["doc_id"]: r["restored_sha256"] for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in docs}


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_parser_at_all_cuts(form):
    rule, text = Rule(), "ab<<S<é"
    for a in range(len(text) + 1):
        out = "".join(parts_of(text, form, a, a, rule)).encode()
        for step in (1, 2, 3, len(out)):
            parser, got = Parts(form, rule), {0: b"", 1: b"", 2: b""}
            for at in range(0, len(out), step):
                for place, part in parser.feed(out[at : at + step]):
                    got[place] += part
            parser.end()
            assert b"".join(got[k] for k in range(3)).decode() == text


def test_lost_mark_is_an_error():
    parser = Parts("psm", Rule())
    list(parser.feed(b"<P>abc<M>"))
    with pytest.raises(ValueError):
        parser.end()


def test_one_shuffle(small):
    plan = fill_in_middle(small[0].sparkSession.read.parquet(f"{small[1]}/documents.parquet"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
