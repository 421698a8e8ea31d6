"""SimHash near-duplicates and repeated passages against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from fieldloom.llm import simhash, substrings
from fieldloom.llm.components import connected_components
from fieldloom.llm.simhash import close_pairs, fingerprint_of, merge_labels, near_duplicates
from fieldloom.llm.substrings import from_bytes, remove_repeats, to_bytes
from tests.llm.conftest import EDGES

WORD = r"[^\x20\x09-\x0D]+"


def brute_fingerprint(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], radius=2) -> list[int]:
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def expected_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    low = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            low[x] = min(low.get(x, doc), doc)
    return Counter((doc, p, low.get(x)) for (doc, _), p, x in zip(rows, prints, label))


def found_groups(df):
    return Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in near_duplicates(df).collect())


def test_groups_match_brute_force(small, texts):
    assert found_groups(small[0]) == expected_groups(sorted(texts.items()))


def test_groups_of_edges(edges, nothing):
    assert found_groups(edges) == expected_groups([r[:2] for r in EDGES])
    assert near_duplicates(nothing).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    """Few distinct words make many close fingerprints; buckets are cut into parts of four."""
    monkeypatch.setattr(simhash, "PART", 4)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 12, n)) for b in base for n in range(5) for _ in range(12)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.close_links(df)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components(prints)
    assert [roots.get(p, p) for p in prints] == [prints[x] for x in want]


def test_close_pairs_are_exact():
    rng = np.random.default_rng(2)
    sizes = [1, 70, 3, 130, 2]
    prints = np.concatenate([rng.integers(0, 2**63) ^ (rng.integers(0, 2**14, n) & rng.integers(0, 2**14, n)) for n in sizes]).astype(np.uint64)
    later = np.concatenate([np.arange(n)[::-1] for n in sizes])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    for radius in (0, 2, 3):
        got = {(int(a), int(b)) for i, j in close_pairs(prints, later, list(range(64)), radius) for a, b in zip(i, j)}
        want = {
            (i, j)
            for i in range(len(prints))
            for j in range(i + 1, len(prints))
            if bucket[i] == bucket[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius
        }
        assert got == want


def test_labels():
    labels = merge_labels(np.arange(6), np.array([4, 2, 3]), np.array([5, 4, 3]))
    assert labels.tolist() == [0, 1, 2, 3, 2, 2]


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b").union(spark.createDataFrame([(500, 400), (7, 7)], "a long, b long"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 200)} | {500: 400}


def test_fingerprint_majority_over_parts():
    text = " ".join(f"w{k % 70_000}" for k in range(70_010))
    assert fingerprint_of(text.encode()) == brute_fingerprint(text)


def brute_repeats(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        words = re.findall(WORD, rows[i][1] or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((rows[i][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found_repeats(df):
    return Counter(
        (r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in remove_repeats(df).collect()
    )


def test_repeats_across_chunks(small, texts, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    assert found_repeats(small[0]) == brute_repeats(sorted(texts.items()))


def test_repeats_with_few_words(spark, monkeypatch):
    """Windows that differ in a word only, at all alignments, over many small chunks."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1)
    rng = np.random.default_rng(3)
    rows = [(int(k), " ".join(rng.choice(["a", "b"], p=[0.97, 0.03], size=rng.integers(0, 90)).tolist())) for k in rng.permutation(60)]
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_repeats(rows)


def test_repeats_of_edges(edges, nothing):
    got = found_repeats(edges.coalesce(1))
    assert got == brute_repeats([r[:2] for r in EDGES])
    assert remove_repeats(nothing).count() == 0


def test_blocks_round_trip():
    values = np.sort(np.random.default_rng(4).integers(0, 2**63, 1000).astype(np.uint64))
    assert (from_bytes(to_bytes(values, True), True) == values).all()
    assert (from_bytes(to_bytes(values[::-1])) == values[::-1]).all()
    assert len(from_bytes(to_bytes(values[:0]))) == 0
