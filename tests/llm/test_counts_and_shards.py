"""Token counts and sharding against direct computation."""

from collections import Counter as Tally

import pytest

from fieldloom.llm.sharding import assign_shards, fill_table
from fieldloom.llm.tokencounts import MARK, Counter, count_tokens, piece_costs
from tests.llm.conftest import EDGES
import public_tokenizers

PIECES, BYTE = piece_costs(public_tokenizers.path("piece_bpe_32k.model"))


def brute_count(word):
    """Cheapest split of one word by itself, from its end."""
    best = {len(word): (0, 0)}
    for i in range(len(word) - 1, -1, -1):
        options = []
        for j in range(i + 1, min(len(word), i + 40) + 1):
            if word[i:j] in PIECES:
                options.append((best[j][0] + PIECES[word[i:j]], best[j][1] + 1))
        if word[i] not in PIECES:
            n = len(word[i].encode())
            options.append((best[i + 1][0] + n * BYTE, best[i + 1][1] + n))
        best[i] = min(options)
    return best[0][1]


def test_counts_match_direct_computation(small, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in count_tokens(small[0]).collect()}
    known = {}
    for doc, text in texts.items():
        words = [MARK + w for w in text.encode().split() and [x.decode() for x in text.encode().split()]]
        for w in words:
            known[w] = known.get(w) or brute_count(w)
        assert got[doc] == (len(words), sum(known[w] for w in words))


def test_prefixes_are_worked_out_once():
    counter = Counter({"a": 1, "b": 1, "c": 1, "ab": 1}, 9)
    assert counter.count([["abc", "abb", "ab"], ["ab", "é"], []]) == [5, 3, 0]
    assert counter.nodes == 5  # a, ab, abb, abc and é


def test_long_words_are_counted_and_forgotten():
    counter = Counter({"a": 1, "b": 1}, 9)
    texts = [["a" * 64, "b" * 65, "ab" * 500], ["b" * 65]]
    assert counter.count(texts) == [1129, 65] and counter.count(texts) == [1129, 65]
    assert set(counter.known) == {"a" * 64}


def test_counts_of_edges(edges, nothing):
    rows = count_tokens(edges).collect()
    assert len(rows) == len(EDGES)
    assert all((r["n_tokens"] == 0) == (r["n_words"] == 0) for r in rows)
    assert count_tokens(nothing).count() == 0


def brute_table(shards, slots):
    import xxhash

    order = [[(xxhash.xxh64_intdigest(s, 1) + k * (xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    assert all(sorted(o) == list(range(slots)) for o in order)
    holder = {}
    while len(holder) < slots:
        for s in range(len(shards)):
            if len(holder) < slots:
                holder[next(p for p in order[s] if p not in holder)] = s
    return [holder[k] for k in range(slots)]


def test_table():
    names = [f"s{k}" for k in range(7)]
    assert fill_table(names, 251).tolist() == brute_table(names, 251)
    share = Tally(fill_table(names).tolist())
    assert max(share.values()) - min(share.values()) <= 1
    moved = sum(a != b for a, b in zip(fill_table(names).tolist(), fill_table(names[:-1]).tolist()))
    assert moved < 65_537 * 0.35  # a seventh had to move
    for bad in (([], 251), (["a", "a"], 251), (["a"], 250)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_placement(spark, edges, nothing):
    names = [f"s{k}" for k in range(5)]
    table = fill_table(names)
    rows = assign_shards(edges.withColumnRenamed("kept", "slot").withColumnRenamed("score", "shard"), names).collect()
    assert len(rows) == len(EDGES)
    assert all(r["shard"] == names[table[r["slot"]]] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1 == len({r["slot"] for r in rows if r["doc_id"] is None})
    assert assign_shards(nothing, names).count() == 0
