"""Toxicity and personal data."""

import re
import zlib

import numpy as np
import pytest

from fieldloom.llm.bigru import BiGru, sigmoid
from fieldloom.llm.pii import IBAN_LENGTHS, detect, mask, summarize
from fieldloom.llm.toxicity import Corpus, classify, learn, score, score_texts, train, window_starts, windows_of, words_in
from tests.llm.conftest import EDGES

# The plain patterns of the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub(r"[^0-9]", "", m[0])
            holds = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if holds:
                out.append((m.start(), rank, m.end()))
    return [f"{list(PLAIN)[r]}:{s}:{e}" for s, r, e in sorted(out)]


TRICKY = [
    "a@b.c_d@e.f x@y.z@w.v @q.r a@b..c a@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3 999999999999999999999.1.1.1",
    "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1112 00000000000000 4111  1111 1111 1111",
    "+1 (202) 555-0142, +12, +1 2 3, ++4930123456 7890x, +1234567890123456",
    "é😀 é +49 30 1234567 é@é.é a@b.cé",
    "DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00, GB82WEST12345698765432",
    "my ssn is 123-45-6789 but 123-45-6789 alone" + " far" * 20 + " 987-65-4321",
    "9" * 5000 + " " + "a" * 5000 + "@" + "-" * 100 + " " + "+1" + "(" * 5000,
]


def test_spans_match_the_contract(spark, texts):
    docs = [*enumerate(TRICKY), *((100 + d, t) for d, t in texts.items()), (None, None), (-3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {}
    for r in detect(df).collect():
        spans.setdefault(r["row"], [r["doc_id"], []])[1].append(r)
    assert len(spans) == len(docs)
    found = sorted(
        (d is None, d or 0, [f"{r['kind']}:{r['start']}:{r['end']}" for r in sorted(rs, key=lambda r: (r["start"] or 0, r["rank"] or 0)) if r["kind"] in PLAIN])
        for d, rs in spans.values()
    )
    assert found == sorted((d is None, d or 0, base_spans(t)) for d, t in docs)
    by_text = {r["match"]: r["kind"] for _, rs in spans.values() for r in rs}
    assert by_text["DE89 3704 0044 0532 0130 00"] == by_text["GB82WEST12345698765432"] == "iban"
    assert by_text["123-45-6789"] == "ssn" and "987-65-4321" not in by_text and "DE88 3704 0044 0532 0130 00" not in by_text
    for _, rs in spans.values():
        for r in rs:
            text = dict((k if k is not None else -1, t) for k, t in docs)[r["doc_id"]] if r["kind"] else ""
            assert not r["kind"] or text[r["start"] : r["end"]] == r["match"]


def test_mask(spark):
    df = spark.createDataFrame([(1, t, 5) for t in TRICKY] + [(None, None, None), (2, "", 0)], "doc_id long, text string, _found int")
    out = mask(df)
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    assert texts[-2:] == [None, ""]
    for before, after in zip(TRICKY, texts):
        assert not base_spans(after)
        if not base_spans(before) and "iban" not in before and "DE89" not in before and "ssn" not in before:
            assert after == before
    assert "<IBAN>, DE88" in texts[5] and "<SSN> but" in texts[6] and "987-65-4321" in texts[6]


def account(country, length, seed):
    """A number of that length that passes mod 97, in groups of four."""
    rng = np.random.default_rng(seed)
    body = "".join(rng.choice(list("0123456789"), length - 4))
    said = int("".join(str(int(c, 36)) for c in body + country + "00"))
    whole = f"{country}{98 - said % 97:02d}{body}"
    return whole, " ".join(whole[k : k + 4] for k in range(0, length, 4))


def test_accounts_of_every_length(spark):
    """Each country's number, before a capitalised word, digits and the end; with blanks and without."""
    docs, want = [], {}
    for n, (length, country) in enumerate((length, c) for length, cs in IBAN_LENGTHS.items() for c in cs.split()):
        plain, spaced = account(country, length, n)
        for k, said in enumerate((f"pay {spaced} In time", f"pay {spaced} in time", f"{plain} 12", f"{plain}", f"({spaced})")):
            docs.append((10 * n + k, said))
            want[10 * n + k] = spaced if spaced in said else plain
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["match"] for r in detect(df).collect() if r["kind"] == "iban"} == want
    masked = {r["doc_id"]: r["text"] for r in mask(df).collect()}
    assert all(masked[d] == t.replace(want[d], "<IBAN>") for d, t in docs)


def test_pii_of_edges(edges, nothing):
    rows = summarize(detect(edges)).collect()
    assert len(rows) == len(EDGES)
    seven = next(r for r in rows if r["doc_id"] == 7)
    assert (seven["n_email"], seven["n_ip"], seven["n_card"], seven["n_phone"]) == (1, 1, 1, 1)
    assert summarize(detect(nothing)).count() == 0


def test_gradients():
    """Training follows the gradient: compared with finite differences."""
    model = BiGru(["good", "bad"], seed=1)
    corpus = Corpus(["good day to you all", "bad word here"])
    pad = len(corpus.words)
    windows = np.concatenate([windows_of(ids, pad)[:, :6] for ids in corpus.ids])
    windows[windows > pad] = pad
    labels = np.array([0, 1], np.float32)
    inputs = corpus.part(model, np.arange(pad))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    grads = {}
    model._adam = lambda g, rate: grads.update(g)
    model.train_step(*inputs, windows, labels, 0.0)

    def loss():
        chance = sigmoid(model.forward(model.vectors(*inputs), windows))
        return -np.mean(labels * np.log(chance) + (1 - labels) * np.log(1 - chance))

    rng = np.random.default_rng(0)
    for name, value in model.p.items():
        for _ in range(3):
            at = tuple(int(rng.integers(s)) for s in value.shape)
            if name == "char":
                at = (int(corpus.grams[0]), at[1])
            held = value[at]
            value[at] = held + 1e-2
            up = loss()
            value[at] = held - 1e-2
            down = loss()
            value[at] = held
            assert (up - down) / 2e-2 == pytest.approx(float(grads[name][at]), abs=2e-4), name


def plain_score(model, text):
    """The score spelled out: windows of 32 words every 24, one word, gate and state at a time."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    words = re.findall(r"[^\W_]+", text.lower()) if text else []
    vectors = []
    for w in words:
        raw = b"\x02" + w.encode() + b"\x03"
        grams = [((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 2654435761 % 2**32) >> 20 for k in range(len(raw) - 2)]
        vectors.append(np.concatenate([p["word"][model.vocabulary.get(w, 0)], sum(p["char"][g] for g in grams) / len(grams)]))
    h, best = p["h_f"].shape[0], -np.inf
    starts = [0]
    while starts[-1] + 32 < len(words):
        starts.append(starts[-1] + 24)
    for start in starts:
        window = vectors[start : start + 32]
        if not window:
            return None
        states = {"f": [], "b": []}
        for side, order in (("f", window), ("b", window[::-1])):
            s = np.zeros(h)
            for x in order:
                a, b = x @ p[f"x_{side}"] + p[f"x_bias_{side}"], s @ p[f"h_{side}"] + p[f"h_bias_{side}"]
                r, z = (1 / (1 + np.exp(-(a[k : k + h] + b[k : k + h]))) for k in (0, h))
                new = np.tanh(a[2 * h :] + r * b[2 * h :])
                s = (1 - z) * new + z * s
                states[side].append(s)
        both = [np.concatenate(pair) for pair in zip(states["f"], states["b"][::-1])]
        weights = np.array([np.exp(np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["attend_out"]) for s in both])
        pooled = sum(w * s for w, s in zip(weights / weights.sum(), both))
        best = max(best, float(pooled @ p["out"] + p["out_bias"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_match_plain_loops(texts):
    """A trained network's scores of whole documents against one word at a time."""
    rng = np.random.default_rng(12)
    plain = [f"p{k}é" for k in range(200)]
    said = [" ".join([*rng.choice(plain, 40), *(["dolt"] if k % 2 else [])]) for k in range(120)]
    model = train(said, np.arange(120) % 2)
    some = [t for t in [*texts.values()][:12] + said[:4] + ["one word", "DOLT", " ".join(plain)] if words_in(t)]
    assert score_texts(model, some) == pytest.approx([plain_score(model, t) for t in some], abs=2e-4)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts = window_starts(n)
        assert starts[0] == 0 and (n <= 32 or starts[-1] + 32 >= n)
        assert set(windows_of(np.arange(n), n).ravel()) - {n} == set(range(n))


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    known = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows.values())
    held = [(r["predicted"], t) for r, t in known if r["held_out"]]
    assert sum(p == t for p, t in held) > 0.9 * len(held)


def test_long_text_with_one_insult():
    rng = np.random.default_rng(8)
    plain = [f"p{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(300):
        said = rng.choice(plain, 60).tolist()
        if k % 3 == 0:
            said[int(rng.integers(60))] = rng.choice(["dolt", "oaf", "fool"])
        texts.append(" ".join(said))
        labels.append(int(k % 3 == 0))
    model = train(texts, np.array(labels))
    clean = " ".join(rng.choice(plain, 5000).tolist())
    scores = score_texts(model, [clean, clean + " DOLT!!! " + clean, "", None])
    assert scores[0] < 0.5 < scores[1] and (scores[2:] < 0.5).all()
    assert (score_texts(model, [clean, texts[0]]) == np.array([score_texts(model, [clean])[0], score_texts(model, [texts[0]])[0]])).all() or np.allclose(
        score_texts(model, [clean, texts[0]]), [score_texts(model, [clean])[0], score_texts(model, [texts[0]])[0]], atol=1e-5
    )


def test_toxicity_of_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (9, 1, 0), (None, 1, 1), (4, None, None), (7, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = classify(edges, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert classify(nothing, labels).count() == 0
    assert learn(edges, labels.limit(0)) is None
    with pytest.raises(ValueError):
        score(edges, None, "kept")
    assert words_in("Ab_c's ÉÀ 12!") == ["ab", "c", "s", "éà", "12"]
