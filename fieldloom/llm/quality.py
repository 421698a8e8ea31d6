"""Quality rules with thresholds that follow each language and source.

Whole-text counts are taken per document.  Documents that pass the base rules feed, per
language and source, one quantile sketch per measure: a histogram whose bins hold whole
numbers up to 63 exactly and larger ones to 1/32 of their size.  Sketches merge by adding
counts, so Spark builds them with partial sums, and they do not depend on the order of
rows.  Fences read from the sketches are joined back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpointed

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Measure:
    """A share in ten-thousandths; ``spread`` is the least quartile distance assumed of it."""

    name: str
    top: str
    bottom: str
    spread: int
    low: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 5_000, low=True),
    Measure("symbols", "n_symbols", "n_words", 500),
    Measure("dup_lines", "n_dup_lines", "n_lines", 1_500),
    Measure("repeats", "n_repeat_words", "n_words", 1_000),
)
#: Quartile distances beyond a quartile at which a document is an outlier.
REACH = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list) -> int:
    """Words in a window of three words that occurs twice or more, its first place included."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 2_000_000:  # keeps the numbers below within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[back] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS``; NULL counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the ``COUNTS`` and ``base_failed`` of every row."""

    def count(batches):
        for batch in batches:
            rows = [counts_of(t) for t in batch.column("text").to_pylist()]
            made = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            keys = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(np.ascontiguousarray(c)) for c in made.T], ["doc_id", "lang", "source", *COUNTS]
            )

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(count, schema).withColumn("base_failed", failed)


def share(m: Measure) -> Column:
    return F.expr(f"10000 * {m.top} div {m.bottom}")


def bin_of(value: Column) -> Column:
    """The sketch's bin of a whole number from 0 on."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function("shiftright", value, shift))


def bin_start(bin_: Column) -> Column:
    """The smallest number of a bin."""
    shift = (F.floor(bin_ / 32) - 1).cast("int")
    return F.when(bin_ < 64, bin_).otherwise(F.call_function("shiftleft", bin_ - shift * 32, shift))


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable histograms: ``lang``, ``source``, ``measure``, ``bin``, ``n``, over documents that
    pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), bin_of(share(m)).alias("bin")) for m in MEASURES]))
    rows = measured.where(~F.col("base_failed")).select("lang", "source", each.alias("s"))
    return rows.groupBy("lang", "source", F.col("s.measure"), F.col("s.bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """The smallest and largest accepted value per ``lang``, ``source`` and measure, one row a
    group: a quartile moved out by ``REACH`` quartile distances."""
    group = ["lang", "source", "measure"]
    upto = F.sum("n").over(W.partitionBy(*group).orderBy("bin"))  # as many rows as the sketch has bins
    total = F.sum("n").over(W.partitionBy(*group))
    at = sketch.withColumns({"upto": upto, "total": total, "value": bin_start(F.col("bin"))})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("value")))
    at = at.groupBy(*group).agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    out = []
    for m in MEASURES:
        of = lambda c: F.max(F.when(F.col("measure") == m.name, c))  # noqa: B023, E731
        wide = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(m.spread))
        out += [of(F.col("q1") - wide).alias(f"least_{m.name}"), of(F.col("q3") + wide).alias(f"most_{m.name}")]
    return at.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Measure every document and keep those that pass the base rules and lie within the
    fences of their language and source.

    Takes ``doc_id``, ``text``, ``lang``, ``source``.  Returns ``doc_id``, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``,
    one row per input row.  NULL or empty text has no words and fails the base rules.  NULL
    languages or sources form a group of their own.  Repeated rows each count.
    """
    measured = checkpointed(measure(docs))
    limits = fences(sketches(measured)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = ~F.col("base_failed")
    for m in MEASURES:
        value = F.when(~F.col("base_failed"), share(m))
        inside = inside & (value <= F.col(f"most_{m.name}"))
        if m.low:
            inside = inside & (value >= F.col(f"least_{m.name}"))
    kept = F.coalesce(inside, F.lit(False)).alias("kept")
    return measured.join(limits, same, "left").select(
        "doc_id", *[c for c in COUNTS if c != "n_lines"], "base_failed", kept
    )


def _sql() -> str:
    def in_bins(v: str) -> str:
        return f"CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)) END"

    shares = ", ".join(f"10000 * {m.top} // {m.bottom} AS {m.name}" for m in MEASURES)
    parts = " UNION ALL ".join(
        f"SELECT lang, source, '{m.name}' AS measure, {in_bins(m.name)} AS bin FROM shares WHERE NOT base_failed" for m in MEASURES
    )
    limits = ", ".join(
        f"max({edge}) FILTER (measure = '{m.name}') AS {side}_{m.name}"
        for m in MEASURES
        for side, edge in (
            ("least", f"q1 - {REACH} * greatest(q3 - q1, {m.spread})"),
            ("most", f"q3 + {REACH} * greatest(q3 - q1, {m.spread})"),
        )
    )
    tests = " AND ".join(
        f"s.{m.name} <= f.most_{m.name}" + (f" AND s.{m.name} >= f.least_{m.name}" if m.low else "") for m in MEASURES
    )
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words FROM d),
grams AS (SELECT rn, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rn, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY rn, gram) > 1),
repeats AS (SELECT rn, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY rn),
lines AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY rn),
counts AS (SELECT rn, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rn) LEFT JOIN repeats USING (rn)),
shares AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {shares} FROM counts),
sketch AS (SELECT lang, source, measure, bin, count(*) AS n FROM ({parts}) GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto,
  sum(n) OVER (PARTITION BY lang, source, measure) AS total,
  CASE WHEN bin < 64 THEN bin ELSE (bin - (bin // 32 - 1) * 32) << (bin // 32 - 1)::INT END AS value FROM sketch),
quartiles AS (SELECT lang, source, measure, min(value) FILTER (upto * 4 >= total) AS q1,
  min(value) FILTER (upto * 4 >= total * 3) AS q3 FROM upto GROUP BY ALL),
fences AS (SELECT lang, source, {limits} FROM quartiles GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {tests}, false) AS kept
FROM shares AS s LEFT JOIN fences AS f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
"""


SQL = _sql()
