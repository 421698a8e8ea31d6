"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used.  The patterns are possessive forms of the plain ones in
``KINDS`` (same matches, but linear time and no recursion on very long runs of one class).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


# The published lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def iban_pattern() -> str:
    """Account numbers of exactly their country's length, with or without a blank between groups of four."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    return "(?:" + "|".join(forms) + ")"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``sure`` is the score of a confirmed match without context; a context word adds
    ``CONTEXT`` to it.  ``needs`` is a substring that every match holds, for a quick look.
    """

    name: str
    pattern: str
    sure: float
    context: tuple[str, ...]
    needs: str = ""


#: In the order in which spans that start together are listed.  The first four are always
#: reported once confirmed: their score alone reaches the threshold.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        ("mail", "contact"),
        "@",
    ),
    Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", 0.6, ("ip", "host", "server"), "."),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.8, ("card", "visa", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "mobile"), "+"),
    Kind("iban", "(?=[A-Z]{2}[0-9]{2})" + iban_pattern(), 0.7, ("iban", "account", "bank")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, ("ssn", "social", "security", "taxpayer"), "-"),
)
CONTEXT = 0.3
THRESHOLD = 0.5
#: Characters looked at before a match for context words.
NEAR = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def confirmed(kind: str, match: Column) -> Column:
    """Whether the checksum or the number ranges of a kind hold for a match."""
    if kind == "ip":
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (
            F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(F.replace(match, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


def _mod97(account: Column) -> Column:
    """The remainder of an account number, first four characters moved to its end, letters as 10 to 35."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        digit = char.between("0", "9")
        value = F.when(digit, F.ascii(char) - 48).otherwise(F.ascii(char) - 55)
        return F.pmod(rest * F.when(digit, 10).otherwise(100) + value, F.lit(97)).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def score(kind: Kind, before: Column) -> Column:
    """The score of a confirmed match, given the characters before it."""
    near = F.lower(F.right(before, F.lit(NEAR)))
    named = reduce(lambda a, b: a | b, [F.contains(near, F.lit(word)) for word in kind.context])
    return F.lit(kind.sure) + F.when(named, CONTEXT).otherwise(0.0)


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def detect(docs: DataFrame) -> DataFrame:
    """Find personal data in ``docs`` (``doc_id``, ``text``; other columns are not looked at).

    One row per confirmed span with a score of at least ``THRESHOLD``: ``row`` (a number for
    the input row), ``doc_id``, ``rank`` and ``kind``, ``start`` and ``end`` in code points (end
    exclusive), ``match``, ``score``.  A document without any gives one row with NULL ``kind``,
    so every input row appears, repeated ones and those with NULL ids too.  NULL text counts as
    empty.  Matches are leftmost and do not overlap within a kind; spans of different kinds may.

    ``split`` gives what lies between the matches; running sums of lengths then give places.
    They run per input row, so no group is larger than one text.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({f"m_{k.name}": _matches(F.col("text"), k) for k in KINDS})
    per_kind = []
    for rank, k in enumerate(KINDS):
        m = F.col(f"m_{k.name}")
        gaps = F.when(F.size(m) > 0, F.split("text", k.pattern, -1))
        place = F.transform(
            F.arrays_zip(m.alias("match"), F.slice(gaps, 1, F.size(m)).alias("gap")),
            lambda x: F.struct(x["match"].alias("match"), F.length(x["gap"]).alias("skip"), F.right(x["gap"], F.lit(NEAR)).alias("before")),
        )
        per_kind.append(F.when(F.size(m) > 0, F.struct(F.lit(rank).alias("rank"), place.alias("places"))))
    kinds = F.filter(F.array(*per_kind), lambda x: x.isNotNull())
    rows = rows.select("row", "doc_id", F.explode_outer(kinds).alias("k"))
    rows = rows.select("row", "doc_id", "k.rank", F.posexplode_outer("k.places").alias("at", "place"))
    rows = rows.select("row", "doc_id", "rank", "at", "place.*").repartition("row")
    upto = W.partitionBy("row", "rank").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("skip") + F.length("match")).over(upto).cast("long"))
    pick = lambda of: reduce(
        lambda when, rk: when.when(F.col("rank") == rk[0], of(rk[1])), enumerate(KINDS), F.when(F.lit(False), of(KINDS[0]))
    )
    rows = rows.withColumn("holds", pick(lambda k: confirmed(k.name, F.col("match"))))
    rows = rows.withColumn("score", F.when(F.col("holds"), pick(lambda k: score(k, F.col("before")))))
    found = F.col("score") >= THRESHOLD
    kind = F.when(found, F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1))
    return rows.select(
        "row",
        "doc_id",
        F.when(found, F.col("rank")).alias("rank"),
        kind.alias("kind"),
        F.when(found, F.col("end") - F.length("match")).alias("start"),
        F.when(found, F.col("end")).alias("end"),
        F.when(found, F.col("match")).alias("match"),
        F.when(found, F.col("score")).alias("score"),
    )


def summarize(spans: DataFrame) -> DataFrame:
    """One row per input row of :func:`detect`: counts per kind and the list of spans as text."""
    base = [k.name for k in KINDS[:4]]
    listed = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("said"))
    has = F.col("kind").isNotNull()
    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        F.array_sort(F.collect_list(F.when(has, listed))).alias("all"),
    )
    said = lambda spans: F.array_join(F.transform(spans, lambda x: x["said"]), ",")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in base],
        F.sha2(said(F.filter("all", lambda x: x["rank"] < len(base))), 256).alias("base_sha256"),
        said(F.col("all")).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with confirmed personal data in ``text`` replaced by ``<KIND>``; NULL stays NULL.

    All columns are kept.  Kinds are replaced one after another, those that can hold others
    first; nothing is shuffled.
    """
    columns = docs.columns
    held = "_found"
    while held in columns:
        held += "_"
    for name in ("email", "iban", "phone", "card", "ip", "ssn"):
        kind = next(k for k in KINDS if k.name == name)
        docs = docs.withColumn(held, _matches(F.col("text"), kind))
        docs = docs.withColumn("text", F.when(F.size(held) > 0, _rebuilt(kind, held)).otherwise(F.col("text")))
    return docs.select(*columns)


def _rebuilt(kind: Kind, held: str) -> Column:
    def put(pair: Column) -> Column:
        match, gap = pair["match"], pair["gap"]
        hide = F.coalesce(confirmed(kind.name, match), F.lit(False)) & (score(kind, gap) >= THRESHOLD)
        return F.concat(gap, F.when(hide, F.lit(f"<{kind.name.upper()}>")).otherwise(F.coalesce(match, F.lit(""))))

    gaps = F.split("text", kind.pattern, -1)
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.col(held).alias("match")), put), "")
