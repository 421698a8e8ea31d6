"""Fill-in-the-middle texts, put together by a secondary sort.

Documents are cut into pieces of a bounded number of units (code points), each keyed by its
document and its position in the output.  The pieces are shuffled once by document and sorted by
position inside the partitions, so a task meets every output as a stream and feeds it to an
incremental digest; no output is ever held whole.  For restoration the stream is parsed at its
sentinels, and the parts, now keyed by their place in the source, are sorted again inside the
same partitions and digested in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a piece.
PIECE = 1 << 16
#: Rows handed on together, and the bytes of pieces after which they are handed on anyway.
ROWS, BYTES = 4096, 1 << 23
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Rule:
    """Which documents are changed and how: ``changed`` percent of them, ``spm`` percent of
    these with the suffix first; ``marks`` stand before prefix, suffix and middle."""

    changed: int = 90
    spm: int = 20
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def cut(self, doc_id: int | None, text: str) -> tuple[str, int, int]:
        """Form, end of the prefix and end of the middle; drawn from the id alone (NULL: an empty one)."""
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
        if not text or any(m in text for m in self.marks) or h3 % 100 >= self.changed:
            return "plain", 0, 0
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        return ("spm" if h4 % 100 < self.spm else "psm"), a, b

    def layout(self, form: str) -> list[int]:
        """The order of prefix (0), suffix (1) and middle (2) in the output."""
        return [1, 0, 2] if form == "spm" else [0, 1, 2]


def parts_of(text: str, form: str, a: int, b: int, rule: Rule) -> list[str]:
    """The strings whose concatenation is the output."""
    if form == "plain":
        return [text]
    parts = (text[:a], text[b:], text[a:b])
    return [s for k in rule.layout(form) for s in (rule.marks[k], parts[k])]


class Parts:
    """Takes an output in bytes, a chunk at a time, and gives its parts without the marks.

    Yields (place in the source, bytes): 0 for a prefix or a plain text, 1 for a middle, 2 for
    a suffix.  Marks may be cut anywhere: the end of a chunk that could begin one is held back.
    """

    def __init__(self, form: str, rule: Rule):
        layout = [] if form == "plain" else rule.layout(form)
        self.marks = [rule.marks[k].encode() for k in layout]
        self.places = [0, *[(0, 2, 1)[k] for k in layout]]
        self.held = b""

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        held = self.held + chunk
        while self.marks:
            at = held.find(self.marks[0])
            if at < 0:
                keep = len(self.marks[0]) - 1
                cut = max(0, len(held) - keep)
                if cut:
                    yield self.places[0], held[:cut]
                self.held = held[cut:]
                return
            if at:
                yield self.places[0], held[:at]
            held = held[at + len(self.marks.pop(0)) :]
            self.places.pop(0)
        self.held = b""
        if held:
            yield self.places[0], held

    def end(self) -> None:
        if self.marks:
            raise ValueError("an output lacks a mark")


# --- streams of rows ----------------------------------------------------------------------------

KEY = ["doc_id", "text_key", "task", "n", "form", "prefix_chars", "middle_chars"]
KEY_SCHEMA = "doc_id long, text_key long, task int, n long, form int, prefix_chars long, middle_chars long"
KEY_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


def batched(rows: Iterable[tuple], kinds: list, names: list[str], heavy: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; column ``heavy`` holds bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, kinds, names)
            held, size = [], 0
    if held:
        yield _batch(held, kinds, names)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _documents(rows: Iterator[tuple]):
    return groupby(rows, itemgetter(*range(len(KEY))))


def fim_pieces(docs: DataFrame, rule: Rule = Rule(), piece: int = PIECE) -> DataFrame:
    """The pieces of all outputs, each document's in one partition and in order: the columns
    ``KEY``, ``at`` (position in the output) and ``piece`` (UTF-8 bytes).

    ``task`` tells copies in different input partitions apart, so that no number of repeated rows
    meets in one place; within one, copies of a row share their pieces' positions.
    """

    def cut(batches):
        task = TaskContext.get().partitionId()

        def rows():
            for doc, key, text in streamed(batches):
                form, a, b = rule.cut(doc, text)
                sizes = (None, None) if form == "plain" else (a, b - a)
                head = (doc, key, task, len(text), FORMS.index(form), *sizes)
                at = 0
                for part in parts_of(text, form, a, b, rule):
                    for k in range(0, len(part), piece):
                        yield *head, at + k, part[k : k + piece].encode()
                    at += len(part)
                if not at:
                    yield *head, 0, b""

        yield from batched(rows(), [*KEY_KINDS, pa.int64(), pa.binary()], [*KEY, "at", "piece"], len(KEY) + 1)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.mapInArrow(cut, f"{KEY_SCHEMA}, at long, piece binary")
    by_document = ["doc_id", "text_key", "task"]
    return rows.repartition(*by_document).sortWithinPartitions(*by_document, "n", "at")


def _once(pieces: Iterable[tuple]) -> Iterator[tuple[tuple, int]]:
    """Each position's piece once, with how often it came: copies of a document lie side by side."""
    for _, same in groupby(pieces, itemgetter(len(KEY))):
        first = next(same)
        yield first, 1 + sum(1 for _ in same)


def fim_texts(pieces: DataFrame) -> DataFrame:
    """Whole outputs, for writing them out: ``doc_id``, ``form``, ``output``, a row per document."""

    def join(batches):
        def rows():
            for key, found in _documents(streamed(batches)):
                parts, copies = [], 1
                for row, copies in _once(found):
                    parts.append(row[-1])
                for _ in range(copies):
                    yield key[0], FORMS[key[4]], b"".join(parts)

        for batch in batched(rows(), [pa.int64(), pa.string(), pa.binary()], ["doc_id", "form", "output"], 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.string())], batch.schema.names)

    return pieces.mapInArrow(join, "doc_id long, form string, output string")


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), piece: int = PIECE) -> DataFrame:
    """Rearrange documents for fill-in-the-middle training, restore them, and digest both.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at.  One row per input row:
    ``doc_id``, ``n`` (code points), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and
    ``middle_chars`` (NULL if plain), ``output_sha256``, and ``restored_sha256`` of the text rebuilt
    from the output and its form.

    NULL text counts as empty, and an empty text stays plain.  A NULL id draws like an empty one.
    Repeated rows each get their row.  Texts may be of any length: a task holds a few pieces of
    ``piece`` code points besides the row that it cuts.  An empty table gives an empty result.
    """
    part_names = [*KEY, "copies", "output_sha256", "place", "at", "piece"]
    part_kinds = [*KEY_KINDS, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def take_apart(batches):
        def rows():
            for key, found in _documents(streamed(batches)):
                digest, parser = hashlib.sha256(), Parts(FORMS[key[4]], rule)
                at, copies = 0, 1
                for row, copies in _once(found):
                    digest.update(row[-1])
                    for place, part in parser.feed(row[-1]):
                        yield *key, None, None, place, at, part
                        at += 1
                parser.end()
                yield *key, copies, digest.hexdigest(), -1, 0, b""

        yield from batched(rows(), part_kinds, part_names, len(part_names) - 1)

    out_names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    out_kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def restore(batches):
        def rows():
            for key, found in _documents(streamed(batches)):
                head = next(found)  # sorted first: place -1
                digest = hashlib.sha256()
                for row in found:
                    digest.update(row[-1])
                doc, _, _, n, form, prefix, middle = key
                for _ in range(head[len(KEY)]):
                    yield doc, n, FORMS[form], prefix, middle, head[len(KEY) + 1], digest.hexdigest()

        yield from batched(rows(), out_kinds, out_names, 5)

    parts = fim_pieces(docs, rule, piece).mapInArrow(
        take_apart, f"{KEY_SCHEMA}, copies long, output_sha256 string, place int, at long, piece binary"
    )
    parts = parts.sortWithinPartitions("doc_id", "text_key", "task", "n", "place", "at")  # no shuffle: a document is in one partition
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return parts.mapInArrow(restore, schema)


def _sql(rule: Rule) -> str:
    p, s, m = rule.marks
    has = " OR ".join(f"contains(t, '{mark}')" for mark in rule.marks)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t)::BIGINT AS n, {", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::UBIGINT::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR {has} OR h3 % 100 >= {rule.changed} THEN 'plain' WHEN h4 % 100 < {rule.spm} THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '{p}' || substring(t, 1, a) || '{s}' || substring(t, b + 1) || '{m}' || substring(t, a + 1, b - a)
    ELSE '{s}' || substring(t, b + 1) || '{p}' || substring(t, 1, a) || '{m}' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


SQL = _sql(Rule())
