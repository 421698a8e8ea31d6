"""Compression of vectors to short codes, with Orchard's search for the nearest entry.

A vector is cut into equal parts, each coded by the index of the nearest entry of its part's
codebook.  Every entry keeps a list of all entries in order of their distance to it.  A search
walks the list of the best entry found so far; a better one makes it jump to that one's list,
entries already looked at are marked and not measured again, and it stops beyond twice the
current distance, where no entry can be nearer.  All arithmetic is in whole numbers, so
codes, ties and codebooks do not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers of a larger magnitude are an error: their squared distances might not fit a long.
LARGEST = 1 << 28
#: Vectors searched in one go.
TOGETHER = 2048
#: Labels up to this number have their sums sent to every task; with more they are joined by shuffle.
LABELS_SENT = 100_000


# --- nearest entries ----------------------------------------------------------------------


class Codebooks:
    """The entries of all parts, ``(part, entry, position)``, and every entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = np.stack([((part[:, None] - part[None]) ** 2).sum(axis=2) for part in entries])
        self.order = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=2)
        sums = entries.sum(axis=2)
        self.by_sum = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.by_sum, axis=1)
        self.measured = 0  # distances worked out so far

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower index) and squared distance of every part: ``(vector, part)`` each."""
        index = np.empty((len(vectors), len(self.entries)), np.int64)
        error = np.empty_like(index)
        for at in range(0, len(vectors), TOGETHER):
            index[at : at + TOGETHER], error[at : at + TOGETHER] = self._search(vectors[at : at + TOGETHER])
        return index, error

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, entries, width = self.entries.shape
        points = vectors.reshape(-1, width)  # one search per vector and part
        part = np.tile(np.arange(parts), len(vectors))
        best = self._starts(points.reshape(-1, parts, width).sum(axis=2)).ravel()
        error = self._distance(points, part, best)
        seen = np.zeros((len(points), entries), bool)
        seen[np.arange(len(points)), best] = True
        place = np.zeros(len(points), np.int64)  # how far the list of the best entry has been walked
        active = np.arange(len(points))
        while len(active):
            p, b, at = part[active], best[active], place[active]
            near = self.gaps[p, b, at] <= 4 * error[active]  # squared: within twice the distance; equal ones may tie
            active, p, at = active[near], p[near], at[near]
            entry = self.order[p, b[near], at]
            place[active] = at + 1
            new = ~seen[active, entry]
            asked, entry = active[new], entry[new]
            seen[asked, entry] = True
            d = self._distance(points[asked], p[new], entry)
            closer = (d < error[asked]) | ((d == error[asked]) & (entry < best[asked]))
            asked = asked[closer]
            best[asked], error[asked], place[asked] = entry[closer], d[closer], 0
            active = active[place[active] < entries]
        return best.reshape(-1, parts), error.reshape(-1, parts)

    def _starts(self, sums: np.ndarray) -> np.ndarray:
        """An entry to begin at: one whose components sum to about as much."""
        out = np.empty(sums.shape, np.int64)
        for part in range(sums.shape[1]):
            at = np.searchsorted(self.sums[part], sums[:, part])
            out[:, part] = self.by_sum[part, np.minimum(at, self.sums.shape[1] - 1)]
        return out

    def _distance(self, points: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.measured += len(points)
        return ((points - self.entries[part, entry]) ** 2).sum(axis=1)

    def restored(self, code: str) -> np.ndarray:
        """The whole numbers that a code stands for."""
        picked = np.frombuffer(bytes.fromhex(code), np.uint8)
        return self.entries[np.arange(len(picked)), picked].ravel()


# --- rows -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """How vectors are read: ``scale`` makes them whole numbers, ``parts`` cut them."""

    parts: int = PARTS
    scale: int = SCALE


def whole_vectors(column: pa.Array, shape: Shape, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and their whole numbers, a row each.

    NULL vectors and vectors with NULL or non-finite components are left out.
    """
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(sizes >= 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes[there])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = bad[ends] == bad[ends - sizes[there]]
    used = sizes[there][good]
    if not len(used):
        return there[:0], np.zeros((0, width or 0), np.int64)
    width = width or int(used[0])
    if (used != width).any() or width % shape.parts or not width:
        raise ValueError(f"vectors need one length that {shape.parts} parts divide, found {sorted(set(used.tolist()) | {width})[:5]}")
    picked = values[np.repeat(good, sizes[there])].reshape(-1, width)
    scaled = np.floor(picked * shape.scale)
    if (np.abs(scaled) > LARGEST).any():
        raise ValueError(f"components beyond {LARGEST / shape.scale:g} are not supported")
    return there[good], scaled.astype(np.int64)


def first_vectors(vectors: DataFrame, shape: Shape, most: int) -> np.ndarray:
    """The usable vectors with the ``most`` smallest ids, ascending; a NULL id comes last.

    Of an id's vectors, the one with the smallest components.  Every task sends its own ``most``
    at the most.
    """

    def smallest(batches):
        found: dict = {}
        for batch in batches:
            rows, whole = whole_vectors(batch.column("vector"), shape)
            ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            edge = max(map(_rank, found), default=None) if len(found) >= most else None
            for id_, vector in zip(ids, whole):
                if edge is None or _rank(id_) <= edge:
                    said = vector.tolist()
                    found[id_] = min(found.get(id_, said), said)
            found = {id_: found[id_] for id_ in sorted(found, key=_rank)[:most]}
        columns = [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector"])

    rows = vectors.mapInArrow(smallest, "vec_id long, vector array<long>")
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last())
    found = [r["vector"] for r in rows.limit(most).collect()]  # ``most`` rows
    if len({len(v) for v in found}) > 1:
        raise ValueError("vectors need one length")
    return np.array(found, np.int64)


def _rank(id_: int | None) -> tuple:
    return (id_ is None, id_ or 0)


def better_entries(vectors: DataFrame, shape: Shape, books: Codebooks) -> np.ndarray:
    """Entries moved to the floored means of the parts nearest to them; unused ones stay.

    A task sends one row of sums per part and entry, whatever its rows.
    """
    held = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape

    def sums(batches):
        books = held.value
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            _, whole = whole_vectors(batch.column("vector"), shape, books.width)
            cell = (books.nearest(whole)[0] + np.arange(parts) * entries).ravel()
            count += np.bincount(cell, minlength=len(count))
            np.add.at(total, cell, whole.reshape(-1, width))
        used = np.flatnonzero(count)
        columns = [used, count[used], *total[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["cell", "n", *[f"s{k}" for k in range(width)]]
    rows = vectors.select("vector").mapInArrow(sums, ", ".join(f"{n} long" for n in names))
    rows = rows.groupBy("cell").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[1:]])
    out = books.entries.reshape(-1, width).copy()
    for row in rows.collect():  # a row per part and entry
        out[row["cell"]] = [int(row[n]) // int(row["n"]) for n in names[2:]]
    return out.reshape(books.entries.shape)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``rows`` (``vec_id``, ``embedding``) after ``rounds`` of assigning and averaging.

    They start as the vectors with the smallest ids; fewer vectors than ``entries`` make smaller
    codebooks, none make None.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    shape, vectors = Shape(parts, scale), _vectors(rows)
    first = first_vectors(vectors, shape, entries)
    if not len(first):
        return None
    books = Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = Codebooks(better_entries(vectors, shape, books))
    return books


def encode(rows: DataFrame, books: Codebooks | None, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` of every usable vector."""
    vectors = rows.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector"))
    label = rows.schema["label"].dataType.simpleString()
    names = ["vec_id", "label", "code", "error"]
    if books is None:
        return vectors.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    held = rows.sparkSession.sparkContext.broadcast(books)
    shape = Shape(len(books.entries), scale)

    def code(batches):
        books = held.value
        for batch in batches:
            kept, whole = whole_vectors(batch.column("vector"), shape, books.width)
            index, error = books.nearest(whole)
            said = index.astype(np.uint8).tobytes().hex()
            step = 2 * shape.parts
            codes = [said[at : at + step] for at in range(0, len(said), step)]
            taken = [batch.column(c).take(pa.array(kept)) for c in names[:2]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(codes, pa.string()), pa.array(error.sum(axis=1))], names)

    return vectors.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Code every usable vector of ``rows`` (``vec_id``, ``embedding``, ``label``) with codebooks learned from all of them.

    Returns ``vec_id``, ``code``, ``error`` (squared distance to what the code stands for),
    ``label_error`` (errors summed over the rows of the same label, NULL labels together; NULL
    beyond a long) and ``codebooks_sha256``.  Other columns are not looked at.

    Rows whose vector is NULL, or holds a NULL or non-finite component, are left out.  Vectors of
    different lengths, or of a length that ``parts`` does not divide, are an error, as are
    components beyond ``LARGEST / scale``.  Rows with a NULL ``vec_id`` are coded like others and
    start a codebook only after all ids.  Repeated rows are each coded and weigh in the means;
    an id starts one entry at most.  An empty table gives an empty result.
    """
    books = learn(rows, parts, entries, rounds, scale)
    coded = checkpointed(encode(rows, books, scale))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    sums = checkpointed(sums)
    sums = F.broadcast(sums) if sums.count() <= LABELS_SENT else sums
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


# --- the same in SQL --------------------------------------------------------------------------


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (SELECT v, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d FROM (
  SELECT v, p.part, entry, list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT AS d
  FROM parts p JOIN {books} b ON p.part = b.part) GROUP BY v, part)"""


def _moved(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
  SELECT part, entry, list(x ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS x FROM (
      SELECT a.part, a.entry, unnest(p.x) AS c, unnest(range(len(p.x))) AS i
      FROM {assigned} a JOIN parts p ON a.v = p.v AND a.part = p.part) GROUP BY part, entry, i)
  GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""


SQL = f"""
WITH whole AS (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT v, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] AS x FROM (SELECT v, w, unnest(range({PARTS})) AS part FROM whole)),
b0 AS (SELECT part, v - 1 AS entry, x FROM parts WHERE v <= {ENTRIES}),
{_assigned("a0", "b0")}, {_moved("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_moved("b2", "b1", "a1")}, {_assigned("a2", "b2")},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a2 JOIN whole USING (v) GROUP BY v, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded
"""
