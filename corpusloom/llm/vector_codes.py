"""Vector code compression: integer vectors in equal parts, each part coded by the nearest entry of its codebook.

The nearest entry is found as in a VA-file. A codebook's coordinates are quantised to a few bits: each is known by its cell,
and a cell by its least and largest coordinate. For every query part a lookup table gives, by coordinate and cell, the least
and the largest squared distance; their sums over an entry's cells bound its distance from both sides. Only entries whose lower
bound is no more than the least upper bound are refined, with integer distances. All numbers are integers, so codes and errors
do not depend on how Spark deals the rows out.

Rows are never moved to learn: tasks return sums for the entries of a codebook, whose number is fixed. The driver holds the
codebooks alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.llm.rows import sized
from corpusloom.session import materialize, small_batches

#: Components in integers are at most so large: all distances and sums then fit a long.
LARGEST = 1 << 26


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are, and are finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, row by row."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(v), -1)
    if v.size and np.abs(v).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}; distances would not fit a long")
    return v.astype(np.int64)


class Approximation:
    """The VA-file of one part's codebook."""

    def __init__(self, entries: np.ndarray, bits: int):
        n, width = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        cells = min(n, 1 << bits)
        #: Cells hold equally many coordinates, up to one.
        self.cell = rank * cells // n
        first = -(-np.arange(cells) * n // cells)
        in_order = np.take_along_axis(entries, order, axis=0)
        self.low = in_order[first].T
        self.high = in_order[np.append(first[1:], n) - 1].T

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, queries by entries."""
        below, above = self.low[None] - query[:, :, None], query[:, :, None] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower, upper = (np.zeros((len(query), len(self.entries)), np.int64) for _ in range(2))
        for d in range(query.shape[1]):
            lower += least[:, d, self.cell[:, d]]
            upper += most[:, d, self.cell[:, d]]
        return lower, upper

    def nearest(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each query, the first of several, and its squared distance."""
        if not len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, upper = self.bounds(query)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        far = ((query[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(far, starts)
        at = np.flatnonzero(far == least[row])
        first = at[np.append(True, row[at][1:] != row[at][:-1])]
        return entry[first], least


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position; bits of a coordinate's cell; scale of components."""

    entries: np.ndarray
    bits: int
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of integer vectors, by part."""
        parts, _, size = self.entries.shape
        found = [Approximation(self.entries[p], self.bits).nearest(v[:, p * size : (p + 1) * size]) for p in range(parts)]
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int) -> DataFrame:
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    return rows.where(finite(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 4) -> Codebooks | None:
    """Codebooks that start as the vectors of the smallest ids and move to their parts' means, rounded down, each round.

    Equal ids are taken in the order of their vectors, null ids last. The first vector's length holds for all; others are
    left out. None if no vector is left. What comes to the driver is parts x entries sums a round.
    """
    rows = _rows(vectors, vec_id, embedding, label, parts)
    first = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"]
    start = first(rows)
    if not len(start):
        return None
    width = len(start[0])
    rows = rows.where(F.size("v") == width)
    if any(len(x) != width for x in start):
        start = first(rows)
    size = width // parts
    books = Codebooks(integers(start, scale).reshape(-1, parts, size).transpose(1, 0, 2), bits, scale)
    small_batches(vectors.sparkSession)
    for _ in range(rounds):
        books = Codebooks(_moved(rows.select("v"), books), bits, scale)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries after one round: each the mean of its parts, rounded down; those without parts stay."""
    parts, n, size = books.entries.shape

    def sums(batches):
        total, count = np.zeros((parts * n, size), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            v = integers(batch.column(0), books.scale)
            code, _ = books.assign(v)
            slot = (code + np.arange(parts) * n).ravel()
            np.add.at(total, slot, v.reshape(-1, size))
            count += np.bincount(slot, minlength=parts * n)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), size).cast(pa.list_(pa.int64()))], ["slot", "n", "s"])

    made = rows.mapInArrow(textops.lean(sums), "slot long, n long, s array<long>")
    out = books.entries.reshape(parts * n, size).copy()
    for slot, count, *total in made.groupBy("slot").agg(F.sum("n"), *(F.sum(F.col("s")[i]) for i in range(size))).collect():
        out[slot] = [x // count for x in total]
    return out.reshape(parts, n, size)


def encoded(vectors: DataFrame, books: Codebooks | None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed) of each vector that can be coded."""
    rows = _rows(vectors, vec_id, embedding, label, parts)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)

    def code(batches):
        for batch in batches:
            index, far = books.assign(integers(batch.column(2), books.scale))
            text = index.astype(np.uint8).tobytes().hex()
            step = 2 * index.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    small_batches(vectors.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return rows.where(F.size("v") == books.width).mapInArrow(textops.lean(code), fields)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that can be coded.

    Vectors that are null or hold null or non-finite components are dropped, and those whose length is not that of the vector
    with the smallest id or no multiple of `parts`. Repeated rows and null ids are kept; label_error adds the errors of equal
    labels, null ones together. An empty table gives no rows. Components beyond 2^26 / scale are an error, as a long could not hold
    the distances. At most 256 entries.
    """
    books = fit(vectors, vec_id, embedding, label, parts, entries, rounds, scale, bits)
    codes = materialize(encoded(vectors, books, vec_id, embedding, label, parts), "codes")
    by_label = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "#label"), "labels")
    told = codes.join(sized(by_label), F.col("label").eqNullSafe(F.col("#label")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _oracle(rounds: int = 2) -> str:
    """The contract of op12 for DuckDB: whole numbers held as doubles, which are exact at this size."""
    far = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.c) + list_dot_product(c.c, c.c)"
    out = """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, k AS part, list_slice(e, k * len(e) // 16 + 1, (k + 1) * len(e) // 16) AS x FROM v, (SELECT unnest(range(16)) AS k)),
c0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64)"""
    for k in range(rounds + 1):
        out += f",\na{k} AS (SELECT p.r, p.part, arg_min(c.entry, 64 * ({far}) + c.entry) AS entry, min({far}) AS error FROM p JOIN c{k} c USING (part) GROUP BY p.r, p.part)"
        if k < rounds:
            out += f""",
m{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM p JOIN a{k} USING (r, part), (SELECT unnest(range(1, 257)) AS i) WHERE i <= len(x) GROUP BY part, entry, i) GROUP BY part, entry),
c{k + 1} AS (SELECT c{k}.part, c{k}.entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))"""
    return out + f""",
coded AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), h"""


ORACLE = _oracle()
