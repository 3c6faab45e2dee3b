"""Vector code compression: product codebooks with Orchard's search for the nearest entry.

Components become integers floor(256 * x), and a vector is cut into ``parts`` equal parts. The
codebook of a part position starts as that part of the ``entries`` smallest vec_ids. Each of
``rounds`` rounds gives every part to the nearest entry (squared distance, ties to the lower
index) and replaces each entry by the floor of the mean of its parts; an entry without parts
stays. A last assignment gives the codes.

Orchard's search keeps for every entry the list of all other entries by their distance from
it. A query starts at some entry and walks down that entry's list. When an entry is closer
than the current one, the search jumps to its list; entries it has met before are marked and
passed over; and it ends where the list's distance is more than twice the current one, since by
the triangle inequality nothing farther can be closer, or as close. All queries of a batch
take a step at a time together. Distances are exact integers: "more than twice" compares
squares with four times the square.

A round is one pass whose tasks send back only sums and counts of each entry; the codebooks,
``parts * entries`` short rows, are the only thing on the driver. Vectors never shuffle.

Rows whose vector is null or empty, or holds a null or non-finite component, are left out. The
vector of the smallest id gives the length; rows of another length are left out too, and a
length that the parts do not divide is an error. Null ids come last in the order of ids, and
rows that repeat an id are ordered by their vectors; every one of them is coded. Integers are
held to 2**25 on either side, so that all sums fit a long. With fewer rows than entries the
codebooks are shorter; an empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import column, tidied
from .tables import join_side, modest_batches, settle, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
MOST = 1 << 25


class Orchard:
    """The entries of one part position and, for each, the others by distance."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gap = ((book[:, None] - book) ** 2).sum(2)
        order = np.argsort(gap, axis=1, kind="stable")
        others = order != np.arange(len(book))[:, None]
        self.near = order[others].reshape(len(book), max(len(book) - 1, 0))
        self.gap = np.take_along_axis(gap, self.near, 1)

    def nearest(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each query."""
        n, last = len(query), len(self.book) - 1
        at = np.zeros(n, np.int64)
        best = ((query - self.book[0]) ** 2).sum(1)
        met = np.zeros((n, last + 1), bool)
        met[:, 0] = True
        going = np.arange(n)
        place = np.zeros(n, np.int64)
        while True:
            going = going[place[going] < last]
            going = going[self.gap[at[going], place[going]] <= 4 * best[going]]
            if not len(going):
                return at, best
            entry = self.near[at[going], place[going]]
            place[going] += 1
            new = ~met[going, entry]
            rows, entry = going[new], entry[new]
            met[rows, entry] = True
            far = ((query[rows] - self.book[entry]) ** 2).sum(1)
            better = (far < best[rows]) | ((far == best[rows]) & (entry < at[rows]))
            rows = rows[better]
            at[rows], best[rows], place[rows] = entry[better], far[better], 0


def integers(array: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one width as a matrix of floor(256 * x)."""
    flat = array.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64).reshape(-1, width)


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows with a vector of finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & finite)


def _sums(batches: Iterator[pa.RecordBatch], vec: str, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.shape
    search = [Orchard(b) for b in books]
    total, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
    for batch in batches:
        x = integers(column(batch, vec), parts * width).reshape(-1, parts, width)
        for p in range(parts):
            at, _ = search[p].nearest(x[:, p])
            np.add.at(total[p], at, x[:, p])
            count[p] += np.bincount(at, minlength=entries)
    p, e = np.nonzero(count)
    yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": count[p, e], "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})


def train(vectors: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as integers, (parts, entries, components); no entries if no vector is usable."""
    good = usable(vectors, vec)
    first = good.select("vec_id", F.col(vec).alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    length = len(first[0]["v"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    good = good.where(F.size(vec) == length)
    if any(len(r["v"]) != length for r in first):
        first = good.select("vec_id", F.col(vec).alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length)
    books = np.ascontiguousarray(start.reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        held = books
        sums = modest_batches(good).select(vec).mapInArrow(lambda it: tidied(_sums(it, vec, held)), "part int, entry int, n long, total array<long>")
        cells = sums.select("part", "entry", "n", F.posexplode("total").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        books = books.copy()
        # at most one row for each component of the codebooks
        for r in cells.collect():
            books[r["part"], r["entry"], r["i"]] = r["x"] // r["n"]
    return books


def _codes(batches: Iterator[pa.RecordBatch], vec: str, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    search = [Orchard(b) for b in books]
    for batch in batches:
        x = integers(column(batch, vec), parts * width).reshape(-1, parts, width)
        code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            at, far = search[p].nearest(x[:, p])
            code[:, p] = at
            error += far
        rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != vec]
        names = [f.name for f in batch.schema if f.name != vec]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=[*names, "code", "error"])


def encode(vectors: DataFrame, books: np.ndarray, vec: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error) of every usable vector under the codebooks."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for a part")
    schema = "vec_id long, label string, code string, error long"
    rows = usable(vectors, vec).where(F.size(vec) == parts * width)
    rows = modest_batches(rows).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec)
    return rows.mapInArrow(lambda it: tidied(_codes(it, vec, books)), schema)


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    """Whole ``embeddings``: code and error of each vector, and the error of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors)
    coded = settle(encode(vectors, books), "codes")
    labels = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    out = join_side(coded, labels, "label", 64, F.xxhash64("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS r FROM (
    SELECT x.vec_id, x.part, entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{i} c ON x.part = c.part AND x.k = c.k GROUP BY ALL)) WHERE r = 1)"""


def _replace(i: int) -> str:
    return f"""c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT part, entry, k, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM a{i} JOIN x USING (vec_id, part) GROUP BY ALL) m USING (part, entry, k))"""


SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT vec_id, n, i // (len // {PARTS}) AS part, i % (len // {PARTS}) AS k, v FROM (
  SELECT vec_id, n, len(embedding) AS len, generate_subscripts(embedding, 1) - 1 AS i,
    CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)),
c0 AS (SELECT part, n AS entry, k, v FROM x WHERE n < {ENTRIES}),
{_round(0)}, {_replace(0)}, {_round(1)}, {_replace(1)}, {_round(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, k)) FROM c2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
