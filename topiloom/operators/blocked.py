"""Factorisation without a bound on the vocabulary.

Neither factor fits one machine here. Documents are dealt to blocks of about
``BLOCK_ENTRIES`` counts. The counts of a block never move again: they are written once as a
table bucketed by block. A block uses only the terms of its own documents, and the table of
those terms, ``(block, term_id)``, is written once as well. A pass brings to each block its
rows of W and the rows of H of its terms, updates W, and sends back one partial sum for each
of its terms. So a pass moves documents x K and (blocks x their terms) x K numbers, never the
counts, a task holds one block at a time, and the driver holds K x K numbers.

The updates, their order, the starting factors and the stopping rule are those of
:mod:`nmf`. The start is a truncated SVD by subspace iteration: the sketch of a term is a
draw from its id, products with X and its transpose are passes as above, and a tall matrix
is orthogonalised by QR of its parts and then of the stacked triangles (TSQR).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeded, vec
from ..session import release, settle, stage_path
from . import nmf
from .sparse import dense, lists, noise, row_sums

BLOCK_ENTRIES = 1_000_000
SWEEPS = 8
_OUT = "doc_id bigint, term_id bigint, v array<double>"


class Blocks:
    """The counts of a corpus by block, and the terms of each block."""

    def __init__(self, docs: DataFrame, n_terms: int, weight: Column | None = None, block_entries: int = BLOCK_ENTRIES):
        spark = docs.sparkSession
        dw = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
        base = docs.where(F.size("ids") > 0).select(
            "doc_id", F.col("ids").cast("array<int>").alias("ids"), F.col("cnts").cast("array<double>").alias("cnts"), dw.alias("dw")).where("dw > 0")
        totals = base.select(F.sum(F.size("ids")), F.sum(F.col("dw") * vec.total("cnts")),
                             F.sum(F.col("dw") * vec.dot("cnts", "cnts")), F.count(F.lit(1))).first()
        self.entries, self.mass, self.squares, self.n_docs = (float(t or 0.0) for t in totals)
        self.n_terms = n_terms
        self.count = max(1, -int(-self.entries // block_entries))
        buckets = min(self.count, int(spark.conf.get("spark.sql.shuffle.partitions")))
        cells = base.withColumn("block", self.block()).repartition(buckets, "block")
        self._name = f"blocks_{uuid.uuid4().hex}"
        cells.write.bucketBy(buckets, "block").sortBy("block").option("path", stage_path(spark, "blocks")).saveAsTable(self._name)
        self.cells = spark.table(self._name)
        self.terms = settle(self.cells.select("block", F.explode("ids").alias("term_id")).distinct(), "terms")

    def block(self) -> Column:
        """The block of a document, from its id alone."""
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.count)).cast("int")

    def docs(self) -> DataFrame:
        return self.cells.select("block", "doc_id")

    def close(self) -> None:
        release(self.cells, self.terms)
        self.cells.sparkSession.sql(f"DROP TABLE IF EXISTS {self._name}")

    def apply(self, h: DataFrame, work: Callable, w: DataFrame | None = None) -> DataFrame:
        """``work(ids, x, rows, dw, w, h)`` on every block, as rows of ``_OUT``.

        ``h`` is ``(term_id, h)`` and ``w`` is ``(block, doc_id, w)``. In a block, ids count
        its terms from 0 and rows its documents. ``work`` returns a matrix for its documents,
        one for its terms, and a vector to be summed over all blocks, or None for any of them.
        """
        right = self.terms.join(h.select("term_id", F.col("h").alias("v")), "term_id").select(
            "block", F.lit(False).alias("is_doc"), F.col("term_id").cast("bigint").alias("key"), "v")
        if w is not None:
            right = right.unionByName(w.select("block", F.lit(True).alias("is_doc"), F.col("doc_id").alias("key"), F.col("w").alias("v")))

        def run(left: pa.Table, factors: pa.Table) -> pa.Table:
            left = left.sort_by("doc_id")
            docs = left.column("doc_id").combine_chunks()
            ids = left.column("ids").combine_chunks()
            x = left.column("cnts").combine_chunks().flatten().to_numpy()
            sizes = pc.list_value_length(ids).to_numpy()
            factors = factors.sort_by("key")
            is_doc = factors.column("is_doc").combine_chunks()

            def matrix(on):
                part = factors.filter(on)
                if not part.num_rows:
                    return np.zeros(0, np.int64), np.zeros((0, 0))
                return part.column("key").to_numpy(), np.array(part.column("v").combine_chunks().flatten().to_numpy()).reshape(part.num_rows, -1)

            terms, held = matrix(pc.invert(is_doc))
            _, own = matrix(is_doc)
            flat = np.searchsorted(terms, ids.flatten().to_numpy())
            for_docs, for_terms, total = work(flat, x, np.repeat(np.arange(len(sizes)), sizes), left.column("dw").to_numpy(), own, held)
            out = []
            if for_docs is not None:
                out.append((docs, pa.nulls(len(docs), pa.int64()), lists(for_docs)))
            if for_terms is not None:
                out.append((pa.nulls(len(terms), pa.int64()), pa.array(terms), lists(for_terms)))
            if total is not None:
                out.append((pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), lists(total[None])))
            return pa.table([pa.chunked_array(c) for c in zip(*out)], names=["doc_id", "term_id", "v"])

        return self.cells.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, _OUT)


def by_term(passed: DataFrame, k: int) -> DataFrame:
    """``(term_id, v)``: the partial sums of all blocks added up."""
    return passed.where("term_id IS NOT NULL").groupBy("term_id").agg(vec.sum_arrays("v", k).alias("v"))


def summed(passed: DataFrame, n: int) -> np.ndarray:
    """The vector that every block added to."""
    row = passed.where("doc_id IS NULL AND term_id IS NULL").agg(vec.sum_arrays("v", n).alias("s")).first()["s"]
    return np.array([x or 0.0 for x in row])


# -- small matrices of tall tables ---------------------------------------------------

def product(rows: DataFrame, a: str, b: str, ka: int, kb: int) -> np.ndarray:
    """``A^T B`` for two array columns of a tall table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((ka, kb))
        for rb in batches:
            out += dense(rb.column(0), ka).T @ dense(rb.column(1), kb)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ka, dtype=np.int32)), lists(out)], names=["i", "v"])

    sums = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "i int, v array<double>").groupBy("i").agg(
        vec.sum_arrays("v", kb).alias("v"))
    out = np.zeros((ka, kb))
    for r in sums.collect():                # K rows
        out[r["i"]] = r["v"]
    return out


def times(rows: DataFrame, column: str, k: int, right: np.ndarray) -> DataFrame:
    """``(term_id, h)``: the array column of each row times a small matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), lists(dense(rb.column(1), k) @ right)], names=["term_id", "h"])

    return rows.select(F.col("term_id").cast("bigint").alias("term_id"), column).mapInArrow(run, "term_id bigint, h array<double>")


def tsqr(rows: DataFrame, column: str, k: int) -> np.ndarray:
    """R of the QR decomposition of a tall table: a triangle for each task, then for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for rb in batches:
            r = np.linalg.qr(np.vstack([r, dense(rb.column(0), k)]), mode="r")
        yield pa.RecordBatch.from_arrays([lists(r)], names=["v"])

    few = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.select(column).coalesce(few).mapInArrow(run, "v array<double>").collect()
    return np.linalg.qr(np.array([p["v"] for p in parts]).reshape(-1, k), mode="r")


def _noise_rows(spark, n: int, k: int, seed: int, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """``(term_id, h)``: the rows of ``sparse.noise``, made where they are needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:                  # a range hands out consecutive numbers
            ids = rb.column(0).to_numpy()
            values = noise(k, int(ids[0]), len(ids), seed) if len(ids) else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([rb.column(0), lists(values * scale + shift)], names=["term_id", "h"])

    return spark.range(n).mapInArrow(run, "term_id bigint, h array<double>")


def svd(blocks: Blocks, rank: int, seed: int) -> tuple[np.ndarray, DataFrame | None]:
    """Leading singular values of the weighted counts, and ``(term_id, h)`` of the right vectors."""
    spark, v = blocks.cells.sparkSession, blocks.n_terms
    r = min(v, rank + 8)

    def work(ids, x, rows, dw, _w, q):
        xq = row_sums(q[ids] * x[:, None], rows, len(dw)) * dw[:, None]
        part = xq[rows] * x[:, None]
        return None, np.stack([np.bincount(ids, part[:, t], len(q)) for t in range(r)], axis=1), None

    q = settle(_noise_rows(spark, v, r, seed, shift=-0.5), "sketch")
    q = settle(times(q, "h", r, np.linalg.inv(tsqr(q, "h", r))), "sketch")
    last, s, right = None, np.empty(0), None
    for _ in range(SWEEPS):
        y = by_term(blocks.apply(q, work), r)
        both = settle(q.join(y, "term_id", "left").select("term_id", "h", F.coalesce("v", vec.zeros(r)).alias("y")), "sketch")
        cross = product(both, "h", "y", r, r)
        values, vectors = np.linalg.eigh((cross + cross.T) / 2)
        order = np.argsort(-values)
        s = np.sqrt(np.maximum(values[order][:rank], 0.0))
        right = q, vectors[:, order][:, :rank]
        if last is not None and np.all(np.abs(s - last) <= 1e-5 * np.maximum(s, 1e-12)):
            break
        last = s
        triangle = tsqr(both, "y", r)
        if np.abs(np.diag(triangle)).min() <= 1e-12 * max(np.abs(np.diag(triangle)).max(), 1e-300):
            break                           # fewer independent columns than the sketch has
        q = settle(times(both, "y", r, np.linalg.inv(triangle)), "sketch")
    keep = s > 1e-9 * max(float(s[0]) if s.size else 0.0, 1e-300)
    if not keep.any():
        return s[keep], None
    return s[keep], settle(times(right[0], "h", r, right[1][:, keep]), "right")


# -- the fit -----------------------------------------------------------------------

def fit(docs: DataFrame, n_terms: int, num_topics: int, *, divergence: str = "kl",
        edges: Sequence[tuple[DataFrame, float]] = (), max_iter: int = 200, tol: float = 1e-4, seed: int = 42,
        init: str = "svd", weight: Column | None = None, block_entries: int = BLOCK_ENTRIES) -> nmf.NMFFit:
    """What :func:`nmf.fit` computes, for any number of terms.

    ``edges`` are ``((src, dst, weight), lambda)`` tables of pruned symmetric graphs. Term ids
    are 0 to ``n_terms`` - 1.
    """
    nmf.Job(num_topics, divergence)         # the same checks
    k, spark = num_topics, docs.sparkSession
    blocks = Blocks(docs, n_terms, weight, block_entries)
    edges = [(e, lam) for e, lam in edges if lam > 0]
    w, h = _start(blocks, k, divergence, seed, init)
    history: list[float] = []

    def work(ids, x, rows, dw, w, h, hsum=None, gram=None):
        if hsum is not None:
            w = nmf._update_w(w, h, hsum, gram, ids, x, rows, divergence)
        ww = w[rows]
        fitted = np.einsum("ij,ij->i", ww, h[ids])
        if divergence == "kl":
            fitted = np.maximum(fitted, nmf.EPS)
            part = x / fitted * dw[rows]
            loss = float(np.sum(dw[rows] * (x * (np.log(x) - np.log(fitted)) - x)))
        else:
            part = x * dw[rows]
            loss = -2.0 * float(np.sum(part * fitted))
        num = np.stack([np.bincount(ids, part * ww[:, t], len(h)) for t in range(k)], axis=1)
        return w, num, np.concatenate([(w.T @ (w * dw[:, None])).ravel(), dw @ w, [loss]])

    def passed(w, h, hsum=None, gram=None):
        done = settle(blocks.apply(h, lambda *a: work(*a, hsum=hsum, gram=gram), w), "pass")
        rest = summed(done, k * k + k + 1)
        new = settle(done.where("doc_id IS NOT NULL").select(blocks.block().alias("block"), "doc_id", F.col("v").alias("w")), "w")
        num = settle(by_term(done, k), "sums")
        release(done, w)
        return new, num, rest[:k * k].reshape(k, k), rest[k * k:-1], rest[-1]

    w, num, wtw, wsum, _ = passed(w, h)
    for _ in range(max_iter):
        old, h = (h, num), settle(_next_h(h, num, wtw, wsum, k, divergence, edges), "h")
        release(*old)
        hsum = np.array(h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"], dtype=float)
        gram = product(h, "h", "h", k, k)
        w, num, wtw, wsum, loss = passed(w, h, hsum, gram)
        objective = loss + float(wsum @ hsum) if divergence == "kl" else blocks.squares + loss + float(np.sum(wtw * gram))
        for e, lam in edges:
            objective += lam * _penalty(e, h)
        history.append(float(objective))
        if len(history) > 1 and history[-2] != 0 and abs(history[-2] - objective) / abs(history[-2]) < tol:
            break
    scale = np.where(hsum == 0, 1.0, hsum).tolist()
    phi = h.select(F.col("term_id").cast("int").alias("term_id"), F.zip_with("h", vec.lit_array(scale), lambda a, b: a / b).alias("h"))
    theta = w.select("doc_id", F.zip_with("w", vec.lit_array(scale), lambda a, b: a * b).alias("w")).select("doc_id", nmf.normalised("w").alias("w"))
    blocks.close()
    return nmf.NMFFit(settle(theta, "theta"), settle(phi, "phi"), k, n_terms, len(history), history[-1], divergence, history)


def fold_in(docs: DataFrame, phi: DataFrame, n_terms: int, k: int, *, n_iter: int = 100, seed: int = 42,
            divergence: str = "kl", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """What :func:`nmf.fold_in` computes, with the topics as a table ``(term_id, h)``."""
    blocks = Blocks(docs, n_terms, block_entries=block_entries)
    h = phi.select("term_id", "h")
    hsum = np.array([x or 0.0 for x in h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"]])
    gram = product(h, "h", "h", k, k)
    draw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: seeded.uniform(seed, F.lit("fold"), F.col("doc_id"), t) + 1e-3)

    def work(ids, x, rows, dw, w, h):
        for _ in range(n_iter):
            w = nmf._update_w(w, h, hsum, gram, ids, x, rows, divergence)
        s = w.sum(axis=1, keepdims=True)
        s[s == 0] = 1.0
        return w / s, None, None

    scored = settle(blocks.apply(h, work, blocks.docs().withColumn("w", draw)).select("doc_id", F.col("v").alias("w")), "scored")
    blocks.close()
    return docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("w", vec.zeros(k)).alias("w"))


def perplexity(docs: DataFrame, theta: DataFrame, phi: DataFrame, n_terms: int, k: int, block_entries: int = BLOCK_ENTRIES) -> float:
    """What :func:`nmf.perplexity` computes, with the topics as a table ``(term_id, h)``."""
    blocks = Blocks(docs, n_terms, block_entries=block_entries)
    h = phi.select("term_id", "h")
    hsum = np.array([x or 0.0 for x in h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"]])

    def work(ids, x, rows, dw, w, h):
        total = w @ hsum
        total[total == 0] = 1.0
        p = np.einsum("ij,ij->i", w[rows], h[ids]) / total[rows]
        return None, None, np.array([np.sum(x * np.log(np.maximum(p, 1e-300))), x.sum()])

    ll, mass = summed(blocks.apply(h, work, theta.select(blocks.block().alias("block"), "doc_id", "w")), 2)
    blocks.close()
    if not mass:
        raise ValueError("no held-out token is in the fitted vocabulary; perplexity is undefined")
    return float(np.exp(-ll / mass))


def _start(blocks: Blocks, k: int, divergence: str, seed: int, init: str) -> tuple[DataFrame, DataFrame]:
    """``(block, doc_id, w)`` and ``(term_id, h)`` to begin with."""
    spark, v = blocks.cells.sparkSession, blocks.n_terms
    rank = min(k, min(int(blocks.n_docs), v) - 1) if init == "svd" else 0
    s, right = svd(blocks, rank, seed) if rank >= 1 else (np.empty(0), None)
    if right is None:
        w = blocks.docs().withColumn("w", nmf._noise(k, seed, 1.0))
        h = _noise_rows(spark, v, k, seed)
    else:
        n = len(s)
        down = np.zeros((n, k))
        down[:, :n] = np.diag(1.0 / np.sqrt(np.maximum(s, 1e-300)))
        wide = np.zeros((n, k))
        wide[:, :n] = np.diag(np.sqrt(s))

        def left(ids, x, rows, dw, _w, m):
            return np.abs(row_sums(m[ids] * x[:, None], rows, len(dw))), None, None

        u = blocks.apply(times(right, "h", n, down), left)
        w = u.select(blocks.block().alias("block"), "doc_id", F.zip_with("v", nmf._noise(k, seed, 1e-4), lambda a, b: a + b).alias("w"))
        noise = _noise_rows(spark, v, k, seed, scale=1e-4).select("term_id", F.col("h").alias("e"))
        h = times(right, "h", n, wide).join(noise, "term_id").select("term_id", F.zip_with("h", "e", lambda a, b: F.abs(a) + b).alias("h"))
    w, h = settle(w, "w"), settle(h, "h")
    if divergence == "kl":
        # the weighted sum of W comes with the blocks' own pass, at the price of one pass
        rest = summed(blocks.apply(h, lambda ids, x, rows, dw, w, h: (None, None, dw @ w), w), k)
        hsum = np.array(h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"], dtype=float)
        mass = float(rest @ hsum)
        if mass > 0:
            w = w.withColumn("w", F.transform("w", lambda a: a * (blocks.mass / mass)))
    return w, h


def _next_h(h: DataFrame, num: DataFrame, wtw: np.ndarray, wsum: np.ndarray, k: int, divergence: str,
            edges: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    out = h.join(num, "term_id", "left").select("term_id", "h", F.coalesce("v", vec.zeros(k)).alias("top"))
    if divergence == "kl":
        out = out.withColumn("bottom", vec.lit_array(wsum.tolist()))
    else:
        bottom = times(h, "h", k, wtw).select("term_id", F.col("h").alias("bottom"))
        out = out.join(bottom, "term_id")
    for e, lam in edges:
        pulled = e.select(F.col("src").alias("_s"), F.col("dst").alias("term_id"), F.col("weight").alias("_x")).join(
            h.select("term_id", F.col("h").alias("g")), "term_id").groupBy(F.col("_s").alias("term_id")).agg(
            vec.sum_arrays("g", k, F.col("_x")).alias("pull"), F.sum("_x").alias("deg"))
        out = out.join(pulled, "term_id", "left").select(
            "term_id", "h", F.zip_with("top", F.coalesce("pull", vec.zeros(k)), lambda a, b: a + lam * b).alias("top"),
            F.zip_with("bottom", "h", lambda a, b: a + lam * b * F.coalesce("deg", F.lit(0.0))).alias("bottom"))
    step = F.zip_with("h", F.zip_with("top", "bottom", lambda a, b: a / (b + nmf.EPS)), lambda a, b: a * b)
    return out.select("term_id", step.alias("h"))


def _penalty(e: DataFrame, h: DataFrame) -> float:
    a = h.select(F.col("term_id").alias("src"), F.col("h").alias("a"))
    b = h.select(F.col("term_id").alias("dst"), F.col("h").alias("b"))
    value = e.join(a, "src").join(b, "dst").agg(F.sum(F.col("weight") * (vec.dot("a", "a") - vec.dot("a", "b")))).first()[0]
    return float(value or 0.0)
