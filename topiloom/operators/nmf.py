"""Graph-regularised non-negative matrix factorisation.

State lives in Spark as one sparse row per document, ``(doc_id, ids, cnts, w)``; the
topic-term matrix H is small (topics x bounded vocabulary) and is broadcast. Each
iteration is one Arrow pass that moves W and sends back, per task, the sums the next H
update needs. A pass holds the documents with their new W, which a lost executor computes
again from the passes before; every ``REPLAY`` iterations they are written.
When H would be too large the same updates run as joins (:func:`fit_joined`), with no
matrix on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeded, vec
from ..session import DRIVER_CELLS, bounded, cut_lineage, hold, spread
from .sparse import DOUBLES, INTS, SUM_TASKS, at_entries, blocks, dense, lists, noise, pieces, row_sums, same, sparse, stretch_sums, summed, truncated_svds

EPS = 1e-10
REPLAY = 5
DIRECT_CELLS = 5_000_000
BATCH_CELLS = 8_000_000
TASK_ENTRIES = 50_000    # counts times models that a task should have at least
_STATE = "doc_id bigint, ids array<int>, cnts array<double>, w array<double>, dw array<double>"
_NAMES = ["doc_id", "ids", "cnts", "w", "dw", "i", "y"]


@dataclass
class NMFFit:
    """``theta(doc_id, w)`` with rows summing to 1 and ``phi(term_id, h)``."""

    theta: DataFrame
    phi: DataFrame
    num_topics: int
    n_terms: int
    n_iter: int
    objective: float
    divergence: str = "kl"
    history: list[float] = field(default_factory=list)

    def theta_long(self) -> DataFrame:
        return self.theta.select("doc_id", F.posexplode("w").alias("topic", "weight"))

    def phi_long(self, vocab: DataFrame | None = None) -> DataFrame:
        rows = self.phi.select("term_id", F.posexplode("h").alias("topic", "weight"))
        if vocab is None:
            return rows
        return rows.join(bounded(vocab.select("term_id", "term"), self.n_terms), "term_id")

    def matrix(self) -> np.ndarray:
        """H as a K x V array on the driver; its size was checked before the fit."""
        pdf = self.phi.toPandas()
        out = np.zeros((self.num_topics, self.n_terms))
        if len(pdf):
            out[:, pdf["term_id"].to_numpy()] = np.vstack(pdf["h"].to_numpy()).T
        return out

    def history_table(self) -> DataFrame:
        spark = self.phi.sparkSession
        return spark.createDataFrame(
            [(i + 1, float(v)) for i, v in enumerate(self.history)], "iter int, objective double")


# -- one pass over the documents, for all models of a batch -------------------------

@dataclass(frozen=True, eq=False)
class Job:
    """One model of a batch.

    ``weight`` repeats a document, as a bootstrap count or the flag of a time slice does;
    documents of weight 0 are not part of the model. ``graphs`` are ``((src, dst, weight),
    lambda)`` arrays of pruned symmetric graphs (see :func:`graphs.edge_arrays`). ``start``
    gives the factors to begin with, ``(doc_id, w)`` and a K x V array; they are not scaled.
    """

    num_topics: int
    divergence: str = "kl"
    graphs: Sequence[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]] = ()
    seed: int = 42
    weight: Column | None = None
    max_iter: int = 200
    tol: float = 1e-4
    init: str = "svd"
    start: tuple[DataFrame, np.ndarray] | None = None

    def __post_init__(self):
        if self.num_topics < 1:
            raise ValueError("num_topics must be >= 1")
        if self.divergence not in ("kl", "frobenius"):
            raise ValueError(f"unknown divergence {self.divergence!r}")


@dataclass(frozen=True)
class _Part:
    """Where a model's columns lie in the stacked W, and its loss."""

    at: int
    k: int
    divergence: str


def _update_w(w, ht, hsum, hht, ids, x, rows, divergence):
    n = w.shape[0]
    h = ht[ids]
    if divergence == "kl":
        wh = np.maximum(np.einsum("ij,ij->i", w[rows], h), EPS)
        num = row_sums(h * (x / wh)[:, None], rows, n)
        return w * num / (hsum[None, :] + EPS)
    return w * row_sums(h * x[:, None], rows, n) / (w @ hht + EPS)


def _fitted_at(w: np.ndarray, hk: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """W H at the entries, topic by topic."""
    wk = np.ascontiguousarray(w.T)
    out = wk[0][rows] * hk[0]
    for t in range(1, len(hk)):
        out += wk[t][rows] * hk[t]
    return out


def _step_w(w: np.ndarray, hk: list[np.ndarray], hsum: np.ndarray, hht: np.ndarray, x: np.ndarray, sizes: np.ndarray,
            divergence: str, rows: np.ndarray | None = None) -> np.ndarray:
    """:func:`_update_w` for entries that stand row after row, H given at the entries."""
    rows = np.repeat(np.arange(len(sizes)), sizes) if rows is None else rows
    if divergence == "kl":
        part = x / np.maximum(_fitted_at(w, hk, rows), EPS)
    else:
        part = x
    num = np.stack([stretch_sums(h * part, sizes) for h in hk], axis=1)
    return w * num / (hsum[None, :] + EPS if divergence == "kl" else w @ hht + EPS)


def _members(rb: pa.RecordBatch, live: Sequence[int], n_models: int):
    """For each of the models, its documents of the batch, their entries, the place and the size of each."""
    ids, x, rows, sizes = sparse(rb, 1, 2)
    ids, dw = ids.astype(np.intp), dense(rb.column(4), n_models)
    for b in live:
        on = dw[:, b] > 0
        if on.all():
            yield b, np.arange(len(sizes)), ids, x, rows, sizes, dw[:, b]
        else:
            entry, own = np.flatnonzero(on[rows]), np.flatnonzero(on)
            yield b, own, ids[entry], x[entry], np.repeat(np.arange(len(own)), sizes[own]), sizes[own], dw[own, b]


def _known(ht: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """H^T with what a step of W needs of it."""
    return ht, ht.sum(axis=0), ht.T @ ht


@dataclass
class _Sums:
    """R^T W or X^T W, W^T W, sum W and the loss of one model at H and W."""

    num: np.ndarray
    gram: np.ndarray
    total: np.ndarray
    loss: float


def _pass(state: DataFrame, hs: dict[int, np.ndarray], parts: list[_Part], v: int, step: bool) -> tuple[DataFrame, dict[int, _Sums]]:
    """One reading of the documents for the models that still run, those of ``hs``.

    ``step`` moves their W to the given H first; then the documents with that W are held and
    returned beside the sums at both. A task adds up all its batches, and splits are joined to a few for each core first,
    so what is shuffled depends on the cluster and not on the number of documents. The sums are
    numbered pieces behind the documents, so W and sums come from the same reading.
    """
    bc = state.sparkSession.sparkContext.broadcast(hs)
    width, kmax = parts[-1].at + parts[-1].k, max(p.k for p in parts)
    block = v + kmax + 2                 # a model's keys: terms, then W^T W, sum W and the loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {b: _known(ht) for b, ht in bc.value.items()}
        held = {b: (np.zeros((parts[b].k, v)), np.zeros((kmax + 2, parts[b].k))) for b in now}
        for rb in blocks(batches):
            all_w = dense(rb.column(3), width)
            all_w = all_w.copy() if step else all_w
            for b, on, ids, x, rows, sizes, dw in _members(rb, list(now), len(parts)):
                if not len(on):
                    continue
                k, kind, (h, hsum, hht) = parts[b].k, parts[b].divergence, now[b]
                cols, hk = slice(parts[b].at, parts[b].at + k), at_entries(h, ids)
                w = all_w[on, cols]
                if step:
                    w = all_w[on, cols] = _step_w(w, hk, hsum, hht, x, sizes, kind, rows)
                num, extra = held[b]
                wk = [np.ascontiguousarray(w[:, t])[rows] for t in range(k)]
                fitted = wk[0] * hk[0]
                for t in range(1, k):
                    fitted += wk[t] * hk[t]
                if kind == "kl":
                    part = x / np.maximum(fitted, EPS)
                    extra[kmax + 1, 0] += float(dw @ stretch_sums(x * (np.log(part) - 1.0), sizes))
                else:
                    part = x
                    extra[kmax + 1, 0] += -2.0 * float(dw @ stretch_sums(part * fitted, sizes))
                weighted = part * dw[rows]
                for t in range(k):
                    num[t] += np.bincount(ids, weighted * wk[t], v)
                extra[:k] += w.T @ (w * dw[:, None])
                extra[kmax] += dw @ w
            if step:
                n = rb.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), same(rb.column(1), INTS), same(rb.column(2), DOUBLES), lists(all_w), same(rb.column(4), DOUBLES),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_NAMES)
        for b, (num, extra) in held.items():
            for piece in pieces(np.concatenate([num, extra.T], axis=1), b * block):
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, INTS), *[pa.nulls(n, DOUBLES)] * 3, *piece.columns], names=_NAMES)

    few = min(state.rdd.getNumPartitions(), SUM_TASKS * state.sparkSession.sparkContext.defaultParallelism)
    both = state.coalesce(few).mapInArrow(run, f"{_STATE}, i bigint, y binary")
    both = hold(both) if step else both
    flat = {b: np.zeros((parts[b].k, block)) for b in hs}
    # few tasks and a small H: the partial sums are added here, without a shuffle
    here = few * len(hs) * v * kmax <= DIRECT_CELLS
    for i, piece in summed(both.where("i IS NOT NULL").select("i", "y"), here).items():
        b, at = divmod(i, block)
        piece = piece.reshape(parts[b].k, -1)
        flat[b][:, at:at + piece.shape[1]] = piece
    bc.unpersist()
    out = {}
    for b, own in flat.items():
        own, k = np.ascontiguousarray(own.T), parts[b].k
        out[b] = _Sums(own[:v], own[v:v + k], own[v + kmax], float(own[v + kmax + 1, 0]))
    return both, out


def _documents(both: DataFrame) -> DataFrame:
    """The documents that a pass held beside its sums."""
    return both.where("i IS NULL").select("doc_id", "ids", "cnts", "w", "dw")


# -- initial factors ---------------------------------------------------------------

def _noise(k: int, seed: int, scale: float) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda t: seeded.uniform(seed, F.lit("w"), F.col("doc_id"), t) * scale)


def _first_factors(base: DataFrame, jobs: Sequence[Job], parts: list[_Part], v: int) -> tuple[DataFrame, list[np.ndarray]]:
    """``(doc_id, ids, cnts, w, dw)`` with the stacked first W, and each model's first H^T.

    ``abs(U) * sqrt(S)`` and ``abs(V) * sqrt(S)`` of the weighted counts, zero-padded when the
    rank is lower than K, plus small noise. U is recomputed from V row by row, so no matrix of
    documents is returned to Python. A model without usable rank starts from random factors.
    """
    n_models = len(jobs)
    sizes = base.agg(*[F.sum((F.col("dw")[b] > 0).cast("long")).alias(f"n{b}") for b in range(n_models)]).first()
    ranks = {b: min(j.num_topics, min(sizes[b] or 0, v) - 1) for b, j in enumerate(jobs)
             if j.start is None and j.init == "svd"}
    found = truncated_svds(base, v, {b: (r, jobs[b].seed) for b, r in ranks.items() if r >= 1}, n_models)
    width = parts[-1].at + parts[-1].k
    hts, pieces, basis = [], [], np.zeros((v, width))
    for b, (job, part) in enumerate(zip(jobs, parts)):
        k = job.num_topics
        if job.start is not None:
            hts.append(np.ascontiguousarray(np.asarray(job.start[1], dtype=float).T))
            pieces.append(F.col(f"_w{b}"))
            continue
        s, right = found.get(b, (np.empty(0), None))
        if s.size == 0:
            hts.append(noise(k, 0, v, job.seed))
            pieces.append(_noise(k, job.seed, 1.0))
            continue
        ht = np.zeros((v, k))
        ht[:, :s.size] = np.abs(right) * np.sqrt(s)
        hts.append(ht + noise(k, 0, v, job.seed) * 1e-4)
        basis[:, part.at:part.at + s.size] = right / np.sqrt(np.maximum(s, 1e-300))   # |X v / s| * sqrt(s)
        pieces.append(F.zip_with(F.slice("u", part.at + 1, k), _noise(k, job.seed, 1e-4), lambda a, c: a + c))
    rows = base
    if basis.any():
        bc = base.sparkSession.sparkContext.broadcast(basis)

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = bc.value
            for rb in batches:
                ids, x, rws, counts = sparse(rb, 1, 2)
                u = np.abs(row_sums(m[ids] * x[:, None], rws, len(counts)))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), same(rb.column(1), INTS), same(rb.column(2), DOUBLES), lists(u),
                     same(rb.column(3), DOUBLES)], names=["doc_id", "ids", "cnts", "u", "dw"])

        rows = base.select("doc_id", "ids", "cnts", "dw").mapInArrow(
            left, "doc_id bigint, ids array<int>, cnts array<double>, u array<double>, dw array<double>")
    for b, job in enumerate(jobs):
        if job.start is not None:
            rows = rows.join(job.start[0].select("doc_id", F.col("w").alias(f"_w{b}")), "doc_id")
    return rows.select("doc_id", "ids", "cnts", F.concat(*pieces).alias("w"), "dw"), hts


def init_factors(docs: DataFrame, k: int, v: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, ids, cnts, w, dw)`` and H^T to start one model from, by truncated SVD."""
    base = docs.select("doc_id", F.col("ids").cast("array<int>").alias("ids"),
                       F.col("cnts").cast("array<double>").alias("cnts"), F.array(F.col("dw").cast("double")).alias("dw"))
    start, hts = _first_factors(base, [Job(k, seed=seed)], [_Part(0, k, "kl")], v)
    return start.withColumn("dw", F.col("dw")[0]), hts[0]


# -- the fit -----------------------------------------------------------------------

def fit(docs: DataFrame, n_terms: int, num_topics: int, *, divergence: str = "kl",
        graphs: Sequence[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]] = (),
        max_iter: int = 200, tol: float = 1e-4, seed: int = 42, init: str = "svd",
        weight: Column | None = None, start: tuple[DataFrame, np.ndarray] | None = None) -> NMFFit:
    """Factorise the counts of ``docs(doc_id, ids, cnts)``: a batch of one :class:`Job`."""
    return fit_many(docs, n_terms, [Job(num_topics, divergence, graphs, seed, weight, max_iter, tol, init, start)])[0]


def fit_many(docs: DataFrame, n_terms: int, jobs: Sequence[Job]) -> list[NMFFit]:
    """Fit several models of ``docs(doc_id, ids, cnts)`` that share the documents' passes.

    Each pass over the documents serves all models that have not converged, so 20 bootstrap
    resamples cost one reading an iteration. Models are packed until their H matrices together
    have ``BATCH_CELLS`` cells; further ones follow in the next batch.
    """
    out: list[NMFFit] = []
    batch: list[Job] = []
    for job in jobs:
        if job.num_topics * n_terms > DRIVER_CELLS:
            raise ValueError("topics x terms is too large to broadcast; use blocked.fit")
        if batch and (sum(j.num_topics for j in batch) + job.num_topics) * n_terms > BATCH_CELLS:
            out += _fit_batch(docs, n_terms, batch)
            batch = []
        batch.append(job)
    return out + (_fit_batch(docs, n_terms, batch) if batch else [])


def _fit_batch(docs: DataFrame, v: int, jobs: Sequence[Job]) -> list[NMFFit]:
    """H is updated first, then W at the new H, and the objective is read at both."""
    spark = docs.sparkSession
    parts, width = [], 0
    for j in jobs:
        parts.append(_Part(width, j.num_topics, j.divergence))
        width += j.num_topics
    dw = F.array(*[F.lit(1.0) if j.weight is None else F.coalesce(j.weight.cast("double"), F.lit(0.0)) for j in jobs])
    base = docs.where(F.size("ids") > 0).select(
        "doc_id", F.col("ids").cast("array<int>").alias("ids"),
        F.col("cnts").cast("array<double>").alias("cnts"), dw.alias("dw")).where(F.exists("dw", lambda c: c > 0))
    base = hold(spread(base))
    n_models = len(jobs)
    totals = base.select(vec.total("cnts").alias("m"), vec.dot("cnts", "cnts").alias("q"), F.size("ids").alias("n"), "dw").agg(
        *[F.sum(F.col("dw")[b] * F.col(c)) for c in ("m", "q") for b in range(n_models)], F.sum("n")).first()
    x_mass, x_sq = ([float(t or 0.0) for t in totals[i * n_models:(i + 1) * n_models]] for i in range(2))
    begin, hts = _first_factors(base, jobs, parts, v)
    # a small corpus is not worth a task on every core
    tasks = max(1, min(base.rdd.getNumPartitions(), int(totals[-1] or 0) * n_models // TASK_ENTRIES))
    state = held = hold(cut_lineage(begin.coalesce(tasks)))
    base.unpersist()
    scales = np.ones(width)
    scaled = [b for b, j in enumerate(jobs) if j.divergence == "kl" and j.start is None]
    if scaled:
        w_sums = state.agg(F.array(*[F.sum(F.col("w")[parts[b].at + t] * F.col("dw")[b]) for b in scaled for t in range(parts[b].k)])).first()[0]
        for b in scaled:
            own, w_sums = w_sums[:parts[b].k], w_sums[parts[b].k:]
            mass = float(np.array([x or 0.0 for x in own]) @ hts[b].sum(axis=0))
            if mass > 0:
                scales[parts[b].at:parts[b].at + parts[b].k] = x_mass[b] / mass
        state = state.withColumn("w", F.zip_with("w", vec.lit_array(scales.tolist()), lambda a, c: a * c))

    lams = [[(src, dst, val, lam, np.bincount(src, val, v)) for (src, dst, val), lam in j.graphs if lam > 0 and len(src)]
            for j in jobs]

    def smooth(h, src, dst, val):
        return np.stack([np.bincount(dst, val * h[src, t], v) for t in range(h.shape[1])], axis=1)

    live = set(range(n_models))
    history: list[list[float]] = [[] for _ in jobs]
    _, sums = _pass(state, {b: hts[b] for b in live}, parts, v, step=False)
    since = 0
    while live:
        for b in live:
            ht, now = hts[b], sums[b]
            top = now.num
            bottom = np.broadcast_to(now.total[None, :], ht.shape) if jobs[b].divergence == "kl" else ht @ now.gram
            for src, dst, val, lam, deg in lams[b]:
                top = top + lam * smooth(ht, src, dst, val)
                bottom = bottom + lam * ht * deg[:, None]
            hts[b] = ht * top / (bottom + EPS)
        both, sums = _pass(state, {b: hts[b] for b in live}, parts, v, step=True)
        held.unpersist()
        state, held, since = _documents(both), both, since + 1
        for b in sorted(live):
            ht, now, past = hts[b], sums[b], history[b]
            if jobs[b].divergence == "kl":
                objective = now.loss + float(now.total @ ht.sum(axis=0))
            else:
                objective = x_sq[b] + now.loss + float(np.sum(now.gram * (ht.T @ ht)))
            for src, dst, val, lam, deg in lams[b]:
                objective += lam * float(np.sum(ht * ht * deg[:, None]) - np.sum(ht * smooth(ht, src, dst, val)))
            past.append(objective)
            if len(past) > 1 and past[-2] != 0 and abs(past[-2] - objective) / abs(past[-2]) < jobs[b].tol:
                live.discard(b)
            elif len(past) >= jobs[b].max_iter:
                live.discard(b)
        if live and since >= REPLAY:
            state, since = cut_lineage(state), 0
            held.unpersist()
    final = cut_lineage(state.select("doc_id", "w", "dw"))
    held.unpersist()
    out = []
    for b, (job, part) in enumerate(zip(jobs, parts)):
        scale = hts[b].sum(axis=0)
        scale[scale == 0] = 1.0
        own = final.where(F.col("dw")[b] > 0).select("doc_id", F.zip_with(
            F.slice("w", part.at + 1, part.k), vec.lit_array([float(s) for s in scale]), lambda a, c: a * c).alias("w"))
        theta = own.select("doc_id", normalised("w").alias("w"))
        out.append(NMFFit(theta, phi_table(spark, hts[b] / scale), part.k, v, len(history[b]), history[b][-1],
                          job.divergence, history[b]))
    return out


def normalised(w: str) -> Column:
    """Array scaled to sum 1; an all-zero array stays zero."""
    s = vec.total(w)
    return F.transform(w, lambda a: a / F.when(s == 0, 1.0).otherwise(s))


def phi_table(spark, ht: np.ndarray) -> DataFrame:
    table = pa.table({
        "term_id": pa.array(np.arange(ht.shape[0], dtype=np.int32)), "h": lists(ht)})
    return spark.createDataFrame(table)


# -- the same updates as joins -------------------------------------------------------

def _dot_cols(a: str, b: str, k: int) -> Column:
    out = F.col(a)[0] * F.col(b)[0]
    for t in range(1, k):
        out = out + F.col(a)[t] * F.col(b)[t]
    return out


def _ratio(bow_df: DataFrame, w: DataFrame, h: DataFrame, k: int, h_rows: int | None) -> DataFrame:
    joined = bow_df.join(bounded(h, h_rows), "term_id").join(w, "doc_id")
    r = F.col("cnt") / F.greatest(_dot_cols("w", "h", k), F.lit(EPS))
    return joined.withColumn("r", r)


def kl_h_step(bow_df: DataFrame, w: DataFrame, h: DataFrame, k: int,
              edges: Sequence[tuple[DataFrame, float]] = (), h_rows: int | None = None) -> DataFrame:
    """One KL update of ``h(term_id, h)``: ratio, then sums per term, then the graphs."""
    num = _ratio(bow_df, w, h, k, h_rows).groupBy("term_id").agg(
        vec.sum_arrays("w", k, F.col("r")).alias("num"))
    wsum = w.agg(vec.sum_arrays("w", k).alias("s")).first()["s"]
    den0 = vec.lit_array([float(s) for s in wsum])
    out = h.join(num, "term_id", "left").select(
        "term_id", "h", F.coalesce("num", vec.zeros(k)).alias("num"), den0.alias("den"))
    for e, lam in edges:
        pulled = e.join(bounded(h, h_rows), e["dst"] == h["term_id"]).groupBy("src").agg(
            vec.sum_arrays("h", k, F.col("weight")).alias("ha"), F.sum("weight").alias("deg"))
        out = out.join(pulled, out["term_id"] == pulled["src"], "left").select(
            "term_id", "h",
            F.zip_with("num", F.coalesce("ha", vec.zeros(k)), lambda a, b: a + lam * b).alias("num"),
            F.zip_with("den", "h", lambda a, b: a + lam * b * F.coalesce("deg", F.lit(0.0))).alias("den"))
    step = F.zip_with("h", F.zip_with("num", "den", lambda a, b: a / (b + EPS)), lambda a, b: a * b)
    return out.select("term_id", step.alias("h"))


def kl_w_step(bow_df: DataFrame, w: DataFrame, h: DataFrame, k: int,
              h_rows: int | None = None) -> DataFrame:
    """One KL update of ``w(doc_id, w)`` at the given ``h``."""
    num = _ratio(bow_df, w, h, k, h_rows).groupBy("doc_id").agg(
        vec.sum_arrays("h", k, F.col("r")).alias("num"))
    hsum = h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"]
    den = vec.lit_array([float(s) + EPS for s in hsum])
    step = F.zip_with("w", F.zip_with(F.coalesce("num", vec.zeros(k)), den, lambda a, b: a / b),
                      lambda a, b: a * b)
    return w.join(num, "doc_id", "left").select("doc_id", step.alias("w"))


def frobenius_h_step(bow_df: DataFrame, w: DataFrame, h: DataFrame, k: int,
                     h_rows: int | None = None) -> DataFrame:
    """One Euclidean update of ``h``: ``H * X^T W / (W^T W H)``."""
    num = bow_df.join(w, "doc_id").groupBy("term_id").agg(
        vec.sum_arrays("w", k, F.col("cnt").cast("double")).alias("num"))
    gram = w.agg(F.array(*[F.sum(F.col("w")[i] * F.col("w")[j])
                           for i in range(k) for j in range(k)]).alias("g")).first()["g"]
    den = F.array(*[
        sum((F.col("h")[j] * float(gram[i * k + j]) for j in range(1, k)),
            F.col("h")[0] * float(gram[i * k])) for i in range(k)])
    step = F.zip_with("h", F.zip_with(F.coalesce("num", vec.zeros(k)), den,
                                      lambda a, b: a / (b + EPS)), lambda a, b: a * b)
    return h.join(num, "term_id", "left").select("term_id", step.alias("h"))


def objective_kl(bow_df: DataFrame, w: DataFrame, h: DataFrame, k: int,
                 edges: Sequence[tuple[DataFrame, float]] = (), h_rows: int | None = None) -> float:
    """KL divergence on the support of the counts plus the graph penalties."""
    wh = F.greatest(_dot_cols("w", "h", k), F.lit(EPS))
    joined = bow_df.join(bounded(h, h_rows), "term_id").join(w, "doc_id")
    support = joined.agg(F.sum(F.col("cnt") * (F.log("cnt") - F.log(wh)) - F.col("cnt"))).first()[0]
    ws = np.asarray(w.agg(vec.sum_arrays("w", k).alias("s")).first()["s"], dtype=float)
    hs = np.asarray(h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"], dtype=float)
    value = float(support or 0.0) + float(ws @ hs)
    for e, lam in edges:
        a = bounded(h.select(F.col("term_id").alias("src"), F.col("h").alias("ha")), h_rows)
        b = bounded(h.select(F.col("term_id").alias("dst"), F.col("h").alias("hb")), h_rows)
        pen = e.join(a, "src").join(b, "dst").agg(
            F.sum(F.col("weight") * (_dot_cols("ha", "ha", k) - _dot_cols("ha", "hb", k)))).first()[0]
        value += lam * float(pen or 0.0)
    return value


def fit_joined(bow_df: DataFrame, vocab: DataFrame, num_topics: int, *,
               edges: Sequence[tuple[DataFrame, float]] = (), max_iter: int = 200,
               tol: float = 1e-4, seed: int = 42, h_rows: int | None = None) -> NMFFit:
    """KL fit with H as a distributed table, for vocabularies without a bound.

    Both factors are written to the checkpoint folder after each iteration.
    """
    k = num_topics
    index = F.sequence(F.lit(0), F.lit(k - 1))
    w = cut_lineage(bow_df.select("doc_id").distinct().withColumn("w", F.transform(
        index, lambda t: seeded.uniform(seed, F.lit("w"), F.col("doc_id"), t))))
    h = cut_lineage(vocab.select("term_id").withColumn("h", F.transform(
        index, lambda t: seeded.uniform(seed, F.lit("h"), F.col("term_id"), t))))
    history: list[float] = []
    n_iter = 0
    for n_iter in range(1, max_iter + 1):
        h = cut_lineage(kl_h_step(bow_df, w, h, k, edges, h_rows))
        w = cut_lineage(kl_w_step(bow_df, w, h, k, h_rows))
        history.append(objective_kl(bow_df, w, h, k, edges, h_rows))
        if n_iter > 1 and abs(history[-2] - history[-1]) / abs(history[-2]) < tol:
            break
    sums = [float(s) or 1.0 for s in h.agg(vec.sum_arrays("h", k).alias("s")).first()["s"]]
    phi = h.select("term_id", F.zip_with("h", vec.lit_array(sums), lambda a, b: a / b).alias("h"))
    theta = w.select("doc_id", F.zip_with("w", vec.lit_array(sums), lambda a, b: a * b).alias("w")) \
        .select("doc_id", normalised("w").alias("w"))
    return NMFFit(theta, phi, k, vocab.count(), n_iter, history[-1], "kl", history)


# -- scoring new documents ---------------------------------------------------------

def fold_in(docs: DataFrame, h: np.ndarray, *, n_iter: int = 100, seed: int = 42,
            divergence: str = "kl") -> DataFrame:
    """``(doc_id, w)`` for ``docs(doc_id, ids, cnts)`` with H fixed, rows summing to 1.

    Each document is independent: one Arrow pass, no shuffle, batch or streaming. A
    document without a known term gets zeros.
    """
    k = h.shape[0]
    ht = np.ascontiguousarray(h.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hsum, hht = _known(ht)
        for rb in blocks(batches):
            ids, x, rows, sizes = sparse(rb, 1, 2)
            w, hk = dense(rb.column(3), k), at_entries(ht, ids)
            for _ in range(n_iter):
                w = _step_w(w, hk, hsum, hht, x, sizes, divergence, rows)
            s = w.sum(axis=1, keepdims=True)
            s[s == 0] = 1.0
            yield pa.RecordBatch.from_arrays([rb.column(0), lists(w / s)], names=["doc_id", "w"])

    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda t: seeded.uniform(seed, F.lit("fold"), F.col("doc_id"), t) + 1e-3)
    empty = F.array().cast("array<int>")
    return docs.select(
        "doc_id", F.coalesce(F.col("ids").cast("array<int>"), empty).alias("ids"),
        F.coalesce(F.col("cnts").cast("array<double>"), empty.cast("array<double>")).alias("cnts"),
        start.alias("w0")).mapInArrow(run, "doc_id bigint, w array<double>")


def perplexity(docs: DataFrame, theta: DataFrame, h: np.ndarray) -> float:
    """``exp(-sum x ln p / sum x)`` over the known words of ``docs(doc_id, ids, cnts)``."""
    k = h.shape[0]
    ht = np.ascontiguousarray(h.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hsum = ht.sum(axis=0)
        ll = mass = 0.0
        for rb in batches:
            ids, x, rows, _ = sparse(rb, 0, 1)
            w = dense(rb.column(2), k)
            total = w @ hsum
            total[total == 0] = 1.0
            p = np.einsum("ij,ij->i", w[rows], ht[ids]) / total[rows]
            ll += float(np.sum(x * np.log(np.maximum(p, 1e-300))))
            mass += float(x.sum())
        yield pa.RecordBatch.from_arrays([pa.array([ll]), pa.array([mass])], names=["ll", "mass"])

    row = (
        docs.where(F.size("ids") > 0).join(theta, "doc_id")
        .select(F.col("ids").cast("array<int>").alias("ids"), "cnts", "w")
        .mapInArrow(run, "ll double, mass double").agg(F.sum("ll"), F.sum("mass")).first()
    )
    if not row[1]:
        raise ValueError("no held-out token is in the fitted vocabulary; perplexity is undefined")
    return float(np.exp(-row[0] / row[1]))


# -- alignment and stability -------------------------------------------------------

def assign(similarity: np.ndarray) -> np.ndarray:
    """Column for each row of a square K x K table with the largest total (Hungarian)."""
    cost = -np.asarray(similarity, dtype=float)
    n = cost.shape[0]
    u, p = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    v = np.zeros(n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, way = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        used = np.zeros(n + 1, dtype=bool)
        while p[j0]:
            used[j0] = True
            cur = np.append(np.inf, cost[p[j0] - 1] - u[p[j0]] - v[1:])
            better = ~used & (cur < low)
            low[better], way[better] = cur[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, low)))
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = np.zeros(n, dtype=int)
    out[p[1:] - 1] = np.arange(n)
    return out


def topic_cosines(a: DataFrame, b: DataFrame, k: int) -> np.ndarray:
    """K x K cosines of two topic tables ``(term_id, h)``, summed in one join."""
    prods = [F.sum(F.col("h")[i] * F.col("g")[j]) for i in range(k) for j in range(k)]
    norms = [F.sum(F.col(c)[i] * F.col(c)[i]) for c in ("h", "g") for i in range(k)]
    row = a.join(b.select("term_id", F.col("h").alias("g")), "term_id", "full").agg(
        F.array(*[F.coalesce(p, F.lit(0.0)) for p in prods]).alias("p"),
        F.array(*[F.coalesce(p, F.lit(0.0)) for p in norms]).alias("n")).first()
    dots = np.array(row["p"]).reshape(k, k)
    n = np.maximum(np.sqrt(np.array(row["n"])), 1e-12)
    return dots / np.outer(n[:k], n[k:])


def match_topics(ref: DataFrame, new: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one alignment of topics by maximum cosine: columns and similarities."""
    sim = topic_cosines(ref, new, k)
    cols = assign(sim)
    return cols, sim[np.arange(k), cols]


def bootstrap(docs: DataFrame, reference: NMFFit, n_resamples: int = 20, seed: int = 0,
              graphs=(), max_iter: int = 200, tol: float = 1e-4, init: str = "svd") -> DataFrame:
    """``(topic, stability, stability_sd, prevalence_sd, topic_stability)``.

    A resample gives each document a Poisson(1) count drawn from its id; only the
    factorisation is repeated, for all resamples in the same passes.
    """
    k = reference.num_topics
    counts = [seeded.poisson1(seeded.uniform(f"{seed}:{b}", "doc_id")) for b in range(n_resamples)]
    fits = fit_many(docs, reference.n_terms, [
        Job(k, reference.divergence, graphs, seed + b + 1, counts[b], max_iter, tol, init) for b in range(n_resamples)])
    sims, prev = [], []
    for res, count in zip(fits, counts):
        _, s = match_topics(reference.phi, res.phi, k)
        sims.append(s)
        means = res.theta.withColumn("c", count).agg(
            *[(F.sum(F.col("w")[i] * F.col("c")) / F.sum("c")) for i in range(k)]).first()
        prev.append([float(x) for x in means])
    sims, prev = np.array(sims), np.array(prev)
    sd = sims.std(axis=0, ddof=1) if len(sims) > 1 else np.zeros(k)
    psd = prev.std(axis=0, ddof=1) if len(prev) > 1 else np.zeros(k)
    rows = [(t, float(sims[:, t].mean()), float(sd[t]), float(psd[t]), float(sims.mean()))
            for t in range(k)]
    return docs.sparkSession.createDataFrame(
        rows, "topic int, stability double, stability_sd double, prevalence_sd double, "
              "topic_stability double")
