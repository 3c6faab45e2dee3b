"""Word graphs: syntax graph, k-NN graph, PMI cut and control graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions.rank import numbered
from ..session import DRIVER_CELLS, bounded, cut_lineage, release, settle
from . import cooc


def top_k_edges(edges: DataFrame, top_k: int, by: str = "weight") -> DataFrame:
    """The strongest ``top_k`` edges of each source, lower id first on ties."""
    w = Window.partitionBy("src").orderBy(F.desc(by), "dst")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges present in both directions, with the smaller weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                        F.col("weight").alias("w2"))
    return edges.join(back, ["src", "dst"]).select(
        "src", "dst", F.least("weight", "w2").alias("weight"))


def syntax_graph(pairs: DataFrame, top_k: int = 15) -> DataFrame:
    """Symmetrised, row-max scaled, mutual top-k graph from ``(src, dst, weight)``."""
    sym = (
        cooc.mirrored(pairs.where(F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    )
    peak = sym.groupBy("src").agg(F.max("weight").alias("m"))
    scaled = sym.join(peak, "src").select("src", "dst", (F.col("weight") / F.col("m")).alias("weight"))
    return mutual(top_k_edges(scaled, top_k))


def degree(edges: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """``(term_id, degree)`` with 0 for isolated words."""
    sums = edges.groupBy(F.col("src").alias("term_id")).agg(F.sum("weight").alias("degree"))
    return vocab.select("term_id").join(bounded(sums, bound), "term_id", "left").select(
        "term_id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def knn_graph(vectors: DataFrame, top_k: int = 15, block: int = 4096) -> DataFrame:
    """Mutual cosine k-NN graph over ``(term_id, vec)``; negatives count as 0.

    The vectors are cut into blocks. Each task scores one block of rows against one
    block of columns and sends on only ``top_k`` candidates per row, so the memory of
    a task is fixed whatever the vocabulary, and a last ranking merges the blocks.
    """
    n = vectors.count()
    parts = max(1, -(-n // block))
    blocked = vectors.select(
        "term_id", F.col("vec").cast("array<double>").alias("vec"),
        F.pmod(F.xxhash64("term_id"), F.lit(parts)).cast("int").alias("b"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = blocked.select("term_id", "vec", F.col("b").alias("bi"), spread.alias("bj"))
    right = blocked.select(F.col("term_id").alias("term_id"), F.col("vec").alias("vec"),
                           spread.alias("bi"), F.col("b").alias("bj"))

    def score(_key, rows: pd.DataFrame, cols: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or cols.empty:
            return pd.DataFrame({"src": [], "dst": [], "weight": []})
        a, b = (np.vstack(p["vec"].to_numpy()) for p in (rows, cols))
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
        ri, ci = rows["term_id"].to_numpy(), cols["term_id"].to_numpy()
        order = np.argsort(ci)
        ci, b = ci[order], b[order]
        out = []
        for s in range(0, len(ri), 512):
            sims = a[s:s + 512] @ b.T
            sims[ri[s:s + 512, None] == ci[None, :]] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")[:, :top_k]
            vals = np.take_along_axis(sims, best, axis=1)
            ok = np.isfinite(vals)
            out.append(pd.DataFrame({
                "src": np.repeat(ri[s:s + 512], ok.sum(axis=1)), "dst": ci[best][ok],
                "weight": vals[ok]}))
        return pd.concat(out)

    near = (
        left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj"))
        .applyInPandas(score, "src int, dst int, weight double")
    )
    kept = top_k_edges(near, top_k).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    return mutual(kept).where(F.col("weight") > 0)


def pmi_sparsify(edges: DataFrame, docs: DataFrame, n_docs: int, top_k: int = 15,
                 bound: int | None = None) -> DataFrame:
    """Edges whose document-level PMI is positive, the best ``top_k`` per source.

    Duplicate edges are collapsed first and stay as the multiplicity ``mult``.
    ``top_k=0`` keeps all of them. Only the cells of the edges are kept.
    """
    merged = settle(edges.groupBy("src", "dst").agg(F.sum("mult").alias("mult")), "edges")
    df = docs.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    merged = merged.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    co = cooc.edge_counts(docs, merged.where(F.col("lo") < F.col("hi")).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))).select(
        F.col("src").alias("lo"), F.col("dst").alias("hi"), "cnt")
    ns = bounded(df.select(F.col("t").alias("src"), F.col("df").alias("ns")), bound)
    nd = bounded(df.select(F.col("t").alias("dst"), F.col("df").alias("nd")), bound)
    scored = (
        merged.join(co, ["lo", "hi"]).join(ns, "src").join(nd, "dst")
        .withColumn("ppmi", F.log(F.col("cnt") * F.lit(float(n_docs)) / (F.col("ns") * F.col("nd"))))
        .where(F.col("ppmi") > 0)
        .select("src", "dst", "mult", "ppmi")
    )
    return top_k_edges(scored, top_k, by="ppmi") if top_k > 0 else scored


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") < F.col("dst"))


def rewire(edges: DataFrame, seed: int = 0, rounds: int = 10, directed: bool = False) -> DataFrame:
    """Degree-preserving control graph by rounds of parallel 2-edge swaps.

    Each round puts edges into random buckets of about two, and an edge pair
    ``(u,v),(x,y)`` proposes ``(u,y),(x,v)``. A proposal is dropped when an endpoint
    repeats, when a new edge already exists, or when two proposals want the same new
    edge, so every round leaves a simple graph with the same degrees and weights.
    Self-loops of a directed multigraph are left alone. A round moves the edges three times:
    into buckets, by their ends as bare keys, and to the pairs whose swap is free.
    """
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    state = edges if directed else undirected(edges)
    order = Window.partitionBy("src", "dst").orderBy(*(cols or ["src"]))
    state = state.withColumn(
        "eid", F.xxhash64("src", "dst", F.row_number().over(order)))
    state = cut_lineage(state.select("eid", "src", "dst", *cols))
    n = state.count()
    if n < 2 or rounds < 1:
        return _close(state, cols, directed)
    rows = _proposed(state, cols, f"{seed}:0", n)
    for r in range(rounds):
        keys = F.explode(F.array(
            F.struct(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(None).cast("bigint").alias("eid")),
            F.struct(F.least("ns", "nd").alias("lo"), F.greatest("ns", "nd").alias("hi"), F.col("eid").alias("eid")))).alias("k")
        # one count by edge tells both what is there already and who wants it
        free = (
            rows.select(keys, "pid").select("k.*", "pid").where(F.col("lo").isNotNull())
            .groupBy("lo", "hi").agg(F.count("eid").alias("claims"), F.count(F.lit(1)).alias("all"), F.max(F.when(F.col("eid").isNotNull(), F.col("pid"))).alias("pid"))
            .where((F.col("claims") == 1) & (F.col("all") == 1))
        )
        both = free.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select("pid", F.lit(True).alias("moved"))
        moved = F.col("moved").isNotNull()
        state = rows.join(both, "pid", "left").select(
            "eid", F.when(moved, F.col("ns")).otherwise(F.col("src")).alias("src"),
            F.when(moved, F.col("nd")).otherwise(F.col("dst")).alias("dst"), *cols)
        old, rows = rows, _proposed(state, cols, f"{seed}:{r + 1}", n) if r + 1 < rounds else settle(state, "rewired")
        release(old)
    return _close(rows.select("eid", "src", "dst", *cols), cols, directed)


def _proposed(state: DataFrame, cols: list[str], seed: str, n: int) -> DataFrame:
    """The edges with the swap of a round: ``(pid, ns, nd)``, the pair and the edge it would become, null without one.

    Edges of a bucket are paired in the order of their ids; both partners read each other in one
    window. The rows are written, since they are read for the counts and for the moves.
    """
    bucket = F.floor(seeded.uniform(seed, "eid") * max(1, n // 2))
    w = Window.partitionBy("b", "loop").orderBy("eid")
    ahead, behind = ([move(c).over(w) for c in ("eid", "src", "dst")] for move in (F.lead, F.lag))
    first = F.col("s") % 2 == 1
    paired = state.select("eid", "src", "dst", *cols, bucket.alias("b"), (F.col("src") == F.col("dst")).alias("loop")).select(
        "eid", "src", "dst", *cols, "loop", F.row_number().over(w).alias("s"),
        *[c.alias(f"a{i}") for i, c in enumerate(ahead)], *[c.alias(f"z{i}") for i, c in enumerate(behind)])
    other = [F.when(first, F.col(f"a{i}")).otherwise(F.col(f"z{i}")) for i in range(3)]
    met = paired.select("eid", "src", "dst", *cols, "loop", first.alias("first"), *[c.alias(f"o{i}") for i, c in enumerate(other)])
    ok = ~F.col("loop") & (F.col("src") != F.col("o1")) & (F.col("src") != F.col("o2")) & (F.col("dst") != F.col("o1")) & (F.col("dst") != F.col("o2"))
    return settle(met.select(
        "eid", "src", "dst", *cols, F.when(ok, F.when(F.col("first"), F.col("eid")).otherwise(F.col("o0"))).alias("pid"),
        # (u,v),(x,y) become (u,y),(x,v): each keeps its start and takes the other's end
        F.when(ok, F.col("src")).alias("ns"), F.when(ok, F.col("o2")).alias("nd")), "swaps")


def _close(state: DataFrame, cols: list[str], directed: bool) -> DataFrame:
    out = state.select("src", "dst", *cols)
    return out if directed else cooc.mirrored(out)


def permutation(vocab: DataFrame, seed: int = 0) -> DataFrame:
    """``(term_id, new_id)``: the vocabulary in a seeded random order."""
    drawn = vocab.select("term_id", seeded.uniform(seed, "term_id").alias("_u"))
    return numbered(drawn, ["_u", "term_id"], "new_id").select("term_id", F.col("new_id").cast("int").alias("new_id"))


def permuted_graph(edges: DataFrame, vocab: DataFrame, seed: int = 0,
                   bound: int | None = None) -> DataFrame:
    """The same graph attached to shuffled words."""
    perm = permutation(vocab, seed)
    a = bounded(perm.select(F.col("term_id").alias("src"), F.col("new_id").alias("ns")), bound)
    b = bounded(perm.select(F.col("term_id").alias("dst"), F.col("new_id").alias("nd")), bound)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(
        F.col("ns").alias("src"), F.col("nd").alias("dst"), *rest)


def graph_stats(vocab: DataFrame, edges: DataFrame, doc_word: DataFrame, relates: DataFrame) -> DataFrame:
    """One row of sizes: nodes, undirected edges, doc-word and word-word edges."""
    spark = vocab.sparkSession
    n_dw = doc_word.count()
    n_ww = relates.agg(F.coalesce(F.sum("mult"), F.lit(0))).first()[0]
    row = (vocab.count(), edges.count() // 2, n_dw, int(n_ww), 2 * n_dw + int(n_ww))
    return spark.createDataFrame(
        [row], "n_nodes bigint, n_edges bigint, n_dw bigint, n_ww bigint, effective_edges bigint")


def edge_arrays(edges: DataFrame, n_terms: int, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pruned graph as driver arrays; mutual top-k bounds it by V * top_k edges."""
    if n_terms * top_k > DRIVER_CELLS:
        raise ValueError("graph too large for the driver; use the join solver")
    pdf = edges.select("src", "dst", "weight").toPandas()
    return pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy()
