"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a weight. The neighbour graph starts from random
hyperplanes: for each of several tables the nodes are put in the order of their sign codes
by a range partitioning, so a crowded code is spread over tasks, and nodes that stand close
in that order are compared. Then NN-descent: the neighbours of a node, in both directions,
are joined with each other, and every node keeps its ``K`` best, until few lists change.
In the first tables only neighbours of cosine ``FLOOR`` or more get a place.

A list that is full of links is saturated: its node may have more. The components that hold
saturated nodes are therefore enlarged to all their pairs, in blocks of ``BLOCK`` nodes,
each pair of blocks in its own group; a group returns link counts, not pairs. Before that
they are compared with each other, as the full lists of two tight groups have no place for
the links between them: each block is covered by balls around some of its nodes, the centres
of all balls are compared in blocks, and where centres and radii leave room for a link
between two components, so are the members. No pair of nodes is left out by this.

An audit compares sampled nodes with all rows and measures the share of links found. It goes
on, ``AUDIT`` nodes and more at a time, until ``ENOUGH`` of them have links or every node was
taken; while the share is below ``RECALL``, more tables are added, and lists then keep far
neighbours too, as ways to near ones. If every node was taken and a link is missing, or the
last tables leave the share too low, all pairs are counted in blocks.

Cosines are in double precision. Vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing; so do vectors of different lengths. Rows without a
``vec_id`` link with nothing and have a null component; rows that repeat an id count as
vectors of their own with one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flat import column, tidied
from .tables import by_group, components, modest_batches, settle, staged

LINK, FLOOR = 0.9, 0.6
TABLES, MOST_BATCHES, WINDOW = 10, 6, 96
K, ROUNDS, CHANGED = 16, 6, 0.001
BLOCK = 512
#: Nodes of this cosine or more to a centre are in its ball; any value gives the same links.
COVER = 0.98
AUDIT, ENOUGH, RECALL = 1024, 100, 0.97


def unit(rows: list[bytes]) -> np.ndarray:
    """Vectors in double precision with length one."""
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null where a vector can link with nothing."""
    for batch in batches:
        out, dims = [], []
        for v in column(batch, "embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            size = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if size > 0:
                x = x / size
                out.append((x / np.sqrt(x @ x)).tobytes())
            else:
                out.append(None)
            dims.append(len(x))
        yield pa.RecordBatch.from_pydict({"vec_id": column(batch, "vec_id"), "dim": pa.array(dims, pa.int32()), "vec": pa.array(out, pa.binary())})


def _codes(batches: Iterator[pa.RecordBatch], first: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Every node once a table, with its 62 sign bits under that table's hyperplanes."""
    for batch in batches:
        dims = np.array(column(batch, "dim").to_pylist())
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            x = unit(column(part, "vec").to_pylist())
            for t in range(first, first + tables):
                planes = np.random.default_rng([t, d, 77]).standard_normal((d, 62))
                code = (x @ planes > 0) @ (1 << np.arange(62, dtype=np.int64))
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(x), t), pa.int32()), "code": code, "node": column(part, "node"), "dim": column(part, "dim"), "vec": column(part, "vec")})


def best_pairs(nodes: np.ndarray, x: np.ndarray, open_: np.ndarray | None = None, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its ``K`` best others of cosine ``floor`` or more, as (u, v, cosine).

    ``open_`` says which pairs (a matrix) or which nodes' pairs (a vector) are asked for.
    """
    s = cosines(x, x)
    np.fill_diagonal(s, -2)
    s[nodes[:, None] == nodes[None, :]] = -2
    if open_ is not None:
        s[~open_] = -2
    k = min(K, len(nodes) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(nodes) - 1 else np.argsort(-s, axis=1)[:, :k]
    value = np.take_along_axis(s, top, 1)
    r, c = np.nonzero(value >= floor)
    return nodes[r], nodes[top[r, c]], value[r, c]


def _pairs_batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(z) for z in zip(*found))
    return pa.RecordBatch.from_pydict({"u": u, "v": v, "s": s})


def _neighbours_in_order(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Compare nodes that stand close in the order, in windows that overlap by half."""
    held: list[tuple[int, int, bytes]] = []
    place: tuple[int, int] | None = None

    def joined(upto: int) -> Iterator[pa.RecordBatch]:
        found = []
        for lo in range(0, max(upto - WINDOW // 2, 1), WINDOW // 2):
            part = held[lo:lo + WINDOW]
            if len(part) > 1:
                found.append(best_pairs(np.array([p[0] for p in part]), unit([p[2] for p in part]), floor=floor))
        if found:
            yield _pairs_batch(found)

    for batch in batches:
        for node, t, d, vec in zip(*(column(batch, c).to_pylist() for c in ("node", "part", "dim", "vec"))):
            if place != (t, d):
                yield from joined(len(held))
                held, place = [], (t, d)
            held.append((node, t, vec))
            if len(held) >= 64 * WINDOW:
                yield from joined(len(held))
                held = held[-WINDOW // 2:]
    yield from joined(len(held))


def _join_members(group: pa.Table, floor: float) -> pa.RecordBatch | None:
    side, same = group.column("side").to_numpy(), group.column("a")[0] == group.column("b")[0]
    nodes = group.column("node").to_numpy()
    open_ = group.column("open").to_numpy(zero_copy_only=False).astype(bool)
    dims = group.column("dim").to_numpy()
    found = []
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        if len(at) > 1 and open_[at].any():
            vecs = group.column("vec").take(pa.array(at)).to_pylist()
            asked = open_[at][:, None] & (side[at][:, None] != side[at][None, :]) if not same else open_[at]
            found.append(best_pairs(nodes[at], unit(vecs), asked, floor))
    return _pairs_batch(found) if found else None


def best_lists(pairs: DataFrame) -> DataFrame:
    """The ``K`` best entries of each node."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    one = pairs.groupBy("u", "v").agg(F.max("s").alias("s"))
    return one.withColumn("_k", rank).where(F.col("_k") <= K).drop("_k")


def saturated(lists: DataFrame) -> DataFrame:
    """Nodes whose whole list is links."""
    return lists.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("least")).where((F.col("n") >= K) & (F.col("least") >= LINK)).select(F.col("u").alias("node"))


def in_blocks(rows: DataFrame, size: str, block: int, *cols: str) -> DataFrame:
    """``cols`` of every row once for each pair (a, b) of blocks that its own is one of."""
    rows = rows.withColumn("of", F.ceil(F.col(size) / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return rows.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).cast("int").alias("side"), *cols)


def descend(lists: DataFrame, nodes: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Join neighbours of neighbours until few lists change, all members of a hub with each other."""
    size_of = lists.select("u").distinct().count()
    for _ in range(ROUNDS):
        full = saturated(lists).withColumn("full", F.lit(True))
        member = lists.select(F.col("u").alias("hub"), F.col("v").alias("node")).unionByName(lists.select(F.col("v").alias("hub"), F.col("u").alias("node"))).distinct()
        member = member.join(full, "node", "left").select("hub", "node", F.isnull("full").alias("open"))
        size = member.groupBy("hub").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any").drop("any")
        rows = in_blocks(member.join(size, "hub").join(nodes.select("node", "dim", "vec"), "node"), "n", BLOCK, "hub", "node", "open", "dim", "vec")
        found = by_group(rows, ["hub", "a", "b"], lambda g: _join_members(g, floor), "u long, v long, s double")
        better = staged(best_lists(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).unionByName(lists)), size_of * K, "lists")
        moved = better.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
        total = lists.count()
        lists = better
        if moved <= CHANGED * total:
            break
    return lists


def _count_links(group: pa.Table) -> pa.RecordBatch | None:
    """Weights of the links of each node in a pair of blocks."""
    side = group.column("side").to_numpy()
    nodes, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
    x = unit(group.column("vec").to_pylist())
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if group.column("a")[0] == group.column("b")[0]:
        hit = cosines(x, x) >= LINK
        np.fill_diagonal(hit, False)
        return pa.RecordBatch.from_pydict({"node": nodes, "n": hit @ weight})
    if not len(a) or not len(b):
        return None
    hit = cosines(x[a], x[b]) >= LINK
    return pa.RecordBatch.from_pydict({"node": np.r_[nodes[a], nodes[b]], "n": np.r_[hit @ weight[b], hit.T @ weight[a]]})


def _forest(hit: np.ndarray) -> np.ndarray:
    """For each node another that it is linked to, so that the links given join what ``hit`` joins; -1 for none."""
    to, fresh = np.full(len(hit), -1), np.ones(len(hit), bool)
    for i in range(len(hit)):
        if fresh[i]:
            fresh[i] = False
            todo = [i]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(hit[at] & fresh)
                fresh[new] = False
                to[new] = at
                todo += new.tolist()
    return to


def _span_links(group: pa.Table) -> pa.RecordBatch | None:
    """Links (a, b) that join whatever the links in a pair of blocks join."""
    nodes = group.column("node").to_numpy()
    x = unit(group.column("vec").to_pylist())
    hit = cosines(x, x) >= LINK
    np.fill_diagonal(hit, False)
    to = _forest(hit)
    at = np.flatnonzero(to >= 0)
    return pa.RecordBatch.from_pydict({"a": np.minimum(nodes[at], nodes[to[at]]), "b": np.maximum(nodes[at], nodes[to[at]])})


def _pairs_of_blocks(members: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    size = members.groupBy("component").agg(F.count("*").alias("size"))
    return in_blocks(members.join(size, "component").join(nodes, "node"), "size", block, "component", "node", "weight", "vec")


def enlarged(members: DataFrame, nodes: DataFrame, block: int | None = None) -> DataFrame:
    """(node, n): links within the given components, over all their pairs in blocks."""
    counts = by_group(_pairs_of_blocks(members, nodes, block or BLOCK), ["component", "a", "b"], _count_links, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def exact(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (node, component) over all pairs of vectors of one length."""
    members = nodes.select("node", F.col("dim").cast("long").alias("component"))
    counts = settle(enlarged(members, nodes, 4 * BLOCK).where("n > 0"), "counts")
    links = by_group(_pairs_of_blocks(members.join(counts.select("node"), "node", "left_semi"), nodes, 4 * BLOCK), ["component", "a", "b"], _span_links, "a long, b long")
    return counts, components(settle(links.distinct(), "links"))


def _cover(group: pa.Table) -> pa.RecordBatch:
    """Balls that hold all nodes of a block, as (node, ball, cosine to the ball's centre)."""
    nodes = group.column("node").to_numpy()
    x = unit(group.column("vec").to_pylist())
    s = cosines(x, x)
    np.fill_diagonal(s, 1.0)
    ball = np.full(len(nodes), -1)
    for i in range(len(nodes)):
        if ball[i] < 0:
            ball[(ball < 0) & (s[i] >= COVER)] = i
    return pa.RecordBatch.from_pydict({"component": group.column("component").to_numpy(), "node": nodes, "ball": nodes[ball], "near": s[ball, np.arange(len(nodes))]})


def _one_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First place of every different pair of components."""
    return np.unique(np.stack([a, b], 1), axis=0, return_index=True)[1]


def _close_balls(group: pa.Table) -> pa.RecordBatch | None:
    """Pairs of balls in a pair of blocks that can hold a link between two components.

    ``sure`` are links of the centres, one for each pair of components; the other pairs of
    balls of such components are not needed.
    """
    side = group.column("side").to_numpy()
    ball, comp, near = (group.column(c).to_numpy() for c in ("ball", "component", "near"))
    x = unit(group.column("vec").to_pylist())
    same = group.column("a")[0] == group.column("b")[0]
    a, b = (np.arange(len(ball)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    s = cosines(x[a], x[b])
    radius = np.arccos(np.clip(near, -1, 1))
    room = np.arccos(LINK) + radius[a][:, None] + radius[b][None, :] + 1e-6
    i, j = np.nonzero((comp[a][:, None] != comp[b][None, :]) & ((s >= LINK) | (np.arccos(np.clip(s, -1, 1)) <= room)))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return None
    sure, u, v = s[i, j] >= LINK, a[i], b[j]
    lo, hi = np.minimum(comp[u], comp[v]), np.maximum(comp[u], comp[v])
    known = np.flatnonzero(sure)[_one_each(lo[sure], hi[sure])]
    joined = set(zip(lo[known].tolist(), hi[known].tolist()))
    rest = [k for k in np.flatnonzero(~sure).tolist() if (lo[k], hi[k]) not in joined]
    k = np.r_[known, np.array(rest, np.int64)].astype(np.int64)
    return pa.RecordBatch.from_pydict({"x": ball[u[k]], "y": ball[v[k]], "cx": comp[u[k]], "cy": comp[v[k]], "sure": sure[k]})


def _bridge(group: pa.Table) -> pa.RecordBatch | None:
    """One link between the members of two balls, if there is any."""
    side, nodes = group.column("side").to_numpy(), group.column("node").to_numpy()
    x = unit(group.column("vec").to_pylist())
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    s = cosines(x[a], x[b])
    i, j = np.unravel_index(int(s.argmax()), s.shape)
    if s[i, j] < LINK:
        return None
    ends = sorted((int(nodes[a[i]]), int(nodes[b[j]])))
    return pa.RecordBatch.from_pydict({"a": pa.array(ends[:1], pa.int64()), "b": pa.array(ends[1:], pa.int64())})


def bridges(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the given components wherever any of their nodes are linked."""
    size = members.groupBy("component").agg(F.count("*").alias("size"))
    rows = members.join(size, "component").join(nodes.select("node", "vec"), "node")
    rows = rows.select("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("i"), "node", "vec")
    held = settle(by_group(rows, ["component", "i"], _cover, "component long, node long, ball long, near double"), "balls")
    balls = held.groupBy("component", "ball").agg(F.min("near").alias("near")).join(nodes.select(F.col("node").alias("ball"), "dim", "vec"), "ball")
    of = max(1, -(-held.select("ball").distinct().count() // BLOCK))
    balls = balls.withColumn("i", F.pmod(F.xxhash64("ball"), F.lit(of)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(of - 1))))
    balls = balls.select("dim", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).cast("int").alias("side"), "component", "ball", "near", "vec")
    close = settle(by_group(balls, ["dim", "a", "b"], _close_balls, "x long, y long, cx long, cy long, sure boolean"), "close")
    sure = close.where("sure").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    merged = components(close.where("sure").select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")))
    at = lambda c, m: merged.select(F.col("node").alias(c), F.col("component").alias(m))
    open_ = close.where("NOT sure").join(at("cx", "mx"), "cx", "left").join(at("cy", "my"), "cy", "left")
    open_ = open_.where(F.coalesce("mx", "cx") != F.coalesce("my", "cy")).select("x", "y")
    inside = held.select("ball", "node").join(nodes.select("node", "vec"), "node")
    sides = [open_.withColumn("ball", F.col(c)).join(inside, "ball").select("x", "y", F.lit(k).alias("side"), "node", "vec") for k, c in enumerate("xy")]
    return sure.unionByName(by_group(sides[0].unionByName(sides[1]), ["x", "y"], _bridge, "a long, b long"))


def link_counts(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (node, component) of the graph's links."""
    edges = lists.where(F.col("s") >= LINK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    edges = staged(edges, lists.count(), "links")
    comp = components(edges)
    full = saturated(lists)

    def with_full(comp: DataFrame) -> DataFrame:
        return staged(comp.join(full.join(comp, "node").select("component").distinct(), "component", "left_semi").select("node", "component"), edges.count(), "crowded")

    crowded = with_full(comp)
    between = staged(bridges(crowded, nodes), edges.count(), "bridges") if crowded.select("component").distinct().limit(2).count() > 1 else None
    if between is not None and not between.isEmpty():
        comp = components(edges.unionByName(between))
        crowded = with_full(comp)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    plain = ends.join(crowded, "node", "left_anti").join(nodes.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.sum("weight").alias("n"))
    return staged(plain.unionByName(enlarged(crowded, nodes)), 2 * edges.count(), "counts"), comp


def _true_links(batches: Iterator[pa.RecordBatch], sample: dict[int, tuple[list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Weights of the rows that each sampled node is linked to, itself among them."""
    total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in sample.items()}
    for batch in batches:
        dims = np.array(column(batch, "dim").to_pylist())
        for d, (_, x) in sample.items():
            part = batch.filter(pa.array(dims == d))
            for lo in range(0, part.num_rows, AUDIT):
                some = part.slice(lo, AUDIT)
                total[d] += (cosines(x, unit(column(some, "vec").to_pylist())) >= LINK) @ column(some, "weight").to_numpy()
    for d, (ids, _) in sample.items():
        yield pa.RecordBatch.from_pydict({"node": ids, "truth": total[d]})


def audit(counts: DataFrame, nodes: DataFrame) -> tuple[float, bool]:
    """Mean share of its links that was found, over sampled nodes that have links, and whether all nodes were sampled.

    The nodes are dealt into parts of about ``AUDIT`` by a hash; one, two, then four parts at
    a time, so that what goes to the tasks is bounded, are compared with all rows.
    """
    parts = max(1, -(-nodes.count() // AUDIT))
    done, share, linked, step = 0, 0.0, 0, 1
    while done < parts and linked < ENOUGH:
        by_dim: dict[int, tuple[list[int], list[bytes]]] = {}
        for r in nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)).between(done, done + step - 1)).select("node", "dim", "vec").collect():
            ids, vecs = by_dim.setdefault(r["dim"], ([], []))
            ids.append(r["node"])
            vecs.append(bytes(r["vec"]))
        sample = {d: (ids, unit(vecs)) for d, (ids, vecs) in by_dim.items()}
        truth = nodes.mapInArrow(lambda it, sample=sample: _true_links(it, sample), "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
        truth = truth.join(nodes.select("node", "weight"), "node").select("node", (F.col("truth") - F.col("weight")).alias("truth")).where("truth > 0")
        row = truth.join(counts, "node", "left").agg(F.sum(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("truth"))), F.count("*")).first()
        share, linked, done, step = share + (row[0] or 0.0), linked + row[1], done + step, min(2 * step, 4)
    return share / linked if linked else 1.0, done >= parts


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    rows = settle(modest_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                  .mapInArrow(lambda it: tidied(_clean(it)), "vec_id long, dim int, vec binary").withColumn("node", F.when(F.col("vec_id").isNotNull() & F.col("vec").isNotNull(), F.xxhash64("vec"))), "vectors")
    nodes = settle(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("dim").alias("dim"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.min("vec_id").alias("vec_id")), "nodes")
    bare = nodes.drop("vec_id")
    lists = None
    for batch in range(MOST_BATCHES):
        floor = FLOOR if batch == 0 else -1.0
        codes = bare.mapInArrow(lambda it, t=batch * TABLES: tidied(_codes(it, t, TABLES)), "part int, code long, node long, dim int, vec binary")
        order = ["part", "dim", "code", "node"]
        near = codes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it, floor=floor: tidied(_neighbours_in_order(it, floor)), "u long, v long, s double")
        lists = settle(best_lists(near if lists is None else near.unionByName(lists)), "lists")
        lists = descend(lists, bare, floor)
        counts, comp = link_counts(lists, bare)
        share, whole = audit(counts, bare)
        if share >= (1.0 - 1e-12 if whole else RECALL):
            break
        if whole or batch == MOST_BATCHES - 1:
            counts, comp = exact(bare)
            break
    named = nodes.select("node", "vec_id", "weight").join(comp, "node", "left").select("node", "vec_id", "weight", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    answer = named.join(smallest, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(answer, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_nn_descent(spark, sf_dir):
    """Whole ``embeddings``: links, components and the vector kept of each."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
