"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds the hashes of its 5-word shingles. The signature has ``SYMBOLS``
minima of the set under as many hash functions, each cut to ``b`` = 16 bits. Two sets of
similarity 0.75 differ in a quarter of the symbols on average, and in more than
``THRESHOLD`` of them with a probability of about one in a million. The signature is split
into 16 chunks of four symbols. Two signatures that differ in at most ``THRESHOLD`` = 31
symbols have, by the pigeonhole principle, a chunk that differs in at most one; so each
chunk is indexed under its four variants that leave one symbol out, and every pair within
the threshold meets under a common key.

Equal sets, by 128 bits of a digest, are one class and go through the join once. A key may be
shared by very many classes, so its pairs are never listed. Each class is compared with the
leaders of the keys it shares most with, in ``ROUNDS`` rounds: the leader of a key is its
smallest class, and later the first or last class of another component found so far. Confirmed
links give components. Keys whose classes are all of one component are done.

In the other keys, classes meet in blocks of ``BLOCK``. A block compares the signatures of
classes of different components, and puts out which classes have a partner within the threshold
and a spanning forest of the near components; never the pairs. Components that are near, directly
or over others, are a family. The classes with a partner are dealt, with their texts, to blocks
of their family. Each two blocks meet in one task, which counts the common shingles of all pairs
by a product of incidence matrices, confirms the pairs within the threshold on full sets, and
puts out a spanning forest of the links. So every pair that meets under a key is either compared
or already in one component, the components are those of all pairs, and no table has a row for
each pair.

Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than five
words is one shingle. Texts without words (or null) have an empty set and are linked with
nothing; so are rows without an id, whose component is null and which are kept. Rows that
repeat an id are one document: they share their component, and all of them are marked kept or
none; ``keep_first`` keeps one of them. Columns of the input that are not needed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import LOWER, NOT_BLANK, Hasher, column, mix, per_row, slices, tidied, words
from .tables import by_group, components, modest_batches, release, settle, small, staged

SHINGLE, SIMILAR = 5, 75
SYMBOLS, CHUNK, THRESHOLD = 64, 4, 31
LEADERS, ROUNDS, ENOUGH = 2, 3, 0.02
BLOCK, BLOCK_SHINGLES = 512, 400_000
_FUNCTIONS = np.random.default_rng(20240601).integers(1, 2**63, (2, SYMBOLS), dtype=np.uint64) | np.uint64(1)
_BLOCK = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, NOT_BLANK)
    h = Hasher(data)(starts, ends)
    n = len(offsets) - 1
    edge = per_row(rows, n)
    run = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i:len(run) + i]
    run = mix(run)
    out = []
    for r in range(n):
        lo, hi = int(edge[r]), int(edge[r + 1])
        if hi - lo >= SHINGLE:
            out.append(np.unique(run[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                x = mix(x * np.uint64(31) + h[i:i + 1])
            out.append(x)
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The 16-bit minima of a non-empty set."""
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), _BLOCK):
        np.minimum(low, ((s[i:i + _BLOCK, None] ^ _FUNCTIONS[0]) * _FUNCTIONS[1]).min(0), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids = column(batch, "doc_id")
        for s in slices(column(batch, "text")):
            sets = shingle_sets(s.data, s.offsets)
            # a class of equal sets goes by a digest of the whole set
            name = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(s.lo, len(s)),
                "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "digest": pa.array(name, pa.binary()),
                "sig": pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                "packed": pa.array([pack(s.text(i)) if len(x) else None for i, x in enumerate(sets)], pa.binary()),
            })


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, packed text) of every row; the digest names the class."""
    return modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: tidied(_signatures(it)), "doc_id long, n_shingles long, digest binary, sig binary, packed binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk under its variants without one symbol."""
    weights = np.random.default_rng(20240701).integers(1, 2**63, (SYMBOLS // CHUNK, CHUNK), dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS // CHUNK, CHUNK)
        if not len(sig):
            continue
        parts = mix((sig.astype(np.uint64) + np.uint64(1)) * weights)
        total = parts.sum(2, keepdims=True, dtype=np.uint64)
        keys = mix(total - parts + np.arange(CHUNK, dtype=np.uint64) + np.uint64(7) * np.arange(SYMBOLS // CHUNK, dtype=np.uint64)[:, None])
        ids = np.repeat(column(batch, "node").to_numpy(zero_copy_only=False), keys[0].size)
        variant = np.tile(np.arange(keys[0].size, dtype=np.int32), len(sig))
        yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(np.int64), "variant": variant, "node": ids})


class _Forest:
    """Unions of components, and whether one joined two of them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = group.column("side").to_numpy()
    a = np.flatnonzero(side == 0)
    alone = group.column("x")[0] == group.column("y")[0]
    return a, a if alone else np.flatnonzero(side == 1), alone


def _within(group: pa.Table, a: np.ndarray, b: np.ndarray, alone: bool, similar: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different components whose sizes allow a link, with where their signatures differ."""
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(node), SYMBOLS // CHUNK, CHUNK)
    for at in np.array_split(a, -(-len(a) // 64)):
        may = comp[at][:, None] != comp[b]
        if alone:
            may &= node[at][:, None] < node[b]
        small, large = np.minimum(n[at][:, None], n[b]), np.maximum(n[at][:, None], n[b])
        i, j = np.nonzero(may & (100 * small >= similar * large))
        differ = sig[at[i]] != sig[b[j]]
        near = differ.sum((1, 2)) <= THRESHOLD
        yield at[i[near]], b[j[near]], differ[near]


def _near(group: pa.Table, similar: int) -> pa.RecordBatch | None:
    """Near components of a key's block, or of two of its blocks, and the classes that make them so.

    A pair within the threshold agrees in three or four symbols of some chunk. It is taken
    only at the first such chunk, and there at the variant that leaves out the symbol in
    which it differs (the first variant if it differs in none), so once in all. A row with
    ``b`` joins two components; a row without it names a class with a partner.
    """
    a, b, alone = _sides(group)
    if not len(a) or not len(b):
        return None
    node, comp = (group.column(c).to_numpy() for c in ("node", "component"))
    chunk, left_out = divmod(int(group.column("variant")[0].as_py()), CHUNK)
    met, forest, edges = np.zeros(len(node), bool), _Forest(), []
    for i, j, differ in _within(group, a, b, alone, similar):
        per_chunk = differ.sum(2)
        first = (per_chunk <= 1).argmax(1)
        here = (first == chunk) & (differ[:, chunk].argmax(1) == left_out) & (per_chunk[:, chunk] <= 1)
        i, j = i[here], j[here]
        met[i] = met[j] = True
        for x, y in np.unique(np.stack([comp[i], comp[j]], axis=1), axis=0).tolist():
            if forest.join(x, y):
                edges.append((x, y))
    if not edges:
        return None
    nodes = node[met].tolist()
    return pa.RecordBatch.from_pydict({
        "a": pa.array([x for x, _ in edges] + nodes, pa.int64()), "b": pa.array([y for _, y in edges] + [None] * len(nodes), pa.int64())})


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    both = np.intersect1d(one, two)
    rows = []
    for sets, flat in ((left, one), (right, two)):
        at = np.searchsorted(both, flat)
        known = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        rows.append((at[known][order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known][order]))
    for lo in range(0, len(both), _BLOCK):
        part = []
        for (at, row), sets in zip(rows, (left, right)):
            i, j = np.searchsorted(at, [lo, lo + _BLOCK])
            m = np.zeros((len(sets), min(_BLOCK, len(both) - lo)), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _links(group: pa.Table, similar: int) -> pa.RecordBatch | None:
    """A spanning forest of the links between the components of a family's block, or of two of them."""
    a, b, alone = _sides(group)
    if not len(a) or not len(b):
        return None
    pairs = [(i, j) for i, j, _ in _within(group, a, b, alone, similar) if len(i)]
    if not pairs:
        return None
    i, j = (np.concatenate(x) for x in zip(*pairs))
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    packed, unpack = group.column("packed"), zstandard.ZstdDecompressor()

    def sets(at: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in at.tolist():
            raw = np.frombuffer(unpack.decompress(packed[k].as_py()), np.uint8)
            out.append(shingle_sets(raw, np.array([0, len(raw)]))[0])
        return out

    u, w = np.unique(i), np.unique(j)
    both = _common(sets(u), sets(w))[np.searchsorted(u, i), np.searchsorted(w, j)]
    good = 100 * both >= similar * (n[i] + n[j] - both)
    if not good.any():
        return None
    ends, where = np.unique(np.stack([comp[i[good]], comp[j[good]]], axis=1), axis=0, return_index=True)
    forest = _Forest()
    kept = [k for (x, y), k in zip(ends.tolist(), where.tolist()) if forest.join(x, y)]
    return pa.RecordBatch.from_pydict({"a": node[i[good][kept]], "b": node[j[good][kept]]})


def _confirm(group: pa.Table, similar: int) -> pa.RecordBatch | None:
    """The pairs of a group whose full sets, cut anew from the texts, are similar enough."""
    unpack = zstandard.ZstdDecompressor()
    sets: dict[int, np.ndarray] = {}
    a, b, packed = group.column("a").to_pylist(), group.column("b").to_pylist(), group.column("packed")
    good = []
    for i, (x, y) in enumerate(zip(a, b)):
        if y is None:
            raw = np.frombuffer(unpack.decompress(packed[i].as_py()), np.uint8)
            sets[x] = shingle_sets(raw, np.array([0, len(raw)]))[0]
        else:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= similar * (len(sets[x]) + len(sets[y]) - both):
                good.append((x, y))
    return pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())}) if good else None


def with_texts(member: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``member`` with the packed text of its class, which one row of the class gives."""
    needed = staged(member.select("node").distinct().join(nodes.select("node", "digest", "doc_id"), "node"), size, "needed")
    texts = rows.select("doc_id", "digest", "packed").join(small(needed, 64), ["digest", "doc_id"]).dropDuplicates(["node"]).select("node", "packed")
    return member.join(texts, "node")


def confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    The partners of an ``a`` are cut into groups of 64; a group gets the texts of its classes
    first and then its pairs.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 64))
    pairs = pairs.join(sizes, "a").select("a", "b", F.xxhash64("a", part).alias("g"))
    member = pairs.select("g", F.col("a").alias("node")).unionByName(pairs.select("g", F.col("b").alias("node"))).distinct()
    texts = with_texts(member, rows, nodes, 2 * pairs.count()).select("g", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    both = texts.unionByName(pairs.select("g", "a", "b", F.lit(None).cast("binary").alias("packed")))
    return by_group(both, ["g"], lambda group: _confirm(group, similar), "a long, b long", ["b"])


def in_blocks(df: DataFrame, of: Column) -> DataFrame:
    """Rows with ``x``, ``y`` and ``side``: dealt to ``of`` blocks, each two of which meet once."""
    dealt = df.withColumn("i", F.pmod(F.xxhash64("node"), of).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), of.cast("int") - 1)))
    return dealt.withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j")).withColumn("side", (F.col("i") > F.col("j")).cast("int")).drop("i", "j")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``similar`` is the least similarity of a link in hundredths, at least 75: the signature
    threshold is made for it.
    """
    if similar < SIMILAR:
        raise ValueError("the signature threshold holds from 75 on")
    rows = settle(signatures(docs), "signatures")
    named = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # an id with several texts is one document
    several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("doc_id", "a")
    also = named.select("doc_id", F.col("digest").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()
    ends = [nodes.select(F.col("digest").alias(c), F.col("node").alias(f"{c}_node")) for c in "ab"]
    links = settle(also.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "links")
    n = nodes.count()

    keys = nodes.select("node", "sig").mapInArrow(lambda it: tidied(_keys(it)), "key long, variant int, node long")
    leaders = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a")
    shared = settle(keys.join(leaders, "key"), "shared")
    tried = comp = None
    for turn in range(ROUNDS):
        met = shared.select("key", "node", "a")
        if turn:
            at = shared.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
            ends = at.groupBy("key").agg(F.min(F.struct("component", "node")).alias("lo"), F.max(F.struct("component", "node")).alias("hi")).where("lo.component <> hi.component")
            met = at.join(ends, "key").select("key", "node", F.when(F.col("component") == F.col("lo.component"), F.col("hi.node")).otherwise(F.col("lo.node")).alias("a"))
        votes = met.where("a <> node").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
        chosen = staged(votes.withColumn("k", best).where(F.col("k") <= LEADERS).select("a", "b"), LEADERS * n, "tried")
        new = staged(confirmed(chosen, rows, nodes, similar), LEADERS * n, "links")
        links = links.unionByName(new)
        tried = chosen if tried is None else tried.unionByName(chosen)
        comp = components(links)
        if new.count() < ENOUGH * chosen.count():
            break

    # what else meets under a key in different components
    at = shared.select("key", "variant", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    part = at.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).alias("of")), "key").join(nodes.select("node", "n_shingles", "sig"), "node")
    near = settle(by_group(in_blocks(part, F.col("of")), ["key", "x", "y"], lambda group: _near(group, similar), "a long, b long"), "near")
    family = components(near.where("b IS NOT NULL"))
    member = near.where("b IS NULL").select(F.col("a").alias("node")).distinct().join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = member.join(family.select(F.col("node").alias("component"), F.col("component").alias("family")), "component").join(nodes.select("node", "n_shingles", "sig"), "node")
    member = staged(member, near.count(), "members")
    sizes = member.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("of"))
    part = in_blocks(with_texts(member, rows, nodes, n).join(sizes, "family"), F.col("of"))
    late = staged(by_group(part, ["family", "x", "y"], lambda group: _links(group, similar), "a long, b long"), near.count(), "links")
    final = comp if late.isEmpty() else components(links.unionByName(late))
    release(shared, near)

    group = staged(nodes.select("node", "digest", "doc_id").join(final, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component")), n, "groups")
    smallest = group.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = group.join(smallest, "component").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(answer, "digest", "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.cast("long").alias("component_id"), F.coalesce(alone == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` without near duplicates: one row of each component stays.

    Of rows that repeat the id that stays, the smallest by text and then the other columns is
    kept. Rows without an id, a text or a word are linked with nothing and stay, a repeated id
    among them once.
    """
    gone = near_duplicates(docs, similar).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    again = settle(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"), "again")
    again = small(again, 16)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = left.join(again, F.col("doc_id") == F.col("_again"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("_row"))
    once = once.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns])
    return left.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(once)


def op6_minhash(spark, sf_dir):
    """Whole ``documents``: sets, components and the document kept of each."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# The links are those of exact Jaccard similarity, so SQL can say them outright.
SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM toks)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) AS f FROM sh GROUP BY s HAVING count(*) > 1),
rare AS (
  SELECT sh.doc_id, sh.s, row_number() OVER (PARTITION BY sh.doc_id ORDER BY coalesce(f, 1), sh.s) AS k FROM sh LEFT JOIN df USING (s)),
prefix AS MATERIALIZED (
  SELECT r.doc_id, r.s FROM rare r JOIN n USING (doc_id) WHERE r.k <= n.n - CAST(ceil(0.75 * n.n) AS BIGINT) + 1),
cand AS MATERIALIZED (
  SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q ON p.s = q.s AND p.doc_id < q.doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT c.a, c.b, count(*) AS x FROM cand c JOIN sh p ON p.doc_id = c.a JOIN sh q ON q.doc_id = c.b AND q.s = p.s GROUP BY c.a, c.b) i
  JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * x >= 75 * (u.n + v.n - x)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT t.b, reach.r FROM reach JOIN both_ways t ON t.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id
"""
