"""Co-occurrence counts, PMI families and collocations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import CONNECTOR_WORDS
from ..session import BROADCAST_ROWS, bounded, by_repeats, settle
from .lookup import Words, flat_lists, word_hashes
from .sparse import INTS

_CELLS = 2_000_000     # pair cells built at once for one document
_HELD = 4_000_000      # counted pairs held by a task before they are sent on
_HEADS = 50_000        # terms whose edges are looked up at once
_TILE = 1 << 24        # pair counters a task holds for its block of terms
_TERMS = 1 << 16       # vocabularies up to this size are counted by blocks of terms
_SHARE = 1 << 27       # term ids of the documents that one round of blocks reads
_NEAR = 1 << 32        # pairs of near words that one round of blocks reads
_WORDS = 500_000       # words whose near pairs are built at once
_CODES = 2048          # pairs sent in one row
EDGE_ROWS = 2_000_000  # edges sent to every task at once
SEND_BYTES = 64 << 20  # phrases sent to every task, by measured bytes


def pair_counts(docs: DataFrame, left: Sequence[int] | None = None) -> DataFrame:
    """``(src, dst, cnt)``: documents that hold both terms.

    ``docs`` has one row ``(ids)`` of distinct term ids per document. Pairs are
    counted inside the task and only counted cells are shuffled; a long document is
    worked off in slices, so no document needs its whole pair set in memory.
    Without ``left`` each unordered pair appears once with ``src < dst``; with it
    the pairs are (left term, any other term).
    """
    wanted = None if left is None else np.array(sorted(left), dtype=np.int64)

    def merge(codes, counts, fresh):
        new, n = np.unique(np.concatenate(fresh), return_counts=True)
        if codes.size == 0:
            return new, n
        both, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return both, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)

    def batch(codes, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array((codes >> 32).astype(np.int32)),
             pa.array((codes & 0xFFFFFFFF).astype(np.int32)),
             pa.array(counts.astype(np.int64))], names=["src", "dst", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.empty(0, np.int64)
        counts = np.empty(0, np.int64)
        fresh: list[np.ndarray] = []
        size = 0
        for rb in batches:
            lists = rb.column(0)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype(np.int64)
            for a, b in zip(offsets[:-1], offsets[1:]):
                ids = flat[a:b]
                heads = ids if wanted is None else ids[np.isin(ids, wanted, assume_unique=True)]
                if ids.size < 2 or heads.size == 0:
                    continue
                step = max(1, _CELLS // ids.size)
                for s in range(0, heads.size, step):
                    part = heads[s:s + step, None]
                    keep = part < ids[None, :] if wanted is None else part != ids[None, :]
                    cells = ((part << 32) | ids[None, :])[keep]
                    fresh.append(cells)
                    size += cells.size
                    if size >= _HELD:
                        codes, counts = merge(codes, counts, fresh)
                        fresh, size = [], 0
                        if codes.size >= _HELD:
                            yield batch(codes, counts)
                            codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if fresh:
            codes, counts = merge(codes, counts, fresh)
        if codes.size:
            yield batch(codes, counts)

    return (
        docs.select("ids").mapInArrow(run, "src int, dst int, cnt bigint")
        .groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
    )


def pair_table(docs: DataFrame) -> DataFrame:
    """The table of :func:`pair_counts` for all terms, ``src < dst``, without shuffled cells.

    A task owns a block of terms and holds one counter for each pair that starts in it. A
    document goes to the blocks of its own terms, as its ids from the block on, so what is
    shuffled are ids: the input times half the blocks at most, whose number depends on the
    vocabulary alone. Documents of more than ``_SHARE`` ids are counted in shares, whose
    cells are added up. Vocabularies beyond ``_TERMS`` are counted by :func:`pair_counts`.
    """
    top, held = docs.agg(F.max(F.array_max("ids")), F.sum(F.size("ids"))).first()
    if top is None or top >= _TERMS:
        return pair_counts(docs)
    size = int(top) + 1
    wide = max(1, min(size, _TILE // size))
    blocks, shares = -(-size // wide), max(1, -(-int(held) // _SHARE))
    share = F.pmod(F.xxhash64(*docs.columns), F.lit(shares)).cast("int")
    block = F.explode(F.array_distinct(F.transform("ids", lambda i: F.floor(i / wide).cast("int"))))
    parts = (
        docs.select("ids", share.alias("share"), block.alias("block"))
        .select("share", "block", F.sort_array(F.filter("ids", lambda i: i >= F.col("block") * wide)).alias("ids"))
        .repartitionById(shares * blocks, F.col("share") * blocks + F.col("block"))
        .select("block", F.col("ids").cast("array<int>").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low = None, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            if counts is None:
                low = rb.column(0)[0].as_py() * wide
                counts = np.zeros(min(wide, size - low) * size, np.int64)
            off = rb.column(1).offsets.to_numpy()
            ids = rb.column(1).values.to_numpy()[off[0]:off[-1]].astype(np.int64)
            end = np.repeat(off[1:] - off[0], np.diff(off))       # of the document of each id
            head = np.flatnonzero(ids < low + wide)
            head = head[np.argsort(ids[head], kind="stable")]     # row after row of the counters
            n = end[head] - head - 1
            upto = np.cumsum(n)
            at = 0
            while at < len(head):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _CELLS, "right")))
                some, m = head[at:to], n[at:to]
                place = np.repeat(some + 1 - (np.cumsum(m) - m), m) + np.arange(m.sum())
                np.add.at(counts, np.repeat((ids[some] - low) * size, m) + ids[place], 1)
                at = to
        if counts is not None:
            yield from _cells(counts, low, size)

    out = parts.mapInArrow(run, "src int, dst int, cnt bigint")
    return out if shares == 1 else out.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def _cells(counts: np.ndarray, low: int, size: int) -> Iterator[pa.RecordBatch]:
    """The counters of the terms from ``low`` on, ``size`` for each, that are not zero."""
    step = max(1, _CELLS // size)
    for row in range(0, len(counts) // size, step):
        part = counts[row * size:(row + step) * size]
        on = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array((on // size + low + row).astype(np.int32)), pa.array((on % size).astype(np.int32)), pa.array(part[on])],
            names=["src", "dst", "cnt"])


def edge_counts(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, cnt)``: documents that hold both ends, for the given edges only.

    The edges go to the tasks as sorted neighbour lists, at most ``EDGE_ROWS`` at a time; with
    more of them the documents are read once for each share. A document looks up the neighbours
    of its own terms among its terms, so its work is the degree of its terms and not the square
    of their number, and what is shuffled is one count for each edge and task. Where the degrees
    are so high that this looks up more cells than the documents have, the cells of
    :func:`pair_table` are joined with the edges instead.
    """
    wanted = settle(edges.select("src", "dst").distinct(), "edges")
    if _dense(docs, wanted):
        return _from_table(docs.select(F.array_distinct("ids").alias("ids")), wanted)
    shares = max(1, -(-wanted.count() // EDGE_ROWS))
    spark, out = docs.sparkSession, None
    for share in range(shares):
        own = wanted.where(F.pmod(F.xxhash64("src", "dst"), F.lit(shares)) == share).orderBy("src", "dst").toArrow()
        src, dst = (own.column(c).to_numpy().astype(np.int64) for c in ("src", "dst"))
        part = _count_edges(docs, spark.sparkContext.broadcast((src, dst)))
        out = part if out is None else out.unionByName(part)
    return out


def _dense(docs: DataFrame, wanted: DataFrame) -> bool:
    top, cells = docs.agg(F.max(F.array_max("ids")), F.sum(F.size("ids").cast("double") * F.size("ids") / 2)).first()
    if top is None or top >= _TERMS:
        return False
    degree = wanted.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    met = docs.select(F.explode("ids").alias("src")).groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("df"))
    return (degree.join(met, "src").agg(F.sum(F.col("n") * F.col("df"))).first()[0] or 0) > cells


def _from_table(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    own = sets.select(F.explode("ids").alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.col("src").alias("lo"), F.col("src").alias("hi"), "cnt")
    cells = pair_table(sets).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), "cnt").unionByName(own)
    return wanted.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst")).join(
        cells, ["lo", "hi"]).select("src", "dst", "cnt")


def _count_edges(docs: DataFrame, edges) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = edges.value
        counts = np.zeros(len(src), np.int64)
        for rb in batches:
            lists = rb.column(0)
            off = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()[off[0]:off[-1]].astype(np.int64)
            rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
            for lo in range(0, len(ids), _HEADS):
                head, row = ids[lo:lo + _HEADS], rows[lo:lo + _HEADS]
                first, last = np.searchsorted(src, head, "left"), np.searchsorted(src, head, "right")
                n = last - first
                edge = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                row = np.repeat(row, n)
                # a document's terms are sorted, so the pairs (row, term) are as well
                a, z = np.searchsorted(rows, [row[0], row[-1] + 1]) if len(row) else (0, 0)
                known = (rows[a:z] << 32) | ids[a:z]
                code = (row << 32) | dst[edge]
                at = np.searchsorted(known, code)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == code[hit]
                counts += np.bincount(edge[hit], minlength=len(src))
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(src[on].astype(np.int32)), pa.array(dst[on].astype(np.int32)), pa.array(counts[on])],
                                         names=["src", "dst", "cnt"])

    # ids are sorted once here, whatever made the rows
    return docs.select(F.sort_array(F.array_distinct("ids")).alias("ids")).mapInArrow(run, "src int, dst int, cnt bigint").groupBy(
        "src", "dst").agg(F.sum("cnt").alias("cnt"))


def mirrored(half: DataFrame) -> DataFrame:
    """Both directions of a table that holds each unordered pair once."""
    both = F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    rest = [c for c in half.columns if c not in ("src", "dst")]
    return half.select(both, *rest).select("e.src", "e.dst", *rest)


def documents(docs: DataFrame) -> DataFrame:
    """Symmetric document co-occurrence ``(src, dst, cnt)``, diagonal removed."""
    return mirrored(pair_table(docs))


def id_lists(lists: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """Token lists as vocabulary ids in order; unknown tokens are removed first.

    A bounded vocabulary is looked up inside the row; only documents whose id stands in several
    rows are put together by a shuffle.
    """
    kind = vocab.schema["term_id"].dataType.simpleString()
    if bound is None or bound > BROADCAST_ROWS or kind not in ("int", "bigint"):
        return _joined_ids(lists, vocab, bound)
    own, again = by_repeats(lists)
    if own is None:
        return _joined_ids(again, vocab, bound)
    known = lists.sparkSession.sparkContext.broadcast(Words(vocab))
    item = pa.list_(pa.field("element", pa.int32() if kind == "int" else pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            words, row = flat_lists(rb.column(1))
            ids = known.value.ids(words, flat_lists(rb.column(2))[0].to_numpy())
            sizes = np.bincount(row[ids >= 0], minlength=rb.num_rows)
            some = sizes > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(ids[ids >= 0], item.value_type), type=item)],
                names=["doc_id", "seq"])

    key = lists.schema["doc_id"].dataType.simpleString()
    out = own.select("doc_id", "tokens", word_hashes("tokens").alias("h")).mapInArrow(run, f"doc_id {key}, seq array<{kind}>")
    return out if again is None else out.unionByName(_joined_ids(again, vocab, bound))


def _joined_ids(lists: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    ids = bounded(vocab.select("term", "term_id"), bound)
    return (
        lists.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
        .join(ids, "term")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "term_id"))).alias("s"))
        .select("doc_id", F.col("s.term_id").alias("seq"))
    )


def window(seqs: DataFrame, width: int) -> DataFrame:
    """Symmetric counts of different terms at distance 1..``width``.

    A document is one row, so its neighbours are read from the array: no join and no window
    sort. As in :func:`pair_table` a task owns a block of terms and holds one counter for each
    pair that starts in it; what is shuffled are the pairs of a stretch of words as numbers inside
    their block, with their counts. More than ``_NEAR`` pairs are counted in shares, whose cells
    are added up. The pairs are counted once and written, since their table is read many times.
    """
    kind = seqs.schema["seq"].dataType.elementType.simpleString()
    seqs = settle(seqs.select("seq"), "sequences")
    low, top, held = seqs.agg(F.min(F.array_min("seq")), F.max(F.array_max("seq")), F.sum(F.greatest(F.size("seq"), F.lit(0)))).first()
    if top is None or low < 0 or top >= _TERMS or width < 1:
        return mirrored(_grouped_window(seqs, width))
    size = int(top) + 1
    wide = max(1, min(size, _TILE // size))
    blocks, shares = -(-size // wide), max(1, -(-int(held) * width // _NEAR))

    def pairs(seq: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for apart in range(1, min(width, len(seq) - 1) + 1):
            a, b = seq[:-apart], seq[apart:]
            on = (rows[:-apart] == rows[apart:]) & (a != b) & (a >= 0) & (b >= 0)
            a, b = a[on], b[on]
            first = np.minimum(a, b)
            found.append(((first // wide) << 32) + first % wide * size + np.maximum(a, b))
        return np.unique(np.concatenate(found), return_counts=True)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for rb in batches:
            off = np.concatenate([[0], np.cumsum(np.maximum(pc.fill_null(pc.list_value_length(rb.column(0)), 0).to_numpy(), 0))])
            flat = pc.fill_null(rb.column(0).flatten(), -1).to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(rb.num_rows), np.diff(off))
            at = 0
            while at < rb.num_rows:             # whole documents, so no pair is cut
                to = max(at + 1, int(np.searchsorted(off, off[at] + _WORDS, "right")) - 1)
                keys, n = pairs(flat[off[at]:off[to]], rows[off[at]:off[to]])
                at, piece = to, piece + 1
                if not len(keys):
                    continue
                block = keys >> 32
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                ends = np.r_[first[1:], len(keys)]
                starts = np.concatenate([np.arange(a, z, _CODES) for a, z in zip(first, ends)])
                cuts = pa.array(np.r_[starts, len(keys)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((piece % shares * blocks + block[starts]).astype(np.int32)),
                     pa.ListArray.from_arrays(cuts, pa.array((keys & 0xFFFFFFFF).astype(np.int32)), type=INTS),
                     pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)), type=INTS)], names=["part", "codes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low = None, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            if counts is None:
                low = rb.column(0)[0].as_py() % blocks * wide
                counts = np.zeros(min(wide, size - low) * size, np.int64)
            off = rb.column(1).offsets.to_numpy()
            codes, n = rb.column(1).values.to_numpy(), rb.column(2).values.to_numpy()
            shift = rb.column(2).offsets.to_numpy()[0] - off[0]
            for a, z in zip(off[:-1], off[1:]):          # a row holds each code once
                counts[codes[a:z]] += n[a + shift:z + shift]
        if counts is not None:
            yield from _cells(counts, low, size)

    parts = seqs.mapInArrow(emit, "part int, codes array<int>, n array<int>").repartitionById(shares * blocks, F.col("part"))
    half = parts.mapInArrow(run, "src int, dst int, cnt bigint")
    if shares > 1:
        half = half.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
    return mirrored(settle(half.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "cnt"), "window"))


def _grouped_window(seqs: DataFrame, width: int) -> DataFrame:
    """One row for each near pair, grouped by a shuffle: any ids, ``src < dst``."""
    near = (
        seqs.select("seq", F.posexplode("seq").alias("p", "a"))
        .select("a", F.explode(F.slice(F.col("seq"), F.col("p") + 2, F.lit(width))).alias("b"))
        .where(F.col("a") != F.col("b"))
    )
    return near.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(
        F.count(F.lit(1)).alias("cnt"))


def window_cells(seqs: DataFrame, width: int, wanted: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The rows of a few terms in the table of :func:`window`, and all its row sums.

    One pass compares the sequence with itself at each distance. It counts the cells of
    ``wanted`` terms only; of the others it keeps one sum a term, so no table of all pairs is
    made. Returns ``(src, dst, cnt)`` and ``(term_id, c)``.
    """
    few = np.array(sorted(wanted), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def added(held, codes, n):
            keys, at = np.unique(np.concatenate([held[0], codes]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([held[1], n])).astype(np.int64)

        for rb in batches:
            lists = rb.column(0)
            off = lists.offsets.to_numpy()
            seq = lists.values.to_numpy()[off[0]:off[-1]].astype(np.int64)
            rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
            around = np.zeros(len(seq), np.int64)
            codes = []
            for apart in range(1, min(width, len(seq) - 1) + 1):
                a, b = seq[:-apart], seq[apart:]
                on = (rows[:-apart] == rows[apart:]) & (a != b)
                around[:-apart] += on
                around[apart:] += on
                for x, y in ((a, b), (b, a)):
                    mine = on & np.isin(x, few)
                    codes.append((x[mine] << 32) | y[mine])
            ids, at = np.unique(seq, return_inverse=True)
            sums = added(sums, ids, np.bincount(at, around).astype(np.int64))
            codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            cells = added(cells, *np.unique(codes, return_counts=True))
            if len(cells[0]) > _HELD:
                yield batch(cells[0] >> 32, cells[0] & 0xFFFFFFFF, cells[1])
                cells = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield batch(cells[0] >> 32, cells[0] & 0xFFFFFFFF, cells[1])
        yield batch(sums[0], np.full(len(sums[0]), -1), sums[1])

    def batch(src, dst, n):
        return pa.RecordBatch.from_arrays([pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32)), pa.array(n)], names=["src", "dst", "cnt"])

    found = settle(seqs.select("seq").mapInArrow(run, "src int, dst int, cnt bigint").groupBy("src", "dst").agg(F.sum("cnt").alias("cnt")), "window")
    return found.where("dst >= 0"), found.where("dst < 0").select(F.col("src").alias("term_id"), F.col("cnt").cast("double").alias("c"))


def marginals(docs: DataFrame) -> DataFrame:
    """``(term_id, c)``: row sums of document co-occurrence without building the pairs.

    A document of n terms adds n - 1 to each of its terms.
    """
    return (
        docs.select(F.explode("ids").alias("term_id"), (F.size("ids") - 1).alias("n"))
        .groupBy("term_id").agg(F.sum("n").alias("c"))
    )


def npmi_expr(c_ij: Column, c_i: Column, c_j: Column, total: Column) -> Column:
    """NPMI of one cell; 0 where it is not finite."""
    den = -F.log(F.greatest(c_ij / total, F.lit(1e-12)))
    num = F.log(c_ij * total / F.greatest(c_i * c_j, F.lit(1e-12)))
    return F.when((den == 0) | (c_ij <= 0), F.lit(0.0)).otherwise(num / den)


def npmi_cells(cooc: DataFrame, bound: int | None) -> DataFrame:
    """``(src, dst, npmi)`` for the cells of a symmetric co-occurrence table, which is read more than once."""
    rows = cooc.groupBy("src").agg(F.sum("cnt").cast("double").alias("c"))
    total = rows.agg(F.sum("c")).first()[0]
    left = bounded(rows.select("src", F.col("c").alias("ci")), bound)
    right = bounded(rows.select(F.col("src").alias("dst"), F.col("c").alias("cj")), bound)
    return cooc.join(left, "src").join(right, "dst").select(
        "src", "dst",
        npmi_expr(F.col("cnt").cast("double"), F.col("ci"), F.col("cj"),
                  F.lit(float(total or 0.0))).alias("npmi"))


def ppmi_documents(docs: DataFrame, df_table: DataFrame, n_docs: int, bound: int | None) -> DataFrame:
    """``(src, dst, ppmi)`` at document level; absent pairs are 0 and left out."""
    d = df_table.select("term_id", (F.col("df") / F.lit(float(n_docs))).alias("p"))
    left = bounded(d.select(F.col("term_id").alias("src"), F.col("p").alias("pi")), bound)
    right = bounded(d.select(F.col("term_id").alias("dst"), F.col("p").alias("pj")), bound)
    value = F.log(F.col("cnt") / F.lit(float(n_docs)) / (F.col("pi") * F.col("pj") + 1e-10) + 1e-10)
    return (
        pair_table(docs).join(left, "src").join(right, "dst")
        .select("src", "dst", F.greatest(value, F.lit(0.0)).alias("ppmi"))
        .where(F.col("ppmi") > 0)
    )


def bigrams(lists: DataFrame) -> DataFrame:
    """``(w1, w2, cnt)`` of adjacent tokens, read from each document's array."""
    t = F.col("tokens")
    adjacent = F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
        F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return (
        lists.where(F.size("tokens") >= 2)
        .select(F.explode(adjacent).alias("b"))
        .groupBy("b.w1", "b.w2").agg(F.count(F.lit(1)).alias("cnt"))
    )


def unigrams(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("tokens").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("cnt"))


def word_and_pair_counts(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(w, cnt)`` and ``(w1, w2, cnt)`` of adjacent tokens, from one pass over the texts."""
    t = F.col("tokens")
    pairs = F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    words = F.transform(t, lambda w: F.struct(w.alias("w1"), F.lit(None).cast("string").alias("w2")))
    both = settle(lists.where(F.size("tokens") > 0).select(F.explode(F.concat(words, pairs)).alias("b"))
                  .groupBy("b.w1", "b.w2").agg(F.count(F.lit(1)).alias("cnt")), "counts")
    return both.where("w2 IS NULL").select(F.col("w1").alias("w"), "cnt"), both.where("w2 IS NOT NULL")


def pmi_bigrams(lists: DataFrame, n: int = 200, min_count: int = 10) -> DataFrame:
    """``(w1, w2, cnt, pmi)``: the ``n`` best bigrams by PMI among those seen often."""
    uni, bi = word_and_pair_counts(lists)
    n_bi = bi.agg(F.sum("cnt")).first()[0] or 0
    n_uni = uni.agg(F.sum("cnt")).first()[0] or 0
    frequent = bi.where(F.col("cnt") >= min_count)
    left = uni.select(F.col("w").alias("w1"), F.col("cnt").alias("n1"))
    right = uni.select(F.col("w").alias("w2"), F.col("cnt").alias("n2"))
    value = F.log(
        (F.col("cnt") / F.lit(float(n_bi)))
        / ((F.col("n1") / F.lit(float(n_uni))) * (F.col("n2") / F.lit(float(n_uni)))))
    return (
        frequent.join(left, "w1").join(right, "w2")
        .select("w1", "w2", "cnt", value.alias("pmi"))
        .orderBy(F.desc("pmi"), "w1", "w2").limit(n)
    )


def phrase_scores(lists: DataFrame, min_count: int = 5, threshold: float = 10.0,
                  connectors: Iterable[str] = CONNECTOR_WORDS) -> DataFrame:
    """``(w1, w2, cnt, score)`` of collocations above the threshold.

    Score is ``(n_ab - min_count) * V / (n_a * n_b)`` with V the number of distinct
    words; a phrase neither starts nor ends with a connector word.
    """
    stop = sorted(connectors)
    uni, bi = word_and_pair_counts(lists)
    v = uni.count()
    pairs = bi.where(
        (F.col("cnt") >= min_count) & ~F.col("w1").isin(stop) & ~F.col("w2").isin(stop))
    left = uni.select(F.col("w").alias("w1"), F.col("cnt").alias("n1"))
    right = uni.select(F.col("w").alias("w2"), F.col("cnt").alias("n2"))
    score = (F.col("cnt") - min_count) * F.lit(float(v)) / (F.col("n1") * F.col("n2"))
    return (
        pairs.join(left, "w1").join(right, "w2")
        .select("w1", "w2", "cnt", score.alias("score"))
        .where(F.col("score") > threshold)
    )


def join_phrases(lists: DataFrame, phrases: DataFrame) -> DataFrame:
    """Token lists with each detected pair joined by ``_``, left to right.

    In a run of adjacent marked pairs the greedy reading joins every second one, counted from
    the run's start. The pairs are marked inside the row: Spark hashes each two neighbours, the
    tasks look the hashes up in the sorted hashes of the phrases and confirm the words, so no
    row of tokens moves. Phrases of more than ``SEND_BYTES``, which are measured first, are
    marked by a join instead.
    """
    found = settle(phrases.select("w1", "w2").distinct(), "phrases")
    size = found.agg(F.sum(F.octet_length("w1") + F.octet_length("w2") + 24)).first()[0] or 0
    if size > SEND_BYTES:
        return _join_phrases_wide(lists, found)
    table = found.select(F.xxhash64("w1", "w2").alias("h"), "w1", "w2").orderBy("h", "w1", "w2").toArrow().combine_chunks()
    known = lists.sparkSession.sparkContext.broadcast(table)
    t = F.col("tokens")
    hashes = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                        lambda a, b: F.xxhash64(a, b))
    return lists.where(F.size("tokens") > 0).select("doc_id", "tokens", hashes.alias("h")).mapInArrow(
        lambda batches: _marked(batches, known.value), "doc_id bigint, tokens array<string>")


def _marked(batches: Iterator[pa.RecordBatch], phrases: pa.Table) -> Iterator[pa.RecordBatch]:
    hashes = phrases.column("h").to_numpy()
    firsts, seconds = (phrases.column(c).combine_chunks() for c in ("w1", "w2"))
    alike = int(np.unique(hashes, return_counts=True)[1].max()) if len(hashes) else 0
    for rb in batches:
        lists = rb.column(1)
        off = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(off[0], off[-1] - off[0])
        off = off - off[0]
        last = np.zeros(len(words), bool)
        last[off[1:] - 1] = True                  # every list here has a token
        lefts = np.flatnonzero(~last)
        pairs = rb.column(2).flatten().to_numpy()
        hit = np.zeros(len(words), bool)
        at = np.searchsorted(hashes, pairs)
        for _ in range(alike):                    # phrases may share a hash
            here = np.flatnonzero(at < len(hashes))
            here = here[hashes[at[here]] == pairs[here]]
            if not len(here):
                break
            left = lefts[here]
            same = pc.and_(pc.equal(words.take(pa.array(left)), firsts.take(pa.array(at[here]))),
                           pc.equal(words.take(pa.array(left + 1)), seconds.take(pa.array(at[here]))))
            hit[left[same.to_numpy(zero_copy_only=False)]] = True
            at = at + 1
        place = np.arange(len(words))
        before = np.where(hit, -1, place)
        before[off[:-1]] = np.maximum(before[off[:-1]], off[:-1] - 1)   # a list starts after no pair
        starts = hit & ((place - np.maximum.accumulate(before)) % 2 == 1)
        eaten = np.zeros(len(words), bool)
        eaten[1:] = starts[:-1]
        joined = pc.binary_join_element_wise(words.filter(pa.array(starts)), words.filter(pa.array(eaten)), "_")
        kept = pc.replace_with_mask(words, pa.array(starts), joined).filter(pa.array(~eaten))
        sizes = np.add.reduceat((~eaten).astype(np.int64), off[:-1]) if len(words) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(offsets, kept, type=pa.list_(pa.field("element", pa.string())))],
                                         names=["doc_id", "tokens"])


def _join_phrases_wide(lists: DataFrame, phrases: DataFrame) -> DataFrame:
    """The same with an equi-join on the two words, for more phrases than tasks can hold."""
    marked = (
        lists.select("doc_id", F.posexplode("tokens").alias("pos", "w1"),
                     F.col("tokens").alias("t"))
        .withColumn("w2", F.get(F.col("t"), F.col("pos") + 1))
        .drop("t")
        .join(phrases.select("w1", "w2", F.lit(True).alias("hit")), ["w1", "w2"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.coalesce(F.max(F.when(~F.col("hit"), F.col("pos"))).over(order), F.lit(-1))
    started = marked.withColumn("starts", F.col("hit") & ((F.col("pos") - before) % 2 == 1))
    kept = started.withColumn("eaten", F.coalesce(F.lag("starts").over(order), F.lit(False))).where("NOT eaten")
    term = F.when(F.col("starts"), F.concat_ws("_", "w1", "w2")).otherwise(F.col("w1"))
    return (
        kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", term.alias("w")))).alias("s"))
        .select("doc_id", F.col("s.w").alias("tokens"))
    )


def window_counts(lists: DataFrame, terms: Sequence[str], width: int) -> tuple[np.ndarray, int]:
    """Boolean sliding-window document frequencies of a small term set.

    Returns the T x T matrix of windows holding both terms (the diagonal is each
    term's own frequency) and the number of windows. A text shorter than the window
    is one window. Each task sums one small matrix.
    """
    listed = sorted(set(terms))
    size = len(listed)
    spark = lists.sparkSession
    table = spark.createDataFrame([(t, i) for i, t in enumerate(listed)], "term string, term_id int")
    known = spark.sparkContext.broadcast(Words(table))
    place_of = {t: i for i, t in enumerate(listed)}
    order = np.array([place_of[t] for t in terms], dtype=int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((size, size))
        windows = 0
        for rb in batches:
            words, doc = flat_lists(rb.column(0))
            ids = known.value.ids(words, flat_lists(rb.column(1))[0].to_numpy())
            sizes = np.bincount(doc, minlength=rb.num_rows)
            counts = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
            windows += int(counts.sum())
            at = np.flatnonzero(ids >= 0)
            place = at - (np.cumsum(sizes) - sizes)[doc[at]]
            edges = np.searchsorted(doc[at], np.arange(rb.num_rows + 1))
            for r in np.flatnonzero(np.diff(edges)):
                lo, hi = edges[r], edges[r + 1]
                count = int(counts[r])
                rows, row = np.unique(ids[at[lo:hi]], return_inverse=True)
                pos = place[lo:hi]
                delta = np.zeros((rows.size, count + 1), dtype=np.int32)
                np.add.at(delta, (row, np.minimum(np.maximum(pos - width + 1, 0), count)), 1)
                np.add.at(delta, (row, np.minimum(pos, count - 1) + 1), -1)
                seen = (np.cumsum(delta[:, :-1], axis=1) > 0).astype(np.float64)
                acc[np.ix_(rows, rows)] += seen @ seen.T
        i, j = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1).astype(np.int32)),
             pa.array(np.append(j, -1).astype(np.int32)),
             pa.array(np.append(acc[i, j], float(windows)))], names=["i", "j", "n"])

    cells = (
        lists.where(F.size("tokens") > 0).select("tokens", word_hashes("tokens")).mapInArrow(run, "i int, j int, n double")
        .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    )
    out = np.zeros((size, size))
    windows = 0
    for r in cells:
        if r["i"] < 0:
            windows = int(r["n"])
        else:
            out[r["i"], r["j"]] = r["n"]
    return out[np.ix_(order, order)], windows
