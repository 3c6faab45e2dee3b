"""Benchmark decontamination with a BM25 inverted index and block-max bounds.

The test items are cut into segments of up to ``SEGMENT`` words, and each word of a segment
gets a BM25 impact, with the word's document frequency counted over the whole training
corpus. Impacts are divided by ``SHARE`` of the score the segment gives itself, so that a
score of 1 is the threshold for every segment. Segments with similar words form blocks, and
a block keeps the largest impact of each word.

Every training text is read as overlapping passages of 2 x ``SEGMENT`` words. For a passage
the largest impacts are summed per block; a block whose bound stays below the threshold is
skipped as WAND skips it, and in the rest all segments are scored, so everything above the
threshold is retrieved. A hit is verified on the text around it: enough of the 5-word
shingles of the item's question (its first two thirds) and of its answer (the last third)
must stand there.

The index goes to all tasks; it is split into shards of ``SHARD_WORDS`` words, each matched
in a pass of its own, so its size is bounded whatever the benchmark. Words are runs without
ASCII white space, A-Z lower-cased. Null or empty texts match nothing, items without words
are left out, and rows that repeat are matched each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, NOT_BLANK, Hasher, Slice, column, mix, per_row, slices, tidied, words
from .tables import keep_rest, modest_batches, settle

SEGMENT, BLOCK, SHINGLE = 64, 8, 5
SHARE, QUESTION, ANSWER = 0.5, 0.6, 0.5
K1, B = 1.2, 0.75
SHARD_WORDS = 400_000
#: Cells of the dense block bounds; larger blocks are used when there are more.
BOUND_CELLS = 8_000_000


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[s.data]
    starts, ends, rows = words(data, s.offsets, NOT_BLANK)
    return Hasher(data)(starts, ends), rows


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of ``n`` words in a row; all words together if there are fewer."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


class Lookup:
    """Word hash to term number by direct address; -1 for other words."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        size = 1 << max(16, 3 + int(len(terms)).bit_length())
        self.mask = np.uint64(size - 1)
        self.maybe = np.zeros(size, bool)
        self.maybe[self.terms & self.mask] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a term, and the numbers of those terms."""
        at = np.flatnonzero(self.maybe[h & self.mask])
        if not len(self.terms):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[t] == h[at]
        return at[same], t[same]


class Items:
    """Word hashes of the test items of one shard."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.words = [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = word_hashes(Slice(0, 1, raw, np.array([0, len(raw)])))
            if len(h):
                self.ids.append(item)
                self.words.append(h)
        self.terms = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)


class Index:
    """Block-max index over the segments of the items."""

    def __init__(self, items: Items, df: np.ndarray, n_docs: int):
        self.ids = np.array(items.ids, np.int64)
        self.lookup = Lookup(items.terms)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        segs: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for i, h in enumerate(items.words):
            n = max(1, -(-len(h) // SEGMENT))
            for part in np.array_split(h, n):
                t, tf = np.unique(np.searchsorted(items.terms, part), return_counts=True)
                segs.append((i, t, tf, len(part)))
        mean = np.mean([s[3] for s in segs]) if segs else 1.0
        # similar segments side by side: by their most frequent words in the corpus
        segs.sort(key=lambda s: tuple(s[1][np.argsort(-df[s[1]], kind="stable")][:4].tolist()))
        self.owner = np.array([s[0] for s in segs], np.int64)
        size = max(BLOCK, -(-len(segs) * len(items.terms) // BOUND_CELLS)) if segs else BLOCK
        self.blocks = []
        n_blocks = -(-len(segs) // size)
        self.bounds = np.zeros((len(items.terms), max(n_blocks, 1)), np.float32)
        for b in range(n_blocks):
            part = segs[b * size:(b + 1) * size]
            terms = np.unique(np.concatenate([s[1] for s in part]))
            impact = np.zeros((len(terms), len(part)), np.float32)
            for j, (_, t, tf, n) in enumerate(part):
                x = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
                impact[np.searchsorted(terms, t), j] = x / max(SHARE * x.sum(), 1e-9)
            self.bounds[terms, b] = impact.max(1)
            self.blocks.append((terms, impact, b * size))
        self.parts = []
        for h in items.words:
            cut = max(1, len(h) - len(h) // 3)
            self.parts.append((np.unique(shingles(h[:cut])), np.unique(shingles(h[cut:])), min(SHINGLE, cut), min(SHINGLE, len(h) - cut), len(h)))

    def hits(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, first word, one past the last word) for passages above the threshold."""
        at, t = self.lookup(h)
        if not len(at):
            return []
        # half-passages that no row border cuts; a passage is two of them
        edge = per_row(rows, int(rows[-1]) + 1)
        inside = at - edge[rows[at]]
        half = rows[at] * (1 << 40) + inside // SEGMENT
        first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        key, last = half[first], np.r_[first[1:], len(at)]
        bound = np.add.reduceat(self.bounds[t], first, axis=0)
        joint = bound.copy()
        follows = np.flatnonzero(key[1:] == key[:-1] + 1)
        joint[follows] += bound[follows + 1]
        nxt = np.zeros(len(key), bool)
        nxt[follows] = True
        found = []
        for p, b in zip(*(x.tolist() for x in np.nonzero(joint >= 1 - 1e-4))):
            hi = last[p + 1] if nxt[p] else last[p]
            terms, impact, base = self.blocks[b]
            mine = np.unique(t[first[p]:hi])
            pos = np.minimum(np.searchsorted(terms, mine), len(terms) - 1)
            score = impact[pos[terms[pos] == mine]].sum(0)
            lo, end = int(at[first[p]]), int(at[hi - 1]) + 1
            found += [(base + j, lo, end) for j in np.flatnonzero(score >= 1 - 1e-4).tolist()]
        return found

    def verified(self, h: np.ndarray, rows: np.ndarray, hit: tuple[int, int, int]) -> tuple[int, float] | None:
        """Item and share of its shingles, if both of its parts stand around the hit."""
        i = int(self.owner[hit[0]])
        question, answer, nq, na, length = self.parts[i]
        row = rows[hit[1]]
        lo = max(hit[1] - length, int(np.searchsorted(rows, row)))
        hi = min(hit[2] + length, int(np.searchsorted(rows, row, "right")))
        there = shingles(h[lo:hi], nq)
        q = np.isin(question, there).mean() if len(question) else 1.0
        if q < QUESTION:
            return None
        a = np.isin(answer, there if na == nq else shingles(h[lo:hi], na)).mean() if len(answer) else 1.0
        return (i, float(min(q, a))) if a >= ANSWER else None


def _frequencies(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    lookup, n = Lookup(terms), len(terms)
    count = np.zeros(n, np.int64)
    for batch in batches:
        for s in slices(column(batch, "text")):
            h, rows = word_hashes(s)
            at, t = lookup(h)
            pair = np.unique(rows[at] * n + t)
            count += np.bincount(pair % max(n, 1), minlength=n)
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.flatnonzero(count), pa.int32()), "docs": count[count > 0]})


def _match(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items: list[list[int]] = []
        shares: list[float] = []
        for s in slices(column(batch, "text")):
            h, rows = word_hashes(s)
            got: list[dict[int, float]] = [{} for _ in range(len(s))]
            for hit in index.hits(h, rows):
                if v := index.verified(h, rows, hit):
                    d = got[rows[hit[1]]]
                    d[v[0]] = max(v[1], d.get(v[0], 0.0))
            for d in got:
                items.append(sorted(int(index.ids[i]) for i in d))
                shares.append(max(d.values(), default=0.0))
        rest = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("items", "overlap")}
        if "items" in batch.schema.names:
            before = column(batch, "items").to_pylist()
            items = [sorted({*x, *y}) for x, y in zip(before, items)]
            shares = [max(x, y) for x, y in zip(column(batch, "overlap").to_pylist(), shares)]
        yield pa.RecordBatch.from_pydict(rest | {"items": pa.array(items, pa.list_(pa.int64())), "overlap": pa.array(shares, pa.float64())})


def shards(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in runs of up to ``SHARD_WORDS`` words, one run at a time."""
    run, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        size = (r["text"] or "").count(" ") + 1
        if run and n + size > SHARD_WORDS:
            yield run
            run, n = [], 0
        run.append((r["item_id"], r["text"]))
        n += size
    if run:
        yield run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``items`` (ids of the items it gives away) and ``overlap``."""
    sc = docs.sparkSession.sparkContext
    docs = modest_batches(docs).select(keep_rest(docs, "items", "overlap"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", items array<bigint>, overlap double"
    n_docs, out, n = docs.count(), docs, 0
    for run in shards(benchmark):
        items = Items(run)
        if not items.ids:
            continue
        terms = sc.broadcast(items.terms)
        parts = docs.select("text").mapInArrow(lambda it, t=terms: tidied(_frequencies(it, t.value)), "term int, docs long")
        df = np.zeros(len(items.terms))
        for r in parts.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
            df[r["term"]] = r["docs"]
        index = sc.broadcast(Index(items, df, n_docs))
        out = settle(out, "matched") if n else out
        out = out.mapInArrow(lambda it, x=index: tidied(_match(it, x.value)), schema)
        n += 1
    if not n:
        out = docs.withColumn("items", F.array().cast("array<bigint>")).withColumn("overlap", F.lit(0.0))
    return out


def op3_decontamination(spark, sf_dir):
    """Whole ``documents`` against whole ``benchmark``: the items that each document has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "overlap")
