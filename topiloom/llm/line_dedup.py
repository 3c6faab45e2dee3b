"""Line dedup with two Bloom filters.

Every task marks the lines of its documents in two bit arrays: hashes seen once and hashes
seen twice or more. The arrays are merged segment by segment (a mark in two tasks makes a
repeat), so after one pass the second array holds every line that two documents share, and
a few more by collision. Only lines that it holds are grouped by their exact key, with
partial counts, to confirm how many documents have them and which occurrence comes first.
Confirmed keys of up to ``SEND_BYTES`` go to every task; more of them are joined by line
and folded back per document, with the same result.

Each row is one document, also if rows repeat. Null and empty texts are one empty line,
which no key stands for; null stays null. A
line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased;
keys shorter than ``min_chars`` code points never count. A key counts once a document.
For ``keep="first"`` the occurrence of the smallest id and line stays (null ids come last;
repeated rows of one id keep it together). Columns of the input pass through, except that
``text``, ``n_lines`` and ``n_dropped`` are this operator's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import column, tidied
from .tables import SEND_BYTES, digest, keep_rest, modest_batches, row_key, settle

BLANKS = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 18
#: The filters get this many bits for each document and at most MOST_BITS. Beyond that they
#: are less selective: more lines are confirmed exactly, none is missed.
BITS_A_DOCUMENT = 256
MOST_BITS = 1 << 28
_NO_ID = 2**63 - 1
_FLUSH = 30_000


def keyed_lines(text: bytes, min_chars: int = 1) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys; None where the key is too short to count."""
    lines = text.split(b"\n")
    keys = [k.strip(BLANKS).lower() for k in lines]
    if min_chars <= 1:
        return lines, [k if len(k) >= min_chars else None for k in keys]
    return lines, [k if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in column(batch, "text").cast(pa.binary()):
        yield x.as_py() or b""


def filter_bits(n_docs: int) -> int:
    want = min(MOST_BITS, max(64 * SEGMENT_BITS, n_docs * BITS_A_DOCUMENT))
    return 1 << (want - 1).bit_length()


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; both lie in one segment."""
    segment = (h >> np.uint64(40)) % np.uint64(bits // SEGMENT_BITS) * np.uint64(SEGMENT_BITS)
    size = np.uint64(SEGMENT_BITS)
    return segment + h % size, segment + (h >> np.uint64(20)) % size


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    """Set sorted distinct bit positions of a packed array."""
    byte, mask = at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    bits[byte[first]] |= np.bitwise_or.reduceat(mask, first)


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Filters:
    """Packed bits of lines seen once, and of lines seen again."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Mark lines; each document hands in each of its lines once."""
        if not len(hashes):
            return
        for at in _places(hashes, self.bits):
            at, times = np.unique(at, return_counts=True)
            again = at[(times > 1) | _get(self.once, at)]
            if len(again):
                _set(self.twice, again)
            _set(self.once, at)


def _mark(batches: Iterator[pa.RecordBatch], min_chars: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Both filters of a task, a row for each segment that has marks."""
    f, wait, n = Filters(bits), [], 0
    for batch in batches:
        for text in _texts(batch):
            wait.append(_hashes({k for k in keyed_lines(text, min_chars)[1] if k is not None}))
            n += len(wait[-1])
            if n > _FLUSH:
                f.add(np.concatenate(wait))
                wait, n = [], 0
    if wait:
        f.add(np.concatenate(wait))
    size = SEGMENT_BITS // 8
    for s in range(bits // SEGMENT_BITS):
        a, b = f.once[s * size:(s + 1) * size], f.twice[s * size:(s + 1) * size]
        if a.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(b.tobytes(), 1)]})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of each segment one after another; a mark in two rows is a repeat."""
    have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
            if row["segment"] in have:
                once, twice = have[row["segment"]]
                a, b = once | a, twice | b | (once & a)
            have[row["segment"]] = (a, b)
    for s, (_, b) in have.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "twice": [zlib.compress(b.tobytes(), 1)]})


def repeat_filter(docs: DataFrame, min_chars: int = 1) -> np.ndarray:
    """Packed bits that hold every line key which two or more documents have.

    The array has at most ``MOST_BITS`` bits, so bringing it to the driver is bounded.
    """
    bits = filter_bits(docs.count())
    marks = modest_batches(docs).select("text").mapInArrow(lambda it: tidied(_mark(it, min_chars, bits)), "segment int, once binary, twice binary")
    merged = marks.repartition("segment").mapInArrow(lambda it: tidied(_merge(it)), "segment int, twice binary")
    out, size = np.zeros(bits // 8, np.uint8), SEGMENT_BITS // 8
    for row in merged.collect():
        out[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
    return out


def _suspects(keys: list[bytes | None], twice: np.ndarray) -> dict[bytes, int]:
    """Suspected repeats among the keys of a document, with the first line of each."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys):
        if k is not None and k not in first:
            first[k] = i
    if not first:
        return first
    a, b = _places(_hashes(first), len(twice) * 8)
    hit = _get(twice, a) & _get(twice, b)
    return {k: i for (k, i), h in zip(first.items(), hit.tolist()) if h}


def _count(batches: Iterator[pa.RecordBatch], min_chars: int, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Document counts and first occurrences of suspected lines, summed up within a task."""
    found: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        n, ids, lines = (list(x) for x in zip(*found.values()))
        out = pa.RecordBatch.from_pydict({"key": pa.array(list(found), pa.binary()), "docs": n, "first_id": ids, "first_line": lines})
        found.clear()
        return out

    for batch in batches:
        for text, doc in zip(_texts(batch), column(batch, "doc_id").to_pylist()):
            doc = _NO_ID if doc is None else doc
            for key, line in _suspects(keyed_lines(text, min_chars)[1], twice).items():
                if key in found:
                    entry = found[key]
                    entry[0] += 1
                    if (doc, line) < (entry[1], entry[2]):
                        entry[1:] = doc, line
                else:
                    found[key] = [1, doc, line]
            if len(found) > _FLUSH:
                yield flush()
    if found:
        yield flush()


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, send_bytes: int = SEND_BYTES) -> tuple[DataFrame, bool]:
    """Keys found in at least ``min_docs`` documents, with ``first_id`` and ``first_line``.

    The table is written to the shared folder; the flag says whether its measured size
    allows sending it to every task.
    """
    sc = docs.sparkSession.sparkContext
    twice = sc.broadcast(repeat_filter(docs, min_chars))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: tidied(_count(it, min_chars, twice.value)), "key binary, docs long, first_id long, first_line long")
    common = seen.groupBy("key").agg(F.sum("docs").alias("docs"), F.min(F.struct("first_id", "first_line")).alias("first"))
    common = settle(common.where(F.col("docs") >= min_docs).select("key", "docs", "first.*"), "lines")
    size = common.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    return common, size <= send_bytes


def _rewrite(batches: Iterator[pa.RecordBatch], drop: Callable, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Texts without the lines for which ``drop`` says so, and the counts."""
    for batch in batches:
        texts, total, dropped = [], [], []
        marks = column(batch, "_drop").to_pylist() if "_drop" in batch.schema.names else [None] * batch.num_rows
        for text, doc, mark in zip(_texts(batch), column(batch, "doc_id").to_pylist(), marks):
            lines, keys = keyed_lines(text, min_chars)
            out = drop(doc, keys, mark)
            total.append(len(lines))
            dropped.append(sum(out))
            texts.append(b"\n".join(x for x, d in zip(lines, out) if not d) if dropped[-1] else text)
        none = column(batch, "text").is_null().to_pylist()
        texts = [None if x else t for x, t in zip(none, texts)]
        rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "_drop")}
        yield pa.RecordBatch.from_pydict(rest | {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", send_bytes: int = SEND_BYTES) -> DataFrame:
    """Documents without the lines that ``min_docs`` or more documents share.

    ``keep="none"`` drops every occurrence, ``keep="first"`` all but the first. Adds
    ``n_lines`` (before) and ``n_dropped``.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    docs = docs.select(keep_rest(docs, "n_lines", "n_dropped", "_drop"))
    common, fits = common_lines(docs, min_docs, min_chars, send_bytes)
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", text string, n_lines long, n_dropped long"
    if fits:
        table = {bytes(r["key"]): (r["first_id"], r["first_line"]) for r in common.collect()}
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def drop(doc, keys, _mark):
            known = sent.value
            if keep == "none":
                return [k is not None and k in known for k in keys]
            doc = _NO_ID if doc is None else doc
            return [k is not None and k in known and known[k] != (doc, i) for i, k in enumerate(keys)]

        return docs.mapInArrow(lambda it: tidied(_rewrite(it, drop, min_chars)), schema)

    docs = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    key = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.encode(F.translate(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8"))
    lines = docs.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.posexplode(key).alias("_line", "key"))
    hit = lines.join(common, "key")
    if keep == "first":
        hit = hit.where((F.col("_id") != F.col("first_id")) | (F.col("_line") != F.col("first_line")))
    marks = hit.groupBy("_row").agg(F.collect_set("_line").alias("_drop"))
    marked = docs.join(marks, "_row", "left").drop("_row")

    def drop_marked(_doc, keys, mark):
        mark = set(mark or ())
        return [i in mark for i in range(len(keys))]

    return marked.mapInArrow(lambda it: tidied(_rewrite(it, drop_marked, min_chars)), schema)


def op8_line_dedup(spark, sf_dir):
    """Whole ``documents``; lines that ten or more documents share go everywhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT r, doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY r, doc_id
"""
