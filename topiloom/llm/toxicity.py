"""Toxicity scores after noisy-channel deobfuscation.

Three passes over the texts, each one Arrow pass without a shuffle of text.

1. A character language model: trigram counts over the bytes of all documents, summed per
   task and then over tasks.
2. A lexicon with precisions, from labelled documents. Features are whole words and word
   beginnings of ``PREFIXES`` bytes. The fit takes at most ``FIT_TOXIC`` toxic and
   ``FIT_CLEAN`` clean documents (the first by a hash of the id, distinct texts, whole
   texts). A feature's evidence is the number of different neighbour words it has in toxic
   documents, so that copies of one document count once. Features with overwhelming
   evidence are taken; further ones are picked one by one, the one that explains most
   toxic documents not yet explained.
3. Scoring. Stretches that look disguised (digits or symbols beside letters, characters
   repeated three times, single characters in a row with up to ``GAP`` separators between them)
   become lattices: each character may stand for itself, for the letters it imitates, or
   for nothing, at a cost, and Viterbi decoding under the language model restores the
   likeliest reading. Where all that is open is one of two equal letters, or the separator
   of two neighbours, trigrams leave a single choice, which is weighed for all such places
   of a slice at once: letters are dropped, and two or three words that read better in one
   become a word (looked up as a whole only). The features of the text, of its restored stretches and
   of its joined words are looked up; a document scores one minus the product of what
   their precisions leave.

Null and empty texts have no features and score the share of toxic documents that no
feature explains. Without labelled rows of both kinds every document scores 0. Several
labels of one document count as toxic if one is. Labels of other documents are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import ALNUM, LOWER, Hasher, column, mix, slices, tidied, words
from .tables import crc_bucket, keep_rest, modest_batches, settle

PREFIXES = (4, 5, 6)
FIT_TOXIC, FIT_CLEAN, CANDIDATES = 6_000, 14_000, 3_000
LEAST_DOCS, LEAST_PRECISION = 3, 0.7
#: Evidence, in nats against chance, with which a feature is taken at once, if its neighbours
#: are as many as this share of its documents and it is this precise.
OVERWHELMING, VARIED, PURE = 25.0, 0.5, 0.98

# What a character may imitate.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
            "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}

#: Costs in nats: an imitation, a character left out between letters (and more for one that
#: imitates letters), a digit or symbol kept as it is, a repeated letter dropped or kept.
IMITATE, SKIP, SKIP_SIGN, KEEP, REPEAT_DROP, REPEAT_KEEP = 1.0, 0.7, 12.0, 6.0, 0.2, 0.7
#: Costs of a sign kept that often ends a word, and of the separators of a split word left
#: out if they hold a blank and if not.
KEEP_END, SPLIT, SPLIT_DOT = 1.0, 3.0, 0.1
#: Most separators between spelled or split words, and most bytes of a part of a split word.
GAP, PART = 3, 16
#: Bytes decoded at a time; longer stretches are decoded in consecutive pieces.
PIECE = 4096
_ENDS_WORD = frozenset(b"!|+(<*#%")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_MARKED = np.zeros(256, bool)
_MARKED[1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in IMITATES]] = True
_AGAIN = re.compile(rb"([\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3})\1+")
_APART = re.compile(b"[^a-z0-9\x80-\xff%s]{2,}" % re.escape("".join(IMITATES)).encode())
#: Byte classes of the language model: 0 for no letter, a-z, the 64 bytes that continue a
#: character beyond ASCII, and eight groups of the bytes that begin one.
CLASSES = 99
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:192] = np.arange(27, 91)
_CLASS[192:256] = 91 + np.arange(64) % 8


# ---- language model -------------------------------------------------------------------

def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for s in slices(column(batch, "text")):
            c = _CLASS[LOWER[s.data]]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int32()), "n": total[at]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a byte class after two others.

    The table has ``CLASSES`` cubed cells whatever the corpus. Trigram estimates fall back
    on bigrams and those on single classes.
    """
    rows = modest_batches(docs).select("text").mapInArrow(lambda it: tidied(_trigrams(it)), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(CLASSES**3)
    n[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = n.sum((0, 1)) + 0.1
    one /= one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


class Decoder:
    """Viterbi decoding of disguised stretches."""

    def __init__(self, lm: np.ndarray):
        # nested lists, since single cells of an array are slow to read
        self.lm, self.kind, self.seen = lm.tolist(), _CLASS.tolist(), {}

    def options(self, raw: bytes, i: int, spelled: bool) -> list[tuple[int, float]]:
        """What the byte at ``i`` may stand for, as (byte or -1 for nothing, cost)."""
        b = raw[i]
        if _LETTER[b]:
            if i and raw[i - 1] == b and b < 128:
                return [(b, REPEAT_KEEP), (-1, REPEAT_DROP)]
            return [(b, 0.0)]
        out = [(ord(c), IMITATE) for c in IMITATES.get(chr(b), "")]
        if 0 < i < len(raw) - 1:
            out.append((-1, SKIP + (SKIP_SIGN if out and not (spelled and not chr(b).isalnum()) else 0.0)))
        ends = i == len(raw) - 1 and b in _ENDS_WORD
        out.append((32, (KEEP_END if ends else KEEP) if out else 0.0))
        return out

    def __call__(self, raw: bytes, spelled: bool = False) -> bytes:
        """The likeliest reading of a stretch; bytes that stay no letters become spaces.

        ``spelled`` says that the stretch is spelled out, so what stands between letters is
        likely to be nothing. Repeated characters beyond ASCII count once.
        """
        raw = _AGAIN.sub(rb"\1", raw)
        if spelled:
            raw = _APART.sub(b" ", raw)
        if len(raw) > PIECE:
            return b"".join(self(raw[i:i + PIECE], spelled) for i in range(0, len(raw), PIECE))
        key = (raw, spelled)
        if key in self.seen:
            return self.seen[key]
        lm, kind = self.lm, self.kind
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, own in enumerate(raw):
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            if _LETTER[own] and not (i and raw[i - 1] == own):
                z = kind[own]
                for (x, y), (cost, path) in paths.items():
                    c = cost + lm[x][y][z]
                    if (y, z) not in nxt or c < nxt[y, z][0]:
                        nxt[y, z] = c, (path, own)
                paths = nxt
                continue
            options = self.options(raw, i, spelled)
            for (x, y), (cost, path) in paths.items():
                for b, extra in options:
                    if b < 0:
                        state, c, p = (x, y), cost + extra, path
                    else:
                        z = kind[b]
                        state, c, p = (y, z), cost + extra + lm[x][y][z], (path, b)
                    if state not in nxt or c < nxt[state][0]:
                        nxt[state] = c, p
            paths = nxt
        _, path = min(((c + lm[x][y][0], p) for (x, y), (c, p) in paths.items()), key=lambda v: v[0])
        out = bytearray()
        while path:
            path, b = path
            out.append(b)
        out.reverse()
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[key] = bytes(out)
        return self.seen[key]


def disguised(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, doubles: bool = False) -> tuple[np.ndarray, ...]:
    """Row, start, end and whether spelled, of stretches that look disguised; ``starts`` to ``rows`` are the words.

    Letters that stand twice count with ``doubles``; otherwise they are left to ``thinned``.
    """
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
    letter, sign = _LETTER[data], _SIGN[data]
    before, after = np.r_[False, letter[:-1]], np.r_[letter[1:], False]
    digit = (data >= 48) & (data <= 57)
    odd = (digit | sign) & (before | after)
    same = np.r_[False, letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)]
    odd |= same if doubles else same & np.r_[False, same[:-1]]
    for width, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[(at >= width) & (at + width <= len(data))]
        odd[at[(data[at[:, None] + np.arange(width)] == data[at[:, None] + np.arange(-width, 0)]).all(1)]] = True
    letters = np.r_[0, np.cumsum(letter)]
    part = letter | sign
    part[np.isin(data, np.frombuffer(b".-_'~^", np.uint8)) & (before | np.r_[False, digit[:-1]]) & (after | np.r_[digit[1:], False])] = True
    s, e, r = words(part.view(np.uint8), offsets, _MARKED)
    k = np.unique(np.searchsorted(s, np.flatnonzero(odd), "right") - 1)
    k = k[k >= 0]
    k = k[letters[e[k]] - letters[s[k]] >= 2]
    # single characters in a row: as many words as lead bytes
    lead = np.r_[0, np.cumsum((data < 128) | (data >= 192))]
    chain = beside(data, starts, ends, rows)
    single = lead[ends] - lead[starts] == 1
    edge = np.diff(np.r_[False, chain & single[1:] & single[:-1], False].astype(np.int8))
    lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    long = (hi - lo >= 2) & (letters[ends[hi]] - letters[starts[lo]] >= 2)
    lo, hi = lo[long], hi[long]
    return (np.r_[r[k], rows[lo]], np.r_[s[k], starts[lo]], np.r_[e[k], ends[hi]], np.r_[np.zeros(len(k), bool), np.ones(len(lo), bool)])


def beside(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words have the next one in the same line, at most ``GAP`` bytes away."""
    line = np.r_[0, np.cumsum((data == 10) | (data == 13))]
    return (rows[1:] == rows[:-1]) & (starts[1:] - ends[:-1] <= GAP) & (line[starts[1:]] == line[ends[:-1]])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, lm: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes, edges and row of two or three words that read better in one.

    Trigrams see two characters on either side of a separator, so of the two readings of a
    separator only three costs differ for each, and the cheaper one is the Viterbi reading.
    """
    none = np.zeros(0, np.int64)
    if len(starts) < 2:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), none
    size = ends - starts
    letters = np.r_[0, np.cumsum(_LETTER[data])]
    plain = (letters[ends] - letters[starts] == size) & (size <= PART)
    j = np.flatnonzero(beside(data, starts, ends, rows) & plain[1:] & plain[:-1])
    c = _CLASS[data]
    x, y = c[ends[j] - 1], c[starts[j + 1]]
    w = np.where(size[j] > 1, c[np.maximum(ends[j] - 2, 0)], 0)
    z = np.where(size[j + 1] > 1, c[np.minimum(starts[j + 1] + 1, len(c) - 1)], 0)
    blank = np.r_[0, np.cumsum((data == 32) | (data == 9))]
    skip = np.where(blank[starts[j + 1]] > blank[ends[j]], SPLIT, SPLIT_DOT)
    j = j[skip + lm[w, x, y] + lm[x, y, z] < lm[w, x, 0] + lm[x, 0, y] + lm[0, y, z]]
    three = j[:-1][np.diff(j) == 1]
    first, last = np.r_[j, three], np.r_[j + 1, three + 2]
    parts = np.c_[first, np.minimum(first + 1, last), last].ravel()
    taken = size[parts] * np.r_[np.tile([1, 1, 0], len(j)), np.ones(3 * len(three), np.int64)]
    return data[inside(starts[parts], taken)], np.r_[0, np.cumsum(taken)[2::3]], rows[first]


def inside(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def thinned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, lm: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes, edges and row of words that read better with one of two equal letters dropped.

    The costs that depend on a pair are those of its own letters and of the one after it,
    whatever becomes of other pairs, so this is the Viterbi reading of the word.
    """
    head, tail = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    head[starts], tail[ends] = True, True
    same = np.zeros(len(data) + 1, bool)
    same[1:-1] = (data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 128) & ~head[1:-1]
    at = np.flatnonzero(same & ~np.r_[False, same[:-1]] & ~np.r_[same[1:], False])
    c = _CLASS[data]
    x = np.where(head[at - 1], 0, c[np.maximum(at - 2, 0)])
    y = np.where(tail[at + 1], 0, c[np.minimum(at + 1, len(c) - 1)]) if len(at) else x
    z = c[at]
    at = at[REPEAT_DROP + lm[x, z, y] < REPEAT_KEEP + lm[x, z, z] + lm[z, z, y]]
    k, n = np.unique(np.searchsorted(starts, at, "right") - 1, return_counts=True)
    kept = np.ones(len(data), bool)
    kept[at] = False
    i = inside(starts[k], ends[k] - starts[k])
    return data[i[kept[i]]], np.r_[0, np.cumsum(ends[k] - starts[k] - n)], rows[k]


# ---- features -------------------------------------------------------------------------

def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, hashes) for whole words and for each length of word beginnings."""
    if not len(starts):
        return
    h = Hasher(data)
    yield np.arange(len(starts)), h(starts, ends)
    for n in prefixes:
        long = np.flatnonzero(ends - starts > n)
        yield long, mix(h(starts[long], starts[long] + n) + np.uint64(n))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each document once, with the words around their first place."""
    for batch in batches:
        toxic = np.array(column(batch, "toxic").to_pylist(), np.int64)
        ids = np.array(column(batch, "doc_id").to_pylist(), np.int64)
        for s in slices(column(batch, "text")):
            data = LOWER[s.data]
            starts, ends, rows = words(data, s.offsets, ALNUM)
            if not len(starts):
                continue
            h = Hasher(data)(starts, ends)
            around = mix(np.r_[np.uint64(1), h[:-1]] * np.uint64(3) + np.r_[h[1:], np.uint64(1)])
            which, feature = (np.concatenate(x) for x in zip(*features(data, starts, ends)))
            row = rows[which]
            order = np.lexsort((which, feature, row))
            which, row, feature = which[order], row[order], feature[order]
            new = np.r_[True, (feature[1:] != feature[:-1]) | (row[1:] != row[:-1])]
            row, feature = row[new] + s.lo, feature[new]
            yield pa.RecordBatch.from_pydict({"doc_id": ids[row], "toxic": toxic[row], "feature": feature.view(np.int64), "around": around[which[new]].view(np.int64)})


@dataclass
class Model:
    """Feature hashes with precisions, the score without features, and the language model."""

    lm: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    precision: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = 0.0

    def score(self, hits: list[int]) -> float:
        left = 1.0 - self.rest
        for i in set(hits):
            left *= 1.0 - float(self.precision[i])
        return min(max(1.0 - left, 0.0), 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Language model over all documents, lexicon from a bounded sample of labelled ones."""
    model = Model(language_model(docs))
    lab = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    lab = lab.where(crc_bucket(F.col("doc_id"), 5) != 0)
    lab = lab.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    totals = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return model
    order = F.xxhash64("doc_id")
    some = lab.where("toxic = 1").orderBy(order).limit(FIT_TOXIC).unionByName(lab.where("toxic = 0").orderBy(order).limit(FIT_CLEAN))
    # at most FIT_TOXIC + FIT_CLEAN rows of two numbers
    sample = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").dropDuplicates(["text"]), "sample")
    rows = settle(sample.mapInArrow(lambda it: tidied(_feature_rows(it)), "doc_id long, toxic long, feature long, around long"), "features")
    counts = rows.groupBy("feature").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("around"))).alias("evidence"))
    counts = counts.where((F.col("evidence") >= LEAST_DOCS) & (F.col("n1") >= LEAST_PRECISION * F.col("n")))
    best = settle(counts.orderBy(F.desc("evidence"), "n", "feature").limit(CANDIDATES), "candidates")
    evidence = {r["feature"]: r["evidence"] for r in best.collect()}
    seen = rows.join(F.broadcast(best.select("feature")), "feature").groupBy("feature", "toxic").agg(F.collect_list("doc_id").alias("docs")).collect()
    pos = {r["feature"]: set(r["docs"]) for r in seen if r["toxic"] == 1}
    neg = {r["feature"]: len(r["docs"]) for r in seen if r["toxic"] == 0}
    sampled = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # toxic and clean documents are thinned out differently, so clean counts are scaled
    scale = (totals[0] / max(sampled.get(0, 1), 1)) / (totals[1] / max(sampled.get(1, 1), 1))
    share = sampled.get(1, 1) / max(sum(sampled.values()), 1)
    left, keys, precision = set().union(*pos.values()) if pos else set(), [], []

    def take(f: int) -> None:
        d = pos.pop(f)
        keys.append(f & (2**64 - 1))
        precision.append((len(d) + 0.5) / (len(d) + neg.get(f, 0) * scale + 1.0))
        left.difference_update(d)

    def precise(f: int, least: float = LEAST_PRECISION) -> bool:
        return len(pos[f]) >= least * (len(pos[f]) + neg.get(f, 0) * scale)

    for f in [f for f, d in pos.items() if evidence[f] * -np.log(share) >= OVERWHELMING and evidence[f] >= VARIED * len(d) and precise(f, PURE)]:
        take(f)
    while True:
        gains = {f: len(d & left) for f, d in pos.items()}
        pos = {f: d for f, d in pos.items() if gains[f] >= LEAST_DOCS and precise(f)}
        if not pos:
            break
        take(max(pos, key=lambda f: (gains[f] - neg.get(f, 0) * scale, -f)))
    known = {f for f in keys}
    explained = set().union(*(r["docs"] for r in seen if r["toxic"] == 1 and r["feature"] & (2**64 - 1) in known))
    missed = (1 - len(explained) / max(sampled.get(1, 0), 1)) * totals[1]
    model.rest = float(min(missed / (missed + totals[0]), 0.49))
    order = np.argsort(np.array(keys, np.uint64))
    model.keys = np.array(keys, np.uint64)[order]
    model.precision = np.array(precision)[order]
    return model


# ---- scoring --------------------------------------------------------------------------

def _known(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, which features) of the words that the lexicon knows."""
    if not len(model.keys):
        return
    for which, h in features(data, starts, ends, prefixes):
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        same = model.keys[at] == h
        yield which[same], at[same]


def restore(text: str, model: Model) -> str:
    """A lower-cased text with its disguised stretches decoded; split words stay apart."""
    raw = np.frombuffer(text.encode(), np.uint8)
    data, offsets = LOWER[raw], np.array([0, len(raw)])
    decoder, out, done = Decoder(model.lm), [], 0
    found = zip(*(x.tolist() for x in disguised(data, offsets, *words(data, offsets, ALNUM), doubles=True)))
    for _, lo, hi, spelled in sorted(found, key=lambda x: (x[1], -x[2], not x[3])):
        if lo >= done:
            out += [data[done:lo].tobytes(), decoder(data[lo:hi].tobytes(), spelled)]
            done = hi
    return b"".join([*out, data[done:].tobytes()]).decode("utf-8", "replace")


class Restored:
    """Features of the restored stretches of a slice; each different stretch is decoded once in a task."""

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.lm)
        self.seen: dict[int, tuple[int, ...]] = {}

    def __call__(self, data: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, spelled: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, feature) of stretches, repeats included."""
        if not len(row) or not len(self.model.keys):
            return
        code, first, which = np.unique(mix(Hasher(data)(lo, hi) + spelled.astype(np.uint64)), return_index=True, return_inverse=True)
        code = code.tolist()
        new = [i for i, c in enumerate(code) if c not in self.seen]
        texts = [self.decoder(data[lo[i]:hi[i]].tobytes(), bool(spelled[i])) for i in first[new].tolist()]
        if len(self.seen) > 200_000:
            self.seen.clear()
            new, texts = range(len(code)), [self.decoder(data[lo[i]:hi[i]].tobytes(), bool(spelled[i])) for i in first.tolist()]
        found: list[set[int]] = [set() for _ in texts]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        a, b, k = words(flat, np.cumsum([0, *map(len, texts)]), ALNUM)
        for at, f in _known(self.model, flat, a, b):
            for j, i in zip(k[at].tolist(), f.tolist()):
                found[j].add(i)
        self.seen.update((code[i], tuple(x)) for i, x in zip(new, found))
        hits = [self.seen[c] for c in code]
        for j in np.flatnonzero(np.array([bool(x) for x in hits])[which]).tolist():
            for i in hits[which[j]]:
                yield int(row[j]), i


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    restored = Restored(model)
    for batch in batches:
        scores: list[float] = []
        for s in slices(column(batch, "text")):
            data = LOWER[s.data]
            starts, ends, rows = words(data, s.offsets, ALNUM)
            hits: dict[int, list[int]] = {}
            for which, f in _known(model, data, starts, ends):
                for r, i in zip(rows[which].tolist(), f.tolist()):
                    hits.setdefault(r, []).append(i)
            for r, i in restored(data, *disguised(data, s.offsets, starts, ends, rows)):
                hits.setdefault(r, []).append(i)
            for reading, prefixes in ((thinned, PREFIXES), (joined, ())):
                flat, edge, own = reading(data, starts, ends, rows, model.lm)
                for which, f in _known(model, flat, edge[:-1], edge[1:], prefixes):
                    for r, i in zip(own[which].tolist(), f.tolist()):
                        hits.setdefault(r, []).append(i)
            scores += [model.score(hits.get(r, [])) for r in range(len(s))]
        rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "score"}
        yield pa.RecordBatch.from_pydict(rest | {"score": pa.array(scores, pa.float64())})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score``; other columns pass through."""
    docs = modest_batches(docs).select(keep_rest(docs, "score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(lambda it: tidied(_score(it, sent.value)), schema)


def op2_toxicity(spark, sf_dir):
    """Whole ``documents``; labels of the fold with remainder 0 are never learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

