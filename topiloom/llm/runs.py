"""Periodic runs of words: Lyndon roots from the grouping phase of a suffix sorter.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times``
periods long, that neither neighbour extends. Every run holds, at each start of its Lyndon
root, a longest Lyndon word of length q under the order of words or under its reverse. So the
steps are:

1. *Grouping.* Suffixes are grouped by their first word, and groups are taken from the
   greatest down. The common prefix of a group, when it is taken, is the longest Lyndon word of
   its places. Each place then leaves the list of remaining places; the place left of it joins
   a new group right above its own, whose prefix is longer by one group prefix for each place it
   precedes. That is phase one of Baier's suffix sorter, and its prefix lengths are the Lyndon
   array; no suffix is ever sorted. It is done under both orders.
2. *Extension.* Each Lyndon word (place, q) is extended to the right and left as far as words
   q apart are equal, by longest common extensions of the two places, all at a time with a
   bisection over hashes of prefixes. Each run found is then compared word by word, and extended
   word by word in the one case where a hash was wrong.

Grouping is done only where a run can be. Words q apart agree over ``length - q`` words, which
is at least ``window = ceil(least * (times - 1) / times)``; so all of a run is covered by windows of that
many words that occur twice in the text. Stretches of covered places are cut out, and a run of
a stretch is a run of the text: a neighbour that extended it would be covered as well.

Words are runs without ASCII white space. Null and empty texts have no words, no runs and an
empty collapsed text. Null ids and repeated rows are rows like others. A task holds a slice of half
a megabyte or its longest text, and a few hundred bytes for each word of a covered stretch.
Other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import NOT_BLANK, Hasher, Slice, column, mix, per_row, slices, tidied, words
from .tables import digest, modest_batches, table

LEAST, TIMES = 24, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(codes: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word at each place of a text over 0 .. kinds - 1."""
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(codes):
        members[c].append(i)
    prefix = [1] * kinds
    above, below = [*range(1, kinds), -1], [*range(-1, kinds - 1)]
    group = list(codes)
    left, right = [*range(-1, n)], [*range(1, n + 2)]
    out = [0] * n
    g = kinds - 1
    while g >= 0:
        length = prefix[g]
        before: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = length
            j, k = left[i], right[i]
            left[k] = j
            right[j] = k
            if j >= 0:
                before[j] = before.get(j, 0) + 1
        # the more places of this group follow a place, the higher its new group
        for times in sorted(set(before.values()), reverse=True):
            fresh: dict[int, int] = {}
            for j, c in before.items():
                if c != times:
                    continue
                old = group[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    prefix.append(prefix[old] + times * length)
                    top = above[old]
                    above.append(top)
                    below.append(old)
                    above[old] = new
                    if top >= 0:
                        below[top] = new
                members[new].append(j)
                group[j] = new
        g = below[g]
    return out


def covered(h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches covered by windows that occur twice in their row."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.zeros(n, np.uint64)
    for i in range(window):
        run = run * _ODD + h[i:n + i]
    inside = np.flatnonzero(rows[:n] == rows[window - 1:])
    key = mix(run[inside] + rows[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    at = inside[twice]
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    on = np.cumsum(step[:-1]) > 0
    begin, end = on.copy(), on.copy()
    split = rows[1:] != rows[:-1]
    begin[1:] &= ~on[:-1] | split
    end[:-1] &= ~on[1:] | split
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def runs_of(codes: list[int], starts: np.ndarray, ends: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of the stretches of a text that 0 separates."""
    text = np.array(codes, np.int64)
    kinds = int(text.max()) + 1
    flipped = np.where(text == 0, 0, kinds - text).tolist()
    place = np.arange(len(text))
    stretch = np.searchsorted(starts, place, "right") - 1
    found = []
    for order in (codes, flipped):
        period = np.array(lyndon_array(order, kinds), np.int64)
        fits = (text > 0) & (place + period < ends[stretch]) & (times * period <= ends[stretch] - starts[stretch])
        at = place[fits]
        at = at[text[at] == text[at + period[at]]]
        found.append(np.stack([at, period[at]]))
    at, period = np.concatenate(found, axis=1)
    if not len(at):
        return []
    up = np.full(len(text) + 1, _ODD, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    value = mix(text.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:-1], dtype=np.uint64)])

    def equal(a, size, apart):
        return (sums[a + size] - sums[a]) * up[apart] == sums[a + apart + size] - sums[a + apart]

    def reach(most, same):
        low, high = np.zeros_like(most), most
        while (low < high).any():
            half = (low + high + 1) // 2
            ok = same(half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low

    first, last = starts[stretch[at]], ends[stretch[at]]
    ahead = reach(last - at - period, lambda size: equal(at, size, period))
    back = reach(at - first, lambda size: equal(at - size, size, period))
    start, end = at - back, at + period + ahead
    long = end - start >= np.maximum(least, times * period)
    at, start, end, period, first, last = (x[long].tolist() for x in (at, start, end, period, first, last))
    out = set()
    for s, e, q in set(zip(start, end, period)):
        if np.array_equal(text[s:e - q], text[s + q:e]):
            out.add((s, e - s, q))
            continue
        for i, lo, hi in {(i, lo, hi) for i, a, z, p, lo, hi in zip(at, start, end, period, first, last) if (a, z, p) == (s, e, q)}:
            a, z = i, i + q
            while z < hi and text[z] == text[z - q]:
                z += 1
            while a > lo and text[a - 1] == text[a - 1 + q]:
                a -= 1
            if z - a >= max(least, times * q):
                out.add((a, z - a, q))
    return sorted(out)


def slice_runs(s: Slice, least: int = LEAST, times: int = TIMES) -> tuple[list[list[bytes]], dict[int, list[tuple[int, int, int]]]]:
    """The words of each text of a slice, and the runs of those texts that have any."""
    starts, ends, rows = words(s.data, s.offsets, NOT_BLANK)
    lists = [s.text(i).split() for i in range(len(s))]
    edge = per_row(rows, len(s))
    low, high = covered(Hasher(s.data)(starts, ends), rows, -(-least * (times - 1) // times))
    long = high - low >= least
    low, high = low[long], high[long]
    if not len(low):
        return lists, {}
    known: dict[bytes, int] = {}
    codes: list[int] = []
    begin, end = [], []
    for a, z in zip(low.tolist(), high.tolist()):
        r = int(rows[a])
        first = int(edge[r])
        begin.append(len(codes))
        codes += [known.setdefault(w, len(known) + 1) for w in lists[r][a - first:z - first]]
        end.append(len(codes))
        codes.append(0)
    out: dict[int, list[tuple[int, int, int]]] = {}
    begin = np.array(begin)
    for at, length, period in runs_of(codes, begin, np.array(end), least, times):
        k = int(np.searchsorted(begin, at, "right")) - 1
        r = int(rows[low[k]])
        out.setdefault(r, []).append((int(low[k] - edge[r]) + at - int(begin[k]), length, period))
    return lists, {r: sorted(set(v), key=lambda x: (x[0], x[2])) for r, v in out.items()}


def collapsed(lists: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside the repetitions of a run, joined by one space."""
    if not runs:
        return b" ".join(lists)
    step = np.zeros(len(lists) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return b" ".join([w for w, x in zip(lists, gone.tolist()) if not x])


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for s in slices(column(batch, "text")):
            lists, runs = slice_runs(s, least, times)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(s.lo, len(s)),
                "n_words": pa.array([len(x) for x in lists], pa.int64()),
                "runs": pa.array([[{"start": a, "length": n, "period": q} for a, n, q in runs.get(i, [])] for i in range(len(s))], _RUN),
                "collapsed": pa.array([collapsed(x, runs.get(i, [])).decode() for i, x in enumerate(lists)], pa.string()),
            })


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; runs by start, then period."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    return modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: tidied(_rows(it, least, times)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """Texts that the task makes periodic: one id in ten, by crc32; a null id never."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def loop(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        turns = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), turns))), F.lit(1), n), " ")

    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.get(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_runs(spark, sf_dir):
    """Whole ``documents``: runs, the strongest of them, and digests of runs and collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start and period, so only a greater exponent replaces one
    best = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = periodic_runs(docs).withColumn("top", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
