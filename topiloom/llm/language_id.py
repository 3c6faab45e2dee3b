"""Language ID with a linear-chain conditional random field over the words of a text.

Every word is a place in the chain and gets one potential for each language from hashed
features: the word itself (a lexicon learned from the corpus), its first and last one to
three bytes, and its byte trigrams. Potentials between neighbours are learned too, so the
chain can change language inside a code-switched text. Forward-backward gives each word's
language probabilities; a text's language is the one with the largest sum, and its score
that sum's share.

The fit is piecewise. Word potentials are a multinomial regression on all words of about
``FIT_DOCS`` documents of each language (those with the smallest hashes of the id, whole texts).
Words are counted by language in a staged table; a step sends the weights to at most
``FIT_TASKS`` tasks, each adds up the gradient of its words and returns the rows that its words touch,
and the driver adds their sums, so it holds a few tables of 2**``TABLE_BITS`` rows by the number of
languages and never the words.
Every language and every word of the sample takes part. Transitions then come from the expected
counts of forward-backward on the same documents, in two rounds.

Learned are only texts and non-null ``lang`` values of documents of the fit's side. A text
that is null or has no letter is ``und`` with score 0; so is every text if there is nothing
to learn from. Rows that repeat are predicted each for itself; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import ALNUM, LOWER, SLICE_BYTES, Hasher, Slice, column, mix, per_row, slices, tidied, words
from .tables import crc_bucket, keep_rest, modest_batches, settle

FIT_DOCS, FIT_TASKS, SEND_TABLES = 1_500, 16, 128 << 20
WORDS_AT_ONCE = 20_000
TABLE_BITS, STEPS, RATE, DECAY = 18, 40, 0.15, 1e-4
STRIDE = 512
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of all words, and where each word's begin."""
    h, n = Hasher(data), len(starts)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    at, number = [np.arange(n)], [h(starts, ends) & mask]
    size = ends - starts
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        at += [long, long]
        number += [mix(h(starts[long], starts[long] + k) + np.uint64(k)) & mask, mix(h(ends[long] - k, ends[long]) + np.uint64(10 + k)) & mask]
    count = np.maximum(size - 2, 0)
    which = np.repeat(np.arange(n), count)
    first = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at.append(which)
    number.append(mix(h(first, first + 3) + np.uint64(20)) & mask)
    at, number = np.concatenate(at), np.concatenate(number).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return number[order], np.searchsorted(at[order], np.arange(n))


@dataclass
class Model:
    """Languages, word potentials by feature, and log potentials of starts and transitions."""

    langs: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << TABLE_BITS, 1), np.float32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1))
    step: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))

    def potentials(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log potentials of each word, computed once for words that repeat."""
        _, first, back = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        number, edge = word_features(data, starts[first], ends[first])
        x = np.add.reduceat(self.table[number], edge, axis=0)
        x -= x.max(1, keepdims=True)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        return x[back]


def _gradient(batches: Iterator[pa.RecordBatch], w: np.ndarray, total: float) -> Iterator[pa.RecordBatch]:
    """The gradient over the words of a task, as bytes: the features its words have, and their rows."""
    size, n_langs = w.shape
    out, met = np.zeros((n_langs, size)), np.zeros(size, bool)
    for batch in batches:
        for lo in range(0, batch.num_rows, WORDS_AT_ONCE):
            part = batch.slice(lo, WORDS_AT_ONCE)
            words_ = column(part, "word").to_pylist()
            lang = column(part, "lang").to_numpy()
            weight = np.sqrt(column(part, "n").to_numpy()) / total
            ends = np.cumsum([len(x) for x in words_])
            number, edge = word_features(np.frombuffer(b"".join(words_), np.uint8), np.r_[0, ends[:-1]], ends)
            met[number] = True
            owner = np.repeat(np.arange(len(words_)), np.diff(np.r_[edge, len(number)]))
            x = np.add.reduceat(w[number], edge, axis=0).astype(np.float64)
            x = np.exp(x - x.max(1, keepdims=True))
            x /= x.sum(1, keepdims=True)
            x[np.arange(len(words_)), lang] -= 1
            x *= weight[:, None]
            for k in range(n_langs):
                out[k] += np.bincount(number, x[owner, k], size)
    at = np.flatnonzero(met).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"at": pa.array([at.tobytes()], pa.binary()), "g": pa.array([out[:, at].astype(np.float32).tobytes()], pa.binary())})


def fit_table(counted: DataFrame, n_langs: int) -> np.ndarray:
    """Multinomial regression of the language on a word's features (Adam, full batches).

    ``counted`` has rows (word, lang, n), lang a number. A step is one pass over it.
    """
    size = 1 << TABLE_BITS
    w, m, v = (np.zeros((size, n_langs), np.float32) for _ in range(3))
    n_words, total = counted.agg(F.count("*"), F.sum(F.sqrt("n"))).first()
    if not n_words:
        return w
    tasks = max(1, min(FIT_TASKS, SEND_TABLES // w.nbytes, -(-n_words // WORDS_AT_ONCE)))
    parts, sc = counted.select("word", "lang", F.col("n").cast("double").alias("n")).coalesce(tasks), counted.sparkSession.sparkContext
    for t in range(1, STEPS + 1):
        sent = sc.broadcast(w)
        grad = parts.mapInArrow(lambda it, b=sent: tidied(_gradient(it, b.value, total)), "at binary, g binary")
        g = np.zeros((n_langs, size), np.float32)
        for part in grad.toArrow().to_batches():      # at most FIT_TASKS rows, in the order of the tasks
            for at, rows in zip(*part.columns):
                at = np.frombuffer(at.as_buffer(), np.int32)
                g[:, at] += np.frombuffer(rows.as_buffer(), np.float32).reshape(n_langs, len(at))
        sent.destroy()
        d = g.T + DECAY * w / n_words
        m = 0.9 * m + 0.1 * d
        v = 0.99 * v + 0.01 * d * d
        w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
    return w


def forward_backward(potential: np.ndarray, begins: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of all chains of a slice, and the expected transition counts.

    ``begins`` marks the first word of each chain. The first word's transition matrix has
    equal rows, which makes it forget what came before, so all chains are one chain. It is
    cut into ``STRIDE`` long stretches that are worked through side by side: first their
    matrix products, then from stretch to stretch, then inside with the true ends.
    """
    n, k = potential.shape
    emit = np.exp(potential - potential.max(1, keepdims=True))
    move = np.exp(step)[None] * emit[:, None, :]
    move[begins] = (np.exp(start) * emit[begins])[:, None, :]
    move /= move.max((1, 2), keepdims=True)
    rows = -(-n // STRIDE)
    if rows * STRIDE > n:
        move = np.concatenate([move, np.broadcast_to(np.eye(k), (rows * STRIDE - n, k, k))])
    move = move.reshape(rows, STRIDE, k, k)

    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(STRIDE):
        product = product @ move[:, t]
        product /= product.max((1, 2), keepdims=True)
    ahead, behind = np.zeros((rows, k)), np.zeros((rows, k))
    a = np.full(k, 1.0 / k)
    for r in range(rows):
        ahead[r] = a
        a = a @ product[r]
        a /= a.sum()
    b = np.ones(k)
    for r in range(rows - 1, -1, -1):
        behind[r] = b
        b = product[r] @ b
        b /= b.sum()
    alpha, beta = np.empty((rows, STRIDE, k)), np.empty((rows, STRIDE, k))
    for t in range(STRIDE):
        ahead = np.matmul(ahead[:, None], move[:, t])[:, 0]
        ahead /= ahead.sum(1, keepdims=True)
        alpha[:, t] = ahead
    for t in range(STRIDE - 1, -1, -1):
        beta[:, t] = behind
        behind = np.matmul(move[:, t], behind[:, :, None])[:, :, 0]
        behind /= behind.sum(1, keepdims=True)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    inner = np.flatnonzero(~begins)
    pair = alpha[inner - 1][:, :, None] * move.reshape(-1, k, k)[inner] * beta[inner][:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return marginal, pair.sum(0)


def _decoded(s: Slice, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each row, marginals and transition counts of a slice."""
    data = LOWER[s.data]
    starts, ends, rows = words(data, s.offsets, ALNUM)
    edge, k = per_row(rows, len(s)), len(model.langs)
    if not len(starts):
        return edge, np.zeros((0, k)), np.zeros((k, k))
    begins = np.r_[True, rows[1:] != rows[:-1]]
    marginal, pairs = forward_backward(model.potentials(data, starts, ends), begins, model.start, model.step)
    return edge, marginal, pairs


def _slice_bytes(model: Model) -> int:
    return max(1 << 16, SLICE_BYTES * 8 // max(8, len(model.langs) ** 2))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        langs = column(batch, "lang").to_pylist()
        for s in slices(column(batch, "text")):
            data = LOWER[s.data]
            raw = data.tobytes()
            seen.update((langs[s.lo + r], raw[a:b]) for a, b, r in zip(*(x.tolist() for x in words(data, s.offsets, ALNUM))))
    if seen:
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.int32()), "word": pa.array([k[1] for k in seen], pa.binary()), "n": list(seen.values())})


def _transitions(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(model.langs),) * 2)
    for batch in batches:
        for s in slices(column(batch, "text"), _slice_bytes(model)):
            total += _decoded(s, model)[2]
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "n": total.ravel()})


def fit(docs: DataFrame) -> Model:
    """A model from (doc_id, text, lang) rows; rows without a language teach nothing."""
    known = modest_batches(docs).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = settle(known.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    if not langs:
        return Model([])
    numbers = known.sparkSession.createDataFrame(list(enumerate(langs)), "_lang int, lang string")
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    of = F.broadcast(totals.join(numbers, "lang"))      # one row for each language
    sample = settle(known.join(of, "lang").where(share * F.col("_n") < FIT_DOCS).select("lang", F.col("_lang"), "text"), "sample")
    counted = sample.select(F.col("_lang").alias("lang"), "text").mapInArrow(lambda it: tidied(_count_words(it)), "lang int, word binary, n long")
    counted = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    k = len(langs)
    model = Model(langs)
    model.table = fit_table(counted, k)
    model.start = np.log(np.full(k, 1 / k))
    model.step = np.log(np.full((k, k), 0.02 / max(k - 1, 1)) * (1 - np.eye(k)) + 0.98 * np.eye(k))
    sc = docs.sparkSession.sparkContext
    for _ in range(2 if k > 1 else 0):
        sent = sc.broadcast(model)
        rows = sample.select("text").mapInArrow(lambda it, m=sent: tidied(_transitions(it, m.value)), "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
        n = np.ones((k, k))
        for r in rows:
            n[r["i"], r["j"]] += r["n"]
        model = Model(langs, model.table, model.start, np.log(n / n.sum(1, keepdims=True)))
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pred: list[str] = []
        score: list[float] = []
        for s in slices(column(batch, "text"), _slice_bytes(model)) if model.langs else []:
            edge, marginal, _ = _decoded(s, model)
            sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(marginal, axis=0)])
            share = sums[edge[1:]] - sums[edge[:-1]]
            letters = np.r_[0, np.cumsum(_ASCII_LETTER[LOWER[s.data]])]
            plain = letters[s.offsets[1:]] > letters[s.offsets[:-1]]
            for r in range(len(s)):
                total = share[r].sum()
                if total > 0 and (plain[r] or any(c.isalpha() for c in s.text(r).decode("utf-8", "replace"))):
                    i = int(share[r].argmax())
                    pred.append(model.langs[i])
                    score.append(float(min(max(share[r, i] / total, 0.0), 1.0)))
                else:
                    pred.append("und")
                    score.append(0.0)
        if not model.langs:
            pred, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
        rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "lang_pred", "score")}
        yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``lang_pred`` and ``score`` for every row, beside its columns other than ``text``."""
    docs = modest_batches(docs).select(keep_rest(docs, "lang_pred", "score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(lambda it: tidied(_predict(it, sent.value)), schema + (", " if schema else "") + "lang_pred string, score double")


def op9_language_id(spark, sf_dir):
    """Whole ``documents``; the fold with remainder 2 is never learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
