"""Dependency pairs and triples from token rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_LEMMA_CHARS
from ..functions.wordlists import GRAPH_RELATIONS, MODE_RELATIONS
from ..session import BROADCAST_ROWS, bounded, by_repeats
from .corpus import kept_tokens, unpacked
from .lookup import flat_lists

ROWS_AT_ONCE = 256       # documents resolved together inside a task
_ASKED = ("sent_id", "tok_id", "head_id", "lemma", "dep", "is_stop", "is_alpha")


def resolve_heads(tokens: DataFrame) -> DataFrame:
    """Token rows with the head's lemma and flags, looked up inside the sentence.

    A packed parse ``(doc_id, toks)`` is resolved row by row. Only documents that stand in several
    rows, and parses of one row for each token, are joined with themselves.
    """
    if "toks" not in tokens.columns:
        return _joined_heads(tokens)
    own, again = by_repeats(tokens)
    if own is None:
        return _joined_heads(unpacked(again))
    names = [f.name for f in tokens.schema["toks"].dataType.elementType]
    fields = unpacked(tokens).select("doc_id", *names, F.col("lemma").alias("head_lemma"), F.col("is_stop").alias("head_stop"),
                                     F.col("is_alpha").alias("head_alpha")).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = own.select("doc_id", "toks").mapInArrow(_row_heads, schema)
    return found if again is None else found.unionByName(_joined_heads(unpacked(again)))


def _row_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            rb = batch.slice(start, ROWS_AT_ONCE)
            toks, row = flat_lists(rb.column(1))
            names = [toks.type.field(i).name for i in range(toks.type.num_fields)]
            cols = dict(zip(names, toks.flatten()))
            own, head = _matches(row, rb.column(0).is_valid().to_numpy(zero_copy_only=False)[row], *(cols[c] for c in ("sent_id", "tok_id", "head_id")))
            same = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(row[own]))] + [cols[c].take(same) for c in names]
                + [cols[c].take(head) for c in ("lemma", "is_stop", "is_alpha")],
                names=["doc_id", *names, "head_lemma", "head_stop", "head_alpha"])


def _matches(row: np.ndarray, known: np.ndarray, sent: pa.Array, tok: pa.Array, head: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of tokens and of their heads in the same row and sentence, null without one.

    A token with several heads of that number stands once for each, as in a join.
    """
    n = len(row)
    s, t, h = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (sent, tok, head))
    known = known & sent.is_valid().to_numpy(zero_copy_only=False)
    is_head = np.flatnonzero(known & tok.is_valid().to_numpy(zero_copy_only=False))
    if not len(is_head):
        return np.arange(n), pa.nulls(n, pa.int64())
    low, high, first = t.min(), t.max(), s.min()
    _, group = np.unique(row * (s.max() - first + 1) + (s - first), return_inverse=True)
    width = high - low + 1
    heads = group[is_head] * width + (t[is_head] - low)
    order = np.argsort(heads, kind="stable")
    heads = heads[order]
    asks = known & head.is_valid().to_numpy(zero_copy_only=False) & (h >= low) & (h <= high)
    wanted = group * width + (h - low)
    at = np.searchsorted(heads, wanted, "left")
    found = np.where(asks, np.searchsorted(heads, wanted, "right") - at, 0)
    times = np.maximum(found, 1)
    own = np.repeat(np.arange(n), times)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
    none = found[own] == 0
    place = np.where(none, 0, at[own] + nth)
    return own, pa.array(is_head[order[np.minimum(place, len(order) - 1)]], mask=none)


def _joined_heads(tokens: DataFrame) -> DataFrame:
    """The join key is the token itself (document, sentence, position), so no key is hot."""
    heads = tokens.select(
        "doc_id", "sent_id", F.col("tok_id").alias("head_id"),
        F.col("lemma").alias("head_lemma"), F.col("is_stop").alias("head_stop"),
        F.col("is_alpha").alias("head_alpha"),
    )
    return tokens.join(heads, ["doc_id", "sent_id", "head_id"], "left")


def _related(resolved: DataFrame, relations: Iterable[str]) -> DataFrame:
    return resolved.where(
        ~F.col("is_stop") & F.col("is_alpha")
        & (F.length("lemma") >= MIN_LEMMA_CHARS)
        & F.col("dep").isin(sorted(relations) or [""])
        & (F.col("dep") != "")
        & (F.col("head_lemma") != F.col("lemma"))
    )


def triples(resolved: DataFrame, relations: Iterable[str] = GRAPH_RELATIONS) -> DataFrame:
    """``(head, relation, dependent, cnt)`` for heads of at least three letters.

    A packed parse ``(doc_id, toks)`` is resolved and filtered row by row, so only the words of
    the wanted relations leave the task; other parses are rows of :func:`resolve_heads`.
    """
    if "toks" not in resolved.columns:
        return _counted(_wide_enough(resolved, relations))
    return _counted(_related_rows(resolved, relations, _wide_enough, False))


def _related_rows(packed: DataFrame, relations: Iterable[str], rule: Callable[[DataFrame, Iterable[str]], DataFrame], strict: bool) -> DataFrame:
    """``(head, relation, dependent)`` of a packed parse by a rule; only documents in several rows are joined."""
    own, again = by_repeats(packed)
    if own is None:
        return rule(_joined_heads(unpacked(again)), relations)
    wanted = sorted(relations)
    kept = own.select("doc_id", *[F.col(f"toks.{c}").alias(c) for c in _ASKED]).mapInArrow(
        lambda it: _row_triples(it, wanted, strict), "head string, relation string, dependent string")
    return kept if again is None else kept.unionByName(rule(_joined_heads(unpacked(again)), relations))


def _wide_enough(resolved: DataFrame, relations: Iterable[str]) -> DataFrame:
    return _related(resolved, relations).where(F.length("head_lemma") >= MIN_LEMMA_CHARS).select(
        F.col("head_lemma").alias("head"), F.col("dep").alias("relation"), F.col("lemma").alias("dependent"))


def _strict(resolved: DataFrame, relations: Iterable[str]) -> DataFrame:
    return _related(resolved, relations).where(~F.col("head_stop") & F.col("head_alpha")).select(
        F.col("head_lemma").alias("head"), F.col("dep").alias("relation"), F.col("lemma").alias("dependent"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("head", "relation", "dependent").agg(F.count(F.lit(1)).alias("cnt"))


def _row_triples(batches: Iterator[pa.RecordBatch], relations: list[str], strict: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_wide_enough`, from one list column for each field of a packed parse.

    ``strict`` gives those of :func:`_strict`.
    """
    wanted = pa.array([r for r in relations if r != ""], pa.string())
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            rb = batch.slice(start, ROWS_AT_ONCE)
            cols = {c: flat_lists(rb.column(c))[0] for c in _ASKED}
            row = flat_lists(rb.column("lemma"))[1]
            long = pc.greater_equal(pc.utf8_length(cols["lemma"]), MIN_LEMMA_CHARS)
            keep = pc.fill_null(pc.and_kleene(pc.and_kleene(pc.invert(cols["is_stop"]), cols["is_alpha"]),
                                              pc.and_kleene(long, pc.is_in(cols["dep"], wanted))), False).to_numpy(zero_copy_only=False)
            known = rb.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]
            own, head = _matches(row, known, *(cols[c] for c in ("sent_id", "tok_id", "head_id")))
            some = np.flatnonzero(keep[own] & head.is_valid().to_numpy(zero_copy_only=False))
            at = head.take(pa.array(some))
            lemma, heads = cols["lemma"].take(pa.array(own[some])), cols["lemma"].take(at)
            wide = (pc.and_kleene(pc.invert(cols["is_stop"].take(at)), cols["is_alpha"].take(at)) if strict
                    else pc.greater_equal(pc.utf8_length(heads), MIN_LEMMA_CHARS))
            on = pc.and_kleene(wide, pc.not_equal(heads, lemma))
            yield pa.RecordBatch.from_arrays([heads.filter(on), cols["dep"].take(pa.array(own[some])).filter(on), lemma.filter(on)],
                                             names=["head", "relation", "dependent"])


def pairs(resolved: DataFrame, relations: Iterable[str] = GRAPH_RELATIONS) -> DataFrame:
    """``(head, dependent, cnt)``."""
    return (
        triples(resolved, relations)
        .groupBy("head", "dependent").agg(F.sum("cnt").alias("cnt"))
    )


def map_vocab(pairs_df: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """``(src, dst, weight)`` for pairs whose two ends are in the vocabulary."""
    ids = vocab.select("term", "term_id")
    left = bounded(ids.select(F.col("term").alias("head"), F.col("term_id").alias("src")), bound)
    right = bounded(ids.select(F.col("term").alias("dependent"), F.col("term_id").alias("dst")), bound)
    return (
        pairs_df.join(left, "head").join(right, "dependent")
        .select("src", "dst", F.col("cnt").cast("double").alias("weight"))
    )


def vocab_pairs(triples_df: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """``(src, dst, weight)`` of the pairs of all relations.

    A bounded vocabulary is looked up first, so that ids are shuffled and not words.
    """
    if bound is None or bound > BROADCAST_ROWS:
        return map_vocab(triples_df.groupBy("head", "dependent").agg(F.sum("cnt").alias("cnt")), vocab, bound)
    return map_vocab(triples_df, vocab, bound).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def directed_edges(resolved: DataFrame, vocab: DataFrame, bound: int | None,
                   mode: str = "filtered") -> DataFrame:
    """``(src, dst, relation, head, dependent, mult)``: dependent to head edges.

    The stricter rule: the head too is alphabetic, no stop word and in the
    vocabulary. Duplicate edges are kept as the multiplicity ``mult``. A packed parse is resolved
    and filtered row by row, as by :func:`triples`.
    """
    ids = vocab.select("term", "term_id")
    src = bounded(ids.select(F.col("term").alias("dependent"), F.col("term_id").alias("src")), bound)
    dst = bounded(ids.select(F.col("term").alias("head"), F.col("term_id").alias("dst")), bound)
    wanted = MODE_RELATIONS[mode]
    kept = _related_rows(resolved, wanted, _strict, True) if "toks" in resolved.columns else _strict(resolved, wanted)
    count = F.count(F.lit(1)).alias("mult")
    if bound is None or bound > BROADCAST_ROWS:
        found = kept.groupBy("dependent", "head", "relation").agg(count).join(src, "dependent").join(dst, "head")
    else:                   # ids are shuffled, and their words are looked up after the count
        found = (kept.join(src, "dependent").join(dst, "head").groupBy("src", "dst", "relation").agg(count)
                 .join(src, "src").join(dst, "dst"))
    return found.select("src", "dst", "relation", "head", "dependent", "mult")


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edge count per relation."""
    return edges.groupBy("relation").agg(F.sum("mult").alias("cnt"))


def doc_word_edges(tokens: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """``(doc_id, term_id)``: one edge per kept token, as a multigraph."""
    ids = bounded(vocab.select(F.col("term").alias("lemma"), "term_id"), bound)
    return kept_tokens(tokens).join(ids, "lemma").select("doc_id", "term_id")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The same edges from word to document."""
    return edges.select("term_id", "doc_id")
