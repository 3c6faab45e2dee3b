"""The whole model fit, from token rows to topics, and what is asked of a fitted model."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TopicConfig
from ..functions.wordlists import STOP_WORDS
from ..operators import blocked, cooc, corpus, deps, graphs, metrics, nmf, reports, vectors
from ..operators import vocab as V
from ..session import DRIVER_CELLS, settle
from ..sources import store


@dataclass
class Parsed:
    """What one parse gives: everything later steps read."""

    doc_ids: DataFrame
    vocab: DataFrame
    n_terms: int
    n_docs: int
    bow: DataFrame
    docs: DataFrame
    lists: DataFrame
    triples: DataFrame
    pairs: DataFrame


@dataclass
class Fitted:
    config: TopicConfig
    parsed: Parsed
    vectors: DataFrame | None
    syntax: DataFrame
    semantic: DataFrame | None
    result: nmf.NMFFit

    @property
    def theta(self) -> DataFrame:
        return self.result.theta_long()

    @property
    def phi(self) -> DataFrame:
        return self.result.phi_long(self.parsed.vocab)

    def top_words(self, top_k: int = 10, hide: Iterable[str] | None = None) -> DataFrame:
        hidden = set(STOP_WORDS["eng"]) if hide is None else set(hide)
        hidden |= set(self.config.topic_stopwords or ())
        return reports.top_words(self.phi, top_k, hidden)

    def mwes(self, top_k: int = 15, hide: Iterable[str] | None = None) -> DataFrame:
        words = self.top_words(10, hide)
        return reports.mwes(words, self.parsed.triples, 10 * self.config.num_topics, top_k)

    def topic_info(self, top_k: int = 10) -> DataFrame:
        return reports.topic_info(V.dominant_topic(self.theta), self.top_words(top_k), self.mwes(3),
                                  self.config.num_topics)

    def evaluate(self, top_k: int = 10, hide: Iterable[str] | None = None) -> dict[str, float | None]:
        words = settle(self.top_words(top_k, hide))
        return summary(words, self.parsed, self.phi, top_k).first().asDict()

    def evaluate_no_syntax(self, top_k: int = 10) -> dict[str, float | None]:
        """The same model without graph penalties, scored the same way."""
        plain = replace(self.config, lambda_syntax=0.0, lambda_embed=0.0)
        return Fitted(plain, self.parsed, self.vectors, self.syntax, self.semantic,
                      factorise(self.parsed, plain, self.syntax, self.semantic)).evaluate(top_k)

    def transform(self, docs: DataFrame, lists: DataFrame) -> DataFrame:
        """``(doc_id, w)`` for new documents over the frozen vocabulary."""
        return self._fold_in(encode_rows(docs, lists, self.parsed.vocab, self.config.max_features))

    def _fold_in(self, rows: DataFrame) -> DataFrame:
        how = {"seed": self.config.seed, "divergence": self.config.divergence}
        if in_memory(self.parsed, self.config):
            return nmf.fold_in(rows, self.result.matrix(), **how)
        return blocked.fold_in(rows, self.result.phi, self.parsed.n_terms, self.config.num_topics, **how)

    def heldout_perplexity(self, docs: DataFrame, lists: DataFrame) -> float:
        rows = settle(encode_rows(docs, lists, self.parsed.vocab, self.config.max_features))
        theta = self._fold_in(rows)
        if in_memory(self.parsed, self.config):
            return nmf.perplexity(rows, theta, self.result.matrix())
        return blocked.perplexity(rows, theta, self.result.phi, self.parsed.n_terms, self.config.num_topics)


def summary(words: DataFrame, parsed: Parsed, phi: DataFrame, top_k: int = 10) -> DataFrame:
    """c_v, npmi, diversity, exclusivity and redundancy as one row with fixed columns."""
    n_words = words.count()
    parts = [
        metrics.c_v_documents(words, parsed.docs, parsed.vocab, top_k, bound=parsed.n_terms),
        metrics.npmi(metrics.scored_pairs(words, parsed.docs, parsed.vocab, top_k, parsed.n_terms),
                     parsed.n_docs),
        metrics.diversity(words),
        metrics.exclusivity(phi, words, n_words),
        metrics.redundancy(words),
    ]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    spark = parts[0].sparkSession
    rows, fields = [], []
    for p in parts:
        r = p.first()
        fields += p.schema.fields
        rows += list(r) if r is not None else [None] * len(p.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spark.createDataFrame([tuple(rows)], schema)


def encode_rows(docs: DataFrame, lists: DataFrame, vocab: DataFrame, bound: int | None) -> DataFrame:
    """Sparse rows of new documents; a document without known words has empty arrays."""
    known = V.doc_rows(V.bow(V.token_counts(lists), vocab, bound))
    return docs.select("doc_id").join(known, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.col("cnts"), F.array().cast("array<double>")).alias("cnts"))


def parse(doc_ids: DataFrame, tokens: DataFrame | None, cfg: TopicConfig,
          lists: DataFrame | None = None) -> Parsed:
    """Vocabulary, counts and dependency tables from token rows, or counts from word lists."""
    if lists is None:
        lists = settle(corpus.term_lists(corpus.lemma_lists(tokens)), "lists")
    counts = V.token_counts(lists)
    vocab = settle(V.build_vocab(counts, cfg.min_df, cfg.max_features))
    n_terms = vocab.count()
    if n_terms == 0:
        raise ValueError("no term reaches min_df; the vocabulary is empty")
    bow = V.bow(counts, vocab, cfg.max_features)
    docs = settle(V.doc_rows(bow))
    spark = doc_ids.sparkSession
    triples = spark.createDataFrame([], "head string, relation string, dependent string, cnt bigint")
    pairs = spark.createDataFrame([], "src int, dst int, weight double")
    parsed = Parsed(doc_ids, vocab, n_terms, doc_ids.count(), bow, docs, lists, triples, pairs)
    return parsed if tokens is None else with_relations(parsed, tokens, cfg)


def parse_settings(cfg: TopicConfig) -> dict:
    """The settings that a parse depends on."""
    return {"min_df": cfg.min_df, "max_features": cfg.max_features, "relations": cfg.relations,
            "apply_chunking": cfg.apply_chunking, "max_chunk_chars": cfg.max_chunk_chars}


def stored_parse(docs: DataFrame, tokens: DataFrame | None, cfg: TopicConfig, path: str,
                 lists: DataFrame | None = None) -> tuple[Parsed, list[str]]:
    """The parse kept at ``path``, or a new one that is kept there, and why it is new.

    A stored parse serves only the same texts ``docs(doc_id, text)`` under the same settings;
    both are part of its signature. Anything else is parsed again and replaces it.
    """
    spark = docs.sparkSession
    sig = store.signature(docs, parse_settings(cfg))
    tables, why = store.load_parse(spark, path, sig)
    if tables is None:
        p = parse(docs.select("doc_id"), tokens, cfg, lists)
        store.save_parse(path, {"doc_ids": p.doc_ids, "vocab": p.vocab, "bow": p.bow, "docs": p.docs, "lists": p.lists,
                                "triples": p.triples, "pairs": p.pairs}, sig)
        tables, _ = store.load_parse(spark, path, sig)
    return Parsed(tables["doc_ids"], tables["vocab"], tables["vocab"].count(), tables["doc_ids"].count(), tables["bow"],
                  tables["docs"], tables["lists"], tables["triples"], tables["pairs"]), why


def with_relations(parsed: Parsed, tokens: DataFrame, cfg: TopicConfig) -> Parsed:
    """The same parse with the dependency tables of other relations."""
    return with_triples(parsed, settle(deps.triples(deps.resolve_heads(tokens), cfg.relations)), cfg)


def with_triples(parsed: Parsed, triples: DataFrame, cfg: TopicConfig) -> Parsed:
    """The same parse with those of the given triples that the config asks for."""
    triples = triples.where(F.col("relation").isin(sorted(cfg.relations) or [""]))
    pairs = deps.vocab_pairs(triples, parsed.vocab, cfg.max_features)
    return replace(parsed, triples=triples, pairs=pairs)


def word_vectors(parsed: Parsed, cfg: TopicConfig) -> DataFrame | None:
    if cfg.vector_backend == "none":
        return None
    if cfg.vector_backend == "ppmi_svd":
        seqs = cooc.id_lists(parsed.lists, parsed.vocab, cfg.max_features)
        cells = vectors.ppmi_cells(cooc.window(seqs, cfg.vector_window), parsed.n_terms)
        found = vectors.svd_vectors(cells, parsed.n_terms, cfg.vector_dim)
    else:
        found = vectors.skipgram_vectors(
            parsed.lists, parsed.triples, parsed.vocab, cfg.vector_dim, cfg.vector_window, cfg.vector_epochs,
            cfg.seed)
        return settle(found)
    return settle(vectors.fill_missing(parsed.vocab, found, cfg.vector_dim))


def in_memory(parsed: Parsed, cfg: TopicConfig) -> bool:
    """Whether the counted terms let topics x terms, and the graphs, be sent to every task."""
    return parsed.n_terms * max(cfg.num_topics, cfg.graph_top_k) <= DRIVER_CELLS


def _job(cfg: TopicConfig, n_terms: int, syntax: DataFrame, semantic: DataFrame | None, init: str, arrays: dict) -> nmf.Job:
    gs = []
    for edges, lam in ((syntax, cfg.lambda_syntax), (semantic, cfg.lambda_embed)):
        if edges is not None and lam > 0:
            if id(edges) not in arrays:
                arrays[id(edges)] = graphs.edge_arrays(edges, n_terms, cfg.graph_top_k)
            gs.append((arrays[id(edges)], lam))
    return nmf.Job(cfg.num_topics, cfg.divergence, gs, cfg.seed, None, cfg.max_iter, cfg.tol, init)


def factorise(parsed: Parsed, cfg: TopicConfig, syntax: DataFrame, semantic: DataFrame | None,
              init: str = "svd") -> nmf.NMFFit:
    if in_memory(parsed, cfg):
        return nmf.fit_many(parsed.docs, parsed.n_terms, [_job(cfg, parsed.n_terms, syntax, semantic, init, {})])[0]
    edges = [(e, lam) for e, lam in ((syntax, cfg.lambda_syntax), (semantic, cfg.lambda_embed)) if e is not None]
    return blocked.fit(parsed.docs, parsed.n_terms, cfg.num_topics, divergence=cfg.divergence, edges=edges,
                       max_iter=cfg.max_iter, tol=cfg.tol, seed=cfg.seed, init=init)


def syntax_graph(parsed: Parsed, cfg: TopicConfig, control: str = "none") -> DataFrame:
    """The syntax graph of a parse, or a control graph with the same degrees or shape."""
    syntax = settle(graphs.syntax_graph(parsed.pairs, cfg.graph_top_k))
    if control == "swap":
        return settle(graphs.rewire(syntax, cfg.seed))
    if control == "permute":
        return settle(graphs.permuted_graph(syntax, parsed.vocab, cfg.seed, parsed.n_terms))
    if control != "none":
        raise ValueError(f"control must be none, swap or permute, got {control!r}")
    return syntax


def fit(doc_ids: DataFrame, tokens: DataFrame | None, cfg: TopicConfig,
        lists: DataFrame | None = None, control: str = "none", init: str = "svd",
        parsed: Parsed | None = None) -> Fitted:
    """Parse, vectors, graphs, factorise. ``control`` swaps in an empty-content syntax graph.

    ``parsed`` is an earlier parse of the same corpus under the same counting settings, as
    :func:`stored_parse` keeps it.
    Segments are cut before parsing (see ``flagship.fit_documents``), so a config that asks
    for them needs the parse of the segments.
    """
    parsed = parse(doc_ids, tokens, cfg, lists) if parsed is None else parsed
    return fit_all([(parsed, cfg, control)], init)[0]


def fit_all(models: Sequence[tuple[Parsed, TopicConfig, str]], init: str = "svd") -> list[Fitted]:
    """Several models of one corpus, ``(parse, config, control)`` each, in shared passes.

    The parses must have the same counts and vocabulary; relations may differ. Graphs and
    vectors that several models ask for alike are made once.
    """
    syntaxes: dict[tuple, DataFrame] = {}
    semantics: dict[tuple, tuple[DataFrame | None, DataFrame | None]] = {}
    prepared, arrays = [], {}
    for parsed, cfg, control in models:
        how = (id(parsed.pairs), cfg.graph_top_k, control, cfg.seed if control != "none" else None)
        if how not in syntaxes:
            syntaxes[how] = syntax_graph(parsed, cfg, control)
        what = (cfg.vector_backend, cfg.vector_dim, cfg.vector_window, cfg.vector_epochs, cfg.seed, cfg.graph_top_k, cfg.lambda_embed > 0)
        if what not in semantics:
            vecs = word_vectors(parsed, cfg) if cfg.lambda_embed > 0 else None
            semantics[what] = vecs, None if vecs is None else settle(graphs.knn_graph(vecs, cfg.graph_top_k))
        prepared.append((parsed, cfg, syntaxes[how], *semantics[what]))
    first = prepared[0][0]
    results: dict[int, nmf.NMFFit] = {}
    together = [i for i, (p, c, *_) in enumerate(prepared) if in_memory(p, c)]
    jobs = [_job(c, first.n_terms, syn, sem, init, arrays) for _, c, syn, _, sem in (prepared[i] for i in together)]
    results |= dict(zip(together, nmf.fit_many(first.docs, first.n_terms, jobs)))
    out = []
    for i, (parsed, cfg, syntax, vecs, semantic) in enumerate(prepared):
        result = results[i] if i in results else factorise(parsed, cfg, syntax, semantic, init)
        out.append(Fitted(cfg, parsed, vecs, syntax, semantic, result))
    return out
