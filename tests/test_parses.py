"""Packed parses: heads, lemma lists and counts without a shuffle of tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.operators import corpus, deps
from topiloom.operators import vocab as V

TOKS = ("doc_id bigint, toks array<struct<sent_id:int, tok_id:int, form:string, lemma:string, upos:string, dep:string, "
        "head_id:int, is_stop:boolean, is_alpha:boolean>>")


def parses(spark, odd=True):
    rng = np.random.default_rng(3)

    def toks(n):
        return [(int(rng.integers(0, 3)), int(rng.integers(1, 9)), "f", f"word{rng.integers(0, 5)}", "X", str(rng.choice(["amod", "obj", "root"])),
                 int(rng.integers(0, 10)), bool(rng.integers(0, 5) == 0), bool(rng.integers(0, 6) > 0)) for _ in range(n)]

    rows = [(i, toks(n)) for i, n in enumerate([12, 0, 25, 1, 40, 7])]
    if odd:
        rows += [(2, toks(9)), (None, toks(6)), (None, toks(5)), (9, None), (8, [(None, 1, "a", "nil", "X", "obj", 1, False, True), (0, None, "a", "nul", "X", "obj", 1, False, True),
                 (0, 1, "a", "head", "X", "root", None, False, True)])]
    return spark.createDataFrame(rows, TOKS).repartition(3)


def bag(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_heads_in_the_row_equal_the_join(spark):
    packed = parses(spark)
    cols = ["doc_id", "sent_id", "tok_id", "form", "lemma", "upos", "dep", "head_id", "is_stop", "is_alpha", "head_lemma", "head_stop", "head_alpha"]
    rows = corpus.unpacked(packed)
    assert rows.count() > 90
    assert bag(deps.resolve_heads(packed), *cols) == bag(deps.resolve_heads(rows), *cols)


def test_tokens_of_single_rows_do_not_move(spark):
    plan = deps.resolve_heads(parses(spark, odd=False))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_lemma_lists_of_packed_parses(spark):
    packed = parses(spark)
    # one document's tokens of equal places are in no fixed order, so the lists are compared as sets of words
    lists = [corpus.lemma_lists(p).select("doc_id", F.sort_array("tokens").alias("t")) for p in (packed, corpus.unpacked(packed))]
    assert bag(lists[0], "doc_id", "t") == bag(lists[1], "doc_id", "t")


@pytest.mark.parametrize("bound", [10, None])
def test_ids_before_words_give_the_same_edges(spark, bound):
    rows = deps.resolve_heads(parses(spark))
    vocab = spark.createDataFrame([("word0", 0), ("word2", 1), ("word3", 2), ("head", 3)], "term string, term_id int")
    ids = {r["term"]: r["term_id"] for r in vocab.collect()}
    want = {}
    for r in rows.collect():
        if (not r["is_stop"] and r["is_alpha"] and r["dep"] in ("amod", "obj") and r["head_lemma"] not in (None, r["lemma"])
                and not r["head_stop"] and r["head_alpha"] and r["lemma"] in ids and r["head_lemma"] in ids):
            key = (ids[r["lemma"]], ids[r["head_lemma"]], r["dep"], r["head_lemma"], r["lemma"])
            want[key] = want.get(key, 0) + 1
    got = {tuple(r)[:5]: r["mult"] for r in deps.directed_edges(rows, vocab, bound).collect()}
    assert got == want and len(want) > 3
    triples = deps.triples(rows)
    pairs = {(r["src"], r["dst"]): r["weight"] for r in deps.vocab_pairs(triples, vocab, bound).collect()}
    counted = {}
    for r in triples.collect():
        if r["head"] in ids and r["dependent"] in ids:
            counted[ids[r["head"]], ids[r["dependent"]]] = counted.get((ids[r["head"]], ids[r["dependent"]]), 0) + r["cnt"]
    assert pairs == counted


def test_pseudo_beta_moves_ids_only(spark):
    bow = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "b", 1), (2, 0, "a", 3), (None, 0, "a", 9), (3, 1, "b", 4)], "doc_id bigint, term_id int, term string, cnt bigint")
    theta = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 1, 0.5), (2, 1, 0.5), (None, 0, 1.0)], "doc_id bigint, topic int, weight double")
    out = V.pseudo_beta(bow, theta)
    assert {tuple(r) for r in out.collect()} == {(0, 0, "a", 0.5), (0, 1, "b", 0.25), (1, 0, "a", 4.5), (1, 1, "b", 0.75)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan


def test_pseudo_beta_packs_cells_without_grouping_them(spark):
    """Cells of a document in one stretch, scattered, or in more rows than a batch holds; ids that repeat or are null."""
    rows = [(d, t, f"w{t:03d}", (d * 7 + t) % 5 + 1) for d in range(6) for t in range(300) if (d + t) % 3]
    rows += [(2, 1, "w001", 4), (None, 2, "w002", 9), (None, 2, "w002", 1), (50, 3, "w003", 8), (4, 5, "w005", None)]
    theta = [(d, k, (d + 1) / (k + 2)) for d in range(6) for k in range(3)] + [(1, 0, 0.5), (None, 1, 1.0), (60, 1, 1.0)]
    want = {}
    for d, t, word, n in rows:
        for e, k, w in theta:
            if d is not None and d == e and n is not None:
                want[k, t, word] = want.get((k, t, word), 0.0) + n * w
    shape = "doc_id bigint, term_id int, term string, cnt bigint"
    topics = spark.createDataFrame(theta, "doc_id bigint, topic int, weight double")
    key = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for bow in (spark.createDataFrame(rows, shape).coalesce(1), spark.createDataFrame(rows[::7] + [r for i, r in enumerate(rows) if i % 7], shape).repartition(3, "term_id")):
            out = V.pseudo_beta(bow, topics)
            got = {tuple(r)[:3]: r["weight"] for r in out.collect()}
            assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
            cells = V.packed(bow).collect()
            assert sum(len(r["ids"]) for r in cells) == len(rows) and len(cells) < len(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list") == 1 and "MapInArrow" in plan   # the topics of a document, not its cells
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", key)


def test_steps_by_topic_equal_the_plain_form():
    """Rows without entries included; both losses."""
    from topiloom.operators import nmf, sparse

    rng = np.random.default_rng(5)
    sizes = np.array([4, 0, 7, 1, 0])
    ids, x = rng.integers(0, 6, sizes.sum()), rng.integers(1, 4, sizes.sum()).astype(float)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    w, ht = rng.random((len(sizes), 3)), rng.random((6, 3))
    for kind in ("kl", "frobenius"):
        _, hsum, hht = nmf._known(ht)
        got = nmf._step_w(w, sparse.at_entries(ht, ids), hsum, hht, x, sizes, kind)
        assert np.allclose(got, nmf._update_w(w, ht, hsum, hht, ids, x, rows, kind), rtol=1e-12)
    assert sparse.stretch_sums(x, sizes).tolist() == np.bincount(rows, x, len(sizes)).tolist()


def test_skipgram_parts_follow_the_cores():
    from topiloom.operators import vectors

    assert vectors.training_parts(0, 100, 8) == 1 and vectors.training_parts(250, 100, 8) == 3
    assert vectors.training_parts(10**9, 100_000, 12) == 48


def test_few_rows_make_one_task(spark):
    from topiloom.operators import classify

    rows = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("vec"))
    data = classify.compact(classify._features(rows).repartition(40).persist())
    assert data.rdd.getNumPartitions() == 1 and data.count() == 200
    out = classify.downstream({"one": rows}, k=4, seeds=(0, 1)).collect()
    assert [r["features"] for r in out] == ["one"] and out[0]["f1_macro"] == 1.0 and out[0]["auc"] == 1.0


def test_modes_filter_one_count_of_triples(spark, monkeypatch):
    """Triples of all relations, cut to a config's, are the triples of that config; heads are resolved once."""
    from types import SimpleNamespace

    from topiloom.plans import fit as fits
    from topiloom.plans import grid

    packed = parses(spark)
    vocab = spark.createDataFrame([("word0", 0), ("word2", 1)], "term string, term_id int")
    base = fits.Parsed(None, vocab, 2, 6, None, None, None, None, None)
    every = deps.triples(deps.resolve_heads(packed), {"amod", "obj", "root"})
    for relations in ({"amod"}, {"amod", "obj"}, set()):
        cfg = SimpleNamespace(relations=frozenset(relations), max_features=10)
        got, want = fits.with_triples(base, every, cfg), fits.with_relations(base, packed, cfg)
        assert bag(got.triples, "head", "relation", "dependent", "cnt") == bag(want.triples, "head", "relation", "dependent", "cnt")
        assert bag(got.pairs, "src", "dst", "weight") == bag(want.pairs, "src", "dst", "weight")
    calls, resolve = [], deps.resolve_heads
    monkeypatch.setattr(deps, "resolve_heads", lambda t: calls.append(1) or resolve(t))
    monkeypatch.setattr(fits, "fit_all", lambda models, init: [])
    from topiloom.config import TopicConfig
    grid.graph_modes(packed.select("doc_id"), packed, TopicConfig(min_df=1)).count()
    assert len(calls) == 1


def test_triples_of_a_packed_parse(spark):
    """Filtered and counted in the row; documents of several rows and rows without an id as before."""
    packed = parses(spark)
    assert packed.groupBy("doc_id").count().where("count > 1").count() > 0
    for relations in ({"amod", "obj"}, {"amod", "obj", "root", ""}, set()):
        got, want = deps.triples(packed, relations), deps.triples(deps.resolve_heads(packed), relations)
        assert bag(got, "head", "relation", "dependent", "cnt") == bag(want, "head", "relation", "dependent", "cnt")
    assert deps.triples(packed, {"amod", "obj"}).count() > 3
    plan = deps.triples(packed.dropDuplicates(["doc_id"]), {"amod"})._jdf.queryExecution().optimizedPlan().toString()
    assert "head_stop" not in plan


def test_cells_meet_their_topics_as_rows(spark):
    from topiloom.operators import context, metrics

    rows = spark.createDataFrame([(1, [0, 1], [2.0, 1.0]), (2, [0], [3.0]), (None, [1], [9.0]), (4, [1], [1.0])], "doc_id bigint, ids array<int>, cnts array<double>")
    theta = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 1, 1.0), (None, 0, 1.0)], "doc_id bigint, topic int, weight double")
    phi = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 1.0)], "topic int, term_id int, weight double")
    want = {(1, 0): 0.875, (1, 1): 0.125, (2, 0): 1.0}
    cells = rows.select("doc_id", F.inline(F.arrays_zip("ids", "cnts")).alias("term_id", "cnt"))
    for bound in (10, None):
        plain = context.expected_at(cells, theta, phi, 2, bound)
        assert plain.columns == ["doc_id", "term_id", "p"] and {(r[0], r[1]): r[2] for r in plain.collect()} == want
        out = context.expected_at(rows, theta, phi, 2, bound)
        assert {(r["doc_id"], r["term_id"]): (r["cnt"], r["p"]) for r in out.collect()} == {(1, 0): (2.0, 0.875), (1, 1): (1.0, 0.125), (2, 0): (3.0, 1.0)}
        log = (2 * np.log(0.875) + np.log(0.125)) / 6
        assert metrics.perplexity_at(out).first()[0] == pytest.approx(np.exp(-log))
    assert "collect_list" in context.expected_at(cells, theta, phi, 2, 10)._jdf.queryExecution().optimizedPlan().toString()
