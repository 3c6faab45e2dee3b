"""Registry of queries, the tables they share and the SQL text of those tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..functions.seeded import POISSON1_CDF
from ..functions.wordlists import STOP_WORDS
from ..operators import corpus, deps, graphs, reports, temporal, vectors
from ..operators import vocab as V
from ..session import settle, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ENG = STOP_WORDS["eng"]
MIN_DF = 5
MAX_FEATURES = 15_000
TOPICS = 4
LANGS = ("en", "fr", "de", "es")
DIM = 64


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, ST.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register ``fn(data)`` under an inventory id, with its SQL twin."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(shared(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


_SHARED: dict[tuple[str, str], Data] = {}


def shared(spark: SparkSession, sf_dir: str) -> Data:
    """One parse per session and folder, reused by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = Data(spark, sf_dir)
    return _SHARED[key]


class Data:
    """The given tables and what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def n_docs(self) -> int:
        return self.table("documents").count()

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text")

    @cached_property
    def lists(self) -> DataFrame:
        return settle(corpus.word_lists(self.documents, T.kept_words("text", ENG)))

    @cached_property
    def counts(self) -> DataFrame:
        return settle(V.token_counts(self.lists))

    @cached_property
    def vocab(self) -> DataFrame:
        return settle(V.build_vocab(self.counts, MIN_DF, MAX_FEATURES))

    @cached_property
    def n_terms(self) -> int:
        return self.vocab.count()

    @cached_property
    def bow(self) -> DataFrame:
        return settle(V.bow(self.counts, self.vocab, MAX_FEATURES))

    @cached_property
    def rows(self) -> DataFrame:
        return settle(V.doc_rows(self.bow))

    @cached_property
    def tokens(self) -> DataFrame:
        """A surface parse, packed by document: the head of a word is the word before it."""
        return settle(surface_parse(self.documents))

    @cached_property
    def resolved(self) -> DataFrame:
        return deps.resolve_heads(self.tokens)

    @cached_property
    def triples(self) -> DataFrame:
        return settle(deps.triples(self.tokens))

    @cached_property
    def vpairs(self) -> DataFrame:
        return settle(deps.vocab_pairs(self.triples, self.vocab, MAX_FEATURES))

    @cached_property
    def syntax(self) -> DataFrame:
        return settle(graphs.syntax_graph(self.vpairs, 15))

    @cached_property
    def theta_rows(self) -> DataFrame:
        """``(doc_id, w)``: a mixture from the document's language and id."""
        raw = [F.lit(1.0) + ((F.col("doc_id") * 7919 + k * 104729) % 10007) / F.lit(10007.0)
               + F.when(F.col("lang") == LANGS[k], 0.8).otherwise(0.0) for k in range(TOPICS)]
        s = raw[0] + raw[1] + raw[2] + raw[3]
        return self.documents.select("doc_id", F.array(*[r / s for r in raw]).alias("w"))

    @cached_property
    def theta(self) -> DataFrame:
        return settle(self.theta_rows.select("doc_id", F.posexplode("w").alias("topic", "weight")))

    @cached_property
    def dominant(self) -> DataFrame:
        return settle(V.dominant_topic(self.theta))

    @cached_property
    def beta(self) -> DataFrame:
        return settle(V.pseudo_beta(self.bow, self.theta))

    @cached_property
    def phi(self) -> DataFrame:
        return settle(V.row_normalise(self.beta).withColumn("weight", F.round("weight", 12)))

    @cached_property
    def words(self) -> DataFrame:
        return settle(reports.top_words(self.phi, 10))

    @cached_property
    def mwes(self) -> DataFrame:
        return settle(reports.mwes(self.words, self.triples, 10 * TOPICS, 15))

    @cached_property
    def word_vectors(self) -> DataFrame:
        """The stored vectors, one per vocabulary word by id."""
        emb = self.table("embeddings").select(
            F.col("vec_id").cast("int").alias("term_id"), F.col("embedding").cast("array<double>").alias("vec"))
        return settle(self.vocab.select("term_id", "term").join(emb, "term_id"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")

    @cached_property
    def topic_vectors(self) -> DataFrame:
        return settle(vectors.topic_vectors(self.phi, self.word_vectors, DIM, MAX_FEATURES, True))

    @cached_property
    def topic_list(self) -> list[tuple[int, list[float]]]:
        return [(r["topic"], r["vec"]) for r in self.topic_vectors.orderBy("topic").collect()]

    @cached_property
    def times(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("doc_id"), temporal.seconds("ts").alias("ts")).join(
            self.documents.select("doc_id"), "doc_id")

    @cached_property
    def runs(self) -> DataFrame:
        """Run records from the order lines: one row per corpus, model, seed and K."""
        return self.table("lineitem").groupBy(
            F.col("l_linestatus").alias("corpus"), F.col("l_returnflag").alias("model"),
            F.col("l_linenumber").alias("seed"), (F.quarter("l_shipdate") * 5).alias("k")).agg(
            F.avg("l_discount").alias("npmi"), F.avg("l_tax").alias("c_v"),
            (F.avg("l_quantity") / 50.0).alias("diversity"))


RELS = ("compound", "amod", "nsubj", "obj", "nmod", "advmod")


def surface_parse(docs: DataFrame) -> DataFrame:
    """``(doc_id, toks)``: the tokens of a document in one row, as `corpus.unpacked` reads them."""
    stops = sorted(ENG)

    def tokens(sentence: Column, number: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(sentence), F.lit(T.WORD_RUN), F.lit(1)), lambda form, p: F.struct(
            number.alias("sent_id"), (p + 1).alias("tok_id"), form.alias("form"), form.alias("lemma"), F.lit("X").alias("upos"),
            F.when(p == 0, "root").otherwise(F.element_at(F.array(*[F.lit(r) for r in RELS]), F.length(form) % 6 + 1)).alias("dep"),
            p.alias("head_id"), form.isin(stops).alias("is_stop"), form.rlike(T.LETTERS_ONLY).alias("is_alpha")))

    return docs.select("doc_id", F.flatten(F.transform(T.sentences("text"), tokens)).alias("toks"))


# -- SQL text of the shared tables -------------------------------------------------

SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(ENG)) + "]"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}|{SP}$', '', 'g')"


def u01(*parts) -> str:
    keys = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {keys})), 1, 12) AS BIGINT) / 281474976710656.0)"


def replicates_sql(rows: str, key: str, n: int, seed: int = 0) -> str:
    """``rows`` once for each replicate ``b``, with its Poisson(1) count ``w``."""
    low = 1 << 32
    mixed = f"(SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT) + b * {0x9E3779B9}) % {low} AS x FROM {rows}, (SELECT unnest(range({n})) AS b))"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        mixed = f"(SELECT * REPLACE (CAST(CAST(xor(x, x >> {shift}) AS HUGEINT) * {factor} % {low} AS BIGINT) AS x) FROM {mixed})"
    count = " + ".join(f"CAST(xor(x, x >> 16) / {low}.0::DOUBLE >= {edge}::DOUBLE AS INTEGER)" for edge in POISSON1_CDF)
    return f"(SELECT *, {count} AS w FROM {mixed})"


def wordlist(x: str, low: int = 2) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda z: "
            f"regexp_full_match(z, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]{{2,}}') AND length(z) >= {low})")


def vocab_sql(name: str, limit: int, counts: str = "counts") -> str:
    return f"""{name} AS MATERIALIZED (SELECT term, df, tf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id
  FROM (SELECT * FROM (SELECT term, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS tf FROM {counts} GROUP BY 1)
        WHERE df >= {MIN_DF} ORDER BY tf DESC, term LIMIT {limit}))"""


_RAW = [f"1.0::DOUBLE + ((doc_id * 7919 + {k} * 104729) % 10007) / 10007.0::DOUBLE "
        f"+ CASE WHEN lang = '{LANGS[k]}' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END" for k in range(TOPICS)]

CTES = {
    "lists": f"""lists AS (SELECT doc_id, list_filter({wordlist('text', 3)},
  lambda z: NOT list_contains({STOPS}, z)) AS tokens FROM documents)""",
    "tok": """tok AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM lists)""",
    "counts": "counts AS (SELECT doc_id, term, count(*) AS cnt FROM tok GROUP BY 1, 2)",
    "vocab": vocab_sql("vocab", MAX_FEATURES),
    "bow": "bow AS MATERIALIZED (SELECT doc_id, term_id, term, cnt FROM counts JOIN vocab USING (term))",
    "sents": f"""sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sent_id FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace({ws('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)),
  lambda z: z <> '') AS ss FROM documents))""",
    "stok": f"""stok AS (SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(p AS INTEGER) AS tok_id, form, form AS lemma, 'X' AS upos,
  CASE WHEN p = 1 THEN 'root' ELSE (['compound','amod','nsubj','obj','nmod','advmod'])[length(form) % 6 + 1] END AS dep,
  CAST(p - 1 AS INTEGER) AS head_id, list_contains({STOPS}, form) AS is_stop,
  regexp_full_match(form, '\\p{{L}}+') AS is_alpha
  FROM (SELECT doc_id, sent_id, unnest(ws) AS form, generate_subscripts(ws, 1) AS p FROM (
    SELECT doc_id, sent_id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM sents)))""",
    "res": """res AS (SELECT t.*, h.lemma AS head_lemma, h.is_stop AS head_stop, h.is_alpha AS head_alpha
  FROM stok t LEFT JOIN stok h ON t.doc_id = h.doc_id AND t.sent_id = h.sent_id AND t.head_id = h.tok_id)""",
    "triples": """triples AS MATERIALIZED (SELECT head_lemma AS head, dep AS relation, lemma AS dependent, count(*) AS cnt FROM res
  WHERE NOT is_stop AND is_alpha AND length(lemma) >= 3 AND length(head_lemma) >= 3 AND head_lemma <> lemma
  AND dep IN ('compound','amod','nsubj','obj','nmod') GROUP BY 1, 2, 3)""",
    "pairs": "pairs AS (SELECT head, dependent, CAST(sum(cnt) AS BIGINT) AS cnt FROM triples GROUP BY 1, 2)",
    "vpairs": """vpairs AS (SELECT a.term_id AS src, b.term_id AS dst, CAST(cnt AS DOUBLE) AS weight FROM pairs
  JOIN vocab a ON head = a.term JOIN vocab b ON dependent = b.term)""",
    "sym": """sym AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM vpairs WHERE src <> dst
  UNION ALL SELECT dst, src, weight FROM vpairs WHERE src <> dst) GROUP BY 1, 2)""",
    "syntax": """topk AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r
  FROM (SELECT src, dst, weight / max(weight) OVER (PARTITION BY src) AS weight FROM sym)) WHERE r <= 15),
syntax AS (SELECT a.src, a.dst, least(a.weight, b.weight) AS weight FROM topk a JOIN topk b ON a.src = b.dst AND a.dst = b.src)""",
    "theta": "thw AS (SELECT doc_id, " + ", ".join(f"({r}) AS r{k}" for k, r in enumerate(_RAW)) + """ FROM documents),
theta AS (""" + " UNION ALL ".join(
        f"SELECT doc_id, {k} AS topic, r{k} / (r0 + r1 + r2 + r3) AS weight FROM thw" for k in range(TOPICS)) + ")",
    "dom": """dom AS (SELECT doc_id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY weight DESC, topic) AS r FROM theta) WHERE r = 1)""",
    "beta": """beta AS (SELECT topic, term_id, term, sum(cnt * weight) AS weight FROM bow JOIN theta USING (doc_id)
  GROUP BY 1, 2, 3)""",
    "phi": "phi AS MATERIALIZED (SELECT topic, term_id, term, round(weight / sum(weight) OVER (PARTITION BY topic), 12) AS weight FROM beta)",
    "words": """words AS (SELECT topic, CAST(rank AS INTEGER) AS rank, term, term_id, weight FROM (SELECT *, row_number() OVER (
  PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM phi) WHERE rank <= 10)""",
    "mwes": """mscore AS (SELECT w.topic, head || ' ' || dependent AS phrase, relation, cnt, CAST(count(*) AS INTEGER) AS in_topic,
  cnt * CASE WHEN count(*) = 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score
  FROM triples t JOIN words w ON (t.head = w.term OR t.dependent = w.term)
  WHERE relation IN ('amod','compound','nmod','flat','fixed','det') GROUP BY w.topic, head, dependent, relation, cnt),
mwes AS (SELECT topic, CAST(rank AS INTEGER) AS rank, phrase, relation, score, cnt, in_topic FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, phrase) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic, phrase ORDER BY score DESC, relation) AS r FROM mscore)
  WHERE r = 1) WHERE rank <= 15)""",
    "wv": """wv AS MATERIALIZED (SELECT term_id, term, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM vocab JOIN embeddings ON vec_id = term_id)""",
    "wvx": "wvx AS (SELECT term_id, term, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM wv)",
    "demb": """demb AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label
  FROM embeddings)""",
    "tv": """tvx AS (SELECT topic, i, sum(weight * x) AS x FROM phi JOIN wvx USING (term_id) GROUP BY 1, 2),
tv AS (SELECT topic, list(x / n ORDER BY i) AS vec FROM tvx JOIN (SELECT topic, sqrt(sum(x * x)) AS n FROM tvx GROUP BY 1)
  USING (topic) GROUP BY 1)""",
    "times": """times AS (SELECT event_id AS doc_id, epoch_us(ts) / 1e6 AS ts FROM events JOIN documents ON event_id = doc_id)""",
    "runs": """runs AS (SELECT l_linestatus AS corpus, l_returnflag AS model, l_linenumber AS seed,
  CAST(quarter(l_shipdate) * 5 AS INTEGER) AS k, avg(l_discount) AS npmi, avg(l_tax) AS c_v, avg(l_quantity) / 50.0 AS diversity
  FROM lineitem GROUP BY 1, 2, 3, 4)""",
}
NEEDS = {
    "tok": ["lists"], "counts": ["tok"], "vocab": ["counts"], "bow": ["counts", "vocab"],
    "stok": ["sents"], "res": ["stok"],
    "triples": ["res"], "pairs": ["triples"], "vpairs": ["pairs", "vocab"], "sym": ["vpairs"],
    "syntax": ["sym"], "dom": ["theta"], "beta": ["bow", "theta"], "phi": ["beta"], "words": ["phi"],
    "mwes": ["triples", "words"], "wv": ["vocab"], "wvx": ["wv"], "tv": ["phi", "wvx"],
}


def sql(tables: str, body: str, doubles: str = "", extra: str = "") -> str:
    """A query over shared tables; ``doubles`` are rounded as the Spark side is."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for t in tables.split():
        add(t)
    parts = [CTES[t] for t in order] + ([extra] if extra else [])
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    if doubles:
        rep = ", ".join(f"round({d}, 6) + 0.0 AS {d}" for d in doubles.split())
        return f"{head}SELECT * REPLACE ({rep}) FROM (\n{body}\n)"
    return head + body
