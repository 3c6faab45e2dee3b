"""Personal data and the words that give it away, with built-in SQL functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by
patterns and checked natively. Each value is a protected entity. Words near an entity (up to
``CONTEXT`` characters on either side, cut words left out) are counted with it over the
corpus: with N documents, the information of entity e is IC(e) = log2(N / df(e)), and a word
t discloses PMI(e, t) = log2(N n(e, t) / (df(e) df(t))) of it. If the disclosed share
PMI / IC reaches ``THRESHOLD`` for an entity and a word that stand together in at least
``LEAST_JOINT`` documents, the word is a span of kind ``term`` beside that entity. It is
generalised to its first three letters if those disclose less, else removed.

The text is read twice: once for spans and contexts, of which only short staged tables are
kept, and once for the document frequencies of the words in question. Words are counted per
document before they move; a value or word that very many documents share is a sum, never a
group. The candidate words are sent to every task only if their counted number proves them
small.

Null is an empty text. A row is a document; rows that repeat both id and text share their
term spans and count once for n(e, t). Positions are code points, ends exclusive. Where the
tables are empty, or no entity stands in two documents, there are no term spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import row_key, settle, small

KINDS = ("email", "ip", "card", "phone")
CONTEXT, LEAST_JOINT, THRESHOLD = 80, 2, 0.9

#: Java forms of the four patterns. Runs are possessive and begin where nothing of their own
#: class precedes (or where the last match ended), which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is tried.
HINTS = {"email": "contains(t, '@')", "ip": r"t RLIKE '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", "card": r"t RLIKE '[0-9](?:[ -]?[0-9]){12}'", "phone": r"t RLIKE '\\+[0-9]'"}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a +
    CASE WHEN i % 2 = 1 THEN cast(substring({_DIGITS}, -i, 1) AS int)
         ELSE cast(substring({_DIGITS}, -i, 1) AS int) * 2 - IF(cast(substring({_DIGITS}, -i, 1) AS int) > 4, 9, 0) END) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> try_cast(p AS double) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
WORD = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@])"
_STEP = 256


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str, base: str = "0") -> str:
    """All matches of a pattern as array<struct<s, e, v, l, r, cl, cr>>.

    ``s`` and ``e`` are positions counted from ``base``, ``v`` the match, ``l`` and ``r``
    what stands before and after it up to the next match, cut to the context, and ``cl`` and
    ``cr`` whether they are cut. Positions are running sums over the parts between matches,
    in two levels, so many matches in one text stay cheap.
    """
    p = _sql(pattern)
    parts = f"""transform(regexp_extract_all({text}, {p}, 0), (m, i) -> struct(
        length(get(g, i)) AS a, length(m) AS b, m AS v,
        right(get(g, i), {CONTEXT}) AS l, left(get(g, i + 1), {CONTEXT}) AS r,
        length(get(g, i)) > {CONTEXT} AS cl, length(get(g, i + 1)) > {CONTEXT} AS cr))"""
    z = f"get(transform(array(split({text}, {p}, -1)), g -> {parts}), 0)"
    blocks = f"transform(sequence(0, cast((size(z) - 1) DIV {_STEP} AS int)), k -> slice(z, k * {_STEP} + 1, {_STEP}))"
    empty = "cast(array() AS array<struct<s: int, e: int, v: string, l: string, r: string, cl: boolean, cr: boolean>>)"
    inside = f"""aggregate(blk, struct(acc.p AS p, {empty} AS o), (c, x) -> struct(
        c.p + x.a + x.b AS p,
        concat(c.o, array(struct(c.p + x.a AS s, c.p + x.a + x.b AS e, x.v AS v, x.l AS l, x.r AS r, x.cl AS cl, x.cr AS cr))) AS o))"""
    whole = f"""aggregate({blocks}, struct(cast({base} AS int) AS p, cast(array() AS array<array<struct<s: int, e: int, v: string, l: string, r: string, cl: boolean, cr: boolean>>>) AS o),
        (acc, blk) -> get(transform(array({inside}), y -> struct(y.p AS p, concat(acc.o, array(y.o)) AS o)), 0), acc -> flatten(acc.o))"""
    return f"get(transform(array({z}), z -> IF(size(z) = 0, {empty}, {whole})), 0)"


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array of checked matches for each kind."""
    docs = docs.withColumn("t", F.coalesce("text", F.lit("")))
    none = "cast(array() AS array<struct<s: int, e: int, v: string, l: string, r: string, cl: boolean, cr: boolean>>)"
    for kind in KINDS:
        docs = docs.withColumn(kind, F.expr(f"IF({HINTS[kind]}, filter({found('t', PATTERNS[kind])}, x -> {VALID[kind]}), {none})"))
    return docs


def _written(kind: str) -> str:
    return f"transform({kind}, x -> concat('{kind}:', x.s, ':', x.e))"


def _context() -> str:
    """Words near every span, as array<struct<entity, term, s, e>>."""
    left = "IF(x.cl, regexp_replace(x.l, '^\\\\S+', ''), x.l)"
    right = "IF(x.cr, regexp_replace(x.r, '\\\\S+$', ''), x.r)"
    sides = []
    for kind in KINDS:
        words = f"""concat({found('lt', WORD, 'x.s - length(lt)')}, {found('rt', WORD, 'x.e')})"""
        near = f"get(transform(array({left}), lt -> get(transform(array({right}), rt -> {words}), 0)), 0)"
        sides.append(f"flatten(transform({kind}, x -> transform({near}, w -> struct(concat('{kind}:', lower(x.v)) AS entity, lower(w.v) AS term, w.s AS s, w.e AS e))))")
    return f"concat({', '.join(sides)})"


def staged(docs: DataFrame) -> DataFrame:
    """Counts, base spans and contexts of every row, without its text."""
    found_ = base_spans(docs.select("doc_id", "text"))
    any_ = " OR ".join(f"size({k}) > 0" for k in KINDS)
    return found_.select(
        "doc_id",
        F.when(F.expr(any_), row_key(F.col("doc_id"), F.col("t"))).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("row"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.expr(f"array_join(concat({', '.join(map(_written, KINDS))}), ',')").alias("base"),
        F.expr(f"concat({', '.join(f'transform({k}, x -> struct(x.s AS s, x.e AS e))' for k in KINDS)})").alias("taken"),
        F.expr(f"array_distinct(concat({', '.join(f'transform({k}, x -> concat({chr(39)}{k}:{chr(39)}, lower(x.v)))' for k in KINDS)}))").alias("entities"),
        F.expr(_context()).alias("near"),
    )


def disclosures(docs: DataFrame, stage: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, share, action) of the words that disclose an entity too strongly."""
    entity = stage.where("size(entities) > 0").select("row", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= LEAST_JOINT)
    beside = stage.where("size(near) > 0").select("row", F.explode("near").alias("w")).select("row", "w.entity", "w.term")
    both = beside.unionByName(beside.withColumn("term", F.concat(F.substring("term", 1, 3), F.lit("*")))).distinct()
    joint = both.groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_JOINT).join(entity, "entity")
    joint = settle(joint, "joint")
    wanted = settle(joint.select("term").distinct(), "terms")
    terms = F.expr(f"array_distinct(transform(regexp_extract_all(text, {_sql(WORD)}, 0), w -> lower(w)))")
    tokens = docs.where("text IS NOT NULL").select(terms.alias("w"))
    tokens = tokens.select(F.explode(F.expr("array_union(w, transform(w, x -> concat(substring(x, 1, 3), '*')))")).alias("term"))
    df = tokens.join(small(wanted, 64), "term").groupBy("term").agg(F.count("*").alias("df_t"))
    n = docs.count()
    share = F.log2(F.lit(float(n)) * F.col("n") / (F.col("df_e") * F.col("df_t"))) / F.log2(F.lit(float(n)) / F.col("df_e"))
    scored = settle(joint.where(F.col("df_e") < n).join(df, "term").withColumn("share", share).where(F.col("share") >= threshold), "shares")
    words = scored.where("term NOT LIKE '%*'").withColumn("general", F.concat(F.substring("term", 1, 3), F.lit("*")))
    general = scored.where("term LIKE '%*'").select("entity", F.col("term").alias("general"), F.lit("remove").alias("action"))
    return words.join(general, ["entity", "general"], "left").select("entity", "term", "share", F.coalesce("action", F.lit("generalise")).alias("action"))


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, counts, base, terms) of every row; terms are (s, e, action) by place."""
    stage = settle(staged(docs), "spans")
    flagged = settle(disclosures(docs, stage, threshold), "disclosures")
    places = stage.where("size(near) > 0").select("row", F.explode("near").alias("w")).select("row", "w.*")
    hit = places.join(small(flagged.select("entity", "term", "action"), 160), ["entity", "term"])
    # next to two entities a word may be removed for one and generalised for the other
    one = hit.groupBy("row", "s", "e").agg(F.max("action").alias("action"))
    terms = one.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "action"))).alias("terms"))
    out = stage.join(terms, "row", "left")
    free = F.expr("filter(coalesce(terms, cast(array() AS array<struct<s: int, e: int, action: string>>)), w -> NOT exists(taken, b -> w.s < b.e AND b.s < w.e))")
    return out.withColumn("terms", free).drop("near", "entities")


def sanitise(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base spans replaced by their kind, and disclosing words by a general
    form or nothing; overlapping spans are replaced together by the kind of the first."""
    found_ = spans(docs, threshold).select("row", "base", "terms").dropDuplicates(["row"])
    marks = F.expr("""array_sort(concat(
        transform(filter(split(base, ','), x -> x <> ''), x -> struct(cast(split(x, ':')[1] AS int) AS s, cast(split(x, ':')[2] AS int) AS e, concat('[', upper(split(x, ':')[0]), ']') AS k)),
        transform(terms, x -> struct(x.s AS s, x.e AS e, x.action AS k))))""")
    held = found_.select("row", marks.alias("_marks"))
    rest = docs.columns
    docs = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    # as in ``staged``: only rows with base spans have marks, under the digest of id and text
    docs = docs.withColumn("row_", row_key(F.col("doc_id"), F.col("_t")))
    joined = docs.join(held.withColumnRenamed("row", "row_"), "row_", "left")
    piece = """concat(acc.o, array(substring(_t, acc.p + 1, m.s - acc.p), CASE m.k WHEN 'remove' THEN '' WHEN 'generalise' THEN concat(substring(_t, m.s + 1, 3), '*') ELSE m.k END))"""
    text = f"""IF(coalesce(size(_marks), 0) <= 0, text, aggregate(_marks, struct(0 AS p, cast(array() AS array<string>) AS o),
        (acc, m) -> IF(m.s < acc.p, struct(greatest(acc.p, m.e) AS p, acc.o AS o), struct(m.e AS p, {piece} AS o)),
        acc -> concat(array_join(acc.o, ''), substring(_t, acc.p + 1))))"""
    return joined.withColumn("text", F.expr(text)).select(rest)


def op1_pii(spark, sf_dir):
    """Whole ``documents``: base counts and spans, and the words that disclose them."""
    out = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    every = F.expr("array_join(filter(array(base, array_join(transform(terms, w -> concat('term:', w.s, ':', w.e)), ',')), x -> x <> ''), ',')")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_terms"))
