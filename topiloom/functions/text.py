"""Text expressions over whole documents; none of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import FUNCTION_WORDS

# The characters that count as white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# A word is two or more letters or letter-like numbers, no digit or underscore.
WORD_RUN = r"([\p{L}\p{N}_]+)"
WORD_ONLY = r"^[\p{L}\p{No}\p{Nl}]{2,}$"
LETTERS_ONLY = r"^\p{L}+$"
MIN_DOC_CHARS = 10
MIN_LEMMA_CHARS = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(_c(c), rf"^{SPACE}|{SPACE}$", "")


def normalise_ws(c) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(_c(c), SPACE, " "))


def long_enough(c) -> Column:
    """True for documents of more than ten characters after collapsing white space."""
    return F.length(normalise_ws(c)) > MIN_DOC_CHARS


def sentences(c) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` followed by a blank; no empty ones."""
    return F.filter(F.split(normalise_ws(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def chunks(c, max_chars: int = 800) -> Column:
    """Greedy packing of sentences into segments of at most ``max_chars``.

    A short document stays whole, the tail is kept and nothing is dropped; a single
    sentence longer than the limit is a segment of its own.
    """
    if max_chars < 50:
        raise ValueError(f"max_chars must be >= 50, got {max_chars}")
    clean = normalise_ws(c)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, s):
        flush = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > max_chars)
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["cur"])))
            .otherwise(acc["done"]).alias("done"),
            F.when(flush, s).otherwise(joined).alias("cur"),
        )

    packed = F.aggregate(
        sentences(c), empty, step,
        lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"])))
        .otherwise(acc["done"]),
    )
    return (
        F.when(clean == "", F.array().cast("array<string>"))
        .when(F.length(clean) <= max_chars, F.array(clean))
        .otherwise(packed)
    )


def words(c, min_chars: int = 2) -> Column:
    """Unicode words of the lower-cased text, in order, found in one regex pass."""
    pattern = rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{No}}\p{{Nl}}]{{{min_chars},}}+(?![\p{{L}}\p{{N}}_])"
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(pattern), F.lit(0))


def ascii_words(c) -> Column:
    """Runs of two or more letters a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[a-z]{2,}"), F.lit(0))


def reference_words(c, stop: Iterable[str]) -> Column:
    """White-space tokens that are alphabetic, not stop words and longer than two."""
    stops = sorted(stop)
    return F.filter(
        F.split(normalise_ws(F.lower(_c(c))), " "),
        lambda w: w.rlike(LETTERS_ONLY) & (F.length(w) > 2) & ~w.isin(stops),
    )


def reference_bow_words(c, stop: Iterable[str]) -> Column:
    """ASCII words that may hold underscores after the first letter, stop words off."""
    stops = sorted(stop)
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_RUN), F.lit(1))
    return F.filter(runs, lambda w: w.rlike(r"^[a-z][a-z_]+$") & ~w.isin(stops))


def kept_words(c, stop: Iterable[str], min_chars: int = MIN_LEMMA_CHARS) -> Column:
    """Words that are not stop words and have at least ``min_chars`` letters."""
    stops = sorted(stop)
    return F.filter(words(c, min_chars), lambda w: ~w.isin(stops))


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams joined by a blank."""
    t = _c(tokens)
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " ")),
        F.array().cast("array<string>"),
    )


def preview(c, n: int = 80) -> Column:
    """The first ``n`` characters and ``...`` when the text is longer."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def spaced(c) -> Column:
    """``a_b`` as ``a b``."""
    return F.regexp_replace(_c(c), "_", " ")


def word_count(c) -> Column:
    """Number of white-space tokens; 0 for an empty text."""
    clean = normalise_ws(c)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def content_bearing(phrase) -> Column:
    """True when some token is longer than three letters and no function word."""
    toks = F.split(normalise_ws(F.lower(spaced(phrase))), " ")
    return F.exists(toks, lambda t: (F.length(t) > 3) & ~t.isin(sorted(FUNCTION_WORDS)))
