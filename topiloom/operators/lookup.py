"""Words to ids inside a task, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_hashes(tokens: Column | str) -> Column:
    """The hash of each word of an array, made by Spark."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


class Words:
    """A bounded word list, sorted by hash; words of one hash are told apart by comparison."""

    def __init__(self, vocab: DataFrame):
        table = vocab.select(F.xxhash64("term").alias("h"), "term", "term_id").orderBy("h", "term").toArrow().combine_chunks()
        self.hashes = table.column("h").to_numpy()
        self.terms = table.column("term").combine_chunks()
        self.numbers = table.column("term_id").to_numpy().astype(np.int64)
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(self.hashes) else 0

    def ids(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The id of each word, -1 for words that are not listed."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        for _ in range(self.alike):
            here = np.flatnonzero((at < len(self.hashes)) & (out < 0))
            here = here[self.hashes[at[here]] == hashes[here]]
            if not len(here):
                break
            same = pc.equal(words.take(pa.array(here)), self.terms.take(pa.array(at[here]))).to_numpy(zero_copy_only=False)
            out[here[same]] = self.numbers[at[here[same]]]
            at = at + 1
        return out


def flat_lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column, and the row of each; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten(), np.repeat(np.arange(len(sizes)), sizes)
