"""Licence scan with a positional index of rare licence words.

Each licence template is a short run of words from its notice. The words of all templates
are looked up in every document of the corpus for their document frequency; a template is
then indexed under its rarest words, each with its place in the template. A file's words
are looked up in that index, the highest IDF first; postings that agree on where the
template would have to begin are intersected, and a place where enough rare words agree is
verified: the template's words must stand there with enough of their IDF weight, and its
mandatory key phrases must occur in the same stretch.

Words are runs of ASCII digits and letters and of characters beyond ASCII, A-Z lower-cased.
Base phrases are found wherever their words stand one after another. Null is an empty text,
without words. Rows that repeat are scanned each for itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import ALNUM, LOWER, Hasher, Slice, column, hash_one, per_row, slices, tidied, words
from .tables import keep_rest, modest_batches

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Words of licence notices (label, notice, mandatory key phrases).
TEMPLATES = (
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document artistic license 2 0", ("artistic license",)),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote",)),
    ("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("by nc 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("by nc sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("by sa 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-2.0", "either version 2 of the license or at your option any later version gnu general public license", ("version 2 of the license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-3.0", "either version 3 of the license or at your option any later version gnu general public license", ("version 3 of the license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("without fee",)),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", ("lesser general public license", "2 1")),
    ("lgpl-3.0", "gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge",)),
    ("mit-release", "released under the mit license", ("mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("as is without any express",)),
)

#: Rare words that index a template, how many of them must agree on a place (or all of a
#: template with fewer), and the share of the IDF weight that must stand there.
RARE_WORDS, AGREE, SHARE = 5, 2, 0.75


class Index:
    """Templates under their rarest words; ``df`` has the document frequency of every word."""

    def __init__(self, df: dict[str, int], n_docs: int, templates=TEMPLATES):
        self.idf = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 0.5))) for t in templates for w in t[1].split()}
        self.templates = []
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (label, notice, phrases) in enumerate(templates):
            ws = notice.split()
            weight = np.array([max(self.idf[w], 0.01) for w in ws])
            rare = sorted(dict.fromkeys(ws), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
            for i, w in enumerate(ws):
                if w in rare:
                    self.postings[hash_one(w)].append((k, i))
            self.templates.append((label, np.array([hash_one(w) for w in ws], np.uint64), weight / weight.sum(), [np.array([hash_one(w) for w in p.split()], np.uint64) for p in phrases], min(AGREE, len(rare))))
        by_idf = {hash_one(w): v for w, v in self.idf.items()}
        self.keys = np.array(sorted(self.postings), np.uint64)
        self.rank = {h: by_idf[h] for h in self.postings}

    def scan(self, h: np.ndarray) -> list[tuple[str, float]]:
        """Labels and scores of the templates that stand in a file with word hashes ``h``."""
        at = np.flatnonzero(np.isin(h, self.keys))
        votes: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p in sorted(at.tolist(), key=lambda p: -self.rank[int(h[p])]):
            for k, i in self.postings[int(h[p])]:
                votes[k, p - i].add(int(h[p]))
        best: dict[str, float] = {}
        for (k, start), agree in votes.items():
            label, template, weight, phrases, need = self.templates[k]
            if len(agree) < need:
                continue
            lo, hi = max(start, 0), min(start + len(template), len(h))
            share = float(weight[lo - start:hi - start][h[lo:hi] == template[lo - start:hi - start]].sum())
            if share >= SHARE and share > best.get(label, 0) and all(has_run(h[lo:hi], p) for p in phrases):
                best[label] = min(share, 1.0)
        return sorted(best.items())


def runs(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the hashes of ``phrase`` stand one after another in ``h``."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = h[:n] == phrase[0]
    for i in range(1, len(phrase)):
        hit &= h[i:n + i] == phrase[i]
    return np.flatnonzero(hit)


def has_run(h: np.ndarray, phrase: np.ndarray) -> bool:
    return len(runs(h, phrase)) > 0


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a slice."""
    data = LOWER[s.data]
    starts, ends, rows = words(data, s.offsets, ALNUM)
    return Hasher(data)(starts, ends), rows


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that have each word."""
    keys = np.array([hash_one(w) for w in vocabulary], np.uint64)
    order = np.argsort(keys)
    count = np.zeros(len(keys), np.int64)
    for batch in batches:
        for s in slices(column(batch, "text")):
            h, rows = word_hashes(s)
            hit = np.flatnonzero(np.isin(h, keys))
            at = np.searchsorted(keys[order], h[hit])
            pair = np.unique(rows[hit] * len(keys) + at)
            count += np.bincount(pair % len(keys), minlength=len(keys))
    yield pa.RecordBatch.from_pydict({"word": [vocabulary[i] for i in order], "docs": count})


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents of the whole corpus have each word of a fixed vocabulary."""
    parts = modest_batches(docs).select("text").mapInArrow(lambda it: tidied(_frequencies(it, vocabulary)), "word string, docs long")
    return {r["word"]: r["docs"] for r in parts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    phrases = [(np.array([hash_one(w) for w in p.split()], np.uint64), label) for p, label in sorted(BASE.items())]
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for s in slices(column(batch, "text")):
            h, rows = word_hashes(s)
            edge = per_row(rows, len(s))
            places: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for phrase, label in phrases:
                p = runs(h, phrase)
                p = p[rows[p] == rows[p + len(phrase) - 1]]
                for at in p.tolist():
                    places[int(rows[at])].append((at, label))
            seeded = set(np.unique(rows[np.isin(h, index.keys)]).tolist())
            for r in range(len(s)):
                lo, hi = int(edge[r]), int(edge[r + 1])
                found = places.get(r, [])
                base = sorted({label for _, label in found})
                own = index.scan(h[lo:hi]) if r in seeded else []
                starts = [at - lo for at, _ in found]
                out["n_words"].append(hi - lo)
                out["n_base"].append(len(found))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(base))
                out["labels"].append(",".join(sorted({*base, *(label for label, _ in own)})))
                out["score"].append(1.0 if base else max((x for _, x in own), default=0.0))
        rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"}
        longs = {c: pa.array(out[c], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")}
        yield pa.RecordBatch.from_pydict(rest | longs | {c: pa.array(out[c], pa.string()) for c in ("base_labels", "labels")} | {"score": pa.array(out["score"], pa.float64())})


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Licences of every text: base phrase places, labels of both kinds, and the best share.

    Other columns pass through, except those that are named like an output.
    """
    index = Index(document_frequencies(docs, sorted({w for t in templates for w in t[1].split()})), docs.count(), templates)
    docs = docs.select(keep_rest(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema += (", " if schema else "") + "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(lambda it: tidied(_scan(it, index)), schema)


def op7_licences(spark, sf_dir):
    """Whole ``documents`` scanned for licences."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
