"""Tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

BASE = "/root/testdata/sf0.001"
LONG = ("word and another word with mail a.b@example.org and id1ot under the MIT License\n" * 3000).strip()
#: (doc_id, text); ids repeat with the same and with other texts.
ODD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under the Apache License, Version 2.0."),
    (5, LONG), (6, "one"), (7, "one"), (8, "a b c d e f g h i j"), (9, "A B C D E F G H I J"), (None, "a b c d e f g h i j"), (None, None),
    (10, "Ünïcödé — 数字 ١٢٣ 🙂 <|endoftext|> don't  stop"), (11, "12345 678"), (12, "+1 (314) 555-6532 and 44.209.66.35, 4111 1111 1111 1111"), (4, "another text"),
]
#: Columns whose names clash with results or inner names.
EXTRA = ["lang", "source", "n_chars", "score", "n_lines", "n_dropped", "items", "overlap", "labels", "component_id", "kept", "node", "key", "spans", "row", "t", "terms", "toxic", "n", "a", "b", "title"]


def odd_docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit(7).cast("long") if c == "n_chars" else F.lit("x"))
    return df


def empty_docs(spark):
    return odd_docs(spark).where("false")


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def table(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{BASE}/{name}.parquet")
