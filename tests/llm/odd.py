"""Small tables with everything that real ones hold now and then."""

from __future__ import annotations

import random

#: Columns whose names clash with those the operators use inside.
EXTRA = ["id", "key", "size", "band", "node", "rep", "bucket_", "shard", "held_out", "label", "vector", "group_", "source_", "whole_", "times_", "times", "cut_", "key_", "none_of_", "none", "doc", "words", "part_", "n", "cuts", "rank"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(n)]
    for i in range(0, n // 2, 2):
        w = out[i].split()
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))  # a near copy
    out += [out[0]] * 5 + [out[1].upper()] * 2
    return out


def documents(spark, extra=True, n=60):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts(n=n))]
    k = len(rows)
    odd = [None, "", "   \n\t", "one", "One two three", "a b c d e", "é" * 40, "word " * 4000, "x" * 30_000, "1" * 20_000, "\U0001f600 mail me@x.y now", "<|endoftext|> end", "a\u00a0b\u2003c"]
    rows += [(k + i, t, "en", "srß" if i % 2 else "", None) for i, t in enumerate(odd)]
    rows += [(None, "no id here at all", None, None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], "en", "src1", 3)]  # repeated rows, and an id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA if extra else []:
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark, docs_n=90):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(docs_n)] + [(None, 1, 0), (5, None, None), (7, 1, 1), (7, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as id", "'x' as text", "1 as y")
