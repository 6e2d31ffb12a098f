"""Small tables with the cases that every operator has to take: nulls, empty and long texts, copies, repeated rows."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("shard", T.StringType()),
])
_WORDS = "alpha Beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau über".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(_WORDS) + (rng.choice(_WORDS) if rng.random() < 0.5 else "") for _ in range(words))


def rows(seed: int = 1, plain: int = 60) -> list[tuple]:
    """Documents with planted copies, near copies and shared passages; ids are not in the order of the rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(5, 120)) for _ in range(plain)]
    shared = sentence(rng, 40)
    texts += [texts[0], texts[1], texts[1] + " end", texts[2].upper(), shared, f"{texts[3]} {shared}", f"{shared} {texts[4]}"]
    texts += [f"{sentence(rng, 30)}\n{shared}. {sentence(rng, 10)}", "", "   \t\n ", None, None, "one", "one two", "aaaa " * 60]
    texts += [sentence(rng, 9000), "x" * 500, "ab" * 300, "a b c 日本語 text"]
    made = [[i * 3 % 97 + 1000, t] for i, t in enumerate(texts)]
    return [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(t or ""), "k", "s", "f", "x", "y", "z") for i, t in made]


def odd_rows(seed: int = 1) -> list[tuple]:
    """As ``rows``, with repeated rows, repeated ids and null ids."""
    held = rows(seed)
    return held + held[:5] + [(held[7][0], *held[8][1:]), (None, *held[9][1:]), (None, *held[9][1:]), (None, *held[10][1:])]


def frame(spark, made, tmp_path=None):
    """A data frame of several partitions, from files if a folder is given."""
    df = spark.createDataFrame(made, DOCS).repartition(4)
    if tmp_path is None:
        return df
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")
