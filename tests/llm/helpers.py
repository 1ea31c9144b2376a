"""Small documents with the awkward cases every operator has to take."""

import random

import pyarrow.parquet as pq
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def rows(texts, sources=None):
    return [(i, t, "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts, sources=None):
    return spark.createDataFrame(rows(texts, sources), SCHEMA)


def corpus(n=None):
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return t[:n]


def strange(seed=5, n=150):
    r = random.Random(seed)
    pool = list("abcDE éÉßü'\"!?.,0123 \n\t    ́​中文字👍\x1c\x85\x01#$|") + ["'s", "'ll", "  ", " the", "<|endoftext|>"]
    return ["".join(r.choice(pool) for _ in range(r.randrange(0, 60))) for _ in range(n)]


AWKWARD = [None, "", " ", "\n", "\n\n\n", "a", "word " * 30_000, "x" * 20_000, "same text here", "same text here", "tab\tand\x0bmore\r\n"]
