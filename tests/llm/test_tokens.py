import public_tokenizers
from tokenizers import Tokenizer

from emendata.llm.tokens import with_token_counts
from helpers import AWKWARD, corpus, frame, strange

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def counts(spark, texts):
    out = with_token_counts(frame(spark, texts).repartition(2), PATH).collect()
    return {r.doc_id: r for r in out}


def test_counts_equal_the_library(spark):
    texts = [r["text"] for r in corpus(80)] + strange() + AWKWARD + ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endo"]
    got = counts(spark, texts)
    assert [got[i].n_tokens for i in range(len(texts))] == expected(texts)
    assert [got[i].n_bytes for i in range(len(texts))] == [len((x or "").encode()) for x in texts]
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())


def test_empty_table_and_clashing_columns(spark):
    docs = frame(spark, ["one two"]).selectExpr("*", "1 AS N_Tokens", "2 AS over_limit")
    assert with_token_counts(docs, PATH).columns[-3:] == ["n_bytes", "n_tokens", "over_limit"]
    assert with_token_counts(docs, PATH).first().n_tokens == 2
    assert with_token_counts(docs.limit(0), PATH).count() == 0
