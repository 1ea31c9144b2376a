import contextlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from emendata.llm import common
from emendata.llm.neardup import near_duplicates
from emendata.llm.quality import scored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert list(names) == ["quality_classifier", "line_dedup", "near_duplicates", "source_mix", "packing"]
    kept = [docs]
    for f in functions:
        kept.append(f(spark, kept[-1], SF).cache())
    for x in kept[:-1]:
        assert x.columns == docs.columns
    before, good, lines, single, mixed, pieces = (x.toPandas() for x in kept)
    bad = {r.doc_id for r in scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    assert bad and set(good.doc_id) == set(before.doc_id) - bad
    assert set(lines.doc_id) <= set(good.doc_id) and (lines.text.str.len() == lines.n_chars).all()
    assert set(single.doc_id) == {r.doc_id for r in near_duplicates(kept[2]).filter("kept").collect()}
    assert near_duplicates(kept[3]).filter("NOT kept").count() == 0
    assert set(mixed.doc_id) <= set(single.doc_id)
    # What is packed is what was mixed, id for id.
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in mixed.text)
    assert want == pieces.length.sum() == sum(len(np.frombuffer(x, "<u4")) for x in pieces.ids)
    assert (pieces.groupby("sequence_id").length.sum() <= 4096).all()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_steps_give_memory_back(spark, monkeypatch):
    """Each stored step has the driver's JVM return freed memory, and the call is one that this JVM knows."""
    seen, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda session: seen.append(trim(session)))
    monkeypatch.setattr(common.contextlib, "suppress", lambda *_: contextlib.nullcontext())
    common.discard(common.stored(spark.range(3)))
    assert common.durable(spark.range(3)).count() == 3
    common.release(spark)
    assert len(seen) == 3
