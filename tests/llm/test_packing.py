import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emendata.llm import queries
from emendata.llm.packing import Encoder, pack
from helpers import AWKWARD, corpus, frame, strange

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    texts = [r["text"] for r in corpus(60)] + strange() + AWKWARD
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    pieces = pack(frame(spark, texts).repartition(3), PATH, window=256).collect()
    got, used = {i: {} for i in want}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0 and p.doc_tokens == len(want[p.doc_id])
        assert p.cut_before == (p.start > 0) and p.cut_after == (p.start + p.length < p.doc_tokens)
        got[p.doc_id][p.start] = ids
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, ids in want.items():
        assert sum((got[i][s] for s in sorted(got[i])), []) == ids
    assert sorted(used) == list(range(len(used)))
    for s, spans in used.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or s == max(used)


def test_ids_of_the_library():
    r = random.Random(12)
    points = [*range(0x20, 0x250), 0x130, 0x131, 0x49, 0x69, 0x3A3, 0x3C2, 0x1E9E, 0x4E2D, 0x5B57, 0x1F44D, 0x307, 0x301, 0xFB01, 0x2160]
    texts = ["İstanbul ve İzmir", "İ", "aİb İİ", *("x" + chr(c) + "Y" for c in range(0x21, 0x250))]
    for _ in range(6000):
        texts.append("".join(chr(r.choice(points)) if r.random() < 0.75 else " " for _ in range(r.randrange(1, 30))))
    for _ in range(3000):
        low = r.choice([0x400, 0x1E00, 0x3040, 0xAC00, 0x10400, 0x20000])
        texts.append("".join(chr(low + r.randrange(0x80)) if r.random() < 0.6 else r.choice(" İIabÄ.") for _ in range(r.randrange(1, 20))))
    with open(PATH, encoding="utf-8") as f:
        engine = Encoder(f.read())
    ids, counts = engine.encode(pa.array(texts))
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    assert [t for i, t in enumerate(texts) if ids[bounds[i] : bounds[i + 1]].tolist() != want[i]] == []


def test_query_and_its_crc(spark, tmp_path):
    texts = [r["text"] for r in corpus(30)] + ["İstanbul", None, "", "twice", "word " * 9000]
    frame(spark, texts).withColumn("ids", F.lit("clash")).withColumn("start", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    seen = {i: 0 for i in want}
    for p in queries.op4_packing(spark, str(tmp_path)).collect():
        part = want[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == p.length
        seen[p.doc_id] += p.length
    assert seen == {i: len(x) for i, x in want.items()}


def test_null_ids_and_repeated_rows(spark):
    docs = frame(spark, ["a b", "a b"]).unionByName(frame(spark, ["a b"])).selectExpr("nullif(doc_id, 1) AS doc_id", "text")
    pieces = pack(docs, PATH).collect()
    assert sorted((p.doc_id is None, p.length) for p in pieces) == [(False, 3), (False, 3), (True, 3)]


def test_empty_table(spark):
    assert pack(frame(spark, ["a"]).limit(0), PATH).count() == 0
