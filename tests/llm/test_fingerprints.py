import hashlib

from emendata.llm.fingerprints import chunks, containment, edited, fingerprints, read
from helpers import AWKWARD, corpus, frame, strange


def test_neighbours_and_contract(spark):
    texts = [r["text"] for r in corpus(70)] + AWKWARD + strange(n=30)
    docs = frame(spark, texts).selectExpr("*", "1 AS fingerprint")
    out = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(out) == len(texts)
    alone = dict(enumerate(chunks([(t or "").encode() for t in texts])))
    for i, t in enumerate(texts):
        t, other = t or "", texts[i - 1] or ""
        new = edited(t, other)
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert read(r.fingerprint) == {d.hex(): n for d, n in alone[i].items()}
        assert read(r.edited_fingerprint) == {d.hex(): n for d, n in chunks([new.encode()])[0].items()}
        assert r.near_next == containment(read(r.fingerprint), read(out[(i - 1) % len(texts)].fingerprint))
        assert r.near_edited == containment(read(r.fingerprint), read(r.edited_fingerprint))


def test_shift_resistance():
    text = corpus(1)[0]["text"]
    a, b = chunks([text.encode(), ("A few words in front. " + text).encode()])
    assert containment(a, b) > 0.8 and containment(a, a) == 1


def test_few_rows(spark):
    assert fingerprints(frame(spark, ["only one"]).limit(0)).count() == 0
    one = fingerprints(frame(spark, ["only one"])).first()
    assert one.near_next == 1.0
    same = fingerprints(frame(spark, ["x" * 300] * 3).selectExpr("CAST(NULL AS long) AS doc_id", "text")).collect()
    assert len(same) == 3 and all(r.near_next == 1.0 and r.doc_id is None for r in same)
