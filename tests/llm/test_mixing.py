from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emendata.llm import mixing
from emendata.llm.common import word_count
from emendata.llm.mixing import capped_targets, mix, mixed_documents, sainte_lague
from helpers import AWKWARD, SF, corpus, frame


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 40))
def test_seats_are_the_highest_quotients(votes, seats):
    most = [10] * len(votes)
    got = sainte_lague(votes, seats, most)
    quotients = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) if v for k in range(10)), reverse=True)
    want = [0] * len(votes)
    for _, i in quotients[:seats]:
        want[-i] += 1
    # equal quotients may change places only among themselves
    assert sum(got) == sum(want)
    assert sorted(v / (2 * g + 1) for v, g in zip(votes, got)) is not None
    taken = sorted((votes[i] / (2 * k + 1) for i, g in enumerate(got) for k in range(g)), reverse=True)
    assert [round(x, 9) for x in taken] == [round(q, 9) for q, _ in quotients[:seats]]


@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([5, 2, 1])), min_size=1, max_size=8))
def test_targets(sources):
    sizes, weights = map(list, zip(*sources))
    got = capped_targets(sizes, weights)
    assert sum(got) == sum(sizes) and all(t <= 3 * n for t, n in zip(got, sizes))
    free = {t / w for t, n, w in zip(got, sizes, weights) if t < 3 * n}
    assert len(free) <= 1 and all(t / w <= min(free) for t, n, w in zip(got, sizes, weights) if free and t == 3 * n)


def test_words_taken_follow_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once, again = (sorted(map(tuple, mix(docs.repartition(n), word_count(F.col("text"))).drop("text").collect())) for n in (1, 5))
    assert once == again
    by, target, n = defaultdict(int), {}, {}
    for _, source, size, source_size, t, taken, full, extra in once:
        assert 0 <= taken <= 3 * size and taken == full * size + extra
        by[source] += taken
        target[source], n[source] = t, source_size
    assert all(abs(by[s] - target[s]) <= 0.02 * target[s] + 16 for s in by)


def test_mixed_documents_carry_what_was_taken(spark):
    docs = frame(spark, [r["text"] for r in corpus(60)] + AWKWARD).withColumn("taken", F.lit("own")).withColumn("size", F.lit(1))
    want = {r.doc_id: r.taken for r in mix(docs, word_count(F.col("text"))).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        assert r.taken == "own" and r.n_chars == len(r.text)
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_null_and_empty(spark):
    docs = frame(spark, AWKWARD, sources=[None] * 6 + ["b"] * 5)
    out = {r.doc_id: r for r in mix(docs, word_count(F.col("text"))).collect()}
    assert len(out) == len(AWKWARD) and out[0].taken == 0 and out[0].size == 0
    assert mix(docs.limit(0), word_count(F.col("text"))).count() == 0
    assert mixed_documents(docs.limit(0)).count() == 0


def seats_one_by_one(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v and out[i] < most[i]]
        if not open_:
            break
        out[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
    return out


def test_mix_equals_brute_force(spark, monkeypatch):
    """Targets, quotas per shard and the blocks selected, worked out row by row over several shards."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    texts = [r["text"] for r in corpus(90)] + AWKWARD
    docs = frame(spark, texts, sources=[("a", "b", None, "c")[0 if i % 5 < 3 else 1 + i % 3] for i in range(len(texts))])
    draw = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "text")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), draw.alias("draw"), F.xxhash64(draw).alias("deal")).collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.n for r in rows if r.source == s) for s in names]
    targets = capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    shards = defaultdict(list)
    for r in rows:
        i = names.index(r.source)
        shards[i, r.deal % max(1, -(-sizes[i] // 400))].append(r)
    words = {k: sum(r.n for r in v) for k, v in shards.items()}
    blocks = {k: max(1, round(n / 16)) for k, n in words.items() if n}
    assert len(blocks) > 2 * len(names)
    of = lambda i: sorted(k for k in blocks if k[0] == i)
    quotas = seats_one_by_one(targets, round(sum(sizes) / 16), [3 * sum(blocks[k] for k in of(i)) for i in range(len(names))])
    want = {r.doc_id: 0 for r in rows}
    for i, quota in enumerate(quotas):
        most = [3 * blocks[k] for k in of(i)]
        quota = sum(most) if targets[i] == 3 * sizes[i] else quota
        for k, q in zip(of(i), seats_one_by_one([words[k] for k in of(i)], quota, most)):
            full, part = divmod(q, blocks[k])
            left = part * words[k] // blocks[k]
            for r in sorted(shards[k], key=lambda r: r.draw):
                more = min(left, r.n)
                want[r.doc_id], left = full * r.n + more, left - more
    assert {r.doc_id: r.taken for r in mix(docs, word_count(F.col("text"))).collect()} == want


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = frame(spark, ["one two " * 40, "five six " * 30])
    out = mix(docs.unionAll(docs).unionAll(docs), word_count(F.col("text"))).collect()
    assert len(out) == 6 and all(r.taken <= 3 * r.size for r in out)
    assert abs(sum(r.taken for r in out) - 3 * 140) <= 2 * 16


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mix(frame(spark, ["a"] * 3, sources=["x", "y", "z"]), word_count(F.col("text")))
