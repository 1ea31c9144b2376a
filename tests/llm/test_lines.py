import random

from pyspark.sql import functions as F

from emendata.llm.common import discard
from emendata.llm.lines import dedup_lines, deduped_documents, prefix_sums
from helpers import AWKWARD, corpus, frame


def brute(texts, min_words):
    """Deleted lines by comparing every pair of positions."""
    split = {i: t.split("\n") for i, t in enumerate(texts) if t is not None}
    order = [(d, p) for d in sorted(split) for p in range(len(split[d]))]
    gone = set()
    for n, (d, p) in enumerate(order):
        best = 0
        for e, q in order[:n]:
            k = 0
            while p + k < len(split[d]) and q + k < len(split[e]) and split[d][p + k] == split[e][q + k]:
                k += 1
            best = max(best, k)
        if best and sum(len(x.split()) for x in split[d][p : p + best]) >= min_words:
            gone |= {(d, p + k) for k in range(best)}
    kept = {d: "\n".join(x for p, x in enumerate(lines) if (d, p) not in gone) for d, lines in split.items()}
    return kept, {d: sum(1 for e, _ in gone if e == d) for d in split}


def check(spark, texts, min_words):
    kept, gone = brute(texts, min_words)
    out = dedup_lines(frame(spark, texts), min_words).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.text == kept.get(r.doc_id)
        assert (r.n_lines, r.n_removed) == ((len(texts[r.doc_id].split("\n")), gone[r.doc_id]) if r.text is not None else (0, 0))


def test_random_lines(spark):
    r = random.Random(8)
    texts = ["\n".join(r.choice(["a b", "c d e", "f", ""]) for _ in range(r.randrange(1, 14))) for _ in range(25)]
    check(spark, texts, 5)


def test_real_and_awkward(spark):
    texts = [r["text"] for r in corpus(60)] + AWKWARD
    check(spark, texts + [texts[3], texts[3] + "\nmore", "\n".join(["x y"] * 40)], 50)


def test_repeated_rows_null_ids_and_documents(spark):
    text = "\n".join(f"line number {i} of the passage that repeats" for i in range(12))
    docs = frame(spark, [text, text + "\nown words", "clean"]).unionByName(frame(spark, [text])).withColumn("spans", F.lit(1))
    out = sorted((r.doc_id, r.n_removed) for r in dedup_lines(docs, 50).collect())
    assert out == [(0, 0), (0, 0), (1, 12), (2, 0)]
    kept = deduped_documents(docs.selectExpr("nullif(doc_id, 0) AS doc_id", "text", "lang", "source", "n_chars", "spans"), 50)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: (text + "\nown words", len(text) + 10), 2: ("clean", 5)}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_runs_of_many_shapes(spark):
    r = random.Random(21)
    pool = ["a b", "c d e", "f", "", "g h i j k l m n", "", "o p"]
    blocks = [[r.choice(pool) for _ in range(r.randrange(1, 9))] for _ in range(4)]
    texts = ["\n".join(line for _ in range(r.randrange(1, 6)) for line in (r.choice(blocks) if r.random() < 0.7 else [f"own {r.random()}"])) for _ in range(40)]
    for min_words in (1, 9):
        check(spark, texts, min_words)


def test_one_long_document_of_equal_lines(spark):
    n = 60_000
    docs = frame(spark, ["\n".join(["x y"] * n), "\n".join(["p q", *["x y"] * 30, "r"])])
    out = {x.doc_id: x for x in dedup_lines(docs, 50).collect()}
    assert (out[0].n_lines, out[0].n_removed, out[0].text) == (n, n - 1, "x y")
    assert (out[1].n_removed, out[1].text) == (30, "p q\nr")


def test_prefix_sums_need_no_join(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("n"))
    out = prefix_sums(rows, [F.col("x")], F.col("n"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    total = 0
    for r in sorted(out.collect(), key=lambda r: r.x):
        assert r._before == total
        total += r.n
    discard(out)
    assert prefix_sums(rows.limit(0), [F.col("x")], F.col("n")).count() == 0


def test_no_join_is_broadcast(spark, monkeypatch):
    from emendata.llm import lines

    plans, write = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    found = lines.later_copies(frame(spark, ["a b c\nd e f\ng", "x\na b c\nd e f", "d e f\ng"]), 3)
    assert found.count() > 0
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not any("BroadcastHashJoin" in p for p in plans)
