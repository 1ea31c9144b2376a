import math

import numpy as np
from pyspark.sql import functions as F

from emendata.llm import quality
from emendata.llm.quality import good_documents, held_out, scored
from helpers import AWKWARD, frame


def tables(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    out = scored(docs, labels)
    assert out.count() == docs.count()
    own = out.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).cast("int").alias("x"))
    assert own.agg(F.avg("x")).first()[0] > 0.97


def test_labels_held_out_do_not_matter(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    hidden = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in scored(docs, x).collect()} for x in (labels, hidden.unionByName(hidden)))
    assert a.keys() == b.keys()
    once = {r.doc_id: r.score for r in scored(docs, labels.unionByName(labels)).collect()}
    assert once == b == a


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD).selectExpr("nullif(doc_id, 3) AS doc_id", "text", "lang", "source", "n_chars", "1 AS score", "2 AS f_length")
    labels = spark.createDataFrame([(0, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = scored(docs, labels).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = scored(docs, labels.limit(0)).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in none)
    assert scored(docs.limit(0), labels).count() == 0
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns


def test_weights_minimise_the_pairwise_loss(monkeypatch):
    """The loss over the drawn pairs, summed in loops, rises in every direction from the weights learnt."""
    monkeypatch.setattr(quality, "PAIRS", 400)
    draw = np.random.default_rng(1)
    y = (draw.random(60) < 0.6).astype(int)
    x = draw.normal(size=(60, 3)) * [1, 10, 0.1] + y[:, None] * [0.5, 0, 0.1] + 7
    found = quality.learn(("a", "b", "c"), x, y)
    mean, spread = x.mean(0), x.std(0)
    pick = np.random.default_rng(3)
    pairs = list(zip(pick.choice(np.flatnonzero(y == 1), 400).tolist(), pick.choice(np.flatnonzero(y == 0), 400).tolist(), strict=True))

    def loss(w):
        total = 0.0
        for good, bad in pairs:
            gap = sum(w[k] * (x[good][k] - x[bad][k]) / spread[k] for k in range(3))
            total += math.log1p(math.exp(-gap))
        return total / len(pairs) + 1e-3 / 2 * sum(v * v for v in w)

    best = [v * s for v, s in zip(found.weights, spread, strict=True)]
    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert loss([v + step * (j == k) for j, v in enumerate(best)]) > loss(best)
    # The threshold leaves as many rows below it as are labelled bad.
    below = sum(float(r @ np.array(found.weights)) < found.threshold for r in x)
    assert abs(below - int((y == 0).sum())) <= 1


def test_features_by_hand(spark):
    texts = ["The the cat cat cat sat!", "", "A b 12 ##\n\nÉté x.", "one two three four five one two three four five"]
    rows = frame(spark, texts).select("doc_id", *[v.alias(k) for k, v in quality.features(F.col("text")).items()]).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        w, n = text.split(), len(text.split())
        windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
        twice = {j for i, g in enumerate(windows) if windows.count(g) > 1 for j in range(i, i + 5)}
        want = {
            "length": math.log1p(n),
            "word_length": sum(map(len, w)) / (n + 1),
            "distinct": len(set(w)) / (n + 1),
            "stutter": sum(a == b for a, b in zip(w, w[1:])) / (n + 1),
            "repeated": len(twice) / (n + 1),
            "single": sum(len(a) <= 1 for a in w) / (n + 1),
            "symbols": sum(c in "#*$%&|<>" for c in text) / (len(text) + 1),
            "digits": sum(c in "0123456789" for c in text) / (len(text) + 1),
            "lines": text.count("\n") / (len(text) + 1),
        }
        assert all(math.isclose(r[k], v, abs_tol=1e-12) for k, v in want.items())
        assert math.isclose(r["single_root"], math.sqrt(want["single"]), abs_tol=1e-12)


def test_repeated_rows_are_scored_alike(spark):
    docs = frame(spark, ["good words in a line", "good words in a line", "bad bad bad"])
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    out = scored(docs.unionAll(docs), labels).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id < 2}) == 1


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """With few rows and pairs to start from, weights and threshold are those of all pairs and all rows."""
    monkeypatch.setattr(quality, "MOST_LABELLED", 40)
    monkeypatch.setattr(quality, "PAIRS", 400)
    monkeypatch.setattr(quality, "SORTED", 20)
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    rows = docs.select("doc_id", "text").join(labels.filter(~held_out(F.col("doc_id"))), "doc_id")
    got = rows.select("quality", *[v.alias(f"f_{k}") for k, v in quality.features(F.col("text")).items()]).toPandas()
    x, y = got.iloc[:, 1:].to_numpy(float), got["quality"].to_numpy()
    seen, real = [], quality.Ranking.score
    monkeypatch.setattr(quality.Ranking, "score", lambda self: seen.append(self) or real(self))
    assert scored(docs, labels).count() == docs.count()
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0))
    w = np.array(seen[0].weights) * np.where(x.std(0) < 1e-9, 1, x.std(0))
    gap = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    down = -gap.T @ (1 / (1 + np.exp(gap @ w))) / len(gap) + 1e-3 * w
    assert len(y) > 100 and np.abs(down).max() < 1e-8
    raw = x @ np.array(seen[0].weights)
    assert math.isclose(seen[0].threshold, np.quantile(raw, (y == 0).mean()), abs_tol=1e-9)
