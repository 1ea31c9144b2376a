"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled good document is preferred to a labelled bad one. The score is linear in features of the text; its weights
minimise the logistic loss on feature differences of pairs, over all pairs of a good and a bad row that may be learnt.
A document is predicted good if its score lies above the quantile, of all these rows, at which the share of bad labels ends.

The loss of a pair is a smooth function of two scores. So the sum over all pairs needs no pairs: scores are dealt into
cells of width 1, and a cell's Chebyshev moments, of ones and of features, give the sum to some 1e-11 of its size. A step
reads the rows once and groups them by label, cell and degree. Few rows and pairs drawn of them say where the steps
start and how long they are, not where they end: there the slope over all pairs is zero.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import discard, let, stored, words
from emendata.llm.rules import STOP_WORDS, repeated_window_words, symbol_count

#: Labelled rows, half of them good, and pairs drawn of them, by which the steps over all rows are started and scaled.
MOST_LABELLED = 20_000
PAIRS = 100_000
#: Chebyshev degrees of a cell; steps at most.
DEGREES = 10
STEPS = 60
#: Scores of a bucket that the driver sorts for a quantile.
SORTED = 10_000


def features(text: Column) -> dict[str, Column]:
    """Features by name, all finite doubles; null measures as the empty text."""
    body = F.coalesce(text, F.lit(""))
    size = F.length(body)
    share = lambda pattern: (size - F.length(F.regexp_replace(body, pattern, ""))) / (size + 1)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        same = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
        return F.struct(
            F.log1p(n.cast("double")).alias("length"),
            (F.length(F.translate(body, " \t\n\x0b\f\r", "")) / (n + 1)).alias("word_length"),
            (F.size(F.array_distinct(w)) / (n + 1)).alias("distinct"),
            (same / (n + 1)).alias("stutter"),
            (repeated_window_words(w) / (n + 1)).alias("repeated"),
            (F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))) / (n + 1)).alias("stop_words"),
            (F.size(F.filter(w, lambda x: F.length(x) <= 1)) / (n + 1)).alias("single"),
        )

    named = ("length", "word_length", "distinct", "stutter", "repeated", "stop_words", "single")
    bound = let(words(body), of_words)
    plain = {
        "symbols": symbol_count(body) / (size + 1),
        "upper": share("[A-ZÀ-ÖØ-Þ]+"),
        "digits": share("[0-9]+"),
        "exclaims": share("[!?]+"),
        "stops": share("[.,;:]+"),
        "lines": share("\n+"),
        "other": share(r"[\p{L}\p{N}\s.,;:!?]+"),
    }
    out = {k: bound.getField(k) for k in named} | plain
    roots = {f"{k}_root": F.sqrt(out[k]) for k in ("stutter", "repeated", "symbols", "upper", "digits", "exclaims", "single")}
    return {k: v.cast("double") for k, v in (out | roots).items()}


class Ranking(NamedTuple):
    """score = 1 / (1 + exp(-(weights . features - threshold)))"""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    threshold: float

    def score(self) -> Column:
        total = F.lit(-self.threshold)
        for name, weight in zip(self.names, self.weights, strict=True):
            total = total + F.lit(weight) * F.col(name)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def learn(names: tuple[str, ...], x: np.ndarray, y: np.ndarray, seed: int = 3, ridge: float = 1e-3) -> Ranking:
    """Weights by Newton's method; without rows of both labels all weights are 0 and every score is one half."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(names, (0.0,) * len(names), 0.0)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    draw = np.random.default_rng(seed)
    better, worse = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    gap = z[better] - z[worse]
    w = np.zeros(gap.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        step = np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + ridge * np.eye(len(w)), gap.T @ (1 - p) / len(gap) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    threshold = float(np.quantile(raw, len(bad) / len(y)))
    weights = w / spread
    return Ranking(names, tuple(map(float, weights)), threshold + float(mean @ weights))


def exact_sums(rows: DataFrame, by: list[str], n: int, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """Sums by name, of values with their greatest size, the same to the bit in whatever order the ``n`` rows come.

    Values are rounded to a grid on which a double holds their sum, which is finer than 1e-16 of n times the greatest.
    """
    sums = []
    for name, (value, most) in values.items():
        grid = 2.0 ** (52 - np.ceil(np.log2(max(n, 1) * max(most, 1e-200)) + 1e-9))
        sums.append((F.sum(F.rint(value * F.lit(float(grid)))) / F.lit(float(grid))).alias(name))
    return rows.groupBy(*by).agg(*sums)


def slope(rows: DataFrame, n: int, z: list[Column], most: list[float], w: np.ndarray) -> np.ndarray:
    """The slope of the mean loss over all pairs of a good and a bad row."""
    total = sum((F.lit(float(v)) * c for v, c in zip(w, z, strict=True)), F.lit(0.0))
    placed = rows.select("_y", total.alias("_s"), *[c.alias(f"z{k}") for k, c in enumerate(z)])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (F.col("_s") - F.floor("_s")) - 1)))
    placed = placed.select("_y", F.floor("_s").alias("_cell"), angle.alias("_a"), *[f"z{k}" for k in range(len(z))])
    dealt = placed.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in range(DEGREES)]))).withColumn("_t", F.cos(F.col("_m") * F.col("_a")))
    values = {"v": (F.col("_t"), 1.0)} | {f"v{k}": (F.col("_t") * F.col(f"z{k}"), most[k]) for k in range(len(z))}
    got = exact_sums(dealt, ["_y", "_cell", "_m"], n, values).toPandas()
    at = np.cos((np.arange(DEGREES) + 0.5) * np.pi / DEGREES)
    turn = np.cos(np.outer(np.arccos(at), np.arange(DEGREES))) * np.where(np.arange(DEGREES) == 0, 1, 2) / DEGREES
    nodes = {}
    for y, of in got.sort_values(["_y", "_cell", "_m"]).groupby("_y"):
        cells = of["_cell"].to_numpy()[::DEGREES]
        moments = of.iloc[:, 3:].to_numpy(float).reshape(len(cells), DEGREES, -1)
        nodes[y] = (cells[:, None] + (at + 1) / 2).ravel(), np.einsum("im,cmv->civ", turn, moments).reshape(len(cells) * DEGREES, -1)
    (good_at, good), (bad_at, bad) = nodes[1], nodes[0]
    out, of_bad = np.zeros(len(z)), np.zeros(len(bad))
    for i in range(0, len(good), 1000):
        wrong = 1 / (1 + np.exp(np.clip(good_at[i : i + 1000, None] - bad_at[None], -700, 700)))
        out -= (wrong @ bad[:, 0]) @ good[i : i + 1000, 1:]
        of_bad += good[i : i + 1000, 0] @ wrong
    return (out + of_bad @ bad[:, 1:]) / good[:, 0].sum() / bad[:, 0].sum()


def at_rank(rows: DataFrame, rank: int) -> float:
    """The ``rank``-th value of _s from 0, exactly: buckets are counted, and the one that holds it again."""
    while True:
        low, high, n = rows.agg(F.min("_s"), F.max("_s"), F.count("*")).first()
        if low == high:
            return low
        if n <= SORTED:
            return sorted(r["_s"] for r in rows.select("_s").collect())[rank]
        bucket = F.least(F.floor((F.col("_s") - low) / (high - low) * 1000), F.lit(999))
        for r in sorted(rows.groupBy(bucket.alias("b")).count().collect()):
            if rank < r["count"]:
                rows = rows.filter(bucket == r["b"])
                break
            rank -= r["count"]


def first_by_hash(rows: DataFrame, n: int, names: tuple[str, ...]):
    """Half of MOST_LABELLED of the ``n`` rows at most, the first by a hash of their id; none only if there are none.

    Hashes beyond where so many are expected are left aside, as every partition sends the driver its first rows.
    """
    most, key = MOST_LABELLED // 2, F.xxhash64("doc_id")
    near = rows.filter(key < int(-(2**63) + 2**64 * min(1.5 * most / max(n, 1), 0.9999)))
    first = lambda some: some.orderBy(key, "doc_id", *names).limit(most).toPandas()
    found = first(near if 1.5 * most < n else rows)
    return found if len(found) or not n else first(rows)


def learn_all(rows: DataFrame, names: tuple[str, ...], seed: int = 3, ridge: float = 1e-3) -> Ranking:
    """``learn`` over all pairs of the rows (_y, doc_id and features), and the quantile over all of them."""
    found = rows.agg(F.count("*").alias("n"), F.sum(1 - F.col("_y")).alias("bad"), *[f(c).alias(f"{i}{c}") for c in names for i, f in enumerate((F.min, F.max))]).first()
    n, low, high = found["n"], *(np.array([found[f"{i}{c}"] for c in names]) for i in (0, 1))
    some = [first_by_hash(rows.filter(F.col("_y") == k), count, names) for k, count in enumerate((found["bad"] or 0, n - (found["bad"] or 0)))]
    x, y = (np.concatenate([one[c].to_numpy(float) for one in some]) for c in (list(names), "_y"))
    first = learn(names, x, y, seed, ridge)
    if not len(some[0]) or not len(some[1]):
        return first
    mean = np.array(exact_sums(rows, [], n, {c: (F.col(c), max(abs(a), abs(b))) for c, a, b in zip(names, low, high, strict=True)}).first()) / n
    apart = [F.col(c) - float(v) for c, v in zip(names, mean, strict=True)]
    most = np.maximum(high - mean, mean - low)
    spread = np.sqrt(np.array(exact_sums(rows, [], n, {c: (v * v, m * m) for c, v, m in zip(names, apart, most, strict=True)}).first()) / n)
    spread[spread < 1e-9] = 1.0
    z = [v / float(s) for v, s in zip(apart, spread, strict=True)]
    draw, own = np.random.default_rng(seed), (x - mean) / spread
    gap = own[draw.choice(np.flatnonzero(y == 1), PAIRS)] - own[draw.choice(np.flatnonzero(y == 0), PAIRS)]
    w = last = np.array(first.weights) * spread
    size, step = np.inf, None
    for _ in range(STEPS):
        down = slope(rows, n, z, list(most / spread), w) + ridge * w
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        new = np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + ridge * np.eye(len(w)), down)
        if np.linalg.norm(down) > size:  # too far
            step = step / 2
        else:
            last, size, step = w, np.linalg.norm(down), new
            if np.abs(step).max() < 1e-8:
                break
        w = last - step
    else:
        raise ValueError("the weights of the quality ranking do not settle")
    scores = rows.select(sum((F.lit(float(v)) * c for v, c in zip(last, z, strict=True)), F.lit(0.0)).alias("_s"))
    place = found["bad"] / n * (n - 1)
    below = at_rank(scores, int(place))
    threshold = below + (place - int(place)) * (at_rank(scores, min(int(place) + 1, n - 1)) - below)
    weights = last / spread
    return Ranking(names, tuple(map(float, weights)), threshold + float(mean @ weights))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, rest: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (double), predicted (int 0 or 1), and ``rest`` as _rest.

    Only text makes a score; equal texts score alike. The weights come from all rows whose label may be learnt; ids that
    are labelled both ways or null are not learnt from, ids that repeat are learnt from once per row. Null and empty
    texts are scored as texts of no words. Every document is scored. The rows are stored with their features.
    """
    rows = docs.select("doc_id", "text", *([] if rest is None else [rest.alias("_rest")]))
    named = features(F.col("text"))
    names = tuple(f"f_{k}" for k in named)
    carried = ["doc_id"] if rest is None else ["doc_id", "_rest"]
    made = stored(rows.select(*carried, *[v.alias(f"f_{k}") for k, v in named.items()]))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).filter("_y = _top").drop("_top")
    learnt = stored(made.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "_y", *names))
    ranking = learn_all(learnt, names)
    discard(learnt)
    out = made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), ranking.score().alias("score"), *carried[1:]
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = scored(docs, labels, rest).filter("predicted = 1")
    return kept.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns])
