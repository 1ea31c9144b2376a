"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets are capped shares of all words. Blocks of equal size are dealt to sources by highest quotients, then each
source's blocks to its shards in the same way. A shard lines its documents up in a seeded order; the line, cut into
blocks, is taken whole as often as its quota allows and the first blocks of the seeded order once more.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emendata.llm.common import GAP, WORD, durable, word_count

BLOCK = 16
SHARD_WORDS = 100_000
#: Shards over all sources are at most this many and one more for each source, whatever the input.
MOST_SHARDS = 32_768
#: Sources whose sizes the driver may hold; beyond it the operator refuses rather than guesses.
MOST_SOURCES = 1_000_000


def capped_targets(sizes: list[int], weights: list[int], times: int = 3) -> list[Fraction]:
    """Shares of the total by weight, none above ``times`` its size; what is cut off is shared again by weight."""
    left, open_ = Fraction(sum(sizes)), {i for i, n in enumerate(sizes) if n}
    out = [Fraction(0)] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > times * sizes[i] * weight}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            return out
        for i in full:
            out[i] = Fraction(times * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def sainte_lague(votes: list, seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients vote / (2 k + 1), at most ``most`` each; ties go to the earlier party.

    Starts from the rounded shares, which lie on the same order of quotients, and walks it up or down; so the
    number of steps follows the number of parties, not of seats.
    """
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    out = [min(m, int(Fraction(v) * seats / total + Fraction(1, 2))) for v, m in zip(votes, most, strict=True)]
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v))
    over = sum(out) - seats
    if over > 0:
        heap = [(Fraction(votes[i]) / (2 * k - 1), -i) for i, k in enumerate(out) if k]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (Fraction(votes[-i]) / (2 * out[-i] - 1), i))
    elif over < 0:
        heap = [(-Fraction(v) / (2 * out[i] + 1), i) for i, v in enumerate(votes) if v and out[i] < most[i]]
        heapq.heapify(heap)
        for _ in range(-over):
            _, i = heapq.heappop(heap)
            out[i] += 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


def _key(row) -> tuple:
    return (row is None, row or "")


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (5, 2, 1),
    times: int = 3,
    seed: int = 17,
    block: int = BLOCK,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    rest: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, text, size, source_size, target, taken, full, extra (longs, target a double).

    ``size`` counts a document's words. Sources by code point, null last, weigh ``weights`` in turn. taken is how
    many words the mix takes from the document, repeats counted: never more than ``times`` its size. The words
    taken are, ``full`` times, the whole document and once more its first ``extra`` words. ``rest`` is carried along
    as the column _rest.

    Null texts have size 0 and nothing is taken from them; rows that repeat are documents of their own; columns
    other than the three named are not read. Order within a shard follows a seeded hash of id and text, then the
    id and a hash of the text, so reruns agree. The driver holds one number per source (MOST_SOURCES at most, else an error) and per shard.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{text}`").alias("text"),
        *([] if rest is None else [rest.alias("_rest")]),
    )
    rows = rows.select("*", size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("_draw"), F.xxhash64(F.lit(seed + 1), "text").alias("_tie"))
    narrow = durable(rows.select("source", "size", "_draw"))
    found = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: _key(r.source))
    sizes = [r.n for r in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], times)
    per_shard = max(SHARD_WORDS, -(-sum(sizes) // MOST_SHARDS))
    shards = [max(1, -(-n // per_shard)) for n in sizes]
    sources = spark.createDataFrame(
        [(r.source, i, n, float(t), s) for i, (r, n, t, s) in enumerate(zip(found, sizes, targets, shards, strict=True))],
        "source string, _s int, source_size long, target double, _shards int",
    )

    def sharded(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
        return joined.drop("_source").withColumn("_shard", F.pmod(F.xxhash64("_draw"), F.col("_shards")).cast("int"))

    parts = sharded(narrow).groupBy("_s", "_shard").agg(F.sum("size").alias("n")).collect()
    by_source: dict[int, list] = {}
    for r in sorted(parts, key=lambda r: (r._s, r._shard)):
        by_source.setdefault(r._s, []).append(r)
    seats = round(sum(sizes) / block)
    blocks = {(r._s, r._shard): max(1, round(r.n / block)) for r in parts if r.n}
    room = [times * sum(blocks.get((i, r._shard), 0) for r in by_source.get(i, [])) for i in range(len(sizes))]
    quotas = []
    for i, quota in enumerate(sainte_lague(targets, seats, room)):
        own = [r for r in by_source.get(i, []) if r.n]
        most = [times * blocks[i, r._shard] for r in own]
        if targets[i] == times * sizes[i]:
            quota = sum(most)  # a source at its cap is taken whole
        for r, q in zip(own, sainte_lague([r.n for r in own], quota, most), strict=True):
            n = blocks[i, r._shard]
            quotas.append((i, r._shard, q // n, (q % n) * r.n // n))
    plan = spark.createDataFrame(quotas, "_s int, _shard int, full long, _edge long")
    line = Window.partitionBy("_s", "_shard").orderBy("_draw", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded(rows).withColumn("_end", F.sum("size").over(line))
    placed = placed.join(F.broadcast(plan), ["_s", "_shard"], "left").fillna(0, ["full", "_edge"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_edge") - F.col("_end") + F.col("size")))
    return placed.select(
        "doc_id",
        "source",
        "text",
        "size",
        "source_size",
        "target",
        (F.col("full") * F.col("size") + extra).cast("long").alias("taken"),
        F.col("full").cast("long").alias("full"),
        extra.cast("long").alias("extra"),
        *([] if rest is None else ["_rest"]),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a document once for each time it is taken.

    A document that is taken in part gives one more row with its first words up to that part, spacing kept.
    n_chars, where it is a column, is counted again. Documents without words take no place in the mix and go.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(1).alias("_"))
    taken = mix(docs, word_count(F.col("text")), rest=rest, **options)
    # Words with the space before each, so that a joined part is the text as it was.
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(GAP.replace("+", "*") + WORD), F.lit(0)), 1, F.col("extra").cast("int")), "")
    whole = F.col("full").cast("int") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0)
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    pieces = F.concat(F.array_repeat("text", whole), F.when(cut, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = taken.filter("taken > 0").select("doc_id", "source", F.explode(pieces).alias("text"), "_rest")
    made = {c: F.col(c) for c in ("doc_id", "source", "text")} | {"n_chars": F.length("text").cast("long")}
    return out.select(*[made.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns])
