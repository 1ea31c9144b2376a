"""Line dedup: a suffix array over line identifiers by distributed prefix doubling, later copies of repeated runs deleted.

Only lines that occur twice can be part of a repeated run; between other lines they form stretches, and a suffix goes
from a line to the end of its stretch. Ranks start as the sort order of the identifiers. Each round sorts the pairs
(rank, rank of the suffix moved by 2^k lines) inside their buckets and so doubles the lines that the ranks order by.
A bucket is closed when it holds one suffix, when its suffixes end, or when they agree in ``min_words`` words: the
order beyond is not needed to tell what is repeated. Neighbours of the array get their longest common prefix from the
ranks of the rounds, from the longest step to the shortest. Where it holds ``min_words`` words the neighbours are in
one LCP interval; the first place of an interval stays, and at the others the run of ``min_words`` words is a later copy.

That finds each repeated run but for the lines that follow its last ``min_words`` words. The same array over the lines
read backwards finds the runs that end in them, and together they are all lines of all maximal repeated runs: a line of
such a run lies in the shortest run of ``min_words`` words from its start, or ends one that lies inside it.

Every step is a join or a sum over rows (position, rank); no array holds more than one document's lines.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emendata.llm.common import discard, joined_by_shuffle, joined_by_sort, let, release, row_key, stored, word_count

MIN_WORDS = 50
BEFORE = (Window.unboundedPreceding, -1)
#: Added to the ranks of suffixes that are read backwards.
BACKWARDS = 1 << 61
#: Steps of the common prefixes that are taken in one job.
LEVELS = 3


def prefix_sums(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """``rows``, which are read twice, with _before, the sum of ``value`` over all rows that stand before in ``order``.

    Rows are dealt by range, so that no key and no prefix of the order has to fit one task; the sums of the ranges, one
    number per partition, are summed up by the driver and stand in the plan, which so needs no join for them.
    """
    dealt = rows.withColumn("_v", value.cast("long")).repartitionByRange(*order)
    dealt = stored(dealt.withColumn("_p", F.spark_partition_id()))
    totals = {r["_p"]: r["_t"] for r in dealt.groupBy("_p").agg(F.sum("_v").alias("_t")).collect()}
    sums = accumulate((totals.get(p) or 0 for p in range(max(totals, default=0))), initial=0)
    bases = F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>")  # a constant to the optimizer
    within = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(*BEFORE))
    out = dealt.withColumn("_before", F.get(bases, F.col("_p")) + F.coalesce(within, F.lit(0))).drop("_p", "_v")
    out.stored_at = dealt.stored_at  # until discarded
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (key of the document), pos, a, b (identifier of the line), w (its words), for all lines."""
    line = lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), word_count(x).cast("int").alias("w"))
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.filter("text IS NOT NULL").select("doc_id", key.alias("_k"), F.transform(F.split("text", "\n", -1), line).alias("_l"))
    return rows.select("doc_id", F.col("_k.a").alias("k1"), F.col("_k.b").alias("k2"), F.posexplode("_l").alias("pos", "_l")).select("doc_id", "k1", "k2", "pos", "_l.*")


def repeated_lines(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The lines that occur twice, in stretches of ``min_words`` words or more; and base, k1, k2 of their documents.

    Lines: g (place: lines are numbered through by doc_id, null last, then key, then position), base (place of the
    document's first line), rank (of the identifier), w, low and high (g of the stretch's ends), v (words before it in
    the stretch), total (words of the stretch). Documents that repeat are one.
    """
    counts = stored(lines.groupBy("a", "b").agg(F.count("*").alias("_c")).filter("_c > 1"))
    ranks = prefix_sums(counts, [F.col("a"), F.col("b")], F.col("_c"))
    own = ranks.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("_before").alias("rank"))
    found = lines.join(joined_by_sort(own), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    found = found.select("doc_id", "k1", "k2", "pos", "w", "rank").dropDuplicates(["k1", "k2", "pos"])
    # Stretches are the islands of positions without a gap.
    order = Window.partitionBy("k1", "k2").orderBy("pos")
    found = found.withColumn("_s", F.col("pos") - F.row_number().over(order))
    stretch = Window.partitionBy("k1", "k2", "_s")
    found = found.select(
        "doc_id", "k1", "k2", "pos", "w", "rank",
        F.min("pos").over(stretch).alias("low"),
        F.max("pos").over(stretch).alias("high"),
        F.sum("w").over(stretch).alias("total"),
        F.coalesce(F.sum("w").over(stretch.orderBy("pos").rowsBetween(*BEFORE)), F.lit(0)).alias("v"),
    ).filter(F.col("total") >= min_words)
    found = stored(found)
    discard(counts, ranks)
    docs = stored(found.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), (F.max("pos") + 1).alias("_n")))
    bases = prefix_sums(docs, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2")], F.col("_n"))
    own = bases.select(F.col("_before").alias("base"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    placed = found.join(joined_by_sort(own), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    at = lambda c: (F.col("base") + F.col(c)).alias
    placed = stored(placed.select(at("pos")("g"), "base", "rank", "w", at("low")("low"), at("high")("high"), "v", "total"))
    discard(found, docs)
    return placed, bases


def suffixes(lines: DataFrame, min_words: int) -> DataFrame:
    """The state before the first round: s, g, base, end, m, rank, done, open; stored.

    s counts lines in reading direction, from 0 forwards and below 0 backwards, and ranks of the two directions have
    nothing in common, so both arrays are built at once. end is the s of the stretch's last line, m how many lines from
    here hold ``min_words`` words (null: the stretch has not so many), done whether the ordered lines do.
    """
    forwards = lines.select(F.col("g").alias("s"), "g", "base", F.col("high").alias("end"), "v", "w", "rank")
    v = F.col("total") - F.col("v") - F.col("w")
    backwards = lines.select((-1 - F.col("g")).alias("s"), "g", "base", (-1 - F.col("low")).alias("end"), v.alias("v"), "w", (F.col("rank") + BACKWARDS).alias("rank"))
    # The line that holds the last of the words is the last with fewer than min_words words before it.
    ahead = Window.partitionBy("end").orderBy("v").rangeBetween(0, min_words - 1)
    last, held = F.max("s").over(ahead), F.max(F.col("v") + F.col("w")).over(ahead)
    rows = forwards.unionByName(backwards).withColumn("m", F.when(held - F.col("v") >= min_words, last - F.col("s") + 1))
    done = F.coalesce(F.col("m") <= 1, F.lit(False))
    return stored(rows.select("s", "g", "base", "end", "m", "rank", done.alias("done"), (~done).alias("open")))


def doubled(state: DataFrame, step: int) -> DataFrame:
    """The state after ordering by twice ``step`` lines."""
    second = state.select(F.col("s").alias("_s"), F.col("rank").alias("_r"), F.col("done").alias("_d"))
    ahead = (F.col("s") + step == F.col("_s")) & (F.col("s") + step <= F.col("end"))
    both = state.filter("open").join(joined_by_sort(second), ahead, "left").withColumn("_r", F.coalesce("_r", F.lit(-1))).drop("_s")
    both = stored(both)
    pairs = prefix_sums(both.groupBy("rank", "_r").agg(F.count("*").alias("_c")), [F.col("rank"), F.col("_r")], F.col("_c"))
    first = pairs.groupBy(F.col("rank").alias("_of")).agg(F.min("_before").alias("_first"))
    new = pairs.join(joined_by_sort(first), F.col("rank") == F.col("_of"))
    new = new.select(F.col("rank").alias("_rank"), F.col("_r").alias("_second"), (F.col("rank") + F.col("_before") - F.col("_first")).alias("_new"), "_c")
    moved = both.join(joined_by_sort(new), (F.col("rank") == F.col("_rank")) & (F.col("_r") == F.col("_second")))
    done = F.coalesce(F.col("_d"), F.lit(False)) | F.coalesce(F.col("m") <= 2 * step, F.lit(False))
    moved = moved.select("s", "g", "base", "end", "m", F.col("_new").alias("rank"), done.alias("done"), (~done & (F.col("_c") > 1) & (F.col("_r") >= 0)).alias("open"))
    out = stored(state.filter("NOT open").unionByName(moved))
    discard(both, pairs)
    return out


def rounds(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """The states of all rounds: in the last one no bucket is open."""
    states = [suffixes(lines, min_words)]
    while not states[-1].filter("open").isEmpty():
        states.append(doubled(states[-1], 1 << (len(states) - 1)))
    return states


def intervals(states: list[DataFrame]) -> DataFrame:
    """rank and interval (_before + _cut): the LCP intervals of ``min_words`` words over the buckets of the suffix array."""
    buckets = states[-1].filter("m IS NOT NULL").groupBy("rank").agg(F.min(F.struct("s", "m")).alias("_x")).select("rank", "_x.*")
    numbered = prefix_sums(buckets, [F.col("rank")], F.lit(1))
    placed = numbered.withColumnRenamed("_before", "i")
    left = placed.select(F.col("s").alias("p"), (F.col("i") + 1).alias("_i"))
    pairs = placed.join(joined_by_sort(left), F.col("i") == F.col("_i")).select("i", "p", F.col("s").alias("q"), "m", F.lit(0).alias("lcp"), F.lit(False).alias("same"))
    held = None
    for k in reversed(range(len(states))):
        one = states[k].select(F.col("s").alias("_s1"), F.col("rank").alias("_r1"), "done")
        two = states[k].select(F.col("s").alias("_s2"), F.col("rank").alias("_r2"))
        short = ~F.col("same") & (F.col("lcp") < F.col("m"))
        met = pairs.join(joined_by_sort(one), F.when(short, F.col("p") + F.col("lcp")) == F.col("_s1"), "left")
        met = met.join(joined_by_sort(two), F.when(short, F.col("q") + F.col("lcp")) == F.col("_s2"), "left")
        equal = F.coalesce(F.col("_r1") == F.col("_r2"), F.lit(False))
        pairs = met.select("i", "p", "q", "m", (F.col("lcp") + F.when(equal, 1 << k).otherwise(0)).alias("lcp"), (F.col("same") | (equal & F.col("done"))).alias("same"))
        if k % LEVELS == 0:
            before, held = held, stored(pairs)
            pairs = held
            if before is not None:
                discard(before)
    joined = pairs.filter("same OR lcp >= m").select(F.col("i").alias("_j"), F.lit(0).alias("_cut"))
    cut = placed.join(joined_by_sort(joined), F.col("i") == F.col("_j"), "left").select("i", "rank", F.coalesce("_cut", F.lit(1)).alias("_cut"))
    found = prefix_sums(cut, [F.col("i")], F.col("_cut"))
    discard(numbered, pairs)
    return found


def copies(lines: DataFrame, min_words: int) -> DataFrame:
    """base, from, to (places, to excluded): the runs of ``min_words`` words at all but the first place of an interval."""
    states = rounds(lines, min_words)
    found = intervals(states)
    own = found.select(F.col("rank").alias("_rank"), (F.col("_before") + F.col("_cut")).alias("interval"))
    heads = states[-1].filter("m IS NOT NULL").select("s", "g", "base", "m", "rank")
    heads = stored(heads.join(joined_by_sort(own), F.col("rank") == F.col("_rank")).select("s", "g", "base", "m", "interval"))
    first = heads.groupBy(F.col("interval").alias("_of")).agg(F.min("g").alias("_first"), F.max("g").alias("_last")).filter("_first < _last")
    later = heads.join(joined_by_sort(first), F.col("interval") == F.col("_of")).filter(F.col("g") > F.col("_first"))
    begin = F.when(F.col("s") < 0, F.col("g") - F.col("m") + 1).otherwise(F.col("g"))
    out = stored(later.select("base", begin.alias("from"), (begin + F.col("m")).alias("to")))
    discard(heads, found, *states)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_key and spans: the disjoint ranges of lines (array of structs from, to) to delete from a document; stored."""
    every = stored(line_table(docs))
    lines, bases = repeated_lines(every, min_words)
    discard(every)
    release(docs.sparkSession)
    runs = copies(lines, min_words)
    earlier = Window.partitionBy("base").orderBy("from", "to").rowsBetween(*BEFORE)
    apart = F.col("from") > F.coalesce(F.max("to").over(earlier), F.lit(-1))
    upto = Window.partitionBy("base").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = runs.withColumn("_apart", apart.cast("int")).withColumn("_span", F.sum("_apart").over(upto))
    spans = spans.groupBy("base", "_span").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    span = F.struct((F.col("from") - F.col("base")).cast("int").alias("from"), (F.col("to") - F.col("base")).cast("int").alias("to"))
    spans = spans.groupBy("base").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    out = bases.join(joined_by_sort(spans), F.col("_before") == F.col("base")).select(F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")).alias("_key"), "spans")
    out = stored(out)
    discard(lines, bases, runs)
    release(docs.sparkSession)
    return out


def without(lines: Column, spans: Column) -> Column:
    """The lines outside of the spans: the slices between them."""
    between = F.transform(spans, lambda x, i: F.slice(lines, _reached(spans, i) + 1, x["from"] - _reached(spans, i)))
    end = F.element_at(spans, -1)["to"]
    return F.flatten(F.concat(between, F.array(F.slice(lines, end + 1, F.size(lines)))))


def _reached(spans: Column, i: Column) -> Column:
    return F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["to"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, rest: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (less the deleted lines), n_lines, n_removed (longs), and ``rest`` as _rest.

    Deleted is every line of a run of lines with ``min_words`` words (at least 1) or more whose equal starts at an
    earlier place; places go by doc_id (null last), then line. So of every such run the first copy stays. Runs do not
    cross documents; lines are compared as they are. Rows equal in doc_id and text are one document and are treated
    alike. Null texts have no lines and stay null; empty lines count as lines and never make a run of words by
    themselves. A document of which every line is deleted is left with an empty text. The lines of one text have to
    fit an array (2^31 - 1).
    """
    if min_words < 1:
        raise ValueError("a run has one word at least")
    rows = docs.select("doc_id", "text", *([] if rest is None else [rest.alias("_rest")]))
    found = later_copies(docs.select("doc_id", "text"), min_words)
    rows = rows.withColumn("_k", row_key(F.col("doc_id"), F.col("text")))
    joined = rows.join(joined_by_shuffle(found), F.col("_k") == F.col("_key"), "left")
    body = F.split("text", "\n", -1)
    kept = F.array_join(let(body, lambda lines: without(lines, F.col("spans"))), "\n")
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["from"])
    return joined.select(
        "doc_id",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(body)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        *([] if rest is None else ["_rest"]),
    )


def deduped_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, with the later copies deleted; documents of which nothing is left go, n_chars is counted again.

    Nulls, empty texts, ties and repeated rows are as in ``dedup_lines``; null and empty texts stay.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = dedup_lines(docs, min_words, rest).filter("n_removed < n_lines OR n_removed = 0")
    made = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_rest").getField("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[made.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns])
