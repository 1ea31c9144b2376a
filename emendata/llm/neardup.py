"""MinHash near-duplicates by tensored banding, candidates verified on full shingle sets.

Two collections of B short bands of ROWS minhashes each are computed; every pair of a band of the first and a band of
the second makes one table key, so B^2 keys cost only 2 * B bands of minhashes. Two sets of similarity s share no key
with probability 1 - (1 - (1 - s^ROWS)^B)^2. B is the least that keeps this within MISSED at the threshold: 17 at
0.80, 12 at 0.85.

Nodes are distinct shingle sets; documents of equal sets are one node from the start. Every bucket has its most
central member for a hub; the members of all buckets of one hub are its star, and all are compared with the hub. A star
that still holds more than one component is dealt into blocks of bounded size, and every two
blocks of it meet once in one task, each set carried once: there a prefix filter and the components found so far leave
few pairs, which are compared on full sets, and only links that join two components leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emendata.llm.common import discard, durable, joined_by_shuffle, row_key, stored
from emendata.llm.shingles import U, mixed, parts, shingle_sets

ROWS = 4
MISSED = 3e-4
SEED = 2024
#: Bytes of sets in a block of a star; a task holds two blocks.
BLOCK_BYTES = 8 << 20
#: Candidates of one set that are compared at a time; between, components are looked up again.
AT_ONCE = 512


KEY = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def bands_for(percent: int) -> int:
    """Bands in each collection, so that a pair at exactly ``percent`` shares no key with probability MISSED at most."""
    apart = max(1 - (percent / 100) ** ROWS, MISSED**2)
    return math.ceil(math.log(1 - math.sqrt(1 - MISSED)) / math.log(apart))


def sketch_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_id),
            T.StructField("_row", KEY),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("first", T.ArrayType(T.LongType())),
            T.StructField("second", T.ArrayType(T.LongType())),
        ]
    )


def node_ids(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes per set, the same for equal sets in any order."""
    one = np.add.reduceat(mixed(flat ^ U(0xA5A5A5A5A5A5A5A5)), begins)
    two = np.add.reduceat(mixed(flat + U(0x123456789ABCDEF)), begins)
    both = np.stack([mixed(one + sizes.astype(U)), two], axis=1)
    return [x.tobytes() for x in both]


def band_values(flat: np.ndarray, begins: np.ndarray, bands: int) -> np.ndarray:
    """2 * bands numbers per set: each mixes ROWS minhashes."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, 2 * bands * ROWS, dtype=np.uint64) * U(2) + U(1)
    shifts = draw.integers(0, 1 << 63, 2 * bands * ROWS, dtype=np.uint64)
    out = np.empty((len(begins), 2 * bands), U)
    work = np.empty(len(flat), U)
    for band in range(2 * bands):
        value = np.full(len(begins), U(band + 1))
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(flat, shifts[k], out=work)
            np.multiply(work, factors[k], out=work)
            value = mixed(value + np.minimum.reduceat(work, begins))
        out[:, band] = value
    return out.view(np.int64)


def sketches(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """Per row: doc_id, _row (key of id and text), n_shingles, node (null without words), first and second (bands)."""
    schema = sketch_schema(docs.schema["doc_id"].dataType)

    def run(batches):
        for batch in batches:
            for at, texts in parts(batch.column(2)):
                sets = shingle_sets(texts, shingle)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                nodes, numbers = [None] * len(sets), None
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.cumsum(sizes[full]) - sizes[full]
                    for i, node in zip(full.tolist(), node_ids(flat, begins, sizes[full]), strict=True):
                        nodes[i] = node
                    numbers = band_values(flat, begins, bands)
                lists = []
                for half in (slice(0, bands), slice(bands, 2 * bands)):
                    ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                    values = np.empty(0, np.int64) if numbers is None else np.ascontiguousarray(numbers[:, half]).ravel()
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        batch.column(1).slice(at, len(sets)),
                        pa.array(sizes),
                        pa.array(nodes, pa.binary()),
                        *lists,
                    ],
                    names=schema.fieldNames(),
                )
        pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), "text")
    return rows.mapInArrow(run, schema)


def stars_of(nodes: DataFrame) -> DataFrame:
    """hub, hub_n, node, n: the members of all buckets, each under the hub of its bucket, once per hub and node; durable.

    A bucket is a tensored key that two nodes or more share. Its hub is the member that shares its first bands with
    most nodes: it stands in the middle of its likes, and is the same in most buckets of a group.
    """
    once = nodes.select("node", F.posexplode("first").alias("i", "g")).select("node", F.xxhash64("i", "g").alias("g"))
    shared = durable(once.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("g").alias("_g"), "c"))
    left = once.join(shared, F.col("g") == F.col("_g")).groupBy("node").agg(F.collect_set("g").alias("gs"), (-F.sum("c")).alias("w"))
    wide = left.join(nodes.select("node", "n", "second"), "node")
    wide = wide.select("node", "n", "w", F.explode("gs").alias("g"), "second").select("node", "n", "w", "g", F.posexplode("second").alias("j", "h"))
    keyed = durable(wide.select(F.xxhash64("g", "j", "h").alias("key"), "node", "n", "w"))
    # Buckets of the same members say the same: one of them stays.
    sums = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    # The two ends of a bucket come with it; only the members between them have to be looked up.
    each = F.struct("w", "node", "n")
    common = keyed.groupBy("key").agg(F.count("*").alias("c"), *sums, F.min(each).alias("m"), F.max(each).alias("x")).filter("c > 1")
    common = common.groupBy("c", "s1", "s2").agg(F.min("key").alias("_key"), F.min("m").alias("m"), F.min("x").alias("x"))
    common = durable(common.select("_key", "c", F.col("m.node").alias("hub"), F.col("m.n").alias("hub_n"), F.col("x.node").alias("last"), F.col("x.n").alias("last_n")))
    ends = [common.select("hub", "hub_n", F.col(k).alias("node"), F.col(f"{k}_n").alias("n")) for k in ("hub", "last")]
    between = (F.col("key") == F.col("_key")) & (F.col("node") != F.col("hub")) & (F.col("node") != F.col("last"))
    members = keyed.join(common.filter("c > 2"), between).select("hub", "hub_n", "node", "n").unionAll(ends[0]).unionAll(ends[1])
    return durable(members.distinct())


def size_fits(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a and b of those pairs of nodes for which 100 * intersection >= percent * union, on the whole sets."""

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = common(p, q)
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return durable(two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"))


def common(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def joining_links(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of linked pairs that join all components which links among ``sets`` join; exact.

    ``roots`` are the components known before. Where ``side`` has both 0 and 1, only pairs of the two sides are looked
    for. Elements are ordered from the rarest. Of two sets with 100 * intersection >= percent * union the intersection
    has percent % of each at least, so their first n - ceil(n * percent / 100) + 1 elements meet; what does not meet
    there is not linked. What does, and is not in one component yet, is compared in full.
    """
    k = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, k)
    order = np.argsort(sizes, kind="stable")
    # Two blocks and their elements are counted in 32 bits; this is where a task needs most memory.
    owners = np.repeat(np.arange(k, dtype=np.int32), sizes[order])
    _, codes, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    tokens = rank[codes]
    alone = int((counts == 1).sum())  # the first so many elements belong to one set only
    del codes, rank
    n = sizes[order]
    begin = np.cumsum(n) - n
    for x, y in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        tokens[x:y].sort()
    prefix = n - (n * percent + 99) // 100 + 1
    heads = np.zeros(len(tokens), bool)
    for x, y in zip(begin.tolist(), (begin + prefix).tolist(), strict=True):
        heads[x:y] = tokens[x:y] >= alone
    # Lists of the sets that have an element in their prefix, from small sets to large.
    listed, list_of = owners[heads], tokens[heads]
    by_token = np.argsort(list_of, kind="stable")
    listed = listed[by_token]
    starts = np.searchsorted(list_of[by_token], np.arange(len(counts) + 1))
    component = np.unique(roots[order], return_inverse=True)[1]
    sides = side[order]
    both_sides = len(np.unique(side)) > 1
    head_begin = np.searchsorted(owners[heads], np.arange(k + 1))
    mark, seen, links = np.zeros(len(counts), bool), np.zeros(k, bool), []
    for x in range(1, k):
        own = list_of[head_begin[x] : head_begin[x + 1]]
        if not len(own):
            continue
        seen[:x] = False
        for t in own.tolist():
            seen[listed[starts[t] : starts[t + 1]]] = True
        near = np.flatnonzero(seen[:x])
        near = near[100 * n[near] >= percent * n[x]]
        if both_sides:
            near = near[sides[near] != sides[x]]
        near = near[component[near] != component[x]][::-1]  # the most alike in size first
        if not len(near):
            continue
        mine = tokens[begin[x] : begin[x] + n[x]]
        mark[mine] = True
        while len(near):
            some, near = near[:AT_ONCE], near[AT_ONCE:]
            ends = np.cumsum(n[some])
            at = np.arange(ends[-1]) + np.repeat(begin[some] - (ends - n[some]), n[some])
            shared = np.add.reduceat(mark[tokens[at]].astype(np.int64), ends - n[some])
            for y in some[100 * shared >= percent * (n[x] + n[some] - shared)].tolist():
                if component[y] != component[x]:
                    links.append((int(order[x]), int(order[y])))
                    component[component == component[y]] = component[x]
            near = near[component[near] != component[x]]
        mark[mine] = False
    return links


def blocks_of(stars: DataFrame) -> DataFrame:
    """Rows of ``stars`` (hub, node, n, root) with the two blocks (lo, hi) of their star that meet in a task, and side.

    Members of the component with most of them in the star are dealt into blocks of their own, which need not meet
    each other. So a star that is all but one component has as many rows as members, however large it is.
    """
    per_root = stars.groupBy("hub", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = per_root.groupBy(F.col("hub").alias("_hub")).agg(F.max(F.struct("c", "s", "root")).alias("m"), F.sum("s").alias("s"))
    parts = lambda shingles: F.ceil(8 * shingles / F.lit(BLOCK_BYTES)).cast("int")
    whole = whole.select("_hub", F.col("m.root").alias("_main"), parts(F.col("m.s")).alias("_mains"), parts(F.col("s") - F.col("m.s")).alias("_others"))
    dealt = stars.join(durable(whole.filter("_others > 0")), F.col("hub") == F.col("_hub"))
    main = F.col("root") == F.col("_main")
    salt = F.xxhash64(F.lit(7), "node")
    block = F.when(main, F.pmod(salt, F.col("_mains"))).otherwise(F.col("_mains") + F.pmod(salt, F.col("_others"))).cast("int")
    # A main block meets the others only; another block meets all.
    meets = F.sequence(F.when(main, F.col("_mains")).otherwise(F.lit(0)), F.col("_mains") + F.col("_others") - 1)
    met = dealt.withColumn("_block", block).withColumn("_with", F.explode(meets))
    lo, hi = F.least("_block", "_with"), F.greatest("_block", "_with")
    return met.select("hub", lo.alias("lo"), hi.alias("hi"), (F.col("_block") == hi).cast("int").alias("side"), "node", "root")


def star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the components of each star; every two blocks are compared in one task."""
    schema = "a long, b long"

    def run(batches):
        group, held = None, []

        def close():
            nodes, roots, side, found = zip(*held, strict=True)
            links = joining_links(found, np.array(roots), np.array(side), percent)
            return [(nodes[x], nodes[y]) for x, y in links]

        def sent(links):
            columns = list(zip(*links, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            done = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            for i, (hub, lo, hi, side, node, root) in enumerate(keys):
                if (hub, lo, hi) != group:
                    if held:
                        done += close()
                    group, held = (hub, lo, hi), []
                held.append((node, root, side, np.frombuffer(batch.column(6)[i].as_py(), U)))
            yield sent(done)
        if held:
            yield sent(close())
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    task = ["hub", "lo", "hi"]
    rows = blocks_of(stars).join(sets, "node").select(*task, "side", "node", "root", "set")
    tasks = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that heavy tasks are not merged
    return durable(rows.repartition(tasks, *task).sortWithinPartitions(*task).mapInArrow(run, schema))


def set_table(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and set (sorted 64-bit numbers) of the wanted nodes, from one document each: wanted has _wanted (a row key)."""

    def run(batches):
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                sets = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "set"]
                )

    rows = docs.select("text", row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    rows = rows.join(joined_by_shuffle(wanted), F.col("_row") == F.col("_wanted")).select("node", "text")
    return stored(rows.mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for all nodes of the edges a - b, by large-star and small-star steps."""
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        low = low.select("_u", F.least("_u", "_m").alias("_m"))
        large = both.join(low, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = durable(large.filter("u <> v").distinct())
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        joined = large.join(least, F.col("u") == F.col("_u"))
        small = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionAll(joined.select("u", F.col("_m").alias("v")))
        e = durable(small.filter("u <> v").distinct())
        now = e.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def open_stars(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """hub, node, n, root of the stars in which components meet that their hub has not joined."""
    own = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rooted = stars.join(own, F.col("node") == F.col("_node"), "left").select("hub", "node", "n", F.coalesce("_root", "node").alias("root"))
    rooted = durable(rooted)
    spread = rooted.groupBy(F.col("hub").alias("_of")).agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_c"))
    spread = durable(spread.filter((F.col("_low") != F.col("_high")) & (F.col("_c") > 2)).select("_of"))
    return durable(rooted.join(spread, F.col("hub") == F.col("_of")).drop("_of"))


def links(docs: DataFrame, nodes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """node and root for all nodes that are linked: components of verified links.

    Every pair of a bucket is compared, unless it is in one component by then, or sizes or prefixes rule a link out.
    """
    stars = stars_of(nodes)
    wanted = nodes.join(stars.select("node").distinct(), "node", "left_semi").select("node", F.col("_row").alias("_wanted"))
    sets = set_table(docs, durable(wanted), shingle)
    pairs = stars.filter((F.col("node") != F.col("hub")) & size_fits("n", "hub_n", percent))
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    to_hubs = verified(durable(pairs), sets, percent)
    roots = durable(components(to_hubs))
    more = star_links(open_stars(stars, roots), sets, percent)
    discard(sets)
    return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, and _row.

    A document's set is its distinct shingles of ``shingle`` words, A-Z lower-cased; with fewer words the whole
    sequence is one. Documents are linked if 100 * intersection >= ``percent`` * union. Null, empty and wordless
    texts have no set and are linked with nothing. kept is whether doc_id is component_id; a null doc_id is kept only
    in a component of null ids. Rows that repeat a doc_id are nodes by their texts and share ids as they come. _row is
    the key of doc_id and text, _root names the component (null without words).
    """
    plain = docs.select("doc_id", "text")
    rows = stored(sketches(plain, shingle, bands_for(percent)))
    nodes = rows.filter("node IS NOT NULL").groupBy(F.col("node").alias("digest")).agg(
        F.min("doc_id").alias("low_id"), F.min("_row").alias("_row"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("second").alias("second")
    )
    # Short numbers for the nodes, fixed by being stored.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = links(plain, nodes, percent, shingle)
    rooted = nodes.select("digest", "node", "low_id").join(roots, "node", "left").select("digest", "low_id", F.coalesce("root", "node").alias("root"))
    rooted = durable(rooted)
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("low_id").alias("component_id"))
    ids = durable(rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("digest").alias("_node"), "component_id", "root"))
    out = rows.select("doc_id", "_row", "n_shingles", "node").join(ids, F.col("node") == F.col("_node"), "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_row", F.col("root").alias("_root"))


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each component.

    The row of the smallest doc_id stays (null last; of equal ids the smaller key of id and text), once if it is
    repeated. Texts without words are in no component and stay, those that repeat an id and text once.
    """
    found = durable(near_duplicates(docs, percent, shingle).select("doc_id", "_row", "_root"))
    leaders = found.filter("_root IS NOT NULL").groupBy(F.col("_root").alias("_of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"))
    leaders = leaders.select("_of", F.col("m._row").alias("_leader"))
    marks = found.join(leaders, F.col("_root") == F.col("_of"), "left").groupBy(F.col("_row").alias("_mark"))
    marks = marks.agg(F.max(F.coalesce(F.col("_row") != F.col("_leader"), F.lit(False))).alias("_gone"), F.count("*").alias("_times"))
    marks = durable(marks.filter("_gone OR _times > 1"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_row"), rest.alias("_rest"))
    rows = rows.join(joined_by_shuffle(marks), F.col("_row") == F.col("_mark"), "left")
    repeated = rows.filter("NOT _gone").dropDuplicates(["_row"])
    kept = rows.filter("_mark IS NULL").select("_rest").unionByName(repeated.select("_rest"))
    return kept.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns])
