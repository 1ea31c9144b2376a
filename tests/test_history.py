import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emendata.operators import planning as P
from emendata.operators import versioning as V
from emendata.streaming import history as H

T0 = dt.datetime(2026, 1, 1)


def log(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(r.randrange(8), T0 + dt.timedelta(minutes=i), r.choice(["a", "b", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc long, at timestamp, content string")


def fold(rows):
    newest, out = {}, []
    for doc, at, content in rows:
        number, last = newest.get(doc, (0, object()))
        if content != last:
            newest[doc] = (number + 1, content)
            out.append((doc, at, content, number + 1))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_revisions_follow_the_newest(spark):
    rows, df = log(spark)
    got = V.append_if_changed(df, "doc", "at", "content")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(fold(rows), key=key)
    assert V.broken_numbers(got, "doc").count() == 0
    again = spark.createDataFrame([(1, T0, "A"), (1, T0 + dt.timedelta(1), "B"), (1, T0 + dt.timedelta(2), "A")], "doc long, at timestamp, content string")
    assert V.append_if_changed(again, "doc", "at", "content").count() == 3
    assert V.reverts(V.append_if_changed(again, "doc", "at", "content"), "doc", "content").collect()[0].first_version == 1


def test_merging_batches_changes_nothing(spark):
    rows, df = log(spark)
    whole = sorted(fold(rows), key=key)
    store = V.append_if_changed(df.filter(F.col("at") < T0 + dt.timedelta(minutes=100)), "doc", "at", "content")
    for low in (100, 200):
        part = df.filter((F.col("at") >= T0 + dt.timedelta(minutes=low)) & (F.col("at") < T0 + dt.timedelta(minutes=low + 100)))
        store = store.unionByName(V.merge_revisions(store, part, "doc", "at", "content"))
    assert sorted(map(tuple, store.collect()), key=key) == whole


def stream(spark, df, path):
    df.repartition(1).sortWithinPartitions("at").write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streamed_revisions(spark, tmp_path):
    rows, df = log(spark, 120)
    rows = [r for r in rows if r[2] is not None]
    source = stream(spark, df.filter("content IS NOT NULL"), str(tmp_path / "in"))
    q = H.stateful_revisions(source).writeStream.format("memory").queryName("revisions").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("revisions").collect())) == sorted(fold(rows))
    store = str(tmp_path / "store")
    q = source.writeStream.foreachBatch(H.merge_into(store)).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(store).select("doc", "at", "content", "version_number")
    assert sorted(map(tuple, got.collect())) == sorted(fold(rows))
    H.merge_into(store)(df.filter("content IS NOT NULL"), 0)  # the batch again
    assert spark.read.parquet(store).count() == len(fold(rows))


def test_streamed_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=20 * i), i % 4 != 0) for i in range(8)], "link long, at timestamp, failed boolean")
    source = stream(spark, df, str(tmp_path / "in"))
    q = H.stateful_strikes(source).writeStream.format("memory").queryName("strikes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("strikes").first().failure_count == 3
    q = H.requests_per_hour(source, "link", "at").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert all(r.requests == 3 for r in spark.table("hours").collect())


def test_claim_strikes_and_single_runs_of_a_stream(spark, tmp_path):
    rows = [(1, T0, False), (1, T0 + dt.timedelta(hours=1), False), (2, T0, False), (2, T0, True)]
    spark.createDataFrame(rows, "feed long, at timestamp, changed boolean").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("feed long, at timestamp, changed boolean").parquet(str(tmp_path / "in"))
    q = H.stateful_claim_strikes(source).writeStream.format("memory").queryName("claims").outputMode("update").option("checkpointLocation", str(tmp_path / "e")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.feed: r.unconfirmed_claims for r in spark.table("claims").collect()} == {1: 2, 2: 0}
    counts = []
    q = H.run_every(source, "run", lambda batch, n: counts.append(batch.count()), str(tmp_path / "f"))
    with pytest.raises(H.AlreadyRunning):
        H.run_every(source, "run", lambda batch, n: None, str(tmp_path / "g"))
    q.processAllAvailable()
    q.stop()
    H.run_every(source, "run", lambda batch, n: counts.append(batch.count()), str(tmp_path / "h"), None).awaitTermination(60)
    assert counts == [4, 4]
    q = H.requests_per_hour(source, "feed", "at", slide="30 minutes").writeStream.format("memory").queryName("sliding").outputMode("complete").option("checkpointLocation", str(tmp_path / "i")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sliding").agg(F.sum("requests")).first()[0] == 8


def test_listing_bounds(spark):
    rows = [(i, 2 + i % 3, T0 + dt.timedelta(hours=i) if i % 5 else None, T0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc long, version_count long, last_changed_at timestamp, first_seen_at timestamp")
    newest = docs.select("doc", F.lit("x").alias("newest"))
    assert V.changed_documents(docs, newest, "doc", limit=0).count() == 1
    assert V.capped(V.changed_documents(docs, newest, "doc", limit=999))
    assert V.changed_documents(docs, newest, "doc").first().doc == 299
    assert V.changed_documents(docs, newest, "doc", since=F.lit(T0 + dt.timedelta(hours=290)), least_versions=0).count() == 8


STATE = "pos int, host string, first_seen long, last_checked long, last_changed long, version_count int, feed_updated long, feed_updated_exact boolean, unconfirmed_claims int"


def decide(spark, now, **state):
    base = dict(pos=0, host="h", first_seen=0, last_checked=0, last_changed=None, version_count=1, feed_updated=None, feed_updated_exact=False, unconfirmed_claims=0)
    row = base | state
    df = spark.createDataFrame([tuple(row[k.split()[0]] for k in STATE.split(", "))], STATE)
    return P.RecheckPolicy().plan(df, now).first().decision


def test_decisions(spark):
    assert decide(spark, 0, last_checked=None, version_count=0) == "DUE"
    assert decide(spark, 599) == "WAITING" and decide(spark, 600) == "DUE"
    assert decide(spark, 604_800) == "DUE" and decide(spark, 604_801) == "RETIRED"
    assert decide(spark, 604_801, version_count=2) == "DUE"
    assert decide(spark, 100, feed_updated=50, feed_updated_exact=True) == "DUE"
    assert decide(spark, 100, feed_updated=50, feed_updated_exact=False) == "WAITING"
    assert decide(spark, 100, feed_updated=50, feed_updated_exact=True, unconfirmed_claims=20) == "WAITING"
    assert decide(spark, 100, feed_updated=0, feed_updated_exact=True) == "WAITING"


def test_life_of_a_stable_document():
    """The schedule of a document that never changes, as the policy's numbers give it."""
    p, last, checks = P.RecheckPolicy(), 0, [0]
    for minute in range(10 * 24 * 60):
        now = minute * 60
        interval = max(p.min_interval, min(p.max_interval, int(now * p.age_factor)))
        if now <= p.window and now - last >= interval:
            last = now
            checks.append(now)
    assert 20 <= len(checks) <= 40
    assert 4 <= sum(c <= 3600 for c in checks) <= 6 and sum(c <= 86_400 for c in checks) > len(checks) / 2


def test_throttle_is_the_sequential_loop(spark):
    r = random.Random(3)
    rows = [(i, f"h{r.randrange(2)}", 0, r.choice([None, r.randrange(90_000, 100_000)]), None, 1, None, False, 0) for i in range(120)]
    policy, now = P.RecheckPolicy(requests_per_hour=20, max_interval=1200), 100_000
    got = {x.pos: x.decision for x in policy.plan(spark.createDataFrame(rows, STATE), now).collect()}
    spent = {h: sum(1 for x in rows if x[1] == h and x[3] is not None and x[3] > now - 3600) for h in ("h0", "h1")}
    for x in sorted(rows, key=lambda x: (x[3] is not None, x[3] or 0, x[0])):
        due = x[3] is None or now - x[3] >= 1200
        want = "WAITING"
        if due:
            want = "DUE" if spent[x[1]] < 20 else "THROTTLED"
            spent[x[1]] += want == "DUE"
        assert got[x[0]] == want


def test_parameters_are_checked():
    for bad in (dict(min_interval=0), dict(max_interval=1), dict(age_factor=0.0), dict(age_factor=float("nan")), dict(max_window_factor=0), dict(requests_per_hour=0)):
        with pytest.raises(ValueError):
            P.RecheckPolicy(**bad)
    with pytest.raises(ValueError):
        P.ArticleBudget(0, 1)


def test_sound_states(spark):
    rows = [(0, "h", 0, 1, None, 1, None, False, 0), (1, None, 0, 1, None, 1, None, False, 0), (2, "h", 0, None, 5, 0, None, False, 0), (3, "h", 0, 1, None, -1, None, False, 0)]
    assert [r.pos for r in P.sound_states(spark.createDataFrame(rows, STATE)).collect()] == [0]


def test_schedule(spark):
    r = random.Random(5)
    rows = [(f"h{i % 3}", float(i) + r.random(), r.random() * 3) for i in range(60)]
    got = {(x.host, x.at): x.start for x in P.polite_schedule(spark.createDataFrame(rows, "host string, at double, took double"), "host", "at", "took", 1.0).collect()}
    free = {}
    for host, at, took in sorted(rows, key=lambda x: x[1]):
        start = max(at, free.get(host, 0.0))
        assert got[host, at] == pytest.approx(start)
        free[host] = start + took + 1.0


def test_either_key_lookup_settles_ties(spark):
    wanted = spark.createDataFrame([("u",), ("o",)], "url string")
    known = [(9, "u", None), (2, "u", "x"), (5, "u", "o"), (4, "v", "o"), (3, "v", "o")]
    for order in (known, known[::-1], known[2:] + known[:2]):
        documents = spark.createDataFrame(order, "page_id long, identity string, origin string").coalesce(1)
        found = V.either_key_lookup(wanted, documents, "url", "identity", "origin", ["page_id"]).collect()
        assert sorted(map(tuple, found)) == [("o", 5), ("u", 2)]
