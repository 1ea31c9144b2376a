import json

import pytest
from pyspark.sql import functions as F

from emendata.operators import diff, reports, versioning
from emendata.sources import sql


def test_responses(spark):
    feeds = spark.createDataFrame([("FETCHED",), ("FAILED",), ("FETCHED",)], "outcome string")
    articles = spark.createDataFrame([("NEW", True), ("CHANGED", False), ("NEW", False)], "outcome string, lossy boolean")
    out = json.loads(reports.run_response(feeds, articles, F.col("lossy")).first().response)
    assert out["feeds"]["fetched"] == 2 and out["articles"]["new"] == 2 and out["articles"]["checked"] == 3 and out["articles"]["replaced"] == 1
    rows = spark.createDataFrame([(1, 1, "t", ["a b c d"]), (1, 2, "t", ["a b c e", "new one"]), (2, 1, "t", ["x"])], "doc long, version_number long, title string, paragraphs array<string>")
    got = {r.doc: json.loads(r.response) for r in reports.revisions_response(rows.withColumn("at", F.col("version_number")), "doc", "at").collect()}
    assert [v["version_number"] for v in got[1]["revisions"]] == [1, 2]
    listed = reports.changed_response(versioning.latest(rows, "doc"), "doc", "paragraphs")
    assert {r.doc: json.loads(r.response)["paragraph_count"] for r in listed.collect()} == {1: 2, 2: 1}
    diffs = diff.revision_diffs(versioning.revision_pairs(rows, "doc", ["title", "paragraphs"]), "title", "paragraphs")
    body = json.loads(reports.diff_response(diffs).first().response)
    assert [p["kind"] for p in body["paragraphs"]] == ["CHANGED", "ADDED"] and "title" not in body
    change = reports.change_rows(diffs.unionByName(diffs), "doc", F.lit(None).cast("string")).collect()
    assert [(c.classification, c.title_changed) for c in change] == [("SUBSTANTIVE", False)]
    both = reports.all_results(feeds, articles)
    assert [r.part for r in both.orderBy("part").collect()] == [0, 0, 0, 1, 1, 1]


def test_windows():
    assert reports.window_start("hour", 10_000) == 6_400 and reports.window_start("all", 5) == 0
    with pytest.raises(KeyError):
        reports.window_start("year", 5)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT extract_article('<article><h1>T</h1><p>Some prose that is long enough here.</p></article>', 'https://a.example/').title AS t, decode_bytes(X'E9', 'text/html; charset=latin1').text AS d").first()
    assert (row.t, row.d) == ("T", "é")
    feed = "<rss><channel><item><title>A</title><link>l</link></item></channel></rss>"
    assert spark.sql(f"SELECT * FROM feed_entries('{feed}')").first().link == "l"
