"""The parsing functions for SQL: after ``register`` they can be called by name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from emendata.sources.articles import ARTICLE, read_page
from emendata.sources.encoding import DECODED, decode
from emendata.sources.feeds import parse_feed


def register(spark: SparkSession) -> list[str]:
    """Register extract_article(html, url), decode_bytes(body, content_type) and the table function feed_entries(body)."""

    @F.arrow_udf(ARTICLE)
    def extract_article(html, url):
        rows = [read_page(page, base) for page, base in zip(html.to_pylist(), url.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("canonical", pa.string())]))

    @F.arrow_udf(DECODED)
    def decode_bytes(body, content_type):
        kind = [("text", pa.string()), ("charset", pa.string()), ("source", pa.string()), ("replaced", pa.bool_()), ("warnings", pa.list_(pa.string()))]
        return pa.array([decode(b, t) for b, t in zip(body.to_pylist(), content_type.to_pylist(), strict=True)], pa.struct(kind))

    @udtf(returnType="slot int, title string, link string, summary string, published_raw string, updated_raw string, guid string")
    class FeedEntries:
        def eval(self, body: str):
            for slot, e in enumerate(parse_feed(body)["entries"]):
                yield slot, e["title"], e["link"], e["summary"], e["published_raw"], e["updated_raw"], e["guid"]

    spark.udf.register("extract_article", extract_article)
    spark.udf.register("decode_bytes", decode_bytes)
    spark.udtf.register("feed_entries", FeedEntries)
    return ["extract_article", "decode_bytes", "feed_entries"]
