"""robots.txt as rows of rules, and the verdict for an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendata.operators.versioning import as_of_join
from pyspark.sql.window import Window


def rule_lines(files: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, field, value of every line that has a field and a value, comments cut."""
    lines = files.select(key, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select(key, "pos", F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"))
    return lines.filter("field <> ''")


def rules(files: DataFrame, key: str, body: str, agent: str) -> DataFrame:
    """key, allow, pattern, and crawl_delay of the groups that are most specific for ``agent``.

    A group is a run of user-agent lines and what follows it. A token fits if it occurs in the agent's name; '*' fits
    everyone least, longer tokens fit better. All groups of the best fit count together; an empty Disallow is no rule.
    """
    lines = rule_lines(files, key, body)
    order = Window.partitionBy(key).orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = lines.withColumn("_s", starts.cast("int")).withColumn("grp", F.sum("_s").over(running)).filter("grp > 0")
    token = F.lower(F.col("value"))
    fit = F.when(token == "*", 0).when((token != "") & F.contains(F.lit(agent.lower()), token), F.length(token))
    whole = Window.partitionBy(key, "grp")
    fitted = grouped.withColumn("fit", F.max(F.when(is_agent, fit)).over(whole))
    best = fitted.withColumn("_b", F.max("fit").over(Window.partitionBy(key))).filter("fit = _b")
    delay = F.max(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))).over(Window.partitionBy(key))
    named = best.withColumn("crawl_delay", delay).filter(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return named.select(key, (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), "crawl_delay")


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: a prefix, '*' for any run, '$' at the end for the end."""
    anchored = pattern.endswith("$")
    bare = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.regexp_replace(bare, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    body = F.regexp_replace(F.concat(F.lit("^"), quoted), r"\*+", ".*")
    return F.concat(body, F.when(anchored, "$").otherwise(""))


def verdicts(targets: DataFrame, known: DataFrame, key: str, target: str) -> DataFrame:
    """``targets`` with allowed: the longest pattern that fits decides, Allow before Disallow, nothing fits: allowed.

    Rules meet addresses by the key (the origin), never all with all.
    """
    own = known.select(F.col(key).alias("_k"), "allow", "pattern").groupBy("_k").agg(
        F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", pattern_regex(F.col("pattern")).alias("regex"))).alias("_rules")
    )
    joined = targets.join(own, F.col(key) == F.col("_k"), "left")
    fits = F.filter("_rules", lambda r: F.regexp_like(F.col(target), r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["allow"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_k", "_rules")


def cached_at(requests: DataFrame, fetches: DataFrame, origin: str, at: str, fetched_at: str, rules: list[str], ttl: str) -> DataFrame:
    """``requests`` with the columns ``rules`` of the newest fetch of their origin's file, null once it is older than ``ttl``.

    An as-of join: one shuffle by origin, where the newest fetch before each request is carried along.
    """
    seen = fetches.withColumn("_fetched", F.col(fetched_at)).withColumn("version_number", F.lit(1))
    joined = as_of_join(requests, seen, origin, at, fetched_at, [*rules, "_fetched"])
    fresh = F.col(at) < F.col("_fetched") + F.expr(f"INTERVAL {ttl}")
    return joined.select(*requests.columns, *[F.when(fresh, F.col(c)).alias(c) for c in rules])
