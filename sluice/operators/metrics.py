"""Route metrics, spans and ring buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_sorted(values: Column, p: float) -> Column:
    """Element at int((n - 1) * p) of the sorted values (the collector's rule)."""
    n = F.size(values)
    return F.get(values, F.floor((n - 1) * F.lit(p)).cast("int"))


def percentile_ranked(values: Column, percent: int) -> Column:
    """Element at n * percent / 100 of the sorted values, at most the last (the viewer's rule)."""
    n = F.size(values)
    return F.get(values, F.least(F.floor(n * percent / 100), n - 1).cast("int"))


#: Buckets for each factor of e in a value.
BUCKETS = 128


def latency_percentiles(df: DataFrame, keys: list[str], value: str, rule: str = "collector") -> DataFrame:
    """p50, p90, p99, sum, count and average of ``value`` by ``keys``.

    Values are counted first, so a key's state is its distinct values, not its rows. Counts by ranges of values, each
    about one hundredth wide, tell which ranges hold the ranks; only their values are sorted, each range by itself. The
    collector's average is an integer, the viewer's a double.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    v = F.col(value).cast("double")
    counts = counts.withColumn("_range", F.floor(F.signum(v) * F.log(F.abs(v) + 1) * BUCKETS).cast("bigint"))
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"), F.sum(F.col(value) * F.col("_n")).alias("_sum"))
    w = Window.partitionBy(*keys)
    ranges = ranges.withColumns({"_upto": F.sum("_in").over(w.orderBy("_range")), "_all": F.sum("_in").over(w), "_total": F.sum("_sum").over(w)})

    def rank(p: int) -> Column:
        if rule == "collector":
            return F.floor((F.col("_all") - 1) * F.lit(p / 100))
        return F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)

    before = F.col("_upto") - F.col("_in")
    holds = {p: (before <= rank(p)) & (F.col("_upto") > rank(p)) for p in (50, 90, 99)}
    asked = ranges.withColumns({f"_p{p}": h for p, h in holds.items()}).where("_p50 OR _p90 OR _p99")
    asked = asked.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), before.alias("_before"), "_all", "_total", "_p50", "_p90", "_p99")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_range").orderBy(value)
    upto = counts.join(asked, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    at = lambda p: F.min(F.when(F.col(f"_p{p}") & (F.col("_upto") > rank(p)), F.col(value))).alias(f"p{p}")
    total, n = F.max("_total"), F.max("_all")
    avg = F.floor(F.try_divide(total, n)).cast("bigint") if rule == "collector" else F.try_divide(total.cast("double"), n.cast("double"))
    return upto.groupBy(*keys).agg(at(50), at(90), at(99), total.alias("total"), n.alias("n"), avg.alias("average"))


def route_counters(df: DataFrame, route: str = "route", ok: str = "ok", retries: str = "retries", dead: str = "dead") -> DataFrame:
    """total, success, failed, retries and dead letters by route."""
    return df.groupBy(route).agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("success"), F.count_if(~F.col(ok)).alias("failed"), F.sum(retries).cast("bigint").alias("retries"), F.count_if(F.col(dead)).alias("dead_letters"))


def errors_by_type(df: DataFrame, route: str = "route", kind: str = "error_type") -> DataFrame:
    return df.where(F.col(kind).isNotNull()).groupBy(route, kind).agg(F.count("*").alias("errors"))


def message_rates(df: DataFrame, ts: str, route: str) -> DataFrame:
    """Messages a minute by route."""
    return df.groupBy(F.window(ts, "1 minute").alias("w"), route).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), route, "n")


def ring_buffer(df: DataFrame, route: str, order: list[str], capacity: int = 200) -> DataFrame:
    """The last messages of each route."""
    w = Window.partitionBy(route).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def recent_spans(spans: DataFrame, limit: int = 20, route: str | None = None) -> DataFrame:
    """The newest spans, in order of their start."""
    s = spans if route is None else spans.where(F.col("route") == route)
    return s.orderBy(F.desc("start_time"), F.desc("span_id")).limit(limit).orderBy("start_time", "span_id")


def child_spans(spans: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(parent_span_id, child_span_id, name) of each parent and child within a trace."""
    p = (spans if parents is None else parents).select(F.col("trace_id"), F.col("span_id").alias("parent_span_id"))
    c = spans.select("trace_id", F.col("parent_span_id").alias("_up"), F.col("span_id").alias("child_span_id"), "name")
    return p.join(c, (p.trace_id == c.trace_id) & (p.parent_span_id == c["_up"])).select(p.trace_id, "parent_span_id", "child_span_id", "name")


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def span_lines(spans: DataFrame) -> DataFrame:
    """A line of text for each span."""
    ms = F.format_string("%.2fms", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000)
    return spans.select(F.concat_ws(" ", F.date_format("start_time", "HH:mm:ss.SSS"), F.concat(F.lit("["), F.coalesce("status", F.lit("unset")), F.lit("]")), "name", ms).alias("line"))


def sampled(spans: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Whole traces at a rate, by a hash of the trace id."""
    return spans.where(F.pmod(F.xxhash64("trace_id", F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))


def utilisation(used: Column, quota: Column) -> Column:
    """Percent of a quota, at most 100; 0 without a quota."""
    return F.when(quota <= 0, F.lit(0.0)).otherwise(F.least(F.try_divide(used * 100.0, quota), F.lit(100.0)))


def impact_level(affected: Column) -> Column:
    return F.when(affected == 0, "low").when(affected <= 3, "medium").when(affected <= 10, "high").otherwise("critical")


def impact(edges: DataFrame) -> DataFrame:
    """By target: affected routes and sinks, level, and confidence (the share of references known for sure)."""
    owners = F.count_distinct(F.when(F.col("is_static") & F.col("source_type").isin("route", "sink"), F.struct("source_type", "source_name")))
    out = edges.groupBy("target_type", "target_name").agg(owners.alias("affected"), F.avg(F.col("is_static").cast("double")).alias("confidence"), F.count("*").alias("refs"))
    return out.withColumn("level", impact_level(F.col("affected")))


def rating(findings: DataFrame, by: str = "config") -> DataFrame:
    """needs-review from three important findings on; fair from one; good over five findings; else excellent."""
    important = F.count_if(F.col("severity") == "important")
    out = findings.groupBy(by).agg(important.alias("important"), F.count("severity").alias("findings"), F.bool_or(F.coalesce("invalid", F.lit(False))).alias("invalid") if "invalid" in findings.columns else F.lit(False).alias("invalid"))
    return out.withColumn("rating", F.when(F.col("invalid"), "invalid").when(F.col("important") >= 3, "needs-review").when(F.col("important") > 0, "fair").when(F.col("findings") > 5, "good").otherwise("excellent"))
