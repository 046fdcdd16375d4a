"""Steps that look at several messages of a key: aggregate, idempotent, rate limit.

Counting without timeouts is a row number. Windows that start at a key's first message (and restart after a flush), and
a time to live that counts from the last accepted message, are sequential per key: rows are dealt by key, sorted within
the partition, and folded in Arrow batches with a state of a few numbers, so no group is ever gathered whole. Where a
column makes rows unique, only key, time and that column are dealt and folded, and the number comes back by a join on
it: messages never go through Python, and a hot key's bodies don't meet in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import values as V
from sluice.functions.compiler import Compiler
from sluice.functions.values import Value
from sluice.operators.envelope import compile_on, fail, ok, with_meta
from sluice.operators.steps import Context

#: Groups of a count strategy flush after this long, unless told otherwise.
TIMEOUT_MS, MAX_MESSAGES, TTL_MINUTES = 60_000, 1000, 60


def _key(df: DataFrame, expr: str, root: str | None) -> Value:
    return Compiler(Value(F.col("body"), df.schema["body"].dataType)).compile(expr) if root == "body" else compile_on(df, expr)


class _Fold:
    """Goes through sorted (key, time) runs; the state of the open key survives from batch to batch."""

    def __init__(self, one, name):
        self.one, self.name = one, name

    def __call__(self, batches):
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            keys = b.column("_key")
            ts = b.column("_t").to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.num_rows
            out = np.zeros(n, np.int64)
            if n:  # a null key is a key of its own, whatever texts there are
                null = keys.is_null().to_numpy(zero_copy_only=False)
                text = keys.fill_null("").to_numpy(zero_copy_only=False)
                ends = np.append(np.flatnonzero((text[1:] != text[:-1]) | (null[1:] != null[:-1])) + 1, n)
                start = 0
                for end in ends:
                    if (null[start], text[start]) != key:
                        key, state = (null[start], text[start]), None
                    out[start:end], state = self.one(ts[start:end], state)
                    start = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, self.name])


def fold(df: DataFrame, one, name: str) -> DataFrame:
    """Adds ``name`` (long): ``one(times, state) -> (values, state)`` over the rows of each ``_key`` by (_t, _id)."""
    dealt = df.repartition("_key").sortWithinPartitions("_key", "_t", "_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt.mapInArrow(_Fold(one, name), f"{fields}, `{name}` long")


def numbered(df: DataFrame, one, name: str, unique: bool) -> DataFrame:
    """``fold`` over narrow rows where ``_id`` is unique."""
    if not unique:
        return fold(df, one, name)
    n = fold(df.select("_key", "_t", "_id"), one, name).select("_id", name)
    return df.join(n, "_id")


def first_anchored(window: int, most: int):
    """Bucket numbers: a bucket opens at its first row, lasts ``window`` and flushes early at ``most`` rows."""

    def one(ts, state):
        bucket, opened, n = state or (-1, None, 0)
        out = np.empty(len(ts), np.int64)
        i = 0
        while i < len(ts):
            if opened is None or n >= most or ts[i] >= opened + window:
                bucket, opened, n = bucket + 1, int(ts[i]), 0
            j = min(int(np.searchsorted(ts, opened + window, "left")), i + most - n)
            j = max(j, i + 1)
            out[i:j] = bucket
            n += j - i
            i = j
        return out, (bucket, opened, n)

    return one


def accepted(ttl: int):
    """1 for rows that are first in ``ttl`` after the last accepted one."""

    def one(ts, state):
        out = np.zeros(len(ts), np.int64)
        i = 0 if state is None else int(np.searchsorted(ts, state + ttl, "left"))
        last = state
        while i < len(ts):
            out[i] = 1
            last = int(ts[i])
            i = max(i + 1, int(np.searchsorted(ts, last + ttl, "left")))
        return out, last

    return one


def limited(window: int, limit: int):
    """1 for rows within the limit of a fixed window that the first row opens."""

    def one(ts, state):
        opened, n = state or (None, 0)
        out = np.zeros(len(ts), np.int64)
        i = 0
        while i < len(ts):
            if opened is None or ts[i] >= opened + window:
                opened, n = int(ts[i]), 0
            j = max(i + 1, int(np.searchsorted(ts, opened + window, "left")))
            take = max(0, min(j - i, limit - n)) if limit else j - i
            out[i : i + take] = 1
            n += take
            i = j
        return out, (opened, n)

    return one


def aggregate(
    df: DataFrame,
    key: str,
    strategy: str = "count",
    count: int = 1,
    timeout_ms: int | None = None,
    window_ms: int = 0,
    max_messages: int = MAX_MESSAGES,
    on_null_key: str = "error_path",
    output_expr: str | None = None,
    tie: str | None = None,
    at: int = 0,
    ctx: Context | None = None,
) -> DataFrame:
    """Groups messages by a key of the body. ``count``: a group flushes when ``count`` are there; with ``timeout_ms``
    also when that long has passed since its first message. ``time_window``: a group opens at its first message, lasts
    ``window_ms`` and flushes early at ``max_messages``. What is open at the end of the input is emitted too.

    The order is (ingested_at, ``tie``); ``tie`` names a column without nulls that is unique. Groups are bounded by count, so no
    key is ever gathered whole. Null keys fail, or pass unaggregated (skip): those go to the context's side output
    "unaggregated".
    """
    v = _key(df, key, "body")
    df = df.withColumn("_key", F.when(v.col.isNotNull(), V.go_text(v)) if not v.missing else F.lit(None).cast("string"))
    passed = df.where(ok() & F.col("_key").isNull()).drop("_key") if on_null_key == "skip" else None
    if on_null_key == "skip":
        df = df.where(~ok() | F.col("_key").isNotNull())
    else:
        df = fail(df, F.col("_key").isNull(), "aggregate: correlation key is null", at, "aggregate")
    dead = df.where(~ok()).drop("_key")
    id_ = F.col(tie) if tie else F.lit(0)
    live = df.where(ok()).withColumns({"_t": F.coalesce(F.unix_micros("metadata.ingested_at"), F.lit(0)), "_id": id_.cast("string") if not tie else id_})
    if strategy == "count" and timeout_ms is None:
        n = F.row_number().over(Window.partitionBy("_key").orderBy("_t", "_id"))
        live, most = live.withColumn("_bucket", F.floor((n - 1) / count)), count
    elif strategy == "count":
        wait = timeout_ms if timeout_ms >= 100 else TIMEOUT_MS
        live, most = numbered(live, first_anchored(wait * 1000, count), "_bucket", bool(tie)), count
    elif strategy == "time_window":
        if window_ms < 100:
            raise ValueError("window_ms is at least 100")
        live, most = numbered(live, first_anchored(window_ms * 1000, max_messages), "_bucket", bool(tie)), max_messages
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    row = F.struct("_t", "_id", "body", "headers", "metadata")
    grouped = live.groupBy("_key", "_bucket").agg(F.array_sort(F.collect_list(row), _by_time).alias("rows"))
    full = F.size("rows") >= most
    trigger = F.when(full, F.lit("count_reached" if strategy == "count" else "max_messages_reached")).otherwise(F.lit("timeout" if strategy == "count" else "window_expired"))
    first = F.get("rows", F.lit(0))
    body = F.struct(
        F.transform("rows", lambda r: F.struct(r["body"].alias("body"), r["headers"].alias("headers"))).alias("messages"),
        F.col("_key").alias("correlation_key"),
        F.size("rows").alias("count"),
        first["metadata"]["ingested_at"].alias("first_ingested"),
        F.element_at("rows", -1)["metadata"]["ingested_at"].alias("last_ingested"),
        trigger.alias("completion_trigger"),
    )
    out = grouped.select(F.create_map().cast("map<string,string>").alias("headers"), body.alias("body"), first["metadata"].alias("metadata"), F.lit(None).cast(df.schema["_error"].dataType).alias("_error"))
    facet = F.struct(F.col("body.count").alias("input_count"), F.col("body.correlation_key").alias("correlation_key"), F.lit(strategy).alias("completion_strategy"), F.col("body.completion_trigger").alias("completion_trigger"))
    out = with_meta(out, aggregator_facet=facet)
    if output_expr:
        o = Compiler({f: Value(F.col(f"body.{f}"), t.dataType) for f, t in ((x.name, x) for x in out.schema["body"].dataType.fields)}).compile(output_expr)
        out = out.withColumn("body", o.col)
    kind = out.schema["body"].dataType
    out = out.unionByName(dead.withColumn("body", F.lit(None).cast(kind)).select("headers", "body", "metadata", "_error"))
    if passed is not None and ctx is not None:
        ctx.taps.append(("unaggregated", passed.drop("_error")))
    return out


def _by_time(a, b):
    return F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0)


def idempotent(df: DataFrame, key: str, ttl_minutes: int | None = TTL_MINUTES, tie: str | None = None, at: int = 0, ctx: Context | None = None) -> DataFrame:
    """The first message of a key passes; later ones within the time to live, counted from the accepted one, are
    dropped. ``ttl_minutes=None``: for good. A null key is a key like any other. Failed messages pass."""
    v = compile_on(df, key, functions=ctx and ctx.functions)
    df = df.withColumns({"_key": V.go_text(v), "_t": F.coalesce(F.unix_micros("metadata.ingested_at"), F.lit(0)), "_id": F.col(tie) if tie else F.lit(0)})
    live, dead = df.where(ok()), df.where(~ok()).drop("_key", "_t", "_id")
    if ttl_minutes is None:
        live = live.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_t", "_id"))).where("_n = 1").drop("_n")
    else:
        rule = accepted(ttl_minutes * 60_000_000)
        if tie:
            live = live.join(fold(live.select("_key", "_t", "_id"), rule, "_keep").where("_keep = 1").select("_id"), "_id", "left_semi")
        else:
            live = fold(live, rule, "_keep").where("_keep = 1").drop("_keep")
    return live.drop("_key", "_t", "_id").unionByName(dead)


def seen_before(df: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Drops messages whose key is in a table of seen keys (dedup_key, expires_at) that has not expired."""
    v = compile_on(df, key)
    at = F.col("metadata.ingested_at")
    s = store.select(F.col("dedup_key").alias("_k"), F.col("expires_at").alias("_e"))
    return df.join(s, (V.go_text(v) == F.col("_k")) & (at < F.col("_e")), "left_anti")


def rate_limit(df: DataFrame, domain: str, limit: int, window_ms: int = 1000, tie: str | None = None) -> DataFrame:
    """Adds ``admitted``: whether a message is within its domain's limit in the fixed window that the first message
    opens. A limit of 0 admits all."""
    out = df.withColumns({"_key": F.col(domain).cast("string"), "_t": F.coalesce(F.unix_micros("metadata.ingested_at"), F.lit(0)), "_id": F.col(tie) if tie else F.lit(0)})
    out = numbered(out, limited(window_ms * 1000, limit), "_in", bool(tie))
    return out.withColumn("admitted", F.col("_in") == 1).drop("_key", "_t", "_id", "_in")
