"""Runs a route over a stream: the batch plan where it is stateless, keyed state with timers where it is not."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.functions import values as V
from sluice.operators import stateful
from sluice.operators.envelope import compile_on
from sluice.plans.route import Result, Route
from sluice.sources.sinks import json_lines

Writer = Callable[[Result, int], None]


def run_route(stream: DataFrame, route: Route, write: Writer, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Applies the route to each micro-batch and hands messages and dead letters to ``write(result, batch_id)``, which
    must be repeatable for a batch id. Stateful steps see one batch at a time here; ``deduplicated`` and ``aggregated``
    put keyed state in front of the route instead."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(route.apply(batch), batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def json_writer(path: str, dead_path: str) -> Writer:
    """Writes JSON lines, a folder for each batch, so that a repeated batch replaces its own output."""

    def write(result: Result, batch_id: int) -> None:
        json_lines(result.ok).write.mode("overwrite").text(f"{path}/batch={batch_id}")
        json_lines(result.dead).write.mode("overwrite").text(f"{dead_path}/batch={batch_id}")
        for name, df in result.taps:
            json_lines(df).write.mode("overwrite").text(f"{path}-{name}/batch={batch_id}")

    return write


def _keyed(stream: DataFrame, key: str) -> DataFrame:
    v = compile_on(stream, key)
    return stream.select(V.go_text(v).alias("key"), F.unix_micros("metadata.ingested_at").alias("t"), F.to_json(F.struct("headers", "body", "metadata")).alias("message"))


class _Accept:
    """The last accepted time of a key is its state; time to live counts from it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def __call__(self, key, frames, state: GroupState):
        rows = pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable")
        last = state.get[0] if state.exists else None
        keep, last = stateful.accepted(self.ttl)(rows["t"].to_numpy(), last)
        state.update((int(last),))
        yield rows[keep == 1][["key", "t", "message"]]


def deduplicated(stream: DataFrame, key: str, ttl_minutes: int = stateful.TTL_MINUTES) -> DataFrame:
    """(key, t, message) of the first message of each key within the time to live, over all batches."""
    return _keyed(stream, key).groupBy("key").applyInPandasWithState(_Accept(ttl_minutes * 60_000_000), "key string, t long, message string", "last long", "append", GroupStateTimeout.NoTimeout)


class _Collect:
    """Open messages of a key are its state; a group goes out when it is full or its time is over."""

    def __init__(self, count: int, wait_ms: int, full: str, over: str):
        self.count, self.wait_ms, self.full, self.over = count, wait_ms, full, over

    def _out(self, key, open_, trigger):
        return {"key": key, "count": len(open_), "first_t": open_[0][0], "last_t": open_[-1][0], "trigger": trigger, "messages": [m for _, m in open_]}

    def __call__(self, key, frames, state: GroupState):
        ts, messages, out = [], [], []
        if state.exists:
            ts, messages = list(state.get[0]), list(state.get[1])
        open_ = list(zip(ts, messages))
        if state.hasTimedOut:
            out.append(self._out(key[0], open_, self.over))
            state.remove()
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable")
            for t, m in zip(rows["t"].tolist(), rows["message"]):
                if open_ and t >= open_[0][0] + self.wait_ms * 1000:
                    out.append(self._out(key[0], open_, self.over))
                    open_ = []
                open_.append((t, m))
                if len(open_) >= self.count:
                    out.append(self._out(key[0], open_, self.full))
                    open_ = []
            if open_:
                state.update(([t for t, _ in open_], [m for _, m in open_]))
                state.setTimeoutDuration(self.wait_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["key", "count", "first_t", "last_t", "trigger", "messages"])


def aggregated(stream: DataFrame, key: str, strategy: str = "count", count: int = 1, timeout_ms: int = stateful.TIMEOUT_MS, window_ms: int = 0, max_messages: int = stateful.MAX_MESSAGES) -> DataFrame:
    """(key, count, first_t, last_t, trigger, messages) of groups, over all batches; timers run in processing time."""
    c = _Collect(count, timeout_ms, "count_reached", "timeout") if strategy == "count" else _Collect(max_messages, window_ms, "max_messages_reached", "window_expired")
    return _keyed(stream, key).groupBy("key").applyInPandasWithState(
        c, "key string, count int, first_t long, last_t long, trigger string, messages array<string>", "ts array<long>, messages array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def rates(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Messages a minute by route, by ingest time, with a watermark."""
    s = stream.select(F.col("metadata.ingested_at").alias("ts"), F.col("metadata.route").alias("route")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", "1 minute").alias("w"), "route").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "route", "n")


def swap(query: StreamingQuery, start: Callable[[], StreamingQuery], wait_seconds: int = 30) -> StreamingQuery:
    """Hot reload: the running batch ends, then the new plan goes on from the same checkpoint."""
    query.stop()
    query.awaitTermination(wait_seconds)
    return start()
