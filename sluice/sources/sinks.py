"""Sinks: JSON lines, topics, databases, object stores, HTTP, exports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """Whole messages as JSON, one a row."""
    return df.select(F.to_json(F.struct(*(c for c in ("headers", "body", "metadata") if c in df.columns))).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "append", by_route: bool = False) -> None:
    out = json_lines(df)
    if by_route:
        out = df.select(F.to_json(F.struct("headers", "body", "metadata")).alias("value"), F.coalesce("metadata.route", F.lit("output")).alias("route"))
        out.write.mode(mode).partitionBy("route").text(path)
    else:
        out.write.mode(mode).text(path)


def kafka_rows(df: DataFrame, topic: str | None = None) -> DataFrame:
    """key, value and headers for a Kafka writer: strings as they are, other bodies as JSON; the key from kafka_key,
    headers without those the source set."""
    kind = df.schema["body"].dataType.simpleString()
    value = F.col("body") if kind in ("string", "binary") else F.to_json("body")
    keep = F.map_filter("headers", lambda k, v: ~k.startswith("kafka_"))
    headers = F.transform(F.map_entries(keep), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    out = df.select(F.try_element_at("headers", F.lit("kafka_key")).alias("key"), value.cast("string").alias("value"), headers.alias("headers"))
    return out if topic is None else out.withColumn("topic", F.lit(topic))


def write_kafka(df: DataFrame, servers: str, topic: str, **options: str) -> None:
    kafka_rows(df, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").options(**options).save()


def amqp_rows(df: DataFrame, routing_header: str = "amqp_routing_key", default: str = "") -> DataFrame:
    """routing_key, value and delivery mode (persistent) for a topic exchange."""
    return df.select(F.coalesce(F.try_element_at("headers", F.lit(routing_header)), F.lit(default)).alias("routing_key"), F.to_json("body").alias("value"), F.lit(2).alias("delivery_mode"))


def object_rows(df: DataFrame, prefix: str) -> DataFrame:
    """(key, value) of objects, one a message: the key holds a hash of the message, so writes don't overwrite others."""
    value = F.to_json(F.struct("headers", "body", "metadata"))
    return df.select(F.concat(F.lit(prefix.rstrip("/") + "/"), F.sha2(value.cast("binary"), 256), F.lit(".json")).alias("key"), value.alias("value"))


def columns_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Body fields as columns; a field that is missing is NULL."""
    names = df.schema["body"].dataType.fieldNames()
    return df.select(*((F.col(f"body.`{c}`") if c in names else F.lit(None).cast("string")).alias(c) for c in columns))


def insert_jdbc(df: DataFrame, url: str, table: str, columns: list[str], batch: int = 50, **options: str) -> None:
    columns_of(df, columns).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: the newest change of each key replaces the target's row, all columns of it."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    last = changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(target.columns)
    return target.join(last.select(*keys), keys, "left_anti").select(target.columns).unionByName(last)


def http_requests(df: DataFrame, token: Column | None = None) -> DataFrame:
    """(body, headers) of POSTs: a bearer token and the correlation id."""
    bearer = F.col("metadata.principal.token") if token is None else token
    h = F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("X-Correlation-ID"), F.col("metadata.correlation_id"), F.lit("Authorization"), F.concat(F.lit("Bearer "), bearer))
    return df.select(F.to_json("body").alias("body"), F.map_filter(h, lambda k, v: v.isNotNull()).alias("headers"))


def post(requests: DataFrame, send: Callable[[str, dict], int], batch: int = 100, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Sends (body, headers) rows; (body, status, attempts, ok). 4xx is final, other failures are tried again. ``send``
    returns a status and runs on executors, so it must be picklable and its effect repeatable."""

    def run(batches):
        import time

        import pyarrow as pa

        for b in batches:
            status, attempts = [], []
            for body, headers in zip(b.column("body").to_pylist(), b.column("headers").to_pylist()):
                for n in range(1, tries + 1):
                    try:
                        s = send(body, dict(headers or ()))
                    except OSError:
                        s = 599
                    if s < 500:
                        break
                    if n < tries:
                        time.sleep(wait * 2 ** (n - 1))
                status.append(s)
                attempts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("body"), pa.array(status, pa.int32()), pa.array(attempts, pa.int32()), pa.array([x < 400 for x in status])], names=["body", "status", "attempts", "ok"])

    return requests.mapInArrow(run, "body string, status int, attempts int, ok boolean")


def exchange_token(subject: Column, roles: Column, audience: str, secret: str, issued_at: Column, ttl_seconds: int = 300) -> Column:
    """A token issued on behalf of a subject, for one audience: HS256, in Arrow batches."""
    @F.pandas_udf("string")
    def issue(claims):
        import base64
        import hashlib
        import hmac

        enc = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
        head = enc(b'{"alg":"HS256","typ":"JWT"}')

        def one(c):
            if c is None:
                return None
            text = f"{head}.{enc(c.encode())}"
            return f"{text}.{enc(hmac.new(secret.encode(), text.encode(), hashlib.sha256).digest())}"

        return claims.map(one)

    at = F.unix_timestamp(issued_at)
    claims = F.to_json(F.struct(subject.alias("sub"), roles.alias("roles"), F.lit(audience).alias("aud"), at.alias("iat"), (at + ttl_seconds).alias("exp")))
    return issue(F.when(subject.isNotNull(), claims))


def purge_log_rows(events: DataFrame, route: str) -> DataFrame:
    """Purge evidence with the day and route it is filed under."""
    return events.withColumns({"year": F.date_format("purged_at", "yyyy"), "month": F.date_format("purged_at", "MM"), "day": F.date_format("purged_at", "dd"), "route": F.lit(route)})


def write_purge_log(events: DataFrame, path: str, route: str) -> None:
    """Purge evidence as JSON, by day."""
    purge_log_rows(events, route).write.mode("append").partitionBy("year", "month", "day", "route").json(path)


def write_objects(df: DataFrame, prefix: str, put: Callable[[str, bytes], None]) -> DataFrame:
    """Puts each message as an object of its own; (key, bytes) of what was put. ``put`` runs on executors; a repeated task
    puts the same bytes under the same keys. The result is lazy: objects are put when it is written or counted."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = []
            for key, value in zip(b.column("key").to_pylist(), b.column("value").to_pylist()):
                raw = value.encode()
                put(key, raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64())], names=["key", "bytes"])

    return object_rows(df, prefix).mapInArrow(run, "key string, bytes long")


def emit_openlineage(events: DataFrame, send: Callable[[str, dict], int], batch: int = 100, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Posts run events (event: JSON) ``batch`` at a time as {"events": [...]}; (event, status, attempts, ok), those that
    are not ok for the dead letters. 4xx is final, other failures are tried again after waits that double. In a stream,
    a trigger of five seconds bounds how long an event waits."""

    def run(batches):
        import pyarrow as pa

        held: list[str] = []

        def flush():
            payload = '{"events":[' + ",".join(held) + "]}"
            status, n = 599, 0
            for n in range(1, tries + 1):
                if n > 1:
                    time.sleep(wait * 2 ** (n - 2))
                try:
                    status = send(payload, {"Content-Type": "application/json"})
                except OSError:
                    status = 599
                if status < 500:
                    break
            k = len(held)
            out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([status] * k, pa.int32()), pa.array([n] * k, pa.int32()), pa.array([200 <= status < 300] * k)], names=["event", "status", "attempts", "ok"])
            held.clear()
            return out

        for b in batches:
            for event in b.column("event").to_pylist():
                held.append(event)
                if len(held) == batch:
                    yield flush()
        if held:
            yield flush()

    return events.select("event").mapInArrow(run, "event string, status int, attempts int, ok boolean")
