"""Sources: DataFrames of envelopes, batch or streaming, from files, topics, databases and change logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.envelope import envelope


class SourceUnavailable(RuntimeError):
    """The source needs a connector that is not on the class path."""


# -- files: local, sftp mounts, object stores --------------------------------------------------------------------------


def file_messages(spark: SparkSession, path: str, seen: DataFrame | None = None, skip_empty: bool = True, settle_seconds: float = 1.0, now: Column | None = None) -> DataFrame:
    """Each whole file is a message, its text the body. ``seen`` (source_path, modified) are files that were taken
    before: unchanged ones are left out, changed ones come again. Files touched within the settle time wait."""
    df = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("n"), F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_size").alias("s"))
    if skip_empty:
        df = df.where("s > 0")
    if settle_seconds:
        df = df.where(F.col("m") <= F.timestamp_add("SECOND", F.lit(-int(settle_seconds)), F.current_timestamp() if now is None else now))
    if seen is not None:
        s = seen.select(F.col("source_path").alias("_p"), F.col("modified").alias("_m"))
        df = df.join(s, (F.col("p") == F.col("_p")) & (F.col("m") == F.col("_m")), "left_anti")
    return envelope(df, F.col("value"), F.create_map(F.lit("source_file"), F.col("n"), F.lit("source_path"), F.col("p")), ingested_at=F.col("m"), correlation_id=F.sha2(F.concat_ws("|", "p", "m").cast("binary"), 256))


def file_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    df = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(path)
    df = df.select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("n"), F.col("_metadata.file_modification_time").alias("m"))
    return envelope(df, F.col("value"), F.create_map(F.lit("source_file"), F.col("n"), F.lit("source_path"), F.col("p")), ingested_at=F.col("m"), correlation_id=F.sha2(F.concat_ws("|", "p", "m").cast("binary"), 256))


def object_messages(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """Objects below a store's path: JSON if it parses, else a string; headers s3_bucket, s3_key, s3_size."""
    df = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_size").alias("s")).where("s > 0")
    if seen is not None:
        k = seen.select(F.col("source_path").alias("_p"), F.col("modified").alias("_m"))
        df = df.join(k, (F.col("p") == F.col("_p")) & (F.col("m") == F.col("_m")), "left_anti")
    bucket, key = F.regexp_extract("p", r"^[a-z0-9]+:/*([^/]*)", 1), F.regexp_extract("p", r"^[a-z0-9]+:/*[^/]*/(.*)$", 1)
    return envelope(df, json_or_text(F.col("value")), F.create_map(F.lit("s3_bucket"), bucket, F.lit("s3_key"), key, F.lit("s3_size"), F.col("s").cast("string")), ingested_at=F.col("m"))


def json_or_text(value: Column) -> Column:
    """Parsed JSON, else the text, as a variant."""
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def parquet_messages(spark: SparkSession, path: str, **meta) -> DataFrame:
    """A table with a schema: bodies are structs, so projections and filters reach the scan."""
    return envelope(spark.read.parquet(path), **meta)


# -- http: requests that were landed as rows ---------------------------------------------------------------------------


def detect_route(header: Column, query: Column, path: Column) -> Column:
    """X-Route header, else the query's route, else the path's segment after /ingest/."""
    segment = F.regexp_extract(path, r"^/ingest/([^/?]+)", 1)
    return F.coalesce(F.nullif(header, F.lit("")), F.nullif(query, F.lit("")), F.nullif(segment, F.lit("")))


def http_messages(requests: DataFrame, require_auth: bool = False, principals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, responses) of landed requests (method, path, query, headers, body, received_at). Responses: 405 for
    other methods than POST and GET, 401 for missing or unknown tokens, 400 for bodies that are no JSON, else 202."""
    h = F.col("headers")
    token = F.regexp_extract(F.coalesce(F.try_element_at(h, F.lit("Authorization")), F.lit("")), r"^Bearer\s+(\S+)$", 1)
    body = F.try_parse_json("body")
    df = requests.withColumns({"_token": token, "_body": body})
    if principals is not None:
        # a token that is listed several times stands for the first of its principals, as JSON sorts them
        known = principals.where("token IS NOT NULL").groupBy(F.col("token").alias("_t")).agg(F.min_by("principal", F.to_json("principal")).alias("_principal"))
        df = df.join(known, F.col("_token") == F.col("_t"), "left").drop("_t")
    else:
        df = df.withColumn("_principal", F.lit(None).cast("struct<subject:string,roles:array<string>,claims:map<string,string>,token:string>"))
    status = F.when(~F.col("method").isin("POST", "GET"), 405)
    if require_auth:
        status = status.when(F.col("_principal").isNull(), 401)
    status = status.when(F.col("_body").isNull(), 400).otherwise(202)
    df = df.withColumn("status", status)
    good = df.where("status = 202")
    route = detect_route(F.try_element_at(h, F.lit("X-Route")), F.regexp_extract(F.coalesce("query", F.lit("")), r"(?:^|&)route=([^&]*)", 1), F.col("path"))
    return envelope(good, F.col("_body"), h, route=route, principal=F.col("_principal"), ingested_at=F.col("received_at")), df.drop("_body", "_token", "_principal")


_CLAIMS = "map<string,string>"
# fixed values: claims that don't become attributes
STANDARD_CLAIMS = ("iss", "sub", "aud", "exp", "nbf", "iat", "jti", "roles")


def jwt_principal(token: Column, secret: str | None = None, now: Column | None = None, rsa: tuple[int, int] | None = None, unsigned: bool = False) -> Column:
    """A principal of a JWT; NULL if it is malformed, expired, has no subject, or its signature doesn't fit: HS256 with a
    ``secret``, RS256 with an ``rsa`` key (modulus, exponent). Only ``unsigned=True`` passes tokens unverified."""
    if secret is None and rsa is None and not unsigned:
        raise ValueError("a secret or an RSA key is needed, or unsigned=True")
    part = lambda i: F.replace(F.replace(F.get(F.split(token, r"\."), F.lit(i)), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    padded = lambda s: F.concat(s, F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)).cast("int")))
    decoded = lambda i: F.try_to_binary(padded(part(i)), F.lit("base64"))
    claims = F.try_parse_json(decoded(1).cast("string"))
    text = lambda n: F.try_variant_get(claims, f"$.{n}", "string")
    roles = F.coalesce(F.try_variant_get(claims, "$.roles", "array<string>"), F.when(F.schema_of_variant(F.try_variant_get(claims, "$.roles", "variant")) == "STRING", F.array(text("roles"))), F.array().cast("array<string>"))
    other = F.map_filter(F.coalesce(F.try_variant_get(claims, "$", _CLAIMS), F.create_map().cast(_CLAIMS)), lambda k, v: ~k.isin(*STANDARD_CLAIMS) & v.isNotNull())
    exp = F.try_variant_get(claims, "$.exp", "double")
    ok = text("sub").isNotNull() & (exp.isNull() | (exp > F.unix_timestamp(F.current_timestamp() if now is None else now)))
    if secret is not None or rsa is not None:
        algorithm = F.try_variant_get(F.try_parse_json(decoded(0).cast("string")), "$.alg", "string")
        signed = F.regexp_extract(token, r"^([^.]*\.[^.]*)\.[^.]*$", 1)
        fits = F.lit(False)
        if secret is not None:
            fits = F.when(algorithm == "HS256", F.lower(F.hex(decoded(2))) == hmac_sha256(secret, signed)).otherwise(fits)
        if rsa is not None:
            fits = F.when(algorithm == "RS256", rsa_sha256(*rsa)(signed, decoded(2))).otherwise(fits)
        ok = ok & F.coalesce(fits, F.lit(False))
    return F.when(ok, F.struct(text("sub").alias("subject"), roles.alias("roles"), other.alias("claims"), token.alias("token")))


def hmac_sha256(secret: str, text: Column) -> Column:
    """HMAC-SHA256 of a text in lower-case hex."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


# fixed value: what stands before a SHA-256 digest in a signature of PKCS #1 v1.5
_DIGEST_INFO = bytes.fromhex("3031300d060960864801650304020105000420")


def rsa_sha256(modulus: int, exponent: int):
    """Whether a signature (binary) of a text fits an RSA key, by PKCS #1 v1.5 with SHA-256; in Arrow batches, as numbers
    of that size have no built-in functions."""
    size = (modulus.bit_length() + 7) // 8

    @F.pandas_udf("boolean")
    def fits(texts, signatures):
        import hashlib

        import pandas as pd

        def one(text, signature):
            if text is None or signature is None or len(signature) != size:
                return False
            want = _DIGEST_INFO + hashlib.sha256(text.encode()).digest()
            want = b"\0\1" + b"\xff" * (size - len(want) - 3) + b"\0" + want
            return pow(int.from_bytes(signature, "big"), exponent, modulus) == int.from_bytes(want, "big")

        return pd.Series([one(t, s) for t, s in zip(texts, signatures)], dtype=bool)

    return fits


# -- topics ------------------------------------------------------------------------------------------------------------


def kafka_envelope(df: DataFrame) -> DataFrame:
    """Envelopes of a Kafka source's rows (key, value, topic, partition, offset, timestamp, headers)."""
    fixed = F.create_map(F.lit("kafka_topic"), F.col("topic"), F.lit("kafka_partition"), F.col("partition").cast("string"), F.lit("kafka_offset"), F.col("offset").cast("string"), F.lit("kafka_timestamp"), F.col("timestamp").cast("string"), F.lit("kafka_key"), F.col("key").cast("string"))
    headers = fixed
    if "headers" in df.columns:
        own = F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.struct(F.concat(F.lit("kafka_header_"), h["key"]), h["value"].cast("string"))))
        headers = F.map_concat(fixed, own)
    headers = F.map_filter(headers, lambda k, v: v.isNotNull())
    return envelope(df, json_or_text(F.col("value").cast("string")), headers, ingested_at=F.col("timestamp"), correlation_id=F.concat_ws("-", "topic", "partition", "offset"))


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_batch: int | None = None, **options: str) -> DataFrame:
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("includeHeaders", True)
    if per_batch:
        r = r.option("maxOffsetsPerTrigger", per_batch)
    try:
        return kafka_envelope(r.options(**options).load())
    except AnalysisException as e:
        if "Failed to find data source" not in str(e) and "DATA_SOURCE_NOT_FOUND" not in str(e):
            raise
        raise SourceUnavailable("the Kafka connector is not on the class path") from e


def amqp_envelope(df: DataFrame) -> DataFrame:
    """Envelopes of queue deliveries that a connector landed (routing_key, exchange, delivery_tag, properties, body)."""
    headers = F.create_map(F.lit("amqp_routing_key"), F.col("routing_key"), F.lit("amqp_exchange"), F.col("exchange"), F.lit("amqp_delivery_tag"), F.col("delivery_tag").cast("string"))
    return envelope(df, json_or_text(F.col("body")), F.map_filter(headers, lambda k, v: v.isNotNull()))


# -- databases ---------------------------------------------------------------------------------------------------------


def watermark_poll(rows: DataFrame, column: str, last=None, limit: int | None = None) -> tuple[DataFrame, Column]:
    """(rows after the watermark in its order, the new watermark as an aggregate of them)."""
    out = rows if last is None else rows.where(F.col(column) > F.lit(last))
    out = out.orderBy(column)
    return (out if limit is None else out.limit(limit)), F.max(column)


def jdbc_poll(spark: SparkSession, url: str, query: str, column: str, last=None, partitions: int | None = None, lower=None, upper=None, **options: str) -> DataFrame:
    """A database table or query by JDBC; the watermark filter is pushed to the database."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    r = r.option("dbtable", f"({query}) q") if partitions else r.option("query", query)
    if partitions:
        r = r.option("partitionColumn", column).option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", partitions)
    return envelope(watermark_poll(r.load(), column, last)[0])


def changelog_page(log: DataFrame, watermark: str, last, limit: int) -> DataFrame:
    """A page of a trigger's change log: table_name, operation, record_id, changed_at, before_state, after_state."""
    page = log.where(F.col(watermark) > F.lit(last)).orderBy(watermark, "record_id").limit(limit)
    return page.select("table_name", "operation", "record_id", "changed_at", "before_state", "after_state")


# fixed values: Debezium's operation codes
DEBEZIUM = {"c": "INSERT", "u": "UPDATE", "d": "DELETE", "r": "READ"}


_EVENT = "op string, type string, ts_ms bigint, ts bigint, table string, source struct<table:string>, before string, after string, old string, data string, _bad string"


def _of_event(text: Column, build) -> Column:
    """``build`` of a change event with its states as JSON text; NULL if it is no JSON. The event is bound by a lambda, so
    that it is parsed once, however often ``build`` names it."""
    parsed = F.from_json(text, _EVENT, {"columnNameOfCorruptRecord": "_bad"})
    return F.get(F.transform(F.array(parsed), lambda e: F.when(e.isNotNull() & e["_bad"].isNull(), build(e))), F.lit(0))


def _state(c: Column) -> Column:
    """A state's JSON if it has fields, else NULL."""
    return F.when(~F.trim(c).isin("{}", "null", ""), c)


def debezium(text: Column) -> Column:
    """struct<table, operation, timestamp, before, after> of a Debezium event; NULL if it is no JSON."""
    table = F.create_map(*(F.lit(x) for kv in DEBEZIUM.items() for x in kv))
    op = lambda e: F.coalesce(F.try_element_at(table, e["op"]), e["op"])
    return _of_event(text, lambda e: F.struct(e["source"]["table"].alias("table"), op(e).alias("operation"), e["ts_ms"].alias("timestamp"), _state(e["before"]).alias("before"), _state(e["after"]).alias("after")))


def maxwell(text: Column) -> Column:
    """The same of a Maxwell event; its operation stays as it is."""
    return _of_event(text, lambda e: F.struct(e["table"].alias("table"), e["type"].alias("operation"), e["ts"].alias("timestamp"), _state(e["old"]).alias("before"), _state(e["data"]).alias("after")))


# -- dead letters ------------------------------------------------------------------------------------------------------

DEAD = "original_message string, error string, failed_step int, failed_step_type string, retry_attempt int, processed_at string"


_DEAD_LETTER = f"headers map<string,string>, body struct<{DEAD.replace(' string', ':string').replace(' int', ':int')}>, metadata struct<correlation_id:string,route:string,stage:string,replay_count:int>"


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Dead-letter files, a JSON message a line."""
    return spark.read.schema(_DEAD_LETTER).json(path)


def parse_dead_letters(lines: DataFrame) -> DataFrame:
    """Dead letters of lines (value), from wherever they were kept. Lines that are no JSON are left out."""
    d = F.from_json("value", _DEAD_LETTER, {"mode": "PERMISSIVE"})
    return lines.select(d.alias("d")).where("d.body.error IS NOT NULL").select("d.*")


def replay(dead: DataFrame, limit: int | None = 100, where: Column | None = None, initiator: str = "replay", now: Column | None = None, dry_run: bool = False, parallelism: int | None = None) -> DataFrame:
    """Messages of dead letters to run again, the replay counted: the oldest ``limit``, or all if it is None. A dry run
    tells instead what would be replayed: correlation_id, route, replay_count, error. ``parallelism``: partitions that
    the messages are dealt to."""
    d = dead if where is None else dead.where(where)
    d = d if limit is None else d.orderBy("body.processed_at", "metadata.correlation_id").limit(limit)
    n = F.coalesce("metadata.replay_count", F.lit(0)) + 1
    if dry_run:
        return d.select(F.col("metadata.correlation_id").alias("correlation_id"), F.col("metadata.route").alias("route"), n.alias("replay_count"), F.col("body.error").alias("error"))
    d = d if parallelism is None else d.repartition(parallelism)
    original = F.try_parse_json("body.original_message")
    entry = F.array(F.struct((F.current_timestamp() if now is None else now).alias("timestamp"), n.alias("attempt"), F.lit(initiator).alias("initiator")))
    return envelope(d, F.try_variant_get(original, "$.body", "variant"), F.coalesce(F.try_variant_get(original, "$.headers", "map<string,string>"), F.col("headers")), correlation_id=F.col("metadata.correlation_id"), route=F.col("metadata.route"), replay_count=n, replay_history=entry)


def schema_of(contract: dict) -> T.DataType:
    from sluice.operators.contracts import spark_type

    return spark_type(contract)
