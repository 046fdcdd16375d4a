"""Queries over the test tables, one for each operator, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import values as V
from sluice.functions.registry import Function, Registry
from sluice.operators import errors, lineage, metrics, stateful, steps
from sluice.operators.envelope import alive, compile_on, dead_letters, envelope
from sluice.plans import checks, config
from sluice.plans.route import Route, fan_out
from sluice.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, **meta) -> DataFrame:
    e = table(spark, d, "events")
    return envelope(e, keep=("event_id",), ingested_at=F.col("ts").cast("timestamp"), correlation_id=F.col("event_id").cast("string"), **meta)


def messages(spark: SparkSession, d: str, name: str, body=None, **meta) -> DataFrame:
    return envelope(table(spark, d, name), body, **meta)


def body(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(f"body.{n}").alias(n) for n in names))


# -- filter, translate -------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events WHERE value > 100 AND event_type = 'purchase'")
def filter_predicate(spark, d):
    df = steps.filter_rows(messages(spark, d, "events"), 'body.value > 100 and body.event_type = "purchase"')
    return body(alive(df), "event_id", "user_id", "value")


@query("""SELECT event_id, coalesce(CASE WHEN value > 200 THEN value ELSE 0 END, 0) <> 0 AS by_number, CASE WHEN event_type = 'click' THEN '' ELSE event_type END <> '' AS by_text,
event_type = 'view' AS by_boolean, false AS by_missing, true AS by_empty_array, true AS by_object FROM events""")
def filter_truthy(spark, d):
    df = messages(spark, d, "events")
    cols = {
        "by_number": "body.value > 200 ? body.value : 0",
        "by_text": 'body.event_type = "click" ? "" : body.event_type',
        "by_boolean": 'body.event_type = "view"',
        "by_missing": "body.nothing",
        "by_empty_array": "[]",
        "by_object": '{"a": body.value}',
    }
    return df.select(F.col("body.event_id").alias("event_id"), *(V.truthy(compile_on(df, e)).alias(n) for n, e in cols.items()))


@query("SELECT o_orderkey AS order_id, round(o_totalprice / 100, 4) AS total, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS tier, 'Order ' || o_orderkey || ' is ' || o_orderstatus AS label FROM orders")
def translate_object(spark, d):
    df = steps.translate(messages(spark, d, "orders"), '{"order_id": body.o_orderkey, "total": body.o_totalprice / 100, "tier": body.o_totalprice > 200000 ? "high" : "low", "label": "Order " & body.o_orderkey & " is " & body.o_orderstatus}')
    return body(df, "order_id", "total", "tier", "label").withColumn("total", F.round("total", 4))


def order_items(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")).alias("i"))
    return envelope(li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items")).select(F.col("l_orderkey").alias("order_id"), "items"))


@query("""SELECT l_orderkey AS order_id, round(sum(l_extendedprice * l_quantity), 2) AS total, count(*) AS n, max(l_quantity) AS most, min(l_extendedprice) AS least,
round(avg(l_quantity), 4) AS average FROM lineitem GROUP BY l_orderkey""")
def translate_array_sum(spark, d):
    df = steps.translate(
        order_items(spark, d),
        '{"order_id": body.order_id, "total": $sum(body.items.(price * quantity)), "n": $count(body.items), "most": $max(body.items.quantity), "least": $min(body.items.price), "average": $average(body.items.quantity)}',
    )
    return body(df, "order_id", "total", "n", "most", "least", "average").withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substr(p_type, 1, 4) AS head, right(p_type, 3) AS tail, length(p_name) AS n,
CASE WHEN instr(p_type, ' ') > 0 THEN substr(p_type, 1, instr(p_type, ' ') - 1) ELSE p_type END AS before_space,
CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE p_name END AS after_space,
contains(p_name, 'a') AS has_a, replace(p_name, ' ', '-') AS dashed, lpad(p_brand, CAST(greatest(14, length(p_brand)) AS INT), '.') AS padded, regexp_matches(p_type, '^[A-M]') AS early FROM part""")
def translate_string_fns(spark, d):
    expr = """{"p_partkey": body.p_partkey, "up": $uppercase(body.p_name), "low": $lowercase(body.p_brand), "head": $substring(body.p_type, 0, 4), "tail": $substring(body.p_type, -3),
    "n": $length(body.p_name), "before_space": $substringBefore(body.p_type, " "), "after_space": $substringAfter(body.p_name, " "), "has_a": $contains(body.p_name, "a"),
    "dashed": $join($split(body.p_name, " "), "-"), "padded": $pad(body.p_brand, -14, "."), "early": $contains(body.p_type, /^[A-M]/)}"""
    df = steps.translate(messages(spark, d, "part"), expr)
    return body(df, "p_partkey", "up", "low", "head", "tail", "n", "before_space", "after_space", "has_a", "dashed", "padded", "early")


@query("SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k, CAST(props->>'$.k' AS DOUBLE) > 50 AS big FROM events")
def translate_json_props(spark, d):
    e = table(spark, d, "events")
    df = envelope(e, F.try_parse_json("props"), F.create_map(F.lit("id"), F.col("event_id").cast("string")))
    df = steps.translate(df, '{"event_id": $number(headers.id), "k": $number(body.k), "big": body.k > 50}')
    return body(df, "event_id", "k", "big").withColumn("event_id", F.col("event_id").cast("bigint"))


@query("""SELECT l_orderkey AS order_id, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS big, round(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END), 2) AS big_total,
arg_max(l_linenumber, (l_extendedprice, -l_linenumber))::BIGINT AS dearest, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
CAST(sum(l_linenumber) AS DOUBLE) AS folded FROM lineitem GROUP BY l_orderkey""")
def translate_lambdas(spark, d):
    expr = """($big := body.items[quantity > 25]; {"order_id": body.order_id, "big": $count($big), "big_total": $sum($map($big, function($i) { $i.price })),
    "dearest": body.items^(>price, line)[0].line, "flags": $join($sort($distinct(body.items.flag)), ","), "folded": $reduce(body.items.line, function($a, $b) { $a + $b }, 0)})"""
    df = steps.translate(order_items(spark, d), expr)
    return body(df, "order_id", "big", "big_total", "dearest", "flags", "folded").withColumns({"big_total": F.round("big_total", 2)})


@query("""SELECT l_orderkey AS order_id, l_returnflag AS flag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL""")
def translate_group(spark, d):
    df = steps.translate(order_items(spark, d), '{"order_id": body.order_id, "by": body.items{flag: $sum(price)}}')
    out = df.select(F.col("body.order_id").alias("order_id"), F.explode("body.by").alias("flag", "total"))
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT event_id, round(value / 7, 2) AS rounded, floor(value) AS low, ceil(value) AS high, round(sqrt(value), 6) AS root, value % 7 AS rest,
CASE WHEN value > 100 AND user_id IN (1, 2, 3) THEN 'x' ELSE 'y' END AS side, CAST(CAST(value AS BIGINT) AS VARCHAR) || '!' AS text FROM (SELECT event_id, user_id, floor(value * 4) / 4 AS value FROM events)""")
def translate_numbers(spark, d):
    e = table(spark, d, "events").withColumn("value", F.floor(F.col("value") * 4) / 4)
    expr = """{"event_id": body.event_id, "rounded": $round(body.value / 7, 2), "low": $floor(body.value), "high": $ceil(body.value), "root": $sqrt(body.value), "rest": body.value % 7,
    "side": body.value > 100 and body.user_id in [1, 2, 3] ? "x" : "y", "text": $string($round(body.value + 0.00001)) & "!"}"""
    df = body(steps.translate(envelope(e), expr), "event_id", "rounded", "low", "high", "root", "rest", "side", "text")
    return df.withColumns({"root": F.round("root", 6), "rounded": F.round("rounded", 2)})


SQL["translate_numbers"] = SQL["translate_numbers"].replace("CAST(CAST(value AS BIGINT) AS VARCHAR)", "CAST(CAST(floor(value + 0.50001) AS BIGINT) AS VARCHAR)")


@query("SELECT event_id, round(value * 2 + 1, 6) AS doubled FROM events")
def custom_function(spark, d):
    r = Registry()
    r.register(Function("twice", ("double",), "double", lambda x: x * 2))
    df = messages(spark, d, "events")
    v = compile_on(df, "$twice(body.value) + 1", functions=r)
    return df.select(F.col("body.event_id").alias("event_id"), F.round(v.col, 6).alias("doubled"))


@query("SELECT event_id, round(sqrt(value) * 10, 6) AS scored FROM events")
def plugin_function(spark, d):
    r = Registry()

    @r.vectorized("score", ("double",), "double")
    def score(x):
        return x**0.5 * 10

    df = messages(spark, d, "events")
    return df.select(F.col("body.event_id").alias("event_id"), F.round(compile_on(df, "$score(body.value)", functions=r).col, 6).alias("scored"))


# -- route, wiretap, fan-out -------------------------------------------------------------------------------------------

CASES = {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"}


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '5-LOW' THEN 'slow' ELSE 'normal' END AS route FROM orders")
def route_cases(spark, d):
    df = steps.route(messages(spark, d, "orders"), "body.o_orderpriority", CASES, "normal")
    return df.select(F.col("body.o_orderkey").alias("o_orderkey"), F.col("metadata.route").alias("route"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '5-LOW' THEN 'slow' END AS route,
CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'no matching route for value: ' || o_orderpriority END AS error FROM orders""")
def route_default(spark, d):
    df = steps.route(messages(spark, d, "orders"), "body.o_orderpriority", CASES)
    return df.select(F.col("body.o_orderkey").alias("o_orderkey"), F.col("metadata.route").alias("route"), F.col("_error.error").alias("error"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS route, count(*) AS n FROM orders GROUP BY 1")
def route_counts(spark, d):
    df = steps.route(messages(spark, d, "orders"), "body.o_orderstatus", {"F": "final", "O": "open"}, "other")
    return alive(df).groupBy(F.col("metadata.route").alias("route")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.6f', s_acctbal) END AS as_number, CAST(s_suppkey AS VARCHAR) AS as_whole,
CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS as_boolean, 'null' AS as_null, s_suppkey FROM supplier""")
def result_to_string(spark, d):
    df = messages(spark, d, "supplier")
    e = {"as_number": "body.s_acctbal", "as_whole": "body.s_suppkey", "as_boolean": "body.s_acctbal > 0", "as_null": "body.nothing"}
    return df.select(F.col("body.s_suppkey").alias("s_suppkey"), *(V.go_text(compile_on(df, x)).alias(n) for n, x in e.items()))


@query("SELECT event_id, 'main' AS output FROM events WHERE value > 200 UNION ALL SELECT event_id, 'tap' FROM events")
def wiretap_copy(spark, d):
    ctx = steps.Context()
    df = steps.filter_rows(steps.wiretap(messages(spark, d, "events"), "tap", 0, ctx), "body.value > 200", 1, ctx)
    main = alive(df).select(F.col("body.event_id").alias("event_id"), F.lit("main").alias("output"))
    return main.union(ctx.taps[0][1].select("body.event_id", F.lit("tap")))


@query("SELECT event_id, 'all' AS route FROM events UNION ALL SELECT event_id, 'large' FROM events WHERE value > 200 UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'")
def fanout_routes(spark, d):
    df = fan_out(messages(spark, d, "events"), {"all": F.lit(True), "large": F.col("body.value") > 200, "errors": F.col("body.event_type") == "error"})
    return df.select(F.col("body.event_id").alias("event_id"), F.col("metadata.route").alias("route"))


# -- authorization, redaction ------------------------------------------------------------------------------------------


def with_principal(spark, d) -> DataFrame:
    roles = F.when(F.col("event_type") == "purchase", F.array(F.lit("buyer"), F.lit("user"))).when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit("user")))
    p = F.struct(F.concat(F.lit("u"), "user_id").alias("subject"), roles.alias("roles"), F.create_map(F.lit("tier"), F.when(F.col("user_id") % 2 == 0, "gold").otherwise("basic")).alias("claims"), F.lit(None).cast("string").alias("token"))
    return events(spark, d, principal=F.when(F.col("event_type") != "error", p))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'authorization_denied: no principal' WHEN event_type = 'purchase' THEN NULL ELSE 'authorization_denied: insufficient roles' END AS error FROM events""")
def authorize_rbac(spark, d):
    return steps.authorize(with_principal(spark, d), "rbac", ["buyer", "admin"]).select("event_id", F.col("_error.error").alias("error"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'authorization_denied: no principal' WHEN user_id % 2 = 0 AND value < 300 THEN NULL ELSE 'authorization_denied: policy evaluation failed' END AS error FROM events""")
def authorize_abac(spark, d):
    return steps.authorize(with_principal(spark, d), "abac", expr='principal.claims.tier = "gold" and body.value < 300').select("event_id", F.col("_error.error").alias("error"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'authorization_denied: blocked' ELSE 'authorization_denied: denied by policy' END AS error FROM customer""")
def authorize_pdp_table(spark, d):
    c = table(spark, d, "customer")
    p = F.struct(F.col("c_custkey").cast("string").alias("subject"), F.array().cast("array<string>").alias("roles"), F.create_map().cast("map<string,string>").alias("claims"), F.lit(None).cast("string").alias("token"))
    decisions = c.where("c_custkey % 5 < 2").select(F.col("c_custkey").cast("string").alias("subject"), (F.col("c_custkey") % 5 == 0).alias("allow"), F.lit("blocked").alias("reason"))
    df = steps.authorize(envelope(c, principal=p), "pbac", decisions=decisions)
    return df.select(F.col("body.c_custkey").alias("c_custkey"), F.col("_error.error").alias("error"))


@query("""SELECT c_custkey, '[REDACTED]' AS name, '[REDACTED]' AS segment, c_acctbal AS balance, '[REDACTED]' AS first_note, 'kept' AS second_note, 'customer.name,customer.segment,notes.text' AS fields FROM customer""")
def redact_fields(spark, d):
    c = table(spark, d, "customer")
    b = F.struct("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("customer"), F.array(F.struct(F.lit("secret").alias("text"), F.lit("kept").alias("other"))).alias("notes"))
    df = steps.redact(envelope(c, b), ["customer.name", "customer.segment", "notes.text"], "[REDACTED]", "deep")
    x = F.col("body.customer")
    return df.select(
        F.col("body.c_custkey").alias("c_custkey"), x["name"].alias("name"), x["segment"].alias("segment"), x["balance"].alias("balance"), F.get("body.notes", F.lit(0))["text"].alias("first_note"), F.get("body.notes", F.lit(0))["other"].alias("second_note"),
        F.array_join("metadata.obligation_facet.fields_redacted", ",").alias("fields"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'authorization_denied: denied by policy' WHEN c_custkey % 10 = 0 THEN 'authorization_denied: a' END AS error FROM customer""")
def authorize_pdp_repeated(spark, d):
    """Several decisions on a subject, also equal ones: messages stay as many as they are, and a denial wins."""
    c = table(spark, d, "customer")
    p = F.struct(F.col("c_custkey").cast("string").alias("subject"), F.array().cast("array<string>").alias("roles"), F.create_map().cast("map<string,string>").alias("claims"), F.lit(None).cast("string").alias("token"))
    s = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("subject"), "c_custkey")
    allow, deny = s.select("subject", F.lit(True).alias("allow"), F.lit("ok").alias("reason")), s.where("c_custkey % 10 = 0")
    decisions = allow.union(allow).union(deny.select("subject", F.lit(False), F.lit("b"))).union(deny.select("subject", F.lit(False), F.lit("a")))
    df = steps.authorize(envelope(c, principal=p), "pbac", decisions=decisions)
    return df.select(F.col("body.c_custkey").alias("c_custkey"), F.col("_error.error").alias("error"))


@query("SELECT event_id, '{\"k\":\"#\",\"list\":[{\"k\":\"#\",\"n\":1.5}],\"o\":{\"big\":12345678901234567890,\"k\":\"#\"}}' AS deep, '{\"k\":\"#\",\"list\":[{\"k\":1,\"n\":1.5}],\"o\":{\"big\":12345678901234567890,\"k\":2}}' AS shallow FROM events")
def redact_variant_paths(spark, d):
    """Paths through objects and arrays of a body without a schema; large numbers keep their digits."""
    text = F.lit('{"k": 0, "o": {"k": 2, "big": 12345678901234567890}, "list": [{"k": 1, "n": 1.5}]}')
    e = envelope(table(spark, d, "events"), F.parse_json(text), keep=("event_id",))
    deep = steps.redact(e, ["k", "o.k", "list.k", "o.none.k"], "#", "deep").select("event_id", F.to_json("body").alias("deep"))
    return deep.join(steps.redact(e, ["k", "list.k"], "#").select("event_id", F.to_json("body").alias("shallow")), "event_id")


@query("SELECT event_id, '***REDACTED***' AS k FROM events")
def redact_variant(spark, d):
    e = table(spark, d, "events")
    df = steps.redact(envelope(e, F.try_parse_json("props"), keep=("event_id",)), ["k", "nothing.here"])
    return df.select("event_id", F.try_variant_get("body", "$.k", "string").alias("k"))


# -- contracts, claim checks -------------------------------------------------------------------------------------------

CONTRACT = {
    "type": "object",
    "required": ["o_orderkey", "o_totalprice", "o_orderstatus"],
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 1},
        "o_totalprice": {"type": "number", "minimum": 50000, "exclusiveMaximum": 450000},
        "o_orderstatus": {"type": "string", "pattern": "^[FO]$", "minLength": 1, "maxLength": 1},
        "o_orderpriority": {"enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
    },
}
_VALID = "o_orderkey >= 1 AND o_totalprice >= 50000 AND o_totalprice < 450000 AND regexp_matches(o_orderstatus, '^[FO]$') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"


@query(f"SELECT o_orderkey, CASE WHEN {_VALID} THEN '1.0.0' END AS version, CASE WHEN {_VALID} THEN NULL ELSE 'orders' END AS contract, CASE WHEN {_VALID} THEN NULL ELSE 'warning' END AS severity FROM orders")
def contract_lenient(spark, d):
    df = steps.contract(messages(spark, d, "orders"), "orders", spec={"schema": CONTRACT, "version": "1.0.0"})
    m = F.col("metadata")
    return alive(df).select(F.col("body.o_orderkey").alias("o_orderkey"), m["contract_version"].alias("version"), m["contract_violation"]["contract_id"].alias("contract"), m["contract_violation"]["severity"].alias("severity"))


@query(f"SELECT o_orderkey, 'contract' AS step, 'error_path' AS stage FROM orders WHERE NOT ({_VALID})")
def contract_strict_dlq(spark, d):
    df = steps.contract(messages(spark, d, "orders"), "orders", spec={"schema": CONTRACT, "version": "1.0.0", "strict": True})
    dead = dead_letters(df, F.lit("2024-01-01").cast("timestamp"))
    key = F.try_variant_get(F.parse_json("body.original_message"), "$.body.o_orderkey", "bigint")
    return dead.select(key.alias("o_orderkey"), F.col("body.failed_step_type").alias("step"), F.col("metadata.stage").alias("stage"))


@query("""SELECT event_id, NOT (CAST(props->>'$.k' AS DOUBLE) BETWEEN 10 AND 90) AS violated FROM events""")
def contract_variant(spark, d):
    e = table(spark, d, "events")
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "allOf": [{"minimum": 10}, {"maximum": 90}]}}, "additionalProperties": False}
    df = steps.contract(envelope(e, F.try_parse_json("props"), keep=("event_id",)), "props", spec={"schema": schema})
    return df.select("event_id", F.col("metadata.contract_violation").isNotNull().alias("violated"))


_PAYLOAD = """'{"doc_id":' || doc_id || ',"source":"' || source || '"}'"""


@query(f"SELECT doc_id, sha256({_PAYLOAD}) AS ticket, CAST(length({_PAYLOAD}) AS BIGINT) AS size, 'sha256:' || sha256({_PAYLOAD}) AS hash FROM documents")
def claim_check(spark, d):
    doc = table(spark, d, "documents")
    df, _ = steps.claim_check(envelope(doc, F.struct("doc_id", "source")))
    c = F.col("body._claim_check")
    return df.select(F.col("body.doc_id").alias("doc_id"), c["ticket"].alias("ticket"), c["size"].alias("size"), c["hash"].alias("hash"))


@query(f"SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {_PAYLOAD} END AS payload, CASE WHEN doc_id % 10 = 0 THEN 'claim resolve: ticket not found' END AS error, count(*) AS n FROM documents GROUP BY 1, 2")
def claim_resolve(spark, d):
    doc = table(spark, d, "documents")
    df, blobs = steps.claim_check(envelope(doc, F.struct("doc_id", "source")), remove_payload=True)
    kept = blobs.where(F.try_variant_get(F.parse_json("payload"), "$.doc_id", "bigint") % 10 != 0)
    out = steps.claim_resolve(df, kept.union(kept))  # a ticket that is stored twice stands for one blob
    return out.select(F.when(F.col("_error").isNull(), F.col("body")).alias("payload"), F.col("_error.error").alias("error")).groupBy("payload", "error").agg(F.count("*").alias("n"))


# -- split -------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, i - 1 AS idx, len(string_split(text, chr(10))) AS total, length(line) AS n FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)""")
def split_array(spark, d):
    df = steps.split(envelope(table(spark, d, "documents"), headers=F.create_map(F.lit("id"), F.col("doc_id").cast("string"))), '$split(body.text, "\\n")')
    f = F.col("metadata.splitter_facet")
    return df.select(F.col("headers")["id"].cast("bigint").alias("doc_id"), f["element_index"].cast("bigint").alias("idx"), f["total_elements"].cast("bigint").alias("total"), F.length("body").cast("bigint").alias("n"))


@query("SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, round(l_extendedprice * l_quantity, 4) AS amount FROM lineitem")
def split_output_expr(spark, d):
    src = order_items(spark, d).withColumn("headers", F.create_map(F.lit("order"), F.col("body.order_id").cast("string")))
    df = steps.split(src, "body.items", '{"order_id": $number(headers.order), "line": body.line, "amount": body.price * body.quantity}')
    return body(df, "order_id", "line", "amount").withColumns({"order_id": F.col("order_id").cast("bigint"), "amount": F.round("amount", 4)})


@query("SELECT event_id, 'split: expression did not give an array' AS error, 'error_path' AS mode FROM events UNION ALL SELECT CAST(NULL AS BIGINT), NULL, 'skip' FROM events WHERE false")
def split_non_array(spark, d):
    df = events(spark, d)
    bad = steps.split(df, "body.event_type").select("event_id", F.col("_error.error").alias("error"), F.lit("error_path").alias("mode"))
    return bad.union(steps.split(df, "body.nothing", on_non_array="skip").select("event_id", F.lit(None).cast("string"), F.lit("skip")))


# -- aggregate, idempotent, rate limit ---------------------------------------------------------------------------------


def _groups(df: DataFrame) -> DataFrame:
    b = F.col("body")
    return df.select(
        b["correlation_key"].alias("user"), b["count"].cast("bigint").alias("n"), b["completion_trigger"].alias("trigger"), F.array_join(F.transform(b["messages"], lambda m: m["body"]["event_id"].cast("string")), ",").alias("ids"),
        F.col("metadata.aggregator_facet.completion_strategy").alias("strategy"),
    )


@query("""WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS b FROM events)
SELECT CAST(user_id AS VARCHAR) AS "user", count(*) AS n, CASE WHEN count(*) = 4 THEN 'count_reached' ELSE 'timeout' END AS trigger, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, 'count' AS strategy FROM e GROUP BY user_id, b""")
def aggregate_count(spark, d):
    return _groups(stateful.aggregate(events(spark, d), "user_id", count=4, tie="event_id"))


_FOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT event_id, user_id, t, r, 0 AS b, t AS opened, 1 AS n FROM e WHERE r = 1
UNION ALL SELECT e.event_id, e.user_id, e.t, e.r, CASE WHEN f.n >= {most} OR e.t >= f.opened + {window} THEN f.b + 1 ELSE f.b END, CASE WHEN f.n >= {most} OR e.t >= f.opened + {window} THEN e.t ELSE f.opened END,
CASE WHEN f.n >= {most} OR e.t >= f.opened + {window} THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT CAST(user_id AS VARCHAR) AS "user", count(*) AS n, CASE WHEN count(*) >= {most} THEN '{full}' ELSE '{over}' END AS trigger, string_agg(event_id, ',' ORDER BY t, event_id) AS ids, '{strategy}' AS strategy FROM f GROUP BY user_id, b"""
_DAY = 86_400_000


@query(_FOLD.format(most=5, window=3 * _DAY * 1000, full="count_reached", over="timeout", strategy="count"))
def aggregate_count_timeout(spark, d):
    return _groups(stateful.aggregate(events(spark, d), "user_id", count=5, timeout_ms=3 * _DAY, tie="event_id"))


@query(_FOLD.format(most=3, window=_DAY * 1000, full="max_messages_reached", over="window_expired", strategy="time_window"))
def aggregate_time_window(spark, d):
    return _groups(stateful.aggregate(events(spark, d), "user_id", "time_window", window_ms=_DAY, max_messages=3, tie="event_id"))


@query("SELECT event_id, 'aggregate: correlation key is null' AS error FROM events WHERE event_type = 'error'")
def aggregate_null_key(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") != "error", F.col("user_id")))
    df = envelope(e, keep=("event_id",), correlation_id=F.col("event_id").cast("string"), ingested_at=F.col("ts").cast("timestamp"))
    dead = dead_letters(stateful.aggregate(df, "k", count=4, tie="event_id"))
    return dead.select(F.col("metadata.correlation_id").cast("bigint").alias("event_id"), F.col("body.error").alias("error"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS order_id, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey")
def split_aggregate_roundtrip(spark, d):
    src = order_items(spark, d).withColumn("headers", F.create_map(F.lit("order"), F.col("body.order_id").cast("string")))
    parts = steps.split(src, "body.items", '{"order": headers.order, "line": body.line, "price": body.price}').withColumn("line", F.col("body.line"))
    df = stateful.aggregate(parts, "order", count=1000, tie="line", output_expr='{"order_id": correlation_key, "n": count, "total": $sum(messages.body.price)}')
    return body(df, "order_id", "n", "total").withColumns({"n": F.col("n").cast("bigint"), "total": F.round("total", 2)})


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def idempotent_first(spark, d):
    return stateful.idempotent(events(spark, d), 'body.user_id & "-" & body.event_type', None, "event_id").select("event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT event_id, user_id, event_type, r, t AS last, true AS keep FROM e WHERE r = 1 UNION ALL
SELECT e.event_id, e.user_id, e.event_type, e.r, CASE WHEN e.t >= f.last + 432000000000 THEN e.t ELSE f.last END, e.t >= f.last + 432000000000 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.r = f.r + 1)
SELECT event_id FROM f WHERE keep""")
def idempotent_ttl(spark, d):
    return stateful.idempotent(events(spark, d), 'body.user_id & "-" & body.event_type', 5 * 24 * 60, "event_id").select("event_id")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') s WHERE s.user_id = e.user_id AND e.ts < TIMESTAMP '2024-01-15 00:00:00')")
def idempotent_store(spark, d):
    seen = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("dedup_key")).distinct().withColumn("expires_at", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return stateful.seen_before(events(spark, d), seen, "body.user_id").select("event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT event_id, event_type, r, t AS opened, 1 AS n, true AS admitted FROM e WHERE r = 1 UNION ALL
SELECT e.event_id, e.event_type, e.r, CASE WHEN e.t >= f.opened + 3600000000 THEN e.t ELSE f.opened END, CASE WHEN e.t >= f.opened + 3600000000 THEN 1 ELSE f.n + 1 END,
e.t >= f.opened + 3600000000 OR f.n < 2 FROM f JOIN e ON e.event_type = f.event_type AND e.r = f.r + 1)
SELECT event_id, admitted FROM f""")
def rate_limit_window(spark, d):
    return stateful.rate_limit(events(spark, d), "body.event_type", 2, 3_600_000, "event_id").select("event_id", "admitted")


# -- errors, dead letters ----------------------------------------------------------------------------------------------


@query("""SELECT event_id, 'authorization_denied: insufficient roles' AS error, 2 AS failed_step, 'authorize' AS failed_step_type, 0 AS retry_attempt FROM events WHERE value > 150 AND event_type NOT IN ('purchase', 'error')
UNION ALL SELECT event_id, 'authorization_denied: no principal', 2, 'authorize', 0 FROM events WHERE value > 150 AND event_type = 'error'""")
def dlq_envelope(spark, d):
    spec = {"steps": [{"filter": {"expr": "body.value > 150"}}, {"translate": {"expr": '{"v": body.value}'}}, {"authorize": {"mode": "rbac", "require_roles": ["buyer"]}}]}
    dead = Route("r", spec).apply(with_principal(spark, d)).dead
    b = F.col("body")
    return dead.select(F.col("metadata.correlation_id").cast("bigint").alias("event_id"), b["error"].alias("error"), b["failed_step"].alias("failed_step"), b["failed_step_type"].alias("failed_step_type"), b["retry_attempt"].alias("retry_attempt"))


_MESSAGES = ["Connection REFUSED by peer", "i/o timeout", "validation failed", None, "context canceled", "temporary failure", "broken pipe"]
_CASE = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if m is None else chr(39) + m + chr(39)}" for i, m in enumerate(_MESSAGES)) + " END"


@query(f"""SELECT message, count(*) AS n, CASE WHEN message IS NULL THEN 'unknown' WHEN message IN ('validation failed', 'context canceled') THEN 'permanent' ELSE 'transient' END AS class FROM (SELECT {_CASE} AS message FROM events) GROUP BY message""")
def error_classify(spark, d):
    m = F.get(F.array(*(F.lit(x).cast("string") for x in _MESSAGES)), (F.col("event_id") % 7).cast("int"))
    e = table(spark, d, "events").select(m.alias("message"))
    return e.groupBy("message").agg(F.count("*").alias("n")).withColumn("class", errors.classify_error(F.col("message")))


@query("SELECT event_id, CAST(least(500 * power(2, event_id % 12), 30000) AS BIGINT) AS wait_ms FROM events")
def backoff_schedule(spark, d):
    return table(spark, d, "events").select("event_id", errors.backoff_ms(F.col("event_id") % 12 + 1, 500).alias("wait_ms"))


# -- lineage -----------------------------------------------------------------------------------------------------------

POLICIES = {"default": 30, "premium-90": 90}


def records(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    b = F.struct("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.when(F.col("o_totalprice") > 300000, "premium").otherwise("basic").alias("tier"))
    df = envelope(o, b, ingested_at=F.col("o_orderdate").cast("timestamp"), route=F.col("o_orderpriority"), correlation_id=F.col("o_orderkey").cast("string"))
    out = lineage.lineage_rows(df, POLICIES, 'body.tier = "premium" ? "premium-90" : "none"', None, "body.customer")
    return out.withColumn("id", F.get_json_object("message_body", "$.o_orderkey"))


_REC = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderpriority AS route_name, o_orderdate AS created_at,
CASE WHEN o_totalprice > 300000 THEN 'premium-90' ELSE 'default' END AS retention_policy,
o_orderdate + (CASE WHEN o_totalprice > 300000 THEN INTERVAL 90 DAY ELSE INTERVAL 30 DAY END) AS expires_at FROM orders) r"""


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _t(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query(f"SELECT id, subject_id, route_name, retention_policy, {_t('created_at')}, {_t('expires_at')} FROM {_REC}")
def retention_resolve(spark, d):
    return records(spark, d).select("id", "subject_id", "route_name", "retention_policy", _text("created_at"), _text("expires_at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'subject id is not a string' END AS error FROM orders")
def subject_extract(spark, d):
    o = table(spark, d, "orders")
    odd = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey").cast("string").cast("variant")).otherwise(F.col("o_custkey").cast("variant"))
    df = envelope(o, F.struct("o_orderkey", odd.alias("who")))
    s, e = lineage.extract_subject(df, "body.who")
    return df.select(F.col("body.o_orderkey").alias("o_orderkey"), s.alias("subject"), e.alias("error"))


@query(f"SELECT id, {_t('created_at')} FROM {_REC} WHERE subject_id = '7'")
def lineage_by_subject(spark, d):
    return lineage.by_subject(records(spark, d), "7").select("id", _text("created_at"))


@query(f"SELECT id, {_t('created_at')} FROM {_REC} WHERE route_name = '1-URGENT' ORDER BY r.created_at DESC, id LIMIT 100")
def lineage_latest(spark, d):
    return lineage.by_route(records(spark, d), "1-URGENT", limit=100).select("id", _text("created_at"))


@query(f"SELECT subject_id, count(*) AS records FROM {_REC} GROUP BY subject_id")
def lineage_counts(spark, d):
    return lineage.count_by_subject(records(spark, d))


@query(f"SELECT a.id AS origin, r.id FROM {_REC} JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders) a USING (subject_id)")
def provenance(spark, d):
    r = records(spark, d)
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return lineage.provenance(r, asked).select("origin", "id")


@query(f"SELECT subject_id, count(*) AS purged_count, '2000-01-01 00:00:00' AS purged_at, '2000-12-31 00:00:00' AS expires_at, 'request' AS reason FROM {_REC} WHERE CAST(subject_id AS BIGINT) % 10 = 3 GROUP BY subject_id")
def purge_subject(spark, d):
    r = records(spark, d)
    _, events_ = lineage.purge(r, r.where("cast(subject_id as bigint) % 10 = 3").select("subject_id"), "request", "2000-01-01")
    return events_.select("subject_id", "purged_count", _text("purged_at"), _text("expires_at"), "reason")


@query(f"SELECT id FROM {_REC} WHERE subject_id NOT IN (SELECT subject_id FROM {_REC} WHERE expires_at <= TIMESTAMP '1997-01-01')")
def reaper(spark, d):
    keep, _ = lineage.reap(records(spark, d), F.lit("1997-01-01").cast("timestamp"))
    return keep.select("id")


@query(f"SELECT id FROM {_REC} WHERE expires_at <= TIMESTAMP '1997-01-01'")
def expired_records(spark, d):
    return lineage.expired(records(spark, d), F.lit("1997-01-01").cast("timestamp")).select("id")


@query(f"""SELECT id, route_name, subject_id, '' AS route_version, '' AS contract_version, retention_policy, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS processed_at,
strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM {_REC} WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""")
def lineage_export(spark, d):
    return lineage.export_csv(records(spark, d), F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))


# -- metrics -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS route, count(*) AS total, count(*) FILTER (value <= 100) AS success, count(*) FILTER (value > 100) AS failed, CAST(sum(user_id % 3) AS BIGINT) AS retries, count(*) FILTER (value > 150) AS dead_letters FROM events GROUP BY event_type")
def metrics_counters(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("route"), (F.col("value") <= 100).alias("ok"), (F.col("user_id") % 3).alias("retries"), (F.col("value") > 150).alias("dead"))
    return metrics.route_counters(e)


@query("SELECT event_type AS route, CASE WHEN value > 150 THEN 'timeout' ELSE 'invalid' END AS error_type, count(*) AS errors FROM events WHERE value > 100 GROUP BY 1, 2")
def metrics_errors(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("route"), F.when(F.col("value") > 150, "timeout").when(F.col("value") > 100, "invalid").alias("error_type"))
    return metrics.errors_by_type(e)


_SORTED = "(SELECT event_type AS route, list_sort(list(CAST(floor(value) AS BIGINT))) AS v, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type)"


@query(f"SELECT route, v[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((n - 1) * 0.9) AS BIGINT) + 1] AS p90, v[CAST(floor((n - 1) * 0.99) AS BIGINT) + 1] AS p99, total, n, total // n AS average FROM {_SORTED}")
def percentile_metrics(spark, d):
    return metrics.latency_percentiles(_latency(spark, d), ["route"], "ms")


@query(f"SELECT route, v[least(n // 2, n - 1) + 1] AS p50, v[least(n * 90 // 100, n - 1) + 1] AS p90, v[least(n * 99 // 100, n - 1) + 1] AS p99, total, n, total / n AS average FROM {_SORTED}")
def percentile_viewer(spark, d):
    return metrics.latency_percentiles(_latency(spark, d), ["route"], "ms", "viewer")


def _latency(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("route"), F.floor("value").cast("bigint").alias("ms"), (F.col("user_id") % 4).alias("step"))


@query("SELECT route, step, n, total FROM (SELECT event_type AS route, user_id % 4 AS step, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2)")
def step_latency(spark, d):
    return metrics.latency_percentiles(_latency(spark, d), ["route", "step"], "ms").select("route", "step", "n", "total")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def ring_buffer(spark, d):
    return metrics.ring_buffer(table(spark, d, "events"), "event_type", ["ts", "event_id"], 20).select("event_id", "event_type")


def spans(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    up = F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4)
    start = F.col("ts").cast("timestamp")
    return e.select((F.floor(F.col("event_id") / 4)).cast("string").alias("trace_id"), F.col("event_id").alias("span_id"), up.alias("parent_span_id"), F.col("event_type").alias("name"), F.col("event_type").alias("route"), start.alias("start_time"), start.alias("end_time"), F.lit("ok").alias("status"))


@query("SELECT span_id, name FROM (SELECT event_id AS span_id, event_type AS name FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 20)")
def recent_spans(spark, d):
    return metrics.recent_spans(spans(spark, d), 20, "view").select("span_id", "name")


@query("SELECT event_id - event_id % 4 AS parent_span_id, event_id AS child_span_id, event_type AS name FROM events WHERE event_id % 4 <> 0")
def child_spans(spark, d):
    return metrics.child_spans(spans(spark, d)).select("parent_span_id", "child_span_id", "name")


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def message_rates(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return metrics.message_rates(e, "ts", "event_type").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE CAST(floor(least(greatest(s_acctbal, 0) * 100.0 / (s_suppkey % 5 * 1000), 100) + 1e-9) AS BIGINT) END AS percent FROM supplier")
def tenant_utilisation(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.floor(metrics.utilisation(F.greatest("s_acctbal", F.lit(0.0)), F.col("s_suppkey") % 5 * 1000.0) + 1e-9).cast("bigint").alias("percent"))


CONFIG = {
    "version": 1,
    "sources": {"in": {"type": "parquet"}, "spare": {"type": "file"}},
    "sinks": {"output": {"type": "file"}, "dead": {"type": "file"}, "audit": {"type": "file"}},
    "routes": {
        "buy": {"from": "in", "auth": "none", "error_path": {"target": "dead"}, "contracts": [{"id": "c", "schema": {"type": "object"}}], "steps": [{"filter": {"expr": 'body.event_type = "purchase"'}}, {"translate": {"expr": '{"v": body.value}'}}, {"translate": {"expr": '{"v": body.v * 2}'}}, {"wiretap": {"sink": "audit"}}]},
        "seen": {"from": "in", "error_path": {"target": "dead"}, "steps": [{"translate": {"expr": '{"x": $lookup(body, body.event_type)}'}}]},
    },
}


@query("""SELECT * FROM (VALUES ('source', 'in', 2, 'medium', 1.0, 2), ('sink', 'dead', 2, 'medium', 1.0, 2), ('sink', 'audit', 1, 'medium', 1.0, 1), ('contract', 'c', 1, 'medium', 1.0, 1), ('step-type', 'filter', 0, 'low', 1.0, 1),
('step-type', 'translate', 0, 'low', 1.0, 3), ('step-type', 'wiretap', 0, 'low', 1.0, 1), ('connection', NULL, 0, 'low', 0.0, 1)) t(target_type, target_name, affected, level, confidence, refs)""")
def impact_query(spark, d):
    return metrics.impact(checks.impact_edges(spark, CONFIG)).select("target_type", "target_name", "affected", "level", "confidence", "refs")


@query("SELECT * FROM (VALUES ('c', 2, 5, 'fair')) t(config, important, findings, rating)")
def critique_rating(spark, d):
    found = spark.createDataFrame(checks.critique("c", CONFIG), checks.FINDING)
    return metrics.rating(found).select("config", "important", "findings", "rating")


# -- sources and sinks -------------------------------------------------------------------------------------------------


def _debezium(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    op = F.get(F.array(*map(F.lit, ("c", "u", "d", "r", "t"))), (F.col("event_id") % 5).cast("int"))
    row = F.struct(F.col("user_id").alias("u"))
    event = F.struct(F.when(F.col("event_id") % 5 != 0, row).alias("before"), F.when(F.col("event_id") % 5 != 2, row).alias("after"), F.struct(F.lit("users").alias("table")).alias("source"), op.alias("op"), F.col("event_id").alias("ts_ms"))
    return e.select("event_id", F.to_json(event).alias("json"))


@query("""SELECT event_id, 'users' AS "table", CASE event_id % 5 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'READ' ELSE 't' END AS operation, event_id AS timestamp,
CASE WHEN event_id % 5 <> 0 THEN '{"u":' || user_id || '}' END AS before, CASE WHEN event_id % 5 <> 2 THEN '{"u":' || user_id || '}' END AS after FROM events""")
def cdc_debezium(spark, d):
    return _debezium(spark, d).select("event_id", readers.debezium(F.col("json")).alias("e")).select("event_id", "e.*")


@query("""SELECT event_id, 'users' AS "table", CASE WHEN event_id % 2 = 0 THEN 'insert' ELSE 'update' END AS operation, event_id * 10 AS timestamp, CASE WHEN event_id % 2 = 1 THEN '{"v":1}' END AS before, '{"u":' || user_id || '}' AS after FROM events""")
def cdc_maxwell(spark, d):
    odd = F.col("event_id") % 2 == 1
    event = F.struct(F.lit("shop").alias("database"), F.lit("users").alias("table"), F.when(odd, "update").otherwise("insert").alias("type"), (F.col("event_id") * 10).alias("ts"), F.struct(F.col("user_id").alias("u")).alias("data"), F.when(odd, F.struct(F.lit(1).alias("v"))).alias("old"))
    e = table(spark, d, "events").select("event_id", F.to_json(event).alias("json"))
    return e.select("event_id", readers.maxwell(F.col("json")).alias("e")).select("event_id", "e.*")


@query("SELECT 'events' AS table_name, event_type AS operation, event_id AS record_id FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 100)")
def cdc_page(spark, d):
    log = table(spark, d, "events").select(F.lit("events").alias("table_name"), F.col("event_type").alias("operation"), F.col("event_id").alias("record_id"), F.col("ts").alias("changed_at"), F.lit(None).cast("string").alias("before_state"), F.col("props").alias("after_state"))
    return readers.changelog_page(log, "changed_at", F.lit("2024-01-10").cast("timestamp_ntz"), 100).select("table_name", "operation", "record_id")


@query("SELECT count(*) AS n, max(event_id) AS watermark FROM events WHERE event_id > 5000")
def db_watermark_poll(spark, d):
    rows, mark = readers.watermark_poll(table(spark, d, "events"), "event_id", 5000)
    return rows.agg(F.count("*").alias("n"), mark.alias("watermark"))


@query("""SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN c_name ELSE 'order ' || o_orderkey END AS c_name FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey
UNION ALL SELECT o_custkey, 'order ' || o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_merge(spark, d):
    target = table(spark, d, "customer").select("c_custkey", "c_name")
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), "o_orderkey").alias("c_name"), "o_orderdate", "o_orderkey")
    return sinks.upsert(target, changes, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT event_id, NULL AS k, CAST(event_id % 4 AS VARCHAR) AS part FROM events WHERE false UNION ALL SELECT event_id, CAST(user_id AS VARCHAR), CAST(event_id % 4 AS VARCHAR) FROM events")
def kafka_envelope(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").cast("binary").alias("key"), F.to_json(F.struct("event_id")).cast("binary").alias("value"), F.lit("t").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    df = readers.kafka_envelope(e)
    return df.select(F.try_variant_get("body", "$.event_id", "bigint").alias("event_id"), F.col("headers")["kafka_key"].alias("k"), F.col("headers")["kafka_partition"].alias("part"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS key, '{\"event_id\":' || event_id || '}' AS value FROM events")
def kafka_sink_rows(spark, d):
    e = table(spark, d, "events")
    df = envelope(e, F.struct("event_id"), F.create_map(F.lit("kafka_key"), F.col("user_id").cast("string"), F.lit("x"), F.col("event_id").cast("string")))
    return sinks.kafka_rows(df).select(F.get(F.filter("headers", lambda h: h["key"] == "x"), F.lit(0))["value"].cast("string").cast("bigint").alias("event_id"), "key", "value")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 405 WHEN event_id % 10 = 1 THEN 400 ELSE 202 END AS status, CASE WHEN event_id % 10 < 2 THEN NULL WHEN event_id % 3 = 0 THEN 'header' WHEN event_id % 3 = 1 THEN 'query' ELSE 'segment' END AS route FROM events""")
def http_ingest(spark, d):
    e = table(spark, d, "events")
    r = e.select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "PUT").otherwise("POST").alias("method"), F.lit("/ingest/segment").alias("path"), F.when(F.col("event_id") % 3 == 1, "a=1&route=query").alias("query"),
        F.map_filter(F.create_map(F.lit("X-Route"), F.when(F.col("event_id") % 3 == 0, "header"), F.lit("n"), F.col("event_id").cast("string")), lambda k, v: v.isNotNull()).alias("headers"),
        F.when(F.col("event_id") % 10 == 1, "{bad").otherwise(F.col("props")).alias("body"), F.col("ts").cast("timestamp").alias("received_at"),
    )
    good, all_ = readers.http_messages(r)
    routes = good.select(F.col("headers")["n"].cast("bigint").alias("event_id"), F.col("metadata.route").alias("route"))
    return all_.select("event_id", "status").join(routes, "event_id", "left")


@query("SELECT event_id, 'u' || user_id AS subject, 2 AS roles, 'eu' AS region FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0")
def jwt_principal(spark, d):
    e = table(spark, d, "events")
    enc = lambda c: F.replace(F.replace(F.regexp_replace(F.base64(c.cast("binary")), "=|\\r|\\n", ""), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    claims = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("sub"), F.array(F.lit("a"), F.lit("b")).alias("roles"), F.lit("eu").alias("region")))).otherwise(F.lit("{}"))
    signed = F.concat_ws(".", enc(F.lit('{"alg":"HS256"}')), enc(claims))
    key = lambda k: F.unhex(readers.hmac_sha256(k, signed))
    token = F.concat_ws(".", signed, enc(F.when(F.col("event_id") % 7 != 0, key("secret")).otherwise(key("another"))))
    p = e.select("event_id", readers.jwt_principal(token, "secret").alias("p")).where("p IS NOT NULL")
    return p.select("event_id", F.col("p.subject").alias("subject"), F.size("p.roles").alias("roles"), F.col("p.claims")["region"].alias("region"))


@query("SELECT event_id, 1 AS replay_count, value FROM (SELECT event_id, value FROM events WHERE value > 200)")
def dlq_replay(spark, d):
    spec = {"steps": [{"authorize": {"mode": "rbac", "require_roles": ["nobody"]}}]}
    dead = Route("r", spec).apply(events(spark, d)).dead
    back = readers.replay(dead.where(F.get_json_object("body.original_message", "$.body.value").cast("double") > 200), limit=None)
    return back.select(F.try_variant_get("body", "$.event_id", "bigint").alias("event_id"), F.col("metadata.replay_count").alias("replay_count"), F.try_variant_get("body", "$.value", "double").alias("value"))


# -- whole routes ------------------------------------------------------------------------------------------------------

FLAGSHIP = {
    "version": 1,
    "sources": {"events": {"type": "parquet"}},
    "sinks": {"output": {"type": "file"}, "dead": {"type": "file"}},
    "routes": {
        "purchases": {
            "from": "events",
            "auth": "none",
            "error_path": {"target": "dead"},
            "steps": [
                {"filter": {"expr": 'body.value > 100 and body.event_type = "purchase"'}},
                {"translate": {"expr": '{"user": body.user_id, "amount": body.value / 100, "tier": body.value > 300 ? "high" : "low"}'}},
                {"route": {"expr": "body.tier", "cases": {"high": {"target": "vip"}}, "default": "standard"}},
            ],
        }
    },
}


@query("""SELECT user_id AS "user", round(value / 100, 6) AS amount, CASE WHEN value > 300 THEN 'high' ELSE 'low' END AS tier, CASE WHEN value > 300 THEN 'vip' ELSE 'standard' END AS route FROM events WHERE value > 100 AND event_type = 'purchase'""")
def route_purchases(spark, d):
    cfg = config.loads(FLAGSHIP)
    ok = Route("purchases", cfg["routes"]["purchases"]).apply(readers.parquet_messages(spark, f"{d}/events.parquet")).ok
    return ok.select(F.col("body.user").alias("user"), F.round("body.amount", 6).alias("amount"), F.col("body.tier").alias("tier"), F.col("metadata.route").alias("route"))


@query("""SELECT l_returnflag AS flag, CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 'big' ELSE 'small' END AS route, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2""")
def route_lineitem(spark, d):
    spec = {"steps": [{"filter": {"expr": "body.l_quantity > 10"}}, {"translate": {"expr": '{"flag": body.l_returnflag, "revenue": body.l_extendedprice * (1 - body.l_discount)}'}}, {"route": {"expr": 'body.revenue > 50000 ? "b" : "s"', "cases": {"b": "big", "s": "small"}}}]}
    ok = Route("lines", spec).apply(messages(spark, d, "lineitem")).ok
    return ok.groupBy(F.col("body.flag").alias("flag"), F.col("metadata.route").alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("body.revenue"), 2).alias("revenue"))


