"""Further queries: sinks and readers by the rows they make, expression features, groups of built-in functions, and
configuration. They join those of ``catalog`` when this module is imported."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions.parser import ExpressionError
from sluice.functions.registry import Function, conformance
from sluice.operators import lineage, metrics, steps
from sluice.operators.envelope import alive, compile_on, envelope
from sluice.plans import checks, config, fixtures
from sluice.plans.catalog import _REC, _text, body, events, messages, order_items, query, records, spans, table, with_principal
from sluice.plans.route import Route, ordered
from sluice.plans.schema_registry import MemoryRegistry, Reference, RegistryError, contract_of
from sluice.sources import readers, sinks


def rows(spark, schema: str, data: list[tuple]):
    return spark.createDataFrame(data, schema)


# -- sinks and readers -------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS correlation_id, event_type FROM events")
def jsonl_sink(spark, d):
    j = lambda p: F.get_json_object("value", p)
    return sinks.json_lines(events(spark, d)).select(j("$.body.event_id").cast("bigint").alias("event_id"), j("$.metadata.correlation_id").alias("correlation_id"), j("$.body.event_type").alias("event_type"))


_DENIED = {"steps": [{"authorize": {"mode": "rbac", "require_roles": ["buyer"]}}]}
_DENIED_SQL = "CASE WHEN event_type = 'error' THEN 'authorization_denied: no principal' ELSE 'authorization_denied: insufficient roles' END"


@query(f"SELECT event_id, {_DENIED_SQL} AS error, 0 AS failed_step, 'authorize' AS failed_step_type FROM events WHERE event_type <> 'purchase'")
def dead_letter_read(spark, d):
    """Dead letters written as lines and read back."""
    dead = Route("r", _DENIED).apply(with_principal(spark, d)).dead
    back = readers.parse_dead_letters(sinks.json_lines(dead))
    return back.select(F.col("metadata.correlation_id").cast("bigint").alias("event_id"), "body.error", "body.failed_step", "body.failed_step_type")


@query(f"SELECT CAST(event_id AS VARCHAR) AS correlation_id, 1 AS replay_count, {_DENIED_SQL} AS error FROM events WHERE event_type <> 'purchase'")
def dlq_replay_dry_run(spark, d):
    dead = Route("r", _DENIED).apply(with_principal(spark, d)).dead
    return readers.replay(dead, limit=None, dry_run=True).select("correlation_id", "replay_count", "error")


@query("SELECT event_id, event_type AS routing_key, 'ex' AS exchange, user_id FROM events")
def amqp_envelope(spark, d):
    e = table(spark, d, "events")
    landed = e.select(F.col("event_type").alias("routing_key"), F.lit("ex").alias("exchange"), F.col("event_id").alias("delivery_tag"), F.to_json(F.struct("user_id")).alias("body"))
    h = F.col("headers")
    return readers.amqp_envelope(landed).select(h["amqp_delivery_tag"].cast("bigint").alias("event_id"), h["amqp_routing_key"].alias("routing_key"), h["amqp_exchange"].alias("exchange"), F.try_variant_get("body", "$.user_id", "bigint").alias("user_id"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fallback' END AS routing_key, '{"event_id":' || event_id || '}' AS value, 2 AS delivery_mode FROM events""")
def amqp_sink_rows(spark, d):
    e = table(spark, d, "events")
    header = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("amqp_routing_key"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    out = sinks.amqp_rows(envelope(e, F.struct("event_id"), header), default="fallback")
    return out.withColumn("event_id", F.get_json_object("value", "$.event_id").cast("bigint"))


@query("SELECT event_id, true AS named_by_content, true AS below_prefix, event_type FROM events")
def object_sink_rows(spark, d):
    out = sinks.object_rows(events(spark, d), "out/")
    digest = F.sha2(F.col("value").cast("binary"), 256)
    return out.select(F.get_json_object("value", "$.body.event_id").cast("bigint").alias("event_id"), F.col("key").endswith(F.concat(digest, F.lit(".json"))).alias("named_by_content"), F.col("key").startswith("out/").alias("below_prefix"), F.get_json_object("value", "$.body.event_type").alias("event_type"))


@query("SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS nothing FROM events")
def db_insert_rows(spark, d):
    return sinks.columns_of(events(spark, d), ["event_id", "event_type", "nothing"])


@query("""SELECT event_id, 'application/json' AS content_type, CAST(event_id AS VARCHAR) AS correlation_id, CASE WHEN event_type <> 'error' THEN 'Bearer t' || user_id END AS "authorization" FROM events""")
def http_requests(spark, d):
    df = with_principal(spark, d)
    token = F.when(F.col("metadata.principal").isNotNull(), F.concat(F.lit("t"), "body.user_id"))
    out = sinks.http_requests(df, token)
    h = lambda n: F.try_element_at("headers", F.lit(n))
    return out.select(F.get_json_object("body", "$.event_id").cast("bigint").alias("event_id"), h("Content-Type").alias("content_type"), h("X-Correlation-ID").alias("correlation_id"), h("Authorization").alias("authorization"))


@query("SELECT event_id, 'u' || user_id AS subject, 'svc' AS role, event_id % 2 = 0 AS verified FROM events")
def obo_exchange(spark, d):
    """A token issued on behalf of a subject passes with the issuer's secret, and with no other."""
    e = table(spark, d, "events")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    token = sinks.exchange_token(F.concat(F.lit("u"), "user_id"), F.array(F.lit("svc")), "api", "secret", now)
    p = e.select("event_id", "user_id", token.alias("t"))
    good, bad = readers.jwt_principal(F.col("t"), "secret", now), readers.jwt_principal(F.col("t"), "other", now)
    p = p.select("event_id", good.alias("g"), F.when(F.col("event_id") % 2 == 0, good).otherwise(bad).alias("x"))
    return p.select("event_id", F.col("g.subject").alias("subject"), F.get("g.roles", F.lit(0)).alias("role"), F.col("x").isNotNull().alias("verified"))


# -- lineage -----------------------------------------------------------------------------------------------------------


@query(f"SELECT id, subject_id, retention_policy, strftime(r.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(r.expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM {_REC}")
def lineage_export_ndjson(spark, d):
    out = lineage.export_ndjson(records(spark, d), "1900-01-01", "2100-01-01")
    return out.select(*(F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "subject_id", "retention_policy", "created_at", "expires_at")))


def _purged(spark, d):
    r = records(spark, d)
    first = lineage.purge(r, r.where("cast(subject_id as bigint) % 10 = 3").select("subject_id"), "request", "2000-01-01")[1]
    return first.unionByName(lineage.purge(r, r.where("cast(subject_id as bigint) % 10 = 4").select("subject_id"), "request", "2001-02-03")[1])


@query(f"""SELECT subject_id, count(*) AS purged_count, CASE WHEN CAST(subject_id AS BIGINT) % 10 = 3 THEN '2000/01/01/r' ELSE '2001/02/03/r' END AS folder
FROM {_REC} WHERE CAST(subject_id AS BIGINT) % 10 IN (3, 4) GROUP BY subject_id""")
def purge_log(spark, d):
    return sinks.purge_log_rows(_purged(spark, d), "r").select("subject_id", "purged_count", F.concat_ws("/", "year", "month", "day", "route").alias("folder"))


@query(f"SELECT subject_id, '2001-02-03 00:00:00' AS purged_at FROM {_REC} WHERE CAST(subject_id AS BIGINT) % 10 = 4 GROUP BY subject_id")
def purge_events_range(spark, d):
    return lineage.purge_events_in(_purged(spark, d), "2001-01-01", "2001-12-31").select("subject_id", _text("purged_at"))


@query(f"SELECT subject_id, '2000-12-31 00:00:00' AS expires_at FROM {_REC} WHERE CAST(subject_id AS BIGINT) % 10 = 3 GROUP BY subject_id")
def evidence_expiry(spark, d):
    return lineage.expiring_evidence(_purged(spark, d), "2000-12-20", 30).select("subject_id", _text("expires_at"))


@query("""SELECT 'COMPLETE' AS type, CAST(event_id AS VARCHAR) AS run, 'ns' AS namespace, event_type AS job, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'amount' AS field FROM events""")
def openlineage_events(spark, d):
    df = events(spark, d, route=F.col("event_type"))
    out = lineage.openlineage_events(df, "ns", [{"name": "amount", "type": "number", "nullable": True}])
    j = lambda p: F.get_json_object("event", p)
    return out.select(j("$.eventType").alias("type"), j("$.run.runId").alias("run"), j("$.job.namespace").alias("namespace"), j("$.job.name").alias("job"), F.substring(j("$.eventTime"), 1, 19).alias("at"), j("$.facets.fields[0].name").alias("field"))


@query("SELECT count(*) AS n, 0 AS out_of_order FROM events")
def ordered_route(spark, d):
    """A route with required ordering: by partition and place, no message comes after a later one."""
    df = ordered(events(spark, d), {"ordering": "required"}, "event_id").select(F.struct("metadata.ingested_at", "event_id").alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    within = df.withColumn("before", F.lag("k").over(Window.partitionBy("p").orderBy("i")))
    parts = within.groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("k") < F.col("before")).alias("bad"), F.min("k").alias("first"), F.max("k").alias("last"))
    between = parts.withColumn("bad", F.col("bad") + F.coalesce((F.col("first") < F.lag("last").over(Window.orderBy("p"))).cast("int"), F.lit(0)))  # a row a partition
    return between.agg(F.sum("n").alias("n"), F.sum("bad").cast("int").alias("out_of_order"))


@query("SELECT 0 AS cut_traces, true AS about_half, 0 AS at_rate_zero, (SELECT count(*) FROM events) AS at_rate_one")
def trace_sampling(spark, d):
    s = spans(spark, d)
    whole = s.groupBy("trace_id").agg(F.count("*").alias("all"))
    kept = metrics.sampled(s, 0.5).groupBy("trace_id").agg(F.count("*").alias("n"))
    both = whole.join(kept, "trace_id", "left").agg(F.count_if(F.col("n") < F.col("all")).cast("int").alias("cut_traces"), F.avg(F.col("n").isNotNull().cast("double")).between(0.4, 0.6).alias("about_half"))
    ends = [metrics.sampled(s, rate).agg(F.count("*").alias(name)) for rate, name in ((0.0, "at_rate_zero"), (1.0, "at_rate_one"))]
    for e in ends:  # one row each
        both = both.unionByName(e, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).withColumn("at_rate_zero", F.col("at_rate_zero").cast("int"))


# -- expressions -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, 'h' || o_orderkey AS quoted, CAST(least_ AS BIGINT) AS first_line, CAST(n AS BIGINT) AS last_line, CAST(NULL AS VARCHAR) AS beyond, o_orderkey + 1 AS applied, true AS has_now
FROM (SELECT l_orderkey AS o_orderkey, max(l_linenumber) AS n, min(l_linenumber) AS least_ FROM lineitem GROUP BY l_orderkey)""")
def expr_paths(spark, d):
    src = order_items(spark, d).withColumn("headers", F.create_map(F.lit("x-order id"), F.concat(F.lit("h"), "body.order_id")))
    expr = """{"id": body.order_id, "quoted": headers."x-order id", "first_line": body.items[0].line, "last_line": $max(body.items.line), "beyond": body.items[99].flag,
    "applied": function($x) { $x + 1 }(body.order_id), "has_now": $length($now()) > 19}"""
    out = body(steps.translate(src, expr), "id", "quoted", "first_line", "last_line", "beyond", "applied", "has_now")
    return out.withColumns({"applied": F.col("applied").cast("bigint"), "last_line": F.col("last_line").cast("bigint")})


_WRONG = {"unknown function": "$nosuch(1)", "unknown variable": "$x", "open bracket": "(1", "no operand": "1 +", "no colon": "{'a' 1}", "open text": "'open", "repeated key": "{'a': 1, 'a': 2}"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in _WRONG) + ") t(expression, refused)")
def expr_errors(spark, d):
    df, out = messages(spark, d, "region"), []
    for name, text in _WRONG.items():
        try:
            compile_on(df, text)
            out.append((name, False))
        except ExpressionError:
            out.append((name, True))
    return rows(spark, "expression string, refused boolean", out)


@query("SELECT event_id, CAST(event_id AS VARCHAR) || '/' || event_type AS seen FROM events WHERE event_type = 'view'")
def expr_metadata(spark, d):
    """Metadata and headers are in reach of expressions, in filters too."""
    df = events(spark, d, route=F.col("event_type"))
    df = steps.filter_rows(df, 'metadata.route = "view"')
    return alive(steps.translate(df, '{"event_id": body.event_id, "seen": metadata.correlation_id & "/" & metadata.route}')).select("body.*")


@query("""SELECT o_orderkey AS id, 'a,b' AS names, o_custkey AS looked, CAST(9 AS BIGINT) AS merged, 'x1' AS each, CAST(2 AS BIGINT) AS pairs FROM orders""")
def builtin_object(spark, d):
    expr = """{"id": body.o_orderkey, "names": $join($sort($keys({"a": body.o_custkey, "b": 2})), ","), "looked": $lookup({"a": body.o_custkey, "b": 2}, "a"), "merged": $merge([{"a": 1, "b": 2}, {"b": 9}]).b,
    "each": $join($each({"x": 1}, function($v, $k) { $k & $v }), ","), "pairs": $count($spread({"a": 1, "b": 2}))}"""
    out = body(steps.translate(messages(spark, d, "orders"), expr), "id", "names", "looked", "merged", "each", "pairs")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("looked", "merged", "pairs")})


@query("SELECT event_id, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS text, event_id * 1000 AS back, true AS later FROM events")
def builtin_date(spark, d):
    expr = '{"event_id": body.event_id, "text": $fromMillis(body.event_id * 1000), "back": $toMillis($fromMillis(body.event_id * 1000)), "later": $millis() > 1600000000000}'
    return body(steps.translate(messages(spark, d, "events"), expr), "event_id", "text", "back", "later").withColumn("back", F.col("back").cast("bigint"))


@query("""SELECT l_orderkey AS id, count(*) + 1 AS appended, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) AS reversed, count(DISTINCT l_returnflag) AS flags,
string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS sorted, count(*) AS zipped, CAST(7 AS BIGINT) AS only FROM lineitem GROUP BY l_orderkey""")
def builtin_array(spark, d):
    expr = """{"id": body.order_id, "appended": $count($append(body.items.line, [99])), "reversed": $join($map($reverse($sort(body.items.line)), function($x) { $string($x) }), ","),
    "flags": $count($distinct(body.items.flag)), "sorted": $join($sort(body.items.flag), ","), "zipped": $count($zip(body.items.line, body.items.flag)), "only": $single([7])}"""
    out = body(steps.translate(order_items(spark, d), expr), "id", "appended", "reversed", "flags", "sorted", "zipped", "only")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("appended", "flags", "zipped", "only")})


@query("""SELECT event_id, value <> 0 AS of_number, event_type <> '' AS of_text, event_type <> 'view' AS negated, true AS there, false AS missing, 'number' AS kind, 'string' AS text_kind, false AS of_empty FROM events""")
def builtin_boolean(spark, d):
    expr = """{"event_id": body.event_id, "of_number": $boolean(body.value), "of_text": $boolean(body.event_type), "negated": $not(body.event_type = "view"), "there": $exists(body.value), "missing": $exists(body.nothing),
    "kind": $type(body.value), "text_kind": $type(body.event_type), "of_empty": $boolean([])}"""
    return body(steps.translate(messages(spark, d, "events"), expr), "event_id", "of_number", "of_text", "negated", "there", "missing", "kind", "text_kind", "of_empty")


@query("""SELECT p_partkey, base64(encode(p_name)) AS coded, p_name AS decoded, printf('%x', p_partkey) AS hex, replace(p_brand, '#', '%23') AS url, p_brand AS back, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded FROM part""")
def builtin_misc(spark, d):
    expr = """{"p_partkey": body.p_partkey, "coded": $base64encode(body.p_name), "decoded": $base64decode($base64encode(body.p_name)), "hex": $formatBase(body.p_partkey, 16), "url": $encodeUrlComponent(body.p_brand),
    "back": $decodeUrlComponent($encodeUrlComponent(body.p_brand)), "padded": $pad($string(body.p_partkey), -8, "0")}"""
    return body(steps.translate(messages(spark, d, "part"), expr), "p_partkey", "coded", "decoded", "hex", "url", "back", "padded")


# -- configuration -----------------------------------------------------------------------------------------------------


def _refused(f) -> bool:
    try:
        f()
    except (config.ConfigError, RegistryError, ValueError):
        return True
    return False


@query("SELECT * FROM (VALUES ('a', '1'), ('b.c', '2'), ('b.d', '4'), ('e', '[5]'), ('steps', '[1,2]')) t(path, value)")
def config_merge(spark, d):
    """Maps merge, later values win, lists of steps are joined."""
    m = config.merge({"a": 1, "b": {"c": 2, "d": 3}, "e": [1], "steps": [1]}, {"b": {"d": 4}, "e": [5], "steps": [2]})
    flat = {"a": m["a"], "b.c": m["b"]["c"], "b.d": m["b"]["d"], "e": m["e"], "steps": m["steps"]}
    return rows(spark, "path string, value string", [(k, str(v).replace(" ", "")) for k, v in flat.items()])


def _config(tmp: str, steps_: str = "[{fragment: clean}, {route: {expr: 'x', default: out}}]") -> Path:
    Path(tmp, "fragments.yaml").write_text("fragments:\n  clean:\n    steps: [{filter: {expr: 'body.a > 1'}}, {translate: {expr: 'body'}}]\n")
    Path(tmp, "unused.yaml").write_text("fragments:\n  other:\n    steps: [{filter: {expr: 'true'}}]\n")
    p = Path(tmp, "route.yaml")
    p.write_text(f"version: 1\nimports: [fragments.yaml, unused.yaml]\nsources: {{s: {{type: file}}}}\nsinks: {{out: {{type: file}}, dead: {{type: file}}}}\nroutes:\n  r:\n    from: s\n    auth: none\n    error_path: {{target: dead}}\n    steps: {steps_}\n")
    return p


@query("SELECT * FROM (VALUES (0, 'filter'), (1, 'translate'), (2, 'route')) t(place, kind)")
def config_fragments(spark, d):
    with tempfile.TemporaryDirectory() as tmp:
        cfg = config.load(_config(tmp))
    return rows(spark, "place int, kind string", [(i, config.step_kind(s)) for i, s in enumerate(cfg["routes"]["r"]["steps"])])


@query("SELECT * FROM (VALUES ('no version', true), ('no auth, strict', true), ('unknown fragment', true), ('two kinds of step', true), ('unused import is told', true), ('whole', false)) t(name, found)")
def config_checks(spark, d):
    with tempfile.TemporaryDirectory() as tmp:
        path = _config(tmp)
        cfg = config.load(path)
        text = path.read_text()
        again = lambda t: (path.write_text(t), config.load(path, auth="strict"))
        out = [
            ("whole", _refused(lambda: again(text))),
            ("unused import is told", cfg["unused_imports"] == ["unused.yaml"]),
            ("no version", _refused(lambda: again(text.replace("version: 1", "version: 2")))),
            ("no auth, strict", _refused(lambda: again(text.replace("    auth: none\n", "")))),
            ("unknown fragment", _refused(lambda: again(text.replace("fragment: clean", "fragment: nothing")))),
            ("two kinds of step", _refused(lambda: again(text.replace("{fragment: clean}", "{filter: {expr: 'a'}, translate: {expr: 'b'}}")))),
        ]
    return rows(spark, "name string, found boolean", out)


@query("SELECT * FROM (VALUES ('own secret', 'v1'), ('within a text', 'user:v1'), ('of another domain', 'refused'), ('unknown', 'refused')) t(name, value)")
def config_secrets(spark, d):
    s = config.Secrets({"a": {"k": "v1"}, "b": {"k": "v2"}})

    def one(text):
        try:
            return s.resolve(text, "a")
        except config.ConfigError:
            return "refused"

    return rows(spark, "name string, value string", [("own secret", one("${SECRET:k}")), ("within a text", one("user:${SECRET:a/k}")), ("of another domain", one("${SECRET:b/k}")), ("unknown", one("${SECRET:z}"))])


@query("SELECT * FROM (VALUES ('same', true), ('other step', false), ('other name only', true), ('ordering', false)) t(change, same_version)")
def config_route_version(spark, d):
    r = {"from": "s", "auth": "none", "error_path": {"target": "dead"}, "steps": [{"filter": {"expr": "body.a > 1"}}]}
    v = config.route_version
    out = [("same", v(dict(reversed(r.items())))), ("other step", v(r | {"steps": [{"filter": {"expr": "body.a > 2"}}]})), ("other name only", v(r | {"description": "x"})), ("ordering", v(r | {"ordering": "required"}))]
    return rows(spark, "change string, same_version boolean", [(n, x == v(r)) for n, x in out])


@query("SELECT * FROM (VALUES ('missing', 'price'), ('type', 'name'), ('extra', 'more')) t(kind, field)")
def contract_static_check(spark, d):
    kind = messages(spark, d, "part").schema["body"].dataType
    contract = {"type": "object", "required": ["key", "price"], "properties": {"key": {"type": "integer"}, "name": {"type": "number"}, "price": {"type": "number"}}, "additionalProperties": False}
    return rows(spark, "kind string, field string", checks.check_contract('{"key": body.p_partkey, "name": body.p_name, "more": 1}', kind, contract))


@query("SELECT * FROM (VALUES ('total', 2), ('passed', 1), ('failed', 1)) t(name, n)")
def fixture_summary(spark, d):
    out = fixtures.summary([fixtures.Outcome("a", True, []), fixtures.Outcome("b", False, ["other body"])])
    return rows(spark, "name string, n int", list(out.items()))


@query("SELECT * FROM (VALUES ('arguments', true), ('no rows', true), ('many rows', true), ('deterministic', true), ('nulls', true), ('wrong arguments', true), ('expected', true)) t(name, held)")
def plugin_conformance(spark, d):
    out = conformance(spark, Function("twice", ("double",), "double", lambda x: x * 2), [(1.0,), (2.5,)], [2.0, 5.0])
    return rows(spark, "name string, held boolean", list(out.items()))


@query("SELECT * FROM (VALUES ('first', '1'), ('same again', '1'), ('compatible', '2'), ('latest', '2'), ('by number', '1'), ('not compatible', 'refused'), ('unknown', 'refused')) t(name, version)")
def schema_registry(spark, d):
    r = MemoryRegistry()
    one, two = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}, {"type": "object", "required": [], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}

    def told(f):
        try:
            return f()
        except RegistryError:
            return "refused"

    out = [("first", told(lambda: r.register("g", "s", one))), ("same again", told(lambda: r.register("g", "s", one))), ("compatible", told(lambda: r.register("g", "s", two)))]
    out += [("latest", told(lambda: r.get("g", "s")[1])), ("by number", told(lambda: r.get("g", "s", "1")[1])), ("not compatible", told(lambda: r.register("g", "s", one))), ("unknown", told(lambda: r.get("g", "t")[1]))]
    return rows(spark, "name string, version string", out)


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 THEN 'memory:g:order:1' END AS version FROM orders")
def contract_from_registry(spark, d):
    r = MemoryRegistry()
    r.register("g", "order", {"type": "object", "required": ["o_orderkey"], "properties": {"o_totalprice": {"type": "number", "minimum": 50000}}})
    df = steps.contract(messages(spark, d, "orders"), "order", spec=contract_of(r, Reference("order", "g")))
    return df.select(F.col("body.o_orderkey").alias("o_orderkey"), F.col("metadata.contract_version").alias("version"))
