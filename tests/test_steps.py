import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import contracts, errors, stateful, steps
from sluice.operators.envelope import alive, dead_letters, envelope, with_meta
from sluice.plans import checks
from sluice.plans.route import Route, bind_sources
from sluice.functions.values import Value


def env(spark, bodies, schema=None, **meta):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "n long, j string")
    return envelope(df, F.from_json("j", schema) if schema else F.parse_json("j"), keep=("n",), correlation_id=F.col("n").cast("string"), **meta)


def principal(roles, **claims):
    return F.struct(F.lit("s").alias("subject"), F.array(*map(F.lit, roles)).cast("array<string>").alias("roles"), F.create_map(*(F.lit(x) for kv in claims.items() for x in kv)).cast("map<string,string>").alias("claims"), F.lit(None).cast("string").alias("token"))


@pytest.mark.parametrize("schema", [None, "amount double, active boolean, status string"])
def test_filter(spark, schema):
    df = env(spark, [{"amount": 150, "active": True, "status": "pending"}, {"amount": 50, "active": False, "status": "pending"}], schema)
    for expr, want in (("body.amount > 100", [0]), ("body.active = true", [0]), ('body.status = "pending"', [0, 1]), ("true", [0, 1]), ("1 = 2", []), ("body.none", [])):
        assert sorted(r.n for r in steps.filter_rows(df, expr).collect()) == want


def test_translate_missing_is_null_or_error(spark):
    df = env(spark, [{"value": 1}])
    assert steps.translate(df, "body.nonexistent").first().body is None
    out = steps.translate(df, "body.nonexistent", 3, steps.Context(undefined="error"))
    assert out.first()._error.failed_step == 3


def test_route(spark):
    df = env(spark, [{"type": "a"}, {"type": "b"}, {"type": "A"}], "type string")
    got = {r.n: (r.metadata.route, r._error and r._error.error) for r in steps.route(df, "body.type", {"a": "x", "b": "y"}).collect()}
    assert got == {0: ("x", None), 1: ("y", None), 2: (None, "no matching route for value: A")}
    assert {r.metadata.route for r in steps.route(df, "body.type", {"a": "x"}, "z").collect()} == {"x", "z"}
    assert steps.route(env(spark, [{"p": 2}]), "body.p", {"2": "two"}).first().metadata.route == "two"


def test_errors_are_sticky_and_dead_letters_whole(spark):
    df = env(spark, [{"t": "a"}, {"t": "b"}], "t string")
    df = steps.route(df, "body.t", {"a": "x"}, at=0)
    df = steps.authorize(df, "rbac", ["r"], at=1)
    dead = {json.loads(r.body.original_message)["body"]["t"]: r for r in dead_letters(df).collect()}
    assert dead["b"].body.failed_step_type == "route" and dead["a"].body.failed_step_type == "authorize"
    assert dead["a"].metadata.stage == "error_path" and alive(df).count() == 0


def test_authorize(spark):
    p = principal(["user", "admin"], tier="gold")
    df = env(spark, [{"v": 1}], "v long", principal=p)
    assert steps.authorize(df, "rbac", ["admin"]).first()._error is None
    assert steps.authorize(df, "rbac", ["*"]).first()._error.error == "authorization_denied: insufficient roles"
    assert steps.authorize(env(spark, [{"v": 1}]), "rbac", ["admin"]).first()._error.error == "authorization_denied: no principal"
    assert steps.authorize(df, "abac", expr='principal.claims.tier = "gold"').first()._error is None
    assert steps.authorize(df, "abac", expr="body.v > 1").first()._error.error == "authorization_denied: policy evaluation failed"
    for bad in (("rbac", []), ("abac", None), ("other", None)):
        with pytest.raises(ValueError):
            steps.authorize(df, *bad)
    ctx = steps.Context()
    assert steps.authorize(df, "rbac", ["x"], ctx=ctx, on_deny="denied").count() == 0
    assert ctx.denied[0][0] == "denied" and ctx.denied[0][1].count() == 1


@pytest.mark.parametrize("schema", [None, "order_id long, customer struct<name:string,ssn:string>, payment struct<card:string>, items array<struct<a:string>>"])
def test_redact(spark, schema):
    df = env(spark, [{"order_id": 1, "customer": {"name": "n", "ssn": "s"}, "payment": {"card": "c"}, "items": [{"a": "x"}]}], schema)
    out = steps.redact(df, ["customer.ssn", "payment.card", "missing.path", "items.a"], "[REDACTED]", "deep")
    b = json.loads(out.select(F.to_json("body")).first()[0])
    assert b == {"order_id": 1, "customer": {"name": "n", "ssn": "[REDACTED]"}, "payment": {"card": "[REDACTED]"}, "items": [{"a": "[REDACTED]"}]}
    b = json.loads(steps.redact(df, ["customer.*", "items.a"]).select(F.to_json("body")).first()[0])
    assert b["customer"] in ({"name": "***REDACTED***", "ssn": "***REDACTED***"}, {"name": "n", "ssn": "s"}) and b["items"] == [{"a": "x"}]
    assert steps.obligations(df, [{"type": "other"}]).first()._error.error.startswith("unknown obligation")
    with pytest.raises(ValueError):
        steps.redact(df, [])


SCHEMA = {"type": "object", "required": ["amount", "currency", "account_id"], "properties": {"amount": {"type": "number", "minimum": 0.01}, "currency": {"type": "string", "pattern": "^[A-Z]{3}$"}, "account_id": {"type": "string"}}}


@pytest.mark.parametrize("schema", [None, "amount double, currency string, account_id string"])
def test_contract(spark, schema):
    rows = [{"amount": 1, "currency": "USD", "account_id": "a"}, {"amount": 0, "currency": "USD", "account_id": "a"}, {"amount": 1, "currency": "usd", "account_id": "a"}, {"amount": 1, "currency": "USD"}]
    df = env(spark, rows, schema)
    out = {r.n: r for r in steps.contract(df, "c", spec={"schema": SCHEMA, "version": "1.0.0"}).collect()}
    assert out[0].metadata.contract_version == "1.0.0" and out[0].metadata.contract_violation is None
    assert all(out[i].metadata.contract_violation.severity == "warning" for i in (1, 2, 3))
    strict = {r.n: r._error for r in steps.contract(df, "c", spec={"schema": SCHEMA, "strict": True}).collect()}
    assert strict[0] is None and all(strict[i].error.startswith("contract_violation: ") for i in (1, 2, 3))


KEYWORDS = [
    ({"type": "integer"}, 1, 1.5), ({"type": ["string", "null"]}, "a", 1), ({"maximum": 5}, 5, 6), ({"exclusiveMinimum": 1}, 2, 1), ({"multipleOf": 0.5}, 1.5, 1.2), ({"enum": [1, "a"]}, "a", "b"), ({"const": True}, True, False),
    ({"minLength": 2}, "ab", "a"), ({"maxLength": 2}, "ab", "abc"), ({"format": "date"}, "2024-01-31", "2024-13-01"), ({"type": "array", "minItems": 2}, [1, 2], [1]), ({"maxItems": 1}, [1], [1, 2]), ({"uniqueItems": True}, [1, 2], [1, 1]),
    ({"items": {"type": "number"}}, [1, 2], [1, "x"]), ({"contains": {"const": 2}}, [1, 2], [1]), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 2, 4), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 6, 4),
    ({"oneOf": [{"minimum": 5}, {"maximum": 3}]}, 6, 4), ({"not": {"type": "string"}}, 1, "a"), ({"if": {"type": "string"}, "then": {"minLength": 2}}, "ab", "a"), ({"properties": {"a": {"properties": {"b": {"type": "number"}}}}}, {"a": {"b": 1}}, {"a": {"b": "x"}}),
    ({"additionalProperties": False, "properties": {"a": {}}}, {"a": 1}, {"a": 1, "b": 2}),
]


def test_contract_keywords(spark):
    df = spark.range(1)
    cols = []
    for i, (schema, good, bad) in enumerate(KEYWORDS):
        for name, x in (("good", good), ("bad", bad)):
            v = F.parse_json(F.lit(json.dumps(x)))
            cols.append(contracts.reason(Value(v, df.select(v).schema[0].dataType), {k: s for k, s in schema.items()}).alias(f"{name}{i}"))
    row = df.select(*cols).first()
    assert [k for k in row.asDict() if (row[k] is None) != k.startswith("good")] == []
    with pytest.raises(contracts.ContractError):
        contracts.reason(Value(F.lit(1), df.schema[0].dataType), {"dependentSchemas": {}})
    assert contracts.version_tag(SCHEMA).startswith("sha256:") and contracts.version_tag(SCHEMA) == contracts.version_tag(json.dumps(SCHEMA))
    assert contracts.fields(SCHEMA)[0] == {"name": "amount", "type": "number", "nullable": False}


def test_claims(spark):
    df = env(spark, [{"a": 1}, {"a": 2}], "a long")
    out, blobs = steps.claim_check(df)
    assert {r.body._claim_check.size for r in out.collect()} == {7}
    back = steps.claim_resolve(out, blobs)
    assert sorted(r.body for r in back.collect()) == ['{"a":1}', '{"a":2}']
    assert {r._error.error for r in steps.claim_resolve(out, blobs.limit(0)).collect()} == {"claim resolve: ticket not found"}
    wrong = blobs.withColumn("payload", F.lit("x"))
    assert {r._error.error for r in steps.claim_resolve(out, wrong).collect()} == {"claim resolve: hash mismatch"}
    assert steps.claim_resolve(df, blobs).collect() == df.collect()


@pytest.mark.parametrize("schema", [None, "items array<struct<id:long,name:string>>, value string"])
def test_split(spark, schema):
    df = env(spark, [{"items": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}, {"value": "x"}, {"items": []}], schema)
    out = steps.split(df, "body.items", "body.name").collect()
    good = sorted((r.n, r.metadata.splitter_facet.element_index, r.metadata.splitter_facet.total_elements) for r in out if not r._error)
    assert good == [(0, 0, 2), (0, 1, 2)] and [r.n for r in out if r._error] == [1]
    assert {r.n for r in steps.split(df, "body.items", on_non_array="skip").collect()} == {0}
    assert {r.n for r in steps.split(df, "body.value").collect() if r._error} == {0, 1, 2}


def timed(spark, rows):
    df = spark.createDataFrame(rows, "n long, k string, s long")
    return envelope(df, F.struct("k", "n"), keep=("n",), ingested_at=F.timestamp_seconds("s"))


def test_aggregate_count(spark):
    df = timed(spark, [(1, "ORD-001", 1), (2, "ORD-002", 2), (3, "ORD-001", 3), (4, "ORD-001", 4)])
    got = {(r.body.correlation_key, tuple(m.body.n for m in r.body.messages), r.body.completion_trigger) for r in stateful.aggregate(df, "k", count=2, tie="n").collect()}
    assert got == {("ORD-001", (1, 3), "count_reached"), ("ORD-001", (4,), "timeout"), ("ORD-002", (2,), "timeout")}


def test_aggregate_time_and_timeout(spark):
    df = timed(spark, [(1, "a", 0), (2, "a", 5), (3, "a", 12), (4, "a", 13), (5, "a", 14), (6, "b", 0)])
    got = sorted((r.body.correlation_key, tuple(m.body.n for m in r.body.messages), r.body.completion_trigger) for r in stateful.aggregate(df, "k", "time_window", window_ms=10_000, max_messages=2, tie="n").collect())
    assert got == [("a", (1, 2), "max_messages_reached"), ("a", (3, 4), "max_messages_reached"), ("a", (5,), "window_expired"), ("b", (6,), "window_expired")]
    got = sorted(tuple(m.body.n for m in r.body.messages) for r in stateful.aggregate(df, "k", count=4, timeout_ms=10_000, tie="n").collect())
    assert got == [(1, 2), (3, 4, 5), (6,)]
    with pytest.raises(ValueError):
        stateful.aggregate(df, "k", "time_window", window_ms=10)


def test_aggregate_null_key(spark):
    df = timed(spark, [(1, None, 0), (2, "a", 1)])
    out = stateful.aggregate(df, "k", count=1, tie="n").collect()
    assert sorted(bool(r._error) for r in out) == [False, True]
    ctx = steps.Context()
    assert stateful.aggregate(df, "k", count=1, on_null_key="skip", tie="n", ctx=ctx).count() == 1
    assert ctx.taps[0][1].first().n == 1


def test_idempotent(spark):
    df = timed(spark, [(1, "a", 0), (2, "a", 60), (3, "a", 3599), (4, "a", 3600), (5, None, 1), (6, None, 2), (7, "a", 3700)])
    assert sorted(r.n for r in stateful.idempotent(df, "body.k", 60, "n").collect()) == [1, 4, 5]
    assert sorted(r.n for r in stateful.idempotent(df, "body.k", None, "n").collect()) == [1, 5]


def test_fold_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = timed(spark, [(i, "a", i) for i in range(20)])
        assert sorted(len(r.body.messages) for r in stateful.aggregate(df, "k", count=7, timeout_ms=100_000, tie="n").collect()) == [6, 7, 7]
        assert sorted(r.n for r in stateful.rate_limit(df, "body.k", 2, 5000, "n").where("admitted").collect()) == [0, 1, 5, 6, 10, 11, 15, 16]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_errors_and_backoff(spark):
    rows = [(None, "unknown"), ("Timeout reached", "transient"), ("connection refused", "transient"), ("context canceled", "permanent"), ("bad input", "permanent")]
    df = spark.createDataFrame(rows, "m string, want string")
    assert all(r[0] == r[1] for r in df.select(errors.classify_error(F.col("m")), "want").collect())
    got = [r[0] for r in spark.range(1, 8).select(errors.backoff_ms(F.col("id"), 1000)).collect()]
    assert got == [1000, 2000, 4000, 8000, 16000, 30000, 30000]
    lo = spark.range(1).select(errors.backoff_ms(F.lit(1), 1000, 100, F.rand())).first()[0]
    assert 1000 <= lo < 1100


def test_whole_route_and_binding(spark):
    spec = {"from": "in", "steps": [{"filter": {"expr": "body.v > 1"}}, {"wiretap": {"sink": "t"}}, {"translate": {"expr": '{"w": body.v * 2}'}}, {"route": {"expr": "body.w", "cases": {"4": {"target": "four"}}}}]}
    res = Route("r", spec).apply(env(spark, [{"v": 1}, {"v": 2}, {"v": 3}], "v long"))
    assert [(r.body.w, r.metadata.route) for r in res.ok.collect()] == [(4.0, "four")]
    assert res.dead.count() == 1 and res.sink("t")[0].count() == 2
    out = bind_sources({"routes": {"a": spec, "b": {"from": "in", "steps": [{"filter": {"expr": True}}]}}}, {"in": env(spark, [{"v": 2}], "v long")})
    assert out["b"].ok.count() == 1 and out["a"].ok.first().metadata.route_version == Route("a", spec).version


def test_static_contract_check(spark):
    from pyspark.sql import types as T

    body = T.DataType.fromDDL("struct<id:string,amount:double>")
    schema = {"type": "object", "required": ["id", "total"], "properties": {"id": {"type": "string"}, "total": {"type": "number"}}, "additionalProperties": False}
    assert checks.check_contract('{"id": body.id, "total": body.amount}', body, schema) == []
    assert checks.check_contract('{"id": body.amount, "x": 1}', body, schema) == [("missing", "total"), ("type", "id"), ("extra", "x")]


def test_metadata_is_only_set_on_live_rows(spark):
    df = steps.route(env(spark, [{"t": "a"}], "t string"), "body.t", {"b": "x"})
    assert with_meta(df, stage=F.lit("s")).first().metadata.stage is None


def test_replay_without_limit_takes_all(spark):
    from sluice.plans import catalog
    from sluice.sources import readers

    dead = Route("r", {"steps": [{"authorize": {"mode": "rbac", "require_roles": ["nobody"]}}]}).apply(env(spark, [{"v": i} for i in range(150)])).dead
    assert readers.replay(dead).count() == 100 and readers.replay(dead, limit=None).count() == 150
    plan = catalog.dlq_replay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
