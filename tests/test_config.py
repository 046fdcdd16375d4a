import json
import time

import pytest
import yaml
from pyspark.sql import functions as F

from sluice.operators import lineage, metrics
from sluice.plans import checks, config, fixtures
from sluice.plans.catalog import CONFIG, FLAGSHIP
from sluice.plans.route import Route
from sluice.sources import readers, sinks
from sluice.streaming import runner


def base(**route):
    return {"version": 1, "sources": {"in": {"type": "file"}}, "sinks": {"output": {"type": "file"}, "e": {"type": "file"}}, "routes": {"r": {"from": "in", "auth": "none", "error_path": {"target": "e"}, "steps": [{"filter": {"expr": True}}], **route}}}


def test_validation():
    assert config.loads(base())["warnings"] == []
    assert config.loads(base(auth=None))["warnings"]
    with pytest.raises(config.ConfigError):
        config.loads(base(auth=None), auth="strict")
    for bad in (base(steps=[]), base(error_path=None), base(error_path={"target": "x"}), base(ordering="some"), base(steps=[{"filter": {}, "route": {}}]), base(steps=[{"magic": {}}]), base(**{"from": "x"}), {**base(), "extra": 1}, {**base(), "version": 2}):
        with pytest.raises(config.ConfigError):
            config.loads(bad)


def test_fragments_imports_params(tmp_path):
    (tmp_path / "f.yaml").write_text(yaml.safe_dump({"fragments": {"base": {"steps": [{"filter": {"expr": "1 = 1"}}]}}}))
    (tmp_path / "unused.yaml").write_text(yaml.safe_dump({"fragments": {"other": [{"filter": {"expr": "true"}}]}}))
    cfg = base(steps=[{"fragment": "base"}, {"translate": {"expr": "body"}}])
    cfg["imports"] = ["f.yaml", "unused.yaml"]
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(cfg))
    out = config.load(tmp_path / "r.yaml")
    assert [config.step_kind(s) for s in out["routes"]["r"]["steps"]] == ["filter", "translate"] and out["unused_imports"] == ["unused.yaml"]
    parent = base(retry={"max_attempts": "${PARAM:n}", "note": "n=${PARAM:n}"})
    parent["$params"] = {"n": 3}
    (tmp_path / "parent.yaml").write_text(yaml.safe_dump(parent))
    (tmp_path / "child.yaml").write_text(yaml.safe_dump({"$import": "parent.yaml", "$params": {"n": 5}, "routes": {"r": {"steps": [{"translate": {"expr": "body"}}]}}}))
    r = config.load(tmp_path / "child.yaml")["routes"]["r"]
    assert r["retry"] == {"max_attempts": 5, "note": "n=5"} and len(r["steps"]) == 2
    (tmp_path / "a.yaml").write_text("$import: b.yaml\n")
    (tmp_path / "b.yaml").write_text("$import: a.yaml\n")
    for name in ("a.yaml", "nothing.yaml"):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / name)
    with pytest.raises(config.ConfigError):
        config.substitute("${PARAM:x}", {})


def test_versions_and_secrets():
    a, b = base(), base(steps=[{"filter": {"expr": False}}])
    va, vb = (config.loads(x)["routes"]["r"]["route_version"] for x in (a, b))
    assert len(va) == 64 and va != vb and va == config.loads(base())["routes"]["r"]["route_version"]
    s = config.Secrets({"pay": {"key": "k1"}})
    assert s.resolve({"p": "x-${SECRET:key}"}, "pay") == {"p": "x-k1"} and s.resolve("${SECRET:pay/key}", "pay") == "k1"
    for ref, domain in (("${SECRET:pay/key}", "other"), ("${SECRET:none}", "pay")):
        with pytest.raises(config.ConfigError):
            s.resolve(ref, domain)


def test_fixture_runner(spark):
    spec = {"steps": [{"filter": {"expr": "body.amount > 100"}}, {"route": {"expr": "body.kind", "cases": {"a": "x"}}}]}
    out = fixtures.run(
        spark,
        Route("r", spec),
        [
            {"name": "kept", "input": {"body": {"amount": 150, "kind": "a"}}, "expected_output": {"body": {"amount": 150, "kind": "a"}}, "expected_route": "x"},
            {"name": "dropped", "input": {"body": {"amount": 50}}, "expected_dropped": True},
            {"name": "failed", "input": {"body": {"amount": 150, "kind": "b"}}, "expected_error": "no matching route"},
            {"name": "wrong", "input": {"body": {"amount": 150, "kind": "a"}}, "expected_output": {"amount": 1}},
        ],
    )
    assert [o.passed for o in out] == [True, True, True, False]
    assert fixtures.summary(out) == {"total": 4, "passed": 3, "failed": 1}


def test_critique_and_impact(spark):
    cfg = {**CONFIG, "unused_imports": ["x"]}
    assert {f[2] for f in checks.critique("c", cfg)} == {"redundancy", "best-practice", "security", "clarity"}
    got = {(r.target_type, r.target_name): r.level for r in metrics.impact(checks.impact_edges(spark, CONFIG)).collect()}
    assert got["source", "in"] == "medium" and got["step-type", "filter"] == "low"


def test_percentiles_by_both_rules(spark):
    df = spark.createDataFrame([("r", 10 * i) for i in range(1, 11)], "route string, ms long")
    a = metrics.latency_percentiles(df, ["route"], "ms").first()
    b = metrics.latency_percentiles(df, ["route"], "ms", "viewer").first()
    assert (a.p50, a.p90, a.p99, a.average) == (50, 90, 90, 55) and (b.p50, b.p90, b.p99) == (60, 100, 100)
    v = F.array(*(F.lit(10 * i) for i in range(1, 11)))
    assert spark.range(1).select(metrics.percentile_sorted(v, 0.5), metrics.percentile_ranked(v, 50)).first() == (50, 60)


def test_retention_and_purge(spark, tmp_path):
    from sluice.operators.envelope import envelope

    df = envelope(spark.createDataFrame([("premium", "s1"), ("basic", "s2"), (None, "s1")], "tier string, who string"), ingested_at=F.lit("2024-01-01").cast("timestamp"), route=F.lit("r"))
    rec = lineage.lineage_rows(df, {"premium-90": 90}, 'body.tier = "premium" ? "premium-90" : "nope"', None, "body.who")
    assert sorted((r.subject_id, r.retention_policy, r.expires_at.isoformat()[:10]) for r in rec.collect()) == [("s1", "default", "2024-01-31"), ("s1", "premium-90", "2024-03-31"), ("s2", "default", "2024-01-31")]
    keep, ev = lineage.purge(rec, rec.where("subject_id = 's1'"), "asked", "2024-02-01")
    assert keep.count() == 1 and ev.first().purged_count == 2
    keep, _ = lineage.reap(rec, F.lit("2024-02-15").cast("timestamp"))
    assert keep.count() == 0
    keep, _ = lineage.reap(rec, F.lit("2024-02-15").cast("timestamp"), whole_subjects=False)
    assert keep.count() == 1
    path = f"file://{tmp_path}/records"
    rec.write.parquet(path)
    lineage.rewrite(spark.read.parquet(path).where("subject_id = 's2'"), path)
    assert spark.read.parquet(path).count() == 1
    assert json.loads(lineage.openlineage_events(df, "ns", [{"name": "a", "type": "string", "nullable": True}]).first()[0])["job"] == {"namespace": "ns", "name": "r"}


def test_file_source_and_jsonl_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"x": 1}')
    (tmp_path / "in/empty.txt").write_text("")
    df = readers.file_messages(spark, f"{tmp_path}/in", settle_seconds=0)
    assert [r.body for r in df.collect()] == ['{"x": 1}'] and df.first().headers["source_file"] == "a.txt"
    seen = df.select(F.col("headers")["source_path"].alias("source_path"), F.col("metadata.ingested_at").alias("modified"))
    assert readers.file_messages(spark, f"{tmp_path}/in", seen, settle_seconds=0).count() == 0
    sinks.write_json_lines(df.drop("_error"), f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out").first()[0])["body"] == '{"x": 1}'
    obj = readers.object_messages(spark, f"{tmp_path}/in")
    assert obj.select(F.try_variant_get("body", "$.x", "int")).first()[0] == 1


def test_cdc_and_tokens(spark):
    df = spark.createDataFrame([('{"op":"c","source":{"table":"t"},"after":{"a":1},"before":{},"ts_ms":5}', '{"type":"update","table":"t","data":{"a":2},"old":{"a":1},"ts":9}')], "d string, m string")
    d, m = df.select(readers.debezium(F.col("d")), readers.maxwell(F.col("m"))).first()
    assert tuple(d) == ("t", "INSERT", 5, None, '{"a":1}') and tuple(m) == ("t", "update", 9, '{"a":1}', '{"a":2}')
    now = F.lit("2024-01-01").cast("timestamp")
    t = spark.range(1).select(sinks.exchange_token(F.lit("bob"), F.array(F.lit("r")), "svc", "key", now).alias("t"))
    p, other, late = t.select(readers.jwt_principal(F.col("t"), "key", now), readers.jwt_principal(F.col("t"), "wrong", now), readers.jwt_principal(F.col("t"), "key", F.lit("2024-01-02").cast("timestamp"))).first()
    assert p.subject == "bob" and p.roles == ["r"] and other is None and late is None


def test_post_retries(spark):
    reqs = spark.createDataFrame([("ok", {}), ("bad", {}), ("down", {})], "body string, headers map<string,string>")
    got = {r.body: (r.status, r.attempts, r.ok) for r in sinks.post(reqs, lambda b, h: {"ok": 200, "bad": 400, "down": 503}[b], wait=0.0).collect()}
    assert got == {"ok": (200, 1, True), "bad": (400, 1, False), "down": (503, 3, False)}


def stream(spark, tmp_path, rows):
    from sluice.operators.envelope import envelope

    spark.createDataFrame(rows, "n long, k string, s long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("n long, k string, s long").parquet(f"{tmp_path}/in")
    return envelope(s, F.struct("k", "n"), keep=("n",), ingested_at=F.timestamp_seconds("s"))


def test_stream_equals_batch(spark, tmp_path):
    spec = {"steps": [{"filter": {"expr": "body.n > 1"}}, {"route": {"expr": "body.k", "cases": {"a": "x"}}}]}
    route = Route("r", spec)
    s = stream(spark, tmp_path, [(1, "a", 1), (2, "a", 2), (3, "b", 3)])
    q = runner.run_route(s, route, runner.json_writer(f"{tmp_path}/ok", f"{tmp_path}/dead"), f"{tmp_path}/c", once=True)
    q.awaitTermination(120)
    ok = [json.loads(r.value)["body"]["n"] for r in spark.read.text(f"{tmp_path}/ok").collect()]
    dead = [json.loads(r.value)["body"]["error"] for r in spark.read.text(f"{tmp_path}/dead").collect()]
    assert ok == [2] and dead == ["no matching route for value: b"]


def test_stream_state(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, "a", 0), (2, "a", 60), (3, "a", 3600), (4, "b", 1)])
    q = runner.deduplicated(s, "body.k", 60).writeStream.format("memory").queryName("dedup").outputMode("append").option("checkpointLocation", f"{tmp_path}/d").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(json.loads(r.message)["body"]["n"] for r in spark.sql("select * from dedup").collect()) == [1, 3, 4]
    q = runner.aggregated(s, "body.k", count=2, timeout_ms=10_000_000).writeStream.format("memory").queryName("agg").outputMode("append").option("checkpointLocation", f"{tmp_path}/a").start()
    for _ in range(240):  # with timers the query never runs out of batches
        if spark.sql("select * from agg").count():
            break
        time.sleep(0.5)
    q.stop()
    got = [(r.key, r["count"], r.trigger) for r in spark.sql("select * from agg").collect()]
    assert ("a", 2, "count_reached") in got


def test_flagship_plan_pushes_down(spark):
    cfg = config.loads(FLAGSHIP)
    df = readers.parquet_messages(spark, "/root/testdata/sf0.001/events.parquet")
    ok = Route("purchases", cfg["routes"]["purchases"]).apply(df).ok
    plan = ok.select("body.amount", "metadata.route")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "EqualTo(event_type,purchase)" in plan and "props" not in plan.split("ReadSchema")[1] and "Python" not in plan
