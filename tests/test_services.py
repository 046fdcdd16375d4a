import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import lineage, metrics, stateful, steps
from sluice.operators.envelope import envelope
from sluice.plans import schema_registry
from sluice.plans.schema_registry import HttpRegistry, MemoryRegistry, Reference, RegistryError, contract_of
from sluice.sources import readers, sinks
from sluice.streaming import control

SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}


class Server:
    """A registry's REST interface in memory."""

    def __init__(self):
        self.schemas, self.up = {}, True

    def __call__(self, method, url, body):
        if not self.up:
            return 503, "down"
        path = url.removeprefix("http://r/")
        if path == "health":
            return 200, "{}"
        key, _, version = path.removeprefix("apis/registry/v3/groups/").partition("/versions")
        known = self.schemas.setdefault(key, [])
        if method == "POST":
            known.append(json.loads(body))
            return 200, json.dumps({"version": str(len(known))})
        if not version:
            return 200, json.dumps({"versions": [{"version": str(i + 1)} for i in range(len(known))]})
        i = int(version[1:]) - 1
        return (200, json.dumps(known[i])) if 0 <= i < len(known) else (404, "no such version")


@pytest.mark.parametrize("make", [MemoryRegistry, lambda: HttpRegistry("http://r/", Server())])
def test_registries_hold_the_same(make):
    r = make()
    assert r.register("g", "s", SCHEMA) == "1"
    assert r.register("g", "s", SCHEMA | {"title": "t"}) == "2"
    assert r.get("g", "s")[1] == "2" and r.get("g", "s", "1") == (SCHEMA, "1") and r.get("g", "s", "latest")[0]["title"] == "t"
    for bad in (("g", "other", "latest"), ("g", "s", "9")):
        with pytest.raises(RegistryError):
            r.get(*bad)
    for i in range(12):
        r.register("", "many", SCHEMA | {"title": str(i)})
    assert r.get("default", "many")[1] == "12"
    r.check()


def test_registry_failures(spark):
    r, server = MemoryRegistry(), Server()
    r.register("g", "s", SCHEMA)
    with pytest.raises(RegistryError):
        r.register("g", "s", SCHEMA | {"required": ["a", "b"]})
    with pytest.raises(RegistryError):
        r.register("g", "", SCHEMA)
    r.healthy = server.up = False
    for bad in (r, HttpRegistry("http://r", server), HttpRegistry("http://127.0.0.1:9")):
        with pytest.raises(RegistryError):
            bad.check()
    server.up = True
    h = HttpRegistry("http://r", server)
    h.register("g/1", "s", SCHEMA)
    spec = contract_of(h, Reference("s", "g/1"), strict=True)
    assert spec["version"] == "apicurio:g/1:s:1" and spec["strict"] and not schema_registry.compatible(SCHEMA, {"properties": {"a": {"type": "string"}}})
    out = steps.contract(envelope(spark.createDataFrame([(1,), (None,)], "a long")), "c", spec=spec)
    assert sorted(x._error is None for x in out.collect()) == [False, True]


def test_openlineage_sink(spark):
    events = spark.createDataFrame([(json.dumps({"n": i}),) for i in range(25)], "event string").coalesce(1)

    def send(payload, headers):
        n = [e["n"] for e in json.loads(payload)["events"]]
        assert len(n) <= 10 and headers["Content-Type"] == "application/json"
        return 400 if 10 in n else 503 if 20 in n else 201

    got = sinks.emit_openlineage(events, send, batch=10, wait=0.0).collect()
    by = {json.loads(r.event)["n"]: (r.status, r.attempts, r.ok) for r in got}
    assert by == {i: (201, 1, True) if i < 10 else (400, 1, False) if i < 20 else (503, 3, False) for i in range(25)}
    assert sinks.emit_openlineage(events.limit(0), send).collect() == []


def test_objects_are_put(spark, tmp_path):
    folder = str(tmp_path)

    def put(key, raw):
        with open(f"{folder}/{key.replace('/', '_')}", "wb") as f:
            f.write(raw)

    df = envelope(spark.createDataFrame([(1,), (2,), (2,)], "a long"))
    assert sinks.write_objects(df, "p", put).count() == 3
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == 2 and all(n == f"p_{hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()}.json" for n in names)


def test_pools_and_reload(spark, tmp_path):
    text = control.allocations({"b": 2, "a & c": 1})
    assert text.index("a &amp; c") < text.index('"b"') and "<weight>2</weight><minShare>2</minShare>" in text
    with pytest.raises(ValueError):
        control.allocations({"x": 0})
    with control.pool(spark, "b"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "b"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None

    log = []

    class Query:
        def __init__(self, name):
            self.name = name

        def stop(self):
            log.append(f"stop {self.name}")

        def awaitTermination(self, seconds):
            log.append(f"wait {self.name}")

    path = tmp_path / "c.yaml"

    def write(**exprs):
        routes = "".join(f"  {n}: {{from: s, auth: none, error_path: {{target: d}}, steps: [{{filter: {{expr: '{e}'}}}}]}}\n" for n, e in exprs.items())
        path.write_text(f"version: 1\nsources: {{s: {{type: file}}}}\nsinks: {{d: {{type: file}}}}\nroutes:\n{routes}")

    write(a="body.x", b="body.y")
    r = control.Reloader(str(path), lambda name, route: (log.append(f"start {name}"), Query(name))[1])
    assert r.refresh() == {"a": "started", "b": "started"} and r.refresh() == {}
    log.clear()
    write(a="body.z", c="body.y")
    assert r.refresh() == {"a": "reloaded", "b": "stopped", "c": "started"}
    assert log == ["stop b", "wait b", "stop a", "wait a", "start a", "start c"]
    path.write_text("version: 2")
    with pytest.raises(ValueError):
        r.refresh()
    assert set(r.running) == {"a", "c"}


def test_rsa_tokens(spark):
    r = random.Random(1)

    def prime(bits):
        while True:
            p = r.getrandbits(bits) | 1 << bits - 1 | 1
            if all(pow(r.randrange(2, p - 1), p - 1, p) == 1 for _ in range(12)):
                return p

    p, q = prime(512), prime(512)
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    import base64

    enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    text = enc(b'{"alg":"RS256"}') + "." + enc(b'{"sub":"ann","roles":["r"]}')
    size = (n.bit_length() + 7) // 8
    want = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(text.encode()).digest()
    padded = b"\0\1" + b"\xff" * (size - len(want) - 3) + b"\0" + want
    good = text + "." + enc(pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big"))
    hs = enc(b'{"alg":"none"}') + "." + enc(b'{"sub":"eve"}') + "."
    df = spark.createDataFrame([(good,), (good[:-6] + "AAAAAA",), (text + ".",), (hs,), (None,), ("x",)], "t string")
    got = [x.p and x.p.subject for x in df.select(readers.jwt_principal(F.col("t"), rsa=(n, e)).alias("p")).collect()]
    assert got == ["ann", None, None, None, None, None]
    assert [x.p and x.p.subject for x in df.select(readers.jwt_principal(F.col("t"), "secret").alias("p")).collect()] == [None] * 6
    assert [x.p and x.p.subject for x in df.select(readers.jwt_principal(F.col("t"), unsigned=True).alias("p")).collect()] == ["ann", "ann", "ann", "eve", None, None]
    with pytest.raises(ValueError):
        readers.jwt_principal(F.col("t"))


def test_repeated_tokens_multiply_nothing(spark):
    req = spark.createDataFrame([("POST", "/ingest/r", "", {"Authorization": "Bearer t"}, "{}", None)] * 3, "method string, path string, query string, headers map<string,string>, body string, received_at timestamp")
    who = "struct<subject:string,roles:array<string>,claims:map<string,string>,token:string>"
    principals = spark.createDataFrame([("t", ("b", [], {}, None)), ("t", ("a", [], {}, None)), ("t", ("a", [], {}, None)), (None, ("c", [], {}, None))], f"token string, principal {who}")
    good, all_ = readers.http_messages(req, True, principals)
    assert all_.count() == 3 and [x.metadata.principal.subject for x in good.collect()] == ["a"] * 3


def test_null_keys_are_a_key_of_their_own(spark):
    df = spark.createDataFrame([(None, 1, 1), ("", 2, 2), ("\0null", 3, 3), (None, 4, 4), ("", 5, 5)], "_key string, _t long, _id long").repartition(1)
    got = {r._id: r.n for r in stateful.fold(df, stateful.accepted(100), "n").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_percentiles_against_sorted_values(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([None, 0.0, -5.0, -3.5, 1e-3, 7.0, 7.01, r.random() * 1e6, r.random()])) for _ in range(900)] + [(None, 4.0), ("c", None)]
    for rule in ("collector", "viewer"):
        got = {x.k: x for x in metrics.latency_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", rule).collect()}
        assert set(got) == {"a", "b", None}
        for k, x in got.items():
            v = sorted(b for a, b in rows if a == k and b is not None)
            at = lambda p: v[int((len(v) - 1) * p / 100)] if rule == "collector" else v[min(len(v) * p // 100, len(v) - 1)]  # noqa: B023, E731
            assert (x.p50, x.p90, x.p99, x.n) == (at(50), at(90), at(99), len(v)) and x.total == pytest.approx(sum(v))


def test_ndjson_export(spark):
    df = envelope(spark.createDataFrame([(1, "x")], "a long, s string"), ingested_at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    lines = [json.loads(r.value) for r in lineage.export_ndjson(lineage.lineage_rows(df, subject_expr="body.s"), "2024-01-01", "2025-01-01").collect()]
    assert len(lines) == 1 and lines[0]["subject_id"] == "x" and lines[0]["created_at"] == "2024-05-06T07:08:09Z" and json.loads(lines[0]["message_body"]) == {"a": 1, "s": "x"}
    assert set(lines[0]) <= {x.split()[0] for x in lineage.RECORDS.split(", ")}
