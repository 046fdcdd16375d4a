"""Runs route fixtures: given messages, expected outputs, drops and errors."""

from __future__ import annotations

import json
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.envelope import PRINCIPAL, envelope
from sluice.plans.route import Route


@dataclass
class Outcome:
    name: str
    passed: bool
    detail: str = ""


def messages(spark: SparkSession, inputs: list[dict], schema: str | None = None) -> DataFrame:
    """Envelopes of inputs (body, headers, principal), with their number in the header fixture."""
    rows = [(i, json.dumps(x.get("body")), {k: v if isinstance(v, str) else json.dumps(v) for k, v in (x.get("headers") or {}).items()}, json.dumps(x["principal"]) if x.get("principal") else None) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "n int, body string, headers map<string,string>, principal string")
    body = F.from_json("body", schema) if schema else F.parse_json("body")
    kind = PRINCIPAL
    return envelope(df, body, F.map_concat("headers", F.create_map(F.lit("fixture"), F.col("n").cast("string"))), principal=F.from_json("principal", kind))


def run(spark: SparkSession, route: Route, fixtures: list[dict], schema: str | None = None) -> list[Outcome]:
    """All fixtures in one job each for messages and dead letters."""
    got = route.apply(messages(spark, [f.get("input") or {} for f in fixtures], schema))
    kind = got.ok.schema["body"].dataType.simpleString()
    body = F.col("body") if kind == "string" else F.to_json("body")
    ok = {r[0]: r for r in got.ok.select(F.col("headers")["fixture"], body, F.col("metadata.route")).collect()}
    dead = {r[0]: r for r in got.dead.select(F.col("headers")["fixture"], F.col("body.error"), F.col("body.failed_step_type")).collect()}
    out = []
    for i, f in enumerate(fixtures):
        key, name = str(i), f.get("name", str(i))
        if f.get("expected_error"):
            text = dead[key][1] if key in dead else ""
            want = f.get("expected_error_type") or (f["expected_error"] if isinstance(f["expected_error"], str) else "")
            out.append(Outcome(name, key in dead and want in text, text or "no error"))
        elif f.get("expected_dropped"):
            out.append(Outcome(name, key not in ok and key not in dead, "not dropped"))
        elif key not in ok:
            out.append(Outcome(name, False, dead[key][1] if key in dead else "dropped"))
        else:
            bad = ""
            if "expected_output" in f:
                want = f["expected_output"]
                want = want.get("body", want) if isinstance(want, dict) else want
                have = ok[key][1] if kind == "string" else json.loads(ok[key][1])
                if have != want:
                    bad = f"got {have!r}"
            if "expected_route" in f and ok[key][2] != f["expected_route"]:
                bad = f"routed to {ok[key][2]!r}"
            out.append(Outcome(name, not bad, bad))
    return out


def load(path: str) -> list[dict]:
    """Fixtures of a file, under ``fixtures`` or ``cases``."""
    data = yaml.safe_load(open(path)) or {}
    return data.get("fixtures") or data.get("cases") or []


def summary(outcomes: list[Outcome]) -> dict[str, int]:
    passed = sum(o.passed for o in outcomes)
    return {"total": len(outcomes), "passed": passed, "failed": len(outcomes) - passed}
