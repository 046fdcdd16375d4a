"""Compiles a route to DataFrame transformations: one plan for batch and for streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import stateful, steps
from sluice.operators.envelope import alive, dead_letters, with_meta
from sluice.plans.config import ConfigError, route_version, step_kind


@dataclass
class Result:
    """What a route gives: messages, dead letters, side outputs by sink, and blobs of claim checks."""

    ok: DataFrame
    dead: DataFrame
    taps: list[tuple[str, DataFrame]] = field(default_factory=list)
    blobs: DataFrame | None = None

    def sink(self, name: str) -> list[DataFrame]:
        return [d for n, d in self.taps if n == name]


def _case_table(cases) -> dict[str, str]:
    return {str(k): v["target"] if isinstance(v, dict) else v for k, v in (cases or {}).items()}


class Route:
    """A compiled route. ``decisions`` is the policy table of pbac steps, ``blobs`` that of claim resolution, ``tie`` a
    column that orders messages of one instant."""

    def __init__(self, name: str, spec: dict, functions=None, decisions: DataFrame | None = None, blobs: DataFrame | None = None, tie: str | None = None, undefined: str = "null"):
        self.name, self.spec, self.functions, self.decisions, self.blobs, self.tie, self.undefined = name, spec, functions, decisions, blobs, tie, undefined
        self.version = spec.get("route_version") or route_version(spec)
        self.kinds = [step_kind(s) for s in spec.get("steps", [])]
        self.contracts = {c["id"]: c for c in spec.get("contracts") or ()}

    def apply(self, df: DataFrame) -> Result:
        """Runs the steps over envelopes; ``df`` may carry the tie column."""
        ctx = steps.Context(self.contracts, self.functions, self.blobs, undefined=self.undefined)
        df = with_meta(df, route=F.lit(self.name), route_version=F.lit(self.version))
        made = None
        for at, (kind, step) in enumerate(zip(self.kinds, self.spec["steps"])):
            s = step[kind] if isinstance(step[kind], dict) else {}
            if kind == "filter":
                df = steps.filter_rows(df, s["expr"], at, ctx)
            elif kind == "translate":
                df = steps.translate(df, s["expr"], at, ctx)
            elif kind == "route":
                df = steps.route(df, s["expr"], _case_table(s.get("cases")), s.get("default"), at, ctx)
            elif kind == "wiretap":
                df = steps.wiretap(df, s["sink"], at, ctx)
            elif kind == "authorize":
                deny = (s.get("on_deny") or {}).get("target")
                df = steps.authorize(df, s.get("mode", "rbac"), s.get("require_roles"), s.get("expr"), at, ctx, self.decisions, deny)
                if s.get("obligations"):
                    df = steps.obligations(df, s["obligations"], at, ctx)
            elif kind == "contract":
                df = steps.contract(df, s["id"], at, ctx)
            elif kind == "claim_check":
                df, made = steps.claim_check(df, bool(s.get("remove_payload")), s.get("ticket_field_path") or "_claim_check", s.get("content_type") or "application/json", at, ctx)
            elif kind == "claim_resolve":
                blobs = made if self.blobs is None else self.blobs
                if blobs is None:
                    raise ConfigError("claim_resolve needs a blob table")
                df = steps.claim_resolve(df, blobs, s.get("ticket_field_path") or "_claim_check", at, ctx)
            elif kind == "split":
                df = steps.split(df, s["expr"], s.get("output_expr"), s.get("on_non_array", "error_path"), at, ctx)
            elif kind == "aggregate":
                a = {k: s[k] for k in ("strategy", "count", "timeout_ms", "window_ms", "max_messages", "on_null_key", "output_expr") if k in s}
                df = stateful.aggregate(df, s["key"], at=at, ctx=ctx, tie=self.tie, **a)
            else:
                df = stateful.idempotent(df, s["key_expr"], s.get("ttl_minutes", stateful.TTL_MINUTES), self.tie, at, ctx)
        return Result(alive(df), dead_letters(df), [*ctx.taps, *ctx.denied], made)


def bind_sources(cfg: dict, sources: dict[str, DataFrame], **options) -> dict[str, Result]:
    """Every route over its sources: one DataFrame feeds all routes that name it."""
    out = {}
    for name, spec in cfg["routes"].items():
        names = spec["from"] if isinstance(spec["from"], list) else [spec["from"]]
        missing = [n for n in names if n not in sources]
        if missing:
            raise ConfigError(f"route {name!r}: unknown source {missing[0]!r}")
        df = sources[names[0]]
        for n in names[1:]:
            df = df.unionByName(sources[n])
        out[name] = Route(name, spec, **options).apply(df)
    return out


def fan_out(df: DataFrame, routes: dict[str, Column]) -> DataFrame:
    """A copy of each message for each route whose condition holds, with metadata.route set."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in routes.items())), lambda x: x.isNotNull())
    return df.withColumn("_route", F.explode(names)).withColumn("metadata", F.col("metadata").withField("route", F.col("_route"))).drop("_route")


def union_outputs(results: dict[str, Result]) -> DataFrame:
    """All routes' messages for one shared sink: bodies as JSON text."""
    out = None
    for r in results.values():
        kind = r.ok.schema["body"].dataType.simpleString()
        d = r.ok.select("headers", (F.col("body") if kind == "string" else F.to_json("body")).alias("body"), "metadata")
        out = d if out is None else out.unionByName(d)
    return out


def workers(spec: dict) -> int | None:
    """Partitions a route's order asks for: 1 if required, else as many as there are."""
    return 1 if spec.get("ordering") == "required" else None


def ordered(df: DataFrame, spec: dict, tie: str | None = None) -> DataFrame:
    """Messages in ingest order within each partition, and over all of them where the route requires it."""
    keys = ["metadata.ingested_at", *([tie] if tie else [])]
    return df.orderBy(*keys) if spec.get("ordering") == "required" else df.sortWithinPartitions(*keys)
