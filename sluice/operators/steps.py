"""Stateless steps of a route. Each takes and returns an envelope DataFrame; ``at`` is its place in the route."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import values as V
from sluice.functions.values import Value
from sluice.operators import contracts
from sluice.operators.envelope import compile_on, fail, ok, with_meta


@dataclass
class Context:
    """What a route's steps share: contracts by id, functions, the blob table, and side outputs by sink."""

    contracts: dict[str, dict] = field(default_factory=dict)
    functions: object = None
    blobs: DataFrame | None = None
    taps: list[tuple[str, DataFrame]] = field(default_factory=list)
    denied: list[tuple[str, DataFrame]] = field(default_factory=list)
    undefined: str = "null"


def filter_rows(df: DataFrame, expr: str | bool, at: int = 0, ctx: Context | None = None) -> DataFrame:
    """Keeps messages whose value is truthy; drops the others without a trace. Failed messages pass."""
    v = compile_on(df, _text(expr), functions=ctx and ctx.functions)
    return df.where(~ok() | V.predicate(v))


def _text(expr) -> str:
    return str(expr).lower() if isinstance(expr, bool) else str(expr)


def translate(df: DataFrame, expr: str, at: int = 0, ctx: Context | None = None) -> DataFrame:
    """The body becomes the expression's value; headers and metadata stay. Failed messages keep their body's JSON only
    where the type changes: their body is NULL then, and ``_error`` tells."""
    v = compile_on(df, expr, functions=ctx and ctx.functions)
    kind = df.schema["body"].dataType
    value = v.col.cast("string") if v.missing else v.col
    if ctx is not None and ctx.undefined == "error":
        df = fail(df, v.col.isNull() if not v.missing else F.lit(True), "translate: undefined", at, "translate")
    new = F.when(ok(), value)
    return df.withColumn("body", new.otherwise(F.col("body")) if kind == v.type else new)


def route(df: DataFrame, expr: str, cases: dict[str, str] | None = None, default: str | None = None, at: int = 0, ctx: Context | None = None) -> DataFrame:
    """Sets metadata.route by a case table; no match without a default is an error."""
    v = compile_on(df, expr, functions=ctx and ctx.functions)
    key = V.go_text(v)
    target = F.lit(default).cast("string")
    if cases:
        table = F.create_map(*(F.lit(x) for kv in cases.items() for x in kv))
        target = F.coalesce(F.try_element_at(table, key), target)
    df = fail(df, target.isNull(), F.concat(F.lit("no matching route for value: "), key), at, "route")
    return with_meta(df, target.isNotNull(), route=target)


def wiretap(df: DataFrame, sink: str, at: int = 0, ctx: Context | None = None) -> DataFrame:
    """Copies what arrives here to a second sink; the main flow goes on unchanged."""
    if ctx is not None:
        ctx.taps.append((sink, df.where(ok()).drop("_error")))
    return df


def authorize(df: DataFrame, mode: str, require_roles: list[str] | None = None, expr: str | None = None, at: int = 0, ctx: Context | None = None, decisions: DataFrame | None = None, on_deny: str | None = None) -> DataFrame:
    """rbac: any role in common; abac: a truthy expression; pbac: a decision table (subject, allow, reason). Of several
    decisions on a subject a denial wins, the one with the first reason; a null ``allow`` denies."""
    before = df
    principal = F.col("metadata.principal")
    denied = "authorization_denied: "
    df = fail(df, principal.isNull(), denied + "no principal", at, "authorize")
    if mode == "rbac":
        if not require_roles:
            raise ValueError("rbac needs roles")
        df = fail(df, ~F.coalesce(F.arrays_overlap(F.col("metadata.principal.roles"), F.array(*map(F.lit, require_roles))), F.lit(False)), denied + "insufficient roles", at, "authorize")
    elif mode == "abac":
        if not expr:
            raise ValueError("abac needs an expression")
        df = fail(df, ~V.truthy(compile_on(df, _text(expr), principal=True, functions=ctx and ctx.functions)), denied + "policy evaluation failed", at, "authorize")
    elif mode == "pbac":
        if decisions is None:
            raise ValueError("pbac needs decisions")
        reason = F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string")
        one = F.min(F.struct(F.coalesce("allow", F.lit(False)).alias("allow"), reason.isNull().alias("bare"), reason.alias("reason"))).alias("d")
        d = decisions.where("subject IS NOT NULL").groupBy(F.col("subject").alias("_subject")).agg(one).select("_subject", F.col("d.allow").alias("_allow"), F.col("d.reason").alias("_reason"))
        df = df.join(d, F.col("metadata.principal.subject") == F.col("_subject"), "left")
        df = fail(df, ~F.coalesce("_allow", F.lit(False)), F.concat(F.lit(denied), F.coalesce("_reason", F.lit("denied by policy"))), at, "authorize").drop("_subject", "_allow", "_reason")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if on_deny and ctx is not None:
        new = ~ok() & F.col("_error.error").startswith("authorization_denied") & (F.col("_error.failed_step") == at)
        ctx.denied.append((on_deny, df.where(new)))
        return df.where(~new)
    return df


def _redacted(v: Value, parts: list[str], replacement: str, deep: bool) -> Column | None:
    """The value with a path replaced; None if there is no such path."""
    part, last = parts[0], len(parts) == 1
    text = F.lit(replacement)
    if part == "*":
        if v.map:
            if last:
                return F.transform_values(v.col, lambda k, x: text)
            return F.transform_values(v.col, lambda k, x: (lambda r: x if r is None else r)(_redacted(Value(x, v.type.valueType), parts[1:], replacement, deep))) if deep else None
        if not v.struct:
            return None
        out = v.col
        for f in v.type.fields:
            inner = Value(v.col.getField(f.name), f.dataType)
            new = text if last else _redacted(inner, parts[1:], replacement, deep) if deep else None
            if new is not None:
                out = out.withField(f"`{f.name}`", new)
        return out
    if v.struct:
        kind = next((f.dataType for f in v.type.fields if f.name == part), None)
        if kind is None:
            return None
        inner = Value(v.col.getField(part), kind)
        if last:
            return F.when(v.col.isNotNull(), v.col.withField(f"`{part}`", text))
        new = _redacted(inner, parts[1:], replacement, deep) if inner.struct or inner.map or deep else None
        return None if new is None else F.when(v.col.isNotNull(), v.col.withField(f"`{part}`", new))
    if v.map:
        if last and v.type.valueType == T.StringType():
            return F.transform_values(v.col, lambda k, x: F.when(k == part, text).otherwise(x))
        return None
    if v.array and deep:
        inner = []

        def one(x):
            r = _redacted(Value(x, v.type.elementType), parts, replacement, deep)
            inner[:] = [r]
            return x if r is None else r

        out = F.transform(v.col, one)
        return out if inner[0] is not None else None
    return None


def redact(df: DataFrame, fields: list[str], replacement: str = "***REDACTED***", depth: str = "shallow", at: int = 0, ctx: Context | None = None, timestamp: Column | None = None) -> DataFrame:
    """Replaces dotted paths of the body; missing paths are ignored, ``*`` stands for every field, depth deep or
    recursive also goes through arrays. Other values stay as they are, to the digit."""
    if not fields:
        raise ValueError("redact_fields obligation 'fields' array is empty")
    deep = depth in ("deep", "recursive")
    kind = df.schema["body"].dataType
    if isinstance(kind, T.VariantType):
        new = F.col("body")
        for path in fields:
            # bound by a lambda, so that what earlier paths made is computed once
            new = F.get(F.transform(F.array(new), lambda v: _redacted_variant(v, path.split("."), replacement, deep)), F.lit(0))  # noqa: B023
        df = df.withColumn("body", F.when(ok(), new).otherwise(F.col("body")))
    else:
        for path in fields:
            v = Value(F.col("body"), df.schema["body"].dataType)
            new = _redacted(v, path.split("."), replacement, deep)
            if new is not None:
                df = df.withColumn("body", new)
    facet = F.struct(F.lit("redact_fields").alias("obligation_type"), F.array(*map(F.lit, fields)).alias("fields_redacted"), F.lit(replacement).alias("replacement"), (F.lit(None).cast("string") if timestamp is None else timestamp).alias("timestamp"))
    return with_meta(df, obligation_facet=facet)


#: Arrays in arrays that a deep path goes through, one in the other without an object between.
NESTED = 2


def _redacted_variant(v: Column, parts: list[str], replacement: str, deep: bool, nested: int = 0) -> Column:
    """A variant with a path replaced; as it is where there is no such path. Objects are taken apart one level a part."""
    part, last = parts[0], len(parts) == 1
    kind = F.schema_of_variant(v)
    text = F.parse_json(F.lit(_json_text(replacement)))

    def field(k, x):
        if last:
            new = text
        elif part == "*" and not deep:
            return x
        else:
            new = _redacted_variant(x, parts[1:], replacement, deep)
        return new if part == "*" else F.when(k == part, new).otherwise(x)

    fields = F.try_variant_get(v, "$", "map<string,variant>")
    out = F.when(kind.startswith("OBJECT<"), F.to_variant_object(F.transform_values(fields, field)))
    if deep and nested < NESTED:
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _redacted_variant(x, parts, replacement, deep, nested + 1))
        out = out.when(kind.startswith("ARRAY<"), F.to_variant_object(each))
    return out.otherwise(v)


def _json_text(x: str) -> str:
    import json

    return json.dumps(x)


def obligations(df: DataFrame, items: list[dict], at: int = 0, ctx: Context | None = None) -> DataFrame:
    """Applies obligations in order; an unknown type fails every message."""
    for o in items:
        if o.get("type") == "redact_fields":
            p = o.get("parameters") or {}
            df = redact(df, p.get("fields") or [], p.get("replacement", "***REDACTED***"), p.get("depth", "shallow"), at, ctx)
        else:
            df = fail(df, F.lit(True), f"unknown obligation type: {o.get('type')}", at, "authorize")
    return df


def contract(df: DataFrame, contract_id: str, at: int = 0, ctx: Context | None = None, spec: dict | None = None) -> DataFrame:
    """Validates the body. A pass stamps the contract's version; a violation fails the message if the contract is
    strict, else marks it (and goes to on_violation, if the contract names one)."""
    spec = spec or (ctx.contracts if ctx else {}).get(contract_id)
    if spec is None:
        raise ValueError(f"unknown contract {contract_id!r}")
    why = contracts.reason(Value(F.col("body"), df.schema["body"].dataType), spec["schema"])
    df = df.withColumn("_why", F.when(ok(), why))
    df = with_meta(df, F.col("_why").isNull(), contract_version=F.lit(str(spec.get("version") or contracts.version_tag(spec["schema"]))))
    if spec.get("strict"):
        return fail(df, F.col("_why").isNotNull(), F.concat(F.lit("contract_violation: "), "_why"), at, "contract").drop("_why")
    mark = F.struct(F.lit(contract_id).alias("contract_id"), F.col("_why").alias("reason"), F.lit("warning").alias("severity"))
    df = with_meta(df, F.col("_why").isNotNull(), contract_violation=mark)
    if spec.get("on_violation") and ctx is not None:
        bad = ok() & F.col("_why").isNotNull()
        ctx.denied.append((spec["on_violation"], df.where(bad).drop("_why")))
        df = df.where(~F.coalesce(bad, F.lit(False)))
    return df.drop("_why")


TICKET = "struct<ticket:string,size:bigint,content_type:string,hash:string>"


def claim_check(df: DataFrame, remove_payload: bool = False, ticket_field: str = "_claim_check", content_type: str = "application/json", at: int = 0, ctx: Context | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, blobs). A blob is the body's JSON; the ticket is its content's hash, so equal bodies share a blob."""
    kind = df.schema["body"].dataType
    payload = V.json(Value(F.col("body"), kind))
    df = df.withColumn("_payload", F.when(ok(), payload))
    digest = F.sha2(F.col("_payload").cast("binary"), 256)
    ticket = F.struct(digest.alias("ticket"), F.octet_length("_payload").cast("bigint").alias("size"), F.lit(content_type).alias("content_type"), F.concat(F.lit("sha256:"), digest).alias("hash")).cast(TICKET)
    blobs = df.where(ok()).select(digest.alias("ticket"), F.col("_payload").alias("payload"), F.concat(F.lit("sha256:"), digest).alias("hash")).dropDuplicates(["ticket"])
    if remove_payload:
        body = F.when(ok(), F.struct(ticket.alias(ticket_field)))
    elif isinstance(kind, T.StructType):
        body = F.col("body").withField(f"`{ticket_field}`", F.when(ok(), ticket))
    else:
        body = F.col("body")
    out = df.withColumn("body", body).drop("_payload")
    facet = F.struct(F.lit("claim_check").alias("split_expr"), F.lit(1).alias("total_elements"), F.lit(0).alias("element_index"), F.lit("payload_checked").alias("split_trigger"))
    return with_meta(out, F.col("metadata.splitter_facet").isNull(), splitter_facet=facet), blobs


def claim_resolve(df: DataFrame, blobs: DataFrame, ticket_field: str = "_claim_check", at: int = 0, ctx: Context | None = None) -> DataFrame:
    """The body becomes the blob's text. Messages without a ticket stay (their body as JSON); an unknown ticket or
    another hash is an error."""
    kind = df.schema["body"].dataType
    has = isinstance(kind, T.StructType) and ticket_field in kind.fieldNames()
    if not has:
        return df
    t = f"body.`{ticket_field}`"
    # a ticket may be stored several times
    b = blobs.where("ticket IS NOT NULL").groupBy(F.col("ticket").alias("_ticket")).agg(F.min("payload").alias("_payload"))
    out = df.join(b, F.col(f"{t}.ticket") == F.col("_ticket"), "left")
    given = F.col(f"{t}.ticket").isNotNull()
    out = fail(out, given & F.col("_ticket").isNull(), "claim resolve: ticket not found", at, "claim_resolve")
    same = F.concat(F.lit("sha256:"), F.sha2(F.col("_payload").cast("binary"), 256)) == F.col(f"{t}.hash")
    out = fail(out, given & ~same, "claim resolve: hash mismatch", at, "claim_resolve")
    return out.withColumn("body", F.when(given, F.col("_payload")).otherwise(F.to_json("body"))).drop("_ticket", "_payload")


def split(df: DataFrame, expr: str, output_expr: str | None = None, on_non_array: str = "error_path", at: int = 0, ctx: Context | None = None) -> DataFrame:
    """A message for each element, in order; headers, correlation id, principal and contract version stay. A value that
    is missing or no array fails (error_path) or gives nothing (skip); an empty array gives nothing."""
    v = compile_on(df, expr, functions=ctx and ctx.functions)
    if v.array:
        listed, kind = v.col, v.type.elementType
    elif v.variant:
        is_array = F.schema_of_variant(v.col).startswith("ARRAY")
        listed, kind = F.when(is_array, F.try_variant_get(v.col, "$", "array<variant>")), T.VariantType()
    else:
        listed, kind = F.lit(None).cast("array<string>"), T.StringType()
    df = df.withColumn("_list", F.when(ok(), listed))
    if on_non_array == "skip":
        df = df.where(~ok() | F.col("_list").isNotNull())
    else:
        df = fail(df, F.col("_list").isNull(), "split: expression did not give an array", at, "split")
    others = [c for c in df.columns if c not in ("body", "_list")]
    good = df.where(ok()).select(*others, F.size("_list").alias("_n"), F.posexplode("_list").alias("_i", "body"))
    facet = F.struct(F.lit(expr).alias("split_expr"), F.col("_n").alias("total_elements"), F.col("_i").alias("element_index"), F.lit("split").alias("split_trigger"))
    good = with_meta(good, splitter_facet=facet).drop("_n", "_i")
    if output_expr:
        o = compile_on(good, output_expr, functions=ctx and ctx.functions)
        good, kind = good.withColumn("body", o.col), o.type
    if on_non_array == "skip":
        return good.select(*others[:1], *(c for c in good.columns if c not in others[:1]))
    dead = df.where(~ok()).withColumn("body", F.lit(None).cast(kind)).select(*good.columns)
    return good.unionByName(dead)


def fan_out(df: DataFrame) -> Column:
    """The route label that delivery partitions by."""
    return F.col("metadata.route")
