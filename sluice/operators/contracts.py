"""Data contracts: JSON Schema keywords as column predicates.

``reason`` is NULL for a valid value, else the first violation. On a typed body, type checks that the schema decides
cost nothing at run time.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import values as V
from sluice.functions.values import Value

_IGNORED = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "version", "id", "definitions", "$defs", "deprecated", "readOnly", "writeOnly"}
# fixed values: patterns of the formats that are checked
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[-+]\d\d:\d\d)$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
}


class ContractError(ValueError):
    """A contract that can't be compiled."""


def _is(v: Value, name: str) -> Column:
    """Whether a present value has a JSON type."""
    if v.variant:
        kind = F.schema_of_variant(v.col)
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
        return {
            "string": kind == "STRING",
            "number": number,
            "integer": number & F.coalesce(V.number(v) == F.floor(V.number(v)), F.lit(False)),
            "boolean": kind == "BOOLEAN",
            "null": kind == "VOID",
            "array": kind.startswith("ARRAY"),
            "object": kind.rlike("^(OBJECT|STRUCT)"),
        }[name]
    if name == "integer":
        whole = isinstance(v.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return F.lit(True) if whole else V.number(v) == F.floor(V.number(v)) if v.number else F.lit(False)
    static = {"string": v.string or not (v.number or v.boolean or v.array or v.struct or v.map), "number": v.number, "boolean": v.boolean, "array": v.array, "object": v.struct or v.map, "null": False}
    if name not in static:
        raise ContractError(f"unknown type {name!r}")
    return F.lit(bool(static[name]))


def _field(v: Value, name: str) -> Value:
    from sluice.functions.compiler import Compiler

    return Compiler(v).field(v, name)


def _present(v: Value) -> Column:
    return F.lit(False) if v.missing else v.col.isNotNull()


def _elements(v: Value) -> Value:
    if v.array:
        return v
    if v.variant:
        return Value(F.try_variant_get(v.col, "$", "array<variant>"), T.ArrayType(T.VariantType()))
    return Value(F.lit(None).cast("array<string>"), T.ArrayType(T.StringType()))


def _const(v: Value, x) -> Column:
    from sluice.functions.compiler import Compiler
    from sluice.functions.values import constant

    if x is None:
        return _is(v, "null") if v.variant else ~_present(v)
    if isinstance(x, (dict, list)):
        return V.json(v) == json.dumps(x, separators=(",", ":"))
    return F.coalesce(Compiler(v).equal(v, constant(x)), F.lit(False))


def violations(v: Value, schema, at: str = "body", nullable: bool = False) -> list[tuple[Column, str]]:
    """(holds when violated, reason) pairs, for a value that is present."""
    if schema is True:
        return []
    if schema is False:
        return [(_present(v), f"{at}: nothing is allowed")]
    out: list[tuple[Column, str]] = []
    here = _present(v)
    known = set(_IGNORED)

    def add(bad: Column, reason: str):
        out.append((here & F.coalesce(bad, F.lit(False)), f"{at}: {reason}"))

    def take(k):
        known.add(k)
        return schema.get(k)

    kinds = take("type")
    if kinds is not None:
        names = kinds if isinstance(kinds, list) else [kinds]
        right = F.lit(False)
        for n in names:
            right = right | _is(v, n)
        add(~F.coalesce(right, F.lit(False)), f"not of type {' or '.join(names)}")
    number, is_number = V.number(v), _is(v, "number")
    for k, f in (
        ("minimum", lambda m: number < m),
        ("maximum", lambda m: number > m),
        ("exclusiveMinimum", lambda m: number <= m),
        ("exclusiveMaximum", lambda m: number >= m),
        ("multipleOf", lambda m: F.abs(number / m - F.round(number / m)) > 1e-9),
    ):
        if (m := take(k)) is not None and not isinstance(m, bool):
            add(is_number & f(float(m)), f"{k} {m}")
    if any(k in schema for k in ("pattern", "minLength", "maxLength", "format")):
        s, is_string = V.text(v), _is(v, "string")
        if (p := take("pattern")) is not None:
            add(is_string & ~s.rlike(p), f"pattern {p}")
        if (n := take("minLength")) is not None:
            add(is_string & (F.length(s) < n), f"minLength {n}")
        if (n := take("maxLength")) is not None:
            add(is_string & (F.length(s) > n), f"maxLength {n}")
        if (f := take("format")) is not None and f in FORMATS:
            add(is_string & ~s.rlike(FORMATS[f]), f"format {f}")
    if (xs := take("enum")) is not None:
        same = F.lit(False)
        for x in xs:
            same = same | _const(v, x)
        add(~same, "not one of the values allowed")
    if "const" in schema:
        add(~_const(v, take("const")), "not the constant")
    is_object = _is(v, "object")
    props = take("properties") or {}
    for name in take("required") or ():
        f = _field(v, name)
        add(is_object & ~_present(f), f"{name} is required")
    for name, sub in props.items():
        f = _field(v, name)
        if not f.missing:
            inner = violations(f, sub, f"{at}.{name}")
            out += [(here & is_object & c, r) for c, r in inner]
    extra = take("additionalProperties")
    if extra is False:
        if v.struct:
            for f in v.type.fields:
                if f.name not in props:
                    add(v.col.getField(f.name).isNotNull(), f"{f.name} is not allowed")
        else:
            keys = F.map_keys(v.col) if v.map else F.map_keys(F.try_variant_get(v.col, "$", "map<string,variant>"))
            add(is_object & (F.size(F.array_except(keys, F.array(*(F.lit(p) for p in props)).cast("array<string>"))) > 0), "more properties than allowed")
    elif isinstance(extra, dict) and v.map:
        more = F.map_filter(v.col, lambda k, _: ~k.isin(list(props) or [""]))
        bad = F.exists(F.map_values(more), lambda x: _any(violations(Value(x, v.type.valueType), extra)))
        add(bad, "an additional property is invalid")
    is_array = _is(v, "array")
    items = _elements(v) if any(k in schema for k in ("minItems", "maxItems", "items", "uniqueItems", "contains")) else None
    if (n := take("minItems")) is not None:
        add(is_array & (F.size(items.col) < n), f"minItems {n}")
    if (n := take("maxItems")) is not None:
        add(is_array & (F.size(items.col) > n), f"maxItems {n}")
    if take("uniqueItems"):
        texts = F.transform(items.col, lambda x: V.json(Value(x, items.type.elementType)))
        add(is_array & (F.size(F.array_distinct(texts)) < F.size(texts)), "items repeat")
    if (sub := take("items")) is not None:
        add(is_array & F.exists(items.col, lambda x: _any(violations(Value(x, items.type.elementType), sub))), "an item is invalid")
    if (sub := take("contains")) is not None:
        add(is_array & ~F.exists(items.col, lambda x: ~_any(violations(Value(x, items.type.elementType), sub))), "no item is as wanted")
    for sub in take("allOf") or ():
        out += violations(v, sub, at)
    if (subs := take("anyOf")) is not None:
        add(V.all_of([_any(violations(v, s)) for s in subs]), "none of anyOf")
    if (subs := take("oneOf")) is not None:
        n = F.lit(0)
        for s in subs:
            n = n + F.when(_any(violations(v, s)), 0).otherwise(1)
        add(n != 1, "not exactly one of oneOf")
    if (sub := take("not")) is not None:
        add(~_any(violations(v, sub)), "what is not allowed")
    if (sub := take("if")) is not None:
        test = _any(violations(v, sub))
        for k, cond in (("then", ~test), ("else", test)):
            if (s := take(k)) is not None:
                add(cond & _any(violations(v, s)), k)
    unknown = set(schema) - known - {"then", "else"}
    if unknown:
        raise ContractError(f"unsupported keyword {', '.join(sorted(unknown))}")
    return out


def _any(pairs) -> Column:
    out = F.lit(False)
    for c, _ in pairs:
        out = out | c
    return out


def reason(v: Value, schema) -> Column:
    """NULL if the value is valid, else the first violation. A body that is NULL violates every type but null."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    pairs = violations(v, schema)
    out = F.lit(None).cast("string")
    for c, r in reversed(pairs):
        out = F.when(c, F.lit(r)).otherwise(out)
    kinds = schema.get("type") if isinstance(schema, dict) else None
    if kinds and "null" not in (kinds if isinstance(kinds, list) else [kinds]):
        out = F.when(~_present(v), F.lit("body: missing")).otherwise(out)
    return out


def version_tag(schema) -> str:
    """sha256 of an inline schema's canonical JSON."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    return "sha256:" + hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def registry_tag(kind: str, group: str, subject: str, version: str) -> str:
    return f"{kind}:{group}:{subject}:{version}"


_SPARK = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def spark_type(schema) -> T.DataType:
    """The Spark type of a JSON Schema."""
    kinds = schema.get("type") if isinstance(schema, dict) else None
    names = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k and k != "null"]
    if len(names) != 1:
        return T.VariantType()
    if names[0] == "object":
        props = schema.get("properties")
        if not props:
            return T.VariantType()
        need = set(schema.get("required") or ())
        return T.StructType([T.StructField(n, spark_type(s), n not in need) for n, s in props.items()])
    if names[0] == "array":
        return T.ArrayType(spark_type(schema.get("items") or {}))
    return _SPARK[names[0]]


def fields(schema) -> list[dict]:
    """Facet fields of a contract: name, type, nullable."""
    need = set(schema.get("required") or ())
    out = []
    for name, s in (schema.get("properties") or {}).items():
        kinds = s.get("type", "any") if isinstance(s, dict) else "any"
        names = kinds if isinstance(kinds, list) else [kinds]
        out.append({"name": name, "type": next((k for k in names if k != "null"), "null"), "nullable": name not in need or "null" in names})
    return out
