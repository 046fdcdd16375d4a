"""The language's functions as columns: name -> f(compiler, context, *arguments)."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import values as V
from sluice.functions.parser import ExpressionError
from sluice.functions.values import Value, common_type, missing

_DOUBLE, _LONG, _STRING, _BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _array(v: Value) -> Value:
    from sluice.functions.compiler import _element

    return _element(v)


def _self(c, at):
    return c.whole(at)


def _text(v: Value):
    return V.text(v)


def _int(v: Value):
    return F.floor(V.number(v)).cast("int")


def _regex(r) -> str:
    flags = "".join(x for x in r[2] if x in "im")
    return (f"(?{flags})" if flags else "") + r[1]


def _is_regex(x) -> bool:
    return isinstance(x, tuple)


def _quote(v: Value):
    """A string column as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(V.text(v), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _call(f, *args: Value) -> Value:
    """Calls a function with as many arguments as it takes."""
    names = getattr(f, "names", None)
    return f(*args[: len(names)]) if names is not None else f(args[0])


# -- strings ----------------------------------------------------------------------------------------------------------


def string(c, at, v=None, pretty=None):
    v = _self(c, at) if v is None else v
    return Value(V.text(v), _STRING)


def length(c, at, v=None):
    v = _self(c, at) if v is None else v
    return Value(F.length(V.text(v) if v.variant else v.col.cast("string")).cast("bigint") if v.string or v.variant else F.lit(None).cast("bigint"), _LONG)


def substring(c, at, s, start, n=None):
    s, i = _text(s), _int(start)
    i = F.when(i < 0, F.greatest(F.length(s) + i, F.lit(0))).otherwise(i)
    k = F.length(s) if n is None else F.greatest(_int(n), F.lit(0))
    return Value(F.substr(s, i + 1, k), _STRING)


def substring_before(c, at, s, mark):
    s, m = _text(s), _text(mark)
    at_ = F.position(m, s)
    return Value(F.when(at_ > 0, F.substr(s, F.lit(1), at_ - 1)).otherwise(s), _STRING)


def substring_after(c, at, s, mark):
    s, m = _text(s), _text(mark)
    at_ = F.position(m, s)
    return Value(F.when(at_ > 0, F.substr(s, at_ + F.length(m))).otherwise(s), _STRING)


def uppercase(c, at, s=None):
    return Value(F.upper(_text(_self(c, at) if s is None else s)), _STRING)


def lowercase(c, at, s=None):
    return Value(F.lower(_text(_self(c, at) if s is None else s)), _STRING)


def trim(c, at, s=None):
    return Value(F.trim(F.regexp_replace(_text(_self(c, at) if s is None else s), r"\s+", " ")), _STRING)


def pad(c, at, s, width, char=None):
    s, w = _text(s), _int(width)
    fill = F.lit(" ") if char is None else _text(char)
    n = F.greatest(F.abs(w) - F.length(s), F.lit(0))
    more = F.substr(F.repeat(fill, n + 1), F.lit(1), n)
    return Value(F.when(w < 0, F.concat(more, s)).otherwise(F.concat(s, more)), _STRING)


def contains(c, at, s, p):
    s = _text(s)
    return Value(s.rlike(_regex(p)) if _is_regex(p) else F.contains(s, _text(p)), _BOOL)


def split(c, at, s, p, limit=None):
    s = _text(s)
    out = F.split(s, F.lit(_regex(p)) if _is_regex(p) else _quote(p))
    if not _is_regex(p) and p.const == "":
        out = F.split(s, "(?!^)(?!$)")
    if limit is not None:
        out = F.slice(out, 1, F.greatest(_int(limit), F.lit(0)))
    return Value(out, T.ArrayType(_STRING))


def join(c, at, v, sep=None):
    v = _array(v)
    parts = F.transform(v.col, lambda x: V.text(Value(x, v.type.elementType)))
    if sep is None or sep.const is not None:
        return Value(F.array_join(parts, "" if sep is None else str(sep.const)), _STRING)
    return Value(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, _text(sep), x)), _STRING)


def match(c, at, s, p, limit=None):
    if not _is_regex(p):
        raise ExpressionError("$match takes a regular expression")
    found = F.regexp_extract_all(_text(s), F.lit(_regex(p)), F.lit(0))
    if limit is not None:
        found = F.slice(found, 1, F.greatest(_int(limit), F.lit(0)))
    kind = T.StructType([T.StructField("match", _STRING)])
    return Value(F.transform(found, lambda m: F.struct(m.alias("match"))), T.ArrayType(kind))


def replace(c, at, s, p, by, limit=None):
    s, b = _text(s), _text(by)
    if limit is None:
        return Value(F.regexp_replace(s, F.lit(_regex(p)), b) if _is_regex(p) else F.replace(s, _text(p), b), _STRING)
    if _is_regex(p):
        raise ExpressionError("$replace has no limit with a regular expression")
    parts = F.split(s, _quote(p))
    n = F.least(_int(limit), F.size(parts) - 1)
    head = F.aggregate(F.slice(parts, 2, n), F.get(parts, F.lit(0)), lambda a, x: F.concat(a, b, x))
    tail = F.aggregate(F.slice(parts, n + 2, F.greatest(F.size(parts) - n - 1, F.lit(0))), F.lit(""), lambda a, x: F.concat(a, _text(p), x))
    return Value(F.concat(head, tail), _STRING)


def base64encode(c, at, s):
    return Value(F.base64(_text(s).cast("binary")), _STRING)


def base64decode(c, at, s):
    return Value(F.try_to_binary(_text(s), F.lit("base64")).cast("string"), _STRING)


def encode_url(c, at, s):
    return Value(F.replace(F.url_encode(_text(s)), F.lit("+"), F.lit("%20")), _STRING)


def decode_url(c, at, s):
    return Value(F.try_url_decode(_text(s)), _STRING)


def format_number(c, at, v, picture, options=None):
    if picture.const is None:
        raise ExpressionError("the picture of $formatNumber is a constant")
    return Value(_formatted(V.number(v), picture.const), _STRING)


def _formatted(x, picture: str):
    whole, dot, frac = picture.partition(".")
    scale, least = len(frac), frac.count("0")
    s = F.format_number(x, scale)
    if "," not in whole:
        s = F.replace(s, F.lit(","), F.lit(""))
    if scale > least:
        s = F.regexp_replace(s, rf"(\.\d{{{least}}}\d*?)0+$", "$1")
        s = F.regexp_replace(s, r"\.$", "")
    digits = whole.count("0")
    if digits > 1 and "," not in whole:
        sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        body = F.regexp_replace(s, "^-", "")
        need = F.greatest(F.lit(digits) - F.length(F.substring_index(body, ".", 1)), F.lit(0))
        s = F.concat(sign, F.repeat(F.lit("0"), need), body)
    return s


def format_base(c, at, v, base=None):
    b = 10 if base is None else base.const
    if not isinstance(b, int):
        raise ExpressionError("the base of $formatBase is a constant")
    return Value(F.lower(F.conv(F.bround(V.number(v)).cast("bigint").cast("string"), 10, -b)), _STRING)


# -- numbers ----------------------------------------------------------------------------------------------------------


def number(c, at, v=None):
    v = _self(c, at) if v is None else v
    if v.string:
        return Value(v.col.try_cast("double"), _DOUBLE)
    if v.boolean:
        return Value(v.col.cast("double"), _DOUBLE)
    if v.variant:
        return Value(F.coalesce(V.number(v), F.try_variant_get(v.col, "$", "string").try_cast("double")), _DOUBLE)
    return Value(V.number(v), _DOUBLE)


def _numeric(f):
    return lambda c, at, v=None: Value(f(V.number(_self(c, at) if v is None else v)), _DOUBLE)


def round_(c, at, v, n=None):
    digits = 0 if n is None else n.const
    if not isinstance(digits, int):
        raise ExpressionError("the precision of $round is a constant")
    return Value(F.bround(V.number(v).cast("decimal(38,12)"), digits).cast("double"), _DOUBLE)


def power(c, at, a, b):
    return Value(F.pow(V.number(a), V.number(b)), _DOUBLE)


def random(c, at):
    return Value(F.rand(), _DOUBLE)


def _numbers(v: Value):
    v = _array(v)
    return F.filter(F.transform(v.col, lambda x: V.number(Value(x, v.type.elementType))), lambda x: x.isNotNull())


def sum_(c, at, v):
    return Value(F.aggregate(_numbers(v), F.lit(0.0), lambda a, x: a + x), _DOUBLE)


def max_(c, at, v):
    return Value(F.array_max(_numbers(v)), _DOUBLE)


def min_(c, at, v):
    return Value(F.array_min(_numbers(v)), _DOUBLE)


def average(c, at, v):
    n = _numbers(v)
    return Value(F.try_divide(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), F.size(n).cast("double")), _DOUBLE)


# -- booleans and types -----------------------------------------------------------------------------------------------


def boolean(c, at, v=None):
    return Value(V.boolean(_self(c, at) if v is None else v), _BOOL)


def not_(c, at, v):
    return Value(~F.coalesce(V.boolean(v), F.lit(False)), _BOOL)


def exists(c, at, v):
    return Value(F.lit(v.null) if v.missing else v.col.isNotNull(), _BOOL)


def type_(c, at, v):
    if v.variant:
        kind = F.schema_of_variant(v.col)
        out = (
            F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.rlike("^(OBJECT|STRUCT)"), "object").when(v.col.isNotNull(), "number")
        )
        return Value(out, _STRING)
    if v.missing:
        return Value(F.lit("null" if v.null else None).cast("string"), _STRING)
    name = "number" if v.number else "boolean" if v.boolean else "array" if v.array else "object" if v.struct or v.map else "string"
    return Value(F.when(v.col.isNotNull(), F.lit(name)), _STRING)


# -- arrays -----------------------------------------------------------------------------------------------------------


def count(c, at, v):
    if v.missing:
        return Value(F.lit(0).cast("bigint"), _LONG)
    v = _array(v)
    return Value(F.when(v.col.isNull(), F.lit(0)).otherwise(F.size(v.col)).cast("bigint"), _LONG)


def append(c, at, a, b):
    a, b = _array(a), _array(b)
    kind = common_type([a.type.elementType, b.type.elementType])
    if kind is None:
        kind = T.VariantType()
        widen = lambda v: Value(F.transform(v.col, lambda x: V.variant(Value(x, v.type.elementType))), T.ArrayType(kind))
        a, b = widen(a), widen(b)
    empty = F.array().cast(T.ArrayType(kind))
    return Value(F.concat(F.coalesce(V.to_type(a, T.ArrayType(kind)), empty), F.coalesce(V.to_type(b, T.ArrayType(kind)), empty)), T.ArrayType(kind))


def sort(c, at, v, f=None):
    v = _array(v)
    kind = v.type.elementType
    if f is None:
        if isinstance(kind, T.VariantType):
            return Value(F.array_sort(v.col, lambda a, b: F.when(V.number(Value(a, kind)) < V.number(Value(b, kind)), -1).when(V.number(Value(a, kind)) > V.number(Value(b, kind)), 1).otherwise(0)), v.type)
        return Value(F.array_sort(v.col), v.type)
    # the function tells whether its first argument comes after its second
    after = lambda a, b: F.coalesce(V.boolean(_call(f, Value(a, kind), Value(b, kind))), F.lit(False))
    return Value(F.array_sort(v.col, lambda a, b: F.when(after(a, b), 1).when(after(b, a), -1).otherwise(0)), v.type)


def reverse(c, at, v):
    v = _array(v)
    return Value(F.reverse(v.col), v.type)


def shuffle(c, at, v):
    v = _array(v)
    return Value(F.shuffle(v.col), v.type)


def distinct(c, at, v):
    v = _array(v)
    if isinstance(v.type.elementType, T.VariantType):
        texts = F.array_distinct(F.transform(v.col, lambda x: F.to_json(x)))
        return Value(F.transform(texts, F.try_parse_json), v.type)
    return Value(F.array_distinct(v.col), v.type)


def zip_(c, at, *vs):
    vs = [_array(v) for v in vs]
    n = F.least(*(F.size(v.col) for v in vs)) if len(vs) > 1 else F.size(vs[0].col)
    kind = common_type([v.type.elementType for v in vs])
    kind = T.VariantType() if kind is None else kind
    row = lambda i: F.array(*(V.to_type(Value(F.get(v.col, i), v.type.elementType), kind) for v in vs))
    return Value(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), row), T.ArrayType(T.ArrayType(kind)))


# -- objects ----------------------------------------------------------------------------------------------------------


def _as_map(v: Value) -> Value:
    if v.map:
        return v
    if v.struct:
        kind = common_type([f.dataType for f in v.type.fields])
        kind = T.VariantType() if kind is None else kind
        pairs = [x for f in v.type.fields for x in (F.lit(f.name), V.to_type(Value(v.col.getField(f.name), f.dataType), kind))]
        return Value(F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull()), T.MapType(_STRING, kind))
    if v.variant:
        return Value(F.try_variant_get(v.col, "$", "map<string,variant>"), T.MapType(_STRING, T.VariantType()))
    raise ExpressionError("an object is needed")


def keys(c, at, v=None):
    v = _self(c, at) if v is None else v
    if v.array:
        out = c.mapped(v, lambda x: keys(c, at, x))
        return Value(F.array_distinct(out.col), out.type)
    return Value(F.map_keys(_as_map(v).col), T.ArrayType(_STRING))


def lookup(c, at, v, key):
    if key.const is not None:
        return c.field(v, str(key.const))
    m = _as_map(v)
    return Value(F.try_element_at(m.col, V.text(key)), m.type.valueType)


def spread(c, at, v):
    m = _as_map(v)
    kind = T.MapType(_STRING, m.type.valueType)
    return Value(F.transform(F.map_entries(m.col), lambda e: F.create_map(e["key"], e["value"])), T.ArrayType(kind))


def merge(c, at, v):
    if not v.array:
        return v
    m = _as_map(Value(F.get(v.col, F.lit(0)), v.type.elementType))
    entries = F.flatten(F.transform(v.col, lambda x: F.map_entries(_as_map(Value(x, v.type.elementType)).col)))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return Value(F.map_from_arrays(names, F.transform(names, last)), T.MapType(_STRING, m.type.valueType))


def sift(c, at, v, f=None):
    v, f = (v, f) if f is not None else (_self(c, at), v)
    m = _as_map(v)
    return Value(F.map_filter(m.col, lambda k, x: F.coalesce(V.boolean(_call(f, Value(x, m.type.valueType), Value(k, _STRING))), F.lit(False))), m.type)


def each(c, at, v, f=None):
    v, f = (v, f) if f is not None else (_self(c, at), v)
    m = _as_map(v)
    entry = T.StructType([T.StructField("key", _STRING), T.StructField("value", m.type.valueType)])
    return c.mapped(Value(F.map_entries(m.col), T.ArrayType(entry)), lambda e: _call(f, Value(e.col["value"], m.type.valueType), Value(e.col["key"], _STRING)))


# -- functions of functions -------------------------------------------------------------------------------------------


def _indexed(v: Value, f):
    kinds = []

    def g(x, i):
        r = _call(f, Value(x, v.type.elementType), Value(i.cast("bigint"), _LONG), v)
        kinds[:] = [r]
        return r

    return g, kinds


def map_(c, at, v, f):
    v = _array(v)
    g, kinds = _indexed(v, f)
    col = F.transform(v.col, lambda x, i: g(x, i).col)
    return Value(F.filter(col, lambda x: x.isNotNull()), T.ArrayType(kinds[0].type))


def filter_(c, at, v, f):
    v = _array(v)
    g, _ = _indexed(v, f)
    return Value(F.filter(v.col, lambda x, i: F.coalesce(V.boolean(g(x, i)), F.lit(False))), v.type)


def reduce_(c, at, v, f, init=None):
    v = _array(v)
    kind = v.type.elementType
    if init is None:
        start, rest = Value(F.get(v.col, F.lit(0)), kind), F.slice(v.col, 2, F.greatest(F.size(v.col) - 1, F.lit(0)))
    else:
        start, rest = init, v.col
    to = _call(f, start, Value(F.get(v.col, F.lit(0)), kind)).type
    return Value(F.aggregate(rest, V.to_type(start, to), lambda a, x: V.to_type(_call(f, Value(a, to), Value(x, kind)), to)), to)


def single(c, at, v, f=None):
    v = _array(v)
    kept = v if f is None else filter_(c, at, v, f)
    return Value(F.when(F.size(kept.col) == 1, F.get(kept.col, F.lit(0))), v.type.elementType)


# -- time -------------------------------------------------------------------------------------------------------------

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def now(c, at):
    return Value(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), _ISO), _STRING)


def millis(c, at):
    return Value(F.unix_millis(F.current_timestamp()), _LONG)


def from_millis(c, at, v, picture=None):
    return Value(F.date_format(F.to_utc_timestamp(F.timestamp_millis(F.floor(V.number(v)).cast("bigint")), F.current_timezone()), _ISO if picture is None else str(picture.const)), _STRING)


def to_millis(c, at, v, picture=None):
    t = F.try_to_timestamp(V.text(v)) if picture is None else F.try_to_timestamp(V.text(v), F.lit(str(picture.const)))
    return Value(F.unix_millis(t), _LONG)


def error(c, at, message=None):
    return missing()


BUILTINS = {
    "string": string, "length": length, "substring": substring, "substringBefore": substring_before, "substringAfter": substring_after,
    "uppercase": uppercase, "lowercase": lowercase, "trim": trim, "pad": pad, "contains": contains, "split": split, "join": join,
    "match": match, "replace": replace, "base64encode": base64encode, "base64decode": base64decode, "encodeUrl": encode_url,
    "encodeUrlComponent": encode_url, "decodeUrl": decode_url, "decodeUrlComponent": decode_url, "formatNumber": format_number,
    "formatBase": format_base, "number": number, "abs": _numeric(F.abs), "floor": _numeric(lambda x: F.floor(x).cast("double")),
    "ceil": _numeric(lambda x: F.ceil(x).cast("double")), "sqrt": _numeric(lambda x: F.when(x >= 0, F.sqrt(x))), "round": round_, "power": power,
    "random": random, "sum": sum_, "max": max_, "min": min_, "average": average, "boolean": boolean, "not": not_, "exists": exists,
    "type": type_, "count": count, "append": append, "sort": sort, "reverse": reverse, "shuffle": shuffle, "distinct": distinct,
    "zip": zip_, "keys": keys, "lookup": lookup, "spread": spread, "merge": merge, "sift": sift, "each": each, "map": map_,
    "filter": filter_, "reduce": reduce_, "single": single, "now": now, "millis": millis, "fromMillis": from_millis,
    "toMillis": to_millis, "error": error,
}
assert all(len(inspect.signature(f).parameters) >= 2 for f in BUILTINS.values())
