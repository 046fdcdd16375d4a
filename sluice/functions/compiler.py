"""Compiles parsed expressions to Spark columns, typed by the input's schema.

Bodies with a schema (STRUCT) keep column pruning and pushdown: a path is a field access. Bodies without one (VARIANT)
are read with ``try_variant_get``. Functions that take functions become higher-order columns. Nothing runs in Python.

A missing value is NULL: comparisons with it are NULL (no match), object constructors keep the field as NULL, and
``x = null`` asks whether x is null. Unlike the language's interpreter, arrays of one element stay arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import values as V
from sluice.functions.parser import ExpressionError, parse
from sluice.functions.values import Value, common_type, constant, missing

_DOUBLE, _LONG, _STRING, _BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


class Lambda:
    def __init__(self, names, body, compiler, scope, context):
        self.names, self.body, self.compiler, self.scope, self.context = names, body, compiler, scope, context

    def __call__(self, *args: Value) -> Value:
        return self.compiler.of(self.body, self.context, {**self.scope, **dict(zip(self.names, args))})


def _element(v: Value) -> Value:
    """As an array."""
    if v.array:
        return v
    if v.variant:
        listed = F.try_variant_get(v.col, "$", "array<variant>")
        return Value(F.coalesce(listed, F.when(v.col.isNotNull(), F.array(v.col))), T.ArrayType(T.VariantType()))
    return Value(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))


class Compiler:
    """``root`` names the values an expression starts from, such as body, headers and metadata."""

    def __init__(self, root: dict[str, Value] | Value, functions=None):
        self.root = root
        self.functions = functions
        self.typed: dict[int, T.DataType] = {}

    def compile(self, text: str) -> Value:
        return self.of(parse(text), self.root, {})

    # -- access -----------------------------------------------------------------------------------------------------

    def field(self, v, name: str) -> Value:
        if isinstance(v, dict):
            return v.get(name) or missing()
        if v.struct:
            for f in v.type.fields:
                if f.name == name:
                    return Value(v.col.getField(name), f.dataType)
            return missing()
        if v.map:
            return Value(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
        if v.variant:
            path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
            direct = F.try_variant_get(v.col, path, "variant")
            each = F.filter(F.transform(F.try_variant_get(v.col, "$", "array<variant>"), lambda x: F.try_variant_get(x, path, "variant")), lambda x: x.isNotNull())
            return Value(F.coalesce(direct, F.to_variant_object(F.when(F.size(each) > 0, each))), T.VariantType())
        if v.array:
            return self.mapped(v, lambda x: self.field(x, name))
        return missing()

    def mapped(self, v: Value, f) -> Value:
        """f of each element; arrays it gives are flattened, missing values left out."""
        inner: list[Value] = []

        def g(x):
            r = f(Value(x, v.type.elementType))
            inner[:] = [r]
            return r.col

        col = F.transform(v.col, g)
        r = inner[0]
        if r.missing:
            return missing()
        if r.array:
            return Value(F.flatten(F.filter(col, lambda x: x.isNotNull())), r.type)
        return Value(F.filter(col, lambda x: x.isNotNull()), T.ArrayType(r.type))

    def fields(self, v) -> list[Value]:
        if isinstance(v, dict):
            return list(v.values())
        return [Value(v.col.getField(f.name), f.dataType) for f in v.type.fields] if v.struct else []

    def listed(self, items: list[Value]) -> Value:
        """An array of the items: of their common type, or of variants."""
        if not items:
            return Value(F.array().cast("array<string>"), T.ArrayType(_STRING))
        kind = common_type([i.type for i in items])
        if kind is None:
            kind = T.VariantType()
        if isinstance(kind, T.NullType):
            kind = _STRING
        return Value(F.array(*(V.to_type(i, kind) for i in items)), T.ArrayType(kind))

    # -- trees ------------------------------------------------------------------------------------------------------

    def of(self, tree, at, scope) -> Value:
        return getattr(self, "_" + tree[0])(tree, at, scope)

    def _num(self, t, at, scope):
        return constant(t[1])

    _str = _bool = _num

    def _null(self, t, at, scope):
        return Value(F.lit(None), T.NullType(), null=True)

    def _regex(self, t, at, scope):
        raise ExpressionError("a regular expression stands as an argument only")

    def _name(self, t, at, scope):
        return self.field(at, t[1])

    def _var(self, t, at, scope):
        if t[1] == "":
            return self.whole(at)
        if t[1] == "$":
            return self.whole(self.root)
        if t[1] in scope:
            return scope[t[1]]
        raise ExpressionError(f"${t[1]} is not bound")

    def whole(self, v) -> Value:
        if isinstance(v, dict):
            return Value(F.struct(*(x.col.alias(k) for k, x in v.items())), T.StructType([T.StructField(k, x.type) for k, x in v.items()]))
        return v

    def _wild(self, t, at, scope):
        if not isinstance(at, dict) and at.map:
            return Value(F.map_values(at.col), T.ArrayType(at.type.valueType))
        if not isinstance(at, dict) and at.array:
            return self.mapped(at, lambda x: self._wild(t, x, scope))
        out = self.listed(self.fields(at))
        return Value(F.flatten(out.col), out.type.elementType) if isinstance(out.type.elementType, T.ArrayType) else out

    def _deep(self, t, at, scope):
        found: list[Value] = []

        def walk(v):
            for f in self.fields(v):
                found.append(f)
                walk(f)

        walk(at)
        return self.listed(found)

    def _parent(self, t, at, scope):
        raise ExpressionError("the parent operator % is not supported")

    def _path(self, t, at, scope):
        left = self.of(t[1], at, scope)
        return self.step(left, t[2], scope)

    def step(self, left, tree, scope) -> Value:
        if tree[0] == "index":  # binds to the step
            if tree[1][0] == "wild" and not isinstance(left, dict) and left.array:
                return self.step(self.step(left, tree[1], scope), tree[2], scope)
            return self.picked(self.step(left, tree[1], scope), tree[2], scope)
        if not isinstance(left, dict) and left.variant and tree[0] != "name":
            listed = _element(left)
            return self.mapped(listed, lambda x: self.of(tree, x, scope))
        if not isinstance(left, dict) and left.array and tree[0] != "name":
            return self.mapped(left, lambda x: self.of(tree, x, scope))
        if not isinstance(left, dict) and left.missing:
            return missing()
        return self.of(tree, left, scope)

    def _keep(self, t, at, scope):
        return _element(self.of(t[1], at, scope))

    def _index(self, t, at, scope):
        return self.picked(self.of(t[1], at, scope), t[2], scope)

    def picked(self, v: Value, tree, scope) -> Value:
        if tree[0] == "wild":
            return _element(v)
        if v.missing:
            return v
        n = tree[1] if tree[0] == "num" else -tree[1][1] if tree[0] == "neg" and tree[1][0] == "num" else None
        if n is not None:
            n = int(n // 1)
            v = _element(v)
            at = F.lit(n) if n >= 0 else F.size(v.col) + n
            return Value(F.get(v.col, at), v.type.elementType)
        if not (v.array or v.variant):
            keep = V.boolean(self.of(tree, v, scope))
            return Value(F.when(keep, v.col), v.type)
        v = _element(v)
        kinds = []

        def keep_(x, i=None):
            r = self.of(tree, Value(x, v.type.elementType), scope)
            kinds[:] = [r]
            return F.coalesce(V.boolean(r), F.lit(False)) if not r.number else r.col

        kept = F.filter(v.col, keep_)
        if kinds[0].number:  # a position that is computed
            r = self.of(tree, v, scope)
            i = F.floor(V.number(r)).cast("int")
            return Value(F.get(v.col, F.when(i < 0, F.size(v.col) + i).otherwise(i)), v.type.elementType)
        return Value(kept, v.type)

    def _sort(self, t, at, scope):
        v = _element(self.of(t[1], at, scope))
        keys = [(k, down) for k, down in t[2]]

        def compare(a, b):
            out = F.lit(0)
            for k, down in reversed(keys):
                x, y = (self.of(k, Value(z, v.type.elementType), scope) for z in (a, b))
                x, y = (V.number(z) if z.variant else z.col for z in (x, y))
                first, second = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
                out = F.when(x.isNull() & y.isNotNull(), 1).when(x.isNotNull() & y.isNull(), -1).when(x < y, first).when(x > y, second).otherwise(out)
            return out

        return Value(F.array_sort(v.col, compare), v.type)

    def _group(self, t, at, scope):
        v = self.of(t[1], at, scope)
        if not (v.array or v.variant):
            return self.of(("object", t[2]), v, scope)
        v = _element(v)
        def pairs(key, value):
            key_of = lambda x: V.text(self.of(key, Value(x, v.type.elementType), scope))
            names = F.array_distinct(F.filter(F.transform(v.col, lambda x: key_of(x)), lambda k: k.isNotNull()))
            got = []

            def entry(k):
                own = F.filter(v.col, lambda x: key_of(x) == k)
                r = self.of(value, Value(own, v.type), scope)
                got[:] = [r.type]
                return F.struct(k.alias("key"), r.col.alias("value"))

            return F.transform(names, entry), got[0]

        maps, kinds = zip(*(pairs(k, x) for k, x in t[2]))
        kind = common_type(list(kinds))
        if len(maps) > 1 and kind is None:
            raise ExpressionError("the values of a grouping have several types")
        return Value(F.map_from_entries(reduce(lambda a, b: F.concat(a, b), maps)), T.MapType(_STRING, kind))

    def _object(self, t, at, scope):
        named = all(k[0] == "str" for k, _ in t[1])
        vals = [self.of(v, at, scope) for _, v in t[1]]
        if named:
            names = [k[1] for k, _ in t[1]]
            if len(set(names)) < len(names):
                raise ExpressionError("an object names a field twice")
            if not names:
                return Value(F.create_map().cast("map<string,string>"), T.MapType(_STRING, _STRING))
            cols = [x.col.cast("string") if x.missing else x.col for x in vals]
            kinds = [_STRING if x.missing else x.type for x in vals]
            return Value(F.struct(*(c.alias(n) for c, n in zip(cols, names))), T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
        keys = [V.text(self.of(k, at, scope)) for k, _ in t[1]]
        kind = common_type([v.type for v in vals])
        kind = T.VariantType() if kind is None else _STRING if isinstance(kind, T.NullType) else kind
        entries = F.array(*(F.struct(k.alias("key"), V.to_type(v, kind).alias("value")) for k, v in zip(keys, vals)))
        return Value(F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull())), T.MapType(_STRING, kind))

    def _array(self, t, at, scope):
        if len(t[1]) == 1 and t[1][0][0] == "range":
            return self._range(t[1][0], at, scope)
        items = [self.of(i, at, scope) for i in t[1]]
        if any(i[0] == "range" for i in t[1]) or any(v.array for v in items) and not all(v.array for v in items):
            parts = [v if v.array and tree[0] != "array" else self.listed([v]) for v, tree in zip(items, t[1])]
            kind = common_type([p.type for p in parts])
            if kind is not None:
                return Value(F.concat(*(V.to_type(p, kind) for p in parts)), kind)
        if items and all(v.array for v in items) and not all(tree[0] == "array" for tree in t[1]):
            kind = common_type([v.type for v in items])
            if kind is not None:
                return Value(F.concat(*(V.to_type(v, kind) for v in items)), kind)
        return self.listed([v for v in items if not v.missing or v.null])

    def _range(self, t, at, scope):
        a, b = (F.floor(V.number(self.of(x, at, scope))).cast("bigint") for x in t[1:])
        return Value(F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(_LONG))

    def _neg(self, t, at, scope):
        v = self.of(t[1], at, scope)
        if v.const is not None and not isinstance(v.const, (str, bool)):
            return constant(-v.const)
        return Value(-V.number(v), _DOUBLE)

    def _bin(self, t, at, scope):
        op, a, b = t[1], self.of(t[2], at, scope), self.of(t[3], at, scope)
        if op in ("and", "or"):
            x, y = (F.coalesce(V.boolean(v), F.lit(False)) for v in (a, b))
            p, q = (V.predicate(v) if v.boolean or v.number or v.string else F.coalesce(V.boolean(v), F.lit(False)) for v in (a, b))
            return Value(*((x & y, _BOOL) if op == "and" else (x | y, _BOOL)), pred=p & q if op == "and" else p | q)
        if op == "&":
            x, y = (F.coalesce(V.text(v), F.lit("")) if not v.null else F.lit("null") for v in (a, b))
            return Value(F.concat(x, y), _STRING)
        if op in "+-*/%":
            x, y = V.number(a), V.number(b)
            out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else F.try_divide(x, y) if op == "/" else F.try_mod(x, y)
            return Value(out, _DOUBLE)
        if op == "in":
            b = _element(b)
            return Value(F.coalesce(F.exists(b.col, lambda e: F.coalesce(self.equal(a, Value(e, b.type.elementType)), F.lit(False))), F.lit(False)), _BOOL)
        if op in ("=", "!="):
            same = self.equal(a, b)
            return Value(same if op == "=" else ~same, _BOOL)
        x, y = self.ordered(a, b)
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], _BOOL)

    def equal(self, a: Value, b: Value) -> Column:
        for x, y in ((a, b), (b, a)):
            if x.null:
                if y.missing:
                    return F.lit(True)
                return (y.col.isNull() | F.coalesce(F.is_variant_null(y.col), F.lit(False))) if y.variant else y.col.isNull()
        if a.missing or b.missing:
            return F.lit(None).cast("boolean")
        if a.number and b.number:
            return a.col == b.col
        if a.string and b.string or a.boolean and b.boolean:
            return a.col == b.col
        for x, y in ((a, b), (b, a)):
            if x.variant and not y.variant:
                kind = F.schema_of_variant(x.col)
                if y.number:
                    return F.when(x.col.isNotNull(), kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)") & F.coalesce(V.number(x) == y.col.cast("double"), F.lit(False)))
                if y.string:
                    return F.when(x.col.isNotNull(), (kind == "STRING") & F.coalesce(F.try_variant_get(x.col, "$", "string") == y.col, F.lit(False)))
                if y.boolean:
                    return F.when(x.col.isNotNull(), (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(x.col, "$", "boolean") == y.col, F.lit(False)))
        if a.variant or b.variant or a.struct or b.struct or a.map or b.map:
            return V.json(a) == V.json(b)
        if a.array and b.array:
            return F.to_json(a.col) == F.to_json(b.col)
        if type(a.type) is type(b.type):
            return a.col == b.col
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))

    def ordered(self, a: Value, b: Value) -> tuple[Column, Column]:
        """Both as numbers or both as strings; else NULL."""
        if a.string and b.string:
            return a.col, b.col
        if a.string or b.string:
            v, s = (a, b) if b.string else (b, a)
            if v.variant:
                x = F.when(F.schema_of_variant(v.col) == "STRING", F.try_variant_get(v.col, "$", "string"))
                return (x, s.col) if v is a else (s.col, x)
            null = F.lit(None).cast("string")
            return null, null
        if a.number and b.number:
            return a.col, b.col
        if a.variant and b.variant:
            strings = (F.schema_of_variant(a.col) == "STRING") & (F.schema_of_variant(b.col) == "STRING")
            pair = [F.struct(F.when(~strings, V.number(v)), F.when(strings, V.text(v))) for v in (a, b)]
            ok = strings | (V.number(a).isNotNull() & V.number(b).isNotNull())
            return F.when(ok, pair[0]), F.when(ok, pair[1])
        kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
        if isinstance(a.type, kinds) and isinstance(b.type, kinds):
            return a.col, b.col
        return V.number(a), V.number(b)

    def _cond(self, t, at, scope):
        test = F.coalesce(V.boolean(self.of(t[1], at, scope)), F.lit(False))
        yes = self.of(t[2], at, scope)
        no = self.of(t[3], at, scope) if t[3] else missing()
        kind = common_type([yes.type, no.type])
        if kind is None:
            kind = T.VariantType()
        if isinstance(kind, T.NullType):
            return missing()
        return Value(F.when(test, V.to_type(yes, kind)).otherwise(V.to_type(no, kind)), kind)

    def _block(self, t, at, scope):
        scope, out = dict(scope), missing()
        for e in t[1]:
            if e[0] == "bind":
                scope[e[1]] = out = self.bound(e[2], at, scope)
            else:
                out = self.of(e, at, scope)
        return out

    def bound(self, tree, at, scope):
        return Lambda(tree[1], tree[2], self, scope, at) if tree[0] == "lambda" else self.of(tree, at, scope)

    def _bind(self, t, at, scope):
        return self.bound(t[2], at, scope)

    def _lambda(self, t, at, scope):
        raise ExpressionError("a function is no value of a column; call it or pass it on")

    def _partial(self, t, at, scope):
        raise ExpressionError("partial application is not supported here")

    def _chain(self, t, at, scope):
        if t[2][0] == "call":
            return self.of(("call", t[2][1], [("given", self.of(t[1], at, scope)), *t[2][2]]), at, scope)
        return self.of(("call", t[2], [("given", self.of(t[1], at, scope))]), at, scope)

    def _given(self, t, at, scope):
        return t[1]

    def _call(self, t, at, scope):
        from sluice.functions.builtins import BUILTINS

        f = t[1]
        if f[0] == "lambda":
            return Lambda(f[1], f[2], self, scope, at)(*(self.bound(a, at, scope) for a in t[2]))
        if f[0] != "var":
            raise ExpressionError("only functions can be called")
        if isinstance(scope.get(f[1]), Lambda):
            return scope[f[1]](*(self.bound(a, at, scope) for a in t[2]))
        if self.functions is not None and (own := self.functions.lookup(f[1])):
            return own.column(*(self.of(a, at, scope) for a in t[2]))
        if f[1] not in BUILTINS:
            raise ExpressionError(f"unknown function ${f[1]}")
        args = []
        for a in t[2]:
            if a[0] == "regex":
                args.append(a)
            elif a[0] == "lambda":
                args.append(Lambda(a[1], a[2], self, scope, at))
            elif a[0] == "var" and a[1] not in scope and a[1] in BUILTINS:
                args.append(lambda *x, n=a[1]: BUILTINS[n](self, at, *x))
            else:
                args.append(self.of(a, at, scope))
        try:
            return BUILTINS[f[1]](self, at, *args)
        except TypeError as e:
            raise ExpressionError(f"${f[1]} doesn't take these arguments: {e}") from e
