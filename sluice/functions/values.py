"""Typed values: a Spark column with its type, and the conversions between them.

Nothing here throws at run time: casts are ``try_cast``, divisions ``try_divide``, accesses ``get``. A missing value is
NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    #: Of constants, the Python value.
    const: object = None
    #: A literal null, unlike a missing value.
    null: bool = False
    #: Of booleans, a predicate that is true where ``col`` is, but may be NULL where that is false: sources understand it.
    pred: Column | None = None

    @property
    def number(self) -> bool:
        return isinstance(self.type, _NUMBERS)

    @property
    def string(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def map(self) -> bool:
        return isinstance(self.type, T.MapType)

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def missing(self) -> bool:
        return isinstance(self.type, T.NullType)




def missing() -> Value:
    return Value(F.lit(None), T.NullType())


def constant(x) -> Value:
    kind = T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    return Value(F.lit(x).cast(kind), kind, const=x)


def number(v: Value) -> Column:
    """As a double; strings that hold numbers, and booleans, aren't numbers here, except in variants."""
    if v.number:
        return v.col.cast("double")
    if v.variant:
        return F.try_variant_get(v.col, "$", "double")
    return F.lit(None).cast("double")


def text(v: Value) -> Column:
    """As a string, the way JSON writes it; whole numbers without a fraction, null for a missing value."""
    if v.string:
        return v.col
    if isinstance(v.type, _WHOLE):
        return v.col.cast("string")
    if v.number:
        x = v.col.cast("double")
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(x.cast("string"), r"\.0(E|$)", "$1"))
    if v.boolean:
        return v.col.cast("string")
    if v.missing:
        return F.lit("null") if v.null else F.lit(None).cast("string")
    if v.variant:
        s = F.try_variant_get(v.col, "$", "string")
        return F.when(F.schema_of_variant(v.col).rlike("^(STRUCT|OBJECT|ARRAY)"), F.to_json(v.col)).when(F.schema_of_variant(v.col) == "DOUBLE", text(Value(F.try_variant_get(v.col, "$", "double"), T.DoubleType()))).otherwise(s)
    if v.array or v.struct or v.map:
        return F.to_json(v.col)
    return v.col.cast("string")


def json(v: Value) -> Column:
    """As JSON text."""
    if v.string:
        return F.regexp_extract(F.to_json(F.array(v.col)), r"(?s)^\[(.*)\]$", 1)
    if v.missing:
        return F.lit("null")
    if v.variant:
        return F.coalesce(F.to_json(v.col), F.lit("null"))
    return F.coalesce(text(v), F.lit("null"))


def truthy(v: Value) -> Column:
    """What a step takes for true: true, numbers but 0, non-empty strings, every array and object. Never NULL."""
    if v.boolean:
        out = v.col
    elif v.number:
        out = v.col != 0
    elif v.string:
        out = v.col != ""
    elif v.missing:
        return F.lit(False)
    elif v.variant:
        kind = F.schema_of_variant(v.col)
        out = (
            F.when(kind == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(v.col, "$", "string") != "")
            .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v.col, "$", "double") != 0)
            .when(kind == "VOID", F.lit(False))
            .otherwise(v.col.isNotNull())
        )
    else:
        out = v.col.isNotNull()
    return F.coalesce(out, F.lit(False))


def predicate(v: Value) -> Column:
    """What holds where the value is truthy, for a filter; a form that can be pushed down, if there is one."""
    if v.boolean:
        return v.col if v.pred is None else v.pred
    if v.number:
        return v.col != 0
    if v.string:
        return v.col != ""
    return truthy(v)


def boolean(v: Value) -> Column:
    """The language's own $boolean: like truthy, but empty arrays and objects are false. NULL if missing."""
    if v.array:
        return (F.size(v.col) > 0) & F.exists(v.col, lambda x: F.coalesce(boolean(Value(x, v.type.elementType)), F.lit(False)))
    if v.map:
        return F.size(v.col) > 0
    if v.struct:
        return F.lit(len(v.type.fields) > 0) & v.col.isNotNull()
    if v.boolean:
        return v.col
    if v.missing:
        return F.lit(None).cast("boolean")
    return F.when(v.col.isNull(), F.lit(None).cast("boolean")).otherwise(truthy(v))


def go_text(v: Value) -> Column:
    """A routing or grouping key as text: whole numbers as integers, other numbers with six decimals, true or false,
    'null' for null."""
    if v.number:
        x = v.col.cast("double")
        out = F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.format_string("%f", x))
    elif v.variant:
        x = F.try_variant_get(v.col, "$", "double")
        whole = F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.format_string("%f", x))
        out = F.when(F.schema_of_variant(v.col).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), whole).when(F.schema_of_variant(v.col) == "VOID", F.lit("null")).otherwise(text(v))
    elif v.missing:
        return F.lit("null")
    else:
        out = text(v)
    return F.coalesce(out, F.lit("null"))


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """One type for all, None if they have to become variants."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if not kinds:
        return T.NullType()
    if all(isinstance(t, _NUMBERS) for t in kinds):
        return kinds[0] if all(t == kinds[0] for t in kinds) else T.DoubleType()
    if all(isinstance(t, T.StringType) for t in kinds):
        return T.StringType()
    if all(t == kinds[0] for t in kinds):
        return kinds[0]
    if all(isinstance(t, T.ArrayType) for t in kinds) and (inner := common_type([t.elementType for t in kinds])) is not None:
        return T.ArrayType(inner)
    return None


def variant(v: Value) -> Column:
    if v.variant:
        return v.col
    if v.struct or v.array or v.map:
        return F.to_variant_object(v.col)
    if v.missing:
        return F.parse_json(F.lit("null")) if v.null else F.lit(None).cast("variant")
    return v.col.cast("variant")


def to_type(v: Value, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return variant(v)
    return v.col if v.type == kind else v.col.cast(kind)


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))
