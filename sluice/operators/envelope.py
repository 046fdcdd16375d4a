"""The envelope: headers, body, metadata and a sticky error.

Each row is a message. ``_error`` is set once; later steps skip such rows, and the end of a route splits them off as
dead letters. Errors are values: no step throws while a job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.compiler import Compiler
from sluice.functions.values import Value

PRINCIPAL = "struct<subject:string,roles:array<string>,claims:map<string,string>,token:string>"
METADATA = (
    f"struct<correlation_id:string,ingested_at:timestamp,route:string,route_version:string,contract_version:string,stage:string,principal:{PRINCIPAL},"
    "replay_count:int,replay_history:array<struct<timestamp:timestamp,attempt:int,initiator:string>>,error_type:string,"
    "aggregator_facet:struct<input_count:int,correlation_key:string,completion_strategy:string,completion_trigger:string>,"
    "splitter_facet:struct<split_expr:string,total_elements:int,element_index:int,split_trigger:string>,"
    "obligation_facet:struct<obligation_type:string,fields_redacted:array<string>,replacement:string,timestamp:string>,"
    "contract_violation:struct<contract_id:string,reason:string,severity:string>>"
)
ERROR = "struct<error:string,failed_step:int,failed_step_type:string,retry_attempt:int>"
HEADERS = "map<string,string>"
COLUMNS = ("headers", "body", "metadata", "_error")


def metadata(**given: Column) -> Column:
    """The metadata struct, with NULL where nothing is given."""
    kind = DataTypes.metadata()
    return F.struct(*((given[f.name].cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields))


class DataTypes:
    """Types of the envelope's columns, parsed when first asked for."""

    _cache: dict[str, T.DataType] = {}

    @classmethod
    def of(cls, ddl: str) -> T.DataType:
        if ddl not in cls._cache:
            cls._cache[ddl] = T.DataType.fromDDL(ddl)
        return cls._cache[ddl]

    @classmethod
    def metadata(cls) -> T.StructType:
        return cls.of(METADATA)


def envelope(df: DataFrame, body: Column | None = None, headers: Column | None = None, keep: tuple[str, ...] = (), **meta: Column) -> DataFrame:
    """Wraps rows as messages. ``body`` is a struct of all columns if not given; ``keep`` are columns to carry along for
    ordering. A missing correlation id is a hash of the body, so that equal inputs get equal ids on every run."""
    b = F.struct(*df.columns) if body is None else body
    out = df.select(*keep, (F.create_map().cast(HEADERS) if headers is None else headers.cast(HEADERS)).alias("headers"), b.alias("body"), metadata(**meta).alias("metadata"), F.lit(None).cast(ERROR).alias("_error"))
    return out


def json_body(text: Column) -> Column:
    """JSON text as a variant; NULL if it is no JSON."""
    return F.try_parse_json(text)


def root_of(df: DataFrame, principal: bool = False) -> dict[str, Value]:
    """What an expression sees: body, headers, metadata, and the principal where a step authorizes."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    root = {c: Value(F.col(c), kinds[c]) for c in ("body", "headers", "metadata")}
    if principal:
        kind = next(f.dataType for f in kinds["metadata"].fields if f.name == "principal")
        root["principal"] = Value(F.col("metadata.principal"), kind)
    return root


def compile_on(df: DataFrame, text: str, principal: bool = False, functions=None) -> Value:
    return Compiler(root_of(df, principal), functions).compile(text)


def ok() -> Column:
    return F.col("_error").isNull()


def fail(df: DataFrame, when: Column, message: Column | str, step: int, kind: str, attempt: int = 0) -> DataFrame:
    """Sets the error of rows without one for which ``when`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    e = F.struct(text.alias("error"), F.lit(step).alias("failed_step"), F.lit(kind).alias("failed_step_type"), F.lit(attempt).alias("retry_attempt")).cast(ERROR)
    return df.withColumn("_error", F.when(ok() & F.coalesce(when, F.lit(False)), e).otherwise(F.col("_error")))


def with_body(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("body", value)


def with_meta(df: DataFrame, when: Column | None = None, **fields: Column) -> DataFrame:
    """Sets fields of the metadata of rows without error."""
    m = F.col("metadata")
    kinds = {f.name: f.dataType for f in df.schema["metadata"].dataType.fields}
    cond = ok() if when is None else ok() & F.coalesce(when, F.lit(False))
    for name, value in fields.items():
        m = m.withField(name, F.when(cond, value.cast(kinds[name])).otherwise(F.col(f"metadata.{name}")))
    return df.withColumn("metadata", m)


def alive(df: DataFrame) -> DataFrame:
    return df.where(ok()).drop("_error")


def dead_letters(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Messages whose body is the dead-letter envelope and whose stage is error_path."""
    original = F.struct("headers", "body", "metadata")
    body = F.struct(
        F.to_json(original).alias("original_message"),
        F.col("_error.error").alias("error"),
        F.col("_error.failed_step").alias("failed_step"),
        F.col("_error.failed_step_type").alias("failed_step_type"),
        F.col("_error.retry_attempt").alias("retry_attempt"),
        (F.date_format(F.current_timestamp() if processed_at is None else processed_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("processed_at"),
    )
    return df.where(~ok()).select("headers", body.alias("body"), F.col("metadata").withField("stage", F.lit("error_path")).alias("metadata"))
