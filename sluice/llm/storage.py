"""Shared storage of the cluster: intermediate tables and the binary files operators write.

Everything goes below ``spark.checkpoint.dir``, which driver and executors share. It has to be set on a cluster; only in
a local session, as in tests, a temporary folder of this machine stands in for it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to so many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 48 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as a URI or path."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends here, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``persist`` returned. What was read from them has to be written by then."""
    for t in tables:
        remove(t.sparkSession, t._written)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark clear the shuffle files of plans that are out of use: it does so when the driver collects its garbage,
    which may come late. A local session is left alone."""
    if spark.sparkContext.master.startswith("local["):
        return
    gc.collect()
    spark._jvm.System.gc()


def collect_garbage(spark: SparkSession) -> None:
    """Lets the executors collect their garbage: heap that an earlier stage needed goes back to the system, and direct buffers are
    only freed then. One task a core, so that each executor has some. A local session is left alone."""
    if spark.sparkContext.master.startswith("local["):
        return
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


#: What a batch of rows on its way to Python holds at most, within ``narrow_batches``, if a row doesn't hold more.
BATCH_BYTES = 4 << 20


@contextmanager
def narrow_batches(spark: SparkSession):
    """Within it, tables are written by way of small Arrow batches: the buffers of a batch of 10,000 texts, which double as they
    grow, lie outside the executor's heap and come on top of it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _width(col, kind: T.DataType):
    """Bytes that a value takes in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(F.coalesce(col, F.array().cast(kind)), F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType))
        return each + 24
    if isinstance(kind, T.StructType):
        return sum((_width(col.getField(f.name), f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a persisted table) with a broadcast hint if its rows stay under ``BROADCAST_BYTES`` in memory, by their
    measured sizes; otherwise as it is, and the join shuffles."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else df


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared storage."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data) -> None:
    """Writes under another name first, then renames: a reader never sees a part of a file."""
    at, path = filesystem(uri)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(part, compression=None) as out:
        for x in [data] if isinstance(data, (bytes, bytearray, memoryview)) else data:
            out.write(x)
    at.move(part, path)
