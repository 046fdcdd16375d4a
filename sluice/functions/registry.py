"""Functions of one's own: column functions and Arrow UDFs under a name that expressions can call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import values as V
from sluice.functions.values import Value


@dataclass(frozen=True)
class Function:
    """``implementation`` takes columns and gives one; arguments are cast to ``inputs``."""

    name: str
    inputs: tuple[str, ...]
    output: str
    implementation: Callable[..., Column]
    deterministic: bool = True

    def column(self, *args: Value) -> Value:
        if len(args) != len(self.inputs):
            raise ValueError(f"${self.name} takes {len(self.inputs)} arguments")
        kinds = [T.DataType.fromDDL(i) for i in self.inputs]
        cols = [V.number(a).cast(k) if isinstance(k, (T.DoubleType, T.LongType, T.IntegerType)) else V.text(a) if isinstance(k, T.StringType) else V.to_type(a, k) for a, k in zip(args, kinds)]
        return Value(self.implementation(*cols), T.DataType.fromDDL(self.output))


class Registry:
    """Names are unique; a definition needs a name and an implementation."""

    def __init__(self):
        self._all: dict[str, Function] = {}

    def register(self, f: Function) -> Function:
        if not f.name or f.implementation is None:
            raise ValueError("a function needs a name and an implementation")
        if f.name in self._all:
            raise ValueError(f"function {f.name!r} is registered already")
        self._all[f.name] = f
        return f

    def column(self, name: str, inputs: tuple[str, ...], output: str):
        """Registers a function of columns."""
        return lambda f: self.register(Function(name, inputs, output, f))

    def vectorized(self, name: str, inputs: tuple[str, ...], output: str):
        """Registers a function of pandas series: a plugin's native form."""

        def wrap(f):
            udf = F.pandas_udf(f, output)
            return self.register(Function(name, inputs, output, udf))

        return wrap

    def lookup(self, name: str) -> Function | None:
        return self._all.get(name)

    def all(self) -> dict[str, Function]:
        return dict(self._all)

    def __len__(self) -> int:
        return len(self._all)


def conformance(spark: SparkSession, f: Function, samples: list[tuple], expected: list | None = None) -> dict[str, bool]:
    """What a plugin has to hold: it takes its arguments, nulls, none and many rows, errs on a wrong number of
    arguments, and gives the same results twice."""
    schema = ", ".join(f"a{i} {t}" for i, t in enumerate(f.inputs)) or "a0 int"
    kinds = [T.DataType.fromDDL(t) for t in f.inputs]
    args = [Value(F.col(f"a{i}"), k) for i, k in enumerate(kinds)]

    def run(rows):
        return [r[0] for r in spark.createDataFrame(rows, schema).select(f.column(*args).col).collect()]

    first = run(samples)
    out = {"arguments": len(first) == len(samples), "no rows": run([]) == [], "many rows": len(run(samples * 50)) == 50 * len(samples), "deterministic": first == run(samples)}
    out["nulls"] = len(run([tuple(None for _ in f.inputs)])) == 1 if f.inputs else True
    try:
        f.column(*args, Value(F.lit(1), T.IntegerType()))
        out["wrong arguments"] = False
    except ValueError:
        out["wrong arguments"] = True
    if expected is not None:
        out["expected"] = first == expected
    return out
