"""Registry of named queries and their SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle (when the operator
is expressible in SQL) is a DuckDB statement over the same parquet tables.
Outputs follow one convention on both sides so results compare exactly:
integral columns are BIGINT, fractional columns DOUBLE rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def finalize(df: DataFrame) -> DataFrame:
    """Integral -> bigint, fractional -> double rounded; other types kept."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), DIGITS))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# SQL side helpers -----------------------------------------------------------
def I(x: str) -> str:  # noqa: E743
    return f"CAST({x} AS BIGINT)"


def D(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), {DIGITS})"


def select_list(cols: dict[str, tuple[str, str]]) -> str:
    """{name: (expr, 'i'|'d'|'s')} -> 'expr AS name, ...' with casts."""
    out = []
    for n, (e, k) in cols.items():
        e = I(e) if k == "i" else D(e) if k == "d" else e
        out.append(f"{e} AS {n}")
    return ",\n  ".join(out)
