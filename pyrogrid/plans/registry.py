"""Catalogue of runnable queries, each with the SQL that must give the same rows.

An output is declared once, as ``name:kind`` items, and the declaration shapes both sides: whole
numbers become 64-bit, reals are rounded to 6 decimals, dates are written as text.  A whole number
that may be missing is declared a real, which both sides represent alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}

KEY = "patch_id reference_date:d"


def fields(names: Iterable[str], kind: str = "f") -> str:
    return " ".join(f"{n}:{kind}" for n in names)


def _parse(output: str) -> list[tuple[str, str]]:
    return [(n, k or "s") for n, _, k in (item.partition(":") for item in output.split())]


def rounded(value: Column) -> Column:
    """``round(value, 6)`` of a double, with 0.0 for -0.0, through decimals only where it matters.

    Away from the halfway points, and where the product is off by far less than the distance to them,
    the nearest whole number of millionths is the rounded one, and dividing it gives the nearest double.
    """
    millionths = value * 1e6
    clear = F.abs(F.abs(millionths - F.floor(millionths)) - 0.5) > 1e-4
    plain = F.when(F.abs(millionths) < 5e10, clear)
    return F.when(plain, F.rint(millionths) / 1e6).otherwise(F.round(value, 6)) + F.lit(0.0)


def shape(df: DataFrame, output: str) -> DataFrame:
    made = {
        "s": lambda c: c.cast("string"),
        "d": lambda c: c.cast("date").cast("string"),
        "i": lambda c: c.cast("bigint"),
        "f": lambda c: rounded(c.cast("double")),
    }
    return df.select(*[made[k](F.col(n)).alias(n) for n, k in _parse(output)])


def shape_sql(sql: str, output: str) -> str:
    made = {
        "s": "CAST({0} AS VARCHAR)",
        "d": "CAST(CAST({0} AS DATE) AS VARCHAR)",
        "i": "CAST({0} AS BIGINT)",
        "f": "round(CAST({0} AS DOUBLE), 6) + 0.0::DOUBLE",
    }
    columns = ", ".join(f"{made[k].format(n)} AS {n}" for n, k in _parse(output))
    return f"SELECT {columns} FROM ({sql})"


def query(name: str, output: str, sql: str | None = None):
    """Register a function as a query; ``output`` declares its columns."""

    def register(run: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")

        def shaped(spark: SparkSession, sf: str) -> DataFrame:
            return shape(run(spark, sf), output)

        REGISTRY[name] = Entry(shaped, None if sql is None else shape_sql(sql, output))
        return run

    return register
