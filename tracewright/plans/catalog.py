"""How plans register queries and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that the order of additions does not show."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def outer(sql: str, columns: str, digits: int = 6) -> str:
    """SQL that rounds doubles as :func:`rounded` does; columns: names, doubles marked by ``~``, whole numbers by ``#``."""
    out = []
    for c in columns.split():
        name = c.strip("~#")
        out.append(f"round({name}::DOUBLE, {digits}) + 0.0 AS {name}" if c[0] == "~" else f"{name}::BIGINT AS {name}" if c[0] == "#" else name)
    return f"SELECT {', '.join(out)} FROM ({sql})"
