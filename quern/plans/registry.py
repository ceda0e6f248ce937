"""The registry of queries, their oracles and the inline fixtures that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Fixture:
    """A few rows for Spark and for SQL, and those of a given table behind them.

    ``also``: the table and, for each column, an expression that both engines understand.
    """

    def __init__(self, name: str, schema: str, rows: list[tuple], also: tuple[str, ...] = ()):
        self.name, self.schema, self.rows, self.also = name, schema, rows, also
        self.columns = [c.split() for c in schema.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str = "") -> DataFrame:
        own = spark.createDataFrame(self.rows, self.schema)
        if not self.also:
            return own
        given = spark.read.parquet(f"{sf_dir}/{self.also[0]}.parquet")
        return own.union(given.selectExpr(*[f"CAST({x} AS {k}) AS {c}" for x, (c, k) in zip(self.also[1:], self.columns, strict=True)]))

    def sql(self) -> str:
        """A common table expression."""
        names = ", ".join(c for c, _ in self.columns)
        casts = ", ".join(f"CAST({c} AS {_KINDS[k]}) AS {c}" for c, k in self.columns)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        given = ", ".join(f"CAST({x} AS {_KINDS[k]})" for x, (_, k) in zip(self.also[1:], self.columns, strict=False))
        more = f" UNION ALL SELECT {given} FROM {self.also[0]}" if self.also else ""
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) AS v({names}){more})"
