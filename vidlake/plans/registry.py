"""Registration of a query beside its SQL, with one column list that casts both sides alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_SPARK = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
_SQL = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def _column(name: str, kind: str):
    c = F.col(name).cast(_SPARK[kind])
    if kind == "d":
        c = F.round(c, 6) + F.lit(0.0)
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'CAST("{name}" AS {_SQL[kind]})'
    if kind == "d":
        c = f"CASE WHEN isfinite({c}) THEN round({c}, 6) + 0.0 ELSE {c} END"
    return f'{c} AS "{name}"'


def query(columns: str, sql: str | None = None, whole: bool = False) -> Callable:
    """Register the decorated (spark, sf_dir) -> DataFrame by its name.

    ``columns`` is "name:kind ..." with kinds i, d (rounded to 6 places), s, b.
    ``sql`` is the DuckDB form; None where SQL cannot express it. Where that form is
    bound to a subset of the rows, ``whole`` also registers name_whole, without SQL:
    the same function called with whole=True.
    """
    pairs = [c.split(":") for c in columns.split()]

    def registered(f: Callable, name: str, **kept: bool) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, **kept).select(*[_column(*p) for p in pairs])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        return run

    def add(f: Callable) -> Callable:
        run = registered(f, f.__name__)
        if whole:
            registered(f, f"{f.__name__}_whole", whole=True)
        if sql is not None:
            SQL[f.__name__] = f"SELECT {', '.join(_sql_column(*p) for p in pairs)} FROM ({sql.strip()}) AS result"
        return run

    return add
