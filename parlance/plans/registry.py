"""Registry of named queries (the driver contract) and their SQL twins."""

from __future__ import annotations

import sys
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, sql: Callable[[], str] | str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional SQL twin."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if callable(sql) else (lambda s=sql: s)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that they register themselves."""
    from . import q_corpus, q_text, q_entities, q_reports, q_vectors, q_clusters, q_features, q_streams, q_more  # noqa: F401


# Summation order differs between engines, so DOUBLE columns are compared at 9 significant digits.
# Only the registered queries do this; the operators return unrounded values.
DIGITS_FORMAT = "%.8e"
ZERO_BELOW = 1e-12   # residue of a sum that is exactly zero


def _comparable(fn: QueryFn) -> QueryFn:
    """Cut DOUBLE/FLOAT output columns to 9 significant digits, as the SQL twin does."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def cut(c):
        x = c.cast("double")
        return F.when(F.abs(x) < ZERO_BELOW, F.lit(0.0)).when(
            x.isNotNull(), F.format_string(DIGITS_FORMAT, x).cast("double"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the model's timestamps are naive UTC (as in the stored data): pin the session time zone
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = fn(spark, sf_dir)
        cols = [cut(F.col(f"`{f.name}`")).alias(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                for f in df.schema.fields]
        return df.select(*cols)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    load_all()
    return {k: _comparable(v) for k, v in QUERIES.items()}


def _describe_connection(sf_dir: str):
    import os

    import duckdb
    from ..sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _comparable_sql(con, sql: str) -> str:
    """Wrap a SQL twin so that its DOUBLE/FLOAT columns are cut to 9 significant digits (binding only)."""
    try:
        desc = con.execute(f"DESCRIBE ({sql})").fetchall()
    except Exception:  # noqa: BLE001 — keep the plain statement if it cannot be bound here
        return sql
    cols = []
    for name, typ, *_ in desc:
        q = '"' + name.replace('"', '""') + '"'
        cols.append(f"CASE WHEN abs({q}) < {ZERO_BELOW} THEN 0.0::DOUBLE ELSE "
                    f"CAST(printf('{DIGITS_FORMAT}', CAST({q} AS DOUBLE)) AS DOUBLE) END AS {q}"
                    if typ in ("DOUBLE", "FLOAT") else q)
    return f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS q"


def oracle_sql(sf_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    """The SQL twins; one that cannot be built is reported on stderr and left out, the others stand."""
    load_all()
    try:
        con = _describe_connection(sf_dir)
    except Exception:  # noqa: BLE001
        con = None
    out = {}
    for k, v in ORACLES.items():
        try:
            sql = v()
        except Exception as e:  # noqa: BLE001
            print(f"oracle_sql: {k}: {e!r}", file=sys.stderr)
            continue
        out[k] = _comparable_sql(con, sql) if con is not None else sql
    return out
