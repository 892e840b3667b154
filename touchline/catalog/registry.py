"""Registry of runnable queries: name -> DataFrame builder, matching SQL, inventory rows covered."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, covers, sql)
        return fn
    return add


# SQL text helpers: the same fixed-point sums the library uses.
def fsum_sql(e: str) -> str:
    return f"(coalesce(sum(cast(floor(({e})*1e6 + 0.5) as bigint)), 0)::double / 1e6::double)"


def fmean_sql(e: str) -> str:
    return f"(sum(cast(floor(({e})*1e6 + 0.5) as bigint))::double / 1e6::double / nullif(count({e}), 0)::double)"


def ratio_sql(n: str, d: str, scale: float = 1.0) -> str:
    return f"(case when ({d}) = 0 then 0.0::double else ({n})::double * {float(scale)}::double / ({d})::double end)"


def pct_sql(n: str, d: str) -> str:
    return ratio_sql(n, d, 100.0)


def n_sql(cond: str) -> str:
    return f"count(*) filter (where {cond})"
