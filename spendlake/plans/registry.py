"""Registered queries: a Spark plan, its output columns and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.plans import fixtures

DUCK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


class Inputs:
    """The driver's tables and the views derived from them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = fixtures.VIEWS[name]
        needed = set(re.findall(r"\{(\w+)\}", text))
        frames = {n: self.view(n) if n in fixtures.VIEWS else self.table(n) for n in needed}
        return self.spark.sql(text, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.VIEWS:
            return self.view(name)
        raise AttributeError(name)


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Inputs], DataFrame]
    columns: str
    sql: str | None

    @cached_property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(part.split()) for part in self.columns.split(",")]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(Inputs(spark, sf_dir))
        return df.select(*[F.col(name).cast(dtype).alias(name) for name, dtype in self.fields])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(f'CAST("{n}" AS {DUCK_TYPES[t]}) AS "{n}"' for n, t in self.fields)
        return f"{fixtures.with_clause(self.sql)}SELECT {picked} FROM (\n{self.sql.strip()}\n) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register the decorated plan under ``name``. Columns: 'a bigint, b string'."""

    def add(plan: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Query(name, plan, " ".join(columns.split()), sql)
        return plan

    return add
