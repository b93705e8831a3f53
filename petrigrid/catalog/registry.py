"""Query registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, oracle

REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = REGISTRY[name][0]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    call.__name__ = name
    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: run(n) for n in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {n: oracle(s) for n, (_, s) in REGISTRY.items() if s is not None}
