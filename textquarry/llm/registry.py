"""What __spark_entry__ adds when this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import oracles
from textquarry.llm import queries as q


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
    return own | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
