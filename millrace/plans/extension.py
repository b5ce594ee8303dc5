"""Extension points: middleware around an execution, scanners whose findings add up, scripts as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import settle

Step = Callable[[DataFrame], DataFrame]

#: Severities, the least first.
SEVERITIES = ("Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Middleware:
    """before changes the tasks, after changes their outcomes and sees the tasks too; both are plans, so nothing runs until the result does."""

    before: Step = lambda tasks: tasks
    after: Callable[[DataFrame, DataFrame], DataFrame] = lambda tasks, outcomes: outcomes


def with_middleware(execute: Step, chain: Iterable[Middleware]) -> Step:
    """execute with every before in order in front and every after in reverse order behind."""
    steps = list(chain)

    def run(tasks: DataFrame) -> DataFrame:
        for m in steps:
            tasks = m.before(tasks)
        outcomes = execute(tasks)
        for m in reversed(steps):
            outcomes = m.after(tasks, outcomes)
        return outcomes

    return run


def scan(packages: DataFrame, scanners: Iterable[Step], least: str = "Low", most: int | None = None) -> DataFrame:
    """Findings (package, id, severity) of all scanners from a severity on; a scanner that fails leaves only its own out.

    Each scanner's findings are written, as a plan shows an error only when it runs.
    """
    found = packages.sparkSession.createDataFrame([], "package string, id string, severity string")
    for scanner in scanners:
        try:
            found = found.unionByName(settle(scanner(packages).select(*[F.col(c).cast("string").alias(c) for c in found.columns])))
        except (PySparkException, ValueError, OSError):
            continue
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    kept = found.where(rank >= SEVERITIES.index(least) + 1)
    return kept if most is None else kept.orderBy(rank.desc(), "package", "id").limit(most)


def register_script(spark: SparkSession, name: str, script: Callable[[pd.Series], pd.Series], returns: str = "string") -> None:
    """A Python script as an SQL function over Arrow batches."""
    spark.udf.register(name, F.pandas_udf(script, returns))
