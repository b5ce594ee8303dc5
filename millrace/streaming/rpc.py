"""Requests as JSON lines answered batch by batch: runs are recorded, summaries answer from all that were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar as sc
from millrace.functions import text as tx
from millrace.operators import analytics as an

REQUEST = (
    "id STRING, method STRING, params STRUCT<run_id: STRING, total_duration_ms: BIGINT, tasks_count: BIGINT, cache_hits: BIGINT, cache_misses: BIGINT, failed_count: BIGINT, bottlenecks: ARRAY<STRING>, "
    "toolchain: STRING, stderr: STRING, stdout: STRING, missing_toolchains: ARRAY<STRING>, installed_count: BIGINT, total_count: BIGINT, files: ARRAY<STRING>, lines_added: BIGINT, lines_deleted: BIGINT, file_content: STRING, error_message: STRING>"
)
#: The codes of the protocol for text that is no JSON and for unknown methods.
PARSE_ERROR, NO_METHOD = -32700, -32601


def requests(lines: DataFrame) -> DataFrame:
    """lines(value): (value, id, method, params); a line that is no JSON object has no method, blank lines are left out."""
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", f"{REQUEST}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.select("value", "r.id", F.when(F.col("r._broken").isNull(), F.coalesce("r.method", F.lit(""))).alias("method"), "r.params")


def recorded_runs(asked: DataFrame) -> DataFrame:
    """The runs that requests record, absent numbers as 0."""
    p = lambda name: F.coalesce(F.col(f"params.{name}"), F.lit(0)).alias(name)
    return asked.where("method = 'record_run'").select(
        F.coalesce("params.run_id", F.lit("run-0")).alias("run_id"), *[p(c) for c in ("total_duration_ms", "tasks_count", "cache_hits", "cache_misses", "failed_count")],
        F.coalesce("params.bottlenecks", F.array().cast("array<string>")).alias("bottleneck_tasks"),
    )


def _result(value: Column) -> Column:
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("id"), value.alias("result")))


def _error(code: int, message: Column) -> Column:
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("id"), F.struct(F.lit(code).alias("code"), message.alias("message")).alias("error")))


def responses(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, response) of every request; summaries are over runs(seq, ...), one broadcast row."""
    p, none, text = (lambda name: F.col(f"params.{name}")), F.array().cast("array<string>"), lambda name: F.coalesce(F.col(f"params.{name}"), F.lit(""))
    log = F.concat_ws("\n", text("stderr"), text("stdout"))
    risk = tx.pr_risk(F.coalesce(p("files"), none), F.coalesce(p("lines_added"), F.lit(0)), F.coalesce(p("lines_deleted"), F.lit(0)))
    answers = {
        "ping": F.struct(F.lit("pong").alias("status")),
        "record_run": F.struct(F.lit("recorded").alias("status")),
        "analytics_summary": F.col("_summary"),
        "analyze_failure": F.struct(tx.error_category(log).alias("category")),
        "analyze_error": F.struct(tx.error_category(log).alias("category")),
        "autofix": F.struct(tx.missing_import_fix(text("file_content"), text("error_message")).alias("content")),
        "predict_pr_risk": F.struct(risk.alias("risk"), tx.risk_severity(risk).alias("severity")),
        "doctor_advice": F.struct(sc.doctor_advice(F.coalesce(p("missing_toolchains"), none), F.coalesce(p("installed_count"), F.lit(0)), F.coalesce(p("total_count"), F.lit(0))).alias("tips")),
    }
    chain = F.when(F.col("method").isNull(), _error(PARSE_ERROR, F.lit("not a JSON request")))
    for name, value in answers.items():
        chain = chain.when(F.col("method") == name, _result(value))
    summary = an.run_summary(runs).select(F.struct("*").alias("_summary"))
    return asked.crossJoin(F.broadcast(summary)).select("id", chain.otherwise(_error(NO_METHOD, F.concat(F.lit("Method "), "method", F.lit(" not found")))).alias("response"))


def rpc_step(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step over lines(value): runs go below path/runs, answers below path/responses, both by epoch, so a repeated epoch replaces itself.

    A summary sees the runs of its own batch and of all before.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        asked = requests(batch).persist()
        try:
            recorded_runs(asked).withColumn("seq", F.lit(epoch) * (1 << 40) + F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/runs/epoch={epoch}")
            responses(asked, spark.read.parquet(f"{path}/runs")).write.mode("overwrite").json(f"{path}/responses/epoch={epoch}")
        finally:
            asked.unpersist()

    return step
