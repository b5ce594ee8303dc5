"""Domain tables derived from the star-schema Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.graph import number_rows

#: The same derivations for DuckDB, as common table expressions.
SQL_VIEWS = {
    "nodes": "SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS weight, ['Pending','Running','Succeeded','Failed','Cached','Cancelled','Skipped','Pending'][(p_partkey % 8)::INT + 1] AS state FROM part",
    "edges": "SELECT p_partkey // 2 AS dependency, p_partkey AS dependent FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2",
    "build_runs": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, o_orderdate AS created_at, o_orderkey AS seq, o_custkey AS project FROM orders",
    "task_metrics": "SELECT l_partkey AS task_id, l_orderkey AS run_id, p_type AS toolchain, l_returnflag = 'N' AS cached, l_returnflag = 'R' AS failed, CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS seq, l_suppkey AS worker, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey",
    "test_runs": "SELECT user_id AS test_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type <> 'error' AS passed, ts, CAST(floor(value) AS BIGINT) AS duration_ms FROM events",
    "touches": "SELECT event_id AS seq, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || '-' || CAST(event_id % 5 AS VARCHAR) END AS package FROM events",
    "duration_samples": "SELECT user_id AS task_name, event_id AS seq, value AS duration_sec, CAST(json_extract_string(props, '$.k') AS BIGINT) AS source_bytes FROM events",
    "telemetry": "SELECT user_id AS worker_id, ts, value AS cpu_pct, CAST(json_extract_string(props, '$.k') AS BIGINT) AS active_jobs, event_id FROM events",
    "artifacts": "SELECT sha256(text) AS digest, min(strlen(text)) AS size_bytes, count(*) AS hit_count FROM documents GROUP BY 1",
    "paths": "SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages",
    "workers": "SELECT s_suppkey AS id, s_suppkey % 7 AS active_jobs, s_nationkey AS zone, s_suppkey % 3 AS tool, s_suppkey % 10 AS age FROM supplier",
    "records": "SELECT l_orderkey * 8 + l_linenumber AS key, l_partkey % 997 AS artifact, CAST(floor(l_quantity) AS BIGINT) AS size, epoch(l_shipdate)::BIGINT AS stored_at, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid FROM lineitem",
    "logs": "SELECT event_id, user_id, ts, event_type, (event_id % 8)::INT AS kind FROM events",
}



def views(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Builders by name; nothing is read until one is called."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    states = F.array(*[F.lit(s) for s in ("Pending", "Running", "Succeeded", "Failed", "Cached", "Cancelled", "Skipped", "Pending")])

    def nodes() -> DataFrame:
        return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("weight"), F.get(states, (F.col("p_partkey") % 8).cast("int")).alias("state"))

    def edges() -> DataFrame:
        p = t("part").select("p_partkey")
        half = p.where("p_partkey > 0").selectExpr("p_partkey div 2 AS dependency", "p_partkey AS dependent")
        return half.unionByName(p.where("p_partkey > 2").selectExpr("p_partkey div 3 AS dependency", "p_partkey AS dependent"))

    def build_runs() -> DataFrame:
        return t("orders").selectExpr("cast(o_orderkey AS string) AS id", "o_orderstatus AS status", "cast(floor(o_totalprice) AS bigint) AS duration_ms", "o_orderdate AS created_at", "o_orderkey AS seq", "o_custkey AS project")

    def task_metrics() -> DataFrame:
        order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
        return t("lineitem").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_partkey").alias("task_id"), F.col("l_orderkey").alias("run_id"), F.col("p_type").alias("toolchain"), (F.col("l_returnflag") == "N").alias("cached"), (F.col("l_returnflag") == "R").alias("failed"),
            F.floor("l_extendedprice").cast("long").alias("duration_ms"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_suppkey").alias("worker"), F.col("l_linenumber").alias("line"),
        )

    def test_runs() -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return t("events").select(F.col("user_id").alias("test_id"), F.row_number().over(order).cast("long").alias("seq"), (F.col("event_type") != "error").alias("passed"), "ts", F.floor("value").cast("long").alias("duration_ms"))

    def touches() -> DataFrame:
        return t("events").selectExpr("event_id AS seq", "user_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(event_type, '-', cast(event_id % 5 AS string)) END AS package")

    def duration_samples() -> DataFrame:
        return t("events").selectExpr("user_id AS task_name", "event_id AS seq", "value AS duration_sec", "cast(get_json_object(props, '$.k') AS bigint) AS source_bytes")

    def telemetry() -> DataFrame:
        return t("events").selectExpr("user_id AS worker_id", "ts", "value AS cpu_pct", "cast(get_json_object(props, '$.k') AS bigint) AS active_jobs", "event_id")

    def artifacts() -> DataFrame:
        return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.octet_length("text")).cast("long").alias("size_bytes"), F.count(F.lit(1)).alias("hit_count"))

    def paths() -> DataFrame:
        return t("pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))

    def workers() -> DataFrame:
        return t("supplier").selectExpr("s_suppkey AS id", "s_suppkey % 7 AS active_jobs", "s_nationkey AS zone", "s_suppkey % 3 AS tool", "s_suppkey % 10 AS age")

    def records() -> DataFrame:
        order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return number_rows(t("lineitem").select(*order, "l_quantity"), *order).select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), (F.col("l_partkey") % 997).alias("artifact"), F.floor("l_quantity").cast("long").alias("size"),
            F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("stored_at"), (F.col("number") + 1).alias("rid"),
        )

    def logs() -> DataFrame:
        return t("events").selectExpr("event_id", "user_id", "ts", "event_type", "cast(event_id % 8 AS int) AS kind")

    found = locals()
    return {k: found[k] for k in SQL_VIEWS} | {"table": t}


def sql(body: str, *names: str) -> str:
    """A DuckDB query over the named views."""
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}" if head else body
    if body.startswith("WITH "):
        return f"WITH {head}, {body.removeprefix('WITH ')}" if head else body
    return f"WITH {head} {body}" if head else body
