"""Explicit schemas of the domain tables; nothing is inferred."""

from __future__ import annotations

SCHEMAS = {
    "nodes": "id BIGINT, name STRING, state STRING, weight BIGINT",
    "edges": "dependency BIGINT, dependent BIGINT",
    "build_runs": "id STRING, status STRING, duration_ms BIGINT, created_at TIMESTAMP_NTZ",
    "task_metrics": "task_id STRING, run_id STRING, toolchain STRING, cached INT, duration_ms BIGINT",
    "cas_artifacts": "digest STRING, size_bytes BIGINT, compressed_bytes BIGINT, hit_count BIGINT",
    "worker_telemetry": "worker_id STRING, timestamp TIMESTAMP_NTZ, cpu_pct DOUBLE, memory_bytes BIGINT, active_jobs INT",
    "run_metrics": "run_id STRING, total_duration_ms BIGINT, tasks_count BIGINT, cache_hits BIGINT, cache_misses BIGINT, failed_count BIGINT, bottleneck_tasks ARRAY<STRING>, task_durations_ms MAP<STRING,BIGINT>, memory_peak_mb BIGINT",
    "test_runs": "test_id STRING, seq BIGINT, passed BOOLEAN, ts TIMESTAMP_NTZ, duration_ms BIGINT",
    "test_meta": "name STRING, recent_failure_count INT, avg_duration_ms BIGINT, complexity_score DOUBLE",
    "touches": "seq BIGINT, path STRING, package STRING",
    "duration_samples": "task_name STRING, seq BIGINT, duration_sec DOUBLE, source_bytes BIGINT",
    "build_profiles": "target STRING, seq BIGINT, flags ARRAY<STRING>, duration_sec DOUBLE, binary_size_bytes BIGINT",
    "failure_logs": "task_id STRING, toolchain STRING, command STRING, stderr STRING, stdout STRING, exit_code INT",
    "pull_requests": "pr_id STRING, changed_files ARRAY<STRING>, lines_added BIGINT, lines_deleted BIGINT",
    "build_tasks": "id STRING, package_name STRING, toolchain STRING, command STRING, args ARRAY<STRING>, inputs ARRAY<STRING>, outputs ARRAY<STRING>, dependencies ARRAY<STRING>, env MAP<STRING,STRING>, timeout_ms BIGINT",
    "task_results": "task_id STRING, exit_code INT, stdout STRING, stderr STRING, duration_ms BIGINT, cached BOOLEAN, fingerprint STRING, output_digests MAP<STRING,STRING>",
    "cache_records": "key STRING, fingerprint STRING, stored_at BIGINT, path STRING, size BIGINT, artifact_hash STRING",
    "artifacts": "hash STRING, size BIGINT, compressed_size BIGINT, compression STRING, timestamp BIGINT, last_accessed BIGINT, artifact_type STRING, source STRING, tags ARRAY<STRING>",
    "symbols": "file STRING, symbol_name STRING, kind STRING, content_hash STRING, byte_range STRUCT<lo:BIGINT,hi:BIGINT>",
    "vfs_entries": "path STRING, size BIGINT, mtime TIMESTAMP_NTZ, content_hash STRING, state STRING",
    "snapshots": "id STRING, timestamp BIGINT, project_name STRING, git_ref STRING, artifacts MAP<STRING,STRING>, total_artifacts BIGINT",
    "workers": "id STRING, address STRING, cpu_cores INT, memory_bytes BIGINT, supported_toolchains ARRAY<STRING>, tags MAP<STRING,STRING>, active_jobs INT, last_heartbeat TIMESTAMP_NTZ",
    "queued_tasks": "task_id STRING, toolchain STRING, priority INT, weight DOUBLE, retry_count INT, max_retries INT, deadline TIMESTAMP_NTZ",
    "spans": "trace_id STRING, span_id STRING, parent_id STRING, name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, tags MAP<STRING,STRING>",
    "diagnostic_logs": "ts TIMESTAMP_NTZ, level STRING, component STRING, message STRING, metadata MAP<STRING,STRING>",
    "advisories": "package STRING, fixed_version STRING, id STRING, severity STRING, description STRING",
    "rules": "name STRING, command STRING, args ARRAY<STRING>, inputs ARRAY<STRING>, outputs ARRAY<STRING>, depends_on ARRAY<STRING>",
    "compile_commands": "directory STRING, command STRING, arguments ARRAY<STRING>, file STRING, output STRING",
}

#: Task states and the predicates over them.
TERMINAL = ("Succeeded", "Failed", "Cached", "Skipped", "Cancelled")
SUCCESSFUL = ("Succeeded", "Cached", "Skipped")
UNSUCCESSFUL = ("Failed", "Cancelled")
