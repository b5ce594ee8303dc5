"""millrace: task-graph and telemetry analytics as plain functions over Spark DataFrames."""
