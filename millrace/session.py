"""Session settings that results do not depend on, but plans do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session in UTC with AQE; partition counts are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
