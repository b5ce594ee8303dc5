"""Row keys for tables whose ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows (doc long, text) with unique doc in the order of ids, table (doc, id) if doc is not the id itself).

    Ids that are unique and not null are used as they are. Otherwise rows that repeat id and text become one,
    and the distinct (id, hash of text) are sorted and numbered in a written table; null ids come first.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows, ids = given.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if rows == ids:
        return given.withColumnRenamed("id", "doc"), None
    marked = given.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["id", "th"])
    key = durable(marked.select("id", "th").orderBy("id", "th").withColumn("doc", F.monotonically_increasing_id()))
    joined = marked.alias("m").join(key.alias("k"), F.col("m.id").eqNullSafe(F.col("k.id")) & (F.col("m.th") == F.col("k.th")))
    return joined.select("doc", "text"), key.select("doc", "id")
