"""Exact duplicates by deterministic block naming (native)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable

#: Bytes of a block that gets a name, and of the head that settles most texts.
BLOCK_BYTES, HEAD_BYTES = 1024, 256


def _named(values: DataFrame) -> DataFrame:
    """The distinct rows of values, sorted, each with an integer of its own as its name."""
    return durable(values.distinct().orderBy(*values.columns).withColumn("name", F.monotonically_increasing_id()))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Rows (id, text_sha256, n_bytes, name) of the texts that may have an equal; equal (n_bytes, name) means equal text.

    A text whose length and first head_bytes occur once has its identity already and goes no further. The
    others are cut into blocks. Distinct blocks are sorted and numbered; then the names of adjacent blocks
    are paired, and distinct pairs sorted and numbered, until one name is left. Names come from comparing
    contents, not from hashes, so they cannot collide. Each round halves the rows and is written, so the number
    of rounds is the logarithm of the longest text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).select(
        "id", "t", F.octet_length("t").alias("n_bytes"), F.substring(F.col("t").cast("binary"), 1, head_bytes).alias("head")
    )
    heads = durable(base.groupBy("n_bytes", "head").count().where("count > 1").drop("count"))
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_bytes") / block_bytes).cast("int") - 1)),
        lambda i: F.expr("cast(t as binary)").substr(i * block_bytes + 1, F.lit(block_bytes)),
    )
    left = durable(
        base.join(heads.hint("merge"), ["n_bytes", "head"], "left_semi")
        .select(F.monotonically_increasing_id().alias("rid"), "id", F.sha2("t", 256).alias("text_sha256"), "n_bytes", cut.alias("blocks"))
    )
    blocks = left.select("rid", F.posexplode("blocks").alias("idx", "block"))
    names = _named(blocks.select("block"))
    level = durable(blocks.join(names.hint("merge"), "block").select("rid", "idx", "name"))
    longest = left.agg(F.max("n_bytes")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(1, -(-longest // block_bytes))))):
        half = F.floor(F.col("idx") / 2).cast("int")
        side = lambda k: F.coalesce(F.max(F.when(F.col("idx") % 2 == k, F.col("name"))), F.lit(-1))
        pairs = level.groupBy("rid", half.alias("idx")).agg(side(0).alias("left"), side(1).alias("right"))
        names = _named(pairs.select("left", "right"))
        level = durable(pairs.join(names.hint("merge"), ["left", "right"]).select("rid", "idx", "name"))
    return left.select("rid", "id", "text_sha256", "n_bytes").join(level.select("rid", "name").hint("merge"), "rid").drop("rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """For every row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null counts as an empty text, and all empty texts are
    equal. Rows that repeat an id with the same text are all marked kept if that id stays, and each counts in
    group_size; a null id stays only where the group has no other. Other columns are not read. An empty table
    gives no rows.

    Shuffles: the texts once, by length and head (only those with a repeated head pass); a hot head or a hot
    block is joined from written tables, where AQE splits it. Counts are pre-aggregated before each shuffle. Joins whose
    sides grow with the input merge sorted sides at every size.
    """
    found = durable(block_identities(docs, id_col, text_col, block_bytes, head_bytes))
    groups = durable(found.groupBy("n_bytes", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    settled = (
        found.join(groups.hint("merge"), ["n_bytes", "name"])
        .select("id", F.col("text_sha256").alias("sha"), "keep_id", "group_size")
        .dropDuplicates(["id", "sha"])
        .withColumnRenamed("id", "found_id")
    )
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("text_sha256"),
    )
    return (
        rows.join(settled, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_sha256") == F.col("sha")), "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("sha").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("sha").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns kept; of rows that repeat id and text one stays."""
    groups = exact_groups(docs, id_col, text_col)
    row, ident = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id")
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(f"`{id_col}`"))).first()
    if rows == ids:
        gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("gone_id"))
        return docs.select(row, ident).join(gone, F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
    stay = groups.where("kept").select(F.col(id_col).alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    marked = docs.select(row, ident, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("sha")).dropDuplicates(["id", "sha"])
    return marked.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
