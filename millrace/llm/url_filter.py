"""URL filters by a sort-merge range join on reversed-host keys (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .durable import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: verdict and rule (host, then path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rules as a table (verdict, rule)."""
    if not rules:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("verdict", "rule")]))
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: the key of a host is a prefix of those of its subdomains."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For each host that has rules: its key and the rules of itself and of all hosts around it, longest first."""
    parsed = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select(
        "rule",
        "verdict",
        F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("prefix"),
    ).where(F.col("host") != "").withColumn("key", host_key(F.col("host")))
    entry = F.struct(F.length("rule").alias("len"), F.length("host").alias("host_len"), "rule", "key", "prefix", "verdict")
    own = parsed.groupBy("key").agg(F.collect_set(entry).alias("own"))
    labels = F.split(F.col("key"), r"\.")
    around = own.select(
        "key",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("outer"),
    )
    return (
        around.join(own.withColumnRenamed("key", "outer"), "outer")
        .groupBy("key")
        .agg(F.sort_array(F.flatten(F.collect_list("own")), asc=False).alias("stack"))
    )


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls.

    Reversed-host keys make a host's subdomains one interval of keys, and these intervals nest. Each salt's
    rows are sorted by key together with the starts of all intervals; one sweep carries the stack of nested
    rules that the last start opened. A row keeps of that stack what still encloses its key and whose path
    begins its path; the longest rule stands first (then the longer host, then the greater text).

    Rows are dealt by a salt over all columns' url, never by host, so that a hot host spreads evenly; each salt
    sorts a copy of the rules (rules x salts rows, streamed, not held). No side is broadcast.
    Null urls and urls without :// have an empty host and path, no rule, and the default verdict. Null or
    host-less rules are ignored; repeated rules count once. Columns of urls that are named like a result
    column are replaced.
    """
    spark = urls.sparkSession
    n = salts or 4 * shuffle_partitions(spark)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    given = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{url_col}`").alias("u"))
    points = given.select(
        F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("salt"),
        host_key(host_of(F.col("u"))).alias("key"),
        F.lit(1).alias("kind"),
        "row",
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
    )
    starts = rule_stacks(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), "key", F.lit(0).alias("kind"), "stack"
    )
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(starts, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["prefix"]))
    return (
        swept.where("kind = 1")
        .withColumn("hit", F.get(fits, F.lit(0)))
        .select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), hit AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
"""
