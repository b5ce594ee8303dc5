"""Run analytics: efficiency, failure rates, percentiles, bottlenecks, summaries, top-k lists.

Everything but the percentiles is one hash aggregation with partial sums, or a top-k that Spark runs as TakeOrderedAndProject.
Empty inputs give zeros in global results. Ratios are ratios of sums. Rounding is half-even.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.graph import sorted_ranges

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 x part / whole, rounded; 0 where whole is 0 or null."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def cache_efficiency(runs: DataFrame) -> DataFrame:
    return runs.agg(share(F.sum("cache_hits"), F.sum(F.col("cache_hits") + F.col("cache_misses"))).alias("cache_efficiency"))


def failure_rate(runs: DataFrame) -> DataFrame:
    return runs.agg(share(F.sum("failed_count"), F.sum("tasks_count")).alias("failure_rate"))


def time_saved(runs: DataFrame, cost_ms: int = 1500) -> DataFrame:
    return runs.agg((F.coalesce(F.sum("cache_hits"), F.lit(0)) * cost_ms).alias("time_saved_ms"))


def percentiles(df: DataFrame, value: str, *by: str, at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Nearest-rank percentiles with min, max and mean; groups without values have no row, a global call gives zeros.

    Equal values are counted first; the counts are sorted by range and summed per range, so a group of any size
    is spread over ranges, and a rank is looked for in each range behind the offset of those before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = sorted_ranges(counts, *by, "_v")
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    within = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    same = [F.col(b).eqNullSafe(F.col(f"_by{k}")) for k, b in enumerate(by)]
    ranks = ranged.withColumn("_within", within).join(offsets, reduce(Column.__and__, same, F.col("_part") == F.col("_at")))
    picks = [F.min(F.when(F.col("_before") + F.col("_within") >= F.col("_all") * p, F.col("_v"))).alias(f"p{round(p * 100)}") for p in at] + [F.min("_v").alias("min"), F.max("_v").alias("max")]
    names = [f"p{round(p * 100)}" for p in at] + ["min", "max"]
    found = ranks.groupBy(*by).agg(*picks, (F.sum(F.col("_v").cast("double") * F.col("_c")) / F.sum("_c")).alias("avg"))
    return found.select(*by, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], F.coalesce(F.bround("avg", 2), F.lit(0.0)).alias("avg"))


def bottlenecks(runs: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent bottleneck tasks; of equal counts the one seen first. runs(seq, bottleneck_tasks)."""
    seen = runs.select("seq", F.posexplode("bottleneck_tasks").alias("pos", "task"))
    return seen.groupBy("task").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("seq", "pos")).alias("first")).orderBy(F.desc("occurrences"), "first").limit(n).select("task", "occurrences")


def run_summary(runs: DataFrame, n: int = 3) -> DataFrame:
    """One record: run count, efficiency, failure rate, time saved and the top bottlenecks in order."""
    totals = runs.agg(
        F.count(F.lit(1)).alias("total_runs"), share(F.sum("cache_hits"), F.sum(F.col("cache_hits") + F.col("cache_misses"))).alias("cache_efficiency"),
        share(F.sum("failed_count"), F.sum("tasks_count")).alias("failure_rate"), (F.coalesce(F.sum("cache_hits"), F.lit(0)) * 1500).alias("time_saved_ms"),
    )
    top = bottlenecks(runs, n).agg(F.sort_array(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "task"))).alias("t"))
    return totals.crossJoin(F.broadcast(top)).select(*totals.columns, F.transform("t", lambda x: x["task"]).alias("bottlenecks"))


def state_summary(nodes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s.lower()) for s in ("Succeeded", "Cached", "Failed", "Cancelled")]
    return nodes.agg(F.count(F.lit(1)).alias("total"), *counts)


def profile(tasks: DataFrame) -> DataFrame:
    """tasks(duration_ms, cached): count, sum, integer mean, max, hit and miss rate."""
    n, hits = F.count(F.lit(1)), F.count_if("cached")
    return tasks.agg(
        n.alias("tasks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.floor(F.try_divide(F.sum("duration_ms"), n)), F.lit(0)).cast("long").alias("avg_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_ms"), ratio(hits, n).alias("hit_rate"), F.when(n > 0, 1 - ratio(hits, n)).otherwise(0.0).alias("miss_rate"),
    )


def operation_metrics(tasks: DataFrame, by: str) -> DataFrame:
    """Per operation: count, sum, min, max, successes, failures, mean, success rate."""
    n = F.count(F.lit(1))
    return tasks.groupBy(by).agg(
        n.alias("calls"), F.sum("duration_ms").alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("failures"), F.floor(F.sum("duration_ms") / n).cast("long").alias("avg_ms"), ratio(F.count_if(~F.col("failed")), n).alias("success_rate"),
    )


def health_report(logs: DataFrame, checks: DataFrame) -> DataFrame:
    """logs(level), checks(status): counts of levels, and the worst status; no checks is Unknown, only unknown ones is Healthy."""
    levels = logs.agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("Debug", "Info", "Warning", "Error", "Critical")])
    worst = checks.agg(
        F.when(F.count(F.lit(1)) == 0, "Unknown").when(F.bool_or(F.col("status") == "Unhealthy"), "Unhealthy").when(F.bool_or(F.col("status") == "Degraded"), "Degraded").otherwise("Healthy").alias("overall_health")
    )
    return levels.crossJoin(F.broadcast(worst))


def store_stats(records: DataFrame, objects: DataFrame) -> DataFrame:
    """records(size), objects(name, size): counts and bytes, temporary objects left out."""
    r = records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("record_bytes"))
    o = objects.where(~F.col("name").endswith(".tmp")).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("object_bytes"))
    return r.crossJoin(F.broadcast(o))


def reference_counts(records: DataFrame, artifact: str = "artifact_hash") -> DataFrame:
    return records.where(F.col(artifact).isNotNull()).groupBy(artifact).agg(F.count(F.lit(1)).alias("refs"))


def access_stats(entries: DataFrame) -> DataFrame:
    """entries(hits, misses): hit rate and mean accesses of an entry."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), ratio(F.sum("hits"), F.sum(F.col("hits") + F.col("misses"))).alias("hit_rate"), F.coalesce(F.avg(F.col("hits").cast("double")), F.lit(0.0)).alias("avg_accesses"))


def status_pivot(results: DataFrame, by: str, status: str, values: tuple[str, ...]) -> DataFrame:
    return results.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values], F.count(F.lit(1)).alias("total"))


def progress(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """tasks(id), updates(id, seq, state): share that is done; updates of unknown tasks are ignored."""
    last = updates.groupBy("id").agg(F.max_by("state", "seq").alias("state"))
    return tasks.select("id").join(last, "id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"),
        ratio(F.count_if(F.col("state").isin("completed", "failed")), F.count(F.lit(1))).alias("progress"),
    )


def suite_summary(results: DataFrame) -> DataFrame:
    """results(suite, passed): totals, success rate and number of suites."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), ratio(F.count_if("passed"), F.count(F.lit(1))).alias("success_rate"), F.count_distinct("suite").alias("suites"))


def duplicate_versions(uses: DataFrame) -> DataFrame:
    """uses(crate, version, features): united features, and the crates with more than one version."""
    return uses.groupBy("crate").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("features")))).alias("features")).where(F.size("versions") > 1)


def key_coverage(manifests: DataFrame, expected: list[str]) -> DataFrame:
    """manifests(id, text): share of expected keys that occur, and whether it reaches three quarters."""
    keys = F.array(*[F.lit(k) for k in expected])
    matched = F.filter(keys, lambda k: F.col("text").contains(k))
    return manifests.select("id", (F.size(matched) / F.lit(len(expected))).alias("accuracy"), (F.size(matched) / F.lit(len(expected)) >= 0.75).alias("passed"), F.array_except(keys, matched).alias("missing"))


def profile_score(duration: Column, size: Column) -> Column:
    return F.lit(1000.0) / (F.greatest(duration, F.lit(1e-6)) * F.greatest(F.lit(1.0), size / F.lit(1048576.0)))


def best_profiles(profiles: DataFrame) -> DataFrame:
    """profiles(target, seq, flags, duration_sec, binary_size_bytes): the best score of each target, of equal ones the first."""
    scored = profiles.withColumn("score", profile_score(F.col("duration_sec"), F.col("binary_size_bytes")))
    return scored.groupBy("target").agg(F.min_by(F.struct("flags", "score", "seq"), F.struct((-F.col("score")).alias("s"), "seq")).alias("b")).select("target", "b.flags", "b.score", "b.seq")


def flame_root(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.coalesce(F.sum(F.coalesce("duration_ms", F.lit(0))), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("children"))


def co_occurrence(files: DataFrame, group: str, item: str, weight: int = 2) -> DataFrame:
    """weight for each ordered pair of places in a group with different items at them (or equal items at different places).

    Counted per distinct item before pairing, so a group costs the square of its distinct items.
    """
    counts = files.groupBy(group, item).agg(F.count(F.lit(1)).alias("c"))
    a, b = counts.select(group, F.col(item).alias("a"), F.col("c").alias("ca")), counts.select(group, F.col(item).alias("b"), F.col("c").alias("cb"))
    pairs = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1)).otherwise(F.col("ca") * F.col("cb"))
    return a.join(b, group).groupBy("a", "b").agg((F.sum(pairs) * weight).alias("score")).where("score > 0")


def memory_peak(events: DataFrame, by: str) -> DataFrame:
    """events(by, seq, delta): peak of the running sum, 0 at least; a window per group."""
    run = F.sum("delta").over(Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("held", run).groupBy(by).agg(F.greatest(F.max("held"), F.lit(0)).alias("peak"))


def resource_usage(samples: DataFrame, by: str) -> DataFrame:
    """samples(by, seq, cpu, disk): the last cpu reading and the sum of disk traffic."""
    return samples.groupBy(by).agg(F.max_by("cpu", "seq").alias("cpu"), F.sum("disk").alias("disk"))


def benchmark_stats(rounds: DataFrame, by: str) -> DataFrame:
    """rounds(by, duration_ms): total, mean and operations a second, 0 where the total is 0."""
    n = F.count(F.lit(1))
    return rounds.groupBy(by).agg(n.alias("iterations"), F.sum("duration_ms").alias("total_ms"), (F.sum("duration_ms") / n).alias("avg_ms"), F.coalesce(F.try_divide(n * 1000.0, F.sum("duration_ms").cast("double")), F.lit(0.0)).alias("ops_per_sec"))


def until_first_failure(runs: DataFrame, by: str) -> DataFrame:
    """runs(by, seq, passed): how many are run when the first failure stops them, and whether all passed."""
    first = F.min(F.when(~F.col("passed"), F.col("seq")))
    return runs.groupBy(by).agg(F.coalesce(first, F.max("seq")).alias("executed"), first.isNull().alias("all_passed"))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def test_priority(tests: DataFrame, complexity: bool = False) -> DataFrame:
    """tests(name, recent_failure_count, avg_duration_ms, complexity_score) with score, failing and fast ones first."""
    score = F.col("recent_failure_count") * 100 + F.lit(1000.0) / F.greatest(F.lit(1), F.col("avg_duration_ms"))
    return tests.withColumn("score", score + F.col("complexity_score") * 10 if complexity else score)


def degree_chart(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with the most direct dependencies and the length of their bars."""
    top = edges.groupBy(F.col("dependent").alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)
    most = top.agg(F.max("degree").alias("most"))
    return top.crossJoin(F.broadcast(most)).select("id", "degree", F.greatest(F.floor(F.col("degree") / F.col("most") * 90 + 0.5) + 10, F.lit(15)).cast("long").alias("pct"))


def latest_versions(migrations: DataFrame) -> DataFrame:
    """migrations(version, seq, ...): the last added of each version, in order."""
    rest = [c for c in migrations.columns if c not in ("version", "seq")]
    return migrations.groupBy("version").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("version", "v.*").orderBy("version")
