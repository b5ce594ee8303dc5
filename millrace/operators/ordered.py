"""Ordered-history operators: flakiness, transitions, moving averages, last-N buffers, state replays.

Windows are partitioned by the series; folds that truncate run over one series' sorted array, which the
series' own length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.graph import number_rows, range_offsets, sorted_ranges


def _series(by: str, *order: str) -> Window:
    return Window.partitionBy(by).orderBy(*order)


def flips(history: DataFrame, by: str = "test_id") -> DataFrame:
    """history(by, seq, passed): runs, failures and flips of each series."""
    turned = F.lag("passed").over(_series(by, "seq"))
    return history.withColumn("flip", F.coalesce((turned != F.col("passed")).cast("long"), F.lit(0))).groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("passed")).alias("failures"), F.sum("flip").alias("flips")
    )


def flakiness(history: DataFrame, threshold: float = 0.25, by: str = "test_id") -> DataFrame:
    """Flip rate of each series and whether it reaches the threshold; fewer than two runs score 0."""
    score = F.when(F.col("runs") < 2, 0.0).otherwise(F.bround(F.col("flips") / F.greatest(F.col("runs") - 1, F.lit(1)), 3))
    return flips(history, by).select(by, score.alias("score"), (score >= threshold).alias("quarantined"))


def flaky_candidates(history: DataFrame, min_flips: int = 2, by: str = "test_id") -> DataFrame:
    return flips(history, by).where((F.col("runs") >= 3) & (F.col("flips") >= min_flips)).select(by, "flips")


def is_flaky(history: DataFrame, by: str = "test_id") -> DataFrame:
    """A series is flaky if it has both outcomes: any flip rate above a quarter implies that."""
    return history.groupBy(by).agg((F.bool_or("passed") & F.bool_or(~F.col("passed"))).alias("flaky"))


def flaky_report(history: DataFrame, by: str = "test_id") -> DataFrame:
    return flips(history, by).select(by, "runs", "failures", (F.col("failures") / F.col("runs")).alias("failure_rate"), "flips")


def transitions(touches: DataFrame, by: str | None = None) -> DataFrame:
    """touches(seq, package[, by]): counts and probabilities of changes from one package to another.

    Null packages are skipped and do not interrupt; staying on a package is no change.
    """
    known = touches.where(F.col("package").isNotNull())
    if by:
        moves = known.withColumn("from", F.lag("package").over(_series(by, "seq")))
    else:  # one history of all rows: each row meets the one numbered before it
        numbered = number_rows(known.select("seq", "package"), "seq")
        moves = numbered.join(numbered.select((F.col("number") + 1).alias("number"), F.col("package").alias("from")), "number")
    moves = moves.where(F.col("from") != F.col("package"))
    counts = moves.groupBy("from", F.col("package").alias("to")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.groupBy("from").agg(F.sum("count").alias("total"))
    return counts.join(total, "from").select("from", "to", "count", (F.col("count") / F.col("total")).alias("probability"))


def warmup_candidates(moves: DataFrame, affected: DataFrame, workspace: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Packages likely to follow an affected one, not affected themselves, and part of the workspace."""
    a = affected.select("package").distinct()
    follow = moves.join(a.withColumnRenamed("package", "from"), "from", "left_semi").where(F.col("probability") >= threshold)
    return follow.select(F.col("to").alias("package")).distinct().join(a, "package", "left_anti").join(workspace.select("package"), "package", "left_semi").orderBy("package")


def mixed_transitions(touches: DataFrame, co: DataFrame, by: str, last: Column | str, before: Column | str, k: int = 5) -> DataFrame:
    """Next targets after (before, last): half the second-order, three tenths the first-order and two tenths the co-occurrence probability."""
    order = Window.partitionBy(by).orderBy("seq")
    seen = touches.where(F.col("package").isNotNull()).select(by, "seq", F.col("package").alias("to"), F.lag("package", 1).over(order).alias("p1"), F.lag("package", 2).over(order).alias("p2"))
    p1, p2 = (F.lit(x) if isinstance(x, str) else x for x in (last, before))
    first = seen.where(F.col("p1") == p1).groupBy("to").agg(F.count(F.lit(1)).alias("n"))
    second = seen.where((F.col("p1") == p1) & (F.col("p2") == p2)).groupBy("to").agg(F.count(F.lit(1)).alias("n"))
    third = co.where(F.col("a") == p1).select(F.col("b").alias("to"), F.col("score").alias("n"))

    def part(df: DataFrame, weight: float) -> DataFrame:
        return df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("all")))).select("to", (F.col("n") / F.col("all") * weight).alias("s"))

    mixed = part(second, 0.5).unionByName(part(first, 0.3)).unionByName(part(third, 0.2))
    return mixed.groupBy("to").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "to").limit(k)


def ema(samples: DataFrame, alpha: float = 0.3, by: str = "task_name") -> DataFrame:
    """samples(by, seq, duration_sec, source_bytes): moving average of seconds a byte, by its closed form."""
    rate = F.col("duration_sec") / F.greatest(F.lit(1), F.col("source_bytes"))
    up, down = _series(by, "seq"), Window.partitionBy(by).orderBy(F.desc("seq"))
    ranked = samples.select(by, rate.alias("r"), F.row_number().over(up).alias("i"), (F.row_number().over(down) - 1).alias("age"))
    weight = F.pow(F.lit(1 - alpha), F.col("age")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return ranked.groupBy(by).agg(F.sum(F.col("r") * weight).alias("rate"))


def predict_duration(rates: DataFrame, requests: DataFrame, by: str = "task_name") -> DataFrame:
    """requests(by, source_bytes): predicted seconds, a thousandth a byte for unknown tasks."""
    return requests.join(rates, by, "left").select(by, "source_bytes", F.when(F.col("rate").isNull(), F.col("source_bytes") * 0.001).otherwise(F.bround(F.col("rate") * F.col("source_bytes"), 3)).alias("predicted_sec"))


def fold(df: DataFrame, by: str, order: str, value: str, start: Column, step) -> DataFrame:  # noqa: ANN001
    """Sequential fold of each series in order: (by, folded)."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(by).agg(sorted_.alias("_s")).select(by, F.aggregate("_s", start, step).alias("folded"))


def integer_ema(samples: DataFrame, by: str, value: str = "duration_ms", default: int = 100) -> DataFrame:
    """(8 x old + 2 x new) div 10 from a default."""
    return fold(samples, by, "seq", value, F.lit(default).cast("long"), lambda a, x: F.floor((a * 8 + x["v"] * 2) / 10).cast("long"))


def running_mean(samples: DataFrame, by: str, value: str = "duration_ms") -> DataFrame:
    """Truncating integer mean that is updated sample by sample."""
    start = F.struct(F.lit(0).cast("long").alias("avg"), F.lit(0).cast("long").alias("n"))
    folded = fold(samples, by, "seq", value, start, lambda a, x: F.struct(F.floor((a["avg"] * a["n"] + x["v"]) / (a["n"] + 1)).cast("long").alias("avg"), (a["n"] + 1).alias("n")))
    return folded.select(by, F.col("folded.avg").alias("mean"))


def interval_ema(accesses: DataFrame, by: str, at: str = "ts_ms") -> DataFrame:
    """accesses(by, at): average gap, .8 old and .2 new from 0, gaps under 1 ms ignored, and the next access expected."""
    gap = F.col(at) - F.lag(at).over(_series(by, at))
    gaps = accesses.select(by, F.col(at).alias("t"), gap.alias("g"))
    ordered = F.array_sort(F.collect_list(F.struct("t", "g")))
    folded = F.aggregate(F.filter("_s", lambda x: x["g"] >= 1), F.lit(0.0), lambda a, x: a * 0.8 + x["g"] * 0.2)
    return gaps.groupBy(by).agg(ordered.alias("_s"), F.max("t").alias("last")).select(by, folded.alias("interval_ms"), (F.col("last") + folded).alias("next_ms"))


def last_n(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The newest n rows of each series."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def last_n_builds(builds: DataFrame, n: int) -> DataFrame:
    """builds(id, seq, ...): the n ids first seen last, each with its newest row; adding an id again does not renew it."""
    rest = [c for c in builds.columns if c not in ("id", "seq")]
    return builds.groupBy("id").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct(*rest), "seq").alias("v")).orderBy(F.desc("first_seq"), "id").limit(n).select("id", "first_seq", "v.*")


def cpu_percent(samples: DataFrame, by: str) -> DataFrame:
    """samples(by, seq, total, idle): busy share between readings, by integer division, deltas not below 0, at most 100."""
    w = _series(by, "seq")
    dt = F.greatest(F.col("total") - F.lag("total").over(w), F.lit(0))
    di = F.greatest(F.col("idle") - F.lag("idle").over(w), F.lit(0))
    d = samples.select(by, "seq", dt.alias("dt"), di.alias("di"), F.lag("total").over(w).isNotNull().alias("known"))
    pct = F.when(F.col("dt") > 0, F.least(F.lit(100), F.floor(100 * F.greatest(F.col("dt") - F.col("di"), F.lit(0)) / F.col("dt"))).cast("long")).otherwise(F.lit(0).cast("long"))
    return d.where("known").select(by, "seq", pct.alias("cpu"))


#: The bars of a sparkline, low to high.
BARS = "▁▂▃▄▅▆▇█"


def sparkline(samples: DataFrame, by: str, n: int = 20, value: str = "value") -> DataFrame:
    """The last n samples of each series as one line of bars scaled to their maximum."""
    recent = last_n(samples.select(by, "seq", F.col(value).alias("v")), n, by, "seq")
    packed = recent.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "v"))).alias("s"), F.max("v").alias("m"))
    bar = F.transform("s", lambda x: F.substring(F.lit(BARS), F.when(F.col("m") > 0, F.least(F.floor(x["v"] * 7 / F.col("m")), F.lit(7))).otherwise(F.lit(0)).cast("int") + 1, F.lit(1)))
    return packed.select(by, F.array_join(bar, "").alias("line"))


def waterfall(tasks: DataFrame, width: int = 40) -> DataFrame:
    """tasks(id, start_ms, duration_ms): bar offset and length scaled to the last end, 1 wide at least."""
    end = tasks.agg(F.greatest(F.max(F.col("start_ms") + F.col("duration_ms")), F.lit(1)).alias("end"))
    scaled = lambda c: F.floor(F.col(c) * width / F.col("end")).cast("long")
    return tasks.crossJoin(F.broadcast(end)).select("id", scaled("start_ms").alias("offset"), F.greatest(scaled("duration_ms"), F.lit(1)).alias("length"))


def running_total(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Adds before: the sum of value over all rows that come earlier, within each sorted range and plus one offset a range."""
    ranged = sorted_ranges(df, *order)
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(range_offsets(ranged, F.col(value))), "_part")
    return joined.withColumn("before", F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_row", "_before")
