"""Stateful operators: batch twins as plain DataFrame functions, and their streaming forms.

Time is always a column or an argument. The streaming forms add event time and watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def _debounced(times: list[int], paths: list[str], width: int) -> list[tuple[int, list[str]]]:
    out: list[tuple[int, set[str]]] = []
    for t, p in sorted(zip(times, paths)):
        if not out or t >= out[-1][0] + width:
            out.append((t, set()))
        out[-1][1].add(p)
    return [(t, sorted(ps)) for t, ps in out]


def debounce(events: DataFrame, by: str, width_ms: int = 50) -> DataFrame:
    """events(by, ts_ms, path): windows of at least 50 ms that start at their first event, with the distinct paths in them."""
    width, kind = max(width_ms, 50), dict(events.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[by].iloc[0], t, ps) for t, ps in _debounced(pdf["ts_ms"].tolist(), pdf["path"].tolist(), width)]
        return pd.DataFrame(rows, columns=[by, "window_start", "paths"])

    return events.select(by, "ts_ms", "path").groupBy(by).applyInPandas(run, f"{by} {kind}, window_start long, paths array<string>")


class Debounce(StatefulProcessor):
    """Streaming debounce: the first event of a key opens a window and sets a timer, which emits and clears it."""

    def __init__(self, width_ms: int = 50):
        self.width = max(width_ms, 50)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            for t, p in sorted(zip(pdf["ts_ms"].tolist(), pdf["path"].tolist())):
                if self.open.exists() and t >= self.open.get()[0] + self.width:
                    yield self._close(key)
                if not self.open.exists():
                    self.open.update((int(t),))
                    self.handle.registerTimer(int(t) + self.width)
                self.paths.updateValue((p,), (True,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.open.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.open.get()[0] + self.width:
            yield self._close(key)

    def _close(self, key) -> pd.DataFrame:  # noqa: ANN001
        out = pd.DataFrame({"key": [key[0]], "window_start": [self.open.get()[0]], "paths": [sorted(k[0] for k in self.paths.keys())]})
        self.open.clear()
        self.paths.clear()
        return out

    def close(self) -> None:
        return


def debounce_stream(events: DataFrame, width_ms: int = 50, key_type: str = "string", time_mode: str = "ProcessingTime") -> DataFrame:
    """events(key, ts_ms, path) as a stream; needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(Debounce(width_ms), f"key {key_type}, window_start long, paths array<string>", "Append", time_mode)


def dirty_set(events: DataFrame, ignored: str = r"\.git|target") -> DataFrame:
    return events.where(~F.col("path").rlike(ignored)).select("path").distinct()


def latest(updates: DataFrame, by: str, order: str) -> DataFrame:
    """Newest row of each key; of equal times the greatest row."""
    rest = [c for c in updates.columns if c not in (by, order)]
    return updates.groupBy(by).agg(F.max(F.struct(order, *rest)).alias("v")).select(by, "v.*")


def unknown_heartbeats(heartbeats: DataFrame, registered: DataFrame) -> DataFrame:
    return heartbeats.join(registered.select("worker_id"), "worker_id", "left_anti")


def healthy(workers: DataFrame, as_of: Column, timeout: str) -> DataFrame:
    """Workers with a heartbeat strictly after as_of less the timeout (an interval); the others are pruned."""
    return workers.withColumn("healthy", F.col("last_heartbeat") > as_of - F.expr(f"INTERVAL {timeout}"))


def _spend(rows: pd.DataFrame, capacity: float, rate: float, level: tuple[float, float] | None) -> tuple[list[tuple[int, bool, float]], tuple[float, float]]:
    """(seq, allowed, left) of one bucket's requests in order, and its level after them; a bucket without a level is full."""
    out = []
    for t, seq, n in rows.sort_values(["ts_s", "seq"])[["ts_s", "seq", "n"]].itertuples(index=False):
        left, since = level or (capacity, t)
        left = min(capacity, left + max(0.0, t - since) * rate)
        ok = left >= n
        level = (left - n if ok else left, max(since, t))
        out.append((seq, ok, level[0]))
    return out, level


def token_bucket(requests: DataFrame, by: str, capacity: float, rate: float) -> DataFrame:
    """requests(by, ts_s, n, seq): whether each is allowed by a bucket that starts full and refills at rate a second; (by, seq, allowed, left).

    Every request depends on those before it, so a key is one task, in time linear in its requests.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_spend(pdf, float(capacity), rate, None)[0], columns=["seq", "allowed", "left"])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    typed = requests.select(by, F.col("ts_s").cast("double").alias("ts_s"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("double").alias("n"))
    return typed.groupBy(by).applyInPandas(run, f"{by} {dict(requests.dtypes)[by]}, seq long, allowed boolean, left double")


class TokenBucket(StatefulProcessor):
    """Streaming token bucket: a key's state is its level and the time of it. Within a batch requests are taken by time."""

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate = float(capacity), rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "left double, ts_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found, level = _spend(pd.concat(rows), self.capacity, self.rate, tuple(self.level.get()) if self.level.exists() else None)
        self.level.update(tuple(float(x) for x in level))
        out = pd.DataFrame(found, columns=["seq", "allowed", "left"])
        out.insert(0, "key", key[0])
        yield out

    def close(self) -> None:
        return


def token_bucket_stream(requests: DataFrame, capacity: float, rate: float, key_type: str = "string") -> DataFrame:
    """requests(key, ts_s, n, seq) as a stream: (key, seq, allowed, left); needs the RocksDB state store."""
    typed = requests.select("key", F.col("ts_s").cast("double").alias("ts_s"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("double").alias("n"))
    return typed.groupBy("key").transformWithStateInPandas(TokenBucket(capacity, rate), f"key {key_type}, seq long, allowed boolean, left double", "Append", "None")


def circuit_state(calls: DataFrame, by: str, as_of: Column, failures: int = 3, seconds: int = 10) -> DataFrame:
    """calls(by, ts_s, ok): open if at least `failures` came after the last success and the last of them within `seconds`."""
    last_ok = F.max(F.when(F.col("ok"), F.col("ts_s"))).over(Window.partitionBy(by))
    since = calls.withColumn("_ok", last_ok).where(~F.col("ok") & (F.col("_ok").isNull() | (F.col("ts_s") > F.col("_ok"))))
    counted = since.groupBy(by).agg(F.count(F.lit(1)).alias("failures"), F.max("ts_s").alias("last_failure"))
    open_ = (F.coalesce("failures", F.lit(0)) >= failures) & (as_of - F.col("last_failure") <= seconds)
    return calls.select(by).distinct().join(counted, by, "left").select(by, F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.coalesce(open_, F.lit(False)).alias("open"))


class _Expiring(StatefulProcessor):
    """A key's state holds until a deadline of processing time, which every batch of its rows may move."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")

    def _until(self, at: int | None) -> None:
        if self.deadline.exists():
            self.handle.deleteTimer(self.deadline.get()[0])
            self.deadline.clear()
        if at is not None:
            self.deadline.update((int(at),))
            self.handle.registerTimer(int(at))

    def close(self) -> None:
        return


class CircuitBreaker(_Expiring):
    """Streaming circuit breaker: a success resets, enough failures since open it, a quiet time closes it again."""

    def __init__(self, failures: int, seconds: float):
        self.most, self.quiet = failures, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = self.failures.get()[0] if self.failures.exists() else 0
        for ok in pd.concat(rows).sort_values("ts_s", kind="stable")["ok"]:
            n = 0 if ok else n + 1
        self.failures.update((int(n),))
        is_open = n >= self.most
        self._until(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000) if is_open else None)
        yield pd.DataFrame({"key": [key[0]], "failures": [n], "open": [is_open]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.deadline.clear()
        yield pd.DataFrame({"key": [key[0]], "failures": [self.failures.get()[0]], "open": [False]})


def circuit_stream(calls: DataFrame, failures: int = 3, seconds: float = 10, key_type: str = "string") -> DataFrame:
    """calls(key, ts_s, ok) as a stream: (key, failures, open) whenever a key was called or its breaker closes."""
    return calls.groupBy("key").transformWithStateInPandas(CircuitBreaker(failures, seconds), f"key {key_type}, failures long, open boolean", "Append", "ProcessingTime")


class Liveness(_Expiring):
    """Streaming health: a heartbeat after none makes a worker healthy, none for the timeout prunes it."""

    def __init__(self, seconds: float):
        self.timeout = seconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if sum(len(x) for x in rows) and not self.deadline.exists():
            yield pd.DataFrame({"key": [key[0]], "healthy": [True]})
        self._until(timerValues.getCurrentProcessingTimeInMs() + int(self.timeout * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.deadline.clear()
        yield pd.DataFrame({"key": [key[0]], "healthy": [False]})


def healthy_stream(heartbeats: DataFrame, seconds: float = 30, key_type: str = "string") -> DataFrame:
    """heartbeats(key, ...) as a stream: (key, healthy) whenever a worker turns healthy or is pruned."""
    return heartbeats.groupBy("key").transformWithStateInPandas(Liveness(seconds), f"key {key_type}, healthy boolean", "Append", "ProcessingTime")


def active_peers(announcements: DataFrame, own_id: str, as_of: Column, seconds: int = 60) -> DataFrame:
    """announcements(message, ts_s) like id|host|port: newest of each peer, self and bad ports left out."""
    parts = F.split("message", r"\|")
    rows = announcements.select(parts.getItem(0).alias("peer_id"), F.get(parts, F.lit(1)).alias("host"), F.get(parts, F.lit(2)).try_cast("int").alias("port"), "ts_s")
    good = rows.where((F.col("peer_id") != own_id) & F.col("port").between(1, 65535))
    return latest(good, "peer_id", "ts_s").select("peer_id", "host", "port", F.col("ts_s").alias("last_seen"), (as_of - F.col("ts_s") < seconds).alias("active"))


def progress_stream(updates: DataFrame) -> DataFrame:
    """Running counts of updates by state, for complete or update mode."""
    return updates.groupBy("state").agg(F.count(F.lit(1)).alias("tasks"))


def latest_stream(updates: DataFrame, by: str, order: str, delay: str = "10 minutes") -> DataFrame:
    """Newest values of each key as a stream; rows later than the delay are dropped."""
    rest = [c for c in updates.columns if c not in (by, order)]
    return updates.withWatermark(order, delay).groupBy(by).agg(F.max(F.struct(order, *rest)).alias("v")).select(by, "v.*")


def upsert_sink(path: str, key: str, order: str):
    """foreachBatch step that keeps the newest row of each key in numbered Parquet versions below path."""
    from millrace.sources.readers import upsert

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        before = f"{path}/v{epoch - 1}"
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        base = spark.read.parquet(before) if epoch and fs.exists(hadoop(before)) else batch.limit(0)
        upsert(base, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return step


def span_children(spans: DataFrame) -> DataFrame:
    """spans(span_id, parent_id, ...): each span with the number of its direct children."""
    counts = spans.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("span_id")).agg(F.count(F.lit(1)).alias("children"))
    return spans.join(counts, "span_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
