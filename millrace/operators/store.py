"""Content-addressed store: retention plans, quotas, chunks, compression, directory hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.graph import number_rows
from millrace.operators.ordered import running_total
from millrace.operators.tables import settle


def prune_plan(records: DataFrame, objects: DataFrame, as_of: int, max_age: int | None, max_bytes: int | None) -> DataFrame:
    """(kind, name, size, phase) of what a prune removes.

    records(key, stored_at, size, artifact), objects(name, mtime, size).
    Age: records at least max_age old go, and objects as old that no remaining record refers to, and temporary
    files. Capacity: then the oldest records go, each with the object whose last reference it was, until the
    rest fits; then the oldest objects, even if referred to.
    """
    old = F.lit(False) if max_age is None else F.lit(as_of) - F.col("stored_at") >= max_age
    kept, gone = records.where(~old), records.where(old).select(F.lit("record").alias("kind"), F.col("key").cast("string").alias("name"), "size", F.lit("age").alias("phase"), "artifact")
    live = kept.where("artifact IS NOT NULL").select(F.col("artifact").alias("name")).distinct()
    were = gone.where("artifact IS NOT NULL").select(F.col("artifact").alias("name")).distinct()
    tmp = F.col("name").endswith(".tmp")
    aged = F.lit(False) if max_age is None else F.lit(as_of) - F.col("mtime") >= max_age
    marked = objects.join(live.withColumn("live", F.lit(True)), "name", "left").join(were.withColumn("was", F.lit(True)), "name", "left")
    drop = F.when(tmp, aged).otherwise(F.col("live").isNull() & (F.col("was").isNotNull() | aged))
    marked = settle(marked.withColumn("drop", F.coalesce(drop, F.lit(False))))
    plan = gone.drop("artifact").unionByName(marked.where("drop").select(F.when(tmp, "temporary").otherwise("object").alias("kind"), "name", "size", F.lit("age").alias("phase")))
    if max_bytes is None:
        return plan
    left = marked.where("NOT drop").select("name", "mtime", "size")
    # an object's bytes go with the last record that refers to it
    last = kept.where("artifact IS NOT NULL").groupBy("artifact").agg(F.max(F.struct("stored_at", "key")).alias("last"))
    freed = left.join(last, F.col("name") == F.col("artifact")).select(F.col("last.key").alias("key"), "name", F.col("size").alias("object_size"))
    by_record = settle(kept.join(freed, "key", "left").withColumn("bytes", F.col("size") + F.coalesce("object_size", F.lit(0))))
    total = (kept.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) + (left.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    evicted = settle(running_total(by_record, "bytes", "stored_at", "key").where(F.lit(total) - F.col("before") > max_bytes))
    plan = plan.unionByName(evicted.select(F.lit("record").alias("kind"), F.col("key").cast("string").alias("name"), "size", F.lit("capacity").alias("phase")))
    plan = plan.unionByName(evicted.where("name IS NOT NULL").select(F.lit("object").alias("kind"), "name", F.col("object_size").alias("size"), F.lit("capacity").alias("phase")))
    rest = total - (evicted.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    others = left.join(evicted.where("name IS NOT NULL").select("name"), "name", "left_anti")
    more = running_total(others, "size", "mtime", "name").where(F.lit(rest) - F.col("before") > max_bytes)
    return plan.unionByName(more.select(F.lit("object").alias("kind"), "name", "size", F.lit("capacity").alias("phase")))


def gc_plan(files: DataFrame, as_of: int, ttl: int, max_bytes: int, policy: str = "lru", high: float = 0.9, low: float = 0.7) -> DataFrame:
    """files(name, size, mtime): (name, size, reason). Expired files go; if the rest is over the high mark, it is evicted down to the low one.

    policy lru takes the oldest first, smallest the smallest; ttl evicts nothing further.
    """
    old = F.lit(as_of) - F.col("mtime") >= ttl
    expired = files.where(old).select("name", "size", F.lit("ttl").alias("reason"))
    live = files.where(~old)
    total = live.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if policy == "ttl" or total <= int(max_bytes * high):
        return expired
    order = ("mtime", "name") if policy == "lru" else ("size", "name")
    over = running_total(live, "size", *order).where(F.lit(total) - F.col("before") > int(max_bytes * low))
    return expired.unionByName(over.select("name", "size", F.lit(policy).alias("reason")))


def cleanup(artifacts: DataFrame, policy: str, as_of: int = 0, seconds: int = 0, tags: tuple[str, ...] = (), keep: int = 0) -> DataFrame:
    """Artifacts that a policy removes: older_than, not_accessed_in, tags, keep_most_recent."""
    if policy == "older_than":
        return artifacts.where(F.lit(as_of) - F.col("timestamp") > seconds)
    if policy == "not_accessed_in":
        return artifacts.where(F.lit(as_of) - F.coalesce("last_accessed", "timestamp") > seconds)
    if policy == "tags":
        return artifacts.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    newest = number_rows(artifacts.withColumn("_age", -F.col("timestamp")), "_age", "hash")
    return newest.where(F.col("number") >= keep).drop("number", "_age")


def admitted(uploads: DataFrame, max_bytes: int, used: int = 0) -> DataFrame:
    """uploads(seq, hash, size) with accepted: whether the store still holds it when all before were stored; 0 means no limit."""
    return running_total(uploads, "size", "seq").withColumn("accepted", F.lit(max_bytes == 0) | (F.col("before") + F.col("size") + used <= max_bytes)).drop("before")


def compression_ratio(size: Column, compressed: Column) -> Column:
    return F.try_divide(compressed.cast("double"), F.nullif(size, F.lit(0)))


def cut_points(data: bytes, least: int, mean: int, most: int) -> list[int]:
    """Ends of content-defined chunks: from the least size on, the first place where the hash of the next eight bytes is a multiple of mean."""
    import numpy as np

    n = len(data)
    if not n:
        return [0]
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for k in range(8):  # near the end the window holds fewer bytes
        m = max(n - k, 0)
        hashes[:m] = hashes[:m] * np.uint64(0x5BD1E995) + raw[k:]
    marks = np.flatnonzero(hashes % np.uint64(max(mean, 1)) == 0)
    out, at = [], 0
    while at < n:
        rest = n - at
        if rest <= least:
            at = n
        else:
            limit = min(rest, most)
            k = int(np.searchsorted(marks, at + least))
            cut = min(int(marks[k]) - at, limit) if k < len(marks) else limit
            at += max(cut, least, 1) if least < limit else (least or rest)
        out.append(at)
    return out


def chunks(files: DataFrame, key: str = "path", content: str = "content", least: int = 2048, mean: int = 8192, most: int = 65536) -> DataFrame:
    """(key, idx, start, length, hash) of each file's content-defined chunks; an empty file has one empty chunk."""
    import hashlib

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data in zip(pdf["k"], pdf["data"], strict=True):
                data, start = bytes(data or b""), 0
                for i, end in enumerate(cut_points(data, least, mean, most)):
                    rows.append((k, i, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            yield pd.DataFrame(rows, columns=["k", "idx", "start", "length", "hash"])

    kind = dict(files.dtypes)[key]
    return files.select(F.col(key).alias("k"), F.col(content).cast("binary").alias("data")).mapInPandas(cut, f"k {kind}, idx long, start long, length long, hash string").withColumnRenamed("k", key)


def reassemble(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """manifest(path, hashes), blobs(hash, data): contents in order; a missing chunk raises."""
    parts = manifest.select("path", F.posexplode("hashes").alias("pos", "hash")).join(blobs, "hash", "left")
    checked = F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("missing chunk "), F.col("hash")))).otherwise(F.hex("data"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", checked.alias("h"))))
    return parts.groupBy("path").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("content"))


def _zstd(level: int, limit: int | None):
    @F.pandas_udf(T.LongType())
    def size(data: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        return data.map(lambda x: len(c.compress(bytes(x[:limit] if limit else x))) if x is not None else None)

    return size


#: Levels by name.
LEVELS = {"fast": 1, "default": 3, "best": 22}


def compressed_size(content: Column, level: str = "default") -> Column:
    return _zstd(LEVELS[level], None)(content.cast("binary"))


def estimated_ratio(content: Column) -> Column:
    """Ratio of the first 4096 bytes, null below 1024 bytes."""
    n = F.octet_length(content.cast("binary"))
    return F.when(n >= 1024, _zstd(3, 4096)(content.cast("binary")) / F.least(n, F.lit(4096)))


def directory_hash(files: DataFrame, root: str = "root") -> DataFrame:
    """files(root, rel, content): one digest of each root, of all files in the order of their paths."""
    each = files.select(root, "rel", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("rel", "h")))
    return each.groupBy(root).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["rel"], F.lit(":"), x["h"])), "\n"), 256).alias("digest"))


def invalidate_directory(entries: DataFrame, directory: str, key: str = "path") -> DataFrame:
    """Entries that stay when all below a directory are dropped; whole components count."""
    return entries.where(~F.col(key).startswith(directory.rstrip("/") + "/"))


def action_cache(updates: DataFrame) -> DataFrame:
    """updates(key, seq, result): the newest result of each key."""
    return updates.groupBy("key").agg(F.max_by("result", "seq").alias("result"))


def hybrid_listing(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("hash").union(remote.select("hash")).distinct().orderBy("hash")
