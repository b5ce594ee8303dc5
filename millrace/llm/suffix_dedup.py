"""Repeated passages by a run-length index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bytesets import as_blob, mix, powers, prefix_hashes, span_hashes, text_chunks
from .durable import durable, small_batches
from .rowkeys import keyed

LENGTH, GRAM = 100, 32
#: Bytes of segments indexed together, and the number of segments round one gram that one index takes.
INDEX_BYTES, PART_SEGMENTS = 1 << 20, 8_000
_POSITION_BITS = np.uint64(28)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several byte strings, with the text positions of all run ends.

    Kept: one symbol for each run of equal symbols (`heads`), the run's first row (`starts`), and, in order of
    text position, the samples of run heads with the position and the common prefix of the row above (`phi`),
    and of run tails with the row below (`phi_inverse`). Within a run, both neighbours of a suffix move along
    with it, so the samples give the neighbours and the longest match of every position: that is the matching
    statistics of the texts against themselves, streamed in text order.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """data: the strings one after another; bounds: their offsets. Equal suffixes stay apart by position."""
        n, count = len(data), len(bounds) - 1
        self.bounds, self.size = bounds, n + count
        ends = bounds[1:] + np.arange(count)  # each string is followed by a stop, below all bytes and unlike any other stop
        symbols = np.zeros(self.size, np.int64)
        keep = np.ones(self.size, bool)
        keep[ends] = False
        symbols[keep] = data.astype(np.int64) + 1
        self.left = np.repeat(bounds[:-1] + np.arange(count), np.diff(bounds) + 1)
        self.room = np.repeat(ends, np.diff(bounds) + 1) - np.arange(self.size)  # bytes up to the stop
        order = self._sort(symbols)
        self.runs = 0
        if not self.size:
            return
        before = symbols[order - 1]  # the first string's start looks at the last stop
        before = np.where(self.left[order] == order, -1 - order, before)  # a string's start ends its run
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.starts = np.concatenate(([0], change))
        self.heads = before[self.starts]
        self.runs = len(self.starts)
        tails = np.concatenate((change, [self.size])) - 1
        self.phi = self._samples(order, self.starts, -1, symbols)
        self.phi_inverse = self._samples(order, tails, 1, symbols)

    def _sort(self, symbols: np.ndarray) -> np.ndarray:
        """Suffix order, by doubling what has been compared; a suffix ends at its string's stop, stops rank by position."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        key = np.zeros(n, np.int64)
        for k in range(6):  # six symbols of nine bits
            shifted = np.zeros(n, np.int64)
            shifted[: max(n - k, 0)] = symbols[k:]
            shifted[self.room < k] = 0
            key = (key << 9) | shifted
        rank, done = self._ranks(np.argsort(key), key), 6
        longest = int(self.room.max()) + 1
        while done < longest:
            after = np.minimum(np.arange(n) + done, n - 1)
            key = rank * np.int64(n + 1) + np.where(self.room >= done, rank[after] + 1, 0)
            rank, done = self._ranks(np.argsort(key), key), 2 * done
        return np.argsort(rank * np.int64(n) + np.arange(n))

    @staticmethod
    def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        sorted_key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        return rank

    def _samples(self, order: np.ndarray, rows: np.ndarray, step: int, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        at = order[rows]
        other_rows = rows + step
        inside = (other_rows >= 0) & (other_rows < self.size)
        other = np.where(inside, order[np.clip(other_rows, 0, self.size - 1)], -1)
        common = self._common(at, other, symbols)
        by_text = np.argsort(at)
        return at[by_text], other[by_text], common[by_text]

    def _common(self, a: np.ndarray, b: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefixes, not past a stop; b below 0 has none."""
        most = np.where(b >= 0, np.minimum(self.room[a], self.room[np.maximum(b, 0)]), 0)
        got = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            same = symbols[a[live] + got[live]] == symbols[b[live] + got[live]]
            live = live[same]
            got[live] += 1
            live = live[got[live] < most[live]]
        return got

    def neighbours(self, at: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray]:
        """For text positions: the position in the row above (or below), and the length they have in common."""
        samples, other, common = self.phi_inverse if below else self.phi
        k = np.searchsorted(samples, at, "right") - 1
        moved = at - samples[k]
        there = np.where(other[k] >= 0, other[k] + moved, -1)
        return there, np.where(there >= 0, np.maximum(common[k] - moved, 0), 0)

    def repeated(self, length: int) -> np.ndarray:
        """The positions whose next `length` bytes also begin at a smaller position.

        Each long match is followed from row to row, both ways, until an earlier position turns up or the match
        becomes too short; rows of equal windows are in no order of position, so few steps suffice.
        """
        at = np.flatnonzero(self.room >= length)
        found = np.zeros(self.size, bool)
        for below in (False, True):
            live = at[~found[at]]
            now = live
            while len(live):
                there, common = self.neighbours(now, below)
                on = common >= length
                live, there = live[on], there[on]
                hit = there < live
                found[live[hit]] = True
                live, now = live[~hit], there[~hit]
        return np.flatnonzero(found)


def repeated_windows(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte of the strings: whether a window of `length` that begins there also begins earlier."""
    index = RunLengthIndex(data, bounds)
    out = np.zeros(len(data), bool)
    at = index.repeated(length) if index.size else np.zeros(0, np.int64)
    out[at - (np.searchsorted(bounds[1:] + np.arange(len(bounds) - 1), at, "left"))] = True
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of windows that share their least gram: (row, start, end, gram's hash, segment's hash); bytes from the row's start."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = prefix_hashes(data)
    _, inverse = powers(n)
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    key = (grams & ~((np.uint64(1) << _POSITION_BITS) - np.uint64(1))) | at
    windows = n - length + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))
    least = least.astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = row[:windows] == row[length - 1 :]
    first = ok.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
    ends = np.flatnonzero(last) + length
    rows = row[starts]
    return rows, starts - offsets[rows], ends - offsets[rows], grams[least[starts]].view(np.int64), span_hashes(prefix, starts, ends).view(np.int64)


_SEGMENT = T.StructType([T.StructField("known", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("gram", "segment", "doc")] + [T.StructField(c, T.IntegerType()) for c in ("start", "stop")])


def _parts(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 23) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The chunk as it is; a single very long text in parts that share no window."""
    if len(data) <= most:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, most):
        part = data[at : at + most + length - 1]
        yield at, part, np.array([0, len(part)])


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi, chunk, bounds in text_chunks(batch.column("text")):
                for at, data, offsets in _parts(chunk, bounds, length):
                    rows, starts, ends, grams, segments = _anchors(data, offsets, length, gram)
                    docs = ids[lo:hi][rows]
                    order = np.lexsort((starts, docs, segments, grams))
                    g, s = grams[order], segments[order]
                    known = np.zeros(len(order), bool)  # the same segment stands earlier in this chunk
                    known[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
                    g = np.where(known, mix((docs[order] * 1_000_003 + starts[order]).view(np.uint64)).view(np.int64), g)  # nothing more to find out: dealt evenly
                    spans = [pa.array((x[order] + at).astype(np.int32)) for x in (starts, ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(g), pa.array(s), pa.array(docs[order]), *spans], names=_SEGMENT.names)

    return run


def _window_runs(hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set positions, each as the bytes its windows cover."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1


_FOUND = "doc long, start int, stop int, gram long, fragment int, firsts binary"


def _found(**columns: np.ndarray | list) -> pa.RecordBatch:
    """Rows of _FOUND with nulls in the columns that are not given."""
    kinds = {"doc": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "gram": pa.int64(), "fragment": pa.int32(), "firsts": pa.binary()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _indexed(length: int, index_bytes: int):
    """Rows (gram, parts, part, doc, start, piece) in order: indexes whole groups of a gram, several at a time, and each part of a divided gram by itself.

    Gives the spans that repeat. Of a divided gram it also gives the windows that are the first of their kind in their part,
    as two hashes, dealt to as many fragments of all hashes as the gram has parts: one row for each part and fragment.
    """
    table = np.random.default_rng(7).permutation(256).astype(np.uint8)

    def marked(group: list[tuple[int, int, bytes]], gram: int, parts: int) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate(([0], np.cumsum([len(x[2]) for x in group]))).astype(np.int64)
        data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        docs, starts = np.array([x[0] for x in group], np.int64), np.array([x[1] for x in group], np.int64) - bounds[:-1]
        hit = repeated_windows(data, bounds, length)
        a, b = _window_runs(hit, length)
        k = np.searchsorted(bounds, a, "right") - 1
        yield _found(doc=docs[k], start=(starts[k] + a).astype(np.int32), stop=(starts[k] + b).astype(np.int32))
        if parts == 1:
            return
        at = np.flatnonzero(~hit & (np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data)) >= length))
        one, two = (span_hashes(prefix_hashes(x), at, at + length) for x in (data, table[data]))
        f = ((one >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(f, kind="stable")
        at, one, two, f = at[order], one[order], two[order], f[order]
        k = np.searchsorted(bounds, at, "right") - 1
        doc, start = docs[k], starts[k] + at
        used, first = np.unique(f, return_index=True)
        edges = np.append(first, len(f))
        blobs = [as_blob(one[x:y], two[x:y], doc[x:y], start[x:y]) for x, y in zip(edges, edges[1:])]
        yield _found(gram=np.full(len(used), gram, np.int64), fragment=used.astype(np.int32), firsts=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes]] = []
        size, last, divided = 0, (0, 0), 1
        for batch in batches:
            for gram, parts, part, doc, start, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "parts", "part", "doc", "start", "piece")), strict=True):
                if (gram, part) != last and group and (divided > 1 or parts > 1 or size >= index_bytes):
                    yield from marked(group, last[0], divided)
                    group, size = [], 0
                last, divided = (gram, part), parts
                group.append((doc, start, piece))
                size += len(piece)
        if group:
            yield from marked(group, last[0], divided)

    return run


def _across(length: int):
    """Rows (gram, fragment, firsts) in order: the spans of windows that stand earlier in another part."""

    def later(blobs: list[bytes]) -> pa.RecordBatch:
        sent = [np.frombuffer(b, np.int64).reshape(4, -1) for b in blobs]
        one, two, doc, start = np.concatenate(sent, axis=1)
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = one[order], two[order], doc[order], start[order]
        again = np.zeros(len(order), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        doc, start = doc[again], start[again]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(doc))[: len(begin)] - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(start[begin].astype(np.int32)), pa.array((start[end] + length).astype(np.int32))], names=["doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = None, []
        for batch in batches:
            for gram, fragment, blob in zip(*(batch.column(c).to_pylist() for c in ("gram", "fragment", "firsts")), strict=True):
                if (gram, fragment) != last and blobs:
                    yield later(blobs)
                    blobs = []
                last = (gram, fragment)
                blobs.append(blob)
        if blobs:
            yield later(blobs)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the spans of each text and cuts them out."""
    for batch in batches:
        spans = batch.column("spans")
        pairs = spans.flatten()
        begin, stop = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        edges = spans.offsets.to_numpy() - spans.offsets[0].as_py()
        sizes, kept, merged = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            raw = (text or "").encode()
            sizes.append(len(raw))
            a, b = begin[edges[i] : edges[i + 1]], stop[edges[i] : edges[i + 1]]
            if not len(a):
                merged.append([])
                kept.append(raw)
                continue
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            cover = np.cumsum(depth[:-1]) > 0
            edge = np.diff(np.concatenate(([0], cover.view(np.int8), [0])))
            merged.append([{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~cover].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
            names=["doc", "n_bytes", "spans", "kept"],
        )


_SPAN_LIST = "array<struct<start:int,stop:int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """Rows (doc, n_bytes, spans, kept) for docs (doc long, unique; text): the byte spans covered by strings of `length` that also start earlier, and the other bytes.

    Equal windows have the same least gram at the same place, so the windows round each such gram form a segment
    of under 2 x length bytes, and only segments round the same gram can share a window. Segments equal to an
    earlier one repeat whole: this shows within a chunk at once, else after one shuffle of hashes.
    Of segments that differ, those whose gram occurs in several go on with their bytes to a run-length index.
    A gram with more than part_segments segments is dealt to parts by document, each with an index of its own; what is
    the first of its kind in its part is then compared with the firsts of the other parts, in fragments of their hashes.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc", "text")
    by_gram = Window.partitionBy("gram")
    placed = (
        texts.mapInArrow(_segments(length, gram), _SEGMENT)
        .withColumn("above", F.lag("segment").over(by_gram.orderBy("known", "segment", "doc", "start")))
        .withColumn("low", F.min("segment").over(by_gram))
        .withColumn("high", F.max("segment").over(by_gram))
        .withColumn("many", F.count(F.lit(1)).over(by_gram))
        .withColumn("again", F.col("known") | F.coalesce(F.col("above") == F.col("segment"), F.lit(False)))
        .where("again OR low <> high")
    )
    per_doc = durable(
        placed.groupBy("doc").agg(
            F.collect_list(F.when(F.col("again"), F.struct("start", "stop"))).alias("whole"),
            F.collect_list(F.when(~F.col("again"), F.struct("gram", "start", "stop", F.ceil(F.col("many") / part_segments).alias("parts")))).alias("open"),
        )
    )
    cut = F.transform("open", lambda s: F.struct(s["gram"].alias("gram"), s["start"].alias("start"), s["parts"].alias("parts"), F.pmod(F.xxhash64("doc"), s["parts"]).alias("part"), F.col("text").cast("binary").substr(s["start"] + 1, s["stop"] - s["start"]).alias("piece")))
    pieces = texts.join(per_doc.where(F.size("open") > 0).select("doc", "open"), "doc").select("doc", cut.alias("cut")).select("doc", F.inline("cut"))
    indexed = durable(
        pieces.select("gram", "parts", "part", "doc", "start", "piece").repartition("gram", "part").sortWithinPartitions("gram", "part", "doc", "start")
        .mapInArrow(_indexed(length, index_bytes), _FOUND)
    )
    firsts = indexed.where("firsts IS NOT NULL").select("gram", "fragment", "firsts")
    later = firsts.repartition("gram", "fragment").sortWithinPartitions("gram", "fragment").mapInArrow(_across(length), "doc long, start int, stop int")
    found = indexed.where("firsts IS NULL").select("doc", "start", "stop").unionByName(later).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    empty = F.array().cast(_SPAN_LIST)
    spans = F.concat(F.coalesce("whole", empty), F.coalesce("found", empty)).alias("spans")
    return (
        texts.join(per_doc.select("doc", "whole"), "doc", "left").join(found, "doc", "left").select("doc", "text", spans)
        .mapInArrow(_merged, f"doc long, n_bytes long, spans {_SPAN_LIST}, kept binary")
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Rows (id, n_bytes, spans, kept): what repeats in each text of docs as UTF-8 bytes, and the bytes that stay.

    Documents come in the order of their ids. Null texts are empty, and texts shorter than the length lose
    nothing. Rows that repeat an id with the same text are one document with one result row; rows that share
    an id but not the text are taken in an order by the text's hash; a null id comes first. Other columns are not
    read. An empty table gives no rows.
    """
    texts, key = keyed(docs, id_col, text_col)
    spans = repeated_spans(texts, **options)
    if key is None:
        return spans.withColumnRenamed("doc", id_col)
    return spans.join(key, "doc").select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
