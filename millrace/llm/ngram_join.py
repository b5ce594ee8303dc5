"""Similarity join on word shingles by vertical partitioning of the global shingle order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesets import as_blob, mix, text_chunks, words
from .durable import durable, shuffle_partitions, small_batches
from .rowkeys import keyed

#: Share of a set's least shingles that go to the fragments beyond the prefix that any partner must meet.
EXTRA = 0.15
#: Fragments in which the overlaps of a pair are counted.
VERTICAL = 4
#: Classes of frequency for each doubling, in which shingles are ordered before their hash.
CLASSES = 16
#: Blocks of sizes for each e-fold, in which partners of a given size are looked up.
BLOCKS = 50


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of k-word shingles of a chunk: hashes in order within each row, their rows, and each row's first entry (and the end).

    A row of fewer than k words has its whole sequence as its one shingle, a row without words has none.
    """
    hashes, rows, first = words(data, offsets)
    counts = np.diff(first)
    step = np.uint64(0xD1342543DE82EF95)
    full = max(len(hashes) - k + 1, 0)
    acc = np.zeros(full, np.uint64)
    for j in range(k):
        acc = acc * step + hashes[j : j + full]
    whole = rows[:full] == rows[k - 1 : k - 1 + full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    own = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        on = counts[short] > j
        own[on] = own[on] * step + hashes[first[short[on]] + j]
    own = own + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    s = np.concatenate((mix(acc[whole]), mix(own)))
    r = np.concatenate((rows[:full][whole], short))
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[fresh], r[fresh]
    return s, r, np.searchsorted(r, np.arange(len(offsets)))


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _deal(k: int, percent: int, fragments: int):
    """For each chunk and fragment of the shingle order: the low bits of its shingles and the documents they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                s, r, first = shingles(data, offsets, k)
                n = np.diff(first)
                extra = np.ceil(EXTRA * n).astype(np.int64)
                take = np.minimum(n, n - _least(n, percent) + extra)
                need = np.minimum(take, np.maximum(1, np.ceil(EXTRA * _least(n, percent)).astype(np.int64)))
                use = np.arange(len(s)) - first[r] < take[r]
                s, r = s[use], r[use]
                order = np.lexsort((r, s))
                s, r = s[order], r[order]
                head = np.ones(len(s), bool)
                head[1:] = s[1:] != s[:-1]
                size = np.diff(np.append(np.flatnonzero(head), len(s)))
                many = np.repeat(size > 1, size)
                met = np.bincount(r[many], minlength=hi - lo)  # shared within the chunk
                s, r, many = s[head], r[head], many[head]
                fragment = ((s >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                edges = np.searchsorted(fragment, np.arange(fragments + 1))
                keys, payloads = [], []
                docs = ids[lo:hi]
                for f in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[f], edges[f + 1])
                    single = ~many[part]
                    low, doc = s[part] & np.uint64((1 << 40) - 1), docs[r[part]]
                    by = np.argsort(doc[single], kind="stable")
                    doc = doc[single][by]
                    mixed = np.concatenate((low[single][by], low[~single]))
                    payloads.append(as_blob(np.array([len(doc), len(mixed), 0], np.int64), np.diff(doc, prepend=0), np.ascontiguousarray(mixed).view(np.uint8).reshape(-1, 8)[:, :5].T))
                    keys.append(int(f))
                keys.append(int(mix(np.array([docs[0]]).view(np.uint64))[0] % np.uint64(fragments)))
                payloads.append(as_blob(np.array([0, 0, len(docs)], np.int64), docs, n.astype(np.int64), need.astype(np.int64), met.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(payloads, pa.binary())], names=["fragment", "payload"])

    return run


_COUNTS = "doc long, n long, need long, met long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fragment: how many of each document's shingles there also occur in another document."""

    def met(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, single, many = [], [], []
        for blob in blobs:
            a, m, rows = np.frombuffer(blob, np.int64, 3)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(blob, np.int64, offset=24).reshape(4, -1)], names=["doc", "n", "need", "met"])
                continue
            docs.append(np.cumsum(np.frombuffer(blob, np.int64, a, 24)))
            raw = np.zeros((m, 8), np.uint8)
            raw[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, 24 + 8 * a).reshape(5, -1).T
            low = raw.view(np.uint64).ravel()
            single.append(low[:a])
            many.append(low[a:])
        if not docs:
            return
        low, doc, shared = np.concatenate(single), np.concatenate(docs), np.concatenate(many)
        order = np.argsort(low)
        low, doc = low[order], doc[order]
        twice = np.zeros(len(low), bool)
        twice[1:] = low[1:] == low[:-1]
        twice[:-1] |= twice[1:]
        found, counts = np.unique(doc[twice | np.isin(low, shared)], return_counts=True)
        zero = pa.array(np.zeros(len(found), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(found), zero, zero, pa.array(counts.astype(np.int64))], names=["doc", "n", "need", "met"])

    last, blobs = None, []
    for batch in batches:
        for f, blob in zip(batch.column("fragment").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if f != last:
                yield from met(blobs)
                last, blobs = f, []
            blobs.append(blob)
    yield from met(blobs)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                s, _, first = shingles(data, offsets, k)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s)))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(0x632BE59BD9B4E019)))))
                tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), *(pa.array((x[first[1:]] - x[first[:-1]]).view(np.int64)) for x in (total, other)), tokens],
                    names=["doc", "n", "sum_a", "sum_b", "tokens"],
                )

    return run


def fragment_borders(occurrences: dict[int, int], fragments: int) -> list[tuple[int, int]]:
    """Where (class, shingle) order is cut into ranges of about equal occurrences: classes by their counts, inside a class by the hash."""
    total, borders, past = sum(occurrences.values()), [], 0
    for c in sorted(occurrences):
        here = occurrences[c]
        while len(borders) < fragments - 1 and past + here >= (goal := total * (len(borders) + 1) / fragments):
            borders.append((c, min((1 << 63) - 1, int((goal - past) / here * (1 << 64)) - (1 << 63))))
        past += here
    return borders


def _fragments(ranked: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    """Rows (doc, n, alone, part, start, tokens): each set's ordered shingles cut at the borders; start counts those in earlier parts."""
    beyond = lambda t, b: (t["c"] > b[0]) | ((t["c"] == b[0]) & (t["token"] >= b[1]))

    def inside(low: tuple[int, int] | None, high: tuple[int, int] | None) -> Callable[[Column], Column]:
        return lambda t: (beyond(t, low) if low else F.lit(True)) & (~beyond(t, high) if high else F.lit(True))

    cut = [F.transform(F.filter("order", inside(*ends)), lambda t: t["token"]) for ends in zip([None, *borders], [*borders, None], strict=True)]
    parts = ranked.select("doc", "n", "alone", F.array(*cut).alias("parts"))
    starts = parts.select("doc", "n", "alone", "parts", F.posexplode("parts").alias("part", "tokens"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("part")), F.lit(0), lambda n, p: n + F.size(p))
    return starts.select("doc", "n", "alone", "part", before.alias("start"), "tokens")


def _partial(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """For each pair (x, y) and fragment: the shingles of x there, and those that y lacks. The plan is the same at every size."""
    side = lambda c: parts.select(F.col("doc").alias(c), "part", F.col("tokens").alias(f"t{c}"), F.col("n").alias(f"n{c}"))
    met = pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), ["y", "part"])
    return met.withColumn("left", F.array_except("tx", "ty")).withColumn("c", F.size("tx") - F.size("left"))


def _overlapping(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that link: overlaps are counted in each fragment by itself and summed for each pair."""
    summed = _partial(pairs, parts).groupBy("x", "y").agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum("c").alias("c"))
    return summed.where(_enough("c", percent)).select("x", "y")


def _enough(overlap: str | Column, percent: int) -> Column:
    """Whether an overlap of sets of nx and ny shingles links them."""
    overlap = F.col(overlap) if isinstance(overlap, str) else overlap
    return ((100 + percent) * overlap) >= (percent * (F.col("nx") + F.col("ny")))


def _fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def _side(lists: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """A list's entries with their columns named for one side of a pair."""
    return lists.select(*keys, F.col("doc").alias(c), *[F.col(name).alias(name + c) for name in ("n", "pos", "g", "pv", "o")], (F.col("g") == F.col("main")).alias(f"m{c}"))


def _open(lists: DataFrame, keys: list[str]) -> DataFrame:
    """The lists that see more than one group, each entry with the group that has most of the list."""
    by_group = lists.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("c"))
    main = by_group.groupBy(*keys).agg(F.max(F.struct("c", "g")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return durable(lists.join(main.select(*keys, F.col("main.g").alias("main")).hint("merge"), keys))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (x, y), component the least node: alternating large and small stars, on written tables."""
    now = durable(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def similar_groups(texts: DataFrame, k: int, percent: int, fragments: int | None = None) -> DataFrame:
    """Rows (doc, n_shingles, component) for texts (doc long, unique; text), two linked if 100 x overlap >= percent x union.

    1. Each set's least shingles (its prefix, and as many more as EXTRA says) are dealt to the fragments of the
       hash order. A fragment counts, for each document, the shingles that another document has too; the
       partial counts are summed per document. Whoever shares fewer than any partner would demand has no link.
    2. The others' sets are built whole; equal sets become one. Shingles are ordered by their frequency among all
       these sets, rarest first, and the order is cut into VERTICAL ranges of about equal occurrences. All overlaps
       below are counted in each of these fragments by itself and summed for each pair.
    3. Partners meet in a shingle of both prefixes. Per shingle, the document with the fewest shingles of its own is
       the leader; each document is compared with the two leaders it meets most and with its pivot, the favourite of
       its favourite. This joins the bulk of a large group at linear cost and gives each document its overlap with
       its pivot and the shingles that its pivot lacks.
    4. Wherever a list still sees documents of different groups, their pairs are candidates, in three joins:
       - alike pivots, and both overlaps with the pivot leave room for a link: by the prefixes and the size;
       - alike pivots otherwise: the two must also share shingles that the pivot lacks, so they meet in the prefixes
         of what the pivot lacks. Members of a large group that are only nearly alike have little in common there;
       - unlike pivots: by the prefixes, for each two pivots that a shingle sees.
       All bounds are lossless, so no link is lost.
    The joins whose sides grow with the input merge sorted sides at every size, so that the plan for a small
    input is the plan for a large one.
    """
    spark = texts.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    deal = texts.mapInArrow(_deal(k, percent, f := fragments or 4 * parts), "fragment int, payload binary")
    counts = durable(
        deal.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(_meet, _COUNTS)
        .groupBy("doc").agg(F.max("n").alias("n"), F.max("need").alias("need"), F.sum("met").alias("met"))
    )
    near = texts.join(counts.where("n > 0 AND met >= need").select("doc").hint("merge"), "doc", "left_semi")
    sets = durable(near.mapInArrow(_sets(k), "doc long, n long, sum_a long, sum_b long, tokens array<long>"))
    alike = durable(sets.groupBy("n", "sum_a", "sum_b").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")))
    entries = sets.join(alike.select("rep").hint("merge"), F.col("doc") == F.col("rep"), "left_semi").select("doc", "n", F.explode("tokens").alias("token"))
    shared = durable(entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("c", F.floor(CLASSES * F.log2("df")).cast("int")))
    borders = fragment_borders({r.c: r.n for r in shared.groupBy("c").agg(F.sum("df").alias("n")).collect()}, VERTICAL)
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = (
        entries.join(shared.select("token", "c").hint("merge"), "token").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("order"))
        .withColumn("alone", F.col("n") - F.size("order")).where(F.col("alone") < longest)
    )
    vertical = durable(_fragments(ranked, borders))
    room = longest - F.col("alone") - F.col("start")
    prefix = durable(
        vertical.where(room > 0).select("doc", "n", "alone", "start", F.posexplode(F.slice("tokens", F.lit(1), room.cast("int"))).alias("i", "token"))
        .select("token", "doc", "n", "alone", (F.col("alone") + F.col("start") + F.col("i")).alias("pos"))
    )

    # leaders, pivots and first links
    leaders = prefix.groupBy("token").agg(F.min(F.struct("alone", "doc", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    votes = (
        prefix.join(leaders.hint("merge"), "token").select(F.col("doc").alias("x"), F.col("lead.doc").alias("y"), "n", F.col("lead.n").alias("m"))
        .where(_fit("n", "m", percent)).groupBy("x", "y").count()
    )
    chosen = durable(votes.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("count"), "y"))).where("k <= 2").select("x", "k", "y"))
    first = chosen.where("k = 1")
    pivot = first.alias("a").join(first.alias("b"), F.col("a.y") == F.col("b.x"), "left").select(F.col("a.x").alias("x"), F.coalesce("b.y", "a.y").alias("y"))
    asked = pivot.withColumn("home", F.lit(True)).unionByName(chosen.select("x", "y", F.lit(False).alias("home"))).groupBy("x", "y").agg(F.max("home").alias("home"))
    measured = durable(
        _partial(asked, vertical).groupBy("x", "y", "home")
        .agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum("c").alias("o"), F.collect_list(F.when(F.col("home"), F.struct("part", "left"))).alias("left"))
    )
    led = durable(measured.where((F.col("x") != F.col("y")) & _enough("o", percent)).select("x", "y"))
    group = durable(led.groupBy("x").agg(F.min("y").alias("g")))
    of = group.alias("a").join(group.alias("b"), F.col("a.g") == F.col("b.x"), "left").select(F.col("a.x").alias("doc"), F.coalesce("b.g", "a.g").alias("g"))
    home = measured.where("home").select(F.col("x").alias("doc"), F.col("y").alias("pv"), "o", F.flatten(F.transform(F.sort_array("left"), lambda p: p["left"])).alias("left"))
    known = durable(
        prefix.groupBy("doc").agg(F.first("n").alias("n"), F.first("alone").alias("alone")).join(home.hint("merge"), "doc", "left").join(of.hint("merge"), "doc", "left")
        .select("doc", "n", "alone", F.coalesce("g", "doc").alias("g"), F.coalesce("pv", "doc").alias("pv"), F.coalesce("o", "n").alias("o"), "left")
    )

    # candidates
    by_prefix = prefix.select("token", "doc", "pos").join(known.drop("left", "alone").hint("merge"), "doc").select("token", "pv", "doc", "n", "pos", "g", "o")
    lists = _open(by_prefix, ["token"])
    lacking = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("o"))
    by_left = (
        known.where("o < n").select("pv", "doc", "n", "g", "o", F.posexplode(F.slice("left", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.col("o") - lacking + 1 - F.col("alone")).cast("int"))).alias("i", "token"), "alone")
        .select("token", "pv", "doc", "n", (F.col("alone") + F.col("i")).alias("pos"), "g", "o")
    )
    apart_lists = _open(by_left, ["token", "pv"])
    differ = (F.col("gx") != F.col("gy")) & _fit("nx", "ny", percent) & (F.col("my") | (F.col("x") < F.col("y")))
    ahead = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
    both = F.least("ox", "oy")
    block = lambda n: F.floor(F.log(n) * BLOCKS)
    most = F.floor((100 + percent) * F.col("o") / percent) - F.col("n")  # a partner's size that the overlap with the pivot allows
    least = F.ceil(F.col("n") * percent / 100)
    sized = lists.where((F.col("g") != F.col("main")) & (most >= least)).withColumn("block", F.explode(F.sequence(block(least), block(F.least(most, F.floor(F.col("n") * 100 / percent))))))
    near_pivot = (
        _side(sized, "x", ["token", "pv", "block"]).join(_side(lists.withColumn("block", block(F.col("n"))), "y", ["token", "pv", "block"]).hint("merge"), ["token", "pv", "block"])
        .where(differ & _enough(both, percent) & _enough(ahead, percent))
    )
    beside = F.least(F.col("nx") - F.col("ox") - F.col("posx"), F.col("ny") - F.col("oy") - F.col("posy"))
    off_pivot = (
        _side(apart_lists.where("g <> main"), "x", ["token", "pv"]).join(_side(apart_lists, "y", ["token", "pv"]).hint("merge"), ["token", "pv"])
        .where(differ & ~_enough(both, percent) & _enough(both + beside, percent))
    )
    seen = lists.groupBy("token", "pv").agg(F.max(F.col("g") != F.col("main")).alias("any"), F.min("n").alias("low"), F.max("n").alias("high"))
    two = (
        seen.where("any").select("token", F.col("pv").alias("pvx"), F.col("low").alias("lx"), F.col("high").alias("hx"))
        .join(seen.select("token", F.col("pv").alias("pvy"), F.col("low").alias("ly"), F.col("high").alias("hy")).hint("merge"), "token")
        .where((F.col("pvx") != F.col("pvy")) & (100 * F.col("hx") >= percent * F.col("ly")) & (100 * F.col("hy") >= percent * F.col("lx"))).select("token", "pvx", "pvy")
    )
    cross = (
        two.join(_side(lists.where("g <> main"), "x", ["token"]).hint("merge"), ["token", "pvx"]).join(_side(lists, "y", ["token"]).hint("merge"), ["token", "pvy"])
        .where(differ & _enough(ahead, percent))
    )
    found = [df.select("x", "y", "gx", "gy", "posy") for df in (near_pivot, off_pivot, cross)]
    rest = durable(found[0].unionByName(found[1]).unionByName(found[2]).groupBy("x", "y").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.min("posy").alias("py")))
    # one link joins a document to a group: the pair most likely to link first, and the others only if groups still differ
    best = rest.groupBy("x", "gy").agg(F.min(F.struct("py", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
    pair = lambda df: df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    early = durable(led.unionByName(_overlapping(durable(pair(best)), vertical, percent)))
    half = components(early)
    side = lambda c: half.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = rest.join(side("x"), "x", "left").join(side("y"), "y", "left").where(F.coalesce("cx", "x") != F.coalesce("cy", "y"))
    links = early.unionByName(_overlapping(durable(pair(apart)), vertical, percent))
    joined = components(links)
    placed_sets = (
        sets.select("doc", "n", "sum_a", "sum_b").join(alike, ["n", "sum_a", "sum_b"])
        .join(joined, F.col("rep") == F.col("node"), "left").select("doc", F.coalesce("component", "rep").alias("component"))
    )
    return counts.join(placed_sets, "doc", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", fragments: int | None = None) -> DataFrame:
    """Rows (id, n_shingles, component_id): the least id that each document reaches by links.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null and empty texts have no shingle and no link.
    Rows that repeat an id with the same text are one document with one result row; a null id counts as less than
    all others. Other columns are not read. An empty table gives no rows.
    """
    texts, key = keyed(docs, id_col, text_col)
    found = similar_groups(texts, k, percent, fragments)
    if key is None:
        return found.select(F.col("doc").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    head = key.select(F.col("doc").alias("component"), F.col("id").alias("component_id"))
    return found.join(key, "doc").join(head, "component").select(F.col("id").alias(id_col), "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document has the least id of its group, all columns kept; a row that repeats another stays once.

    Ids that are null or repeated are told apart by their texts' hashes, as in rowkeys.keyed().
    """
    texts, key = keyed(docs, id_col, text_col)
    found = similar_groups(texts, k, percent)
    stay = found.where("doc = component").select("doc")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ident = F.col(f"`{id_col}`").cast("long").alias("row_id")
    if key is None:
        return docs.select(row, ident).join(stay, F.col("row_id") == F.col("doc"), "left_semi").select("row.*")
    hashed = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    rows = docs.select(row, ident, hashed(F.col(f"`{text_col}`")).alias("row_hash")).dropDuplicates(["row_id", "row_hash"])
    ids = texts.select("doc", hashed(F.col("text")).alias("th")).join(stay, "doc", "left_semi").join(key, "doc")
    return rows.join(ids, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("th")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_components(docs, k=4, percent=85)
