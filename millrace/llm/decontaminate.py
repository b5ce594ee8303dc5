"""Benchmark decontamination by spaced-seed hashing (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Token offsets that a mask looks at; the others may differ. Each period of substitution leaves one mask whole.
MASKS = ((0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 4, 6), (0, 1, 2, 6), (0, 3, 5, 6))
#: Tokens that any mask needs; a wider one that runs over the end looks at what is there.
SPAN = 5
#: Items below MIN_TOKENS count only as a whole, and from so many tokens on.
MIN_ITEM = 6
#: A document holds an item if at least this share of the item's tokens, and so many tokens, agree on its diagonals.
MIN_SHARE, MIN_TOKENS = 0.5, 10
#: It also holds a passage of an item, however long the item, where a stretch of one diagonal has so many more agreeing than other tokens.
MIN_STRETCH = 20
#: Diagonals so far from another one add the item tokens that only they hold, for inserted or left out words.
BAND = 16
#: Seeds that one pass broadcasts at most; a larger benchmark is searched in several passes. Longer items are divided.
MAX_SEEDS, ITEM_PART = 1_000_000, 50_000


def _tokens(text: Column) -> Column:
    """64-bit hashes of the words, A-Z lower-cased; empty or null text gives an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(F.regexp_replace(plain, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(tokens: str, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For each mask and each position where it fits, the hash of the tokens it looks at; mask after mask."""
    starts = F.sequence(F.lit(0), F.size(tokens) - SPAN)

    def under(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(tokens), i + F.lit(o)) for o in mask]))

    return F.when(F.size(tokens) >= SPAN, F.concat(*[under(k, m) for k, m in enumerate(masks)]))


def _located(df: DataFrame, keep: list[str], tokens: str, at: str) -> DataFrame:
    """One row for each seed with the position of its first token.

    The outer form keeps the optimizer from pushing a filter on the generator, with the tokenizer inlined for
    every element, below the projection; its null rows match no seed.
    """
    n = F.size(tokens) - F.lit(SPAN - 1)
    return df.select(*keep, tokens, F.posexplode_outer("seeds").alias("k", "seed")).select(*keep, tokens, "seed", F.pmod(F.col("k"), n).alias(at), F.floor(F.col("k") / n).cast("int").alias("mask"))


def _again(masks: tuple[tuple[int, ...], ...]) -> Column:
    """Whether the hit one token earlier on the diagonal, under the same mask, is a hit too: the first of a run stands for all."""
    same = lambda o: F.get("doc", F.col("pos") + (o - 1)).eqNullSafe(F.get("item", F.col("item_pos") + (o - 1)))
    runs = [(F.col("mask") == k) & reduce(Column.__and__, [same(o) for o in m]) for k, m in enumerate(masks)]
    return (F.col("pos") > 0) & (F.col("item_pos") > 0) & reduce(Column.__or__, runs)


def _stretch(agree: Column) -> Column:
    """The most that agreeing tokens outnumber the others in any stretch, from the sorted positions that agree."""
    start = F.struct(F.lit(0).alias("now"), F.lit(-1).alias("last"), F.lit(0).alias("best"))

    def step(s: Column, k: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] - (k - s["last"] - 1)) + 1
        return F.struct(now.alias("now"), k.alias("last"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(agree, start, step, lambda s: s["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS, min_stretch: int = MIN_STRETCH, band: int = BAND, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """Rows (id, text_hash, item_id, doc_pos, item_tokens, matched, share) for each document that holds a benchmark item or a long passage of one.

    Every position of every document and item is hashed under every mask. A hit fixes a diagonal (document
    position less item position); there all tokens of the item are compared, so substituted words cost only
    themselves. matched counts the distinct item tokens that agree on a diagonal or on those at most band beside it,
    which also bears inserted words; the diagonal with the most stands for the pair, so a phrase that stands twice
    counts once and phrases far apart do not add up. doc_pos is the token where the item would begin on that
    diagonal, below 0 if its start is cut off.

    A pair counts with min_share of the item's tokens, or with a stretch of one diagonal whose agreeing tokens
    outnumber the others by min_stretch: 20 words copied verbatim, 40 with every fourth one substituted.

    Documents are not shuffled: the item seeds are counted and broadcast in blocks of at most max_seeds, one
    pass each, and beside them each of the block's items once, so what is broadcast is in proportion to the tokens.
    Of a run of hits on a diagonal the first is verified. Only verified diagonals are shuffled, after a partial
    aggregation.
    Items of fewer than min_tokens tokens count where all tokens agree on one diagonal; those of fewer than
    MIN_ITEM, and null and empty texts, never match. Repeated rows
    and repeated items give one row for each distinct (id, text, item_id); a null id is an id like others, and a null
    item_id too. An empty side gives no rows.
    """
    items = benchmark.select("item_id", _tokens(F.col("text")).alias("item")).where(F.size("item") >= MIN_ITEM).withColumn("item_key", F.xxhash64(F.lit(1), "item_id", "item"))
    keyed = items.select("item_key", "item_id", "item").distinct()
    sown = _located(keyed.withColumn("seeds", _seeds("item", MASKS)), ["item_key"], "item", "item_pos").select("item_key", "seed", "item_pos", "mask").where("seed IS NOT NULL").distinct()
    n = sown.count()
    blocks = max(1, -(-n // max_seeds))
    dealt = lambda part: F.pmod(F.xxhash64("item_key", part.cast("long")), F.lit(blocks))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), _tokens(F.col(f"`{text_col}`")).alias("doc"))
    spread = _located(base.withColumn("seeds", _seeds("doc", MASKS)), ["id", "text_hash"], "doc", "pos").withColumnRenamed("mask", "doc_mask")

    def one_pass(b: int) -> DataFrame:
        part = sown.where(dealt(F.floor(F.col("item_pos") / ITEM_PART)) == b)
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("item") / ITEM_PART).cast("int")), lambda k: F.pmod(F.xxhash64("item_key", k.cast("long")), F.lit(blocks)))
        texts = keyed.where(F.array_contains(parts, F.lit(b).cast("long")))
        hits = spread.join(F.broadcast(part), "seed").join(F.broadcast(texts), "item_key").where(~_again(MASKS))
        size = F.size("item")
        same = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get("doc", F.col("pos") - F.col("item_pos") + k) == F.get("item", k))
        return hits.select("id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("doc_pos"), size.alias("item_tokens"), same.alias("agree"))

    diagonals = reduce(DataFrame.unionByName, [one_pass(b) for b in range(blocks)]).distinct().withColumn("stretch", _stretch(F.col("agree")))
    beside = Window.partitionBy("id", "text_hash", "item_id").orderBy("doc_pos").rangeBetween(-band, band)
    centres = diagonals.withColumn("matched", F.size(F.array_distinct(F.flatten(F.collect_list("agree").over(beside)))))
    best = F.max(F.struct("matched", F.size("agree").alias("own"), (-F.col("doc_pos")).alias("later")))
    return (
        centres.groupBy("id", "text_hash", "item_id")
        .agg(F.max(F.size("agree")).alias("own"), (-best["later"]).alias("doc_pos"), best["matched"].cast("long").alias("matched"), F.max("item_tokens").alias("item_tokens"), F.max("stretch").alias("stretch"))
        .withColumn("share", F.col("matched") / F.col("item_tokens"))
        .where(((F.col("item_tokens") < min_tokens) & (F.col("own") == F.col("item_tokens"))) | ((F.col("share") >= min_share) & (F.col("matched") >= min_tokens)) | (F.col("stretch") >= min_stretch))
        .select(F.col("id").alias(id_col), "text_hash", "item_id", F.col("doc_pos").cast("long").alias("doc_pos"), F.col("item_tokens").cast("long").alias("item_tokens"), "matched", "share")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns kept."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
