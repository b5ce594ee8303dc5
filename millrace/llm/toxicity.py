"""Toxicity scores by a convolutional text classifier on hashed word embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import mix, prefix_hashes, span_hashes, text_chunks, words
from .durable import durable, small_batches
from .rowkeys import keyed

#: Labelled texts of each class that the fit starts from at most, those with the least hash of the id; then it learns from all.
SAMPLE_PER_CLASS = 4000
#: Rows of the embedding table, its width, filters of each width of the convolution, and the widths.
TABLE, DIMENSIONS, FILTERS, WIDTHS = 1 << 15, 12, 6, (1, 2, 3)
#: Word starts and ends (in bytes) that are hashed besides the whole word.
AFFIXES = (4, 5, 6)
EPOCHS, STEPS, RATE, BATCH_BYTES = 10, 400, 0.02, 1 << 18
SHARE_FOR_THRESHOLDS = 5  # every fifth text sets thresholds and is not trained on
#: Passes over all learning texts, bytes of text a task of them (its state takes about 6 MB), task states that one task adds up, and steps of a logit that thresholds tell apart.
ROUNDS, PASS_BYTES, FAN_IN, LOGIT_STEPS = 2, 16 << 20, 16, 1000


@dataclass
class Classifier:
    """Weights of the network, the language guesser, and each language's threshold as a logit."""

    table: np.ndarray
    kernels: np.ndarray  # (position among all widths' positions, dimension, filter)
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    languages: list[str] = field(default_factory=list)
    profile: np.ndarray | None = None  # (letter pair bucket, language)
    thresholds: np.ndarray | None = None
    memory: dict[str, np.ndarray] | None = None  # Adagrad's sums, while it learns


_PLACES = [(w, p) for w in WIDTHS for p in range(w)]


def _lowered(data: np.ndarray) -> np.ndarray:
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    return low


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk as table rows (word, starts, ends), each word's number, and the first word of each text (and the end); also the first bytes' buckets for the language.

    Words are runs of letters, digits and bytes above 127, so punctuation does not stick to them.
    """
    low = _lowered(data)
    part = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    plain = np.where(part, low, 32).astype(np.uint8)
    hashes, _, first = words(plain, offsets)
    inside = np.concatenate(([False], part, [False]))
    begins = inside[1:] & ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts[inside[cuts] & inside[cuts + 1]]] = True
    starts = np.flatnonzero(begins)
    stops = inside[:-1] & ~inside[1:]
    stops[cuts[inside[cuts] & inside[cuts + 1]]] = True
    ends = np.flatnonzero(stops)
    types, where, number = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[where], ends[where]
    prefix = prefix_hashes(plain)
    rows = [types]
    for n in AFFIXES:
        rows.append(mix(span_hashes(prefix, s, np.minimum(s + n, e)) + np.uint64(n)))
        rows.append(mix(span_hashes(prefix, np.maximum(e - n, s), e) + np.uint64(100 + n)))
    return (np.stack(rows, 1) % np.uint64(TABLE)).astype(np.int64), number, first, types


def _pooled(model: Classifier, rows: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text and filter the largest response, and the word where it begins; a text without words responds with the bias."""
    embedded = model.table[rows].mean(1)
    texts = len(first) - 1
    padded = max(len(number), 1)
    value = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
    where = np.full((texts, len(WIDTHS) * FILTERS), -1)
    filled = np.flatnonzero(np.diff(first) > 0)
    if not len(filled):
        return embedded, value, where
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's text
    at = np.arange(padded)
    for k, width in enumerate(WIDTHS):
        response = np.zeros((len(number), FILTERS), np.float32)
        for p in range(width):
            projected = embedded @ model.kernels[_PLACES.index((width, p))]
            shifted = projected[number[np.minimum(at + p, padded - 1)]]
            if p:
                shifted[at + p >= last] = 0
            response += shifted
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        best = np.maximum.reduceat(response, first[filled], axis=0)
        value[filled, cols] = best
        hit = response == np.repeat(best, np.diff(first)[filled], axis=0)
        order = np.where(hit, at[:, None], padded)
        where[filled, cols] = np.minimum.reduceat(order, first[filled], axis=0)
    return embedded, value, where


def _logits(model: Classifier, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    active = np.maximum(value + model.bias, 0)
    return active @ model.out + model.offset, active


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed letter pairs of each text, for the language."""
    low = _lowered(data).astype(np.int64)
    pair = ((low[:-1] * 263 + low[1:]) * 2654435761 >> 8) % 1024 if len(low) > 1 else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = row[:-1] == row[1:]  # no pair across two texts
    return np.bincount(row[:-1][inner] * 1024 + pair[inner], minlength=(len(offsets) - 1) * 1024).reshape(-1, 1024)


def guess_language(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The language whose letter pairs fit each text best, from the text alone."""
    return (_letters(data, offsets) @ model.profile).argmax(1) if len(model.languages) else np.zeros(len(offsets) - 1, np.int64)


LEARNT = ("table", "kernels", "bias", "out")


def _step(model: Classifier, rows: np.ndarray, number: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, use: np.ndarray) -> None:
    """One step of Adagrad on the texts of a chunk that use names.

    The gradient of max pooling reaches only the words where each filter responded most.
    """
    embedded, value, where = _pooled(model, rows, number, first)
    logit, active = _logits(model, value)
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight * use / max(use.sum(), 1)
    d_active = np.outer(error, model.out) * (active > 0)
    grads = {"out": active.T @ error, "bias": d_active.sum(0), "kernels": np.zeros_like(model.kernels)}
    d_embedded = np.zeros_like(embedded)
    last = first[1:]
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            j = k * FILTERS + f
            live = np.flatnonzero((d_active[:, j] != 0) & (where[:, j] >= 0))
            for p in range(width):
                at = where[live, j] + p
                ok = at < last[live]
                word, d, place = number[at[ok]], d_active[live[ok], j], _PLACES.index((width, p))
                grads["kernels"][place, :, f] += d @ embedded[word]
                np.add.at(d_embedded, word, np.outer(d, model.kernels[place, :, f]))
    touched = np.flatnonzero(d_embedded.any(1))
    d_table = np.zeros_like(model.table)
    np.add.at(d_table, rows[touched], (d_embedded[touched] / rows.shape[1])[:, None, :])
    grads["table"] = d_table
    for name, g in grads.items():
        model.memory[name] += g * g
        getattr(model, name)[...] -= (RATE * g / np.sqrt(model.memory[name])).astype(np.float32)
    model.memory["offset"] += float(error.sum()) ** 2
    model.offset -= RATE * float(error.sum()) / np.sqrt(model.memory["offset"])


def train(texts: pa.Array, labels: np.ndarray, langs: np.ndarray, clean_to_toxic: float, seed: int = 0) -> Classifier:
    """Fits the network by stochastic gradients (Adagrad), then the thresholds on texts it has not seen.

    A clean text stands for clean_to_toxic times as many labelled texts as a toxic one; the thresholds count them so.

    Texts stay in Arrow buffers and their words in narrow integers, so a fit takes a few times the sample's bytes.
    """
    rng = np.random.default_rng(seed)
    wide = len(WIDTHS) * FILTERS
    model = Classifier(
        rng.normal(0, 0.3, (TABLE, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.5, (len(_PLACES), DIMENSIONS, FILTERS)).astype(np.float32),
        np.zeros(wide, np.float32), np.abs(rng.normal(0, 0.5, wide)).astype(np.float32),
    )
    model.memory = {k: np.full_like(getattr(model, k), 1e-6) for k in LEARNT} | {"offset": np.float64(1e-6)}
    chunks = []
    for lo, hi, data, offsets in text_chunks(texts, BATCH_BYTES):
        rows, number, first, _ = features(data, offsets)
        chunks.append((lo, hi, rows.astype(np.uint16), number.astype(np.int32), first.astype(np.int32)))
    held = np.arange(len(texts)) % SHARE_FOR_THRESHOLDS == 0
    if len(set(labels[~held])) == 2:
        share = labels[~held].mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _ in range(min(10 * EPOCHS, max(EPOCHS, STEPS // len(chunks)))):
            for c in rng.permutation(len(chunks)):
                lo, hi, *words_of = chunks[c]
                _step(model, *words_of, labels[lo:hi], weight[lo:hi], ~held[lo:hi])
    model.languages = sorted(set(langs.tolist()))
    counts = np.ones((1024, len(model.languages)))
    guessed, logits = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi, data, offsets in text_chunks(texts, BATCH_BYTES):
        letters = _letters(data, offsets)
        for k, lang in enumerate(model.languages):
            counts[:, k] += letters[langs[lo:hi] == lang].sum(0)
    model.profile = np.log(counts / counts.sum(0))
    for (lo, hi, data, offsets), chunk in zip(text_chunks(texts, BATCH_BYTES), chunks, strict=True):
        guessed[lo:hi] = guess_language(model, data, offsets)
        logits[lo:hi] = _logits(model, _pooled(model, *chunk[2:])[1])[0]
    model.thresholds = np.array([_threshold(logits[held & (guessed == k)], labels[held & (guessed == k)], clean_to_toxic) for k in range(len(model.languages))])
    return model


def _threshold(logits: np.ndarray, labels: np.ndarray, clean_to_toxic: float, times: np.ndarray | int = 1) -> float:
    """The logit with the fewest errors, a clean text counting clean_to_toxic times; midway between the texts beside it. A row stands for so many texts as times says."""
    if len(set(labels)) < 2:
        return 0.0
    order = np.argsort(logits)
    x, y, n = logits[order], labels[order], np.broadcast_to(times, labels.shape)[order]
    cost = np.concatenate(([0], np.cumsum(y * n))) + clean_to_toxic * np.concatenate((np.cumsum(((1 - y) * n)[::-1])[::-1], [0]))
    best = np.flatnonzero(cost == cost.min())
    k = int(best[len(best) // 2])
    return float(x[0] - 0.5 if k == 0 else x[-1] + 0.5 if k == len(x) else (x[k - 1] + x[k]) / 2)


def _state(model: Classifier) -> np.ndarray:
    """All that a pass over texts changes, in a row."""
    return np.concatenate([*[np.ravel(getattr(model, k)) for k in LEARNT], *[np.ravel(model.memory[k]) for k in LEARNT], [model.offset, model.memory["offset"]]]).astype(np.float64)


def _with_state(model: Classifier, state: np.ndarray) -> Classifier:
    model, at = deepcopy(model), 0
    for hold in (lambda k, v: setattr(model, k, v), model.memory.__setitem__):
        for k in LEARNT:
            like = getattr(model, k)
            hold(k, state[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
    model.offset, model.memory["offset"] = float(state[at]), np.float64(state[at + 1])
    return model


def _pass(model: Classifier, share: float):
    """Steps on all texts of a task; then what it learned, times its texts, and the letter pairs of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, letters = deepcopy(model), 0, {}
        for batch in batches:
            toxic, held, langs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_toxic", "_held", "_lang"))
            for lo, hi, data, offsets in text_chunks(batch.column("_text"), BATCH_BYTES):
                rows, number, first, _ = features(data, offsets)
                labels, use = toxic[lo:hi].astype(np.int64), ~held[lo:hi].astype(bool)
                if use.any():
                    _step(own, rows, number, first, labels, np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32), use)
                    texts += int(use.sum())
                pairs = _letters(data, offsets)
                for lang in set(langs[lo:hi]):
                    letters[lang] = letters.get(lang, 0) + pairs[langs[lo:hi] == lang].sum(0)
        part = TaskContext.get().partitionId()
        found = [(part, None, texts, (_state(own) * texts).tobytes())] * bool(texts) + [(part, k, 0, v.astype(np.float64).tobytes()) for k, v in letters.items()]
        yield from (pa.RecordBatch.from_pylist([dict(zip(("part", "lang", "texts", "sums"), r))], schema=_SUMS) for r in found)

    return run


_SUMS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("texts", pa.int64()), ("sums", pa.binary())])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows for each language, and of the states (no language)."""
    sums: dict[str | None, tuple[int, int, np.ndarray]] = {}
    for batch in batches:
        for part, lang, texts, data in zip(*(c.to_pylist() for c in batch.columns)):
            first, n, total = sums.get(lang, (part, 0, 0.0))
            sums[lang] = first, n + texts, total + np.frombuffer(data)
    yield from (pa.RecordBatch.from_pylist([{"part": p, "lang": k, "texts": n, "sums": v.tobytes()}], schema=_SUMS) for k, (p, n, v) in sums.items())


def _held_logits(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("_text"), BATCH_BYTES):
                logit = _logits(model, _pooled(model, *features(data, offsets)[:3])[1])[0]
                columns = guess_language(model, data, offsets), np.rint(np.clip(logit, -500, 500) * LOGIT_STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("_toxic").slice(lo, hi - lo).cast(pa.int64())], names=["k", "logit", "toxic"])

    return run


def learn_all(model: Classifier, learning: DataFrame, share: float, seen: DataFrame) -> Classifier:
    """The model after ROUNDS passes over all of learning(_id, _text, _lang, _toxic), with the languages and thresholds of all of it.

    In a pass each task steps through its texts from the common model; the means of what the tasks learned, weighed by their
    texts, are the next model. Tasks follow the bytes of text and not the session's partitions, as each writes a state of one size.
    The states are added FAN_IN at a time in tasks, so the driver gets a sixteenth of them.
    Every fifth text trains nothing and sets the thresholds; seen(_id, _held) says which of the texts used before those are.
    """
    spark = learning.sparkSession
    small_batches(spark)
    fifth = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(SHARE_FOR_THRESHOLDS)) == 0
    texts = durable(learning.join(F.broadcast(seen), "_id", "left").select("_id", "_text", "_lang", "_toxic", F.coalesce("_held", fifth).alias("_held"), F.octet_length("_text").alias("_bytes")).sortWithinPartitions(F.xxhash64("_id"), "_id")).drop("_id")
    tasks = max(1, -(-(texts.agg(F.sum("_bytes")).first()[0] or 0) // PASS_BYTES))
    kind = "part int, lang string, texts long, sums binary"
    for _ in range(ROUNDS):
        told = durable(texts.coalesce(tasks).mapInArrow(_pass(model, share), kind))
        groups = -(-told.where("lang IS NULL").count() // FAN_IN)
        added = told.repartition(max(1, groups), F.expr(f"part div {FAN_IN}")).sortWithinPartitions("part", "lang").mapInArrow(_added, kind).toArrow().sort_by("part")
        sums = {r["lang"]: r for r in (b.to_pylist()[0] for b in pa.Table.from_batches(_added(iter(added.to_batches()))).to_batches())}
        if None in sums:
            model = _with_state(model, np.frombuffer(sums[None]["sums"]) / sums[None]["texts"])
    model.memory = None
    model.languages = sorted(k for k in sums if k is not None)
    counts = np.stack([np.frombuffer(sums[k]["sums"]) for k in model.languages], 1) + 1
    model.profile = np.log(counts / counts.sum(0))
    bins = texts.where("_held").mapInArrow(_held_logits(model), "k long, logit long, toxic long").groupBy("k", "logit", "toxic").agg(F.count(F.lit(1)).alias("n")).toArrow()
    k, logit, toxic, n = (bins.column(c).to_numpy() for c in ("k", "logit", "toxic", "n"))
    order = np.lexsort((toxic, logit, k))
    k, logit, toxic, n = k[order], logit[order] / LOGIT_STEPS, toxic[order], n[order]
    model.thresholds = np.array([_threshold(logit[k == i], toxic[k == i], 1.0, n[k == i]) for i in range(len(model.languages))])
    return model


def _scores(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), 1 << 19):
                rows, number, first, _ = features(data, offsets)
                logit = _logits(model, _pooled(model, rows, number, first)[1])[0] - model.thresholds[guess_language(model, data, offsets)] if model.languages else np.full(hi - lo, -1.0)
                score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), pa.array(score.astype(np.float64))], names=["doc", "score"])

    return run


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Classifier:
    """Learns from all labelled texts whose id's crc32 modulo 5 is not 0: first on the driver from at most per_class of each class, then, if there are more, from all in tasks.

    An id that several texts share gives one of them. For the thresholds of the first part a text counts for as many learning labels of its class as there are for each of its texts.
    """
    ids = labels.where(F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max("toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in ids.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = (max(1.0, counts.get(c, 0) / per_class) for c in (0, 1))
    pick = lambda c: ids.where(F.col("_toxic") == c).orderBy(F.xxhash64("_label_id"), "_label_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.coalesce(lang, F.lit("")).alias("_lang"))
    texts_of = lambda wanted: named.join(wanted, F.col("_id") == F.col("_label_id")).groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_lang", "_toxic")).alias("r")).select("_id", "r._text", "r._lang", "r._toxic")
    rows = texts_of(F.broadcast(chosen)).toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    rows = rows.take(np.random.default_rng(1).permutation(rows.num_rows)).combine_chunks()
    texts = rows.column("_text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    model = train(texts, rows.column("_toxic").to_numpy().astype(np.int64), rows.column("_lang").to_numpy(), clean / toxic)
    held = np.arange(rows.num_rows) % SHARE_FOR_THRESHOLDS == 0
    seen = pa.table({"_id": rows.column("_id"), "_held": pa.array(held)})
    whole = max(clean, toxic) == 1.0 or len(set(rows.column("_toxic").to_pylist())) < 2
    del rows, texts
    pa.default_memory_pool().release_unused()
    if model is None or whole:
        if model is not None:
            model.memory = None
        return model
    share = counts[1] / (counts[0] + counts[1])
    return learn_all(model, texts_of(ids.where(F.col("_toxic").isin(0, 1)).hint("merge")), share, docs.sparkSession.createDataFrame(seen))


def score_toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted) from the whole texts alone; predicted is 1 if score >= 0.5.

    A score is the sigmoid of the network's logit less the threshold of the language that the text looks like.
    Null and empty texts have no words and get the score of the biases. Rows that repeat an id with the same
    text are one document with one result row. An empty table gives no rows. Without labels of both classes
    the network stays untrained and its scores mean nothing. The model has a fixed size and travels with the tasks.
    """
    small_batches(docs.sparkSession)
    texts, key = keyed(docs, id_col, text_col)
    scored = texts.select("doc", "text").mapInArrow(_scores(model), "doc long, score double")
    if key is not None:
        scored = scored.join(key, "doc").drop("doc").withColumnRenamed("id", "doc")
    return scored.select(F.col("doc").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not call toxic, all columns kept, in one pass without a shuffle."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            scored = _scores(model)(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc", "text"])]))
            yield pa.concat_arrays([pa.array([], pa.float64()), *(x.column("score") for x in scored)])

    return docs.where(score(F.col(f"`{text_col}`")) < 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
