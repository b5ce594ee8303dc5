"""Language-model scores by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import as_blob, mix, text_chunks, words
from .durable import durable, shuffle_partitions, small_batches
from .rowkeys import keyed

#: Bytes of text whose n-grams are counted together before they are dealt out, and bytes of text for each fragment that sums them.
BLOCK_BYTES = FRAGMENT_BYTES = 1 << 23
#: Bytes of text for each task of a shuffle, beyond what the session's number of partitions gives.
TASK_BYTES = 1 << 26
#: Folds of the ids: 0 is held out from everything, 1 is deleted from the counts while the weights are learned.
FOLDS, OUTSIDE, DELETED = 10, 0, 1
BUCKETS, ROUNDS = 48, 60
_END = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Interpolation:
    """What a score needs besides the counts: corpus totals and, for each bucket of context counts, the weights (bigram, unigram, uniform)."""

    tokens: int
    types: int
    weights: np.ndarray


def _sequence(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block's texts, each text closed by an end; hashes of the bigrams that end there; the first token of each text (and the end)."""
    parts, counts = [], []
    for _, _, data, offsets in text_chunks(text):
        hashes, _, first = words(data, offsets)
        parts.append(np.insert(hashes, first[1:], _END))
        counts.append(np.diff(first) + 1)
    token = np.concatenate(parts)
    edges = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    context = np.empty_like(token)
    context[1:] = token[:-1]  # of a text's first token: the end of the text before it
    context[0] = _END
    return token, mix(context * np.uint64(0x9FB21C651E98DF25) + token), edges


def _gaps(types: np.ndarray) -> bytes:
    """Hashes in order, whole, as compressed differences."""
    return _squeezed(np.diff(types, prepend=np.uint64(0)))


def _emit(fragments: int):
    """Counts a block's distinct tokens and bigrams, in the training folds and in the deleted one, and deals them to fragments by hash."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        token, bigram, edges = _sequence(table.column("text"))
        fold = np.repeat(table.column("fold").to_numpy(), np.diff(edges))
        kinds = []
        for h in (token, bigram):
            types, at = np.unique(h, return_inverse=True)
            kinds.append((types, *(np.bincount(at[m], minlength=len(types)).astype(np.uint32) for m in (fold != OUTSIDE, fold == DELETED)), ((types >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)))
        used = np.unique(np.concatenate([f for *_, f in kinds]))
        cuts = [np.append(np.searchsorted(f, used), len(f)) for *_, f in kinds]
        payloads = []
        for i in range(len(used)):
            counts, lows = [], []
            for (types, train, deleted, _), cut in zip(kinds, cuts, strict=True):
                s = slice(cut[i], cut[i + 1])
                counts.append(_squeezed(np.concatenate((train[s], deleted[s]))))
                lows.append(_gaps(types[s]))
            payloads.append(_joined([*counts, *lows]))
        return pa.table({"fragment": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), key[0].as_py(), np.int64)), "payload": pa.array(payloads, pa.binary())})

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fragment: sums the counts over all blocks and returns them to each block in its own order."""

    def summed(rows: list[tuple[int, bytes]], fragment: int) -> Iterator[pa.RecordBatch]:
        sent = [_parted(b) for _, b in rows]
        back: list[list[bytes]] = [[] for _ in rows]
        totals = (0, 0, 0)
        for kind in (0, 1):
            low = [np.cumsum(_loosened(p[2 + kind], np.uint64)) for p in sent]
            cut = np.concatenate(([0], np.cumsum([len(x) for x in low])))
            types, at = np.unique(np.concatenate(low), return_inverse=True)
            counts = [_loosened(p[kind], np.uint32).reshape(2, -1) for p in sent]
            sums = [np.bincount(at, weights=np.concatenate([c[k] for c in counts]), minlength=len(types)).astype(np.int64) for k in (0, 1)]
            for i in range(len(rows)):
                here = at[cut[i] : cut[i + 1]]
                back[i].append(_squeezed(np.concatenate([c[here] for c in sums])))
            if kind == 0:
                totals = (int(sums[0].sum()), int((sums[0] > 0).sum()), int(sums[1].sum()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in rows] + [-1], pa.int64()), pa.array([fragment] * (len(rows) + 1), pa.int32()),
                pa.array([*map(_joined, back), as_blob(np.array(totals, np.int64))], pa.binary()),
            ],
            names=["block", "fragment", "payload"],
        )

    last, rows = None, []
    for batch in batches:
        for f, block, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "block", "payload")), strict=True):
            if f != last and rows:
                yield from summed(rows, last)
                rows = []
            last = f
            rows.append((block, blob))
    if rows:
        yield from summed(rows, last)


def _squeezed(a: np.ndarray) -> bytes:
    """Columns of bytes, compressed: counts are mostly small."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _loosened(blob: bytes, kind: type) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(blob)
    raw = np.frombuffer(plain, np.uint8) if plain else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _joined(blobs: list[bytes]) -> bytes:
    """Blobs behind their number and lengths."""
    return as_blob(np.array([len(blobs), *map(len, blobs)], np.int64)) + b"".join(blobs)


def _parted(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    edges = 8 * (n + 1) + np.concatenate(([0], np.cumsum(np.frombuffer(blob, np.int64, n, 8)))).astype(np.int64)
    return [blob[a:b] for a, b in zip(edges, edges[1:])]


_FACTS = "doc binary, fold binary, edges binary, unigram binary, bigram binary, left_unigram binary, left_bigram binary, totals binary"


def _facts(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Each token of a block with the corpus counts of itself and of its bigram; in deleted texts also the counts without that fold."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    if key[0].as_py() < 0:
        totals = sum(np.frombuffer(b, np.int64) for b in counts.column("payload").to_pylist())
        return pa.table({c: pa.array([totals.tobytes() if c == "totals" else None], pa.binary()) for c in names})
    token, bigram, edges = _sequence(texts.column("text"))
    fold = texts.column("fold").to_numpy().astype(np.int8)
    blobs = [b for _, b in sorted(zip(counts.column("fragment").to_pylist(), counts.column("payload").to_pylist(), strict=True))]
    parts = [_parted(b) for b in blobs]
    deleted = np.repeat(fold == DELETED, np.diff(edges))
    full, left = [], []
    for kind, h in enumerate((token, bigram)):
        _, at = np.unique(h, return_inverse=True)
        all_c, del_c = np.concatenate([_loosened(p[kind], np.int64).reshape(2, -1) for p in parts], axis=1)
        full.append(_squeezed(all_c[at]))
        left.append(_squeezed((all_c - del_c)[at[deleted]]))
    row = [_squeezed(texts.column("doc").to_numpy()), _squeezed(fold), _squeezed(edges), *full, *left, None]
    return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(names, row, strict=True)})


def _contexts(unigram: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts of the tokens before; a text's first token stands after an end, which occurs as often as there are texts."""
    before = np.empty_like(unigram)
    before[1:] = unigram[:-1]
    before[edges[:-1]] = unigram[edges[1:] - 1]
    return before


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the binary logarithm of its count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _held_out(tokens: int):
    """Counts of the deleted fold's tokens by bucket and by both estimates, in steps of half a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fold, edges = _loosened(row["fold"], np.int8), _loosened(row["edges"], np.int64)
                sizes = np.diff(edges)[fold == DELETED]
                if not len(sizes):
                    continue
                c, both = _loosened(row["left_unigram"], np.int64), _loosened(row["left_bigram"], np.int64)
                context = _contexts(c, np.concatenate(([0], np.cumsum(sizes))))
                steps = lambda part, whole: np.where(part > 0, 1 + np.rint(-2 * np.log2(np.maximum(part, 1) / np.maximum(whole, 1))), 0).astype(np.int64)
                cell = (_bucket(context).astype(np.int64) << 32) | (steps(both, context) << 16) | steps(c, tokens)
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each bucket, by expectation-maximisation on held-out counts.

    A bucket's weights start from, and are steadied by, ten tokens of all buckets together. A context that was
    never seen has no bigram estimate and gives that weight to the others.
    """
    bucket = cells >> 32
    p = np.stack([np.where(q > 0, 2.0 ** (-(q - 1) / 2), 0.0) for q in ((cells >> 16) & 0xFFFF, cells & 0xFFFF)] + [np.full(len(cells), 1 / (types + 1))])

    def fitted(p: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = prior / prior.sum()
        for _ in range(rounds):
            share = w[:, None] * p
            expected = (share / share.sum(0) * n).sum(1) + prior
            w = expected / expected.sum()
        return w

    overall = fitted(p, counts, np.ones(3))
    out = np.tile(overall, (BUCKETS, 1))
    for b in np.unique(bucket):
        on = bucket == b
        out[b] = fitted(p[:, on], counts[on], 10 * overall)
    out[0, 0] = 0
    return out / out.sum(1, keepdims=True)


def _scored(model: Interpolation):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edges = _loosened(row["edges"], np.int64)
                c, both = _loosened(row["unigram"], np.int64), _loosened(row["bigram"], np.int64)
                context = _contexts(c, edges)
                w = model.weights[_bucket(context)]
                p = w[:, 0] * (both / np.maximum(context, 1)) + w[:, 1] * (c / max(model.tokens, 1)) + w[:, 2] / (model.types + 1)
                base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                cut = edges[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_loosened(row["doc"], np.int64)), pa.array(np.diff(edges)), pa.array(np.add.reduceat((c > 0).astype(np.int64), cut)),
                        pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(np.log10(p), cut)),
                    ],
                    names=["doc", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fragments: int | None = None) -> tuple[DataFrame, Interpolation]:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the model.

    The model mixes the maximum-likelihood estimates of bigrams and unigrams with a uniform share, by weights that
    depend on how often the context was seen. Counts come from all texts whose id's crc32 modulo 10 is not 0.
    The weights are learned by deletion: the texts of remainder 1 are taken out of the counts, and
    expectation-maximisation over all their tokens finds the weights that predict them best from the rest.

    Texts are dealt to blocks of block_bytes by a hash of the id. A block sends each distinct n-gram once, as a
    hash of 64 bits, to the fragment that sums it (pre-aggregated, so a frequent word is one entry a block), and gets
    the sums back. The numbers of blocks and fragments follow the bytes of text, and no result depends on them or on
    the number of partitions. Nothing of the corpus goes to the driver but the totals and the held-out counts in cells of half
    a bit, whose number has a fixed bound.

    Null texts are empty: one token, the end. Rows that repeat an id with the same text are one document; null
    ids count as an empty text in the crc32. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, key = keyed(docs, id_col, text_col)
    if key is not None:
        texts = texts.join(key, "doc")
    name = F.coalesce((F.col("doc") if key is None else F.col("id")).cast("string"), F.lit(""))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, fragments = max(1, -(-size // block_bytes)), fragments or max(1, -(-size // FRAGMENT_BYTES))
    parts = max(shuffle_partitions(spark), -(-size // TASK_BYTES))
    base = texts.select("doc", F.pmod(F.crc32(name.cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"), "text", F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")).repartition(parts, "block")
    sent = base.groupBy("block").applyInArrow(_emit(fragments), "fragment int, block long, payload binary")
    counted = sent.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(_count, "block long, fragment int, payload binary")
    facts = durable(base.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_facts, _FACTS))
    totals = facts.where("totals IS NOT NULL").select("totals").first()
    tokens, types, deleted = (int(x) for x in np.frombuffer(totals[0], np.int64)) if totals else (0, 0, 0)
    tokens_facts = facts.where("totals IS NULL")
    cells = tokens_facts.select("fold", "edges", "left_unigram", "left_bigram").mapInArrow(_held_out(tokens - deleted), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells.sort(key=lambda r: r.cell)
    weights = learn_weights(np.array([r.cell for r in cells], np.int64), np.array([r.n for r in cells], np.float64), types)
    model = Interpolation(tokens, types, weights)
    scored = tokens_facts.select("doc", "edges", "unigram", "bigram").mapInArrow(_scored(model), "doc long, n_tokens long, n_known long, base_score double, score double")
    if key is not None:
        scored = scored.join(key, "doc")
    ident = (F.col("doc") if key is None else F.col("id")).alias(id_col)
    fold = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return scored.select(ident, (fold == OUTSIDE).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs)[0]
