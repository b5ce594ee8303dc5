import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries

from test_llm import brute_components, words

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert "pipeline" in queries.QUERIES and {int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")} == set(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_on_awkward_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("cast(null AS bigint) AS doc_id", "cast(null AS string) AS text", "cast(null AS string) AS lang", "source", "n_chars")
    now = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("row", docs.lang)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        now = spark.read.parquet(path)
        assert 0 < now.count() <= docs.count() + 4
    assert now.columns == ["doc_id", "n_ids", "ids", "decoded_sha256"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage after the classifier on what the one before kept, with the pipeline's own parameters."""
    import public_tokenizers
    import sentencepiece

    rng = random.Random(31)
    base = [words(rng, rng.randrange(30, 150), 3000) for _ in range(40)]
    items = [(k, words(rng, 40, 9000)) for k in range(6)]
    texts = base + base[:9] + [base[3]] * 5
    for t in base[10:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 20)} {t} {words(rng, 20)}" for _, t in items[:4]] + [" ".join(items[4][1].split()[:15]) + " " + words(rng, 40), "", "short", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    last = {t or "": i for i, t in rows}
    kept = [(i, t) for i, t in rows if last[t or ""] == i]
    now = stages["exact dedup"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in now.collect()) == kept

    groups = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    now = stages["n-gram Jaccard join"](spark, now, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in now.collect()) == kept and len(kept) < len(last)

    def holds(t, item):
        a, b = (t or "").lower().split(), item.lower().split()
        return any(sum(0 <= d + k < len(a) and a[d + k] == x for k, x in enumerate(b)) >= max(10, len(b) / 2) for d in range(-len(b), len(a)))

    kept = [(i, t) for i, t in kept if not any(holds(t, item) for _, item in items)]
    now = stages["benchmark decontamination"](spark, now, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in now.collect()) == kept
    assert {i for i, t in rows if t and any(item in t for _, item in items)}.isdisjoint({i for i, _ in kept})

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in stages["SentencePiece encoding and decoding"](spark, now.withColumn("ids", F.lit("x")), str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in kept}
    for i, t in kept:
        assert list(got[i].ids) == sp.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
