"""The pipeline's stages, each on its own input, and all of them."""

from collections import Counter, defaultdict

import corpus_pipeline
from helixframe.llm import mixing, quality_rules

from . import brute


def test_stages(spark, some):
    docs = spark.read.parquet(f"{some}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    kept = stage["quality rules"](spark, docs, some)
    want = {r["doc_id"] for r in quality_rules.op10_quality_rules(spark, some).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    kept = kept.cache()
    one = stage["near-duplicates"](spark, kept, some).cache()
    classes = brute.near_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(classes.values())) and one.columns == docs.columns

    clean = stage["personal data"](spark, one, some).cache()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        assert sum(brute.pii(r["text"])[0]) == 0 and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or sum(brute.pii(before[r["doc_id"]])[0])

    mixed = stage["mixing"](spark, clean, some).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert sum(copies.values()) == mixed.count() and mixed.columns == docs.columns
    sizes, got = defaultdict(int), defaultdict(int)
    for r in clean.collect():
        sizes[r["source"]] += len(brute.WORD.findall(r["text"]))
    for r in mixed.collect():
        got[r["source"]] += len(brute.WORD.findall(r["text"]))
    for s, t in brute.targets(sizes).items():
        assert abs(got[s] - t) <= 0.02 * t

    packed = stage["packing"](spark, mixed, some).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_run(spark, some):
    got = corpus_pipeline.run(spark, some).collect()
    assert got and {r["offset"] for r in got} >= {0}


def test_odd_and_empty(spark, odd, bare):
    assert corpus_pipeline.run(spark, bare).collect() == []
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        out.collect()
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, odd).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    repeated = mixing.repeat_documents(docs)
    assert repeated.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
