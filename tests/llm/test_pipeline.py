from collections import Counter

import corpus_pipeline as C
from tessera.llm import minhash_join, quality


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "pack_sequences"]
    kept = C.quality_rules(spark, docs, data)
    good = {r["doc_id"] for r in quality.op5_adaptive_quality(spark, data).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and not any(labels.get(d) == 0 for d in good)
    single = C.near_duplicates(spark, kept, data)
    classes = {r["doc_id"]: r["class_id"] for r in minhash_join.near_duplicates(kept).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values()))
    clean = {r["doc_id"]: r for r in C.personal_data(spark, single, data).collect()}
    assert len(clean) == len(set(classes.values())) and all("@mail" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean.values())
    mixed = Counter(r["doc_id"] for r in C.mix_sources(spark, single, data).collect())
    assert max(mixed.values()) == 2 and set(mixed) <= set(clean)
    pieces = C.run(spark, data).collect()
    starts = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert max(starts.values()) <= 2 and set(starts) <= set(clean)
