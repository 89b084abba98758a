"""The pipeline's stages on a small table, each against brute force on its own input."""

import corpus_pipeline as P

from .test_duplicates import benchmark_words, brute_components, brute_contamination, norm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [k for k, _ in P.STAGES] == ["quality_classifier", "exact_duplicates", "near_duplicates", "decontamination", "mixing"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = P.stored(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and all(after[i].text == before[i] for i in after)
        if name == "quality_classifier":
            rated = [i for i in before if i in labels]
            good = [i for i in rated if labels[i].quality == 1]
            assert sum(i in after for i in good) >= 0.98 * len(good)
            assert sum(i in after for i in rated if labels[i].quality == 0) <= 0.2 * (len(rated) - len(good))
        elif name == "exact_duplicates":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]), i)
            assert set(after) == set(first.values())
        elif name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute_components(list(before.items()))}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute_contamination(list(before.items()), items) if not r[-1]}
            assert benchmark_words("A-b") == ["a", "b"]
        else:
            assert docs.columns == columns + ["n_tokens", "domain", "posteriors", "rate", "copies"] and min(r.copies for r in after.values()) >= 1
            continue
        assert docs.columns == columns


def test_run_reads_documents_through_all_stages(spark):
    assert set(P.run(spark, SF).columns) >= {"doc_id", "text", "rate", "copies"}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF))
        assert docs.count() == 0
