"""Feature operators: how the work is dealt to tasks."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.operators import cooccurrence as CO
from parlance.operators import features as FE


def test_word_vectors_are_trained_by_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "uno dos tres cuatro cinco") for i in range(40)] + [(40, None)], "doc_id long, text string")
    assert FE.training_tasks(docs) == 1 and FE.training_tasks(docs.where("text IS NULL")) == 1
    monkeypatch.setattr(FE, "TRAINED_CHARS", 400)
    assert FE.training_tasks(docs) == 3                 # 1,000 code points
    assert FE.training_tasks(docs, subword=True) == 40
    seen, real = [], FE.Word2Vec
    monkeypatch.setattr(FE, "Word2Vec", lambda **kw: seen.append(kw["numPartitions"]) or real(**kw))
    out = FE.word2vec_embedder(docs.where("text IS NOT NULL"), size=4)(docs.where("text IS NOT NULL"))
    assert seen == [3]
    assert out.select(F.size("features").alias("n")).distinct().collect()[0].n == 4 and out.count() == 40


def _exchanged(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_tfidf_moves_each_document_once(spark):
    rows = [(1, "uno dos dos tres"), (2, "uno dos"), (2, "dos cuatro"), (3, "tres uno"), (None, "uno tres"), (4, None), (5, "uno dos")]
    out = FE.tfidf(spark.createDataFrame(rows, "doc_id long, text string"), min_df=2, max_df=1.0)
    assert len(_exchanged(out)) == 1
    got = {(r.doc_id, r.term): r.tfidf for r in out.collect()}
    assert set(got) == {(1, "uno"), (1, "dos"), (1, "tres"), (2, "uno"), (2, "dos"), (3, "tres"), (3, "uno"), (5, "uno"), (5, "dos")}
    idf = {t: math.log(6 / (1 + n)) + 1 for t, n in {"uno": 5, "dos": 3, "tres": 3}.items()}    # a null document counts for df, not for n
    norm = math.hypot(idf["uno"], 2 * idf["dos"])
    assert got[2, "dos"] == pytest.approx(2 * idf["dos"] / norm) and got[2, "uno"] == pytest.approx(idf["uno"] / norm)


def test_many_words_are_shuffled_with_the_same_result(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "uno dos tres uno" if i % 2 else "dos cuatro uno") for i in range(8)], "doc_id long, text string")

    def results():
        return ({(r.doc_id, r.term): round(r.tfidf, 12) for r in FE.tfidf(docs, min_df=2, max_df=1.0).collect()},
                {(r.word, r.context): round(r.value, 12) for r in CO.corpus_ppmi(docs, 2, 1).collect()})
    few = results()
    assert few[1] == {(r.word, r.context): round(r.value, 12) for r in CO.ppmi(CO.pair_counts(docs, 2, 1)).collect()}
    assert [x for x in _exchanged(CO.corpus_ppmi(docs, 2, 1)) if "(a#" in x or "(word#" in x or "(context#" in x]
    monkeypatch.setattr(FE, "SENT_WORDS", 1)
    monkeypatch.setattr(CO, "SENT_WORDS", 1)
    assert results() == few
