"""Tokens are matched to the vocabulary where their text lies."""

from pyspark.sql import functions as F

from parlance.operators import normalise as N

ROWS = [(1, "cats  and boxes"), (2, ""), (3, None), (None, "dogs a"), (None, "dogs"), (4, "tables"), (4, "cats x")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_rows(spark):
    got = {r["doc_id"]: r["text"] for r in N.normalise(docs(spark)).collect()}
    assert got == {1: "cat and box", None: "dog dog a", 4: "cat tabl x"}
    table = spark.createDataFrame([("cats", "felis")], "token string, lemma string")
    got = {r["doc_id"]: r["text"] for r in N.normalise(docs(spark), lemmas=table).collect()}
    assert got == {1: "felis and boxes", None: "dogs dogs a", 4: "felis tables x"}


def test_no_token_is_shuffled_and_a_text_is_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x
    own = docs(spark).where("text IS NOT NULL").withColumn("text", F.udf(seen, "string")("text"))
    out = N.normalise(own)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 3 and calls.value == 6
