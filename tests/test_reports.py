from parlance.operators import reports as R


def test_consolidated_weighting(spark):
    rows = [("daily", "A", "e1", 0.5), ("daily", "A", "e1", 0.7), ("daily", "A", "e1", None),
            ("daily", "B", "e1", 0.9), ("daily", "B", "e1", None), ("daily", "B", "e1", None)]
    df = spark.createDataFrame(rows, "frequency string, algorithm string, embedder string, sil_score double")
    got = [(r["algorithm"], round(r["sil_score"], 9), r["valid_entries"], round(r["weighted_score"], 9))
           for r in R.consolidated(df, "daily").collect()]
    assert got == [("A", 0.6, 2, 0.6), ("B", 0.9, 1, 0.45)]


def test_unknown_frequency_rejected(spark):
    import pytest
    df = spark.createDataFrame([("daily",)], "frequency string")
    with pytest.raises(ValueError):
        R.of_frequency(df, "hourly")


def test_ties_round_half_even(spark):
    from pyspark.sql import functions as F
    from parlance.operators.reports import exact_avg, np_round
    values = [0.0625, 0.1875, 2.5, 3.5, -0.0625]       # exact in binary
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    import numpy as np
    got = [r.x for r in df.select(np_round("v", 3).alias("x")).collect()]
    assert got == [float(np.round(v, 3)) for v in values] == [0.062, 0.188, 2.5, 3.5, -0.062]
    assert [r.x for r in df.select(np_round("v", 0).alias("x")).collect()][2:4] == [2.0, 4.0]
    assert df.where("v is null").agg(exact_avg(F.col("v"))).first()[0] is None
