from parlance.operators import entities as EN


def test_variation_skips_gaps(spark):
    rows = [("daily", "t1", "x", "a", 1), ("daily", "t1", "x", "b", 1), ("daily", "t2", "x", "b", 1),
            ("daily", "t2", "x", "c", 1), ("daily", "t4", "x", "c", 1)]
    rolled = spark.createDataFrame(rows, "frequency string, tag string, entity_type string, item string, occurrences long")
    got = sorted((r["tag"], r["item"], r["change"]) for r in EN.variation(rolled, rolled).collect())
    assert got == [("t2", "a", "removed"), ("t2", "c", "added"), ("t4", "b", "removed")]
    summ = {(r["tag"]): (r["added"], r["removed"]) for r in EN.variation_summary(rolled, rolled).collect()}
    assert summ == {"t1": (0, 0), "t2": (1, 1), "t4": (0, 1)}
