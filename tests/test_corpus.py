from parlance.operators import corpus as K


def test_repeated_text_drops_every_copy(spark):
    df = spark.createDataFrame([(1, "x", "u"), (2, "x", "u"), (3, "y", None)], "id long, full_text string, screen_name string")
    assert [r["full_text"] for r in K.exclude_repeated(df).collect()] == ["y"]


def test_missing_account_passes(spark):
    df = spark.createDataFrame([(1, "src0"), (2, None), (3, "src9")], "id long, screen_name string")
    assert sorted(r["id"] for r in K.exclude_accounts(df).collect()) == [2, 3]
