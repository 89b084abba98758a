from pyspark.sql import functions as F

from parlance.functions import text as T


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_cleaner_v2_golden(spark):
    assert _one(spark, "Esta es una frase! Qué loco todo! @andres #tema", T.clean_v2) == "frase loco"
    assert _one(spark, "😋\n        BASADO\n        😋", T.clean_v2) == "basado"
    assert _one(spark, "3x covid19 100% ok", T.clean_v2) == "ok"


def test_fold_accents(spark):
    assert _one(spark, "qué niño güiro\nçå", T.fold_accents) == "que niño guiro ca"


def test_hashtags(spark):
    got = spark.createDataFrame([("#Venezuela!! # #SOS_ #Ñandú2…",)], "s string").select(
        T.hashtags("s").alias("h")).first()["h"]
    assert got == ["#venezuela", "#sos", "#ñandu2"]


def test_capitalize(spark):
    assert _one(spark, "hola QUÉ tal", T.capitalize) == "Hola qué tal"


def test_ngrams_short_and_normal(spark):
    df = spark.createDataFrame([(["solo"],), (["a", "b", "c"],)], "t array<string>")
    rows = [r["g"] for r in df.select(T.ngrams(F.col("t"), 2).alias("g")).collect()]
    assert rows == [[], [["a", "b"], ["b", "c"]]]


def test_blank_unwanted_keeps_double_spaces(spark):
    from parlance.functions.lexicon import unwanted_words
    text = "Hola jajaja que JAJA tal"
    want = " ".join("" if w in set(unwanted_words()) else w for w in text.split())
    assert "  " in want
    assert _one(spark, text, T.blank_unwanted) == want


def test_half_even_rounding(spark):
    assert spark.range(1).select(F.bround(F.lit(0.125), 2)).first()[0] == 0.12
