"""H14 (re-aimed) vocabulary normalisation: tokens → lemma / stem through a lookup table.

The distinct vocabulary is normalised once (a table the size of the vocabulary, not of the corpus),
tokens are matched to it by an equi-join on the token, unknown tokens stay as they are, and each text
is regrouped in token order.  The texts are computed once (written, then read for the vocabulary and for the
match) and move once, by their id; a table of up to ``features.SENT_WORDS`` rows is sent to the tasks, so that no token moves; with a larger
one the tokens do.  Any (token, lemma) table can be supplied; the default one is built from
the corpus vocabulary by a light plural-stripping rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .features import sent

# Light plural rule (fixed values): strip "es" from words longer than 4 letters, else "s" from words
# longer than 3 letters.
PLURAL_RULES = (("es", 4), ("s", 3))


def light_stem(t: Column) -> Column:
    out = t
    for suffix, min_len in reversed(PLURAL_RULES):
        out = F.when(t.endswith(suffix) & (F.length(t) > min_len),
                     t.substr(F.lit(1), F.length(t) - len(suffix))).otherwise(out)
    return out


def light_stem_sql(t: str) -> str:
    (s1, m1), (s2, m2) = PLURAL_RULES
    return (f"CASE WHEN ends_with({t}, '{s1}') AND length({t}) > {m1} THEN left({t}, length({t}) - {len(s1)}) "
            f"WHEN ends_with({t}, '{s2}') AND length({t}) > {m2} THEN left({t}, length({t}) - {len(s2)}) ELSE {t} END")


def vocabulary_lemmas(tokens_df: DataFrame) -> DataFrame:
    """(token, lemma) for the distinct vocabulary of a (doc_id, pos, token) frame (changed tokens only)."""
    vocab = tokens_df.select("token").distinct()
    return vocab.select("token", light_stem(F.col("token")).alias("lemma")).where(F.col("lemma") != F.col("token"))


def normalise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lemmas: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) with every token replaced by its lemma when the table has one."""
    texts, tokens = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))), T.tokens(F.col("_text"))
    table = sent(lemmas if lemmas is not None else vocabulary_lemmas(texts.select(F.explode(tokens).alias("token"))))
    toks = texts.repartition("doc_id").select("doc_id", F.posexplode(tokens).alias("pos", "token"))
    j = toks.join(table, "token", "left").withColumn("token", F.coalesce("lemma", "token"))
    regrouped = j.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return regrouped.select("doc_id", F.array_join(F.transform("_t", lambda s: s["token"]), " ").alias("text"))
