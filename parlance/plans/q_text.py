"""Scalar text functions over the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources import tables as S
from .registry import query

D = "documents"


def _docs(spark, sf_dir):
    return S.table(spark, sf_dir, D)


@query("h1_fold_accents", lambda: f"SELECT doc_id, {T.fold_accents_sql('lower(text)')} AS text FROM documents")
def h1_fold_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold_accents(F.lower("text")).alias("text"))


@query("h2_remove_emoji", lambda: f"SELECT doc_id, length({T.remove_emoji_sql('text')}) AS n_chars FROM documents")
def h2_remove_emoji(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.remove_emoji("text")).cast("long").alias("n_chars"))


@query("h3_keep_tokens", lambda: f"""SELECT doc_id, CAST(len(list_filter({T.tokens_sql('text')},
  lambda t: {T.keep_token_sql('t')})) AS BIGINT) AS kept, CAST(len({T.tokens_sql('text')}) AS BIGINT) AS total FROM documents""")
def h3_keep_tokens(spark, sf_dir):
    toks = T.tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(toks, T.keep_token)).cast("long").alias("kept"),
                                       F.size(toks).cast("long").alias("total"))


@query("h4_punctuation", lambda: f"""SELECT doc_id, {T.punctuation_to_space_sql('text')} AS text FROM documents""")
def h4_punctuation(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.punctuation_to_space("text").alias("text"))


@query("h5_stopword_counts", lambda: f"""SELECT lang, CAST(sum(len(list_filter(toks, lambda t:
  list_contains({L.sql_str_list(L.stopwords())}, t)))) AS BIGINT) AS stopwords
FROM (SELECT lang, {T.tokens_sql(T.fold_accents_sql('lower(text)'))} AS toks FROM documents) GROUP BY lang""")
def h5_stopword_counts(spark, sf_dir):
    """H5: the stop-word set applied to the corpus — stop-word tokens per language."""
    words = list(L.stopwords())
    toks = _docs(spark, sf_dir).select("lang", T.tokens(T.fold_accents(F.lower("text"))).alias("toks"))
    return toks.groupBy("lang").agg(
        F.sum(F.size(F.filter("toks", lambda t: t.isin(words)))).cast("long").alias("stopwords"))


@query("h6_drop_stopwords", lambda: f"""SELECT doc_id, array_to_string({T.drop_stopwords_sql(T.tokens_sql('lower(text)'))}, ' ') AS text
FROM documents""")
def h6_drop_stopwords(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(T.drop_stopwords(T.tokens(F.lower("text"))), " ").alias("text"))


@query("h7_clean_v2", lambda: f"SELECT doc_id, {T.clean_v2_sql('text')} AS text FROM documents")
def h7_clean_v2(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_v2("text").alias("text"))


@query("h8_clean_v1", lambda: f"SELECT doc_id, {T.clean_v1_sql('text')} AS text FROM documents")
def h8_clean_v1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_v1("text").alias("text"))


@query("h9_blank_unwanted", lambda: f"SELECT doc_id, {T.blank_unwanted_sql('text')} AS text FROM documents")
def h9_blank_unwanted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.blank_unwanted("text").alias("text"))


@query("h10_long_tokens", lambda: f"SELECT doc_id, CAST(len({T.long_tokens_sql('text')}) AS BIGINT) AS n_tokens FROM documents")
def h10_long_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.long_tokens("text")).cast("long").alias("n_tokens"))


@query("h11_ngram_counts", lambda: f"""SELECT doc_id, CAST(len({T.ngrams_sql('toks', 3)}) AS BIGINT) AS trigrams
FROM (SELECT doc_id, {T.tokens_sql('text')} AS toks FROM documents)""")
def h11_ngram_counts(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("toks"))
    return toks.select("doc_id", F.size(T.ngrams(F.col("toks"), 3)).cast("long").alias("trigrams"))


HASHTAG_RE = r"(\p{Lu}\p{L}+)"


def posts_hashtags(spark, sf_dir):
    """posts with each capitalised word made a hashtag (FIXTURES.md §2)."""
    return S.posts(spark, sf_dir).withColumn("full_text", F.regexp_replace("full_text", HASHTAG_RE, "#$1"))


POSTS_HASHTAGS_SQL = f"SELECT * REPLACE (regexp_replace(full_text, '{HASHTAG_RE}', '#\\1', 'g') AS full_text) FROM ({S.POSTS_SQL})"


@query("h12_hashtags", lambda: f"""SELECT id, tag, CAST(count(*) AS BIGINT) AS count FROM
 (SELECT id, unnest({T.hashtags_sql('full_text')}) AS tag FROM ({POSTS_HASHTAGS_SQL})) GROUP BY id, tag""")
def h12_hashtags(spark, sf_dir):
    p = posts_hashtags(spark, sf_dir)
    return (p.select("id", F.explode(T.hashtags("full_text")).alias("tag"))
            .groupBy("id", "tag").agg(F.count(F.lit(1)).alias("count")))


@query("h15_capitalize", lambda: f"SELECT doc_id, {T.capitalize_sql('text')} AS text FROM documents")
def h15_capitalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.capitalize("text").alias("text"))


@query("h17_format_dates", lambda: f"""SELECT id, strftime(created_at, '%Y-%m-%d') AS date FROM ({S.POSTS_SQL})""")
def h17_format_dates(spark, sf_dir):
    return S.posts(spark, sf_dir).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("date"))


@query("h18_round_half_even", lambda: """SELECT event_id, round_even(event_id / 8, 2) AS v2,
  round_even(event_id / 16, 3) AS v3 FROM events""")
def h18_round_half_even(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    # eighths and sixteenths are exact binary fractions, so the ties are real ties (half-even)
    return e.select("event_id", F.bround(F.col("event_id") / 8, 2).alias("v2"),
                    F.bround(F.col("event_id") / 16, 3).alias("v3"))
