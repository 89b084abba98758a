"""Queries over posts: scans, filters, corpus selection, calendar (A, B, D1, G1, H16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import text as T
from ..operators import corpus as K
from ..operators.ngrams import top_ngrams, top_ngrams_sql
from ..sources import tables as S
from .registry import query

P = f"WITH posts AS ({S.POSTS_SQL})\n"
MAIN = S.MAIN_CITY
EXCL = ", ".join(f"'{a}'" for a in S.EXCLUDED_ACCOUNTS)
TODAY_SQL = "SELECT CAST(max(created_at) AS DATE) + 1 FROM posts"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _ts_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


SELECTED_SQL = f"""SELECT * FROM posts WHERE city_tag = '{MAIN}'
  AND (screen_name IS NULL OR screen_name NOT IN ({EXCL}))
  AND (full_text IS NULL OR full_text NOT IN (SELECT full_text FROM posts WHERE full_text IS NOT NULL GROUP BY full_text HAVING count(*) > 1))"""


# ---- step 1: the flagship query -------------------------------------------------------------
def language_themes(spark, sf_dir, n=2, top=5):
    """H7 → G1 → B6 → F2: top bigram themes of the cleaned, distinct corpus per language."""
    posts = S.posts(spark, sf_dir)
    corpus = K.clean_corpus(posts, "full_text", key_cols=["lang"])
    return top_ngrams(corpus, ["lang"], "text", n=n, top=top)


def _language_themes_sql(n=2, top=5):
    src = f"""SELECT DISTINCT lang, text FROM (SELECT lang, {T.clean_v2_sql('full_text')} AS text FROM posts)
WHERE length(text) > 0"""
    return P + "SELECT * FROM (" + top_ngrams_sql(src, ["lang"], "text", n=n, top=top) + ")"


query("f2_top_ngrams", _language_themes_sql)(language_themes)


# ---- A: scans ------------------------------------------------------------------------------------
@query("a1_scan_posts", lambda: P + f"""SELECT id, full_text, screen_name, city_tag, lang,
  {_ts_sql('created_at')} AS created_at FROM posts""")
def a1_scan_posts(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    return p.select("id", "full_text", "screen_name", "city_tag", "lang", _ts("created_at").alias("created_at"))


@query("a2_filtered_text", lambda: P + f"""SELECT id, full_text FROM ({SELECTED_SQL})""")
def a2_filtered_text(spark, sf_dir):
    return K.text_of_posts(S.posts(spark, sf_dir), city=MAIN)


@query("a3_main_corpus", lambda: P + f"SELECT DISTINCT full_text FROM ({SELECTED_SQL})")
def a3_main_corpus(spark, sf_dir):
    return K.main_corpus(S.posts(spark, sf_dir), MAIN)


def _tag_dates_sql(freq):
    cal = C.tag_calendar_sql(freq, TODAY_SQL)
    return f"""SELECT frequency, tag, CAST(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS DATE) AS date
FROM ({cal})"""


@query("a4_posts_by_tag", lambda: P + f"""SELECT DISTINCT d.frequency, d.tag, s.full_text
FROM ({SELECTED_SQL}) s JOIN ({_tag_dates_sql('weekly')}) d ON CAST(s.created_at AS DATE) = d.date""")
def a4_posts_by_tag(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    cal = C.tag_calendar("weekly", C.today_after_newest(posts))
    return K.posts_by_tag(posts, C.tag_dates(cal), MAIN)


@query("a7_tags_by_frequency", lambda: P + "SELECT frequency, count(*) AS tags, CAST(sum(dates_amount) AS BIGINT) AS days FROM ("
       + " UNION ALL ".join(f"SELECT frequency, dates_amount FROM ({C.tag_calendar_sql(f, TODAY_SQL)})"
                            for f in C.VALID_FREQUENCIES) + ") GROUP BY frequency")
def a7_tags_by_frequency(spark, sf_dir):
    """One tag table partitioned by frequency (here: tags and days per partition)."""
    posts = S.posts(spark, sf_dir)
    today = C.today_after_newest(posts)
    cal = None
    for f in C.VALID_FREQUENCIES:
        part = C.tag_calendar(f, today)
        cal = part if cal is None else cal.unionByName(part)
    return cal.groupBy("frequency").agg(F.count(F.lit(1)).alias("tags"),
                                        F.sum("dates_amount").cast("long").alias("days"))


# ---- B: filters ------------------------------------------------------------------------------------
@query("b1_exclude_accounts", lambda: P + f"""SELECT id FROM posts
WHERE screen_name IS NULL OR screen_name NOT IN ({EXCL})""")
def b1_exclude_accounts(spark, sf_dir):
    return K.exclude_accounts(S.posts(spark, sf_dir)).select("id")


@query("b2_city", lambda: P + f"SELECT id FROM posts WHERE city_tag = '{MAIN}'")
def b2_city(spark, sf_dir):
    return S.posts(spark, sf_dir).where(F.col("city_tag") == MAIN).select("id")


@query("b3_dates_of_tag", lambda: P + f"""SELECT d.tag, p.id FROM posts p
JOIN ({_tag_dates_sql('monthly')}) d ON CAST(p.created_at AS DATE) = d.date""")
def b3_dates_of_tag(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    dates = C.tag_dates(C.tag_calendar("monthly", C.today_after_newest(posts)))
    return posts.withColumn("date", F.to_date("created_at")).join(dates, "date").select("tag", "id")


@query("b4_exclude_repeated", lambda: P + """SELECT id FROM posts WHERE full_text IS NULL OR full_text NOT IN
 (SELECT full_text FROM posts WHERE full_text IS NOT NULL GROUP BY full_text HAVING count(*) > 1)""")
def b4_exclude_repeated(spark, sf_dir):
    return K.exclude_repeated(S.posts(spark, sf_dir)).select("id")


@query("b5_city_modes", lambda: P + f"""SELECT coalesce(city_tag, 'all') AS mode, count(*) AS posts,
  count(DISTINCT full_text) AS distinct_texts FROM ({SELECTED_SQL.replace(f"city_tag = '{MAIN}'", 'TRUE')})
GROUP BY GROUPING SETS ((city_tag), ())""")
def b5_city_modes(spark, sf_dir):
    """One city and all cities at once (GROUPING SETS)."""
    sel = K.select_posts(S.posts(spark, sf_dir))
    sel.createOrReplaceTempView("_b5_selected")
    return spark.sql("""SELECT coalesce(city_tag, 'all') AS mode, count(*) AS posts,
      count(DISTINCT full_text) AS distinct_texts FROM _b5_selected GROUP BY GROUPING SETS ((city_tag), ())""")


@query("b6_nonempty_clean", lambda: P + f"""SELECT id, text FROM (SELECT id, {T.clean_v2_sql('full_text')} AS text
FROM posts) WHERE length(text) > 0""")
def b6_nonempty_clean(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    return p.select("id", K.nonempty(T.clean_v2("full_text")).alias("text"))


@query("b14_search_terms", lambda: P + """SELECT id FROM posts
WHERE regexp_matches(full_text, '(?i)(mentre|ouen|thorr)') AND lang = 'fr'
  AND NOT starts_with(full_text, 'RT @') AND NOT regexp_matches(full_text, 'http')""")
def b14_search_terms(spark, sf_dir):
    return K.search_term_filter(S.posts(spark, sf_dir), ["mentre", "ouen", "thorr"], "fr").select("id")


@query("b15_drop_retweets", lambda: P + "SELECT id FROM posts WHERE NOT starts_with(full_text, 'RT @')")
def b15_drop_retweets(spark, sf_dir):
    return K.drop_retweets(S.posts(spark, sf_dir)).select("id")


# ---- D1, G1 -------------------------------------------------------------------------------------------
@query("d1_repeated_texts", lambda: P + """SELECT full_text, count(*) AS count FROM posts
WHERE full_text IS NOT NULL GROUP BY full_text HAVING count(*) > 1""")
def d1_repeated_texts(spark, sf_dir):
    return K.repeated_texts(S.posts(spark, sf_dir))


@query("g1_distinct_clean", lambda: P + f"""SELECT DISTINCT lang, text FROM
 (SELECT lang, {T.clean_v2_sql('full_text')} AS text FROM posts) WHERE length(text) > 0""")
def g1_distinct_clean(spark, sf_dir):
    return K.clean_corpus(S.posts(spark, sf_dir), "full_text", key_cols=["lang"])


# ---- H16 calendar ------------------------------------------------------------------------------------------
def _cal_sql():
    parts = [f"SELECT frequency, tag, strftime(first_date, '%Y-%m-%d') AS first_date, "
             f"strftime(last_date, '%Y-%m-%d') AS last_date, dates_amount FROM ({C.tag_calendar_sql(f, TODAY_SQL)})"
             for f in C.VALID_FREQUENCIES]
    return P + " UNION ALL ".join(parts)


@query("h16_tag_calendar", _cal_sql)
def h16_tag_calendar(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    today = C.today_after_newest(posts)
    out = None
    for f in C.VALID_FREQUENCIES:
        cal = C.tag_calendar(f, today).select(
            "frequency", "tag", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"),
            F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
            F.col("dates_amount").cast("long").alias("dates_amount"))
        out = cal if out is None else out.unionByName(cal)
    return out
