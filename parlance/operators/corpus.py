"""Corpus selection: A2–A4, B1–B6, B14, B15, D1, G1.

All filters are column predicates over the posts scan, so Catalyst pushes
them into the Parquet reader; the repeated-text exclusion (B4) is a
``left_anti`` join against D1 computed once for the whole table (never a
literal NOT IN list), and the per-tag load (A4) handles every tag in one
pass by an equi-join on the post date.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import EXCLUDED_ACCOUNTS


def repeated_texts(posts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Texts that occur more than once, with their count (partial aggregation, spills if needed)."""
    return (posts.where(F.col(text_col).isNotNull())
            .groupBy(text_col).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def exclude_accounts(posts: DataFrame, accounts: Iterable[str] = EXCLUDED_ACCOUNTS,
                     col: str = "screen_name") -> DataFrame:
    """B1: accounts not in the list; a missing account passes."""
    return posts.where(F.col(col).isNull() | ~F.col(col).isin(list(accounts)))


def exclude_repeated(posts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Drop every copy of a verbatim-repeated text (judged over the whole table)."""
    rep = repeated_texts(posts, text_col).select(text_col)
    return posts.join(rep, text_col, "left_anti")


def select_posts(posts: DataFrame, exclude_uninteresting_accounts: bool = True,
                 exclude_repeated_text: bool = True, city: str | None = None,
                 dates: DataFrame | None = None) -> DataFrame:
    """A2 before projection: the optional filters B1, B4, B2, B3.

    ``dates`` is a frame of (frequency, tag, date): every post is matched to
    each tag containing its day (B3 for all tags at once)."""
    out = posts
    if city is not None:
        out = out.where(F.col("city_tag") == city)
    if exclude_uninteresting_accounts:
        out = exclude_accounts(out)
    if exclude_repeated_text:
        # the repeated set is judged over the whole table, before the other filters
        rep = repeated_texts(posts).select("full_text")
        out = out.join(rep, "full_text", "left_anti")
    if dates is not None:
        out = out.withColumn("date", F.to_date("created_at")).join(dates, "date")
    return out


def text_of_posts(posts: DataFrame, **kw) -> DataFrame:
    """A2: the text column of the selected posts."""
    return select_posts(posts, **kw).select("id", "full_text")


def main_corpus(posts: DataFrame, city: str) -> DataFrame:
    """A3: distinct text of one city with the default exclusions."""
    return select_posts(posts, city=city).select("full_text").distinct()


def posts_by_tag(posts: DataFrame, dates: DataFrame, city: str) -> DataFrame:
    """A4 for every tag in one pass: (frequency, tag, full_text), distinct per tag."""
    sel = select_posts(posts, city=city, dates=dates)
    return sel.select("frequency", "tag", "full_text").dropDuplicates(["frequency", "tag", "full_text"])


def nonempty(col) -> "F.Column":
    """Generator keeping a computed string only when it is non-empty.

    A ``where(length(x) > 0)`` on a computed column would be pushed below the projection with the
    whole expression inlined — evaluated twice, the first time before any repartition.  Exploding a
    filtered one-element array filters without a pushable predicate."""
    return F.explode(F.filter(F.array(col), lambda s: F.length(s) > 0))


def clean_corpus(df: DataFrame, text_col: str, key_cols=(), out_col: str = "text") -> DataFrame:
    """H7 → G1 → B6: cleaned text, distinct per key, non-empty."""
    cleaned = df.select(*key_cols, nonempty(T.clean_v2(text_col)).alias(out_col))
    return cleaned.dropDuplicates([*key_cols, out_col])


def search_term_filter(posts: DataFrame, terms: Iterable[str], lang: str, text_col: str = "full_text",
                       lang_col: str = "lang") -> DataFrame:
    """B14 (re-aimed search query): any of the terms/hashtags, language, no retweet, no link."""
    import re
    alternation = "|".join(re.escape(t) for t in terms)
    return posts.where(F.col(text_col).rlike(f"(?i)({alternation})")
                       & (F.col(lang_col) == lang)
                       & ~F.col(text_col).startswith("RT @")
                       & ~F.col(text_col).rlike("http"))


def drop_retweets(posts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Drop texts starting with ``RT @``."""
    return posts.where(~F.col(text_col).startswith("RT @"))
