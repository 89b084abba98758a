"""Exact duplicates by content-defined chunk recipes (operator 9), DataFrame functions only.

A text (null counts as empty) is normalised by turning each run of ASCII white space into one space,
and cut where its own content says so: after 512 characters, the next place where the characters
around a space fall into fixed classes, or after 4,096 characters.  Equal texts are cut alike, and a
change moves only the cuts near it.  A chunk's identifier is its 64-bit hash, *verified*: the distinct
(hash, chunk) pairs of the corpus show every hash that stands for more than one chunk.  A document is
the ordered list of its identifiers; those lists are compared and moved, not the texts.  Documents
with a chunk whose hash stands for several chunks (normally none) are compared by their whole text.

Cases: null or empty text: the empty list, all of them equal.  Null ``doc_id``: part of its group, the
smallest non-null id stays; if a group has none, ``keep_id`` is null and its rows are kept.  Repeated
rows count one by one in ``group_size``; all rows of the kept id are kept.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_CHARS, MAX_CHARS = 512, 4096
NO_ID = -(1 << 63)          # stands for a null doc_id
# A cut falls behind such characters (about one place in 130)
CUT_BEHIND = "[g-m][d-n] [o-z]"


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null as the empty text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def chunks(norm: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The text cut into content-defined chunks; their concatenation is the text."""
    pattern = f"(?s).{{{min_chars},{max_chars - 1}}}?(?<={CUT_BEHIND})|.{{1,{max_chars}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_dictionary(texts: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """The distinct (id, chunk) pairs of ``texts(norm)``; copies fall together before the shuffle."""
    return (texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
            .select(hash_of("chunk").alias("id"), "chunk").distinct())


def exact_duplicates(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) for every row of ``docs(doc_id, text)``."""
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    ambiguous = stored(chunk_dictionary(base, hash_of).groupBy("id").count().where("count > 1").select("id"))
    recipes = base.select("doc_id", "norm", F.transform(chunks(F.col("norm")), lambda c: hash_of(c)).alias("recipe"))
    if ambiguous.isEmpty():
        whole = F.lit(None).cast("string")
    else:  # some hash is no identifier: its documents carry their text as well
        ids = (recipes.select("recipe", F.explode("recipe").alias("id")).join(ambiguous, "id", "left_semi")
               .select("recipe").distinct().withColumn("marked", F.lit(True)))
        recipes = recipes.join(ids, "recipe", "left")
        whole = F.when(F.col("marked"), F.col("norm"))
    rows = stored(recipes.select("doc_id", "recipe", whole.alias("whole"),
                                 F.sha2("norm", 256).alias("text_sha256")))
    key = ["recipe", F.coalesce("whole", F.lit("")).alias("whole")]
    groups = (rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # one row a group; the rows of a large group are split by the adaptive skew join
    return (rows.select("doc_id", "text_sha256", *key).join(groups, ["recipe", "whole"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256", F.size("recipe").alias("n_chunks")))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest doc_id; repeated rows go.

    The decisions are narrow rows; the documents are dealt once, by id and hash, for both the join and the repeated rows."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_exact_id"), "_exact_sha"]
    lost = (exact_duplicates(docs).where(~F.col("kept")).withColumnRenamed("text_sha256", "_exact_sha").select(*key).distinct())
    left = (docs.withColumn("_exact_sha", F.sha2(normalised(F.col("text")), 256)).select("*", key[0])
            .join(lost, ["_exact_id", "_exact_sha"], "left_anti"))
    nth = F.row_number().over(Window.partitionBy("_exact_id", "_exact_sha").orderBy("_exact_sha"))
    return left.withColumn("_exact_nth", nth).where("_exact_nth = 1").select(*docs.columns)


ORACLE = """WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
