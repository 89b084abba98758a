"""Entities per tag: H13 extraction, G2 sets, D17 roll-up, F1 tag-over-tag variation, P1.

Everything stays in *long form* — one row per (frequency, tag, entity_type, item) — so a tag
with millions of entities is a set of rows spread over partitions, never one collected array.
The added / removed sets of F1 are ``left_anti`` joins against the previous stored tag, which
is found by ``lag`` over the (small) table of stored tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ENTITY_TYPES = ("organizations", "locations", "persons", "misc")
GAZETTEER_TYPES = {"ORG": "organizations", "LOC": "locations", "PER": "persons", "MISC": "misc"}
# maximal runs of capitalised words that start a whitespace token
_RUN = r"(?:^|[\x{9}-\x{D}\x{20}])(\p{Lu}\p{L}+(?:[\x{20}]\p{Lu}\p{L}+)*)"


def capitalised_runs(col) -> "F.Column":
    """Candidate entity spans: maximal runs of capitalised words (not after @ or #)."""
    return F.regexp_extract_all(col, F.lit(_RUN), 1)


def capitalised_runs_sql(e: str) -> str:
    return f"regexp_extract_all({e}, '{_RUN}', 1)"


def extract_entities(docs: DataFrame, text_col: str, gazetteer: DataFrame, key_cols=()) -> DataFrame:
    """H13 (re-aimed): spans ⋈ gazetteer(surface, type) → typed entities; unknown spans → misc.
    Accents folded (H1).  The gazetteer is a bounded dimension table; Spark picks the join."""
    spans = docs.select(*key_cols, F.explode(capitalised_runs(F.col(text_col))).alias("surface"))
    spans = spans.withColumn("item", T.fold_accents("surface"))
    typed = spans.join(gazetteer.select(F.col("surface").alias("item"), "entity_type"), "item", "left")
    return typed.select(*key_cols, "item", F.coalesce("entity_type", F.lit("misc")).alias("entity_type"))


def extract_hashtag_items(docs: DataFrame, text_col: str, key_cols=()) -> DataFrame:
    """H12 in long form: (keys, item, entity_type='hashtags')."""
    return docs.select(*key_cols, F.explode(T.hashtags(text_col)).alias("item"),
                       F.lit("hashtags").alias("entity_type"))


def with_all_type(items: DataFrame, key_cols) -> DataFrame:
    """Add the ``all`` entity type = every named-entity type together (hashtags excluded)."""
    named = items.where(F.col("entity_type") != "hashtags").withColumn("entity_type", F.lit("all"))
    return items.unionByName(named.select(*items.columns))


def rollup(items: DataFrame, key_cols=("frequency", "tag")) -> DataFrame:
    """D17 in long form: per (keys, type, item) the number of occurrences; G2 = the rows themselves."""
    k = list(key_cols)
    return items.groupBy(*k, "entity_type", "item").agg(F.count(F.lit(1)).alias("occurrences"))


def rollup_summary(rolled: DataFrame, key_cols=("frequency", "tag")) -> DataFrame:
    """D17 amounts: list length (with repeats) and unique amount per (keys, type)."""
    k = list(key_cols)
    return rolled.groupBy(*k, "entity_type").agg(F.sum("occurrences").alias("items_amount"),
                                                 F.count(F.lit(1)).alias("unique_amount"))


def previous_tags(tags: DataFrame) -> DataFrame:
    """(frequency, tag, prev_tag): previous *stored* tag of the same frequency (gaps skipped).
    The window runs over the stored-tag table — one row per tag."""
    w = Window.partitionBy("frequency").orderBy("tag")
    return tags.select("frequency", "tag").distinct().withColumn("prev_tag", F.lag("tag").over(w))


def variation(rolled: DataFrame, tags: DataFrame) -> DataFrame:
    """added = cur \\ prev, removed = prev \\ cur, per (frequency, tag, type); the first tag has
    none.  Long form: (frequency, tag, entity_type, item, change)."""
    prev = previous_tags(tags).where(F.col("prev_tag").isNotNull())
    cur = rolled.select("frequency", "tag", "entity_type", "item")
    # items of the previous tag, re-keyed to the current tag
    before = (cur.withColumnRenamed("tag", "prev_tag").join(prev, ["frequency", "prev_tag"])
              .select("frequency", "tag", "entity_type", "item"))
    now = cur.join(prev.select("frequency", "tag"), ["frequency", "tag"])
    keys = ["frequency", "tag", "entity_type", "item"]
    added = now.join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = before.join(now, keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def variation_summary(rolled: DataFrame, tags: DataFrame) -> DataFrame:
    """(frequency, tag, entity_type, unique_amount, items_amount, added, removed) for every stored
    tag and type; the first tag gets 0 / 0 (empty arrays)."""
    summ = rollup_summary(rolled)
    var = variation(rolled, tags).groupBy("frequency", "tag", "entity_type").agg(
        F.count(F.when(F.col("change") == "added", 1)).alias("added"),
        F.count(F.when(F.col("change") == "removed", 1)).alias("removed"))
    out = summ.join(var, ["frequency", "tag", "entity_type"], "full")
    return out.select("frequency", "tag", "entity_type",
                      F.coalesce("unique_amount", F.lit(0)).cast("long").alias("unique_amount"),
                      F.coalesce("items_amount", F.lit(0)).cast("long").alias("items_amount"),
                      F.coalesce("added", F.lit(0)).cast("long").alias("added"),
                      F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))


def gazetteer_from_tables(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """A (surface, entity_type) dimension from the driver's named tables: nations and regions are
    locations, suppliers organisations (surfaces capitalised like prose)."""
    cap = lambda c: T.capitalize(c)
    return (nation.select(cap("n_name").alias("surface"), F.lit("locations").alias("entity_type"))
            .unionByName(region.select(cap("r_name").alias("surface"), F.lit("locations").alias("entity_type")))
            .unionByName(supplier.select(cap("s_name").alias("surface"), F.lit("organizations").alias("entity_type")))
            .dropDuplicates(["surface"]))
