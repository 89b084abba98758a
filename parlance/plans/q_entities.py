"""Entity and tag queries: H13, G2, G3, D17, F1, F4, F5, A5, A6, B13, D21, C1, C2, C6, C8, P1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import text as T
from ..operators import corpus as K
from ..operators import entities as EN
from ..operators.ngrams import word_frequencies
from ..operators.reports import EMBEDDER_SHORT_NAMES
from ..sources import tables as S
from .q_corpus import SELECTED_SQL, TODAY_SQL, _tag_dates_sql
from .q_reports import FIXTURE_ALGORITHMS, RR
from .q_text import HASHTAG_RE, POSTS_HASHTAGS_SQL, posts_hashtags
from .registry import query

DS = f"WITH day_sets AS ({S.DAY_SETS_SQL})\n"
ROLLED_SQL = "SELECT 'daily' AS frequency, tag, entity_type, item, count(*) AS occurrences FROM day_sets GROUP BY ALL"


def _rolled(spark, sf_dir):
    ds = S.day_sets(spark, sf_dir).withColumn("frequency", F.lit("daily"))
    return EN.rollup(ds)


def _variation_sql(rolled_cte: str) -> str:
    return f"""{rolled_cte},
tg AS (SELECT DISTINCT frequency, tag FROM r),
pv AS (SELECT frequency, tag, lag(tag) OVER (PARTITION BY frequency ORDER BY tag) AS prev_tag FROM tg),
cur AS (SELECT r.frequency, r.tag, r.entity_type, r.item FROM r JOIN pv USING (frequency, tag) WHERE pv.prev_tag IS NOT NULL),
bef AS (SELECT pv.frequency, pv.tag, r.entity_type, r.item FROM r JOIN pv ON r.frequency = pv.frequency AND r.tag = pv.prev_tag)
SELECT frequency, tag, entity_type, item, 'added' AS change FROM (SELECT * FROM cur EXCEPT SELECT * FROM bef)
UNION ALL
SELECT frequency, tag, entity_type, item, 'removed' AS change FROM (SELECT * FROM bef EXCEPT SELECT * FROM cur)"""


@query("f1_variation", lambda: "WITH day_sets AS (" + S.DAY_SETS_SQL + "),\n" + _variation_sql(f"r AS ({ROLLED_SQL})"))
def f1_variation(spark, sf_dir):
    rolled = _rolled(spark, sf_dir)
    return EN.variation(rolled, rolled.select("frequency", "tag"))


@query("d17_tag_rollup", lambda: DS + f"""SELECT frequency, tag, entity_type, CAST(sum(occurrences) AS BIGINT) AS items_amount,
  count(*) AS unique_amount FROM ({ROLLED_SQL}) GROUP BY ALL""")
def d17_tag_rollup(spark, sf_dir):
    return EN.rollup_summary(_rolled(spark, sf_dir))


@query("g2_entity_sets", lambda: DS + "SELECT DISTINCT tag, entity_type, item FROM day_sets")
def g2_entity_sets(spark, sf_dir):
    return S.day_sets(spark, sf_dir).dropDuplicates(["tag", "entity_type", "item"])


@query("g3_set_difference", lambda: """SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS only_first,
  array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS only_second
FROM (SELECT user_id, list_distinct(list(event_type) FILTER (WHERE day(ts) <= 15)) AS a,
        list_distinct(list(event_type) FILTER (WHERE day(ts) > 15)) AS b FROM events GROUP BY user_id)""")
def g3_set_difference(spark, sf_dir):
    """Both directions of a set difference with ``array_except`` (sets bounded by the event types)."""
    e = S.table(spark, sf_dir, "events")
    sets = e.groupBy("user_id").agg(
        F.collect_set(F.when(F.dayofmonth("ts") <= 15, F.col("event_type"))).alias("a"),
        F.collect_set(F.when(F.dayofmonth("ts") > 15, F.col("event_type"))).alias("b"))
    return sets.select("user_id",
                       F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("only_first"),
                       F.array_join(F.array_sort(F.array_except("b", "a")), "|").alias("only_second"))


@query("f4_newest_tags", lambda: DS + "SELECT tag FROM (SELECT DISTINCT tag FROM day_sets) ORDER BY tag DESC LIMIT 3")
def f4_newest_tags(spark, sf_dir):
    """newest n stored tags (TakeOrderedAndProject)."""
    return S.day_sets(spark, sf_dir).select("tag").distinct().orderBy(F.desc("tag")).limit(3)


@query("f5_distinct_tags_desc", lambda: RR + "SELECT DISTINCT tag FROM result_rows")
def f5_distinct_tags_desc(spark, sf_dir):
    return S.result_rows(spark, sf_dir).select("tag").distinct().orderBy(F.desc("tag"))


@query("a5_tag_lookup", lambda: DS + f"""SELECT frequency, tag, entity_type, CAST(sum(occurrences) AS BIGINT) AS items_amount,
  count(*) AS unique_amount FROM ({ROLLED_SQL}) WHERE frequency = 'daily' AND tag = '2024-01-15' GROUP BY ALL""")
def a5_tag_lookup(spark, sf_dir):
    summ = EN.rollup_summary(_rolled(spark, sf_dir))
    return summ.where((F.col("frequency") == "daily") & (F.col("tag") == "2024-01-15"))


@query("a6_latest_tags", lambda: DS + f"""SELECT tag, entity_type, count(*) AS unique_amount FROM ({ROLLED_SQL})
WHERE tag IN (SELECT DISTINCT tag FROM day_sets ORDER BY tag DESC LIMIT 5) GROUP BY ALL""")
def a6_latest_tags(spark, sf_dir):
    """Latest n tags (newest first) with a projection of their entity sets."""
    summ = EN.rollup_summary(_rolled(spark, sf_dir))
    latest = summ.select("tag").distinct().orderBy(F.desc("tag")).limit(5)
    return summ.join(latest, "tag", "left_semi").select("tag", "entity_type", "unique_amount")


# ---- posts-based entities ---------------------------------------------------------------------------------
def _gazetteer(spark, sf_dir):
    return EN.gazetteer_from_tables(S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region"),
                                    S.table(spark, sf_dir, "supplier"))


GAZ_SQL = f"""SELECT surface, min(entity_type) AS entity_type FROM (
  SELECT {T.capitalize_sql('n_name')} AS surface, 'locations' AS entity_type FROM nation
  UNION ALL SELECT {T.capitalize_sql('r_name')}, 'locations' FROM region
  UNION ALL SELECT {T.capitalize_sql('s_name')}, 'organizations' FROM supplier) GROUP BY surface"""


def _entities_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, item, coalesce(g.entity_type, 'misc') AS entity_type FROM (
  SELECT {keys}, {T.fold_accents_sql('surface')} AS item FROM
   (SELECT {keys}, unnest({EN.capitalised_runs_sql('full_text')}) AS surface FROM ({src}))) s
LEFT JOIN ({GAZ_SQL}) g ON g.surface = s.item"""


@query("h13_entities", lambda: f"""SELECT id, item, entity_type, count(*) AS count FROM ({_entities_sql(S.POSTS_SQL, 'id')})
GROUP BY ALL""")
def h13_entities(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    ents = EN.extract_entities(posts, "full_text", _gazetteer(spark, sf_dir), ["id"])
    return ents.groupBy("id", "item", "entity_type").agg(F.count(F.lit(1)).alias("count"))


def tag_entities(spark, sf_dir, frequency="weekly"):
    """Calendar (H16) → posts per tag (A4) → laughter/stop-word blanking (H9) → hashtags (H12) and
    entities (H13) → roll-up (D17) → variation against the previous stored tag (F1)."""
    posts = S.posts(spark, sf_dir)
    cal = C.tag_calendar(frequency, C.today_after_newest(posts))
    per_tag = K.posts_by_tag(posts, C.tag_dates(cal), S.MAIN_CITY)
    # the fixture's hashtag rewrite (capitalised word → #word) is applied after the selection, so the
    # repeated-text exclusion keys on the stored text (the rewrite is one-to-one on texts)
    per_tag = per_tag.withColumn("full_text", F.regexp_replace("full_text", HASHTAG_RE, "#$1"))
    cleaned = per_tag.withColumn("full_text", T.blank_unwanted("full_text"))
    keys = ["frequency", "tag"]
    # an entity counts once in a tag (G2), a hashtag as often as it is used
    items = (EN.extract_entities(cleaned, "full_text", _gazetteer(spark, sf_dir), keys).distinct()
             .unionByName(EN.extract_hashtag_items(cleaned, "full_text", keys)))
    rolled = EN.rollup(EN.with_all_type(items, keys))
    stored = per_tag.select("frequency", "tag").distinct()
    return rolled, stored


def _p1_sql(frequency="weekly"):
    src = f"""SELECT d.frequency, d.tag, {T.blank_unwanted_sql('full_text')} AS full_text FROM (
  SELECT DISTINCT d.frequency, d.tag, s.full_text FROM ({SELECTED_SQL}) s
  JOIN ({_tag_dates_sql(frequency)}) d ON CAST(s.created_at AS DATE) = d.date) d"""
    src = src.replace("FROM posts", "FROM posts_h")
    items = f"""SELECT DISTINCT frequency, tag, item, entity_type FROM ({_entities_sql(src, 'frequency, tag')})
UNION ALL SELECT frequency, tag, unnest({T.hashtags_sql('full_text')}) AS item, 'hashtags' AS entity_type FROM ({src})"""
    return f"""WITH posts AS ({POSTS_HASHTAGS_SQL}), posts_h AS (SELECT * FROM posts),
it AS ({items}),
it2 AS (SELECT * FROM it UNION ALL SELECT frequency, tag, item, 'all' FROM it WHERE entity_type <> 'hashtags'),
r AS (SELECT frequency, tag, entity_type, item, count(*) AS occurrences FROM it2 GROUP BY ALL),
tg AS (SELECT DISTINCT frequency, tag FROM ({src})),
pv AS (SELECT frequency, tag, lag(tag) OVER (PARTITION BY frequency ORDER BY tag) AS prev_tag FROM tg),
cur AS (SELECT r.frequency, r.tag, r.entity_type, r.item FROM r JOIN pv USING (frequency, tag) WHERE pv.prev_tag IS NOT NULL),
bef AS (SELECT pv.frequency, pv.tag, r.entity_type, r.item FROM r JOIN pv ON r.frequency = pv.frequency AND r.tag = pv.prev_tag),
ad AS (SELECT frequency, tag, entity_type, count(*) AS added FROM (SELECT * FROM cur EXCEPT SELECT * FROM bef) GROUP BY ALL),
rm AS (SELECT frequency, tag, entity_type, count(*) AS removed FROM (SELECT * FROM bef EXCEPT SELECT * FROM cur) GROUP BY ALL),
sm AS (SELECT frequency, tag, entity_type, CAST(sum(occurrences) AS BIGINT) AS items_amount, count(*) AS unique_amount FROM r GROUP BY ALL),
k AS (SELECT frequency, tag, entity_type FROM sm UNION SELECT frequency, tag, entity_type FROM ad
      UNION SELECT frequency, tag, entity_type FROM rm)
SELECT k.frequency, k.tag, k.entity_type, CAST(coalesce(unique_amount, 0) AS BIGINT) AS unique_amount,
  CAST(coalesce(items_amount, 0) AS BIGINT) AS items_amount, CAST(coalesce(added, 0) AS BIGINT) AS added,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed
FROM k LEFT JOIN sm USING (frequency, tag, entity_type) LEFT JOIN ad USING (frequency, tag, entity_type)
LEFT JOIN rm USING (frequency, tag, entity_type)"""


@query("p1_tag_entities", _p1_sql)
def p1_tag_entities(spark, sf_dir):
    rolled, stored = tag_entities(spark, sf_dir)
    return EN.variation_summary(rolled, stored)


@query("p1_tag_items", lambda: _p1_sql().split(",\ntg AS")[0] + "\nSELECT frequency, tag, entity_type, item, occurrences FROM r")
def p1_tag_items(spark, sf_dir):
    """P1 content: every item of every weekly tag, appended to the tag store (A8) and read back."""
    from ..sources import io as IO
    from ..streaming.ingest import read_rollup_store, scratch
    rolled, _ = tag_entities(spark, sf_dir)
    path = scratch(spark, "tags")
    IO.append_partitioned(rolled, path, ("frequency", "tag"))
    return read_rollup_store(spark, path)


@query("d17_tag_items", lambda: DS + ROLLED_SQL)
def d17_tag_items(spark, sf_dir):
    """D17 content in long form: the set is the rows, the list repeats by ``occurrences``."""
    return _rolled(spark, sf_dir)


@query("b13_variation_projection", lambda: _p1_sql() + "\nWHERE k.entity_type IN ('misc', 'hashtags')")
def b13_variation_projection(spark, sf_dir):
    """Projection of the variation to the person-like (misc) and hashtag entity types."""
    rolled, stored = tag_entities(spark, sf_dir)
    return EN.variation_summary(rolled, stored).where(F.col("entity_type").isin("misc", "hashtags"))


@query("d21_word_cloud", lambda: f"""WITH e AS ({_entities_sql(S.POSTS_SQL.replace('doc_id AS id,', 'doc_id AS id, lang AS lg,'), 'id, lg')}),
w AS (SELECT lg AS lang, unnest({T.tokens_sql('item')}) AS word FROM e WHERE entity_type = 'misc'),
c AS (SELECT lang, word, count(*) AS count FROM w WHERE length(word) >= 4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS rank FROM c)
SELECT lang, CAST(rank AS BIGINT) AS rank, word, CAST(count AS BIGINT) AS count,
  count / max(count) OVER (PARTITION BY lang) AS weight FROM r WHERE rank <= 80""")
def d21_word_cloud(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    ents = EN.extract_entities(posts, "full_text", _gazetteer(spark, sf_dir), ["lang"])
    return word_frequencies(ents.where(F.col("entity_type") == "misc"), ["lang"], "item", min_len=4, top=80)


# ---- incremental joins: C1, C2, C6, C8 -----------------------------------------------------------------
@query("c1_missing_tags", lambda: f"""WITH posts AS ({S.POSTS_SQL}),
cal AS ({C.tag_calendar_sql('daily', TODAY_SQL)}),
stored AS (SELECT DISTINCT strftime(CAST(p.created_at AS DATE), '%Y-%m-%d') AS tag FROM posts p JOIN labels l ON l.doc_id = p.id)
SELECT frequency, tag FROM cal WHERE tag NOT IN (SELECT tag FROM stored)""")
def c1_missing_tags(spark, sf_dir):
    """Calendar tags not yet stored.  "Stored" tags are the days that hold an already
    labelled post (the ``labels`` table plays the store)."""
    posts = S.posts(spark, sf_dir)
    cal = C.tag_calendar("daily", C.today_after_newest(posts))
    stored = (posts.join(S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
              .select(F.lit("daily").alias("frequency"), F.date_format(F.to_date("created_at"), "yyyy-MM-dd").alias("tag"))
              .distinct())
    return cal.select("frequency", "tag").join(stored, ["frequency", "tag"], "left_anti")


REGISTRY_EMBEDDERS = [e for k in EMBEDDER_SHORT_NAMES for e in (k, f"{k} (50-d)")]


def combination_grid(tags_df):
    """Tag × embedder × algorithm, newest tag first — the registries are exploded, not joined."""
    return (tags_df.select("frequency", "tag")
            .withColumn("embedder", F.explode(F.array(*[F.lit(e) for e in REGISTRY_EMBEDDERS])))
            .withColumn("algorithm", F.explode(F.array(*[F.lit(a) for a in FIXTURE_ALGORITHMS]))))


def _grid_sql():
    embs = ", ".join(f"('{e}')" for e in REGISTRY_EMBEDDERS)
    algs = ", ".join(f"('{a}')" for a in FIXTURE_ALGORITHMS)
    return f"""grid AS (SELECT t.frequency, t.tag, e.embedder, a.algorithm FROM (SELECT DISTINCT frequency, tag FROM result_rows) t
  CROSS JOIN (VALUES {embs}) e(embedder) CROSS JOIN (VALUES {algs}) a(algorithm))"""


@query("c6_combination_grid", lambda: RR.rstrip("\n") + ", " + _grid_sql() + """
SELECT embedder, algorithm, count(*) AS tags FROM grid GROUP BY ALL""")
def c6_combination_grid(spark, sf_dir):
    grid = combination_grid(S.result_rows(spark, sf_dir).select("frequency", "tag").distinct())
    return grid.groupBy("embedder", "algorithm").agg(F.count(F.lit(1)).alias("tags"))


@query("c2_missing_combinations", lambda: RR.rstrip("\n") + ", " + _grid_sql() + """
SELECT frequency, tag, embedder, algorithm FROM grid g WHERE NOT EXISTS (SELECT 1 FROM result_rows r
  WHERE r.frequency = g.frequency AND r.tag = g.tag AND r.embedder = g.embedder AND r.algorithm = g.algorithm)""")
def c2_missing_combinations(spark, sf_dir):
    """(frequency, tag, embedder, algorithm) combinations not yet computed (left anti on 4 keys)."""
    rows = S.result_rows(spark, sf_dir)
    grid = combination_grid(rows.select("frequency", "tag").distinct())
    return grid.join(rows.select("frequency", "tag", "embedder", "algorithm"),
                     ["frequency", "tag", "embedder", "algorithm"], "left_anti")


@query("c8_new_posts", lambda: f"""SELECT id FROM ({S.POSTS_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)""")
def c8_new_posts(spark, sf_dir):
    """Posts whose id is not stored yet (``labels`` plays the store)."""
    stored = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return S.posts(spark, sf_dir).join(stored, "id", "left_anti").select("id")
