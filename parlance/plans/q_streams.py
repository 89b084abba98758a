"""Streaming queries (M1–M4): each drains a file stream over the driver's folder with the
``availableNow`` trigger into a sink under the checkpoint folder and returns the sink as a batch
frame; the SQL twin is the batch result the drained sink must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as EN
from ..sources import tables as S
from ..streaming import ingest as M
from .registry import query


def _stream(spark, sf_dir, name):
    return M.file_stream(spark, sf_dir, name, S.table(spark, sf_dir, name).schema)


@query("m1_ingest", lambda: f"""SELECT id, city_tag FROM ({S.POSTS_SQL}) p
WHERE NOT starts_with(full_text, 'RT @') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)""")
def m1_ingest(spark, sf_dir):
    posts = S.posts_from(_stream(spark, sf_dir, "documents"))
    store = M.scratch(spark, "m1-store")
    stored = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    q = M.ingest(posts, store, stored, None, M.scratch(spark, "m1-ckpt"))
    q.awaitTermination()
    return spark.read.parquet(store).select("id", "city_tag")


def _m2_sql(limit):
    return f"""WITH p AS (SELECT id, city_tag, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = q.id) AS is_new
                 FROM ({S.POSTS_SQL}) q),
o AS (SELECT *, row_number() OVER (PARTITION BY city_tag ORDER BY id) - 1 AS pos FROM p),
s AS (SELECT *, coalesce(max(CASE WHEN is_new THEN pos END) OVER (PARTITION BY city_tag ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS prev_new FROM o),
st AS (SELECT city_tag, min(pos) AS stop FROM s WHERE NOT is_new AND pos - prev_new >= {limit} GROUP BY city_tag)
SELECT s.city_tag, s.id, CAST(s.pos AS BIGINT) AS pos FROM s LEFT JOIN st USING (city_tag)
WHERE s.is_new AND (st.stop IS NULL OR s.pos < st.stop)"""


def _m2(spark, sf_dir, limit):
    posts = S.posts(spark, sf_dir)
    stored = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("_s"))
    flagged = posts.join(stored, "id", "left").withColumn("is_new", F.col("_s").isNull())
    return M.early_stop(flagged, "is_new", limit=limit).select("city_tag", "id", "pos")


@query("m2_early_stop", lambda: _m2_sql(30))
def m2_early_stop(spark, sf_dir):
    """M2 with the original limit of 30 consecutive duplicates (stored posts play the duplicates)."""
    return _m2(spark, sf_dir, 30)


@query("m2_early_stop_limit3", lambda: _m2_sql(3))
def m2_early_stop_limit3(spark, sf_dir):
    return _m2(spark, sf_dir, 3)


def _m3_sql(unit, width):
    return f"""WITH p AS ({S.POSTS_SQL}),
w AS (SELECT date_trunc('{unit}', created_at) AS window_start, count(*) AS posts FROM p GROUP BY 1)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(window_start + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS window_end, posts FROM w
WHERE window_start + INTERVAL {width} <= (SELECT max(created_at) FROM p)"""


def _m3(spark, sf_dir, frequency):
    posts = S.posts_from(_stream(spark, sf_dir, "documents"))
    store = M.scratch(spark, f"m3-{frequency}")
    M.count_windows(posts, store, frequency, M.scratch(spark, "m3-ckpt")).awaitTermination()
    today = S.posts(spark, sf_dir).agg(F.max("created_at")).first()[0]     # the newest post plays "now"
    res = M.closed_windows(spark, store, frequency, today)
    return res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "posts")


@query("m3_daily_windows", lambda: _m3_sql("day", "1 DAY"))
def m3_daily_windows(spark, sf_dir):
    return _m3(spark, sf_dir, "daily")


@query("m3_weekly_windows", lambda: _m3_sql("week", "7 DAY"))
def m3_weekly_windows(spark, sf_dir):
    return _m3(spark, sf_dir, "weekly")


@query("m3_monthly_windows", lambda: _m3_sql("month", "1 MONTH"))
def m3_monthly_windows(spark, sf_dir):
    return _m3(spark, sf_dir, "monthly")


@query("m4_incremental_rollup", lambda: f"""WITH d AS ({S.DAY_SETS_SQL})
SELECT 'daily' AS frequency, tag, entity_type, CAST(sum(c) AS BIGINT) AS items_amount, count(*) AS unique_amount
FROM (SELECT tag, entity_type, item, count(*) AS c FROM d GROUP BY ALL) GROUP BY ALL""")
def m4_incremental_rollup(spark, sf_dir):
    """M4: stream of day sets; each batch recomputes only the tags it touches (A9 overwrite)."""
    items = S.day_sets_from(_stream(spark, sf_dir, "events")).withColumn("frequency", F.lit("daily"))
    store = M.scratch(spark, "m4-store")
    q = M.incremental_rollup(items, store, M.scratch(spark, "m4-ckpt"))
    q.awaitTermination()
    return EN.rollup_summary(M.read_rollup_store(spark, store))
