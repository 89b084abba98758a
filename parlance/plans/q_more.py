"""More operator queries: sinks/sources (A8, A9, A12, A15), B12, C4, D18, D19, F12–F14, J12, P5–P7."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as EN
from ..operators import features as FE
from ..operators import quality as Q
from ..sources import io as IO
from ..sources import tables as S
from ..streaming.ingest import read_rollup_store, scratch
from .q_entities import GAZ_SQL, ROLLED_SQL, _entities_sql, _gazetteer
from .q_features import _counts_sql
from .q_reports import RR
from .q_vectors import V, VN, _pts
from .registry import query


@query("b12_noise_filter", lambda: f"SELECT label, count(*) AS size FROM ({VN}) WHERE label <> -1 GROUP BY label")
def b12_noise_filter(spark, sf_dir):
    return (_pts(spark, sf_dir, noise=True).where(F.col("label") != -1)
            .groupBy("label").agg(F.count(F.lit(1)).alias("size")))


@query("c4_cluster_members", lambda: f"""SELECT v.label, d.doc_id, d.text
FROM ({V}) v JOIN documents d ON d.doc_id = v.doc_id WHERE v.label <> -1""")
def c4_cluster_members(spark, sf_dir):
    """C4: labels joined to their texts by id (never by position), noise out."""
    labels = _pts(spark, sf_dir).select(F.col("id").alias("doc_id"), "label").where(F.col("label") != -1)
    return labels.join(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("label", "doc_id", "text")


@query("d18_entity_lists", lambda: f"""SELECT entity_type, item, count(*) AS occurrences
FROM ({_entities_sql(S.POSTS_SQL, 'id')}) GROUP BY entity_type, item""")
def d18_entity_lists(spark, sf_dir):
    """The entity list of each type in long form; the set is the rows, the list repeats by ``occurrences``."""
    ents = EN.extract_entities(S.posts(spark, sf_dir), "full_text", _gazetteer(spark, sf_dir), ["id"])
    return ents.groupBy("entity_type", "item").agg(F.count(F.lit(1)).alias("occurrences"))


@query("d19_arg_best", lambda: RR + """SELECT algorithm, embedder, n_clusters AS best_k, sil AS best_silhouette FROM (
  SELECT *, row_number() OVER (PARTITION BY algorithm, embedder ORDER BY sil DESC NULLS LAST, n_clusters) AS r
  FROM (SELECT algorithm, embedder, n_clusters, avg(sil_score) AS sil FROM result_rows GROUP BY ALL)) WHERE r = 1""")
def d19_arg_best(spark, sf_dir):
    """Per (algorithm, embedder) the k with the highest mean silhouette (smallest k on ties)."""
    rows = S.result_rows(spark, sf_dir)
    per_k = rows.groupBy("algorithm", "embedder", "n_clusters").agg(F.avg("sil_score").alias("sil"))
    w = Window.partitionBy("algorithm", "embedder").orderBy(F.desc_nulls_last("sil"), "n_clusters")
    return (per_k.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("algorithm", "embedder", F.col("n_clusters").alias("best_k"), F.col("sil").alias("best_silhouette")))


@query("f12_top_words", lambda: _counts_sql(3, 0.85) + """,
w AS (SELECT c.doc_id, c.term, c.count * (ln((1 + vocab.n) / (1 + vocab.df)) + 1) AS w FROM c JOIN vocab USING (term)),
x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w),
tw AS (SELECT d.lang AS topic, x.term, sum(x.tfidf) AS weight FROM x JOIN documents d USING (doc_id) GROUP BY ALL)
SELECT topic, CAST(rank AS INTEGER) AS rank, term, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM tw) WHERE rank <= 10""")
def f12_top_words(spark, sf_dir):
    """top 10 terms per topic by weight (language plays the topic, summed TF-IDF the weight)."""
    from ..operators.topics import top_words
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tf = FE.tfidf(docs, min_df=3, max_df=0.85).join(docs.select("doc_id", "lang"), "doc_id")
    weights = tf.groupBy(F.col("lang").alias("topic"), "term").agg(F.sum("tfidf").alias("weight"))
    return top_words(weights, 10).withColumn("rank", F.col("rank").cast("int"))


@query("f13_first_members", lambda: f"""SELECT label, doc_id FROM (SELECT label, doc_id,
  row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM ({V})) WHERE r <= 3""")
def f13_first_members(spark, sf_dir):
    """the first m members of each cluster (bounded window: partial group limit before the shuffle)."""
    v = _pts(spark, sf_dir).select("label", F.col("id").alias("doc_id"))
    w = Window.partitionBy("label").orderBy("doc_id")
    return v.withColumn("_r", F.row_number().over(w)).where("_r <= 3").select("label", "doc_id")


@query("f14_sample")
def f14_sample(spark, sf_dir):
    """one reproducible random post per city (seeded hash order, top-1 per group)."""
    p = S.posts(spark, sf_dir)
    w = Window.partitionBy("city_tag").orderBy(F.xxhash64("id", F.lit(12345678)), "id")
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("city_tag", "id")


@query("a8_a9_tag_store", lambda: "WITH day_sets AS (" + S.DAY_SETS_SQL + f""")
SELECT frequency, tag, entity_type, CAST(sum(occurrences) AS BIGINT) AS items_amount, count(*) AS unique_amount
FROM ({ROLLED_SQL}) GROUP BY ALL""")
def a8_a9_tag_store(spark, sf_dir):
    """A8 append (partitioned by frequency, tag) then A9 replace of the tags written twice."""
    ds = S.day_sets(spark, sf_dir).withColumn("frequency", F.lit("daily"))
    rolled = EN.rollup(ds)
    path = scratch(spark, "tagstore")
    first_half = rolled.where(F.col("tag") < "2024-01-16")
    IO.append_partitioned(first_half.where(F.col("tag") < "2024-01-10"), path, ("frequency", "tag"))
    IO.append_partitioned(rolled.where(F.col("tag") >= "2024-01-10"), path, ("frequency", "tag"))
    IO.replace_partitions(first_half, path)           # re-written tags replace, never duplicate
    return EN.rollup_summary(read_rollup_store(spark, path))


@query("a12_markdown_sink", lambda: RR + """, r AS (SELECT DISTINCT algorithm, embedder, n_clusters, success FROM result_rows)
SELECT '| algorithm | embedder | n_clusters | success |' AS value UNION ALL SELECT '|---|---|---|---|'
UNION ALL SELECT '| ' || algorithm || ' | ' || embedder || ' | ' || n_clusters || ' | ' || success || ' |' FROM r""")
def a12_markdown_sink(spark, sf_dir):
    """A report written as a Markdown table (header, rule, one line per row) and read back line by line."""
    rep = S.result_rows(spark, sf_dir).select("algorithm", "embedder", "n_clusters", "success").distinct()
    path = scratch(spark, "markdown")
    IO.write_markdown(rep, path)
    return spark.read.text(path)


def _matrix_sql():
    return "SELECT doc_id, " + ", ".join(f"features[{i + 1}] AS x{i}" for i in range(64)) + f" FROM ({V})"


@query("a15_matrix_csv", _matrix_sql)
def a15_matrix_csv(spark, sf_dir):
    """A headerless numeric CSV (the id and all 64 dimensions of the vectors) read back with a schema."""
    v = _pts(spark, sf_dir)
    path = scratch(spark, "matrix")
    names = [f"x{i}" for i in range(64)]
    v.select("id", *[F.col("features")[i].alias(c) for i, c in enumerate(names)]).write.csv(path)
    return IO.read_matrix_csv(spark, path, ["doc_id", *names]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("j12_dbscan_sweep")
def j12_dbscan_sweep(spark, sf_dir):
    """One runner over a parameter grid — DBSCAN eps × min_samples — recording the cluster-length table
    size (D13) and the silhouette (K1) of each setting.  All settings share their pair passes."""
    from ..clustering.dbscan import dbscan_many
    from ..session import cut_lineage
    pts = cut_lineage(_pts(spark, sf_dir).drop("label"))
    grid = [(eps, ms) for eps in (1.10, 1.15, 1.20) for ms in (5, 10)]
    labels = cut_lineage(dbscan_many(pts, grid))
    shape = Q.cluster_stats(labels.select("setting", "id", "label"), ["setting"])
    sil = dbscan_silhouettes(pts, labels, len(grid))
    settings = spark.createDataFrame([(k, e, m) for k, (e, m) in enumerate(grid)], "setting int, eps double, min_samples int")
    out = settings.join(shape, "setting", "left").join(sil, "setting", "left")         # a row a setting
    return out.select("eps", "min_samples", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
                      F.coalesce("noise_amount", F.lit(0)).alias("noise_amount"), "silhouette")


def dbscan_silhouettes(pts, labels, settings: int):
    """(setting, silhouette) of the points that are no noise in a setting of ``labels`` (setting, id, label)."""
    # an entry a setting; an id that is many rows of the points is as many in each setting
    of = labels.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("setting", "label"))).alias("_l"),
                                  (F.count(F.lit(1)) / settings).cast("int").alias("_n"))
    own = F.array(*[F.when(F.col("_l")[F.lit(k)] != -1, F.col("_l")[F.lit(k)]) for k in range(settings)])
    members = pts.join(of, "id").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("id", "features", own.alias("labels"))
    return Q.silhouettes(members, settings).withColumnRenamed("labelling", "setting")


# ---- C11 nearest place -----------------------------------------------------------------------------------
RADIUS_KM = 2000.0
CUST_LAT, CUST_LON = "((c_custkey * 37) % 1200) / 10.0 - 60", "((c_custkey * 91) % 3600) / 10.0 - 180"
NATION_LAT, NATION_LON = "n_nationkey * 4.7 - 58", "n_nationkey * 14.0 - 170"


@query("c11_nearest_place", lambda: f"""WITH c AS (SELECT c_custkey AS pid, {CUST_LAT} AS lat, {CUST_LON} AS lon FROM customer),
p AS (SELECT CAST(n_nationkey AS BIGINT) AS place_id, {NATION_LAT} AS lat, {NATION_LON} AS lon FROM nation),
d AS (SELECT c.pid, p.place_id, {__import__('parlance.operators.geo', fromlist=['x']).haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')} AS distance_km FROM c CROSS JOIN p)
SELECT pid, place_id, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance_km, place_id) AS r
  FROM d WHERE distance_km <= {RADIUS_KM}) WHERE r = 1""")
def c11_nearest_place(spark, sf_dir):
    """C11: customers (synthetic coordinates from the key) to the nearest nation centre within 2000 km."""
    from ..operators.geo import nearest_place
    c = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"),
                                                  F.expr(CUST_LAT).alias("lat"), F.expr(CUST_LON).alias("lon"))
    p = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"),
                                                F.expr(NATION_LAT).alias("lat"), F.expr(NATION_LON).alias("lon"))
    return nearest_place(c, p, RADIUS_KM)


@query("h14_normalise_tokens", lambda: f"""WITH t AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, {T.tokens_sql(T.clean_v2_sql('text'))} AS toks FROM documents)),
lem AS (SELECT token, lemma FROM (SELECT token, {__import__('parlance.operators.normalise', fromlist=['x']).light_stem_sql('token')} AS lemma
        FROM (SELECT DISTINCT token FROM t)) WHERE lemma <> token)
SELECT doc_id, string_agg(coalesce(lem.lemma, t.token), ' ' ORDER BY pos) AS text FROM t LEFT JOIN lem USING (token)
GROUP BY doc_id""")
def h14_normalise_tokens(spark, sf_dir):
    """Cleaned texts with every token mapped through the vocabulary's lemma table."""
    from ..operators.normalise import normalise
    docs = S.table(spark, sf_dir, "documents").select("doc_id", T.clean_v2("text").alias("text"))
    return normalise(docs)


# ---- composites P5–P7 and A10 ---------------------------------------------------------------------------
def _posts_modes(spark, sf_dir):
    """B5 city modes: the main city and all cities, as a ``mode`` column (union, not a loop)."""
    from ..operators import corpus as K
    posts = S.posts(spark, sf_dir)
    sel = K.select_posts(posts)
    return (sel.where(F.col("city_tag") == S.MAIN_CITY).withColumn("mode", F.lit(S.MAIN_CITY))
            .unionByName(sel.withColumn("mode", F.lit("all"))))


@query("p5_embedding_measurement")
def p5_embedding_measurement(spark, sf_dir):
    """P5: city modes (B5) → cleaner v1 (H8) → distinct (G1) → embedder (I6) → norm statistics
    per (mode, embedder)."""
    modes = _posts_modes(spark, sf_dir)
    corpus = (modes.select("mode", T.clean_v1("full_text").alias("text")).where(F.length("text") > 0)
              .dropDuplicates(["mode", "text"]).withColumn("id", F.xxhash64("mode", "text")))
    vec = FE.hashing_tf_embedder(64)(corpus).withColumn("embedder", F.lit("Hash 64"))
    return Q.norm_stats(vec, ["mode", "embedder"])


@query("p6_word2vec_sweep")
def p6_word2vec_sweep(spark, sf_dir):
    """Document-vector sweep (vector size × window) on the main corpus, each setting projected to 2-d
    (I9); returns the spread of each projection."""
    from ..operators import corpus as K
    from ..session import cut_lineage
    posts = S.posts(spark, sf_dir)
    corpus = cut_lineage(K.clean_corpus(K.select_posts(posts, city=S.MAIN_CITY), "full_text").withColumn("id", F.xxhash64("text")))
    out = None
    for size in (50, 100, 200):
        for window in (3, 5, 7):
            vec = FE.word2vec_embedder(corpus, size=size, window=window, min_count=3)(corpus)
            proj = FE.projection_2d(vec.withColumn("label", F.lit(0)))
            part = proj.agg(F.stddev_pop("x").alias("sd_x"), F.stddev_pop("y").alias("sd_y"),
                            F.count(F.lit(1)).alias("docs")).select(
                F.lit(size).alias("size"), F.lit(window).alias("window"), "sd_x", "sd_y", "docs")
            out = part if out is None else out.unionByName(part)
    return out


FIRST_MEMBERS = 15           # of a cluster that P7 shows


@query("p7_kmeans_topics")
def p7_kmeans_topics(spark, sf_dir):
    """Filtered text (A2) → cleaner v1 (H8) → embedder (I6) → k-means (J1) → silhouette and inertia
    (K1, K4) → members (C4) → first members (F13) → topics per cluster (L6: 10 topics × 10 words of each model).
    A cluster without topics is one row."""
    from ..clustering import kmeans as KM
    from ..operators import corpus as K
    from ..operators.topics import topic_registry
    from ..session import cut_lineage
    posts = S.posts(spark, sf_dir)
    # a key of each row's own: post ids may repeat
    corpus = cut_lineage(K.text_of_posts(posts).select("id", T.clean_v1("full_text").alias("text"))
                         .where(F.length("text") > 0).withColumn("row", F.monotonically_increasing_id()))
    vec = cut_lineage(FE.hashing_tf_embedder(64)(corpus.select(F.col("row").alias("id"), "text")).select("id", "features"))
    labels, _ = KM.kmeans(vec, 5)
    return kmeans_topics(corpus, vec, cut_lineage(labels), tuple(topic_registry()))


def kmeans_topics(corpus, vec, labels, models):
    """(cluster, size, first_members, silhouette, inertia, model, topic, rank, term, weight) of texts (id, text, row) that were clustered:
    ``vec`` (id, features) and ``labels`` (id, label, sqdist) by their row."""
    from ..operators.topics import topics_per_cluster
    from ..session import cut_lineage
    scores = Q.silhouette(vec.join(labels.select("id", "label"), "id")).crossJoin(                     # K1, K4: a row each
        labels.agg(F.sum("sqdist").alias("inertia")))
    members = cut_lineage(labels.select(F.col("id").alias("row"), F.col("label").alias("cluster")).join(corpus, "row"))   # C4
    w = Window.partitionBy("cluster").orderBy("id", "row")
    first = (members.select("cluster", "id", "row").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= FIRST_MEMBERS)   # F13
             .groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda m: m["id"]).alias("first_members")))
    clusters = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(first, "cluster").crossJoin(F.broadcast(scores))
    topics = topics_per_cluster(members.select(F.col("row").alias("doc_id"), "text", "cluster"), "cluster", k=10, top=10, max_iter=20, models=models)
    return clusters.join(topics, "cluster", "left").select(
        "cluster", "size", "first_members", "silhouette", "inertia", "model", "topic", "rank", "term", "weight")


A10_ALGORITHMS = ("K-Means", "DBSCAN")       # the first finds clusters in every tag, the second none at its default radius


@query("a10_result_rows_store")
def a10_result_rows_store(spark, sf_dir):
    """A10: full result rows (success and failure shape, themes and sentiment maps) appended to a store
    partitioned by frequency and read back; a second run finds nothing left to compute (C2)."""
    from .cluster_tags import cluster_tags, without_computed
    rows = cluster_tags(spark, sf_dir, algorithms=A10_ALGORITHMS)["rows"]
    path = scratch(spark, "results")
    IO.append_partitioned(rows, path, ("frequency",))
    back = spark.read.schema(rows.schema).parquet(path)
    left = None
    for name in A10_ALGORITHMS:
        todo = without_computed(back.select("frequency", "tag", "embedder"), name, back)
        left = todo if left is None else left.unionByName(todo)
    return (back.drop("time").withColumn("theme_clusters", F.size(F.coalesce("themes", F.create_map().cast("map<int,array<string>>"))))
            .drop("themes", "sentiment").unionByName(left.withColumn("success", F.lit(None).cast("boolean")), allowMissingColumns=True))


# ---- G4, G5 ---------------------------------------------------------------------------------------------
def _vocab_parts():
    from ..functions import lexicon as LX
    base = set(LX.spark_default_stopwords("spanish")) | set(LX.EXTRA_STOPWORDS)
    folded = {LX.fold_accents_py(w) for w in base} - base
    laughter = {LX.LAUGHTER_STOP_SEED * i for i in range(1, LX.LAUGHTER_STOP_MAX + 1)} - base - folded
    return [("stopword", sorted(base)), ("folded", sorted(folded)), ("laughter", sorted(laughter))]


def _g4_sql():
    from ..functions import lexicon as LX
    parts = " UNION ALL ".join(f"SELECT '{name}' AS source, unnest({LX.sql_str_list(words)}) AS word"
                               for name, words in _vocab_parts())
    return f"""WITH v AS ({parts}),
t AS (SELECT unnest({T.tokens_sql(T.fold_accents_sql('lower(text)'))}) AS word FROM documents)
SELECT v.source, count(*) AS tokens FROM t JOIN v USING (word) GROUP BY v.source"""


@query("g4_vocabulary_union", _g4_sql)
def g4_vocabulary_union(spark, sf_dir):
    """The stop-word vocabulary as a union of small frames (stop words ∪ folded ∪ laughter),
    broadcast-joined to the corpus tokens; tokens counted per part."""
    vocab = None
    for name, words in _vocab_parts():
        part = spark.createDataFrame([(name, w) for w in words], "source string, word string")
        vocab = part if vocab is None else vocab.unionByName(part)
    toks = S.table(spark, sf_dir, "documents").select(F.explode(T.tokens(T.fold_accents(F.lower("text")))).alias("word"))
    return toks.join(F.broadcast(vocab.distinct()), "word").groupBy("source").agg(F.count(F.lit(1)).alias("tokens"))


@query("g5_embedder_union")
def g5_embedder_union(spark, sf_dir):
    """Base and reduced (50-d) embedders unioned by name; norm statistics per embedder."""
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    base = FE.hashing_tf_embedder(64)(docs).withColumn("embedder", F.lit("Hash 64"))
    reduced = FE.pca_reduce(base.drop("embedder"), k=50).withColumn("embedder", F.lit("Hash 64 (50-d)"))
    both = base.select("id", "features", "embedder").unionByName(reduced.select("id", "features", "embedder"))
    return Q.norm_stats(both, ["embedder"])


@query("n3_topic_models", lambda: "SELECT * FROM (VALUES (0, 'NMF'), (1, 'PLSI'), (2, 'LDA')) t(position, model), (SELECT DISTINCT lang FROM documents) d")
def n3_topic_models(spark, sf_dir):
    """The topic models by name, offered for each language of the corpus."""
    from ..operators.topics import topic_registry
    langs = S.table(spark, sf_dir, "documents").select("lang").distinct()
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("model")) for i, n in enumerate(topic_registry())])
    return langs.withColumn("m", F.explode(names)).select("m.position", "m.model", "lang")
