"""Feature, embedding, topic and sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import cooccurrence as CO
from ..operators import features as FE
from ..operators import topics as TP
from ..sources import tables as S
from .q_vectors import _pts
from .registry import query


def _docs(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _counts_sql(min_df, max_df, stop=False, table="documents"):
    toks = FE.word_tokens_sql("text")
    stop_filter = f" WHERE NOT list_contains({L.sql_str_list(L.stopwords())}, term)" if stop else ""
    lo = f"{min_df}" if isinstance(min_df, int) else f"n * {min_df}"
    hi = f"{max_df}" if isinstance(max_df, int) else f"n * {max_df}"
    return f"""WITH t AS (SELECT doc_id, unnest({toks}) AS term FROM {table}),
c AS (SELECT doc_id, term, count(*) AS count FROM t{stop_filter} GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM {table}),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
vocab AS (SELECT term, df, n FROM df, n WHERE df >= {lo} AND df <= {hi})"""


@query("i1_bag_of_words", lambda: _counts_sql(3, 0.85) + "\nSELECT c.doc_id, c.term, c.count FROM c JOIN vocab USING (term)")
def i1_bag_of_words(spark, sf_dir):
    return FE.bag_of_words(_docs(spark, sf_dir), min_df=3, max_df=0.85)


@query("i2_topic_term_counts", lambda: _counts_sql(2, 0.95, stop=True) + "\nSELECT c.doc_id, c.term, c.count FROM c JOIN vocab USING (term)")
def i2_topic_term_counts(spark, sf_dir):
    return FE.bag_of_words(_docs(spark, sf_dir), min_df=2, max_df=0.95, stop_words=L.stopwords())


@query("i3_tfidf", lambda: _counts_sql(3, 0.85) + """,
w AS (SELECT c.doc_id, c.term, c.count * (ln((1 + vocab.n) / (1 + vocab.df)) + 1) AS w FROM c JOIN vocab USING (term))
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w""")
def i3_tfidf(spark, sf_dir):
    return FE.tfidf(_docs(spark, sf_dir), min_df=3, max_df=0.85)


@query("i4_word2vec_vectors")
def i4_word2vec_vectors(spark, sf_dir):
    """I4 (re-aimed): Word2Vec(100, window 5, min count 3) fitted on the main corpus; document means."""
    docs = _docs(spark, sf_dir)
    embed = FE.word2vec_embedder(docs.where(F.col("lang") == S.MAIN_CITY), size=100, window=5, min_count=3)
    return embed(docs).select("doc_id", F.size("features").alias("dim"),
                              F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("i5_subword_vectors")
def i5_subword_vectors(spark, sf_dir):
    """I5 (re-aimed): Word2Vec over tokens and their character 3–6-grams, fitted on the main corpus."""
    docs = _docs(spark, sf_dir)
    embed = FE.word2vec_embedder(docs.where(F.col("lang") == S.MAIN_CITY), size=100, subword=True)
    return embed(docs).select("doc_id", F.size("features").alias("dim"))


@query("i5b_pair_counts", lambda: f"WITH {CO.pair_counts_sql('documents')}\nSELECT * FROM pairs")
def i5b_pair_counts(spark, sf_dir):
    """Words at most 5 tokens apart, of words that occur 5 times or more."""
    return CO.pair_counts(_docs(spark, sf_dir))


@query("i5b_ppmi", lambda: f"WITH {CO.pair_counts_sql('documents')},\n{CO.ppmi_sql()}\nSELECT * FROM weights")
def i5b_ppmi(spark, sf_dir):
    """Positive pointwise mutual information of those pairs."""
    return CO.corpus_ppmi(_docs(spark, sf_dir))


@query("i5b_cooccurrence_vectors")
def i5b_cooccurrence_vectors(spark, sf_dir):
    """Vectors of 100 entries from the main corpus's weights; a document's are the mean of its words'."""
    docs = _docs(spark, sf_dir)
    embed = CO.cooccurrence_embedder(docs.where(F.col("lang") == S.MAIN_CITY), size=100, id_col="doc_id")
    return embed(docs).select("doc_id", F.size("features").alias("dim"),
                              F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("i6_batch_inference")
def i6_batch_inference(spark, sf_dir):
    """Batch inference through ``predict_batch_udf`` (offline feature-hash model)."""
    embed = FE.hashing_embedder(64)
    return embed(_docs(spark, sf_dir)).select("doc_id", F.size("features").alias("dim"),
                                              F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x).alias("sq_norm"))


@query("i8_pca_50")
def i8_pca_50(spark, sf_dir):
    """I8: centre → PCA(50) → standardise; per-dimension variance (sign-free check)."""
    red = FE.pca_reduce(_pts(spark, sf_dir), k=50)
    return red.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(
        F.var_pop("x").alias("variance"), F.avg("x").alias("mean"))


@query("i9_projection_2d")
def i9_projection_2d(spark, sf_dir):
    return FE.projection_2d(_pts(spark, sf_dir, noise=True), drop_noise=True)


def _nb_sql():
    toks = FE.word_tokens_sql("text")
    return f"""WITH tr AS (SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS y FROM documents d JOIN labels l USING (doc_id)),
tok AS (SELECT y, unnest({toks}) AS term FROM tr),
vocab AS (SELECT DISTINCT term FROM tok),
nv AS (SELECT count(*) AS v FROM vocab),
classes AS (SELECT y, count(*) AS nd FROM tr GROUP BY y),
ct AS (SELECT y, term, count(*) AS n FROM tok GROUP BY ALL),
cy AS (SELECT y, sum(n) AS tot FROM ct GROUP BY y),
pri AS (SELECT y, ln(nd + 1.0) - ln((SELECT count(*) FROM tr) + (SELECT count(*) FROM classes) * 1.0) AS pi FROM classes),
theta AS (SELECT ct.y, ct.term, ln(ct.n + 1.0) - ln(cy.tot + nv.v) AS th FROM ct JOIN cy USING (y), nv),
zero AS (SELECT cy.y, - ln(cy.tot + nv.v) AS th0 FROM cy, nv),
dt AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({toks}) AS term FROM documents)
       WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
raw AS (SELECT d.doc_id, c.y, c.pi + coalesce(sum(dt.cnt * coalesce(th.th, z.th0)), 0) AS r
        FROM documents d CROSS JOIN pri c JOIN zero z ON z.y = c.y
        LEFT JOIN dt ON dt.doc_id = d.doc_id LEFT JOIN theta th ON th.y = c.y AND th.term = dt.term
        GROUP BY d.doc_id, c.y, c.pi),
sc AS (SELECT doc_id, 1.0 / (1.0 + exp(max(CASE WHEN y = 0 THEN r END) - max(CASE WHEN y = 1 THEN r END))) AS sentiment
       FROM raw GROUP BY doc_id)"""


@query("l1_sentiment", lambda: _nb_sql() + """
SELECT d.lang, avg(sentiment) AS avg_sentiment, count(*) AS docs FROM sc JOIN documents d USING (doc_id) GROUP BY d.lang""")
def l1_sentiment(spark, sf_dir):
    """L1 + D16: Naive Bayes positive-class probability per post, averaged per cluster (language)."""
    model = TP.sentiment_model(S.training(spark, sf_dir))
    scored = TP.sentiment_scores(model, _docs(spark, sf_dir))
    return TP.average_sentiment(scored, ["lang"])


@query("l1_sentiment_per_post", lambda: _nb_sql() + "\nSELECT doc_id, sentiment FROM sc")
def l1_sentiment_per_post(spark, sf_dir):
    model = TP.sentiment_model(S.training(spark, sf_dir))
    return TP.sentiment_scores(model, _docs(spark, sf_dir)).select("doc_id", "sentiment")


def _topic_docs(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("lang") == S.MAIN_CITY).select("doc_id", "text")


@query("l2_nmf_topics")
def l2_nmf_topics(spark, sf_dir):
    """L2: NMF (Frobenius, 3 topics, alpha .1, l1 ratio .5) on the TF-IDF of the main corpus (terms in 2
    documents or more and 95 % or fewer, no stop words); top 10 words per topic."""
    return TP.topic_registry()["NMF"](_topic_docs(spark, sf_dir), L.stopwords())


@query("l3_plsi_topics")
def l3_plsi_topics(spark, sf_dir):
    """L3: PLSI = NMF with the KL loss (multiplicative updates)."""
    return TP.topic_registry()["PLSI"](_topic_docs(spark, sf_dir), L.stopwords())


@query("l4_lda_topics")
def l4_lda_topics(spark, sf_dir):
    """L4 + L5: online LDA, 3 topics; top 10 words per topic."""
    return TP.lda_topics(_docs(spark, sf_dir).where(F.col("lang") == S.MAIN_CITY), k=3, stop_words=L.stopwords())


@query("l6_topics_per_cluster")
def l6_topics_per_cluster(spark, sf_dir):
    """Topics fitted within each cluster (conversation role plays the cluster)."""
    conv = S.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("cluster"))
    return TP.topics_per_cluster(conv, "cluster", k=10, top=10, max_iter=10)
