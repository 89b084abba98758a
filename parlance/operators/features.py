"""Text features and embedders: I1–I6, I8–I10 (I7 lives in ``quality.standardise``).

Term statistics are computed in *long form* — (doc, term, count) rows — with
ordinary aggregations (document frequency is one shuffle by term, row norms one
by document), so the vocabulary never has to fit in a dense vector.  The
``pyspark.ml`` stages (CountVectorizer, Word2Vec, PCA, ...) are used where a
fitted model is the product.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, PCA, RegexTokenizer, StopWordsRemover, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.lexicon import RANDOM_SEED
from ..session import cut_lineage

WORD_RE = r"[\p{L}\p{N}_]{2,}"   # sklearn-style tokens: 2+ word characters
SENT_WORDS = 1_000_000             # rows of a vocabulary that are sent to the tasks
TRAINED_CHARS = 8_000_000          # text that one task trains word vectors on


def word_tokens(col) -> "F.Column":
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD_RE})"), 1)


def word_tokens_sql(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '({WORD_RE})', 1)"


def term_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_words=None) -> DataFrame:
    """(doc_id, term, count) for every document."""
    # the texts move once, by their id: no exploded row does
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).repartition("doc_id")
    toks = dealt.select("doc_id", F.explode(word_tokens(F.col("_text"))).alias("term"))
    if stop_words:
        toks = toks.where(~F.col("term").isin(list(stop_words)))
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, n_docs_df: DataFrame, min_df: float, max_df: float) -> DataFrame:
    """Terms whose document frequency is within [min_df, max_df]; an int bound is a document count, a
    float bound a fraction of the documents (sklearn convention).  ``n_docs_df``: one row ``n``."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lo = F.lit(min_df) if isinstance(min_df, int) else F.col("n") * min_df
    hi = F.lit(max_df) if isinstance(max_df, int) else F.col("n") * max_df
    return _with_n(df, n_docs_df).where((F.col("df") >= lo) & (F.col("df") <= hi))


def _with_n(df: DataFrame, n_docs_df: DataFrame) -> DataFrame:
    """Attach the one-row document count by a key join (the one-row side is broadcast: size 1)."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(n_docs_df.withColumn("_k", F.lit(1))), "_k").drop("_k")


def sent(words: DataFrame) -> DataFrame:
    """A table with a row a word, written; up to ``SENT_WORDS`` rows are sent to the tasks that join it, more are shuffled."""
    words = cut_lineage(words)
    return F.broadcast(words) if words.count() <= SENT_WORDS else words


def bag_of_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_df=3, max_df=0.85,
                 stop_words=None) -> DataFrame:
    """I1 / I2 long form: counts of vocabulary terms per document."""
    counts = term_counts(docs, text_col, id_col, stop_words)
    n = docs.select(F.countDistinct(id_col).alias("n"))
    vocab = sent(vocabulary(counts, n, min_df, max_df).select("term"))
    return counts.join(vocab, "term")


def tfidf(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_df=3, max_df=0.85,
          stop_words=None) -> DataFrame:
    """Smooth idf = ln((1 + n) / (1 + df)) + 1, tf = raw count, rows L2-normalised."""
    counts = term_counts(docs, text_col, id_col, stop_words)
    n = docs.select(F.countDistinct(id_col).alias("n"))
    vocab = vocabulary(counts, n, min_df, max_df)
    idf = sent(vocab.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    w = counts.join(idf, "term").withColumn("w", F.col("count") * F.col("idf")).where("doc_id IS NOT NULL")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", (F.col("w") / norm).alias("tfidf"))


# ---- fitted models --------------------------------------------------------------------------------------
def count_pipeline(min_df=3.0, max_df=0.85, stop_words=None, vocab_size=2 ** 31 - 1) -> Pipeline:
    """``max_df=None`` keeps every frequent term.  Note Spark's convention: a bound ≥ 1 is a document
    count, a bound in [0, 1) a fraction."""
    """I1/I2 as ``pyspark.ml`` stages (model form, vectors for downstream estimators)."""
    stages = [RegexTokenizer(inputCol="text", outputCol="_toks", pattern=f"({WORD_RE})", gaps=False,
                             toLowercase=True)]
    col = "_toks"
    if stop_words:
        stages.append(StopWordsRemover(inputCol=col, outputCol="_toks2", stopWords=list(stop_words),
                                       caseSensitive=True))
        col = "_toks2"
    cv = CountVectorizer(inputCol=col, outputCol="features", minDF=min_df, vocabSize=vocab_size)
    if max_df is not None:
        cv.setMaxDF(max_df)
    stages.append(cv)
    return Pipeline(stages=stages)


def training_tasks(corpus: DataFrame, text_col: str = "text", subword: bool = False) -> int:
    """How many tasks train a Word2Vec model of the texts: one for every ``TRAINED_CHARS`` code points (a token with its grams is about
    sixteen items, so fewer with ``subword``), one at least.  One row comes back."""
    chars = corpus.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-chars // (TRAINED_CHARS // 16 if subword else TRAINED_CHARS)))


def word2vec_embedder(corpus: DataFrame, text_col: str = "text", size: int = 100, window: int = 5,
                      min_count: int = 3, seed: int = RANDOM_SEED, subword: bool = False):
    """I4 (re-aimed document vectors) / I5 (subword vectors): Word2Vec over whitespace tokens (plus
    character 3–6-grams of each token with ``subword``); a document is the mean of its word vectors.
    A corpus of more than ``TRAINED_CHARS`` is trained by several tasks whose vectors are averaged (``Word2Vec``'s ``numPartitions``)."""
    from ..functions.text import tokens
    toks = tokens(F.col(text_col))
    if subword:
        grams = F.flatten(F.transform(toks, lambda t: F.concat(
            F.array(t),
            F.flatten(F.transform(F.sequence(F.lit(3), F.lit(6)), lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(F.concat(F.lit("<"), t, F.lit(">"))) - n + 1, F.lit(0))),
                lambda i: F.substring(F.concat(F.lit("<"), t, F.lit(">")), i, n)))))))
        toks = F.filter(grams, lambda x: F.length(x) > 0)
    data = corpus.withColumn("_toks", toks)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="_toks",
                     outputCol="_vec", maxIter=1, numPartitions=training_tasks(corpus, text_col, subword)).fit(data)

    def embed(df: DataFrame) -> DataFrame:
        out = model.transform(df.withColumn("_toks", toks))
        return out.withColumn("features", vector_to_array("_vec")).drop("_toks", "_vec")
    return embed


def hashing_embedder(dim: int = 64, seed: int = RANDOM_SEED):
    """Batch inference surface (``predict_batch_udf``) with an offline model — signed feature
    hashing of word tokens, L2-normalised.  A real model plugs in through the same ``make_predict_fn``."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    def make_predict_fn():
        import re
        word = re.compile(r"[^\W_]{2,}|_{2,}", re.UNICODE)

        def predict(texts: np.ndarray) -> np.ndarray:
            import zlib
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in word.findall(str(t).lower()):
                    h = zlib.crc32(w.encode("utf-8")) ^ seed
                    out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(n == 0, 1.0, n)
        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=256)

    def embed(df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn("features", udf(F.col(text_col)))
    return embed


def hashing_tf_embedder(dim: int = 64, text_col: str = "text"):
    """The default embedder: hashed term counts (``HashingTF``) of the word tokens, L2-normalised, in the JVM."""
    from pyspark.ml.feature import HashingTF, Normalizer

    def embed(df: DataFrame) -> DataFrame:
        toks = df.withColumn("_toks", word_tokens(F.col(text_col)))
        tf = HashingTF(numFeatures=dim, inputCol="_toks", outputCol="_tf").transform(toks)
        out = Normalizer(inputCol="_tf", outputCol="_v").transform(tf)
        return out.withColumn("features", vector_to_array("_v")).drop("_toks", "_tf", "_v")
    return embed


def pca_reduce(points: DataFrame, k: int = 50, standardise_after: bool = True) -> DataFrame:
    """I8: centre, PCA(k) (Spark's PCA does not centre), then standardise again."""
    from .quality import standardise
    centred = standardise_means(points)
    vec = centred.withColumn("_v", array_to_vector("features"))
    k = min(k, len(points.select("features").first()[0]))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    out = model.transform(vec).withColumn("features", vector_to_array("_p")).drop("_v", "_p")
    return standardise(out) if standardise_after else out


def standardise_means(points: DataFrame) -> DataFrame:
    """Subtract the per-dimension mean (a one-row mean vector joined back)."""
    from pyspark.ml.stat import Summarizer
    mean = points.select(array_to_vector("features").alias("_v")).agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mu"))
    j = points.withColumn("_k", F.lit(1)).join(F.broadcast(mean.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return j.withColumn("features", F.zip_with("features", "_mu", lambda x, m: x - m)).drop("_mu")


def projection_2d(points: DataFrame, drop_noise: bool = False) -> DataFrame:
    """(id, x, y, label) — PCA(2) of the centred vectors, optionally without noise."""
    pts = points.where(F.col("label") != -1) if drop_noise else points
    p = pca_reduce(pts, k=2, standardise_after=False)
    return p.select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), "label")


# Embedder registry — name → factory(corpus) → embed(df).  "(50-d)" variants add I8.
def embedder_registry() -> dict:
    base = {
        "Hash 64": lambda corpus: hashing_tf_embedder(64),
        "Word2Vec 100": lambda corpus: word2vec_embedder(corpus, size=100),
        "Subword 100": lambda corpus: word2vec_embedder(corpus, size=100, subword=True),
    }
    reg = dict(base)
    for name, make in base.items():
        def reduced(corpus, make=make):
            emb = make(corpus)
            return lambda df: pca_reduce(emb(df).withColumn("id", F.col("doc_id")), k=50)
        reg[f"{name} (50-d)"] = reduced
    return reg
