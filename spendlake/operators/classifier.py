"""Naive Bayes over TF-IDF of words, bigrams and trigrams, as a pyspark.ml pipeline."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.text import normalize_description
from spendlake.operators.ranking import top_k
from spendlake.session import checkpoint_dir
from spendlake.sources import store


def ngrams(words: Column) -> Column:
    """The words, then their bigrams and trigrams."""
    n = F.size(words)

    def grams(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        return F.when(
            n >= k, F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(k))))
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(words, grams(2), grams(3))


def with_terms(df: DataFrame) -> DataFrame:
    """Add ``terms``. The words are a column of their own, so that no n-gram cleans and cuts the text again."""
    words = F.regexp_extract_all(F.lower("_normal"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    cleaned = df.withColumn("_normal", normalize_description(F.col("description"))).withColumn("_words", words)
    return cleaned.withColumn("terms", ngrams(F.col("_words"))).drop("_normal", "_words")


def train(labelled: DataFrame, max_features: int = 5000, min_df: int = 2, max_df: float = 0.95, smoothing: float = 0.1) -> PipelineModel | None:
    """Fit on (description, category, subcategory); None with fewer than two labels.

    Every step of the fit reads all rows, so their terms are made once and stored.
    """
    rows = with_terms(labelled).select("terms", F.concat_ws("|", "category", "subcategory").alias("label_text"))
    rows = store.stage(rows, f"{checkpoint_dir(labelled.sparkSession)}/terms-{uuid.uuid4().hex}")
    if rows.select("label_text").distinct().limit(2).count() < 2:
        return None
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=max_features, minDF=min_df, maxDF=max_df).fit(rows)
    idf = IDF(inputCol="tf", outputCol="_").fit(counts.transform(rows))
    # Smooth idf is ln((1 + n) / (1 + df)) + 1; the library's has no "+ 1".
    weights = Vectors.dense([x + 1.0 for x in idf.idf.toArray()])
    scale = ElementwiseProduct(scalingVec=weights, inputCol="tf", outputCol="tfidf")
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    indexer = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    bayes = NaiveBayes(smoothing=smoothing, featuresCol="features", labelCol="label", modelType="multinomial")
    fitted = Pipeline(stages=[counts, scale, unit, indexer, bayes]).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    # The label indexer is only needed for training.
    return PipelineModel([s for s in fitted.stages if s.uid != indexer.uid] + [names])


def predict_top_n(model: PipelineModel, txns: DataFrame, n: int = 3, min_probability: float = 0.01) -> DataFrame:
    """Up to ``n`` labels per transaction with probability above the minimum."""
    labels = F.array(*[F.lit(s) for s in model.stages[-1].getLabels()])
    scored = model.transform(with_terms(txns)).select("txn_id", F.posexplode(vector_to_array("probability")).alias("k", "confidence"))
    likely = scored.filter(F.col("confidence") > min_probability)
    best = top_k(likely, ["txn_id"], [F.col("confidence").desc(), F.col("k")], n)
    label = F.split(F.element_at(labels, F.col("k") + 1), "\\|")
    return best.select("txn_id", label[0].alias("category"), label[1].alias("subcategory"), "confidence", "rank")


def predict(model: PipelineModel, txns: DataFrame) -> DataFrame:
    """The most probable label; no shuffle."""
    out = model.transform(with_terms(txns))
    label = F.split("predicted_label", "\\|")
    return out.select(
        "txn_id", label[0].alias("category"), label[1].alias("subcategory"), F.array_max(vector_to_array("probability")).alias("confidence")
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
