"""Matching descriptions against dictionaries: contained keyword, UPI handle, fuzzy, TF-IDF.

A dictionary is a table. Joins are equi-joins on a short key (a 3-gram of the
keyword, a word, a text length) with the exact test as the residual condition.
Spark broadcasts the dictionary when its size allows and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.operators.ranking import ranked, top_k

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def text_grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct substrings of the given sizes."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(_grams(text, n), none) for n in sizes]))


def contained(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs where ``word`` of ``words`` occurs in the lower-cased ``text``.

    Words are found through their first (up to) 3 characters.
    """
    sizes = tuple(r[0] for r in words.select(F.least(F.length(word), F.lit(GRAM))).distinct().collect() if r[0])
    lowered = texts.select(key, F.lower(text).alias("_text"))
    grams = lowered.withColumn("_gram", F.explode(text_grams(F.col("_text"), sizes or (GRAM,))))
    index = words.withColumn("_gram", F.substring(word, 1, GRAM))
    return grams.join(index, "_gram").filter(F.col("_text").contains(F.col(word))).drop("_gram")


def keyword_confidence(confidence: Column, keyword: Column, text: Column) -> Column:
    ratio = F.length(keyword) / F.length(text)
    return F.least(F.lit(0.95), confidence * (F.lit(0.5) + F.lit(0.5) * ratio))


def contains_matches(texts: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """All merchants with a keyword in the text; the first keyword sets the confidence."""
    hits = contained(texts, key, text, keywords, "keyword")
    first = hits.groupBy(key, "merchant", "category", "subcategory", "is_subscription").agg(
        F.min(F.struct("ord", "keyword", "confidence", "_text")).alias("f")
    )
    return first.select(
        key,
        "merchant",
        "category",
        "subcategory",
        "is_subscription",
        F.col("f.ord").alias("ord"),
        keyword_confidence(F.col("f.confidence"), F.col("f.keyword"), F.col("f._text")).alias("confidence"),
    )


def best_contained(texts: DataFrame, key: str, text: str, keywords: DataFrame, k: int | None = 1) -> DataFrame:
    """The best ``k`` merchants of each text, or all of them, with their rank."""
    matches = contains_matches(texts, key, text, keywords)
    return ranked(matches, [key], [F.col("confidence").desc(), F.col("ord")], k)


def exact_keyword(texts: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """Texts that are a keyword, whole; the first merchant of the dictionary wins."""
    probe = texts.select(key, F.trim(F.lower(text)).alias("keyword"))
    index = keywords.groupBy("keyword").agg(
        F.min(F.struct("ord", "merchant", "category", "subcategory", "is_subscription")).alias("m")
    )
    return probe.join(index, "keyword").select(key, "m.merchant", "m.category", "m.subcategory", "m.is_subscription")


def upi_matches(texts: DataFrame, key: str, upi_id: str, patterns: DataFrame) -> DataFrame:
    """First pattern, in dictionary order, contained in the part before '@'."""
    handles = texts.filter(F.col(upi_id).isNotNull()).select(key, F.substring_index(F.lower(upi_id), "@", 1).alias("handle"))
    hits = contained(handles, key, "handle", patterns, "pattern")
    return hits.groupBy(key).agg(F.min(F.struct("ord", "merchant", "category", "subcategory")).alias("m")).select(
        key, "m.merchant", "m.category", "m.subcategory"
    )


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest


def fuzzy_matches(
    texts: DataFrame, key: str, text: str, keywords: DataFrame, threshold: float = 0.7, max_results: int = 5
) -> DataFrame:
    """Merchants with a keyword close to the whole text by edit distance.

    Each distinct text is compared once, and only with keywords whose length
    can reach the threshold: the join key is the text length.
    """
    probe = texts.select(key, F.trim(F.lower(text)).alias("_text")).filter(F.length("_text") > 0)
    n = F.length("keyword")
    # |a - b| <= (1 - t) * max(a, b) bounds the text length on both sides.
    band = F.sequence(F.greatest(F.lit(1), F.floor(n * threshold).cast("int")), F.ceil(n / threshold).cast("int"))
    index = keywords.withColumn("_len", F.explode(band))
    close = (
        probe.select("_text").distinct().withColumn("_len", F.length("_text"))
        .join(index, "_len")
        .withColumn("_sim", similarity(F.col("_text"), F.col("keyword")))
        .filter(F.col("_sim") >= threshold)
        .groupBy("_text", "merchant", "category", "subcategory", "is_subscription")
        .agg(F.min(F.struct("ord", (F.col("_sim") * F.col("confidence")).alias("score"))).alias("f"))
        .select("_text", "merchant", "category", "subcategory", "is_subscription", "f.ord", "f.score")
    )
    best = top_k(close, ["_text"], [F.col("score").desc(), F.col("ord")], max_results)
    return probe.join(best, "_text").drop("_text")


# --- TF-IDF --------------------------------------------------------------------------


def terms(text: Column) -> Column:
    """Words of two or more characters, and their bigrams, of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def tfidf_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, idf, weight): raw counts, smooth idf, L2-normalised per document."""
    n = documents.count()
    counts = documents.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("term").agg(
        (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.count(F.lit(1)))) + 1.0).alias("idf")
    )
    weighted = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    squared = F.round(F.col("w") * F.col("w"), 12).cast("decimal(28,12)")
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(squared).cast("double")).alias("norm"))
    return weighted.join(norms, key).select(key, "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_retrieve(queries: DataFrame, qkey: str, text: str, index: DataFrame, key: str, k: int | None = 5, min_score: float = 0.0) -> DataFrame:
    """Best ``k`` documents per query by cosine, or all; terms outside the index do not count.

    ``index`` should be a stored table: its size then tells Spark to broadcast it
    and not the queries. Known terms are dealt once, by query; norms, products
    and ranks keep that order, so no two tables as long as the queries are joined.
    """
    idf = index.select("term", "idf").distinct()
    words = queries.filter(F.col(qkey).isNotNull()).select(qkey, F.col(text).alias("_text")).select(qkey, F.explode(terms(F.col("_text"))).alias("term"))
    counts = (
        words.join(idf, "term")
        .repartition(qkey)
        .groupBy(qkey, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
        .withColumn("w", F.col("tf") * F.col("idf"))
    )
    squared = F.round(F.col("w") * F.col("w"), 12).cast("decimal(28,12)")
    product = F.round(F.col("w") * F.col("weight"), 12).cast("decimal(28,12)")
    normed = counts.withColumn("norm", F.sqrt(F.sum(squared).over(Window.partitionBy(qkey)).cast("double")))
    dots = normed.join(index.select(key, "term", "weight"), "term").groupBy(qkey, key).agg(
        F.sum(product).cast("double").alias("dot"), F.first("norm").alias("norm")
    )
    scored = dots.select(qkey, key, F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    return ranked(scored.filter((F.col("score") > 0) & (F.col("score") >= min_score)), [qkey], [F.col("score").desc(), F.col(key)], k)
