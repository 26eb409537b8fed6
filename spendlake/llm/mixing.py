"""Mix sources to target weights by Poisson replication, in DataFrame functions only.

A source with target share ``w`` of ``budget`` bytes that holds ``b`` bytes gets the repetition rate
``w * budget / b``. A document's number of copies is the inverse of the Poisson distribution of that
rate at a uniform number hashed from (seed, doc_id, text); every copy then gets a hashed shuffle key, and
the copies are sorted globally by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.shared import stored, text_key, without

TEMPERATURE = 0.7
SEED = 17
#: Hex digits of a hash that make a uniform number: 52 bits, exact in a double.
DIGITS = 13


def size_of(text: str = "text") -> F.Column:
    """UTF-8 bytes and one for the end of the document, so that no source is of size zero."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, source_bytes, weight, rate), one row per source of ``docs``; null is a source of its own.

    ``weights`` (source, weight >= 0) are target shares up to a factor. Without them a source's share
    is its bytes to the power ``temperature``. A source of ``docs`` that ``weights`` lacks gets rate 0;
    a weight whose source has no documents is left out of the total. The budget is ``epochs`` times
    all bytes.
    """
    sizes = docs.groupBy("source").agg(F.sum(size_of()).alias("source_bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("source_bytes").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given")
        sizes = sizes.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # one row per source is left, so the totals are no burden for their single task
    every = Window.partitionBy()
    share = F.col("weight") / F.nullif(F.sum("weight").over(every), F.lit(0.0))
    rate = share * F.sum("source_bytes").over(every) * F.lit(float(epochs)) / F.col("source_bytes")
    return sizes.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` with ``cdf``: P(copies <= k) for k = 0, 1, ..., far enough that the rest is below 1e-16."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_factorial = F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto)
    steps = steps.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial))
    steps = steps.withColumn("below", F.sum("p").over(upto))
    tables = steps.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list("below")).alias("cdf"))
    return rates.join(tables, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def uniform(*parts: F.Column | str, seed: int = SEED) -> F.Column:
    """A number in (0, 1) hashed from ``seed`` and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """The copies of ``docs``: all its columns, rate, n_copies, copy (1, 2, ...) and shuffle_key, in shuffled order.

    A null doc_id and a null text hash as the empty text; documents without an id are told by their texts, and only rows that repeat both get the
    same number of copies and the same keys.
    Null and empty texts weigh one byte. An empty table gives an empty result. Columns of ``docs``
    named as a result column are replaced. A hot source is no hot key: the rates are joined as a
    written table of one row per source, which Spark broadcasts if its size allows or else joins with skew splitting.
    """
    results = ("rate", "n_copies", "copy", "shuffle_key")
    docs = without(docs, *results)
    tables = stored(poisson_tables(source_rates(docs, weights, temperature, epochs)), "rates").select(F.col("source").alias("__of"), "rate", "cdf")
    # a source that is the same in all rows must not be folded into the join, which then loses its column
    out = docs.withColumn("__source", F.when(F.spark_partition_id() >= 0, F.col("source")))
    out = out.join(tables, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of", "__source").withColumn("__text", F.md5(text_key("text")))
    u = uniform(text_key("doc_id"), F.col("__text"), seed=seed)
    out = out.withColumn("__u", u).withColumn("n_copies", F.expr("size(filter(cdf, c -> c < __u))")).where("n_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).drop("cdf", "__u")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), text_key("doc_id"), F.col("__text"), F.col("copy").cast("string")))).drop("__text")
    return out.orderBy("shuffle_key", "doc_id") if shuffle else out
