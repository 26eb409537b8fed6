"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import decontaminate, embeddings, language, mixing, ring, simhash, spelling, spotsigs, suffix_tree, token_counts, token_files, warc, whitening
from spendlake.llm.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shards of the sharding query.
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer; it lies where the package is installed, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizer())
    return token_files.read(spark, path)


@query
def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "flat")
    end = token_counts.write_flat(table(spark, sf_dir, "documents"), path, public_tokenizer())
    return token_counts.count_tokens(spark, path, end)


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), F.col("n_copies").cast("bigint").alias("n_copies"), F.col("copy").cast("bigint").alias("copy"), "shuffle_key")


def mixing_sql(documents: str, columns: str) -> str:
    """The mixing operator with its default parameters in DuckDB SQL, over the relation ``documents``."""
    return f"""
WITH docs AS (SELECT * FROM {documents}),
sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS source_bytes,
         pow(CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE), {mixing.TEMPERATURE}) AS weight
  FROM docs GROUP BY source),
rates AS (
  SELECT source, weight / sum(weight) OVER () * CAST(sum(source_bytes) OVER () AS DOUBLE) / source_bytes AS rate FROM sizes),
steps AS (
  SELECT source, rate, k FROM rates, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k)),
points AS (
  SELECT source, k, exp(k * ln(rate) - rate - sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM points),
tables AS (SELECT source, list(below ORDER BY k) AS cdf FROM cdf GROUP BY source),
counted AS (
  SELECT d.*, r.rate, len(list_filter(t.cdf, lambda c: c < (CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, ''))), 1, {mixing.DIGITS}) AS BIGINT) + 0.5) / {16**mixing.DIGITS}.0)) AS n_copies
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT {columns}
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM counted WHERE n_copies > 0)"""


ORACLES["op3_source_mixing"] = mixing_sql(
    "documents",
    f"doc_id, source, text, round(rate, 9) AS rate, CAST(n_copies AS BIGINT) AS n_copies, CAST(copy AS BIGINT) AS copy, md5('order{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || CAST(copy AS VARCHAR)) AS shuffle_key",
)


@query
def op4_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def crc_of_id() -> F.Column:
    """crc32 of doc_id as text, by which rows are held out; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


@query
def op5_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_of_id() % 3 == 1)
    model = language.train(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id() % 10 == 0).alias("held_out"))
    model, rare = suffix_tree.train(docs.where("NOT held_out"))
    return suffix_tree.score(docs, model, rare).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read(spark, path))
    revisit = F.col("response.record_type") == "revisit"
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("bigint").alias("page_id"),
        F.when(revisit, F.regexp_extract("response.http_headers", r"Content-Length: (\d+)", 1)).otherwise(F.octet_length("response.payload")).cast("bigint").alias("payload_bytes"),
        F.when(revisit, F.substring_index("response.payload_digest", ":", -1)).otherwise(F.sha2("response.payload", 256)).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.fields")["refers-to-page-id"].cast("bigint").alias("refers_to"),
    )


ORACLES["op8_warc_captures"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS of, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f ON payload_digest = of AND payload_bytes >= 100"""


@query
def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"), scratch(spark, "postings"))
    found = decontaminate.search(index, table(spark, sf_dir, "benchmark"))
    found = found.withColumn("ids", decontaminate.items_hit())
    return found.select(
        "doc_id", "n_words", decontaminate.words_hit().alias("n_hit"), F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query
def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.write_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint_text(F.col("signed")).alias("fingerprint"),
        spotsigs.fingerprint_text(F.col("edited_signed")).alias("edited_fingerprint"), "near_edited", "near_next",
        spotsigs.length_partition(F.size("signed")).alias("length_partition"),
    )


@query
def op12_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
