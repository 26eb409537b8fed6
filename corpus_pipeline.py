"""From raw documents to mixed, packed token ids, in five stages.

Each stage works on all that the one before kept; all but the last return the columns of ``documents``.
Between stages the documents are written as Parquet and read again, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import decontaminate, language, mixing, simhash, token_files
from spendlake.llm.queries import public_tokenizer, table
from spendlake.llm.shared import scratch, stored

#: Texts of which less than this share looks like the language that is nearest are rejected.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text in a known language; a null lang becomes the predicted one."""
    found = language.identify(docs, language.train(docs))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies: SimHash candidates, judged by their shingles."""
    return simhash.deduplicate(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of ten words of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources meet their target shares, in a global random order."""
    return mixing.mix(docs).select(docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write all documents as bit-packed token files, in the order of the stage before, and return what the files hold of each."""
    path = scratch(spark, "corpus")
    token_files.write_stored(docs, path, public_tokenizer())
    return token_files.read(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_token_files),
]

#: SQL cannot express the language, SimHash and token stages; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
