"""A training-data pipeline of five stages over `documents`; each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paintgraph.llm import bpe, decontaminate, lines, neardup, quality
from paintgraph.llm.common import table
from paintgraph.scratch import Table
from paintgraph.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts fail them and go; repeated rows are judged alike, each for itself."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and runs of two lines or more go, but for the first. A document that loses its last word by it goes
    whole; one that had no words before, null texts among them, stays as it is. The column n_chars is written anew with the text's
    length. Of repeated rows the first keeps its lines."""
    ship(spark)
    return lines.dedup_documents(docs, runs=True).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more. Null texts and texts
    without words stay; rows of one doc_id stay or go together; rows without a doc_id stay."""
    ship(spark)
    return neardup.dedup_documents(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go. Null and empty texts hold none and stay; repeated rows are judged
    alike; with an empty benchmark all stay."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (binary, little-endian 32-bit), and a digest of the bytes they decode to. Null and empty texts have
    no ids; repeated rows are encoded each for itself."""
    import public_tokenizers

    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", tokens)]

#: The tokenizer and similarity components of a whole corpus aren't SQL; tests/llm compare run() with its five stages written out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is freed once the next one is written; the last is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Table(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.free()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
