"""The corpus pipeline: documents with a known language, without lines repeated across
the corpus, one of each group of near-duplicates, free of benchmark passages, tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. Stages are written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bondflow.llm import decontaminate, langid, linededup, minhash, sentencepieces, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language prediction is not rejected; a null text, or one without a letter, goes."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents, save in their keeper; every row stays, n_chars follows the text."""
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more. Wordless texts stay, as do rows that repeat the id of the one kept."""
    return minhash.deduplicate(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark passage; a null or wordless text stays, an empty benchmark takes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row; a null text counts as empty."""
    import public_tokenizers

    model = sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.digests(docs, model)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

ORACLE_SQL = None  # language prediction and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = shared.kept(stage(spark, docs, sf_dir), name)
    return docs
