"""The queries of this subpackage, each an operator applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bondflow.llm import decontaminate, langid, linededup, minhash, ngrams, quality, sentencepieces, urlfilter, warc, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), words=4)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.digests(table(spark, sf_dir, "documents"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_warc": op2_warc,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_urls": op4_urls,
    "op5_lines": op5_lines,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontaminate": op9_decontaminate,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op4_urls": urlfilter.ORACLE,
    "op5_lines": linededup.ORACLE,
}
