"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from quarry.llm import exact_dedup, license_scan, line_dedup, near_dup, packing, quality_mil, sp_codec, sql, substring_dedup, tool_calls, ts_media
from quarry.llm._common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(sql.SQL)


def _query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@_query
def op9_sp_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.digests(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@_query
def op4_ts_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts_media.digests(ts_media.read_streams(ts_media.to_streams(documents(spark, sf_dir))))


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@_query
def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.evaluate(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(documents(spark, sf_dir), shingle=2)


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


@_query
def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_turns(table(spark, sf_dir, "conversations")), tool_calls.TURN_SCHEMA)


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
