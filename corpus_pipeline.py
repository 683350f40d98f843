"""The corpus pipeline: five stages over documents, each written and read again.

quality classifier -> line dedup -> near-dedup -> substring dedup -> packing.
Every stage but the last returns the columns of documents; further columns of any
name travel along (an input column n_chars is set anew with the text). A null text
counts as empty, and an empty one has no quality to reject by rule: its score decides.
Rows without an id stay apart by their texts and are in no near-duplicate group. Of
equal rows, and of ties, the first by id and then by digest keeps its lines. An empty
table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, near_dup, packing, quality_mil, substring_dedup
from quarry.llm._common import documents, stage, table
from quarry.llm.queries import vocabulary


def _retext(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and its length in n_chars where there is such a column."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches 0.3; the classifier learns from documents and labels."""
    model = quality_mil.train(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return quality_mil.accept(docs, model)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; a document that had words and keeps none goes too."""
    left = line_dedup.dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return _retext(left.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns)), F.col("text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five-word shingles, Jaccard 0.8) the one with the smallest id stays."""
    groups = near_dup.near_groups(docs)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def fresh_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that starts elsewhere too go; what a
    cut leaves of a character goes with them. Texts that go whole go as documents."""
    cut = substring_dedup.remove_repeats(docs, keep=docs.columns)
    cut = cut.where("n_removed = 0 or n_removed < n_bytes")
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.col("n_removed") > 0, whole).otherwise(F.col("row")["text"])
    return _retext(cut.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns)), F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("line dedup", fresh_lines),
    ("near dedup", one_of_each),
    ("substring dedup", fresh_strings),
    ("packing", packed),
]

#: SQL can express neither the classifier nor packing; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
