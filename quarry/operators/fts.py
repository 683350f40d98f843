"""Inverted index and BM25 over text columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import full_text_terms

_K1, _B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, pos, token, lower-cased; one row per word of every field."""
    parts = [F.struct(F.lit(f).alias("field"), F.filter(F.split(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "").alias("tokens")) for f in fields]
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("p"))
    return rows.select("id", "p.field", F.posexplode("p.tokens").alias("pos", "token"))


def query_phrases(query: str) -> list[list[str]]:
    import re

    phrases = [re.findall(r"[^\W_]+", t.strip('"').lower()) for t in full_text_terms(query)]
    return [p for p in phrases if p]


def phrase_hits(words: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """id, phrase, field, f: how often each phrase stands in each field. Only
    postings of the query's words are read on; the words of a phrase meet where
    their places less their positions in it agree."""
    wanted = words.sparkSession.createDataFrame([(k, j, t, len(p)) for k, p in enumerate(phrases) for j, t in enumerate(p)], "phrase int, j int, token string, n int")
    met = words.join(F.broadcast(wanted), "token")  # as many rows as the query has words
    at = met.groupBy("id", "field", "phrase", "n", (F.col("pos") - F.col("j")).alias("at")).agg(F.countDistinct("j").alias("m")).where("m = n")
    return at.groupBy("id", "phrase", "field").agg(F.count("*").alias("f"))


def bm25(docs: DataFrame, id_col: str, fields: list[str], query: str, limit: int | None = None) -> DataFrame:
    """id, score (negative, best first) and field, the first one with a hit.
    Every phrase must occur in some field; frequencies and lengths are over all fields."""
    phrases = query_phrases(query)
    words = postings(docs, id_col, fields)
    if not phrases:
        return words.limit(0).select("id", F.lit(0.0).alias("score"), "field")
    size = words.groupBy("id").agg(F.count("*").alias("size"))
    total = docs.agg(F.count("*").alias("n")).join(size.agg(F.sum("size").alias("words"))).first()
    n, average = total["n"], max(1.0, (total["words"] or 0) / max(1, total["n"]))
    rank = F.lit(len(fields))
    for k, f in enumerate(fields):
        rank = F.when(F.col("field") == f, k).otherwise(rank)
    hits = phrase_hits(words, phrases).groupBy("id", "phrase").agg(F.sum("f").alias("f"), F.min(rank).alias("rank"))
    df = {r["phrase"]: r["count"] for r in hits.groupBy("phrase").count().collect()}  # a row per phrase
    idf = F.lit(0.0)
    for k in range(len(phrases)):
        m = df.get(k, 0)
        idf = F.when(F.col("phrase") == k, max(1e-6, math.log((n - m + 0.5) / (m + 0.5)))).otherwise(idf)
    part = idf * F.col("f") * (_K1 + 1) / (F.col("f") + _K1 * (1 - _B + _B * F.col("size") / average))
    rows = hits.join(size, "id").groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("m"), F.min("rank").alias("rank")).where(F.col("m") == len(phrases))
    rows = rows.select("id", "score", F.element_at(F.array(*map(F.lit, fields)), F.col("rank") + 1).alias("field"))
    return rows if limit is None else rows.orderBy("score", "id").limit(limit)
