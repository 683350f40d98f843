"""Exact nearest neighbours, and the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """In doubles, over float arrays of equal length."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "symbol_id", vector_col: str = "embedding") -> DataFrame:
    """id, distance of the k nearest; ties go to the smaller id. The query is a
    literal, so each partition keeps its own k and only those meet."""
    if k == 0:
        return vectors.select(F.col(id_col).alias("id"), F.lit(0.0).alias("distance")).limit(0)
    q = F.array(*(F.lit(float(x)) for x in query))
    wrong = F.raise_error(F.lit("vectors of another dimension")).cast("double")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.size(vector_col) == len(query), l2(F.col(vector_col), q)).otherwise(wrong).alias("distance"))
    return rows.orderBy("distance", "id").limit(k)


def latest(vectors: DataFrame, updates: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """vectors with the rows of updates in place of theirs."""
    return vectors.join(updates.select(id_col), id_col, "left_anti").unionByName(updates)


# Words that say nothing about a symbol.
STOP_WORDS = (
    "a an and as by class const constructor controller create default dispose editor export false for from function get handle if impl import in interface "
    "let manager new of on private provider public return self service set src string terminal this to true type update var void with"
).split()


def hashing_tokens(text: Column) -> Column:
    """Lower-case parts of identifiers, without short ones and stop words."""
    words = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^\\p{L}\\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def hashing_embed(rows: DataFrame, id_col: str, text_col: str, dims: int) -> DataFrame:
    """id, embedding: counts of hashed tokens, of unit length; zeros without tokens.
    Column expressions only: bins are counted per row, without a shuffle."""
    if dims <= 0:
        raise ValueError("dims must be positive")
    bins = F.transform(hashing_tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.size(F.filter("bins", lambda x: x == b)).cast("double"))
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x * x))
    out = rows.select(F.col(id_col).alias("id"), bins.alias("bins")).withColumn("counts", counts).withColumn("norm", norm)
    return out.select("id", F.transform("counts", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0).cast("float")).alias("embedding"))
