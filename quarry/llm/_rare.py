"""Prefixes of token sets in the order of rarity, for exact set-similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rare_prefixes(sets: DataFrame, ident: list[str], carry: list[str], least: int, of: int, sort: bool = False) -> DataFrame:
    """sets: one row per set, with the columns of ident and carry, and tokens (distinct longs).

    Frequencies are counted exactly. A token that one set has is in no other; a set
    of which others have less than least / of is left out. What others have is ordered
    by rarity (then by token), and two sets with a Jaccard similarity of least / of share
    a token of their prefixes: token, ident, carry, n (tokens of the set), rest (so
    many of its tokens that others have too follow this one). sort: all tokens are sorted
    once to count them, instead of counted by hash and joined with their counts.
    """
    each = sets.select(*ident, F.explode("tokens").alias("token"))
    if sort:
        shared = each.withColumn("times", F.count("*").over(Window.partitionBy("token"))).where("times > 1")
    else:
        shared = each.join(each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "token")
    ranked = shared.groupBy(*ident).agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("ranked"))
    ranked = ranked.join(sets.select(*ident, *carry, F.size("tokens").alias("n")), ident).where(F.size("ranked") * of >= F.col("n") * least)
    prefix = F.slice("ranked", F.lit(1), F.size("ranked") - F.ceil(F.col("n") * least / of).cast("int") + 1)
    rows = ranked.select(*ident, *carry, "n", F.size("ranked").alias("m"), F.posexplode(prefix).alias("pos", "entry"))
    return rows.select(F.col("entry.token").alias("token"), *ident, *carry, "n", (F.col("m") - F.col("pos") - 1).alias("rest"))


def may_match(least: int, of: int):
    """Length and positional filter of a row of rare_prefixes and another in the struct hub."""
    length = of * F.least("n", "hub.n") >= least * F.greatest("n", "hub.n")
    return length & ((of + least) * (1 + F.least("rest", "hub.rest")) >= least * (F.col("n") + F.col("hub.n")))
