"""Exact duplicates by a tree merge of digest runs.

Every row is digested once (white space normalised), and rows are dealt over
runs by a hash of their id. A run is sorted by digest, and holds the smallest id
and the count of each. Runs are exchanged in rounds of a binomial tree: numbered
in base FAN, in round r a run whose digit r is not 0 goes to the run with a 0
there, which merges the FAN sorted runs it then has (sort aggregates, no hash
tables), so at every level the smallest id of each digest is kept. Every level is
written to the shared folder. The winners go back down the same tree, level by
level, to the rows. A digest that a third of all rows share has at most FAN
entries in any merge and its rows are spread over all runs, so no task grows with
a group; a run is itself spread over tasks by its digests.

Entries merge only if digest, length and a second, independent hash all agree, at
every level; texts that differ in any of the three stay apart. 320 bits and a
length stand for the text: among 10**12 texts the chance that any two differ and
agree in the 256 bits alone is below 10**-53.

Nulls: a null text counts as empty. A null id never wins over another one; in
a group without ids keep_id is null and every row is kept. Rows that repeat
the smallest id are all kept, and all are counted. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import SPACE_RUN, Scratch, partitions, text_or_empty

#: How many runs merge into one in a round.
FAN = 8
_KEY = ["digest", "n_bytes", "witness"]


def normalised(text_col: str):
    """White-space runs become one blank; single blanks are left alone."""
    return F.regexp_replace(text_or_empty(text_col), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("t"))
    return rows.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("witness"),
    )


class RunTree:
    """The merge tree over runs of (key, doc_id) rows.

    rows: the rows with their run; top: one row per key with best (the smallest
    doc_id), n (the count) and the first of each further column. keep stages a level.
    """

    def __init__(self, rows: DataFrame, key: list[str], *, more: dict | None = None, fan: int = FAN, keep: Callable[[DataFrame], DataFrame] = lambda level: level):
        self.key, self.fan = key, fan
        self.levels = max(1, math.ceil(math.log(max(2, partitions(rows.sparkSession)), fan)))
        self.rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(fan**self.levels)))
        more = more or {}
        self.runs = [keep(self.rows.groupBy(*key, "run").agg(F.min("doc_id").alias("best"), F.count("*").alias("n"), *(c.alias(k) for k, c in more.items())))]
        for r in range(self.levels):
            sent = self.runs[-1].withColumn("run", self._receiver(r))
            self.runs.append(keep(sent.groupBy(*key, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"), *(F.first(k).alias(k) for k in more))))
        self.top = self.runs[-1].drop("run")

    def _receiver(self, r: int) -> Column:
        """The run that merges this one in round r: digits 0 to r are 0."""
        return F.col("run") - F.pmod("run", F.lit(self.fan ** (r + 1)))

    def down(self, won: DataFrame, *columns: str) -> DataFrame:
        """The rows, each with the named columns of its key's row in won."""
        won = won.select(*self.key, F.lit(0).cast("long").alias("run"), *columns)
        for r in reversed(range(self.levels)):
            below = self.runs[r].select(*self.key, F.col("run").alias("own"), self._receiver(r).alias("run"))
            won = below.join(won, [*self.key, "run"]).select(*self.key, F.col("own").alias("run"), *columns)
        return self.rows.join(won, [*self.key, "run"])


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = Scratch(docs.sparkSession)
    # the minimum of a struct is kept by sort aggregates: runs are sorted and merged, not hashed
    digests = digest_rows(docs, id_col, text_col).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id")))
    tree = RunTree(own.keep(digests, "digests"), _KEY, fan=fan, keep=lambda level: own.keep(level, "runs"))
    rows = tree.down(tree.top.withColumnsRenamed({"best": "keep_id", "n": "group_size"}), "keep_id", "group_size")
    rows = rows.withColumns({"doc_id": F.col("doc_id.doc_id"), "keep_id": F.col("keep_id.doc_id")})
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = f"""
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, h as text_sha256
from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_RUN}', ' ', 'g')) as h from documents)
window w as (partition by h)
"""
