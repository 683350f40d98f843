"""Repeated lines by an exact set-similarity join.

A line's tokens are its distinct shingles of SHINGLE words (A-Z lowered; a
shorter line matches equal ones only). A line is removed if an earlier one (by document,
then line) has a Jaccard similarity of at least LEAST / OF; blank lines never
match. Equal lines are one class from the start. Between classes:

1. Sample. Two lines that match miss at most a share 1 - LEAST / OF of either's
   tokens. A run of words that a single class has is in no token of the others, so
   all tokens around it are missed. Runs are chosen by the hashes of their first words
   alone, in all lines alike; a line is done if more tokens than that lie around its own ones.
2. Rarity. Of the lines that stay all tokens are counted exactly and ordered by
   rarity. A line stays if others have a share LEAST / OF of its tokens; its prefix
   is the rarest tokens, so many that a match cannot lie in the rest alone.
3. Groups. Lines whose prefixes share a token meet, under the length and
   positional filters; pairs are verified on all tokens. A group's hubs are its
   earliest lines, WIDTH times as many in each round, which meet the later lines that
   nothing has matched yet, until no such line or no hub is left. So candidates
   grow with the lines that stay, not with the pairs of a group's copies.

All work is DataFrame expressions. Nulls: a null text has one blank line; lines
of a null id count as later than all others. A line's document is its row's id and
the digest of its whole text, so rows that share an id, or have none, are apart, in
the order of their digests. Of rows that are equal in both one goes through the
join; dedup takes every line with words from the others. Very long texts are only
long arrays; empty tables give none. dedup's n_lines and n_removed stand in for
input columns of these names; no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import Scratch, text_or_empty
from quarry.llm._rare import may_match, rare_prefixes

SHINGLE, LEAST, OF, WIDTH = 5, 80, 100, 8
#: Runs of words are sampled: PART words fewer than a shingle, SHARE of 100 words may be their first.
PART, SHARE = 1, 40
_LAST = (1 << 63) - 1


def _key(id_col: str, text_col: str) -> list[Column]:
    """A row's id, the largest where it is null, and the digest of its whole text."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return [own.alias("id"), F.unhex(F.md5(text_or_empty(text_col).cast("binary"))).alias("digest")]


def _fold(text: Column) -> Column:
    """A text with A-Z lowered and white space as blanks. Its bytes become characters of their own, so
    that the lowering sees Latin-1 only: of these it lowers C0 to DE too, bytes that begin a character
    of two bytes; what they become begins longer ones, so different texts stay different."""
    low = F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.when(low.rlike("[\t\x0b\x0c\r]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)


def _even(line: str) -> Column:
    """A folded line with one blank between words and none around them."""
    loose = F.col(line).contains("  ") | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(loose, F.array_join(F.array_remove(F.split(line, " "), ""), " ")).otherwise(F.col(line))


def _lines(docs: DataFrame, keys: list[Column], text_col: str) -> DataFrame:
    """One row per line with words: keys, line_no, line (its words, one blank between), c1, c2 (its class)."""
    names = docs.select(*keys).columns
    lines = docs.select(*keys, _fold(text_or_empty(text_col)).alias("text"))
    lines = lines.select(*names, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    lines = lines.select(*names, "line_no", _even("line").alias("line"))
    return lines.select(*names, "line_no", "line", F.xxhash64("line").alias("c1"), F.xxhash64(F.lit(1), "line").alias("c2"))


def _most(words: Column, shingle: int) -> Column:
    """So many shingles begin in a line."""
    return F.greatest(F.lit(0), F.size(words) - (shingle - 1))


def _low(word: Column) -> Column:
    """Whether a word is one of SHARE of 100, by its hash."""
    return F.xxhash64(word) < int((_LAST + 1) * (SHARE / 50 - 1))


def _alone(lines: DataFrame, shingle: int) -> DataFrame:
    """c1, alone: so many distinct shingles of a class, at least, are in no other class.

    lines: c1, line. Of the runs of PART words fewer than a shingle those are sent whose first word
    is low and whose second is not, whatever the line. No shingle has two of them. One that a single class
    has is in no shingle of another class; a shingle begins with it and another one ends
    with it, but at an end of the line.
    """
    part = PART if shingle > PART + 2 else 0  # runs of two words are seldom a class's own
    size = shingle - part
    # posexplode_outer, and no filter on words alone: Spark would move a filter down and split each line once more
    runs = lines.select("c1", F.split("line", " ").alias("words")).select("c1", "words", F.posexplode_outer("words").alias("at", "word"))
    last = F.size("words") - size
    runs = runs.where(_low(F.col("word")) & (F.col("at") <= F.when(last >= part, last)))
    if part:
        runs = runs.where(~_low(F.get("words", F.col("at") + 1)))
    inner = (F.col("at") > 0) & (F.col("at") < last) & F.lit(part > 0)
    token = F.xxhash64(*(F.get("words", F.col("at") + k) for k in range(size)))
    runs = runs.select(token.alias("token"), "c1", F.when(inner, 2).otherwise(1).alias("weight"))
    once = runs.groupBy("token").agg(F.min("c1").alias("c1"), F.max("c1").alias("other"), F.min("weight").alias("weight")).where("c1 = other")
    return once.groupBy("c1").agg(F.sum("weight").alias("alone"))


def matched_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST, of: int = OF) -> DataFrame:
    """The lines to remove: id, digest (see _key), line_no, and the earlier line that
    each matches: of_id, of_digest, of_line."""
    own = Scratch(docs.sparkSession)
    lines = _lines(docs, _key(id_col, text_col), text_col)
    lines = own.keep(lines.select("id", "digest", "line_no", "c1", "c2", _most(F.split("line", " "), shingle).alias("most")), "lines")
    heads = lines.groupBy("c1", "c2").agg(F.min(F.struct("id", "digest", "line_no")).alias("at"), F.count("*").alias("n"), F.first("most").alias("most"))
    heads = heads.join(_alone(_lines(docs, [], text_col).select("c1", "line"), shingle), "c1", "left")
    missed = F.floor(F.col("most") * (of - least) / of)
    heads = heads.withColumn("open", (F.col("most") > 0) & (F.coalesce("alone", F.lit(0)) <= missed))
    heads = own.keep(heads.where("n > 1 or open").select("c1", "c2", "at", "n", "open"), "heads")

    sets = own.keep(_sets(docs, heads.where("open").select("at", "c1", "c2"), id_col, text_col, shingle), "sets")
    every = own.keep(rare_prefixes(sets, ["c1", "c2"], ["at"], least, of, sort=True).select("token", "at", "n", "rest"), "prefixes")
    rows = own.keep(every.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1").drop("m"), "entries")
    # verification reads the sets of lines that meet another
    few = own.keep(sets.select("at", "tokens").join(rows.select("at").distinct(), "at", "left_semi"), "sets")
    own.drop(every, sets)
    found = own.keep(_matches(own, rows, few, least, of), "found")
    own.drop(few)

    best = found.groupBy("at").agg(F.min("of").alias("of"))
    heads = heads.select("c1", "c2", "at", "n").join(best, "at", "left").where("n > 1 or of is not null")
    heads = heads.select("c1", "c2", "at", F.coalesce("of", "at").alias("of"), F.col("of").isNotNull().alias("all"))
    gone = lines.select("c1", "c2", F.struct("id", "digest", "line_no").alias("line")).join(heads, ["c1", "c2"]).where("all or line <> at")
    return gone.select("line.id", "line.digest", "line.line_no", F.col("of.id").alias("of_id"), F.col("of.digest").alias("of_digest"), F.col("of.line_no").alias("of_line"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The wanted lines (at, c1, c2), each of at least one shingle, with all their tokens."""
    wanted = wanted.groupBy("at.id", "at.digest").agg(F.collect_list(F.struct("at.line_no", "c1", "c2")).alias("wanted"))
    texts = docs.select(*_key(id_col, text_col), text_or_empty(text_col).alias("text")).join(wanted, ["id", "digest"])
    lines = texts.select("id", "digest", "wanted", F.split("text", "\n").alias("lines"))
    lines = lines.select("id", "digest", "lines", F.explode("wanted").alias("x"))
    lines = lines.select(F.struct("id", "digest", "x.line_no").alias("at"), "x.c1", "x.c2", _fold(F.get("lines", F.col("x.line_no"))).alias("line"))
    lines = lines.select("at", "c1", "c2", _even("line").alias("line"))
    each = F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(f" (?=({' '.join(['[^ ]+'] * shingle)}))"), F.lit(1))
    tokens = F.array_distinct(F.transform(each, lambda words: F.xxhash64(words)))
    lines = lines.select("at", "c1", "c2", tokens.alias("tokens"))
    return lines.groupBy("c1", "c2").agg(F.first("at").alias("at"), F.first("tokens").alias("tokens"))  # equal rows are one


def _matches(own: Scratch, rows: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """at, of: lines and an earlier line that each matches."""
    fits = may_match(least, of)
    found, width = None, 1
    rows, first = rows.withColumn("matched", F.lit(False)), rows
    while True:
        turn = F.row_number().over(Window.partitionBy("token").orderBy("at"))
        hubs = own.keep(rows.withColumn("turn", turn).where(F.col("turn") <= width).select("token", F.struct("at", "n", "rest").alias("hub")), "hubs")
        pairs = rows.where("not matched").join(hubs, "token").where((F.col("hub.at") < F.col("at")) & fits).select("at", F.col("hub.at").alias("of")).distinct()
        x = sets.select(F.col("at").alias("of"), F.col("tokens").alias("others"))
        both = F.size(F.array_intersect("tokens", "others"))
        good = pairs.join(sets, "at").join(x, "of").where(of * both >= least * (F.size("tokens") + F.size("others") - both))
        new = own.keep(good.groupBy("at").agg(F.min("of").alias("of")), "matches")
        found = new if found is None else found.union(new)
        # hubs have met all that follow them; groups with nothing unmatched left are done
        last = hubs.groupBy("token").agg(F.max("hub.at").alias("last"))
        after = rows.join(last, "token").where("at > last").drop("last").join(new.select("at", F.lit(True).alias("now")), "at", "left")
        after = own.keep(after.withColumn("matched", F.col("matched") | F.col("now").isNotNull()).drop("now"), "entries")
        own.drop(first, hubs)
        waiting = after.where("not matched").select("token").distinct()
        first, rows, width = after, after.join(waiting, "token", "left_semi"), width * WIDTH
        if after.where("not matched").isEmpty():
            return found


def _copies(keyed: DataFrame) -> DataFrame:
    """keyed (with id, digest) with copy: whether an equal key stands in an earlier row."""
    own = Scratch(keyed.sparkSession)
    shared = own.keep(keyed.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"), "copies")
    if shared.isEmpty():
        return keyed.withColumn("copy", F.lit(False))
    rows = own.keep(keyed.join(shared, ["id", "digest"], "left_semi").withColumn("nr", F.monotonically_increasing_id()), "copies")
    first = rows.groupBy("id", "digest").agg(F.min("nr").alias("nr")).select("nr", F.lit(False).alias("copy"))
    rows = rows.join(first, "nr", "left").withColumn("copy", F.coalesce("copy", F.lit(True))).drop("nr")
    return keyed.join(shared, ["id", "digest"], "left_anti").withColumn("copy", F.lit(False)).unionByName(rows)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """docs with the matched lines taken out of text; n_lines and n_removed are added."""
    gone = matched_lines(docs, id_col=id_col, text_col=text_col, **parameters)
    gone = gone.groupBy("id", "digest").agg(F.collect_set("line_no").alias("gone"))
    both = _copies(docs.select(F.struct(*docs.columns).alias("row"), *_key(id_col, text_col))).join(gone, ["id", "digest"], "left")
    both = both.withColumn("lines", F.split(text_or_empty(F.col("row")[text_col]), "\n"))
    worded = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike("[^\\x20\\x09-\\x0D]"))
    both = both.withColumn("gone", F.when(F.col("copy"), F.when(F.size(worded) > 0, worded)).otherwise(F.col("gone")))
    left = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNotNull(), left).otherwise(F.col("row")[text_col])
    return both.select(
        *((text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.size("lines").cast("long").alias("n_lines"),
        F.greatest(F.lit(0), F.size("gone")).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))
