"""Symbol enumeration: exact, suffix and contained names, ordered terms, fuzzy tiers, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import identifier_terms, like_escape
from quarry.schemas import checked_limit

RELAXED = {"function": "method", "method": "function"}


def match_class(query: str) -> Column:
    """0 the name itself, 1 its last dotted part, 2 contained; null without a match."""
    q = like_escape(query)
    name = F.col("name")
    return F.when(name == query, 0).when(name.ilike(f"%.{q}"), 1).when(name.ilike(f"%{q}%"), 2)


def list_symbols(symbols: DataFrame, query: str, limit: int, *, prefix: str | None = None, kind: str | None = None) -> DataFrame:
    rows = symbols.withColumn("match", match_class(query)).where("match is not null")
    if prefix:
        rows = rows.where(F.col("file").ilike(like_escape(prefix) + "%"))
    if kind:
        rows = rows.where(F.col("kind") == ("class" if kind == "struct" else kind))
    return rows.orderBy("match", "file", "line", "name", "id").limit(checked_limit(limit))


def list_relaxed(symbols: DataFrame, query: str, limit: int, kind: str, **filters) -> DataFrame:
    """As list_symbols; if no symbol has the kind, function and method stand for each other."""
    strict = list_symbols(symbols, query, limit, kind=kind, **filters).withColumn("relaxed", F.lit(False))
    if kind not in RELAXED or not strict.isEmpty():
        return strict
    return list_symbols(symbols, query, limit, kind=RELAXED[kind], **filters).withColumn("relaxed", F.lit(True))


def ordered_terms(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols whose name or context has the query's terms in order; two terms at least."""
    terms = identifier_terms(query)
    if len(terms) < 2:
        return symbols.limit(0)
    like = "%" + "%".join(map(like_escape, terms)) + "%"
    by_name = F.lower("name").like(like)
    rows = symbols.withColumn("in_name", by_name).where(by_name | F.lower("context").like(like))
    return rows.orderBy(F.desc("in_name"), "file", "line", "name", "id").limit(checked_limit(limit))


def fuzzy(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """names: wanted (string), in_file (string or null). For each the symbols of
    the first tier that has any: 0 name and file, 1 name and end of the file, 2 last
    part of the name; 3 to 5 the same with the leading underscore toggled. One pass:
    every symbol meets the wanted names under its whole name and its last part."""
    toggled = F.when(F.col("wanted").startswith("_"), F.substring("wanted", 2, 1 << 20)).otherwise(F.concat(F.lit("_"), "wanted"))
    asked = names.select("wanted", "in_file", F.explode(F.array(F.struct(F.col("wanted").alias("key"), F.lit(0).alias("step")), F.struct(toggled.alias("key"), F.lit(3).alias("step")))).alias("k")).select("wanted", "in_file", "k.*")
    whole = symbols.withColumn("key", F.col("name")).withColumn("part", F.lit(False))
    part = symbols.where(F.col("name").contains(".")).withColumn("key", F.element_at(F.split("name", "\\."), -1)).withColumn("part", F.lit(True))
    met = asked.join(whole.unionByName(part), "key")
    file_ok = F.col("in_file").isNull() | (F.col("file") == F.col("in_file"))
    end_ok = F.col("file").endswith(F.concat(F.lit("/"), F.col("in_file")))
    tier = F.when(~F.col("part") & file_ok, 0).when(~F.col("part") & end_ok, 1).when(F.col("part"), 2)
    met = met.withColumn("tier", F.col("step") + tier).where("tier is not null")
    best = F.min("tier").over(Window.partitionBy("wanted", "in_file"))
    return met.withColumn("best", best).where("tier = best").select("wanted", "in_file", "tier", "id", "name", "file", "line").distinct()


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points: file, line. The smallest span of the file that contains the line;
    of equal ones the one that starts last, then the smallest id."""
    s = symbols.select("file", F.col("line").alias("start"), "end_line", "id", "name")
    met = points.distinct().join(s, "file").where("line between start and end_line")
    pick = F.min_by(F.struct("id", "name"), F.struct(F.col("end_line") - F.col("start"), -F.col("start"), F.col("id")))
    return met.groupBy("file", "line").agg(pick.alias("s")).select("file", "line", F.col("s.id").alias("symbol_id"), F.col("s.name").alias("symbol_name"))


def nearest(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol of the file whose first line is nearest; ties go to the earlier line, then the smaller id;
    symbols without a line come last. A file's points and first lines go by once in each direction."""
    kind = points.schema["line"].dataType
    named = F.struct(F.col("line").alias("start"), "id", "name")
    starts = symbols.where("file is not null").groupBy("file", "line").agg(F.min(named).alias("s"))
    points = points.select("file", "line").where("file is not null").distinct()
    rows = starts.withColumn("asks", F.lit(False)).unionByName(points.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    file = Window.partitionBy("file")
    placed = F.when(F.col("s.start").isNotNull(), F.col("s"))
    rows = rows.withColumns({"before": F.last(placed, True).over(file.orderBy("line")), "after": F.last(placed, True).over(file.orderBy(F.desc("line"))), "other": F.min("s").over(file)})
    first = F.col("after").isNull() | (F.col("line") - F.col("before.start") <= F.col("after.start") - F.col("line"))
    pick = F.coalesce(F.when(first, F.col("before")), "after", "other")
    rows = rows.where("asks").select("file", F.col("line").cast(kind).alias("line"), pick.alias("s")).where("s is not null")
    return rows.select("file", "line", F.col("s.id").alias("symbol_id"), F.col("s.name").alias("symbol_name"))


def anchors(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Containing symbol, else the nearest one of the file."""
    inner = enclosing(points, symbols).withColumn("contained", F.lit(True))
    rest = points.distinct().join(inner, ["file", "line"], "left_anti")
    return inner.unionByName(nearest(rest, symbols).withColumn("contained", F.lit(False)))


def summary(context: str = "context") -> Column:
    """The first line with text, at most 160 characters; else kind and name."""
    first = F.element_at(F.filter(F.transform(F.split(context, "\n"), F.trim), lambda x: x != ""), 1)
    text = F.coalesce(F.when(F.size(F.filter(F.split(context, "\n"), lambda x: F.trim(x) != "")) > 0, first), F.concat_ws(" ", "kind", "name"))
    return F.when(F.length(text) > 160, F.concat(F.substring(text, 1, 160), F.lit("..."))).otherwise(text)


def handle(id_col: str = "id", revision: str | None = None) -> Column:
    return F.concat(F.lit("symbol:"), F.col(id_col).cast("string"), F.lit(f"@{revision}" if revision else ""))


def file_handle(file_col: str = "file") -> Column:
    return F.concat(F.lit("file:"), F.lower(F.hex(F.col(file_col).cast("binary"))))
