"""The engine's relations as views of the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"STANDARD": "function", "ECONOMY": "method", "MEDIUM": "class", "PROMO": "interface", "LARGE": "variable"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def symbols(self) -> DataFrame:
        p = self.table("part")
        kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("p_type")), F.lit("macro"))
        line = F.floor(F.col("p_partkey") / 40) * 10 + 1
        return p.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
            kind.alias("kind"),
            F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/m"), (F.col("p_partkey") % 40).cast("string"), F.lit(".ts")).alias("file"),
            line.alias("line"),
            (line + F.col("p_size")).alias("end_line"),
            F.concat_ws(" ", "p_name", "p_type").alias("context"),
        )

    def edges(self) -> DataFrame:
        """Each order's parts in a row; null targets where the line is open."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        rel = F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "imports").otherwise("extends")
        e = self.table("lineitem").select(
            F.col("l_partkey").alias("source_id"),
            F.lead("l_partkey").over(w).alias("to_id"),
            rel.alias("relationship"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"),
            (F.col("l_linestatus") == "F").alias("resolved"),
        )
        return e.where("to_id is not null and to_id <> source_id")

    def resolved(self) -> DataFrame:
        return self.edges().where("resolved").select("source_id", F.col("to_id").alias("target_id"), "relationship", "confidence")

    def commits(self) -> DataFrame:
        """idx, file: the order's files; idx counts from 1, newest first."""
        o = self.table("orders").withColumn("idx", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")))
        recent = o.where(F.col("idx") <= 500).select("o_orderkey", F.col("idx").cast("long"))
        l = self.table("lineitem").join(F.broadcast(recent), F.col("l_orderkey") == F.col("o_orderkey"))  # 500 rows
        return l.select("idx", F.concat(F.lit("m"), (F.col("l_partkey") % 40).cast("string"), F.lit(".ts")).alias("file"))

    def lines(self) -> DataFrame:
        d = self.table("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
        return d.select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")

    def facts(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", F.col("event_type").alias("fact_type"), F.col("props").alias("value"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 97 + 1).alias("line"), (F.col("event_id") % 97 + 3).alias("end_line"))


#: The same views in SQL; every twin starts with them.
WITH = """with recursive symbols as (
  select p_partkey as id, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') as name,
         case p_type when 'STANDARD' then 'function' when 'ECONOMY' then 'method' when 'MEDIUM' then 'class' when 'PROMO' then 'interface' when 'LARGE' then 'variable' else 'macro' end as kind,
         'src/' || lower(p_type) || '/m' || (p_partkey % 40) || '.ts' as file, (p_partkey // 40) * 10 + 1 as line, (p_partkey // 40) * 10 + 1 + p_size as end_line,
         p_name || ' ' || p_type as context from part),
edges as (select * from (
  select l_partkey as source_id, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as to_id,
         case l_returnflag when 'R' then 'calls' when 'A' then 'imports' else 'extends' end as relationship, round(1 - l_discount, 2) as confidence, l_linestatus = 'F' as resolved from lineitem)
  where to_id is not null and to_id <> source_id),
resolved as (select source_id, to_id as target_id, relationship, confidence from edges where resolved),
best as (select source_id, target_id, max(confidence) as confidence,
         min(relationship) filter (confidence = m) as relationship from (select *, max(confidence) over (partition by source_id, target_id) as m from resolved) group by all),
commits as (select idx, 'm' || (l_partkey % 40) || '.ts' as file from lineitem join
  (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as idx from orders) on l_orderkey = o_orderkey where idx <= 500),
dfiles as (select distinct idx, file from commits), sized as (select idx from dfiles group by idx having count(*) between 2 and 20),
cochange as (select a.file as file_a, b.file as file_b, count(*) as frequency, least(sum(1.0::double / (1 + a.idx)), 1.0) as recency
  from dfiles a join dfiles b on a.idx = b.idx and a.file < b.file where a.idx in (select idx from sized) group by all),
lines as (select source || '/' || lang || '/' || doc_id || '.txt' as file, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as line, unnest(string_split(coalesce(text, ''), chr(10))) as text from documents),
facts as (select event_id, event_type as fact_type, props as value, 'u' || user_id as file, event_id % 97 + 1 as line, event_id % 97 + 3 as end_line from events)
"""
