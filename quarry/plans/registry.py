"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.operators import callsites, coupling, fts, graph, index, lines, lookup, ranking, scans, search, vector
from quarry.plans.views import WITH, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TARGET = 5


def query(sql: str | None = None):
    """Registers f(views) under its name; sql follows the views of WITH."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = WITH + sql
        return f

    return add


def _r(c, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def _one(v: Views, x: int = TARGET) -> DataFrame:
    return v.spark.createDataFrame([(x,)], "source long")


# -- lookup ---------------------------------------------------------------------
_MATCH = "case when name = '{q}' then 0 when name ilike '%.{q}' then 1 when name ilike '%{q}%' then 2 end"


@query(f"select id, name, kind, file, line, cast({_MATCH.format(q='widget')} as int) as match from symbols where name ilike '%widget%' and kind = 'method' order by match, file, line, name, id limit 25")
def symbols_enumerate(v: Views) -> DataFrame:
    return lookup.list_symbols(v.symbols(), "widget", 25, kind="method").select("id", "name", "kind", "file", "line", "match")


@query("select id, name, file, line from symbols where name ilike '%bolt%' and file ilike 'src/e%' order by file, line, name, id limit 40")
def symbols_prefix(v: Views) -> DataFrame:
    return lookup.list_symbols(v.symbols(), "bolt", 40, prefix="src/e").select("id", "name", "file", "line")


@query("select id, name, kind, true as relaxed from symbols where name ilike '%ring%' and file ilike 'src/economy/%' and kind = 'method' order by file, line, name, id limit 20")
def symbols_relaxed_kind(v: Views) -> DataFrame:
    return lookup.list_relaxed(v.symbols(), "ring", 20, "function", prefix="src/economy/").select("id", "name", "kind", "relaxed")


@query("select id, name, lower(name) like '%red%widget%' as in_name from symbols where lower(name) like '%red%widget%' or lower(context) like '%red%widget%' order by in_name desc, file, line, name, id limit 30")
def symbols_ordered_tokens(v: Views) -> DataFrame:
    return lookup.ordered_terms(v.symbols(), "red widget", 30).select("id", "name", "in_name")


@query("""
, asked(wanted, in_file) as (values ('Brand1.red_widget', null), ('red_widget', null), ('_blue_bolt', null), ('small_ring', 'm0.ts'), ('nothing', null)),
k as (select wanted, in_file, wanted as key, 0 as step from asked union all select wanted, in_file, case when wanted like '\\_%' escape '\\' then substr(wanted, 2) else '_' || wanted end, 3 from asked),
t as (select wanted, in_file, id, name, file, line, step + case when name = key and (in_file is null or file = in_file) then 0 when name = key and file like '%/' || in_file then 1 else 2 end as tier
      from k join symbols on name = key and (in_file is null or file = in_file or file like '%/' || in_file) or string_split(name, '.')[2] = key)
select wanted, in_file, cast(tier as int) as tier, id, name, file, line from (select distinct *, min(tier) over (partition by wanted, in_file) as m from t) where tier = m""")
def fuzzy_lookup_tiers(v: Views) -> DataFrame:
    rows = [("Brand1.red_widget", None), ("red_widget", None), ("_blue_bolt", None), ("small_ring", "m0.ts"), ("nothing", None)]
    return lookup.fuzzy(v.symbols(), v.spark.createDataFrame(rows, "wanted string, in_file string"))


@query("select distinct file from symbols")
def distinct_files(v: Views) -> DataFrame:
    return v.symbols().select("file").distinct()


@query("select id, name, line from symbols where file = 'src/small/m2.ts' order by line")
def colocated_symbols(v: Views) -> DataFrame:
    return v.symbols().where(F.col("file") == "src/small/m2.ts").orderBy("line").select("id", "name", "line")


_POINTS = ", points as (select distinct file, line + 3 as line from symbols)"


@query(f"""{_POINTS}
select file, line, symbol_id, symbol_name from (select p.file, p.line, s.id as symbol_id, s.name as symbol_name,
  row_number() over (partition by p.file, p.line order by s.end_line - s.line, s.line desc, s.id) as r
  from points p join symbols s on s.file = p.file and p.line between s.line and s.end_line) where r = 1""")
def enclosing_symbol(v: Views) -> DataFrame:
    return lookup.enclosing(v.symbols().select("file", (F.col("line") + 3).alias("line")), v.symbols())


@query(f"""{_POINTS}
select file, line, symbol_id, symbol_name from (select p.file, p.line, s.id as symbol_id, s.name as symbol_name,
  row_number() over (partition by p.file, p.line order by abs(s.line - p.line), s.line, s.id) as r from points p join symbols s on s.file = p.file) where r = 1""")
def nearest_symbol(v: Views) -> DataFrame:
    return lookup.nearest(v.symbols().select("file", (F.col("line") + 3).alias("line")), v.symbols())


@query("select id, 'symbol:' || id as handle, 'file:' || lower(hex(encode(file))) as file_handle, context as summary from symbols")
def handles(v: Views) -> DataFrame:
    return v.symbols().select("id", lookup.handle().alias("handle"), lookup.file_handle().alias("file_handle"), lookup.summary().alias("summary"))


@query("select id, name, string_split(name, '.')[-1] in ('map', 'filter', 'find', 'log', 'error') as generic, case when kind in ('function', 'class') then 1.5 when kind = 'method' then 1.3 when kind = 'variable' then 0.5 else 1.0 end::double as boost from symbols")
def kind_boosts(v: Views) -> DataFrame:
    return v.symbols().select("id", "name", scoring.generic_target("name").alias("generic"), scoring.kind_boost("kind").alias("boost"))


# -- lines ----------------------------------------------------------------------
@query("select file, line, text, 'exact_phrase' as match from lines where lower(text) like '%apache license%'")
def line_scan_phrase(v: Views) -> DataFrame:
    return lines.scan(v.lines(), "apache license").where("match = 'exact_phrase'")


@query("""select file, line, cast(case when lower(text) like '%apache version%' then 10 else 4 end as bigint) as points, case when lower(text) like '%apache version%' then 'exact_phrase' else 'ordered_tokens' end as match
from lines where lower(text) like '%apache%version%' order by points desc, file, line limit 50""")
def line_scan_ordered(v: Views) -> DataFrame:
    return lines.ranked_scan(v.lines(), "apache version", 50).select("file", "line", "points", "match")


@query("""
, r as (select file, line, text, cast(sum(length(text) + 1) over (partition by file order by line) as bigint) as upto from lines where line between 2 and 9),
k as (select file, line, upto, substr(text, 1, 600 - (upto - length(text) - 1)) as part from r where 600 - (upto - length(text) - 1) > 0)
select file, 2 as first, 9 as last, string_agg(part, chr(10) order by line) as text, max(line) as end_line, max(upto) - 1 > 600 as truncated from k group by file""")
def inspect_slice(v: Views) -> DataFrame:
    spans = v.lines().select("file").distinct().select("file", F.lit(2).alias("first"), F.lit(9).alias("last"))
    return lines.snippet(v.lines(), spans, 600)


@query(f"select file, line from lines where regexp_matches(lower(text), '{'|'.join(lines.SECRET_MARKERS)}')")
def secret_lines(v: Views) -> DataFrame:
    return lines.secret_lines(v.lines()).select("file", "line")


# -- full text ------------------------------------------------------------------
_TOKENS = ", tok as (select conv_id * 100 + turn as id, t from conversations, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) u(t) where t <> ''), size as (select id, count(*) as size from tok group by id), tot as (select (select count(*) from conversations) as n, sum(size) as words from size)"


@query(_TOKENS + """
, f as (select id, t, count(*) as f from tok where t in ('the', 'thonst') group by all),
d as (select t, count(*) as m from f group by t),
s as (select f.id, -sum(greatest(1e-6, ln((n - m + 0.5) / (m + 0.5))) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * size / (words / n)))) as score from f join d using (t) join size using (id), tot group by f.id having count(*) = 2)
select id, round(score, 6) as score, 'text' as field from s order by s.score, id limit 20""")
def bm25_topk(v: Views) -> DataFrame:
    c = v.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return fts.bm25(c, "id", ["text"], "the thonst", 20).select("id", _r("score"), "field")


@query("""
, tok as (select conv_id * 100 + turn as id, i, l[i] as t, l[i + 1] as u from (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as l from conversations), unnest(range(1, len(l) + 1)) r(i)),
size as (select id, count(*) as size from tok group by id), tot as (select (select count(*) from conversations) as n, sum(size) as words from size),
f as (select id, count(*) as f from tok where t = 'of' and u = 'the' group by id), m as (select count(*) as m from f)
select id, round(-greatest(1e-6, ln((n - m + 0.5) / (m + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / (words / n))), 6) as score, 'text' as field from f join size using (id), m, tot""")
def bm25_phrase(v: Views) -> DataFrame:
    c = v.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return fts.bm25(c, "id", ["text"], '"of the"').select("id", _r("score"), "field")


# -- facts, index ---------------------------------------------------------------
@query("select file, fact_type, value, 'e' as enclosing, min(line) as line, max(end_line) as end_line, count(*) as occurrence_count from facts group by all")
def facts_materialize(v: Views) -> DataFrame:
    return index.materialise_facts(v.facts().withColumn("enclosing", F.lit("e")))


@query("""
, old as (select doc_id, case when doc_id % 7 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 10 <> 0 union all select 1000000007, 'gone')
select coalesce(d.doc_id, o.doc_id)::varchar as file, case when d.doc_id is null then 'deleted' when o.doc_id is null then 'new' else 'changed' end as state
from documents d full join old o using (doc_id) where d.doc_id is null or o.doc_id is null or sha256(d.text) <> o.h""")
def stale_diff(v: Views) -> DataFrame:
    now = v.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = now.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")).alias("h"))
    old = old.union(v.spark.createDataFrame([(1000000007, "gone")], "doc_id long, h string"))
    shape = lambda d: d.select(F.col("doc_id").cast("string").alias("file"), F.col("h").alias("content_hash"))
    return index.stale_files(shape(now), shape(old))


@query("select (select count(*) from symbols) as symbols, (select count(distinct file) from symbols) as files, (select count(*) from edges where resolved) as resolved, (select count(*) from edges where not resolved) as unresolved, (select count(*) from facts) as facts, (select count(*) from embeddings) as embeddings")
def index_stats(v: Views) -> DataFrame:
    s = v.symbols().agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))
    e = v.edges().agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return s.join(e).join(v.facts().agg(F.count("*").alias("facts"))).join(v.table("embeddings").agg(F.count("*").alias("embeddings")))  # one row each


@query("select cast(0 as bigint) as stale, false as degraded, r as resolved, u as unresolved, case when u > 3 * r then 'attention' else 'healthy' end as status from (select count(*) filter (resolved) as r, count(*) filter (not resolved) as u from edges)")
def index_health(v: Views) -> DataFrame:
    e = v.edges().agg(F.lit(0).cast("long").alias("stale"), F.lit(False).alias("degraded"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return index.health(e).drop("warnings")


@query()
def index_revision(v: Views) -> DataFrame:
    return index.revision(v.symbols())


@query("""
, r as (select file, enclosing, min(event_id) as event_id from (select 'src/' || lower(p_type) || '/m' || (p_partkey % 40) || '.ts' as file, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') as enclosing, p_partkey as event_id from part) group by all)
select event_id, file, enclosing, (select s.id from symbols s where s.file = r.file and s.name = r.enclosing order by s.line, s.id limit 1) as symbol_id from r""")
def signal_enclosures(v: Views) -> DataFrame:
    rows = v.symbols().groupBy("file", F.col("name").alias("enclosing")).agg(F.min("id").alias("event_id"))
    return index.enclosures(rows, v.symbols()).select("event_id", "file", "enclosing", "symbol_id")


@query("""
, p as (select source_id, t.id as target_id from edges join symbols t on t.id = to_id where not resolved and false),
e as (select s.id as edge_id, s.file as source_file, s.name as source_name, string_split(t.name, '.')[2] as target_name, case when s.id % 3 = 0 then t.file end as target_file, t.name as whole from symbols s join symbols t on t.id = (s.id * 7 + 3) % (select count(*) from symbols)),
e2 as (select edge_id, source_file, source_name, case when edge_id % 2 = 0 then whole else target_name end as target_name, target_file from e),
xf as (select file, name, min(id) as id from symbols group by all having count(*) = 1), x as (select name, min(id) as id from symbols group by name having count(*) = 1),
sx as (select string_split(name, '.')[2] as name, min(id) as id from symbols group by all having count(*) = 1)
select edge_id, coalesce(a.id, x.id, sx.id) as target_id, case when a.id is not null then 1.0 when x.id is not null then 1.0 when sx.id is not null then 0.8 else 0.0 end::double as confidence
from e2 left join xf a on a.file = target_file and a.name = target_name left join x on x.name = target_name and target_name like '%.%' left join sx on sx.name = string_split(target_name, '.')[-1]""")
def resolve_edges_rules(v: Views) -> DataFrame:
    s = v.symbols()
    n = s.count()
    t = s.select(F.col("id").alias("tid"), F.col("name").alias("whole"), F.col("file").alias("tfile"))
    e = s.join(t, (F.col("id") * 7 + 3) % n == F.col("tid"))
    name = F.when(F.col("id") % 2 == 0, F.col("whole")).otherwise(F.element_at(F.split("whole", "\\."), 2))
    edges = e.select(F.col("id").alias("edge_id"), F.col("file").alias("source_file"), F.col("name").alias("source_name"), name.alias("target_name"), F.when(F.col("id") % 3 == 0, F.col("tfile")).alias("target_file"))
    none = v.spark.createDataFrame([], "source_file string, local_name string, resolved_file string, original string")
    return index.resolve_edges(edges, s, none).drop("rule")


@query("""
, c as (select id as call_id, string_split(name, '.')[2] as callee, name as target, id % 4 = 0 as generic from symbols),
k as (select call_id, generic, callee as part from c union select call_id, generic, target from c),
o as (select id as target_id, name as part from symbols union select id, string_split(name, '.')[2] from symbols),
f as (select distinct call_id, generic, target_id from k join o using (part) where call_id <> target_id)
select call_id, call_id as source_id, target_id, round(case when generic then 0.35 else 1.0 end / count(*) over (partition by call_id), 6) as confidence, case when count(*) over (partition by call_id) = 1 then target_id end as resolved_id from f""")
def callsite_candidates(v: Views) -> DataFrame:
    calls = v.symbols().select(F.col("id").alias("call_id"), F.col("id").alias("source_id"), F.element_at(F.split("name", "\\."), 2).alias("callee"), F.col("name").alias("target"), (F.col("id") % 4 == 0).alias("generic"))
    found = index.callsite_groups(calls, v.symbols()).withColumn("confidence", _r("confidence"))
    return index.resolved(index.members(found, v.symbols()))


@query("""
, inb as (select t.file, count(*) as n from resolved e join symbols s on s.id = e.source_id join symbols t on t.id = e.target_id where s.file <> t.file group by t.file)
select f.file, round(least(1.0, coalesce(n, 0) / greatest(1, (select count(*) from symbols) - 1)), 6) as centrality from (select distinct file from symbols) f left join inb using (file)""")
def file_centrality(v: Views) -> DataFrame:
    return index.file_centrality(v.symbols(), v.resolved()).select("file", _r("centrality"))


@query("""
, fp as (select 'src/standard/' || file_a as file_a, 'src/standard/' || file_b as file_b, frequency from cochange),
l as (select s.file as file, t.file as other, 2 as w from resolved e join symbols s on s.id = e.source_id join symbols t on t.id = e.target_id where s.file <> t.file
      union all select t.file, s.file, 1 from resolved e join symbols s on s.id = e.source_id join symbols t on t.id = e.target_id where s.file <> t.file),
le as (select * from (select file, other, sum(w) as score, row_number() over (partition by file order by sum(w) desc, other) as r from l group by file, other) where r <= 8),
ce as (select * from (select file, other, score, row_number() over (partition by file order by score desc, other) as r from (select file_a as file, file_b as other, frequency as score from fp union all select file_b, file_a, frequency from fp)) where r <= 8)
select file, other, cast(score as bigint) as score from (select file, other, sum(score) as score, row_number() over (partition by file order by sum(score) desc, other) as r from (select file, other, score from le union all select file, other, score from ce) group by file, other) where r <= 5""")
def role_card_files(v: Views) -> DataFrame:
    pairs = coupling.cochange(v.commits())
    pairs = pairs.select(F.concat(F.lit("src/standard/"), "file_a").alias("file_a"), F.concat(F.lit("src/standard/"), "file_b").alias("file_b"), "frequency", "recency")
    return index.related_files(v.symbols(), v.resolved(), pairs)


# -- co-change, coupling --------------------------------------------------------
@query("select file_a, file_b, frequency, round(recency, 6) as recency from cochange")
def cochange_pairs(v: Views) -> DataFrame:
    return coupling.cochange(v.commits()).select("file_a", "file_b", "frequency", _r("recency"))


@query("select case when file_a = 'm5.ts' then file_b else file_a end as other, frequency, round(recency, 6) as recency from cochange where 'm5.ts' in (file_a, file_b) order by frequency desc, cochange.recency desc, other limit 8")
def top_cochange(v: Views) -> DataFrame:
    return coupling.top_partners(coupling.cochange(v.commits()), "m5.ts", 8).select("other", "frequency", _r("recency"))


_EVO = "0.75 * least(frequency / 10, 1.0) + 0.25 * least(greatest(recency, 0), 1)"


@query(f"select file_a, file_b, round({_EVO}, 6) as evolutionary from cochange")
def evolutionary_score(v: Views) -> DataFrame:
    return coupling.cochange(v.commits()).select("file_a", "file_b", _r(scoring.evolutionary("frequency", "recency"), "evolutionary"))


_WEIGHT = "case relationship when 'calls' then 1.0 when 'extends' then 1.0 when 'imports' then 0.5 else 0.5 end"


@query(f"select source_id, target_id, round({_WEIGHT} * confidence, 6) as structural, round(least(1, 0.45 * {_WEIGHT} * confidence / 0.8), 9) as combined from best")
def structural_score(v: Views) -> DataFrame:
    s = scoring.structural("relationship", "confidence", F.lit(1))
    return graph.build(v.resolved()).select("source_id", "target_id", _r(s, "structural"), F.round(scoring.fuse(s, 0.0, 0.0), 9).alias("combined"))


# -- graph ----------------------------------------------------------------------
@query("select source_id, target_id, relationship, confidence from best")
def edge_dedup_max_conf(v: Views) -> DataFrame:
    return graph.build(v.resolved())


def _reach(a: str, b: str, depth: int) -> str:
    return f", reach as (select cast({TARGET} as bigint) as id, 0 as depth union select {b}, depth + 1 from reach join best on {a} = id where depth < {depth}), near as (select id, cast(min(depth) as int) as depth from reach group by id)"


@query(_reach("target_id", "source_id", 2) + f" select id, depth from near where id <> {TARGET}")
def bfs_dependents_d2(v: Views) -> DataFrame:
    return graph.bfs(graph.build(v.resolved()), _one(v), 2, reverse=True).select("id", "depth")


@query(_reach("source_id", "target_id", 2) + f" select id, depth from near where id <> {TARGET}")
def bfs_dependencies_d2(v: Views) -> DataFrame:
    return graph.bfs(graph.build(v.resolved()), _one(v), 2).select("id", "depth")


@query(f"""
, b as (select target_id as node, source_id as id, relationship, confidence, 0 as side from best where target_id = {TARGET} union all select source_id, target_id, relationship, confidence, 1 from best where source_id = {TARGET})
select node, id, relationship, confidence, case side when 0 then 'incoming' else 'outgoing' end as direction from (select *, row_number() over (partition by id order by confidence desc, side) as r from b) where r = 1""")
def neighbors_best(v: Views) -> DataFrame:
    return graph.neighbours(graph.build(v.resolved()), _one(v).select(F.col("source").alias("node")))


@query(_reach("source_id", "target_id", 64) + f" select id, depth from near where id <> {TARGET}")
def shortest_path_len(v: Views) -> DataFrame:
    return graph.reached(graph.build(v.resolved()), _one(v)).select("id", "depth")


_NODES = ", nodes as (select source_id as id from best union select target_id from best), ins as (select target_id as id, count(distinct source_id) as n from best group by all), cen as (select id, coalesce(n, 0) / ((select count(*) from nodes) - 1) as centrality from nodes left join ins using (id))"


@query(_NODES + " select id, round(centrality, 6) as centrality from cen order by cen.centrality desc, id limit 10")
def centrality_top(v: Views) -> DataFrame:
    return graph.centrality(graph.build(v.resolved()), 10).select("id", _r("centrality"))


@query(_reach("target_id", "source_id", 2) + f"""
, e as (select n.id, n.depth, max(confidence) as c from near n join best b on b.source_id = n.id join near p on p.id = b.target_id and p.depth = n.depth - 1 group by all)
select id, depth, round(c / pow(2, depth - 1), 6) as impact from e where id <> {TARGET}""")
def impact_radius(v: Views) -> DataFrame:
    return graph.impact_radius(graph.build(v.resolved()), TARGET, 2).select("id", "depth", _r("impact"))


@query(f"select target_id as id, case relationship when 'calls' then 'callee' when 'imports' then 'imported' else 'base_type' end as role from best where source_id = {TARGET}")
def graph_roles(v: Views) -> DataFrame:
    return graph.build(v.resolved()).where(F.col("source_id") == TARGET).select(F.col("target_id").alias("id"), graph.role().alias("role"))


def _mode(a: str, b: str) -> str:
    return _reach(a, b, 3) + f"""
, e as (select n.id, n.depth, relationship, confidence, row_number() over (partition by n.id order by confidence desc, relationship, p.id) as r from near n join best b on b.{b} = n.id join near p on p.id = b.{a} and p.depth = n.depth - 1)
select id, name, file, line, depth, round({_WEIGHT} * confidence / pow(2, depth - 1), 6) as score from e join symbols using (id) where r = 1 and id <> {TARGET} order by {_WEIGHT} * confidence / pow(2, depth - 1) desc, file, line, name, id limit 20"""


@query(_mode("target_id", "source_id"))
def graph_mode_callers(v: Views) -> DataFrame:
    return search.graph_mode(v.symbols(), graph.build(v.resolved()), TARGET, "callers", 20).withColumn("score", _r("score"))


@query(_mode("source_id", "target_id"))
def graph_mode_callees(v: Views) -> DataFrame:
    return search.graph_mode(v.symbols(), graph.build(v.resolved()), TARGET, "callees", 20).withColumn("score", _r("score"))


def _table_edges(v: Views) -> DataFrame:
    names = v.symbols().select(F.col("id").alias("to_id"), F.col("name").alias("target_name"))
    e = v.edges().join(names, "to_id")
    return e.select("source_id", F.when(F.col("resolved"), F.col("to_id")).alias("target_id"), "target_name", "relationship", "confidence")


@query(_reach("target_id", "source_id", 3) + f"""
, e as (select n.id, n.depth, relationship, confidence, row_number() over (partition by n.id order by confidence desc, relationship, p.id) as r from near n join best b on b.source_id = n.id join near p on p.id = b.target_id and p.depth = n.depth - 1),
g as (select id, least(1, 0.45 * {_WEIGHT} * confidence / pow(2, depth - 1) / 0.8) as score, 0 as source from e where r = 1
  union all select source_id, 0.8, 1 from edges where resolved and to_id = {TARGET}
  union all select source_id, 0.8, 2 from edges e join symbols s on s.id = e.to_id where not resolved and s.name = (select name from symbols where id = {TARGET}))
select id, round(score, 6) as score, case source when 0 then 'graph' when 1 then 'resolved_edge' else 'unresolved_name_edge' end as provenance
from (select *, row_number() over (partition by id order by source, score desc) as r from g where id <> {TARGET}) where r = 1 order by round(score, 6) desc, id limit 12""")
def impact_union(v: Views) -> DataFrame:
    none = v.spark.createDataFrame([], "file_a string, file_b string, frequency long, recency double")
    rows = coupling.impact(v.symbols(), _table_edges(v), graph.build(v.resolved()), none, TARGET, 1000)
    return rows.withColumn("score", _r("score")).orderBy(F.desc("score"), "id").limit(12)


# -- vectors --------------------------------------------------------------------
_KNN = "select vec_id as id, list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as distance from embeddings"


def _query_vector(v: Views) -> list[float]:
    return v.table("embeddings").where("vec_id = 0").first()["embedding"]


@query(f"select id, round(distance, 6) as distance from ({_KNN}) k order by k.distance, id limit 20")
def knn_l2(v: Views) -> DataFrame:
    return vector.knn(v.table("embeddings"), _query_vector(v), 20, id_col="vec_id").select("id", _r("distance"))


@query(f"select id, round(greatest(0, least(1, 1 - distance)), 6) as semantic from ({_KNN}) where 1 - distance > 0.3")
def knn_semantic_threshold(v: Views) -> DataFrame:
    e = v.table("embeddings")
    q = F.array(*map(F.lit, map(float, _query_vector(v))))
    return e.select(F.col("vec_id").alias("id"), scoring.semantic(vector.l2(F.col("embedding"), q)).alias("s")).where("s > 0.3").select("id", _r("s", "semantic"))


@query()
def hashing_embed(v: Views) -> DataFrame:
    return vector.hashing_embed(v.symbols(), "id", "context", 32)


def _nearby(v: Views) -> DataFrame:
    return vector.knn(v.table("embeddings"), v.table("embeddings").where(F.col("vec_id") == TARGET).first()["embedding"], 20, id_col="vec_id")


@query()
def related_topk(v: Views) -> DataFrame:
    pairs = coupling.cochange(v.commits())
    rows = coupling.coupled(v.symbols(), graph.build(v.resolved()), pairs, _nearby(v), TARGET)
    return rows.orderBy(F.desc("combined"), "id").limit(12).select("id", _r("structural"), _r("semantic"), _r("evolutionary"), _r("combined"))


@query()
def neighborhood_topk(v: Views) -> DataFrame:
    pairs = coupling.cochange(v.commits())
    rows = coupling.coupled(v.symbols(), graph.build(v.resolved()), pairs, _nearby(v), TARGET)
    return coupling.neighbourhood(rows, v.symbols(), TARGET).withColumn("score", _r("score"))


# -- fusion ---------------------------------------------------------------------
@query("""
, s as (select id, kind, row_number() over (order by case when name ilike '%.widget' then 1 else 2 end, file, line, name, id) - 1 as rank from symbols where name ilike '%widget%' order by file, line, name, id limit 60)
select id, round((1 + 1.0 / (60 + rank)) * case when kind in ('function', 'class') then 1.5 when kind = 'method' then 1.3 when kind = 'variable' then 0.5 else 1.0 end * 0.45, 6) as signal from s""")
def rrf_fusion(v: Views) -> DataFrame:
    return search.channels(v.symbols(), "widget", 60).where("channel = 'symbol'").select("id", _r("signal"))


@query()
def bucketed_search(v: Views) -> DataFrame:
    rows = search.search(v.symbols(), graph.build(v.resolved()), "red widget", 20)
    return rows.select("id", "name", "bucket", "rank", _r("score"), "reasons")


@query()
def role_cards(v: Views) -> DataFrame:
    pairs = coupling.cochange(v.commits())
    facts = v.facts().withColumn("enclosing", F.lit("e"))
    return index.role_cards(v.symbols(), facts, v.resolved(), pairs).withColumn("centrality", _r("centrality"))


@query(_NODES + " select id, round(case when m <= 0 then centrality else least(centrality / greatest(m, 2.5 / 60), 1) end, 6) as score from cen, (select max(centrality) as m from cen)")
def normalized_fusion(v: Views) -> DataFrame:
    c = graph.centrality(graph.build(v.resolved()))
    most = c.agg(F.max("centrality").alias("m"))
    return c.join(F.broadcast(most)).select("id", _r(scoring.normalised("centrality", F.col("m")), "score"))


# -- events ---------------------------------------------------------------------
@query("""
, g as (select user_id, ts, value, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 10 minute then 1 else 0 end as n from events),
k as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select 'u' || user_id as path, count(*) as events, min(ts) as started, max(ts) as ended from k group by user_id, k""")
def debounce_batches(v: Views) -> DataFrame:
    from quarry.streaming.debounce import sessions

    e = v.table("events").select(F.col("ts").cast("timestamp"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))
    return sessions(e, "10 minutes").withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("ended", F.col("ended").cast("timestamp_ntz"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is null or before <> event_type")
def content_dedup(v: Views) -> DataFrame:
    from quarry.streaming.debounce import changed_only

    return changed_only(v.table("events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


# -- scans by key ---------------------------------------------------------------
@query(f"select source_id, target_id, relationship, confidence from resolved where source_id = {TARGET}")
def edges_from(v: Views) -> DataFrame:
    return scans.edges_by(v.resolved(), source=TARGET)


@query(f"select source_id, target_id, relationship, confidence from resolved where target_id = {TARGET}")
def edges_to(v: Views) -> DataFrame:
    return scans.edges_by(v.resolved(), target=TARGET)


@query(f"select source_id, name as target_name, relationship, confidence from edges join symbols s on s.id = to_id where name = (select name from symbols where id = {TARGET})")
def edges_to_name(v: Views) -> DataFrame:
    name = v.symbols().where(F.col("id") == TARGET).first()["name"]
    return scans.edges_by(_table_edges(v), name=name).select("source_id", "target_name", "relationship", "confidence")


@query("select event_id as id, fact_type, value, line from facts where file = 'u7' order by line, fact_type, value, event_id")
def facts_of_file(v: Views) -> DataFrame:
    return scans.of_file(_facts(v), "facts", "u7").select("id", "fact_type", "value", "line")


@query("select coalesce(bool_or(contains(text, 'a')), false) as found from lines where file = (select min(file) from lines) and line = 1")
def line_has(v: Views) -> DataFrame:
    rows = v.lines()
    return scans.line_contains(rows, rows.agg(F.min("file")).first()[0], 1, "a")


def _facts(v: Views) -> DataFrame:
    return v.facts().withColumnRenamed("event_id", "id")


def _calls(v: Views) -> DataFrame:
    """A call site for every symbol: its own name as the target, a third of them resolved."""
    last = F.element_at(F.split("name", "\\."), 2)
    return v.symbols().select("id", "file", "line", last.alias("callee"), F.col("name").alias("target"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("resolved_id"))


_CALLS = ", calls as (select id, file, line, string_split(name, '.')[2] as callee, name as target, case when id % 3 = 0 then id end as resolved_id from symbols)"


@query(_CALLS + """
select id, file, line, callee, resolved_id from calls where (callee = 'widget' or target = 'widget' or target ilike '%widget' or callee ilike '%widget%') and file ilike '%m1%'
order by resolved_id is null, ends_with(file, '_test.go'), file, line, target, id limit 100""")
def callsites_named(v: Views) -> DataFrame:
    return scans.callsites_matching(_calls(v), "widget", 100, "m1").select("id", "file", "line", "callee", "resolved_id")


_SUFFIX = "(select string_split(name, '.')[2] from symbols where id = {})"


@query(f"select id, name, file, line from symbols where name ilike '%.' || {_SUFFIX.format(TARGET)} order by file, line, name, id limit 20")
def symbols_method_suffix(v: Views) -> DataFrame:
    name = v.symbols().where(F.col("id") == TARGET).first()["name"].split(".")[1]
    return scans.method_suffix(v.symbols(), name).select("id", "name", "file", "line")


@query("select id, name, file, line from symbols where name ilike 'brand1%gear' order by file, line, name, id limit 50")
def symbols_like(v: Views) -> DataFrame:
    return scans.named_like(v.symbols(), "brand1%gear", 50).select("id", "name", "file", "line")


@query("select id, name, file, line, count(*) over () > 24 as truncated from symbols where name ilike '%gear%' order by file, line, name, id limit 24")
def symbols_page(v: Views) -> DataFrame:
    rows = v.symbols().where(F.col("name").ilike("%gear%")).select("id", "name", "file", "line")
    return scans.page(rows, ["file", "line", "name", "id"], 24)


@query("select id, name, case when kind = 'method' then 0 else 1 end as part from symbols where kind = 'method' or name ilike '%bolt%'")
def symbols_merged(v: Views) -> DataFrame:
    s = v.symbols().select("id", "name", "kind")
    parts = [s.where("kind = 'method'").withColumn("part", F.lit(0)), s.where(F.col("name").ilike("%bolt%")).withColumn("part", F.lit(1))]
    return scans.merged(parts, ["id"], ["name"]).select("id", "name", "part")


# -- call sites -----------------------------------------------------------------
def _open_calls(v: Views) -> DataFrame:
    """Every pair of symbols that an open edge names, as a call site of the first one. The condition that always
    holds reads what _named_edges reads, so that both take the lines of orders from one exchange."""
    to = v.symbols().select(F.col("id").alias("to_id"), F.col("name").alias("target"))
    opened = v.edges().where("not resolved and pmod(hash(relationship, confidence), 2) >= 0").select("source_id", "to_id")
    pairs = opened.repartition("to_id").distinct().join(to, "to_id")
    return pairs.select((F.col("source_id") * 1_000_000 + F.col("to_id")).alias("call_id"), "source_id", F.element_at(F.split("target", "\\."), 2).alias("callee"), "target", (F.col("to_id") % 4 == 0).alias("generic"))


def _named_edges(v: Views) -> DataFrame:
    """Resolved edges as rows of the edges table."""
    to = v.symbols().select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    e = graph.build(v.resolved()).join(to, "target_id")
    return e.withColumn("id", F.col("source_id") * 1_000_000 + F.col("target_id"))


_OPEN = """, opened as (select distinct source_id * 1000000 + to_id as call_id, source_id, string_split(name, '.')[2] as callee, name as target, to_id % 4 = 0 as generic from edges join symbols s on s.id = to_id where not resolved),
named as (select source_id * 1000000 + target_id as id, source_id, target_id, name as target_name, relationship, confidence from best join symbols s on s.id = target_id)"""


@query(_OPEN + """
select call_id, resolved_id from (select c.call_id, e.target_id as resolved_id, row_number() over (partition by c.call_id order by e.confidence desc, e.id) as r
from opened c join named e on e.source_id = c.source_id and e.relationship in ('calls', 'instantiates') and (e.target_name = c.target or ends_with(lower(e.target_name), lower(c.callee)))) where r = 1""")
def callsites_from_edges(v: Views) -> DataFrame:
    return callsites.from_edges(_open_calls(v), _named_edges(v))


@query(_OPEN + """
, pairs as (select distinct c.call_id, c.source_id, c.generic, s.id as target_id from opened c join symbols s on (s.name = c.target or string_split(s.name, '.')[2] = c.callee) and s.id <> c.source_id),
f as (select source_id, target_id, (case when generic then 0.35 else 1.0 end)::double / count(*) over (partition by call_id) as c from pairs)
select source_id, target_id, round(max(c), 6) as confidence from f where not exists (select 1 from named e where e.source_id = f.source_id and e.target_id = f.target_id and relationship = 'calls') group by all""")
def callsites_new_edges(v: Views) -> DataFrame:
    found = index.callsite_groups(_open_calls(v), v.symbols()).withColumn("confidence", _r("confidence"))
    return callsites.new_edges(found, _named_edges(v), v.symbols())


@query("""
, t as (select file, string_split(name, '.')[1] as owner, id, line, row_number() over (partition by file, string_split(name, '.')[1] order by line, id) as r from symbols where kind in ('class', 'interface'))
select t.id, owner as name, t.file, t.line, 2.5::double as score from t where r = 1 and exists (select 1 from symbols m where m.kind = 'method' and replace(m.file, 'economy', 'medium') = t.file and string_split(m.name, '.')[1] = owner)""")
def receiver_types(v: Views) -> DataFrame:
    """Methods of src/economy are taken as if they stood beside the classes of src/medium, named by their brand."""
    s = v.symbols()
    methods = s.withColumn("file", F.replace("file", F.lit("economy"), F.lit("medium")))
    types = s.withColumn("name", F.element_at(F.split("name", "\\."), 1))
    return search.receiver_types(methods, types).select("id", "name", "file", "line", "score")


# -- facts and lines as channels ------------------------------------------------
_FTOK = ", tok as (select event_id as id, t from facts, unnest(regexp_split_to_array(lower(fact_type || ' ' || value || ' ' || file), '[^\\p{L}\\p{N}]+')) u(t) where t <> ''), size as (select id, count(*) as size from tok group by id), tot as (select (select count(*) from facts) as n, sum(size) as words from size)"


@query(_FTOK + """
, f as (select id, t, count(*) as f from tok where t in ('purchase', '42') group by all), d as (select t, count(*) as m from f group by t),
s as (select f.id, -sum(greatest(1e-6, ln((n - m + 0.5) / (m + 0.5))) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * size / (words / n)))) as score from f join d using (t) join size using (id), tot group by f.id having count(*) = 2)
select event_id as id, fact_type, value, file, line, round(score, 6) as score from s join facts on event_id = id""")
def fact_hits(v: Views) -> DataFrame:
    return search.fact_search(_facts(v), "purchase 42", 1 << 30).select("id", "fact_type", "value", "file", "line", _r("score"))


@query("""
, s as (select file, line, contains(lower(text), 'ba')::int + contains(lower(text), 'next')::int + 5 * contains(lower(text), 'next()')::int + 2 * regexp_matches(text, 'type |func ')::int as points from lines)
select file, line, cast(points as bigint) as points from s where s.points > 0""")
def evidence_lines(v: Views) -> DataFrame:
    return ranking.ranked_lines(v.lines(), ["ba", "next"]).select("file", "line", "points")


@query("""
, m as (select file, line, lower(file) as p, lower(text) as x from lines where text ilike '%license%'),
s as (select file, line, 3 * (contains(p, 'web')::int + contains(p, 'license')::int) + 1 + 2 * (contains(x, 'web')::int + contains(x, 'license')::int) as points from m)
select file, line, cast(points as bigint) as points from s order by s.points desc, file, line limit 200""")
def evidence_matches(v: Views) -> DataFrame:
    hits = v.lines().where(F.col("text").ilike("%license%"))
    return ranking.ranked_matches(hits, ["web", "license"], "which license").limit(200).select("file", "line", "points")


@query("""
, h as (select file, line, kind from symbols where id % 7 = 0 union all select 'src/none.ts', 3, 'x')
select h.file, cast(h.line as bigint) as line, s.id as id, coalesce(s.kind, 'file_match') as kind from (select distinct file, line from h) h left join lateral
(select id, kind from symbols s where s.file = h.file and h.line between s.line and s.end_line order by s.end_line - s.line, -s.line, s.id limit 1) s on true""")
def line_symbols(v: Views) -> DataFrame:
    s = v.symbols()
    hits = s.where("id % 7 = 0").select("file", "line").union(v.spark.createDataFrame([("src/none.ts", 3)], "file string, line long")).distinct()
    return search.line_symbols(hits, s).select("file", F.col("line").cast("long").alias("line"), F.when(F.col("id") >= 0, F.col("id")).alias("id"), "kind")
