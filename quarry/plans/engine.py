"""The engine's operations over a source tree: refresh the tables, ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import callsites, coupling, evidence, graph, index, lookup, search, vector
from quarry.sources import files, git, parse
from quarry.sources.store import SnapshotStore

FINGERPRINT = "hashing-64;1"
DIMS = 64


def _id(*cols: str):
    """A stable id of what the columns say."""
    return F.abs(F.xxhash64(*cols))


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root, SnapshotStore(spark, store)

    # -- writing ----------------------------------------------------------------
    def reindex(self, *, history: bool = True) -> dict[str, int]:
        """Reads the files that are new or changed, drops what is gone, resolves, and writes a snapshot."""
        held: list[DataFrame] = []

        def hold(rows: DataFrame) -> DataFrame:
            held.append(rows.cache())
            return held[-1]

        found = files.discover(self.spark, self.root)
        meta = self.store.read("index_meta")
        stale = hold(index.stale_files(found, meta, FINGERPRINT))
        todo = found.join(F.broadcast(stale.where("state <> 'deleted'").select("file")), "file", "left_semi") if stale.count() <= 100_000 else found.join(stale.where("state <> 'deleted'").select("file"), "file", "left_semi")
        parsed = hold(parse.parse_files(todo))
        new = {w: parse.table(parsed, w) for w in parse.ROWS}
        symbols = new["symbols"].withColumn("language", files.language()).dropDuplicates(["file", "name", "kind", "line"])
        symbols = symbols.withColumn("id", _id("file", "name", "kind", "line", "end_line"))
        keep = lambda name, rows: index.replace_files(self.store.read(name), rows.select(*self.store.read(name).columns), stale)
        all_symbols = hold(keep("symbols", symbols))
        raw = self._edges(new["edges"], symbols)
        gone = self.store.read("symbols").join(stale, "file", "left_semi").select("id")
        old = index.unlink(self.store.read("edges").where(F.coalesce("original_name", F.lit("")) != callsites.MADE), gone)
        edges = hold(self._resolved(old.unionByName(raw.select(*old.columns)), all_symbols))
        facts = index.materialise_facts(new["facts"].withColumn("end_line", F.col("line"))).withColumn("id", _id("file", "fact_type", "value", "enclosing"))
        calls = new["callsites"].withColumns({"id": _id("file", "line", "target", "callee"), "end_line": F.col("line"), "resolved_id": F.lit(None).cast("long"), "downweighted": F.col("generic")})
        aliases = new["aliases"].withColumns({"id": _id("file", "line", "local_name", "source"), "end_line": F.col("line"), "enclosing": F.lit(None).cast("string")})
        calls, added = callsites.resolve(hold(keep("callsites", calls)), edges, all_symbols, hold)
        edges = hold(edges.unionByName(added.select(*edges.columns)))
        pairs = coupling.cochange(git.commits(self.spark, self.root, extensions=files.EXTENSIONS)) if history else self.store.read("cochange")
        all_facts = keep("facts", facts)
        cards = index.role_cards(all_symbols, all_facts, edges.where("target_id is not null"), pairs)
        fresh = todo.select("file", "content_hash", F.lit(FINGERPRINT).alias("fingerprint"), F.current_timestamp().alias("last_indexed"))
        meta_now = keep("index_meta", fresh)
        all_aliases = keep("aliases", aliases)
        cards = self._imported(cards, edges, all_aliases, all_symbols, meta_now).withColumn("content_hash", F.lit(""))
        text = symbols.select("id", F.concat_ws(" ", "kind", "name", "context").alias("text"))
        vectors = vector.hashing_embed(text, "id", "text", DIMS).withColumnRenamed("id", "symbol_id")
        kept = self.store.read("embeddings").join(gone, F.col("symbol_id") == F.col("id"), "left_anti").unionByName(vectors)
        self.store.write({"symbols": all_symbols, "edges": edges, "facts": all_facts, "callsites": calls, "aliases": all_aliases, "cochange": pairs, "role_cards": cards, "embeddings": kept, "index_meta": meta_now})
        counts = {r["state"]: r["count"] for r in stale.groupBy("state").count().collect()}
        errors = parsed.where("what = 'error'").count()
        for rows in held:
            rows.unpersist()
        return {"files_new": counts.get("new", 0), "files_changed": counts.get("changed", 0), "files_deleted": counts.get("deleted", 0), "errors": errors}

    def _imported(self, cards: DataFrame, edges: DataFrame, aliases: DataFrame, symbols: DataFrame, files: DataFrame, items: int = 16) -> DataFrame:
        """cards with imported, the first names of what a file's imports and aliases name, and tests, other test files whose path has its stem."""
        place = symbols.select(F.col("id").alias("source_id"), "file")
        names = edges.where("relationship = 'imports'").join(place, "source_id").select("file", F.coalesce("target_file", "target_name").alias("name"))
        names = names.union(aliases.select("file", "source")).groupBy("file").agg(F.slice(F.array_sort(F.collect_set("name")), 1, items).alias("imported"))
        none = F.expr("cast(array() as array<string>)")
        stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "(?<=.)\\.[^.]*$", "")
        others = files.select(F.col("file").alias("test")).where(F.lower("test").rlike("test|spec"))
        met = cards.select("file", F.lower(stem).alias("stem")).join(others, F.expr("stem <> '' and test <> file and lower(test) like concat('%', stem, '%')"))
        touching = met.groupBy("file").agg(F.slice(F.array_sort(F.collect_set("test")), 1, 8).alias("tests"))
        return cards.join(names, "file", "left").join(touching, "file", "left").withColumns({"imported": F.coalesce("imported", none), "tests": F.coalesce("tests", none)})

    def _edges(self, rows: DataFrame, symbols: DataFrame) -> DataFrame:
        """Parsed edges with their source's id; imports belong to the file's first symbol."""
        named = symbols.groupBy("file", F.col("name").alias("source")).agg(F.max_by("id", F.struct("line", "id")).alias("by_name"))
        first = symbols.groupBy("file").agg(F.min_by("id", F.struct("line", "id")).alias("by_file"))
        met = rows.join(named, ["file", "source"], "left").join(first, "file", "left").withColumn("source_id", F.coalesce("by_name", F.when(F.col("source").isNull(), F.col("by_file"))))
        met = met.where("source_id is not null").select("source_id", F.col("target").alias("target_name"), "target_file", "relationship", F.col("original").alias("original_name")).distinct()
        return met.withColumns({"id": _id("source_id", "target_name", "relationship", "target_file"), "target_id": F.lit(None).cast("long"), "confidence": F.lit(0.0)})

    def _resolved(self, edges: DataFrame, symbols: DataFrame) -> DataFrame:
        place = symbols.select(F.col("id").alias("source_id"), F.col("file").alias("source_file"), F.col("name").alias("source_name"))
        met = edges.join(place, "source_id")
        known = symbols.select("file").distinct()
        stem = F.regexp_replace("file", "(/index)?\\.[^./]+$", "")
        modules = known.select(F.col("file").alias("resolved_file"), F.explode(F.array_distinct(F.array(F.col("file"), stem))).alias("module")).groupBy("module").agg(F.min("resolved_file").alias("resolved_file"))
        imports = met.where("relationship = 'imports' and target_file is not null").select("source_file", F.col("target_name").alias("local_name"), F.col("target_file").alias("module"), F.coalesce("original_name", "target_name").alias("original"))
        imports = imports.join(modules, "module").select("source_file", "local_name", "resolved_file", "original")
        asked = met.select(F.col("id").alias("edge_id"), "source_file", "source_name", "target_name", F.lit(None).cast("string").alias("target_file"))
        got = index.resolve_edges(asked, symbols, imports).select(F.col("edge_id").alias("id"), F.col("target_id").alias("to"), F.col("confidence").alias("sure"))
        return edges.join(got, "id", "left").withColumns({"target_id": F.col("to"), "confidence": F.coalesce("sure", F.lit(0.0))}).drop("to", "sure")

    # -- reading ----------------------------------------------------------------
    def _graph(self) -> DataFrame:
        return graph.build(self.store.read("edges"))

    def _lines(self) -> DataFrame:
        return files.lines(files.discover(self.spark, self.root))

    def _target(self, name: str) -> int:
        asked = self.spark.createDataFrame([(name, None)], "wanted string, in_file string")
        row = lookup.fuzzy(self.store.read("symbols"), asked).orderBy("file", "line", "id").first()
        if row is None:
            raise ValueError(f"no symbol {name!r}")
        return row["id"]

    def symbols(self, query: str, limit: int = 24, **filters) -> list[dict]:
        if not query.strip():
            raise ValueError("an empty query")
        rows = self.store.read("symbols")
        kind = filters.pop("kind", None)
        found = lookup.list_relaxed(rows, query, min(limit, schemas.SYMBOL_LIMIT), kind, **filters) if kind else lookup.list_symbols(rows, query, min(limit, schemas.SYMBOL_LIMIT), **filters)
        return [r.asDict() for r in found.select(lookup.handle().alias("handle"), "name", "kind", "file", "line", "end_line").collect()]

    def search(self, query: str, limit: int = 8, *, mode: str = "auto", kind: str | None = None) -> dict:
        if not query.strip():
            raise ValueError("an empty query")
        symbols = self.store.read("symbols")
        if mode in ("callers", "callees", "impact", "implementations", "implementors"):
            try:
                rows = search.graph_mode(symbols, self._graph(), self._target(query), mode, limit).collect()
                return search.envelope(query, [r.asDict() | {"bucket": "exact", "rank": k} for k, r in enumerate(rows, 1)])
            except ValueError:
                pass  # no such symbol: an ordinary search
        asked = self.spark.createDataFrame([(0, query)], "id long, text string")
        embedded = vector.hashing_embed(asked, "id", "text", DIMS).first()["embedding"]
        vectors = self.store.read("embeddings").withColumnRenamed("symbol_id", "id")
        facts = index.enclosures(self.store.read("facts"), symbols)
        rows = search.search(symbols, self._graph(), query, limit, kind=kind, facts=facts, lines=self._lines(), vectors=vectors, embedded=embedded)
        return search.envelope(query, [r.asDict() for r in rows.collect()])

    def _coupled(self, target: int) -> DataFrame:
        vectors = self.store.read("embeddings")
        own = vectors.where(F.col("symbol_id") == target).first()
        near = vector.knn(vectors, own["embedding"], 20) if own else self.spark.createDataFrame([], "id long, distance double")
        return coupling.coupled(self.store.read("symbols"), self._graph(), self.store.read("cochange"), near, target)

    def _shown(self, rows: DataFrame) -> list[dict]:
        met = rows.join(self.store.read("symbols").select("id", "name", "kind", "file", "line"), "id")
        score = "combined" if "combined" in rows.columns else "score"
        return [r.asDict() for r in met.orderBy(F.desc(score), "file", "line", "id").collect()]

    def related(self, name: str) -> list[dict]:
        return self._shown(self._coupled(self._target(name)).orderBy(F.desc("combined"), "id").limit(schemas.EXPANSION_LIMIT))

    def impact(self, name: str) -> list[dict]:
        return self._shown(coupling.impact(self.store.read("symbols"), self.store.read("edges"), self._graph(), self.store.read("cochange"), self._target(name)))

    def neighborhood(self, file: str, line: int) -> list[dict]:
        symbols = self.store.read("symbols")
        at = lookup.anchors(self.spark.createDataFrame([(file, line)], "file string, line long"), symbols).first()
        if at is None:
            raise ValueError(f"no symbol near {file}:{line}")
        return self._shown(coupling.neighbourhood(self._coupled(at["symbol_id"]), symbols, at["symbol_id"]))

    def inspect(self, handle: str, **budget) -> dict:
        tables = {n: self.store.read(n) for n in ("symbols", "facts", "callsites")} | {"lines": self._lines()}
        return evidence.inspect(handle, tables, **budget)

    def evidence_pack(self, question: str, tokens: int = 8_000) -> dict:
        return evidence.pack(question, self.store.read("symbols"), self._graph(), self._lines(), self.store.read("role_cards"), tokens=tokens)

    def status(self) -> dict:
        found = files.discover(self.spark, self.root)
        stale = index.stale_files(found, self.store.read("index_meta"), FINGERPRINT).count()
        counts = {n: self.store.read(n).count() for n in schemas.SCHEMAS}
        edges = self.store.read("edges").agg(F.count_if(F.col("target_id").isNotNull()).alias("resolved"), F.count_if(F.col("target_id").isNull()).alias("unresolved"))
        row = index.health(edges.withColumns({"stale": F.lit(stale), "degraded": F.lit(False)})).first()
        return counts | row.asDict() | {"schema_version": schemas.SCHEMA_VERSION, "revision": index.revision(self.store.read("symbols")).first()["revision"]}
