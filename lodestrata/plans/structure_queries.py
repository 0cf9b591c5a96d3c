"""Queries of the graph, edge, storage, summary and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import edges as edge_ops
from lodestrata.operators import evaluation as ev
from lodestrata.operators import graph, intent, summaries
from lodestrata.operators import reconcile as rec
from lodestrata.operators.fulltext import Corpus, Index
from lodestrata.plans.search_queries import BM, by_100, docs, text_queries
from lodestrata.plans.sql import BY_100, CC, EDGES, RC, bm25
from lodestrata.runtime import shared_folder
from lodestrata.sources.store import ChunkStore, persist_edges
from lodestrata.sources.store import ingest_full as run_full
from lodestrata.sources.store import ingest_incremental as run_incremental
from lodestrata.sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- graph: asked about the chunk that most edges lead to -------------------------------------

HUB = "hub as (select callee as node from edges group by callee order by count(*) desc, callee limit 1)"
ROOT = "root as (select caller as node from edges group by caller order by count(*) desc, caller limit 1)"


def hub(t: Tables, side: str = "callee") -> DataFrame:
    return t.edges().groupBy(c(side).alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


@query(f"with {EDGES} select distinct callee as node, caller as neighbour from edges")
def callers_of(t: Tables) -> DataFrame:
    e = t.edges()
    return graph.neighbours(e, e.select(c("callee").alias("node")).distinct(), "callers")


@query(f"with {EDGES} select distinct caller as node, callee as neighbour from edges")
def callees_of(t: Tables) -> DataFrame:
    e = t.edges()
    return graph.neighbours(e, e.select(c("caller").alias("node")).distinct(), "callees")


@query(f"with {EDGES}, {HUB} select distinct node, n as neighbour from hub join (select callee as node, caller as n from edges union all select caller, callee from edges) using (node)")
def graph_both(t: Tables) -> DataFrame:
    return graph.neighbours(t.edges(), hub(t), "both")


def bfs_sql(start: str, a: str, b: str) -> str:
    return f"""with recursive {EDGES}, {start}, walk(node, depth) as (select node, 0 from {start.split(' ')[0]} union select e.{b}, depth + 1 from walk join edges e on e.{a} = walk.node where depth < 3)
    select node, min(depth) as depth from walk where node not in (select node from {start.split(' ')[0]}) group by node"""


@query(bfs_sql(HUB, "callee", "caller"))
def bfs_callers(t: Tables) -> DataFrame:
    return graph.bfs(t.edges(), hub(t), "callers", 3)


@query(bfs_sql(ROOT, "caller", "callee"))
def bfs_callees(t: Tables) -> DataFrame:
    return graph.bfs(t.edges(), hub(t, "caller"), "callees", 3)


@query(
    f"""with recursive {EDGES}, {ROOT}, walk(node, path, depth) as (select node, [node], 0 from root union all select e.callee, list_append(path, e.callee), depth + 1 from walk join (select distinct caller, callee from edges) e on e.caller = walk.node where depth < 4 and not list_contains(path, e.callee)),
    goal as (select max(node) as goal from (select node, min(depth) as d from walk group by node) where d = 2)
    select array_to_string(path, ' > ') as path, depth as length from walk, goal where node = goal order by depth, path limit 1"""
)
def shortest_path(t: Tables) -> DataFrame:
    e, start = t.edges(), hub(t, "caller")
    goal = graph.bfs(e, start, "callees", 4).where("depth = 2").agg(F.max("node")).first()[0]
    found = graph.shortest_path(e, start.first().node, goal or "", 4)
    return found.select(F.array_join("path", " > ").alias("path"), "length")


@query(f"with {CC} select lower(identifier) as identifier, min(chunk_id) as chunk_id from cc group by lower(identifier) having count(distinct chunk_id) = 1")
def unique_identifier(t: Tables) -> DataFrame:
    return graph.unique_identifiers(t.code("identifier"))


UNIQUE = "uniq as (select lower(identifier) as identifier, min(chunk_id) as chunk_id from cc group by lower(identifier) having count(distinct chunk_id) = 1)"


@query(
    f"""with {CC}, {EDGES}, {UNIQUE} select identifier, 'callers' as view, caller as chunk_id from uniq join edges on callee = chunk_id
    union select identifier, 'callees', callee from uniq join edges on caller = chunk_id"""
)
def graph_tool(t: Tables) -> DataFrame:
    u = graph.unique_identifiers(t.code("identifier")).withColumnRenamed("chunk_id", "node")
    e = t.edges()
    views = [u.join(graph.neighbours(e, u.select("node"), way), "node").select("identifier", F.lit(way).alias("view"), c("neighbour").alias("chunk_id")) for way in ("callers", "callees")]
    return views[0].unionByName(views[1]).distinct()


def base_rows(t: Tables, k: int) -> DataFrame:
    return Corpus.of(docs(t)).topk(text_queries(t), k)


def target_candidates(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """First five BM25 rows of each question "What calls …?" about the questioner's own identifier, or without a term. rows: the search's rows, where it has run."""
    names = t.code("identifier")
    asked = names.where(by_100("chunk_id")).select(c("chunk_id").alias("query_id"), F.when(c("identifier").rlike("^[a-m]"), c("identifier")).alias("term"))
    found = (base_rows(t, 5) if rows is None else rows.where("rank <= 5")).select("query_id", "id", "rank")
    return found.join(names.withColumnRenamed("chunk_id", "id"), "id").join(asked, "query_id")


TARGET = f"""asked as (select chunk_id as query_id, case when regexp_matches(identifier, '^[a-m]') then identifier end as term from cc where {BY_100.format('chunk_id')}),
    cand0 as (select bm.query_id, bm.id, bm.rank, identifier, term, starts_with(identifier, 'test_') as test from bm join cc on id = chunk_id join asked using (query_id) where rank <= 5),
    cand as (select * from (select *, max((not test)::int) over (partition by query_id) as r from cand0) where r = 0 or not test),
    opts as (select query_id, id as chunk_id, rank, case when term is null then 4 when lower(identifier) = lower(term) then 1 when contains(lower(identifier), lower(term)) then 3 end as how from cand
      union all select distinct query_id, uniq.chunk_id, 0, 2 from cand join uniq on uniq.identifier = lower(term)),
    target as (select query_id, chunk_id, how from (select *, row_number() over (partition by query_id order by how, rank, chunk_id) as n from opts where how is not null) where n = 1)"""


@query(f"with {BM}, {UNIQUE}, {TARGET} select query_id, chunk_id, how from target")
def graph_target(t: Tables) -> DataFrame:
    return graph.resolve_target(target_candidates(t), graph.unique_identifiers(t.code("identifier")))


AUGMENT = """directed as (select query_id, chunk_id as node, case how when 1 then 'callers' when 2 then 'callees' else 'both' end as direction from target),
    aug as (select query_id, id, case min(tier) when 1 then 0.85::double when 2 then 0.8::double else 0.75::double end as score from directed join
      (select callee as node, caller as id, tier, 'callers' as way from edges union all select caller, callee, tier, 'callees' from edges) using (node) where direction in ('both', way) group by query_id, id)"""


def directed(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    found = graph.resolve_target(target_candidates(t, rows), graph.unique_identifiers(t.code("identifier")))
    way = F.when(c("how") == 1, "callers").when(c("how") == 2, "callees").otherwise("both")
    return found.select("query_id", c("chunk_id").alias("node"), way.alias("direction"))


def augmented(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    return graph.augment(directed(t, rows), t.edges())


@query(f"with {BM}, {EDGES}, {UNIQUE}, {TARGET}, {AUGMENT} select query_id, id, score from aug")
def graph_augment(t: Tables) -> DataFrame:
    return augmented(t)


MERGED = """base as (select query_id, id, score / 100 as score, rank from bm),
    merged as (select base.query_id, base.id, base.score, aug.id is not null as from_graph from base left join aug using (query_id, id)
      union all select query_id, id, score, true from aug where not exists (select 1 from base where base.query_id = aug.query_id and base.id = aug.id)),
    placed as (select *, row_number() over (partition by query_id order by from_graph, round(score, 9) desc, id) as pos from merged)"""


def listed(rows: DataFrame) -> DataFrame:
    """The same rows; no filters or columns of later steps get below the lists, so all that read them read the same shuffle."""
    return rows.groupBy("query_id").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select(F.inline("rows"))


def merged(t: Tables, best: int | None = None) -> DataFrame:
    """One search serves the base list and the targets. best: only so many of the graph's rows that the base list hasn't are wanted of each question."""
    rows = listed(base_rows(t, 10))
    base = rows.select("query_id", "id", (c("score") / 100).alias("score"))
    return graph.merge(base, augmented(t, rows)) if best is None else graph.merge_best(base, listed(directed(t, rows)), t.edges(), best + 10)


def placed(t: Tables, best: int | None = None) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy("from_graph", F.desc(F.round("score", 9)), "id")
    return merged(t, best).withColumn("pos", F.row_number().over(w))


G_BASE = f"with {BM}, {EDGES}, {UNIQUE}, {TARGET}, {AUGMENT}, {MERGED}"


@query(f"{G_BASE} select query_id, id, round(score, 6) as score, from_graph from merged")
def graph_merge(t: Tables) -> DataFrame:
    return merged(t).select("query_id", "id", F.round("score", 6).alias("score"), "from_graph")


@query(
    f"""{G_BASE}, g as (select *, pos <= 5 as upper from placed),
    h as (select *, sum((upper and from_graph)::int) over (partition by query_id) as have, sum((upper and not from_graph)::int) over (partition by query_id) as others,
      row_number() over (partition by query_id, from_graph, upper order by pos) as nth, row_number() over (partition by query_id, upper, from_graph order by round(score, 9) desc, pos) as best from g),
    l as (select *, (not upper and from_graph and nth <= greatest(0, 2 - have)) as lifted from h), m as (select *, sum(lifted::int) over (partition by query_id) as lifts from l),
    kept as (select * from m where (upper and (from_graph or best <= others - least(lifts, others))) or lifted)
    select query_id, id, round(score, 6) as score, from_graph, rank from (select *, row_number() over (partition by query_id order by case when lifts = 0 then pos end, round(score, 9) desc, pos) as rank from kept) where rank <= 5"""
)
def graph_reserve(t: Tables) -> DataFrame:
    return graph.reserve(placed(t), 5, 2).select("query_id", "id", F.round("score", 6).alias("score"), "from_graph", c("rank").cast("long").alias("rank"))


@query(
    f"""{G_BASE}, n as (select *, row_number() over (partition by query_id, from_graph order by case when from_graph then -round(score, 9) end, case when not from_graph then pos end, id) as nth from placed)
    select query_id, id, round(score, 6) as score, from_graph, rank from (select *, row_number() over (partition by query_id order by from_graph desc, nth) as rank from n where not from_graph or nth <= 4) where rank <= 5"""
)
def graph_partition(t: Tables) -> DataFrame:
    # prepend takes four of the graph's rows at most; of the best fourteen the base list has ten at most
    return graph.prepend(placed(t, 4), 5).select("query_id", "id", F.round("score", 6).alias("score"), "from_graph", c("rank").cast("long").alias("rank"))


# --- edges: the calls of the stored graph, resolved again ----------------------------------------

CALLS = f"""{CC}, {EDGES}, calls as (select distinct caller, callee_identifier from edges),
    imported as (select caller_file as file_path, callee_identifier as imported_name, 'crate::' || replace(regexp_replace(callee_file, '\\.[^./]*$', ''), '/', '::') as source_path, strlen(callee_file) as position from edges where tier = 2
      union all select caller_file, callee_identifier, 'zz::earlier', 0 from edges where tier = 2),
    imports as (select file_path, imported_name, arg_max(source_path, (position, source_path)) as source_path from imported group by all),
    cand as (select caller, callee_identifier, a.file_path as caller_file, b.chunk_id as callee, b.file_path as callee_file from calls join cc a on a.chunk_id = caller join cc b on b.identifier = callee_identifier where caller <> b.chunk_id)"""
P = "replace(replace(regexp_replace({0}, '^(crate::|super::|self::)+', ''), '::', '/'), '.', '/')"
FITS = f"contains(callee_file, {P.format('source_path')})"


def call_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = t.edges()
    calls = e.select("caller", "callee_identifier").distinct()
    source = F.concat(F.lit("crate::"), F.replace(F.regexp_replace("callee_file", r"\.[^./]*$", ""), F.lit("/"), F.lit("::")))
    named = e.where("tier = 2").select(c("caller_file").alias("file_path"), c("callee_identifier").alias("imported_name"), source.alias("source_path"), F.octet_length("callee_file").alias("position"))
    # each name is imported once more, earlier, from a path that sorts last
    imports = named.unionByName(named.withColumns({"source_path": F.lit("zz::earlier"), "position": F.lit(0)}))
    return t.code("identifier", "file_path"), calls, imports


@query(f"with {CALLS} select caller, callee_identifier, callee from cand")
def edges_candidates(t: Tables) -> DataFrame:
    chunks, calls, _ = call_inputs(t)
    return edge_ops.candidates(chunks, calls).select("caller", "callee_identifier", "callee")


@query(
    f"""with {CALLS}, w as (select cand.*, caller_file = callee_file as local, coalesce({FITS}, false) as fits from cand left join imports on file_path = caller_file and imported_name = callee_identifier),
    r as (select caller, callee_identifier, case when count(*) filter (local) = 1 then max(callee) filter (local) end as t1, case when count(*) filter (fits) = 1 then max(callee) filter (fits) end as t2, case when count(*) = 1 then max(callee) end as t3 from w group by all)
    select sha256('edge:' || caller || ':' || coalesce(t1, t2, t3)) as edge_id, caller, coalesce(t1, t2, t3) as callee, callee_identifier, (case when t1 is not null then 1 when t2 is not null then 2 else 3 end)::int as tier from r where coalesce(t1, t2, t3) is not null"""
)
def edge_resolution(t: Tables) -> DataFrame:
    return edge_ops.resolve(*call_inputs(t))


@query(f"with {CALLS} select distinct caller_file, callee_file, source_path, {FITS} as fits from cand join imports on file_path = caller_file and imported_name = callee_identifier")
def import_path_match(t: Tables) -> DataFrame:
    chunks, calls, imports = call_inputs(t)
    last = edge_ops.last_imports(imports)
    wide = edge_ops.candidates(chunks, calls).join(last, (c("file_path") == c("caller_file")) & (c("imported_name") == c("callee_identifier")))
    return wide.select("caller_file", "callee_file", "source_path", edge_ops.import_matches(c("callee_file"), c("source_path")).alias("fits")).distinct()


@query(f"with {EDGES} select caller, callee, tier from edges")
def export_edges(t: Tables) -> DataFrame:
    return t.edges().select("caller", "callee", "tier")


# --- storage ---------------------------------------------------------------------------------------


@query("select * replace (array_to_string(dependencies, ',') as dependencies) from crate_chunks")
def scan_full(t: Tables) -> DataFrame:
    return t.crates().withColumn("dependencies", F.array_join("dependencies", ","))


@query("select chunk_id, file_path, start_line from code_chunks where language = 'rust' and start_line > 100")
def scan_filter_project(t: Tables) -> DataFrame:
    return t.raw("code_chunks").where("language = 'rust' and start_line > 100").select("chunk_id", "file_path", "start_line")


@query(f"with {CC}, {EDGES} select chunk_id, identifier from cc where chunk_id in (select callee from edges)")
def lookup_by_ids(t: Tables) -> DataFrame:
    return t.code("identifier").join(t.edges().select(c("callee").alias("chunk_id")), "chunk_id", "left_semi")


@query(f"with {CC} select file_path as path, min(content_hash) as content_hash, array_to_string(list_sort(list_distinct(list(chunk_id))), ',') as chunk_ids from cc group by file_path")
def file_index(t: Tables) -> DataFrame:
    return rec.file_index(t.code("file_path", "content_hash")).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("select distinct project_name from code_chunks")
def list_projects(t: Tables) -> DataFrame:
    return t.raw("code_chunks").select("project_name").distinct()


@query("select project_name from code_chunks union select project_name from readme_chunks union select project_name from crate_chunks")
def union_distinct_projects(t: Tables) -> DataFrame:
    return rec.union_all([t.raw(n).select("project_name").distinct() for n in ("code_chunks", "readme_chunks", "crate_chunks")]).distinct()


@query(f'with {CC} select embedding_model_version, count(*) as "rows" from cc group by embedding_model_version')
def model_version_check(t: Tables) -> DataFrame:
    return rec.mixed_models(t.code("embedding_model_version"))


#: the older snapshot is what was committed before this day, the newer one everything, with files of one project gone
SPLIT = "2025-06-01"
SNAPSHOTS = f"""{CC}, gone as (select project_name as p from cc group by 1 order by count(*) desc, 1 limit 1), old as (select chunk_id, file_path, content_hash, identifier, embedding_model_version from cc where committed_at < timestamp '{SPLIT}' or committed_at is null),
    new as (select chunk_id, file_path, case when language = 'go' then content_hash || 'v2' else content_hash end as content_hash, identifier, embedding_model_version from cc, gone where project_name <> p)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    cc = t.code("file_path", "content_hash", "identifier", "embedding_model_version", "committed_at", "project_name", "language")
    gone = cc.groupBy("project_name").count().orderBy(F.desc("count"), "project_name").first().project_name
    keep = ["chunk_id", "file_path", "content_hash", "identifier", "embedding_model_version"]
    old = cc.where((c("committed_at") < F.lit(SPLIT).cast("timestamp_ntz")) | c("committed_at").isNull()).select(*keep)
    new = cc.where(c("project_name") != gone).withColumn("content_hash", F.when(c("language") == "go", F.concat("content_hash", F.lit("v2"))).otherwise(c("content_hash"))).select(*keep)
    return old, new


STATUS = """st as (select coalesce(o.file_path, n.file_path) as path, case when o.h is null then 'new' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'changed' end as status
    from (select file_path, min(content_hash) as h from old group by file_path) o full join (select file_path, min(content_hash) as h from new group by file_path) n on o.file_path = n.file_path)"""


def statuses(t: Tables) -> DataFrame:
    old, new = snapshots(t)
    keyed = lambda d: d.select(c("file_path").alias("path"), "content_hash")
    return rec.status(keyed(old), keyed(new))


@query(f"with {SNAPSHOTS}, {STATUS} select path, status from st")
def reconcile_status(t: Tables) -> DataFrame:
    return statuses(t)


@query(f"with {SNAPSHOTS}, {STATUS} select count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'new') as new, count(*) filter (status = 'deleted') as deleted from st")
def reconcile_stats(t: Tables) -> DataFrame:
    return rec.stats(statuses(t))


@query(f"with {SNAPSHOTS} select distinct chunk_id from old where chunk_id not in (select chunk_id from new)")
def reconcile_deletes(t: Tables) -> DataFrame:
    return rec.deletions(*snapshots(t))


@query(f"with {SNAPSHOTS} select * from old where chunk_id not in (select chunk_id from new) union all select * from new")
def merge_upsert(t: Tables) -> DataFrame:
    return rec.upsert(*snapshots(t), "chunk_id")


STORED = ["chunk_id", "file_path", "content_hash", "identifier", "embedding_model_version", "project_name", "searchable_text"]
STORES = f"""{CC}, gone as (select project_name as p from cc group by 1 order by count(*) desc, 1 limit 1), old as (select {', '.join(STORED)} from cc where committed_at < timestamp '{SPLIT}' or committed_at is null),
    new as (select {', '.join(STORED).replace('content_hash', "case when language = 'go' then content_hash || 'v2' else content_hash end as content_hash")} from cc, gone where project_name <> p)"""


def stored_snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The two snapshots with all that a store keeps of them."""
    more = t.code("project_name", "searchable_text")
    return tuple(d.join(more, "chunk_id").select(*STORED) for d in snapshots(t))


def stocked(t: Tables, name: str, rows: DataFrame) -> ChunkStore:
    """A fresh store in the shared folder that holds ``rows``."""
    store = ChunkStore(t.spark, shared_folder(t.spark, "store"), buckets=8)
    store.upsert(name, rows)
    return store


@query(f"with {STORES} select * from old where project_name not in (select project_name from new) union all select * from new")
def ingest_full(t: Tables) -> DataFrame:
    """The older snapshot is stored, then the projects of the newer one are ingested anew; the table as written."""
    old, new = stored_snapshots(t)
    store = stocked(t, "code_chunks", old)
    run_full(store, {"code_chunks": new})
    return store.read("code_chunks").select(*STORED)


@query(
    f"""with {STORES}, {STATUS} select old.* from old join st on path = file_path and status = 'unchanged'
    union all select new.* from new join st on path = file_path and status in ('new', 'changed')"""
)
def ingest_incremental(t: Tables) -> DataFrame:
    """The older snapshot is stored, then the newer one comes in incrementally; the table as written."""
    old, new = stored_snapshots(t)
    store = stocked(t, "code_chunks", old)
    run_incremental(store, {"code_chunks": new})
    return store.read("code_chunks").select(*STORED)


@query(f"with {STORES}, {STATUS}, done as (select old.* from old join st on path = file_path and status = 'unchanged' union all select new.* from new join st on path = file_path and status in ('new', 'changed')), {bm25('(select chunk_id as id, searchable_text as text from done)', '(select chunk_id as query_id, searchable_text as query from done where ' + BY_100.format('chunk_id') + ')')} select query_id, id, round(score, 6) as score, rank from bm")
def ingest_index(t: Tables) -> DataFrame:
    """A search in the full-text index that the incremental run left behind."""
    old, new = stored_snapshots(t)
    store = stocked(t, "code_chunks", old)
    run_incremental(store, {"code_chunks": new})
    asked = store.read("code_chunks").where(by_100("chunk_id")).select(c("chunk_id").alias("query_id"), c("searchable_text").alias("query"))
    found = Index.open(t.spark, f"{store.folder}/_fulltext/code_chunks").topk(asked, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank"))


EDGE_COLUMNS = ["edge_id", "caller", "callee", "caller_identifier", "callee_identifier", "caller_file", "callee_file", "project_name", "tier"]


@query(f"with {EDGES}, top as (select project_name as p from edges group by 1 order by count(*) desc, 1 limit 1) select {', '.join(EDGE_COLUMNS)} from edges, top where project_name <> p or tier = 1")
def edge_persistence(t: Tables) -> DataFrame:
    """All edges are stored, then those of one project are replaced by its edges of tier 1."""
    e = t.edges().select(*EDGE_COLUMNS)
    top = e.groupBy("project_name").count().orderBy(F.desc("count"), "project_name").first().project_name
    store = stocked(t, "call_edges", e)
    persist_edges(store, e.where((c("project_name") == top) & (c("tier") == 1)))
    return store.read("call_edges").select(*EDGE_COLUMNS)


def diff_sql(path: str) -> str:
    return f"""st as (select coalesce(o.path, n.path) as path, case when o.h is null then 'new' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'changed' end as status
      from (select {path} as path, min(content_hash) as h from old group by 1) o full join (select {path} as path, min(content_hash) as h from new group by 1) n on o.path = n.path)
    select 'status' as part, path as subject, status from st union all select distinct 'come', chunk_id, null from new join st on path = {path} where status in ('new', 'changed')
    union all select distinct 'go', chunk_id, null from old join st on path = {path} where status in ('changed', 'deleted') and chunk_id not in (select chunk_id from new)"""


def diffed(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    d = rec.reconcile(old, new, path, "chunk_id")
    none = F.lit(None).cast("string")
    parts = [d.status.select(F.lit("status").alias("part"), c("path").alias("subject"), "status"), d.come.select(F.lit("come").alias("part"), c("chunk_id").alias("subject"), none.alias("status")).distinct(), d.go.select(F.lit("go").alias("part"), c("chunk_id").alias("subject"), none.alias("status"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {SNAPSHOTS}, {diff_sql('file_path')}")
def reconcile_files(t: Tables) -> DataFrame:
    """Many chunks a path."""
    return diffed(*snapshots(t), "file_path")


@query(f"with {RC}, gone as (select project_name as p from rc group by 1 order by count(*) desc, 1 limit 1), old as (select chunk_id, file_path, content_hash from rc where committed_at < timestamp '{SPLIT}' or committed_at is null), new as (select chunk_id, file_path, case when length(content) % 5 = 0 then content_hash || 'v2' else content_hash end as content_hash from rc, gone where project_name <> p), {diff_sql('file_path')}")
def reconcile_paths(t: Tables) -> DataFrame:
    """One chunk a path."""
    rc = t.readme("file_path", "content_hash", "content", "committed_at", "project_name")
    gone = rc.groupBy("project_name").count().orderBy(F.desc("count"), "project_name").first().project_name
    old = rc.where((c("committed_at") < F.lit(SPLIT).cast("timestamp_ntz")) | c("committed_at").isNull())
    new = rc.where(c("project_name") != gone).withColumn("content_hash", F.when(F.length("content") % 5 == 0, F.concat("content_hash", F.lit("v2"))).otherwise(c("content_hash")))
    return diffed(old.select("chunk_id", "file_path", "content_hash"), new.select("chunk_id", "file_path", "content_hash"), "file_path")


@query(f"with old as (select chunk_id, crate_name, content_hash from crate_chunks where length(crate_name) % 3 <> 0), new as (select chunk_id, crate_name, case when length(crate_name) % 4 = 0 then content_hash || 'v2' else content_hash end as content_hash from crate_chunks where length(crate_name) % 5 <> 0), {diff_sql('crate_name')}")
def reconcile_crates(t: Tables) -> DataFrame:
    """By a crate's name."""
    k, n = t.crates().select("chunk_id", "crate_name", "content_hash"), F.length("crate_name")
    new = k.where(n % 5 != 0).withColumn("content_hash", F.when(n % 4 == 0, F.concat("content_hash", F.lit("v2"))).otherwise(c("content_hash")))
    return diffed(k.where(n % 3 != 0), new, "crate_name")


@query(f"with {CC} select chunk_id, project_name from cc where not (language = 'go' and coalesce(contains(file_path, '/tests/'), false))")
def delete_by_predicate(t: Tables) -> DataFrame:
    return rec.delete_where(t.code("project_name", "language", "file_path"), (c("language") == "go") & c("file_path").contains("/tests/")).select("chunk_id", "project_name")


@query(f"with {CC}, {EDGES} select chunk_id, identifier from cc where chunk_id not in (select callee from edges)")
def delete_by_ids(t: Tables) -> DataFrame:
    return rec.delete_ids(t.code("identifier"), t.edges().select(c("callee").alias("chunk_id")), "chunk_id")


# --- summaries -----------------------------------------------------------------------------------

M_NAME = "regexp_replace(coalesce(list_filter(regexp_split_to_array({0}, '[/\\\\]'), lambda x: x <> '')[-1], ''), '^(.+)\\.[^.]*$', '\\1')"
B_NAME = "coalesce(list_filter(regexp_split_to_array({0}, '[/\\\\]'), lambda x: x <> '')[-1], '')"
CLEAN = "nullif(left(trim(regexp_replace(regexp_split_to_array({0}, '\\r?\\n')[1], '\\s+', ' ', 'g')), 140), '')"
PUBLIC = """case language when 'rust' then coalesce(starts_with(ltrim(signature), 'pub '), false) when 'python' then not starts_with(identifier, '_') or starts_with(identifier, '__')
    when 'typescript' then coalesce(regexp_matches(signature, '(^|[^\\p{L}\\p{N}_])export($|[^\\p{L}\\p{N}_])'), false) else true end"""
PURPOSE = f"""purpose as (select file_path, coalesce({CLEAN.format('d')}, 'This file defines ' || {M_NAME.format('file_path')} || '.') as purpose from (select file_path, arg_min(docstring, (start_line, chunk_id)) filter (docstring is not null) as d from cc group by file_path))"""
names = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(f"with {CC}, {PURPOSE} select file_path, purpose from purpose")
def file_purpose(t: Tables) -> DataFrame:
    return summaries.file_purpose(t.code("file_path", "docstring", "start_line"))


def first_n(expr: str, cond: str, n: int) -> str:
    return f"coalesce(nullif(array_to_string(list_sort(list_distinct(list({expr}) filter ({cond})))[1:{n}], ', '), ''), 'none')"


@query(
    f"""with {CC}, {EDGES}, {PURPOSE}, imp as (select caller_file as file_path, {first_n('callee_identifier', 'true', 16)} as imports from edges where caller_file <> callee_file group by caller_file),
    b as (select file_path, min(language) as language, {first_n('identifier', PUBLIC + ' and node_type in (' + names(summaries.FILE_TYPES + summaries.FILE_FUNCTIONS) + ')', 16)} as exports from cc group by file_path)
    select file_path, 'File: ' || file_path || ' (module: ' || {M_NAME.format('file_path')} || ', ' || language || ')' || chr(10) || 'Exports: ' || exports || chr(10) || 'Imports: ' || coalesce(imports, 'none') || chr(10) || 'Purpose: ' || purpose as summary_text
    from b left join imp using (file_path) join purpose using (file_path)"""
)
def file_summary(t: Tables) -> DataFrame:
    imports = t.edges().where("caller_file <> callee_file").select(c("caller_file").alias("file_path"), c("callee_identifier").alias("imported_name"))
    return summaries.file_summary(t.code("file_path", "language", "signature", "identifier", "node_type", "docstring", "start_line"), imports)


@query(
    f"""with {CC}, f as (select *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder from cc),
    b as (select folder, count(distinct file_path) as file_count, coalesce(nullif(array_to_string(list_sort(list_distinct(list(language))), ', '), ''), 'n/a') as languages,
      {first_n('identifier', PUBLIC + ' and node_type in (' + names(summaries.FOLDER_TYPES) + ')', 12)} as types, {first_n('identifier', PUBLIC + ' and node_type in (' + names(summaries.FOLDER_FUNCTIONS) + ')', 12)} as functions from f group by folder),
    s as (select regexp_extract(folder, '^(.*)/[^/]*$', 1) as parent, array_to_string(list_sort(list_distinct(list({B_NAME.format('folder')}))), ', ') as subs from (select distinct folder from f where folder <> '') group by parent)
    select folder as folder_path, file_count, 'Folder: ' || folder || ' (module: ' || {B_NAME.format('folder')} || ')' || chr(10) || 'Contains: ' || file_count || ' files (' || languages || ')' || chr(10) || 'Key types: ' || types || chr(10) || 'Key functions: ' || functions || chr(10) || 'Subfolders: ' || coalesce(subs, 'none') as summary_text
    from b left join s on parent = folder"""
)
def folder_summary(t: Tables) -> DataFrame:
    return summaries.folder_summary(t.code("file_path", "language", "signature", "identifier", "node_type"))


# --- evaluation: each queried chunk is a case that expects itself -----------------------------------

CASES = f"""cases as (select chunk_id as case_id, 'file' as kind, file_path as expected from q union all select chunk_id, 'identifier', identifier from q union all select chunk_id, 'project', project_name from q
      union all select chunk_id, 'chunk_type', 'code' from q union all select chunk_id, 'excluded', '/vendor/' from q union all select chunk_id, 'file', 'no/such/file.rs' from q where node_type = 'impl_item'),
    retrieved as (select bm.query_id as case_id, rank, 'code' as chunk_type, file_path, identifier, project_name as project, 1.0::double / rank as relevance from bm join cc on chunk_id = id)"""
EV = f"with {BM}, q as (select * from cc where {BY_100.format('chunk_id')}), {CASES}"
MATCH = "case when kind in ('file', 'excluded') then contains(file_path, expected) when kind = 'identifier' then coalesce(identifier = expected, false) when kind = 'chunk_type' then chunk_type = expected else project = expected end"


def cases(t: Tables) -> DataFrame:
    q = t.code("file_path", "identifier", "project_name", "node_type").where(by_100("chunk_id"))
    want = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("expected"))
    wants = F.array(
        want("file", c("file_path")), want("identifier", c("identifier")), want("project", c("project_name")), want("chunk_type", F.lit("code")),
        want("excluded", F.lit("/vendor/")), want("file", F.when(c("node_type") == "impl_item", "no/such/file.rs")),
    )
    return q.select(c("chunk_id").alias("case_id"), F.explode(wants).alias("w")).select("case_id", "w.*").where("expected is not null")


def retrieved(t: Tables) -> DataFrame:
    found = Corpus.of(docs(t)).topk(text_queries(t), 10)
    meta = t.code("file_path", "identifier", "project_name").withColumnsRenamed({"chunk_id": "id", "project_name": "project"})
    return found.join(meta, "id").select(c("query_id").alias("case_id"), "rank", F.lit("code").alias("chunk_type"), "file_path", "identifier", "project", (1.0 / c("rank")).alias("relevance"))


def hit_sql(k: str) -> str:
    return f"select case_id, kind, expected, coalesce(max({MATCH}), false) as hit from (select distinct * from cases) left join (select * from retrieved where {k}) using (case_id) group by all"


def recall_sql(k: str) -> str:
    return f"select case_id, avg(hit::int::double) as recall from ({hit_sql(k)}) where kind in ('file', 'identifier') group by case_id"


MRR = f"select case_id, coalesce(1.0::double / min(rank) filter ({MATCH}), 0) as mrr from (select distinct * from cases where kind in ('file', 'identifier')) left join retrieved using (case_id) group by case_id"


@query(f"{EV} {hit_sql('rank <= 10')}")
def harness_hits(t: Tables) -> DataFrame:
    return ev.hits(cases(t), retrieved(t), 10)


@query(f"{EV} select case_id, a.recall as recall_5, b.recall as recall_pool from ({recall_sql('rank <= 5')}) a join ({recall_sql('true')}) b using (case_id)")
def harness_recall(t: Tables) -> DataFrame:
    k, r = cases(t), retrieved(t)
    return ev.recall(k, r, 5).withColumnRenamed("recall", "recall_5").join(ev.recall(k, r, None).withColumnRenamed("recall", "recall_pool"), "case_id")


@query(f"{EV} select case_id, round(mrr, 6) as mrr from ({MRR})")
def harness_mrr(t: Tables) -> DataFrame:
    return ev.reciprocal_rank(cases(t), retrieved(t)).select("case_id", F.round("mrr", 6).alias("mrr"))


@query(f"{EV} select case_id, rank, expected, file_path from retrieved join (select case_id, expected from cases where kind = 'project') using (case_id)")
def harness_join(t: Tables) -> DataFrame:
    return retrieved(t).join(cases(t).where("kind = 'project'").select("case_id", "expected"), "case_id").select("case_id", c("rank").cast("long").alias("rank"), "expected", "file_path")


INTENT_OF = "case when contains(node_type, 'function') then 'implementation' when contains(node_type, 'class') then 'overview' else 'relationship' end"
METRICS = f"m as (select case_id, a.recall as r5, b.recall as r10, p.recall as rp, mrr, {INTENT_OF} as intent from ({recall_sql('rank <= 5')}) a join ({recall_sql('rank <= 10')}) b using (case_id) join ({recall_sql('true')}) p using (case_id) join ({MRR}) using (case_id) join q on q.chunk_id = case_id)"


def case_metrics(t: Tables) -> DataFrame:
    kind = F.when(c("node_type").contains("function"), "implementation").when(c("node_type").contains("class"), "overview").otherwise("relationship")
    return ev.case_metrics(cases(t), retrieved(t)).join(t.code("node_type").select(c("chunk_id").alias("case_id"), kind.alias("intent")), "case_id")


def means() -> list:
    return [F.count("*").alias("queries"), *[F.round(F.avg(x), 6).alias(x) for x in ("recall_5", "recall_10", "recall_pool", "mrr")]]


MEANS = "count(*) as queries, round(avg(r5), 6) as recall_5, round(avg(r10), 6) as recall_10, round(avg(rp), 6) as recall_pool, round(avg(mrr), 6) as mrr"


@query(f"{EV}, {METRICS} select {MEANS} from m")
def harness_aggregate(t: Tables) -> DataFrame:
    return case_metrics(t).agg(*means())


@query(f"{EV}, {METRICS} select intent, {MEANS} from m group by intent")
def harness_by_intent(t: Tables) -> DataFrame:
    return case_metrics(t).groupBy("intent").agg(*means())


@query(f"{EV} select case_id, string_agg(chunk_type || ':' || coalesce(identifier, file_path) || ' (' || round(relevance * 100)::int || '%)', ', ' order by rank) as top_results, count(*) filter (relevance > 0.5) as relevant_count from retrieved group by case_id")
def harness_query_report(t: Tables) -> DataFrame:
    line = F.concat("chunk_type", F.lit(":"), F.coalesce("identifier", "file_path"), F.lit(" ("), F.round(c("relevance") * 100).cast("int").cast("string"), F.lit("%)"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), ", ")
    return retrieved(t).groupBy("case_id").agg(listed.alias("top_results"), F.count_if(c("relevance") > 0.5).alias("relevant_count"))


@query(f"{EV}, n as (select case_id, count(*) filter (relevance > 0.5) as relevant_count from retrieved where rank <= 10 group by case_id) select chunk_id as case_id, coalesce(relevant_count, 0) as relevant_count, coalesce(relevant_count, 0) >= coalesce(case when node_type = 'impl_item' then 2 end, 0) as enough from q left join n on case_id = chunk_id")
def harness_min_relevant(t: Tables) -> DataFrame:
    wanted = t.code("node_type").where(by_100("chunk_id")).select(c("chunk_id").alias("case_id"), F.when(c("node_type") == "impl_item", 2).alias("min_relevant_results"))
    return ev.enough_relevant(wanted, retrieved(t), 10)


LAT = "lat as (select event_id as id, abs(value) as ms from events)"


@query(
    f"""{EV}, {LAT}, {METRICS}, med as (select quantile_disc(ms order by ms desc, 0.5) as m from lat)
    select 'never found' as warning, expected as subject from (select expected, max(hit) as any_hit from ({hit_sql('true')}) where kind = 'file' group by expected) where not any_hit
    union all select 'recall 0', intent from m group by intent having max(r5) = 0
    union all select 'slow', id::varchar from lat, med where ms > 5 * m and m > 0""".replace("quantile_disc(ms order by ms desc, 0.5)", "(list_sort(list(ms)))[count(*) // 2 + 1]")
)
def harness_warnings(t: Tables) -> DataFrame:
    lost = ev.never_found(cases(t), retrieved(t)).select(F.lit("never found").alias("warning"), c("expected").alias("subject"))
    zero = case_metrics(t).groupBy("intent").agg(F.max("recall_5").alias("r")).where("r = 0").select(F.lit("recall 0").alias("warning"), c("intent").alias("subject"))
    late = ev.slow(t.raw("events").select(c("event_id").alias("case_id"), F.abs("value").alias("ms"))).select(F.lit("slow").alias("warning"), c("case_id").cast("string").alias("subject"))
    return lost.unionByName(zero).unionByName(late)


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def latency_percentile(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("event_type").agg(ev.percentile("value", 0.5).alias("p50"), ev.percentile("value", 0.95).alias("p95"))


@query(
    f"""select case_id, 'repeated id' as problem from (select chunk_id as case_id, node_type as expected_intent from code_chunks) group by case_id having count(*) > 1
    union select chunk_id, 'unknown intent' from code_chunks where node_type not in ({names(intent.INTENTS)})"""
)
def dataset_validate(t: Tables) -> DataFrame:
    return ev.invalid_cases(t.raw("code_chunks").select(c("chunk_id").alias("case_id"), c("node_type").alias("expected_intent")), intent.INTENTS)


@query("select crate_name from crate_chunks where list_has_any(dependencies, (select list(crate_name) from (select crate_name from crate_chunks order by crate_name limit 5)))")
def filter_by_tag(t: Tables) -> DataFrame:
    tags = [r.crate_name for r in t.crates().select("crate_name").orderBy("crate_name").limit(5).collect()]
    return t.crates().where(F.arrays_overlap("dependencies", F.array(*map(F.lit, tags)))).select("crate_name")
