"""Queries of the six chunk types and of the whole pipeline, each with its SQL.

Questions are put, in six fixed templates, about every code chunk whose id, as
a number, is divisible by 100; all rows of all types are searched. Vectors and
rerank scores are those of the stand-ins that need no model, so SQL has them too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import fusion, intent
from lodestrata.operators.fulltext import Corpus, Index, write_index
from lodestrata.operators.intent import TYPES
from lodestrata.operators.vectors import knn_batch
from lodestrata.plans import chunk_types, harness, structure_queries
from lodestrata.plans.retrieve import EngineConfig, Retrieved, retrieve
from lodestrata.plans.scalar_queries import CRATE_TEXT, comparator_sql, target_sql
from lodestrata.plans.search_queries import BM, by_100, docs, renamed, show, text_queries
from lodestrata.plans.seams import term_vector
from lodestrata.plans.sql import BY_100, CC, EDGES, RC, bm25, cut, searchable, tokens
from lodestrata.runtime import shared_folder
from lodestrata.sources.bundle import Bundle, frequencies, read_bundle, write_bundle
from lodestrata.sources.store import SPECS, ChunkStore
from lodestrata.sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
DIM = 16


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


TEMPLATES = ["What calls {i}?", "How does {i} work?", "What is the purpose of the {p} project?", "Compare {i} and {p}", "What does {i} call?", "Show me the implementation of {i}"]


def questions(t: Tables) -> DataFrame:
    number = F.conv(F.substring("chunk_id", -12, 12), 16, 10).cast("long")
    text = F.lit(None).cast("string")
    for n, s in enumerate(TEMPLATES):
        put = F.replace(F.replace(F.lit(s), F.lit("{i}"), c("identifier")), F.lit("{p}"), c("project_name"))
        text = F.when(F.pmod(F.floor(number / 100), F.lit(len(TEMPLATES))) == n, put).otherwise(text)
    return t.code("identifier", "project_name").where(by_100("chunk_id")).select(c("chunk_id").alias("query_id"), text.alias("query"))


# --- SQL of questions, chunk types, vectors and lists --------------------------------------------

PUT = " ".join(f"when {n} then replace(replace('{s}', '{{i}}', identifier), '{{p}}', project_name)" for n, s in enumerate(TEMPLATES))
Q = f"q as materialized (select chunk_id as query_id, case (('0x' || right(chunk_id, 12))::bigint // 100) % {len(TEMPLATES)} {PUT} end as query from cc where {BY_100.format('chunk_id')})"


def vector_sql(rel: str, id: str, text: str, name: str) -> str:
    """Relation ``name``(id, vector): the stand-in embedder's vectors."""
    return f"""{name}_b as (select {id} as id, list_transform({tokens(text)}, lambda t: ('0x' || left(md5(t), 2))::int % {DIM}) as bk from {rel}),
    {name}_c as (select id, list_transform(range(0, {DIM}), lambda b: len(list_filter(bk, lambda x: x = b))::double) as cv from {name}_b),
    {name} as materialized (select id, list_transform(cv, lambda x: x / greatest(sqrt(list_sum(list_transform(cv, lambda y: y * y))), 1.0::double)) as vector from {name}_c)"""


def sha(path: str, text: str) -> str:
    return f"sha256(replace('chunk:' || {path} || ':' || {text}, chr(13) || chr(10), chr(10)))"


MOD_PATH = "coalesce(source, 'unknown') || '/' || doc_id || '/lib.rs'"
MODULE_DOCS = f"md as materialized (select {sha(MOD_PATH, 'text')} as chunk_id, {MOD_PATH} as file_path, coalesce(source, 'unknown') as module_name, text as doc_content, coalesce(project_name, 'unknown') as project_name from documents where doc_kind = 'module_doc' and text is not null and doc_id is not null)"
FOLDERS = f"""fo as materialized (select {sha('folder_path', 'summary_text')} as chunk_id, folder_path, summary_text, project_name from ({structure_queries.ORACLES['folder_summary']})
    join (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder_path, min(project_name) as project_name from cc group by 1) using (folder_path))"""
FILES = f"""fi as materialized (select {sha("'file:' || file_path", 'summary_text')} as chunk_id, file_path, summary_text, project_name from ({structure_queries.ORACLES['file_summary']})
    join (select file_path, min(project_name) as project_name from cc group by 1) using (file_path))"""
RELATIONS = {
    "code": f"select chunk_id as id, file_path, identifier, project_name as project, start_line as line, searchable_text as text, searchable_text as emb, concat_ws(chr(10), coalesce(signature, identifier) || ' (' || language || ')', nullif(docstring, ''), {cut('code_content', 1200, '...')}) as rr from cc",
    "readme": f"select chunk_id as id, file_path, null::varchar as identifier, project_name as project, null::bigint as line, content as text, 'Project: ' || project_name || chr(10) || content as emb, 'Project: ' || project_name || chr(10) || {cut('content', 1500, '...')} as rr from rc",
    "crate": f"select chunk_id as id, crate_path as file_path, crate_name as identifier, project_name as project, null::bigint as line, description as text, {CRATE_TEXT} as emb, {CRATE_TEXT} as rr from crate_chunks",
    "module_doc": "select chunk_id as id, file_path, module_name as identifier, project_name as project, null::bigint as line, doc_content as text, 'Module: ' || module_name || chr(10) || doc_content as emb, 'Module: ' || module_name || chr(10) || doc_content as rr from md",
    "folder": "select chunk_id as id, folder_path as file_path, null::varchar as identifier, project_name as project, null::bigint as line, summary_text as text, summary_text as emb, summary_text as rr from fo",
    "file": "select chunk_id as id, file_path, null::varchar as identifier, project_name as project, null::bigint as line, summary_text as text, summary_text as emb, summary_text as rr from fi",
}
BASE = f"{CC}, {RC}, {MODULE_DOCS}, {FOLDERS}, {FILES}, {Q}, {vector_sql('q', 'query_id', 'query', 'qv')}"


def words_cut(e: str, limit: int) -> str:
    k = cut(e, limit)
    return f"case when strlen({e}) <= {limit} then {e} when contains({k}, ' ') then regexp_extract({k}, '(?s)^(.*) ', 1) else {k} end"


TICKS = "chr(96) || chr(96) || chr(96)"
NAMED = "'` (' || project_name || ')' || chr(10)"
#: what a context shows of a chunk
CONTEXTS = {
    "code": f"'`' || identifier || '` in ' || project_name || ' (' || file_path || ':' || start_line || ')' || chr(10) || case when docstring is not null then '**Docs:** ' || docstring || chr(10) else '' end || {TICKS} || language || chr(10) || trim(code_content, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) || {TICKS}",
    "readme": f"project_name || chr(10) || {words_cut('content', 800)}",
    "crate": f"'Crate `' || crate_name || {NAMED} || '**Description:** ' || coalesce(description, 'No description available') || chr(10) || '**Local dependencies:** ' || coalesce(nullif(array_to_string(dependencies, ', '), ''), 'none')",
    "module_doc": f"'Module `' || module_name || {NAMED} || {words_cut('doc_content', 600)}",
    "folder": f"'`' || folder_path || {NAMED} || summary_text",
    "file": f"'`' || file_path || {NAMED} || summary_text",
}


def type_sql(kind: str) -> str:
    rows = RELATIONS[kind].replace(" as rr from", f" as rr, chr(10) || '### ' || {CONTEXTS[kind]} || chr(10) as ctx from")
    return f"t_{kind} as materialized ({rows}), {vector_sql(f't_{kind}', 'id', 'emb', f'v_{kind}')}, d_{kind} as (select id, text from t_{kind} where text is not null)"


def near_sql(kind: str, most: int) -> str:
    return f"near_{kind} as materialized (select * from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rank from (select a.id as query_id, b.id, list_distance(a.vector, b.vector) as distance from qv a, v_{kind} b)) where rank <= {most})"


def text_sql(kind: str, most: int) -> str:
    return renamed(bm25(f"d_{kind}", "q"), f"{kind}_").replace("<= 10", f"<= {most}").replace(f"{kind}_bm as (", f"{kind}_bm as materialized (")


def fused_10(kind: str) -> str:
    return f"(select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from (select query_id, id, sum(1.0::double / (60 + rank)) as score from (select query_id, id, rank from near_{kind} union all select query_id, id, rank from {kind}_bm) group by query_id, id)) where rank <= 10)"


# --- chunk types: vectors, hybrids, all of them -----------------------------------------------------


def near(t: Tables, kind: str, k: int = 10) -> DataFrame:
    asked = questions(t).select("query_id", term_vector(c("query"), DIM).alias("vector"))
    return knn_batch(chunk_types.rows_of(chunk_types.chunks(t, kind), lambda x: term_vector(x, DIM)), asked, k, DIM)


def hybrid(t: Tables, kind: str) -> DataFrame:
    text = Corpus.of(chunk_types.docs_of(chunk_types.chunks(t, kind))).topk(questions(t), 10)
    return fusion.rrf([near(t, kind), text], 10)


def _register_types() -> None:
    for kind in TYPES:
        vectors = f"with {BASE}, {type_sql(kind)}, {near_sql(kind, 10)} select query_id, id, round(distance, 6) as distance, rank from near_{kind}"
        both = f"with {BASE}, {type_sql(kind)}, {near_sql(kind, 10)}, {text_sql(kind, 10)} select query_id, id, round(score, 6) as score, rank from {fused_10(kind)}"
        query(vectors, f"knn_{kind}")(lambda t, kind=kind: near(t, kind).select("query_id", "id", F.round("distance", 6).alias("distance"), c("rank").cast("long").alias("rank")))
        query(both, f"hybrid_{kind}")(lambda t, kind=kind: show(hybrid(t, kind)))


_register_types()
FOUR = TYPES[:4]
ALL_BASE = f"with {BASE}, " + ", ".join(f"{type_sql(k)}, {near_sql(k, 10)}, {text_sql(k, 10)}" for k in FOUR)


@query(ALL_BASE + " " + " union all ".join(f"select '{k}' as chunk_type, query_id, id, round(1 / (1 + distance), 6) as relevance from near_{k}" for k in FOUR))
def search_all(t: Tables) -> DataFrame:
    """The four searched types by vectors, ten rows each."""
    parts = [near(t, k).select(F.lit(k).alias("chunk_type"), "query_id", "id", F.round(1 / (1 + c("distance")), 6).alias("relevance")) for k in FOUR]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(ALL_BASE + " " + " union all ".join(f"select '{k}' as chunk_type, query_id, id, round(score, 6) as relevance from {fused_10(k)}" for k in FOUR))
def hybrid_search_all(t: Tables) -> DataFrame:
    """The four searched types by vectors and full text, ten rows each."""
    parts = [hybrid(t, k).select(F.lit(k).alias("chunk_type"), "query_id", "id", F.round("score", 6).alias("relevance")) for k in FOUR]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"with {CC}, {RC}, {MODULE_DOCS} select chunk_id, file_path, module_name, doc_content, project_name from md")
def module_doc_chunks(t: Tables) -> DataFrame:
    return chunk_types.module_docs(t)


@query(f"with {CC}, {FOLDERS} select chunk_id, folder_path, summary_text, project_name from fo")
def folder_chunks(t: Tables) -> DataFrame:
    return chunk_types.folders(t)


@query(f"with {CC}, {FILES} select chunk_id, file_path, summary_text, project_name from fi")
def file_chunks(t: Tables) -> DataFrame:
    return chunk_types.files(t)


@query(f"with {BM} select query_id, id, round(score, 6) as score, rank from bm")
def fts_index_search(t: Tables) -> DataFrame:
    """The full-text index written to the shared folder, opened again and searched."""
    folder = shared_folder(t.spark, "fulltext-code")
    write_index(docs(t), folder)
    return show(Index.open(t.spark, folder).topk(text_queries(t), 10))


# --- the bundle -----------------------------------------------------------------------------------------

SIX = f"with {BASE}, {EDGES}, " + ", ".join(type_sql(k) for k in TYPES)
IDF = " union all ".join(f"select '{k}' as corpus, term, count(*) as df from (select distinct id, unnest({tokens('text')}) as term from d_{k}) group by term" for k in TYPES)


@query(f"{SIX} {IDF}")
def export_idf(t: Tables) -> DataFrame:
    """The frequency tables of all six types."""
    return frequencies(t)


@query(f"{SIX}, idf as ({IDF}) " + " union all ".join([f"select '{k}' as section, count(*) as \"rows\" from t_{k}" for k in TYPES] + ["select 'edge', count(*) from edges", "select 'project', count(distinct project_name) from code_chunks", f"select 'prototype', {sum(map(len, intent.PROTOTYPES.values()))}", "select 'idf', count(*) from idf"]))
def sink_export_rows(t: Tables) -> DataFrame:
    """How many rows each section of the bundle has, counted in what was written."""
    folder = shared_folder(t.spark, "bundle")
    write_bundle(t, folder)
    return read_bundle(t.spark, folder).groupBy("section").agg(F.count("*").alias("rows"))


@query(f"with {CC}, docs as (select chunk_id as id, {searchable()} as text from cc), queries as (select id as query_id, text as query from docs where {BY_100.format('id')}), {bm25('docs', 'queries')} select query_id, id, round(score, 6) as score, rank from bm")
def bundle_search(t: Tables) -> DataFrame:
    """The bundle is written, opened, its texts made anew, and searched."""
    folder = shared_folder(t.spark, "bundle")
    write_bundle(t, folder)
    found = Bundle(t.spark, folder).corpus()
    return show(found.topk(found.docs.where(by_100("id")).select(c("id").alias("query_id"), c("text").alias("query")), 10))


@query(f"{SIX} " + " union all ".join(f"select '{k}' as chunk_type, id, rr as text from t_{k}" for k in TYPES))
def rerank_texts(t: Tables) -> DataFrame:
    """What a reranker reads, of all six types."""
    parts = [d.select(F.lit(k).alias("chunk_type"), "id", c("rerank_text").alias("text")) for k, d in chunk_types.all_chunks(t).items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"{SIX} " + " union all ".join(f"select '{k}' as chunk_type, id, emb as text from t_{k}" for k in TYPES[1:]))
def embed_texts(t: Tables) -> DataFrame:
    """What an embedder reads, of all types but code, which ``embed_text`` has."""
    parts = [d.select(F.lit(k).alias("chunk_type"), "id", c("embed_text").alias("text")) for k, d in chunk_types.all_chunks(t).items() if k != "code"]
    return reduce(DataFrame.unionByName, parts)


def storable(t: Tables) -> dict[str, DataFrame]:
    """The rows of all seven tables, by the store's names."""
    return {
        "code_chunks": t.code("file_path", "content_hash", "project_name"), "readme_chunks": t.readme("file_path", "content_hash", "project_name"), "crate_chunks": t.crates(), "module_doc_chunks": chunk_types.module_docs(t),
        "folder_chunks": chunk_types.folders(t), "file_chunks": chunk_types.files(t), "call_edges": t.edges(),
    }


@query(f"with {CC}, {RC}, {EDGES}, {MODULE_DOCS}, {FOLDERS}, {FILES} " + " union all ".join(f"select '{name}' as name, count(*) as \"rows\", count(distinct project_name) as projects from {rel}" for name, rel in (("code_chunks", "cc"), ("readme_chunks", "rc"), ("crate_chunks", "crate_chunks"), ("module_doc_chunks", "md"), ("folder_chunks", "fo"), ("file_chunks", "fi"), ("call_edges", "edges"))))
def store_upserts(t: Tables) -> DataFrame:
    """Each of the seven tables is written in two overlapping steps, then read back and counted."""
    store = ChunkStore(t.spark, shared_folder(t.spark, "store"), buckets=4)
    counts = []
    for name, rows in storable(t).items():
        store.upsert(name, rows.where(F.pmod(F.xxhash64(SPECS[name].key), F.lit(3)) < 2))
        store.upsert(name, rows)
        counts.append(store.read(name).agg(F.count("*").alias("rows"), F.countDistinct("project_name").alias("projects")).select(F.lit(name).alias("name"), "rows", "projects"))
    return reduce(DataFrame.unionByName, counts)


# --- the pipeline -------------------------------------------------------------------------------------

PROTOS = "protos as (select * from (values " + ", ".join(f"('{i}#{n:02d}', '{i}', '{x}')" for i, xs in intent.PROTOTYPES.items() for n, x in enumerate(xs)) + ") v(proto_id, intent, text))"
INTENT = f"""{PROTOS}, {vector_sql('protos', 'proto_id', 'text', 'pv')},
    sims as (select qv.id as query_id, protos.intent, proto_id, list_cosine_similarity(qv.vector, pv.vector) as similarity from qv, protos join pv on pv.id = proto_id),
    place as (select * from (values ('overview', 1), ('implementation', 2), ('relationship', 3), ('comparison', 4)) v(intent, p)),
    near3 as (select * from (select sims.*, row_number() over (partition by query_id order by round(similarity, 9) desc, p, proto_id) as n from sims join place using (intent)) where n <= 3),
    votes as (select q.query_id, place.intent, p, coalesce(sum(near3.similarity), 0) as weight from q cross join place left join near3 on near3.query_id = q.query_id and near3.intent = place.intent group by all),
    best as (select query_id, case when weight >= 0.3 then intent else 'implementation' end as intent from (select *, row_number() over (partition by query_id order by round(weight, 9) desc, p) as n from votes) where n = 1),
    worded as (select query_id, case when not (contains(l, 'difference this makes') or contains(l, 'difference that makes') or contains(l, 'difference it makes'))
      and (contains(l, 'difference between') or contains(l, 'differences between') or regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}])differs?($|[^\\p{{L}}\\p{{N}}])') or contains(l, 'compare ')
        or (not (contains(l, '_vs_') or contains(l, '_vs.') or contains(l, '-vs-')) and (contains(l, ' vs ') or contains(l, ' vs. ')))) then 'comparison' end as intent from (select query_id, lower(query) as l from q)),
    asked as (select q.query_id, query, coalesce({{forced}}, worded.intent, best.intent) as intent from q join best using (query_id) join worded using (query_id))"""


def case_sql(values: dict) -> str:
    return "case intent " + " ".join(f"when '{i}' then {str(v).lower()}" for i, v in values.items()) + " end"


def plan_sql(rerank: bool, forced: str | None) -> str:
    arms = {i: dict(zip(("bm25", "rerank", "folder", "file", "signature"), a)) for i, a in intent.ARMS.items()}
    limits = {k: {i: intent.ROUTES[i][n] if k not in ("folder", "file") or arms[i][k] else 0 for i in intent.INTENTS} for n, k in enumerate(TYPES)}
    again = case_sql({i: rerank and a["rerank"] for i, a in arms.items()})
    columns = ", ".join(f"l_{k}, case when rr then l_{k} * {intent.RERANK_FACTOR[k]} else l_{k} end as f_{k}" for k in TYPES)
    return f"{INTENT.replace('{forced}', repr(forced) if forced else 'null')}, p0 as (select *, {case_sql({i: a['bm25'] for i, a in arms.items()})} as bm25, {again} as rr, " + ", ".join(f"{case_sql(v)} as l_{k}" for k, v in limits.items()) + f" from asked), p as materialized (select query_id, query, intent, bm25, rr, {columns} from p0)"


def list_sql(kind: str) -> str:
    ranks = f"select query_id, id, rank from near_{kind} join p using (query_id) where bm25 and rank <= f_{kind} union all select query_id, id, rank from {kind}_bm join p using (query_id) where bm25 and rank <= f_{kind}"
    return f"""list_{kind} as materialized (select query_id, id, 1 / (1 + distance) as score, rank as pos from near_{kind} join p using (query_id) where not bm25 and rank <= f_{kind}
      union all select query_id, id, score, pos from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as pos from (select query_id, id, sum(1.0::double / (60 + rank)) as score from ({ranks}) group by query_id, id)) join p using (query_id) where pos <= f_{kind})"""


COMPARED = f"""sides as (select query_id as asked, query, l_code, string_split(cs, ' | ') as cs from (select query_id, query, l_code, {comparator_sql()} as cs from p where intent = 'comparison') where cs is not null),
    subs as (select asked || '#' || s as query_id, asked, s, l_code, case s when 0 then query else cs[s] || ' ' || query end as text from sides, (values (0), (1), (2)) v(s)),
    {vector_sql('subs', 'query_id', 'text', 'sv')},
    near12 as (select * from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rank from (select a.id as query_id, b.id, list_distance(a.vector, b.vector) as distance from sv a, v_code b)) where rank <= 12),
    clists as (select asked as query_id, s, near12.id, rank, distance, project, l_code from near12 join subs using (query_id) join t_code on t_code.id = near12.id),
    cvote as (select query_id, project from (select *, row_number() over (partition by query_id order by n desc, project) as k from (select query_id, project, count(*) as n from clists where s = 0 and rank <= 5 group by all)) where k = 1),
    ckept as (select * from (select clists.*, row_number() over (partition by clists.query_id, s order by rank) as r from clists join cvote using (query_id, project)) where r <= 8),
    compared as materialized (select query_id, id, score, pos from (select *, row_number() over (partition by query_id order by round(fs, 9) desc, id) as pos from (select query_id, id, sum(1.0::double / (60 + r)) as fs, max(1 / (1 + distance)) as score, max(l_code) as l from ckept group by query_id, id)) where pos <= l)"""
GRAPH = f"""searched as materialized (select * from list_code where query_id not in (select query_id from compared) union all select * from compared),
    first5 as (select searched.query_id, searched.id, pos, identifier, project, query, intent, starts_with(identifier, 'test_') as test from searched join p using (query_id) join t_code on t_code.id = searched.id where pos <= 5 and intent in ('relationship', 'implementation')),
    own as (select query_id, project from first5 where pos = 1),
    cand as (select * from (select *, {target_sql('query')} as term, max((not test)::int) over (partition by query_id) as r from first5) where r = 0 or not test),
    uniq as (select project_name as project, identifier, min(chunk_id) as chunk_id from (select project_name, lower(caller_identifier) as identifier, caller as chunk_id from edges union all select project_name, lower(callee_identifier), callee from edges) group by all having count(distinct chunk_id) = 1),
    opts as (select query_id, id as chunk_id, pos as rank, case when term is null then 4 when lower(identifier) = lower(term) then 1 when contains(lower(identifier), lower(term)) then 3 end as how from cand
      union all select distinct cand.query_id, uniq.chunk_id, 0, 2 from cand join own using (query_id) join uniq on uniq.project = own.project and uniq.identifier = lower(term)),
    target as (select query_id, chunk_id as node from (select *, row_number() over (partition by query_id order by how, rank, chunk_id) as n from opts where how is not null) where n = 1),
    ways as (select query_id, case when contains(l, 'called by') or contains(l, 'invoked by') or contains(l, 'what calls') or contains(l, 'who calls') or (contains(l, 'where is') and contains(l, 'called')) then 'callers'
      when (contains(l, 'does') and contains(l, 'call')) or contains(l, 'depend on') or contains(l, 'uses') then 'callees' else 'both' end as direction from (select query_id, lower(query) as l from p)),
    aug as materialized (select query_id, id, case min(tier) when 1 then 0.85::double when 2 then 0.8::double else 0.75::double end as score from target join own using (query_id) join ways using (query_id) join
      (select callee as node, caller as id, tier, 'callers' as way, project_name as project from edges union all select caller, callee, tier, 'callees', project_name from edges) using (node, project) where direction in ('both', way) and id in (select id from t_code) group by query_id, id),
    merged0 as (select s.query_id, s.id, s.score, aug.id is not null as g, pos from searched s left join aug using (query_id, id) union all select query_id, id, score, true, null from aug where not exists (select 1 from searched s where s.query_id = aug.query_id and s.id = aug.id)),
    n_of as (select query_id, max(pos) as n from searched group by query_id),
    flags as (select p.query_id, rr, l_code, coalesce(h, false) and direction <> 'both' as explicit, coalesce(h, false) and direction = 'both' as soft, case when intent = 'relationship' then 2 else 1 end as least from p join ways using (query_id) left join (select distinct query_id, true as h from aug) using (query_id)),
    rows0 as materialized (select query_id, id, score, g, coalesce(pos, coalesce(n, 0) + row_number() over (partition by query_id, pos is null order by round(score, 9) desc, id)) as pos, rr, l_code, explicit, soft, least from merged0 left join n_of using (query_id) join flags using (query_id))"""


def rerank_sql(rows: str, kind: str, columns: str) -> str:
    terms = lambda e: f"list_distinct({tokens(e)})"
    logit = f"8.0::double * len(list_intersect({terms('query')}, {terms('rr_text')})) / greatest(1, len({terms('query')})) - 4.0::double"
    return f"(select query_id, id, score, {columns}, row_number() over (partition by query_id order by round(score, 9) desc, id) as pos from (select query_id, id, 1 / (1 + exp(-({logit}))) as score, {columns} from (select x.*, p.query, t.rr as rr_text from ({rows}) x join p using (query_id) join t_{kind} t on t.id = x.id)))"


STITCHED = f"""ranked as materialized {rerank_sql("select * exclude (score, pos) from rows0 where rr and not (explicit and g)", "code", "g, rr, l_code, explicit, soft, least")},
    plain as materialized (select * from (select query_id, id, score, g, rr, l_code, explicit, soft, least, pos from rows0 where not rr union all select query_id, id, score, g, rr, l_code, explicit, soft, least, pos from ranked)
      where pos <= l_code + case when soft then 5 when not rr then 1000000000 else 0 end),
    before as (select query_id, id, score, l_code, nth from (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos, id) as nth from rows0 where rr and explicit and g) where nth < l_code),
    stitched as (select query_id, id, score, pos from (select query_id, id, score, l_code, row_number() over (partition by query_id order by nth) as pos from (select query_id, id, score, l_code, pos + 1000000 as nth from plain where explicit union all select * from before)) where pos <= l_code),
    g1 as (select *, pos <= 5 as upper from plain where soft),
    h as (select *, sum((upper and g)::int) over (partition by query_id) as have, sum((upper and not g)::int) over (partition by query_id) as others,
      row_number() over (partition by query_id, g, upper order by pos) as nth, row_number() over (partition by query_id, upper, g order by round(score, 9) desc, pos) as best from g1),
    lf as (select *, (not upper and g and nth <= greatest(0, least - have)) as lifted from h), m as (select *, sum(lifted::int) over (partition by query_id) as lifts from lf),
    kept as (select * from m where (upper and (g or best <= others - case when lifts < others then lifts else others end)) or lifted),
    reserved as (select query_id, id, score, pos from (select query_id, id, score, row_number() over (partition by query_id order by case when lifts = 0 then pos end, round(score, 9) desc, pos) as pos from kept) where pos <= 5),
    out_code as (select * from stitched union all select * from reserved union all select query_id, id, score, pos from plain where not soft and not explicit)"""


def out_sql(kind: str) -> str:
    ranked = rerank_sql(f"select query_id, id, l_{kind} as l from list_{kind} join p using (query_id) where p.rr", kind, "l")
    return f"out_{kind} as (select query_id, id, score, pos from list_{kind} join p using (query_id) where not rr union all select query_id, id, score, pos from {ranked} where pos <= l)"


def pipeline_sql(rerank: bool, forced: str | None) -> str:
    most = {k: max(r[n] for r in intent.ROUTES.values()) * intent.RERANK_FACTOR[k] for n, k in enumerate(TYPES)}
    parts = ", ".join(f"{type_sql(k)}, {near_sql(k, most[k])}, {text_sql(k, most[k])}, {list_sql(k)}" for k in TYPES)
    every = " union all ".join(f"select o.query_id, {n} as type_order, '{k}' as chunk_type, o.id, t.file_path, t.identifier, t.project, t.line, score as relevance, pos, ctx from out_{k} o join t_{k} t on t.id = o.id" for n, k in enumerate(TYPES))
    outs = ", ".join(out_sql(k) for k in TYPES[1:])
    flat = f"every as materialized ({every}), flat as (select every.*, p.intent, row_number() over (partition by every.query_id order by round(relevance, 9) desc, file_path, type_order, id) as rank from every join p using (query_id))"
    return f"with {BASE}, {EDGES}, {plan_sql(rerank, forced)}, {parts}, {COMPARED}, {GRAPH}, {STITCHED}, {outs}, {flat}"


SHOWN = "select query_id, intent, rank, chunk_type, id, file_path, identifier, project, line, round(relevance, 6) as relevance from flat"


def answered(t: Tables, rerank: bool, forced: str | None = None) -> Retrieved:
    asked = questions(t)
    return retrieve(t, asked if forced is None else asked.withColumn("intent", F.lit(forced)), EngineConfig(rerank=rerank))


def shown(found: Retrieved) -> DataFrame:
    return found.flat().withColumns({"rank": c("rank").cast("long"), "relevance": F.round("relevance", 6)})


@query(f"{pipeline_sql(False, None)} {SHOWN}")
def retrieve_flat(t: Tables) -> DataFrame:
    """The pipeline: intent, routes, arms, comparison, graph, one ranked list for each question."""
    return shown(answered(t, False))


@query(f"{pipeline_sql(True, None)} {SHOWN}")
def retrieve_reranked(t: Tables) -> DataFrame:
    """The same with the stand-in reranker over all six types."""
    return shown(answered(t, True))


def _register_intents() -> None:
    for name in intent.INTENTS:
        query(f"{pipeline_sql(True, name)} {SHOWN}", f"retrieve_{name}")(lambda t, name=name: shown(answered(t, True, name)))


_register_intents()


@query(f"""{pipeline_sql(False, None)}, e as (select q.query_id as case_id, file_path as f, identifier as i from q join cc on chunk_id = q.query_id),
    w as (select case_id, 'file' as kind, f as expected from e union all select case_id, 'identifier', i from e),
    fr as (select w.case_id, kind, expected, min(rank) filter (case kind when 'file' then contains(file_path, expected) else coalesce(identifier = expected, false) end) as first from w left join flat on flat.query_id = w.case_id group by all)
    select case_id, round(avg(coalesce(first <= 5, false)::int::double), 6) as recall_5, round(avg(coalesce(first <= 10, false)::int::double), 6) as recall_10, round(avg((first is not null)::int::double), 6) as recall_pool, round(coalesce(1.0::double / min(first), 0), 6) as mrr from fr group by case_id""")
def harness_run(t: Tables) -> DataFrame:
    """The harness over the pipeline: each question expects the chunk that it is about."""
    about = t.code("file_path", "identifier").withColumnRenamed("chunk_id", "id")
    none = F.array().cast("array<string>")
    cases = questions(t).withColumnRenamed("query_id", "id").join(about, "id").select("id", "query", F.lit(None).cast("string").alias("expected_intent"), F.array("file_path").alias("expected_files"), F.array("identifier").alias("expected_identifiers"), *[none.alias(x) for x in ("expected_chunk_types", "expected_projects", "excluded_files")])
    return harness.run(t, cases).metrics.select("case_id", *[F.round(m, 6).alias(m) for m in harness.MEANS])


SECTION = " ".join(f"when '{k}' then {n}" for n, k in enumerate(chunk_types.SECTIONS))
HEADING = " ".join(f"when '{k}' then '{h}'" for k, h in chunk_types.SECTIONS.items())
CONTEXT = f"""parts as (select query_id, case chunk_type {SECTION} end as n, case chunk_type {HEADING} end || chr(10) || string_agg(ctx, '' order by pos) as part from every group by query_id, chunk_type),
    context as (select p.query_id, query, coalesce(whole, '{chunk_types.NOTHING}') as context from p left join (select query_id, string_agg(part, chr(10) || chr(10) order by n) as whole from parts group by query_id) using (query_id))"""
SYSTEM = "Answer from the context below. Say so if it does not hold the answer."


@query(f"{pipeline_sql(True, None)}, {CONTEXT} select query_id, context from context")
def build_context(t: Tables) -> DataFrame:
    """What a language model is given for each question: up to six sections."""
    return answered(t, True).context()


@query(f"{pipeline_sql(True, None)}, {CONTEXT} select query_id, '{SYSTEM}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Question:** ' || query as prompt from context")
def build_prompt(t: Tables) -> DataFrame:
    found = answered(t, True)
    wide = found.context().join(found.plan.select("query_id", "query"), "query_id")
    return wide.select("query_id", F.concat(F.lit(SYSTEM + "\n\n---\n\n"), "context", F.lit("\n\n---\n\n**Question:** "), "query").alias("prompt"))
