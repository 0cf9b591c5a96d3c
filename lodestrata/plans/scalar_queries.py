"""Queries of scalar operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing, paths, text, vectors
from lodestrata.operators import edges as edge_ops
from lodestrata.operators import graph, intent
from lodestrata.plans.sql import CAMEL, CC, EDGES, RC, cut, searchable, tokens
from lodestrata.sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


c = F.col


@query(f"with {CC} select chunk_id, sha256(replace(code_content, chr(13) || chr(10), chr(10))) as hash from cc")
def content_hash(t: Tables) -> DataFrame:
    return t.code("code_content").select("chunk_id", hashing.content_hash(c("code_content")).alias("hash"))


@query(f"with {CC} select chunk_id, sha256(replace('chunk:' || file_path || ':' || code_content, chr(13) || chr(10), chr(10))) as derived from cc")
def chunk_id(t: Tables) -> DataFrame:
    return t.code("file_path", "code_content").select("chunk_id", hashing.chunk_id(c("file_path"), c("code_content")).alias("derived"))


@query(f"select distinct identifier, {CAMEL.format('identifier')} as words from code_chunks")
def split_camel_case(t: Tables) -> DataFrame:
    return t.raw("code_chunks").select("identifier").distinct().select("identifier", text.split_camel_case(c("identifier")).alias("words"))


@query(f"with {CC} select chunk_id, {searchable()} as searchable_text from cc")
def searchable_text(t: Tables) -> DataFrame:
    return t.code("identifier", "signature", "docstring").select("chunk_id", text.searchable_text(c("identifier"), c("signature"), c("docstring")).alias("searchable_text"))


@query(f"select doc_id, len({tokens('text')})::bigint as n_tokens, array_to_string({tokens('text')}, ' ') as tokens from documents")
def tokenize(t: Tables) -> DataFrame:
    ts = text.tokenize(c("text"))
    return t.raw("documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.array_join(ts, " ").alias("tokens"))


PATHS = "(select file_path as path from code_chunks union select file_path from readme_chunks)"


def all_paths(t: Tables) -> DataFrame:
    return t.raw("code_chunks").select(c("file_path").alias("path")).unionByName(t.raw("readme_chunks").select(c("file_path").alias("path"))).distinct()


@query(f"select path, replace(path, chr(92), '/') as normal from {PATHS}")
def proj_normalize_path(t: Tables) -> DataFrame:
    return all_paths(t).select("path", paths.normalize_path(c("path")).alias("normal"))


@query(f"select path, coalesce(case when contains(path, '/') then split_part(path, '/', 1) end, 'workspace', 'unknown') as project from {PATHS}")
def proj_project_name(t: Tables) -> DataFrame:
    return all_paths(t).select("path", paths.project_name(c("path"), repository="workspace").alias("project"))


@query(f"select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent from {PATHS}")
def folder_parent(t: Tables) -> DataFrame:
    return all_paths(t).select("path", paths.folder_of(c("path")).alias("parent"))


BASE = "coalesce(list_filter(regexp_split_to_array(path, '[/\\\\]'), lambda x: x <> '')[-1], '')"


@query(f"select path, {BASE} as name from {PATHS}")
def basename(t: Tables) -> DataFrame:
    return all_paths(t).select("path", paths.basename(c("path")).alias("name"))


@query(f"select path, regexp_replace({BASE}, '^(.+)\\.[^.]*$', '\\1') as module from {PATHS}")
def module_name(t: Tables) -> DataFrame:
    return all_paths(t).select("path", paths.module_name(c("path")).alias("module"))


IGNORED = ", ".join(f"'{d}'" for d in paths.IGNORED_DIRS)


@query(
    f"""select path from {PATHS} where not (len(list_filter(string_split(path, '/'), lambda x: x in ({IGNORED}) or (starts_with(x, '.') and x not in ('.', '..')))) > 0
    or regexp_matches(string_split(path, '/')[-1], '(?i)^(test_.*\\.py|.*_test\\.py|.*\\.(test|spec)\\.(ts|tsx|js)|.*_test\\.go)$'))"""
)
def filter_skip_paths(t: Tables) -> DataFrame:
    return all_paths(t).where(~paths.skipped(c("path")))


@query(
    f"""with {CC} select chunk_id, case language when 'rust' then coalesce(starts_with(ltrim(signature), 'pub '), false)
    when 'python' then not starts_with(identifier, '_') or starts_with(identifier, '__')
    when 'typescript' then coalesce(regexp_matches(signature, '(^|[^\\p{{L}}\\p{{N}}_])export($|[^\\p{{L}}\\p{{N}}_])'), false) else true end as public from cc"""
)
def is_public(t: Tables) -> DataFrame:
    return t.code("language", "signature", "identifier").select("chunk_id", paths.is_public(c("language"), c("signature"), c("identifier")).alias("public"))


@query(f"with {CC} select chunk_id, nullif(left(trim(regexp_replace(regexp_split_to_array(docstring, '\\r?\\n')[1], '\\s+', ' ', 'g')), 140), '') as purpose from cc where docstring is not null")
def clean_purpose(t: Tables) -> DataFrame:
    return t.code("docstring").where("docstring is not null").select("chunk_id", text.clean_purpose(c("docstring")).alias("purpose"))


@query(
    f"""with {RC}, k as (select chunk_id, content, {cut('content', 800)} as cut from rc)
    select chunk_id, case when strlen(content) <= 800 then content when contains(cut, ' ') then regexp_extract(cut, '(?s)^(.*) ', 1) else cut end as start from k"""
)
def truncate_words(t: Tables) -> DataFrame:
    return t.readme("content").select("chunk_id", text.truncate_words(c("content"), text.CONTEXT_README_BYTES).alias("start"))


CRATE_TEXT = "concat_ws(chr(10), 'Crate: ' || crate_name, description, case when len(dependencies) > 0 then 'Dependencies: ' || array_to_string(dependencies, ', ') end)"


@query(
    f"""with {CC}, {RC} select 'code' as chunk_type, chunk_id, concat_ws(chr(10), coalesce(signature, identifier) || ' (' || language || ')', nullif(docstring, ''), {cut('code_content', 1200, '...')}) as text from cc
    union all select 'readme', chunk_id, 'Project: ' || project_name || chr(10) || {cut('content', 1500, '...')} from rc
    union all select 'crate', chunk_id, {CRATE_TEXT} from crate_chunks"""
)
def rerank_text(t: Tables) -> DataFrame:
    code = t.code("signature", "identifier", "language", "docstring", "code_content").select(F.lit("code").alias("chunk_type"), "chunk_id", text.rerank_text_code(c("signature"), c("identifier"), c("language"), c("docstring"), c("code_content")).alias("text"))
    readme = t.readme("project_name", "content").select(F.lit("readme").alias("chunk_type"), "chunk_id", text.rerank_text_readme(c("project_name"), c("content")).alias("text"))
    crate = t.crates().select(F.lit("crate").alias("chunk_type"), "chunk_id", text.crate_text(c("crate_name"), c("description"), c("dependencies")).alias("text"))
    return code.unionByName(readme).unionByName(crate)


@query(
    f"""with {CC}, {RC}, {EDGES}, calls as (select caller, list_sort(list_distinct(list(callee_identifier))) as names from edges group by caller)
    select 'code' as kind, chunk_id, concat_ws(chr(10), identifier || ' (' || language || ')', nullif(docstring, ''), code_content, case when len(names) > 0 then 'Calls: ' || array_to_string(names, ', ') end) as text from cc left join calls on caller = chunk_id
    union all select 'signature', chunk_id, concat_ws(chr(10), signature || ' (' || language || ')', nullif(docstring, '')) from cc where signature is not null
    union all select 'readme', chunk_id, 'Project: ' || project_name || chr(10) || content from rc
    union all select 'crate', chunk_id, {CRATE_TEXT} from crate_chunks"""
)
def embed_text(t: Tables) -> DataFrame:
    calls = t.edges().groupBy(c("caller").alias("chunk_id")).agg(F.sort_array(F.collect_set("callee_identifier")).alias("names"))
    cc = t.code("signature", "identifier", "language", "docstring", "code_content")
    code = cc.join(calls, "chunk_id", "left").select(F.lit("code").alias("kind"), "chunk_id", text.embed_text_code(c("identifier"), c("language"), c("docstring"), c("code_content"), c("names")).alias("text"))
    sig = cc.where("signature is not null").select(F.lit("signature").alias("kind"), "chunk_id", text.embed_text_signature(c("signature"), c("language"), c("docstring")).alias("text"))
    readme = t.readme("project_name", "content").select(F.lit("readme").alias("kind"), "chunk_id", F.concat(F.lit("Project: "), "project_name", F.lit("\n"), "content").alias("text"))
    crate = t.crates().select(F.lit("crate").alias("kind"), "chunk_id", text.crate_text(c("crate_name"), c("description"), c("dependencies")).alias("text"))
    return code.unionByName(sig).unionByName(readme).unionByName(crate)


@query("select event_id, round(1 / (1 + abs(value)), 6) as relevance from events")
def distance_relevance(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.round(vectors.distance_to_relevance(F.abs("value")), 6).alias("relevance"))


@query("select event_id, round(1 / (1 + exp(-(value / 100))), 6) as p from events")
def sigmoid(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.round(vectors.sigmoid(c("value") / 100), 6).alias("p"))


@query(f"with {EDGES} select edge_id, case tier when 1 then 0.85::double when 2 then 0.8::double else 0.75::double end as score from edges")
def tier_score(t: Tables) -> DataFrame:
    return t.edges().select("edge_id", vectors.tier_score(c("tier")).alias("score"))


@query("with q as (select embedding::double[] as e from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], e), 6) as similarity from embeddings, q")
def cosine_similarity(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    first = e.orderBy("vec_id").first().embedding
    return e.select("vec_id", F.round(vectors.cosine_similarity(c("embedding"), F.array(*[F.lit(float(x)) for x in first])), 6).alias("similarity"))


@query(f"with {CC} select chunk_id, array_to_string(string_split(code_content, chr(10))[-3:], chr(10)) as tail from cc")
def tail_lines(t: Tables) -> DataFrame:
    return t.code("code_content").select("chunk_id", text.tail_lines(c("code_content"), 3).alias("tail"))


@query(
    f"""with {RC}, l as (select chunk_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from rc)
    select chunk_id, line_no::int as line_no, line from l where line_no between 5 - 2 and 5 + 2"""
)
def neighbors_window(t: Tables) -> DataFrame:
    lines = t.readme("content").select("chunk_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return lines.select("chunk_id", (c("at") + 1).alias("line_no"), "line").where(c("line_no").between(5 - 2, 5 + 2))


@query(f"with {CC} select chunk_id, file_path, identifier, start_line from (select *, row_number() over (partition by file_path, identifier, start_line order by chunk_id) as k from cc) where k = 1")
def dedup_ident_line(t: Tables) -> DataFrame:
    return edge_ops.dedup_definitions(t.code("file_path", "identifier", "start_line")).select("chunk_id", "file_path", "identifier", "start_line")


# --- fixed tables ---------------------------------------------------------------------------


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::int"
    return f"select * from (values {', '.join('(' + ', '.join(show(v) for v in r) + ')' for r in rows)}) as v({names})"


@query(values([(x, k) for k, xs in paths.LANGUAGES.items() for x in xs], "extension, language"))
def dim_language(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x, k) for k, xs in paths.LANGUAGES.items() for x in xs], "extension string, language string")


@query(values([(i, n, s) for i, ss in intent.PROTOTYPES.items() for n, s in enumerate(ss)], "intent, position, text"))
def dim_prototypes(t: Tables) -> DataFrame:
    return intent.prototypes(t.spark)


@query(values([(i, *r) for i, r in intent.ROUTES.items()], "intent, " + ", ".join(f"{k}_limit" for k in intent.TYPES)))
def route(t: Tables) -> DataFrame:
    return intent.routes(t.spark)


@query(values([(i, *r) for i, r in intent.ARMS.items()], "intent, bm25, rerank, folder_vectors, file_vectors, signature_vectors"))
def arm_policy(t: Tables) -> DataFrame:
    return intent.arms(t.spark)


@query(values([(i, k, n * intent.RERANK_FACTOR[k]) for i, r in intent.ROUTES.items() for k, n in zip(intent.TYPES, r)], "intent, chunk_type, fetched"))
def fetch_limits(t: Tables) -> DataFrame:
    return intent.fetch_limits(t.spark)


# --- questions ------------------------------------------------------------------------------

TEMPLATES = [
    "What calls {}?", "What does {} call?", "Who calls the function {}", "Compare {} and the router", "{} vs. parser", "What is the difference between {} and an index?",
    "How does {} differ from a cache?", "callers of `{}`", "Show `{}` please", "file a_vs_b.{}", "The difference it makes to compare {}", "How do {} and queue compare?", "Where is {} called", "what uses {} depend on",
]
QUESTIONS = "questions as (select i || '#' || n as query_id, replace(t, '{}', i) as query from (select distinct identifier as i from code_chunks) a, (" + values([(n, s) for n, s in enumerate(TEMPLATES)], "n, t") + ") b)"


def questions(t: Tables) -> DataFrame:
    """Every identifier in every template."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("t")) for n, s in enumerate(TEMPLATES)]))
    wide = t.raw("code_chunks").select("identifier").distinct().select("identifier", each.alias("s"))
    return wide.select(F.concat_ws("#", "identifier", c("s.n").cast("string")).alias("query_id"), F.replace(c("s.t"), F.lit("{}"), c("identifier")).alias("query"))


@query(
    f"""with {QUESTIONS}, q as (select query_id, lower(query) as q from questions)
    select query_id, case when not (contains(q, 'difference this makes') or contains(q, 'difference that makes') or contains(q, 'difference it makes'))
      and (contains(q, 'difference between') or contains(q, 'differences between') or regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}])differs?($|[^\\p{{L}}\\p{{N}}])') or contains(q, 'compare ')
        or (not (contains(q, '_vs_') or contains(q, '_vs.') or contains(q, '-vs-')) and (contains(q, ' vs ') or contains(q, ' vs. ')))) then 'comparison' end as intent from q"""
)
def pre_classify(t: Tables) -> DataFrame:
    return questions(t).select("query_id", intent.pre_classify(c("query")).alias("intent"))


@query(
    f"""with {QUESTIONS}, q as (select query_id, lower(query) as q from questions)
    select query_id, case when contains(q, 'called by') or contains(q, 'invoked by') or contains(q, 'what calls') or contains(q, 'who calls') or (contains(q, 'where is') and contains(q, 'called')) then 'callers'
      when (contains(q, 'does') and contains(q, 'call')) or contains(q, 'depend on') or contains(q, 'uses') then 'callees' else 'both' end as direction from q"""
)
def detect_direction(t: Tables) -> DataFrame:
    return questions(t).select("query_id", graph.detect_direction(c("query")).alias("direction"))


def first_word(expr: str) -> str:
    stop = ", ".join(f"'{w}'" for w in graph.STOP_WORDS)
    return f"list_filter(regexp_split_to_array({expr}, '[\\s?.`]'), lambda w: w <> '' and lower(w) not in ({stop}))[1]"


def target_sql(q: str) -> str:
    after = lambda m: first_word(f"regexp_extract({q}, '(?is)^.*?{m}(.*)$', 1)")
    return f"coalesce({after('what calls ')}, {after('who calls ')}, {after('called by ')}, {first_word(f'''regexp_extract({q}, '(?is)what does (.*?) call', 1)''')}, {after('callers of ')}, {after('callees of ')}, nullif(regexp_extract({q}, '`([^`]+)`', 1), ''))"


@query(f"with {QUESTIONS} select query_id, {target_sql('query')} as target from questions")
def extract_target(t: Tables) -> DataFrame:
    return questions(t).select("query_id", graph.extract_target(c("query")).alias("target"))


def comparator_sql() -> str:
    pairs = []
    canon = lambda e: f"(select case when strlen(b) between 2 and 60 then b end from (select trim(regexp_replace(lower(regexp_replace(trim({e}), '[?.,;:]+$', '')), '^(the|an|a) ', '')) as b))"
    for p in intent.COMPARISONS:
        p = p.replace("(?:", "(?:")
        a, b = (canon(f"regexp_extract(query, '{p}', {i})") for i in (1, 2))
        pairs.append(f"(select case when a is not null and b is not null and a <> b then a || ' | ' || b end from (select {a} as a, {b} as b))")
    return f"coalesce({', '.join(pairs)})"


@query(f"with {QUESTIONS} select query_id, {comparator_sql()} as compared from questions")
def extract_comparators(t: Tables) -> DataFrame:
    return questions(t).select("query_id", F.array_join(intent.comparators(c("query")), " | ").alias("compared"))


@query(f"select distinct node_type as name, case when node_type in ({', '.join(repr(i) for i in intent.INTENTS)}) then node_type end as intent from code_chunks union select intent, intent from (values ('overview'), ('comparison')) v(intent)")
def intent_parse(t: Tables) -> DataFrame:
    names = t.raw("code_chunks").select(c("node_type").alias("name")).unionByName(t.spark.createDataFrame([("overview",), ("comparison",)], "name string")).distinct()
    return names.select("name", intent.parse(c("name")).alias("intent"))
