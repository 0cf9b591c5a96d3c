"""Queries of the search, fusion, intent and pipeline operators, each with its SQL.

Searches ask with every code chunk whose id, as a number, is divisible by 100,
and search all rows: its searchable text for BM25, its vector for the nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import fusion, intent
from lodestrata.operators.fulltext import Corpus, idf, idf_table as idf_op, postings
from lodestrata.operators.vectors import knn, knn_batch as knn_batch_op
from lodestrata.plans.sql import BY_100, CC, RC, SIG, VEC, bm25, cut, tokens
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


def by_100(col: str):
    return F.pmod(F.conv(F.substring(col, -12, 12), 16, 10).cast("long"), F.lit(100)) == 0


def docs(t: Tables) -> DataFrame:
    return t.code("searchable_text").select(c("chunk_id").alias("id"), c("searchable_text").alias("text"))


def text_queries(t: Tables) -> DataFrame:
    return docs(t).where(by_100("id")).select(c("id").alias("query_id"), c("text").alias("query"))


DOCS = f"{CC}, docs as (select chunk_id as id, searchable_text as text from cc), queries as (select id as query_id, text as query from docs where {BY_100.format('id')})"
BM = f"{DOCS}, {bm25('docs', 'queries')}"
LINKED = f"select q.id as query_id, v.id, list_distance(q.vector, v.vector) as distance from {{0}} q, {{0}} v where {BY_100.format('q.id')}"


def near(rel: str, name: str) -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rank from ({LINKED.format(rel)})) where rank <= 10)"


@query(f"with {CC} select term, count(*) as df from (select distinct chunk_id, unnest({tokens('searchable_text')}) as term from cc) group by term")
def idf_table(t: Tables) -> DataFrame:
    return idf_op(docs(t))


@query(f"with {CC}, d as (select term, count(*) as df from (select distinct chunk_id, unnest({tokens('searchable_text')}) as term from cc) group by term) select term, round(ln(((select count(*) from cc) - df + 0.5) / (df + 0.5) + 1), 6) as idf from d")
def idf_value(t: Tables) -> DataFrame:
    d = docs(t)
    return idf_op(d).select("term", F.round(idf(F.lit(d.count()), c("df")), 6).alias("idf"))


@query(f"with {CC} select count(*) as n_docs, round(avg(len({tokens('searchable_text')})), 6) as avg_len from cc")
def avg_doc_len(t: Tables) -> DataFrame:
    corpus = Corpus.of(docs(t))
    return t.spark.createDataFrame([(corpus.n_docs, round(corpus.average, 6))], "n_docs long, avg_len double")


@query(f"with {CC} select term, chunk_id, count(*) as tf, any_value(n)::bigint as doc_len from (select chunk_id, len({tokens('searchable_text')}) as n, unnest({tokens('searchable_text')}) as term from cc) group by term, chunk_id")
def fts_postings(t: Tables) -> DataFrame:
    return postings(docs(t)).select("term", c("id").alias("chunk_id"), "tf", "doc_len")


@query(f"with {BM} select query_id, id, round(score, 6) as score from scores")
def bm25_score(t: Tables) -> DataFrame:
    # positive scores rounded as the SQL does; F.round goes through a decimal for each of the pairs
    return Corpus.of(docs(t)).scores(text_queries(t)).select("query_id", "id", (F.floor(c("score") * 1e6 + 0.5) / F.lit(1e6)).alias("score"))


@query(f"with {BM} select query_id, id, round(score, 6) as score, rank from bm")
def bm25_topk(t: Tables) -> DataFrame:
    return Corpus.of(docs(t)).topk(text_queries(t), 10).select("query_id", "id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank"))


@query("with q as (select embedding::double[] as e from embeddings order by vec_id limit 1) select vec_id as id, round(list_distance(embedding::double[], e), 6) as distance from embeddings, q order by round(list_distance(embedding::double[], e), 9), vec_id limit 10")
def knn_l2(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    return knn(e, "vec_id", "embedding", e.orderBy("vec_id").first().embedding, 10).select("id", F.round("distance", 6).alias("distance"))


@query(f"with {SIG}, q as (select vector as e from sig order by id limit 1) select id, round(list_distance(vector, e), 6) as distance from sig, q order by round(list_distance(vector, e), 9), id limit 10")
def knn_l2_nullable(t: Tables) -> DataFrame:
    s = t.vectors("signature_embedding")
    return knn(s, "id", "vector", s.orderBy("id").first().vector, 10).select("id", F.round("distance", 6).alias("distance"))


@query(
    """with p as (select q.vec_id as query_id, v.vec_id as id, list_distance(q.embedding::double[], v.embedding::double[]) as d from embeddings q, embeddings v where q.vec_id % 100 = 0)
    select query_id, id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by round(d, 9), id) as rank from p) where rank <= 10"""
)
def knn_batch(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    found = knn_batch_op(e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10, 64)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), c("rank").cast("long").alias("rank"))


def nearest(t: Tables, field: str = "embedding") -> DataFrame:
    v = t.vectors(field)
    return knn_batch_op(v, v.where(by_100("id")).withColumnRenamed("id", "query_id"), 10, 64)


def fused_sql(*names: str) -> str:
    every = " union all ".join(f"select query_id, id, rank from {n}" for n in names)
    return f"fused as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from (select query_id, id, sum(1.0::double / (60 + rank)) as score from ({every}) group by query_id, id))"


SHOW_FUSED = "select query_id, id, round(score, 6) as score, rank from fused where rank <= 10"


def show(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank"))


@query(f"with {VEC}, {SIG}, {near('vec', 'nv')}, {near('sig', 'ns')}, {fused_sql('nv', 'ns')} select query_id, id, round(score, 6) as score, rank from fused")
def rrf_fuse(t: Tables) -> DataFrame:
    return show(fusion.rrf([nearest(t), nearest(t, "signature_embedding")]))


@query(f"with {BM}, {VEC}, {near('vec', 'nv')}, {fused_sql('bm', 'nv')} {SHOW_FUSED}")
def hybrid_search(t: Tables) -> DataFrame:
    return show(fusion.rrf([Corpus.of(docs(t)).topk(text_queries(t), 10), nearest(t)], 10))


@query(f"with {VEC}, {SIG}, {near('vec', 'nv')}, {near('sig', 'ns')}, {fused_sql('nv', 'ns')} {SHOW_FUSED}")
def code_arm(t: Tables) -> DataFrame:
    return show(fusion.rrf([nearest(t), nearest(t, "signature_embedding")], 10))


@query(f"with {BM}, {VEC}, {SIG}, {near('vec', 'nv')}, {near('sig', 'ns')}, {fused_sql('bm', 'nv', 'ns')} {SHOW_FUSED}")
def code_arm_nary(t: Tables) -> DataFrame:
    return show(fusion.rrf([Corpus.of(docs(t)).topk(text_queries(t), 10), nearest(t), nearest(t, "signature_embedding")], 10))


README_DOCS = f"{RC}, rdocs as (select chunk_id as id, content as text from rc)"
CRATE_DOCS = "kdocs as (select chunk_id as id, description as text from crate_chunks where description is not null)"


def renamed(sql: str, prefix: str) -> str:
    """The BM25 expressions under names of their own."""
    for name in ("wanted", "scores", "post", "dfs", "tot", "tok", "bm"):
        sql = __import__("re").sub(rf"\b{name}\b", prefix + name, sql)
    return sql


R_BM = f"{README_DOCS}, {renamed(bm25('rdocs', 'queries'), 'r_')}"
K_BM = f"{CRATE_DOCS}, {renamed(bm25('kdocs', 'queries'), 'k_')}"
TYPED = """typed as (select query_id, 0 as type_order, 'code' as chunk_type, id, 1.0::double / (60 + rank) as relevance from bm where rank <= 5
    union all select query_id, 1, 'readme', id, 1.0::double / (60 + rank) from r_bm where rank <= 2 union all select query_id, 2, 'crate', id, 1.0::double / (60 + rank) from k_bm where rank <= 3)"""
PATHED = "pathed as (select typed.*, coalesce(cc.file_path, rc.file_path, k.crate_path) as file_path, cc.identifier, coalesce(cc.project_name, rc.project_name, k.project_name) as project, cc.start_line as line from typed left join cc on typed.chunk_type = 'code' and cc.chunk_id = id left join rc on typed.chunk_type = 'readme' and rc.chunk_id = id left join crate_chunks k on typed.chunk_type = 'crate' and k.chunk_id = id)"
FLAT = "flat as (select *, row_number() over (partition by query_id order by round(relevance, 9) desc, file_path, type_order, id) as rank from pathed)"
ALL_TYPES = f"with {BM}, {R_BM}, {K_BM}, {TYPED}, {PATHED}, {FLAT}"


def typed(t: Tables) -> DataFrame:
    """Rows of the three chunk types found for each query, with the relevance of their ranks."""
    q = text_queries(t)
    readme = t.readme("content").select(c("chunk_id").alias("id"), c("content").alias("text"))
    crate = t.crates().where("description is not null").select(c("chunk_id").alias("id"), c("description").alias("text"))
    parts = []
    for n, (name, corpus, limit) in enumerate((("code", docs(t), 5), ("readme", readme, 2), ("crate", crate, 3))):
        found = Corpus.of(corpus).topk(q, limit)
        parts.append(found.select("query_id", F.lit(n).alias("type_order"), F.lit(name).alias("chunk_type"), "id", (1.0 / (60 + c("rank"))).alias("relevance")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def flat(t: Tables) -> DataFrame:
    """The rows of ``typed`` with path, identifier, project, line and rank."""
    meta = t.code("file_path", "identifier", "project_name", "start_line").select(F.lit("code").alias("chunk_type"), c("chunk_id").alias("id"), "file_path", "identifier", c("project_name").alias("project"), c("start_line").alias("line"))
    none = F.lit(None)
    meta = meta.unionByName(t.readme("file_path", "project_name").select(F.lit("readme").alias("chunk_type"), c("chunk_id").alias("id"), "file_path", none.cast("string").alias("identifier"), c("project_name").alias("project"), none.cast("long").alias("line")))
    meta = meta.unionByName(t.crates().select(F.lit("crate").alias("chunk_type"), c("chunk_id").alias("id"), c("crate_path").alias("file_path"), none.cast("string").alias("identifier"), c("project_name").alias("project"), none.cast("long").alias("line")))
    return fusion.flatten(typed(t).join(meta, ["chunk_type", "id"]))


@query(f"{ALL_TYPES} select query_id, chunk_type, id, round(relevance, 6) as relevance from typed")
def search_all_types(t: Tables) -> DataFrame:
    return typed(t).select("query_id", "chunk_type", "id", F.round("relevance", 6).alias("relevance"))


@query(f"{ALL_TYPES} select query_id, chunk_type, id, file_path, identifier, project, coalesce(line, 0) as line, round(relevance, 6) as relevance from pathed")
def flatten_union(t: Tables) -> DataFrame:
    return flat(t).select("query_id", "chunk_type", "id", "file_path", "identifier", "project", F.coalesce("line", F.lit(0)).alias("line"), F.round("relevance", 6).alias("relevance"))


@query(f"{ALL_TYPES} select query_id, rank, chunk_type, id from flat")
def flatten_rank(t: Tables) -> DataFrame:
    return flat(t).select("query_id", c("rank").cast("long").alias("rank"), "chunk_type", "id")


@query(f"{ALL_TYPES} select query_id, rank, chunk_type, id as chunk_id, file_path as path, coalesce(identifier, project) as label, project, round(relevance, 6) as relevance, round(relevance * 100)::int as relevance_pct, coalesce(line, 0) as line from flat")
def build_sources(t: Tables) -> DataFrame:
    return flat(t).select(
        "query_id", c("rank").cast("long").alias("rank"), "chunk_type", c("id").alias("chunk_id"), c("file_path").alias("path"), F.coalesce("identifier", "project").alias("label"), "project",
        F.round("relevance", 6).alias("relevance"), F.round(c("relevance") * 100).cast("int").alias("relevance_pct"), F.coalesce("line", F.lit(0)).alias("line"),
    )


VOTES = "voted as (select query_id, project, votes from (select *, row_number() over (partition by query_id order by votes desc, project) as n from (select query_id, project, count(*) as votes from flat where rank <= 5 group by all)) where n = 1)"


@query(f"{ALL_TYPES}, {VOTES} select query_id, project as project_name, votes from voted")
def vote_project(t: Tables) -> DataFrame:
    return fusion.vote(flat(t).withColumnRenamed("project", "project_name"))


# --- intent ----------------------------------------------------------------------------------

LABELLED = """protos as (select label as proto_id, case label % 4 when 0 then 'overview' when 1 then 'implementation' when 2 then 'relationship' else 'comparison' end as intent, list(m order by i) as proto
      from (select label, i, avg(x) as m from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label),
    sims as (select vec_id as query_id, intent, proto_id, list_cosine_similarity(embedding::double[], proto) as similarity from embeddings, protos where vec_id % 100 = 0),
    place as (select * from (values ('overview', 1), ('implementation', 2), ('relationship', 3), ('comparison', 4)) v(intent, p)),
    near3 as (select * from (select sims.*, row_number() over (partition by query_id order by round(similarity, 9) desc, p, proto_id) as n from sims join place using (intent)) where n <= 3),
    votes as (select q.query_id, place.intent, p, coalesce(sum(near3.similarity), 0) as weight from (select distinct query_id from sims) q cross join place left join near3 on near3.query_id = q.query_id and near3.intent = place.intent group by all),
    best as (select query_id, intent, weight as confidence, weight - coalesce(nxt, 0) as margin from (select *, row_number() over w as n, lead(weight) over w as nxt from votes window w as (partition by query_id order by round(weight, 9) desc, p)) where n = 1)"""


def labelled_similarities(t: Tables) -> DataFrame:
    """Similarity of the queried vectors to the mean vector of each label; labels stand for intents."""
    e = t.raw("embeddings")
    mean = e.select("label", F.posexplode(c("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    proto = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("proto"))
    names = F.array(*[F.lit(x) for x in ("overview", "implementation", "relationship", "comparison")])
    protos = proto.select(c("label").alias("proto_id"), F.element_at(names, (c("label") % 4 + 1).cast("int")).alias("intent"), "proto")
    asked = e.where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))
    return intent.similarities(asked, protos)


@query(f"with {LABELLED} select query_id, intent, round(weight, 6) as weight from votes")
def intent_knn_vote(t: Tables) -> DataFrame:
    return intent.knn_vote(labelled_similarities(t)).select("query_id", "intent", F.round("weight", 6).alias("weight"))


@query(f"with {LABELLED} select query_id, intent, round(max(similarity), 6) as weight from sims group by query_id, intent")
def intent_max_sim(t: Tables) -> DataFrame:
    return intent.max_similarity(labelled_similarities(t)).select("query_id", "intent", F.round("weight", 6).alias("weight"))


@query(f"with {LABELLED} select query_id, intent, round(confidence, 6) as confidence, round(margin, 6) as margin from best")
def intent_margin(t: Tables) -> DataFrame:
    return intent.margins(intent.knn_vote(labelled_similarities(t))).select("query_id", "intent", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


@query(f"with {LABELLED} select query_id, case when confidence >= 0.3 then intent else 'implementation' end as intent, round(confidence, 6) as confidence from best")
def classify(t: Tables) -> DataFrame:
    return intent.classify(labelled_similarities(t)).select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


# --- comparison and the whole pipeline ---------------------------------------------------------

SIDES = "sides as (select query_id || '#' || s as query_id, query_id as asked, s, case s when 'a' then query else (select min(project_name) from cc where chunk_id = query_id) || ' ' || query end as query from queries, (values ('a'), ('b')) v(s))"
C_BM = renamed(bm25("docs", "sides"), "c_").replace("<= 10", "<= 12")
COMPARE = f"""{SIDES}, {C_BM}, lists as (select sides.asked as query_id, s, c_bm.* exclude (query_id), project_name from c_bm join sides using (query_id) join cc on chunk_id = id),
    v as (select query_id, project_name from (select *, row_number() over (partition by query_id order by n desc, project_name) as k from (select query_id, project_name, count(*) as n from lists where rank <= 5 group by all)) where k = 1),
    kept as (select * from (select lists.*, row_number() over (partition by lists.query_id, s order by rank) as r from lists join v using (query_id, project_name)) where r <= 8),
    fused as (select *, row_number() over (partition by query_id order by round(fused_score, 9) desc, id) as place from (select query_id, id, sum(1.0::double / (60 + r)) as fused_score, max(score) as relevance from kept group by query_id, id))"""


@query(f"with {DOCS}, {COMPARE} select query_id, id, round(relevance, 6) as relevance, place from fused where place <= 5")
def comparison_fusion(t: Tables) -> DataFrame:
    """Two sub-queries each: twelve rows a list, the project most of the first five have, eight rows a list of it, fused; the better score stays."""
    cc = t.code("project_name")
    asked = text_queries(t).join(cc.withColumnRenamed("chunk_id", "query_id"), "query_id")
    sides = asked.select(c("query_id").alias("asked"), F.explode(F.array(F.struct(F.lit("a").alias("s"), c("query").alias("q")), F.struct(F.lit("b").alias("s"), F.concat_ws(" ", "project_name", "query").alias("q")))).alias("x"))
    sides = sides.select(F.concat_ws("#", "asked", "x.s").alias("query_id"), "asked", "x.s", c("x.q").alias("query"))
    lists = Corpus.of(docs(t)).topk(sides, 12).join(sides.select("query_id", "asked", "s"), "query_id").drop("query_id").withColumnRenamed("asked", "query_id").join(cc.withColumnRenamed("chunk_id", "id"), "id")
    kept = lists.join(fusion.vote(lists).drop("votes"), ["query_id", "project_name"]).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("rank"))).where("r <= 8")
    fused = kept.groupBy("query_id", "id").agg(F.sum(1.0 / (60 + c("r"))).alias("fused"), F.max("score").alias("relevance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "id"))
    return fused.withColumn("place", place).where("place <= 5").select("query_id", "id", F.round("relevance", 6).alias("relevance"), c("place").cast("long").alias("place"))


RERANKED = f"""texts as (select chunk_id as id, concat_ws(chr(10), coalesce(signature, identifier) || ' (' || language || ')', nullif(docstring, ''), {cut('code_content', 1200, '...')}) as rr from cc),
    cand as (select f.query_id, f.id, list_distinct({tokens('query')}) as qt, list_distinct({tokens('rr')}) as tt from fused f join queries using (query_id) join texts on texts.id = f.id where rank <= 20),
    scored as (select query_id, id, 1 / (1 + exp(-(8.0::double * len(list_intersect(qt, tt)) / greatest(1, len(qt)) - 4.0::double))) as score from cand)"""


@query(f"with {BM}, {VEC}, {near('vec', 'nv')}, {fused_sql('bm', 'nv')}, {RERANKED} select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored) where rank <= 5")
def rerank(t: Tables) -> DataFrame:
    """Candidates of the hybrid arm scored by a reranker seam (a lexical stand-in for a model)."""
    from lodestrata.functions.text import rerank_text_code
    from lodestrata.plans.seams import lexical_score, rerank as rerank_op

    found = fusion.rrf([Corpus.of(docs(t)).topk(text_queries(t), 10), nearest(t)], 20).select("query_id", "id")
    texts = t.code("signature", "identifier", "language", "docstring", "code_content").select(c("chunk_id").alias("id"), rerank_text_code(c("signature"), c("identifier"), c("language"), c("docstring"), c("code_content")).alias("text"))
    return show(rerank_op(found.join(text_queries(t), "query_id").join(texts, "id"), lexical_score, 5))
