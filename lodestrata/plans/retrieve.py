"""The retrieval pipeline over a batch of questions.

Every step works on all questions at once: what the intent of a question
decides (limits, arms, rerank) is a column, and one search of each chunk type
serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import tokenize
from lodestrata.functions.vectors import distance_to_relevance, sigmoid
from lodestrata.operators import fusion, graph, intent
from lodestrata.operators.fulltext import Corpus
from lodestrata.operators.vectors import knn_batch
from lodestrata.plans import chunk_types
from lodestrata.plans.seams import lexical_score, term_vector
from lodestrata.runtime import cut_lineage
from lodestrata.sources.tables import Tables

PER_LIST, KEPT, SPARE = 12, 8, 5  # comparison: rows of a list, of these kept; rows beyond the limit that a soft reserve may lift


@dataclass(frozen=True)
class EngineConfig:
    """hybrid: full text beside vectors where the intent's policy has it. rerank: where the policy has it.

    fallback: a reranker may give no score (null); a question that has such a
    row is then answered by the search's own scores at the final limits.
    """

    hybrid: bool = True
    rerank: bool = False
    fallback: bool = False
    rrf_k: int = fusion.RRF_K
    dim: int = 16


def by_intent(values: dict) -> Column:
    return reduce(lambda out, kv: F.when(F.col("intent") == kv[0], F.lit(kv[1])).otherwise(out), values.items(), F.lit(None))


def classified(questions: DataFrame, embed: Callable[[Column], Column], options: dict | None = None) -> DataFrame:
    """(query_id, query, vector, intent): the intent a question comes with, else that of its wording, else of its nearest prototypes."""
    given = F.col("intent") if "intent" in questions.columns else F.lit(None).cast("string")
    # written once: the batch may be the result of something that gives other rows when it runs again
    q = cut_lineage(questions.select("query_id", "query", given.alias("given"), embed(F.col("query")).alias("vector")))
    spark = questions.sparkSession
    protos = intent.prototypes(spark).select(F.concat_ws("#", "intent", F.lpad(F.col("position").cast("string"), 2, "0")).alias("proto_id"), "intent", embed(F.col("text")).alias("proto"))
    near = intent.classify(intent.similarities(q, protos), **(options or {})).select("query_id", F.col("intent").alias("near"))
    wide = q.join(near, "query_id")
    return wide.select("query_id", "query", "vector", F.coalesce("given", intent.pre_classify(F.col("query")), "near").alias("intent"))


def planned(questions: DataFrame, config: EngineConfig) -> DataFrame:
    """Questions with bm25, rerank, and for each chunk type the final limit and how many rows to fetch."""
    arms = {i: dict(zip(("bm25", "rerank", "folder", "file", "signature"), a)) for i, a in intent.ARMS.items()}
    out = questions.withColumn("bm25", F.lit(config.hybrid) & by_intent({i: a["bm25"] for i, a in arms.items()}))
    out = out.withColumn("rerank", F.lit(config.rerank) & by_intent({i: a["rerank"] for i, a in arms.items()}))
    for n, kind in enumerate(intent.TYPES):
        allowed = {i: intent.ROUTES[i][n] if kind not in ("folder", "file") or arms[i][kind] else 0 for i in intent.INTENTS}
        out = out.withColumn(f"limit_{kind}", by_intent(allowed))
        out = out.withColumn(f"fetch_{kind}", F.col(f"limit_{kind}") * F.when(F.col("rerank"), intent.RERANK_FACTOR[kind]).otherwise(1))
    return out


@dataclass(frozen=True)
class Size:
    """rows of a chunk type; of these docs in full-text search, with their average length."""

    rows: int
    docs: int
    average: float


def sizes(found: dict[str, DataFrame]) -> dict[str, Size]:
    """All chunk types measured in one pass."""
    each = [d.select(F.lit(k).alias("kind"), F.when(F.col("text").isNotNull(), F.size(tokenize(F.col("text")))).alias("n")) for k, d in found.items()]
    rows = reduce(DataFrame.unionByName, each).groupBy("kind").agg(F.count("*").alias("rows"), F.count("n").alias("docs"), F.avg("n").alias("a")).collect()
    return {k: Size(0, 0, 0.0) for k in found} | {r.kind: Size(r.rows, r.docs, r.a or 0.0) for r in rows}


@dataclass
class Arm:
    """One chunk type's lists for all questions: nearest vectors, and full text (None where no question has it)."""

    near: DataFrame
    text: DataFrame | None
    config: EngineConfig

    @classmethod
    def search(cls, kind: str, found: DataFrame, size: Size, plan: DataFrame, asked: int, config: EngineConfig, embed: Callable[[Column], Column]) -> Arm:
        factor = intent.RERANK_FACTOR[kind] if config.rerank else 1
        most = max(r[intent.TYPES.index(kind)] for r in intent.ROUTES.values()) * factor
        asking = plan.where(F.col(f"fetch_{kind}") > 0)
        near = knn_batch(chunk_types.rows_of(found, embed), asking.select("query_id", "vector"), most, config.dim, sizes=(size.rows, asked))
        text = None
        if config.hybrid:
            text = Corpus(chunk_types.docs_of(found), size.docs, size.average).topk(asking.where("bm25").select("query_id", "query"), most, asked)
        return cls(near, text, config)

    @staticmethod
    def settle(arms: dict[str, Arm]) -> None:
        """Run the searches of all types beside each other, once; what is found is small."""
        for name in ("near", "text"):
            parts = [getattr(a, name).withColumn("kind", F.lit(k)) for k, a in arms.items() if getattr(a, name) is not None]
            if parts:
                found = cut_lineage(reduce(DataFrame.unionByName, parts))
                for k, a in arms.items():
                    setattr(a, name, found.where(F.col("kind") == k).drop("kind"))

    def top(self, plan: DataFrame, limit: str) -> DataFrame:
        """(query_id, id, score, pos): the first rows of each question, so many as its column ``limit`` says; fused by rank where both lists are."""
        q = plan.select("query_id", "bm25", F.col(limit).alias("limit"))
        near = self.near.join(q, "query_id").where(F.col("rank") <= F.col("limit"))
        alone = near.where("not bm25").select("query_id", "id", distance_to_relevance(F.col("distance")).alias("score"), F.col("rank").alias("pos"))
        if self.text is None:
            return alone
        text = self.text.join(q, "query_id").where(F.col("rank") <= F.col("limit"))
        both = fusion.rrf([near.where("bm25"), text], k=self.config.rrf_k).join(q, "query_id").where(F.col("rank") <= F.col("limit"))
        return alone.unionByName(both.select("query_id", "id", "score", F.col("rank").alias("pos")))


def compared(plan: DataFrame, code: DataFrame, rows: int, asked: int, config: EngineConfig, embed: Callable[[Column], Column]) -> DataFrame:
    """(query_id, id, score, pos) of comparisons whose two sides the wording names.

    The question itself and the question with each side before it are searched
    by vectors, twelve rows each; of the project that most of the question's
    first five rows have, eight rows a list are fused; the best of a row's
    relevances stays.
    """
    sided = plan.where("intent = 'comparison'").select("query_id", "query", "limit_code", intent.comparators(F.col("query")).alias("sides")).where("sides is not null")
    put = F.concat(F.array("query"), F.transform("sides", lambda s: F.concat(s, F.lit(" "), F.col("query"))))
    subs = sided.select(F.col("query_id").alias("asked"), "limit_code", F.posexplode(put).alias("s", "query"))
    subs = subs.select(F.concat_ws("#", "asked", F.col("s").cast("string")).alias("query_id"), "asked", "s", "limit_code", embed(F.col("query")).alias("vector"))
    found = knn_batch(chunk_types.rows_of(code, embed), subs.select("query_id", "vector"), PER_LIST, config.dim, sizes=(rows, 3 * asked))
    lists = found.join(subs.select("query_id", "asked", "s", "limit_code"), "query_id").drop("query_id").withColumnRenamed("asked", "query_id")
    lists = lists.join(code.select("id", F.col("project").alias("project_name")), "id")
    voted = fusion.vote(lists.where("s = 0")).drop("votes")
    kept = lists.join(voted, ["query_id", "project_name"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("rank"))).where(F.col("rank") <= KEPT)
    best = kept.groupBy("query_id", "id").agg(F.max(distance_to_relevance(F.col("distance"))).alias("score"), F.max("limit_code").alias("limit"))
    fused = fusion.rrf([kept], k=config.rrf_k).select("query_id", "id", F.col("rank").alias("pos"))
    return fused.join(best, ["query_id", "id"]).where(F.col("pos") <= F.col("limit")).select("query_id", "id", "score", "pos")


def graph_rows(plan: DataFrame, code_list: DataFrame, code: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, score): chunks one call away from what a question is about, within the project of its first row."""
    asking = plan.where(F.col("intent").isin("relationship", "implementation")).select("query_id", "query")
    names = code.select("id", "identifier", F.col("project").alias("project_name"))
    first = code_list.where(F.col("pos") <= 5).join(asking, "query_id").join(names, "id")
    own = first.where("pos = 1").select("query_id", "project_name")
    candidates = first.select("query_id", graph.extract_target(F.col("query")).alias("term"), "id", "identifier", F.col("pos").alias("rank"))
    ends = edges.select("project_name", F.explode(F.array(F.struct(F.lower("caller_identifier").alias("identifier"), F.col("caller").alias("chunk_id")), F.struct(F.lower("callee_identifier").alias("identifier"), F.col("callee").alias("chunk_id")))).alias("e")).select("project_name", "e.*")
    unique = ends.groupBy("project_name", "identifier").agg(F.min("chunk_id").alias("chunk_id"), F.max("chunk_id").alias("other")).where("chunk_id = other").drop("other")
    target = graph.resolve_target(candidates, own.join(unique, "project_name").select("query_id", "identifier", "chunk_id"))
    directed = target.join(asking, "query_id").join(own, "query_id").select("query_id", "project_name", F.col("chunk_id").alias("node"), graph.detect_direction(F.col("query")).alias("direction"))
    return graph.augment(directed, edges).join(code.select("id"), "id", "left_semi")


def reranked(rows: DataFrame, plan: DataFrame, texts: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows(query_id, id, …)`` with the reranker's score, null where it gave none, and their place by it."""
    wide = rows.join(plan.select("query_id", "query"), "query_id").join(texts.select("id", "rerank_text"), "id")
    scored = wide.withColumn("score", sigmoid(score(F.col("query"), F.col("rerank_text")))).drop("query", "rerank_text")
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))


@dataclass
class Retrieved:
    """plan: the questions with intent and limits. lists: (query_id, chunk_type, type_order, id, score, pos). places: (chunk_type, id, file_path, identifier, project, line). contexts: (chunk_type, id, context)."""

    plan: DataFrame
    lists: DataFrame
    places: DataFrame
    contexts: DataFrame

    def context(self) -> DataFrame:
        """(query_id, context): a section for each chunk type that has rows, in a fixed order, rows in theirs; a fixed sentence without any."""
        wide = self.lists.join(self.contexts, ["chunk_type", "id"])
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "context"))), lambda x: x["context"]), "")
        parts = wide.groupBy("query_id", "chunk_type").agg(listed.alias("part"))
        order, heading = (F.create_map(*[F.lit(x) for n, (k, h) in enumerate(chunk_types.SECTIONS.items()) for x in (k, (n, h)[i])]) for i in (0, 1))
        section = F.struct(F.element_at(order, F.col("chunk_type")).alias("n"), F.concat(F.element_at(heading, F.col("chunk_type")), F.lit("\n"), "part").alias("text"))
        whole = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["text"]), "\n\n").alias("context"))
        return self.plan.select("query_id").join(whole, "query_id", "left").select("query_id", F.coalesce("context", F.lit(chunk_types.NOTHING)).alias("context"))

    def flat(self) -> DataFrame:
        """(query_id, intent, rank, chunk_type, id, file_path, identifier, project, line, relevance): one ranked list for each question."""
        wide = self.lists.withColumnRenamed("score", "relevance").join(self.places, ["chunk_type", "id"])
        return fusion.flatten(wide).join(self.plan.select("query_id", "intent"), "query_id").select("query_id", "intent", "rank", "chunk_type", "id", "file_path", "identifier", "project", "line", "relevance")


def code_lists(plan: DataFrame, searched: DataFrame, arm: Arm, code: DataFrame, t: Tables, config: EngineConfig, score) -> tuple[DataFrame, DataFrame | None]:
    """The code rows of each question with its graph's, and the questions that the reranker failed (None where that can't be)."""
    extra = cut_lineage(graph_rows(plan, searched, code, t.edges()))
    merged = graph.merge(searched, extra)
    # rows of the graph come behind the others
    last = searched.groupBy("query_id").agg(F.max("pos").alias("n"))
    placed = merged.join(searched.select("query_id", "id", "pos"), ["query_id", "id"], "left").join(last, "query_id", "left")
    behind = F.row_number().over(Window.partitionBy("query_id", F.col("pos").isNull()).orderBy(F.desc(F.round("score", 9)), "id"))
    placed = placed.withColumn("pos", F.coalesce("pos", F.coalesce("n", F.lit(0)) + behind)).drop("n")
    ways = plan.select("query_id", "rerank", "intent", "limit_code", graph.detect_direction(F.col("query")).alias("direction")).join(extra.select("query_id").distinct().withColumn("g", F.lit(True)), "query_id", "left")
    some = F.coalesce("g", F.lit(False))
    ways = ways.select("query_id", "rerank", "limit_code", (some & (F.col("direction") != "both")).alias("explicit"), (some & (F.col("direction") == "both")).alias("soft"), F.when(F.col("intent") == "relationship", 2).otherwise(1).alias("least"))
    rows = cut_lineage(placed.join(ways, "query_id"))
    room = F.col("limit_code") + F.when(F.col("soft"), SPARE).when(~F.col("rerank"), 1 << 30).otherwise(0)
    plain, failed = rows.where("not rerank"), None
    after = plain.where("explicit").withColumn("nth", F.col("pos") + (1 << 20))
    if config.rerank:
        aside = rows.where("rerank and explicit and from_graph")  # the reranker has no say over these
        ranked = reranked(rows.where("rerank and not (explicit and from_graph)"), plan, code, score)
        if config.fallback:
            ranked = cut_lineage(ranked)
            failed = ranked.where("score is null").select("query_id").distinct()
            known = extra.select("query_id", "id", F.lit(True).alias("g"))
            again = arm.top(plan, "limit_code").join(failed, "query_id", "left_semi").join(ways, "query_id").join(known, ["query_id", "id"], "left").withColumn("from_graph", F.coalesce("g", F.lit(False)))
            ranked = ranked.join(failed, "query_id", "left_anti").unionByName(again.select(ranked.columns))
        plain = plain.unionByName(ranked)
        # explicit directions: the graph's rows first, at most all but one
        before = aside.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos", "id"))).where(F.col("nth") < F.col("limit_code"))
        after = plain.where(F.col("explicit") & (F.col("pos") <= room)).withColumn("nth", F.col("pos") + (1 << 20)).unionByName(before)
    plain = plain.where(F.col("pos") <= room)
    stitched = after.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))).where(F.col("pos") <= F.col("limit_code")).select("query_id", "id", "score", "pos")
    soft, keep = plain.where("soft"), ["query_id", "id", "score", "from_graph", "pos", "least"]
    reserved = graph.reserve(soft.select(*keep), intent.ROUTES["implementation"][0], F.col("least")).select("query_id", "id", "score", F.col("rank").alias("pos"))
    others = plain.where("not soft and not explicit").select("query_id", "id", "score", "pos")
    return stitched.unionByName(reserved).unionByName(others), failed


def retrieve(t: Tables, questions: DataFrame, config: EngineConfig | None = None, embed: Callable[[Column], Column] | None = None, score: Callable[[Column, Column], Column] = lexical_score, options: dict | None = None) -> Retrieved:
    """Answers of all ``questions(query_id, query)``, or (query_id, query, intent) where the intent of some is known.

    embed: text to vector of ``config.dim`` numbers. score: question and text to
    a logit, null where the reranker fails. options: of the intent classifier.
    Null or repeated questions aren't expected; an empty batch gives no rows.
    """
    config = config or EngineConfig()
    embed = embed or (lambda c: term_vector(c, config.dim))
    plan = cut_lineage(planned(classified(questions, embed, options), config))
    intents = {r.intent: r.n for r in plan.groupBy("intent").agg(F.count("*").alias("n")).collect()}  # four rows at most
    asked = sum(intents.values())
    found = chunk_types.all_chunks(t)
    size = sizes(found)
    arms = {kind: Arm.search(kind, found[kind], size[kind], plan, asked, config, embed) for kind in intent.TYPES}
    Arm.settle(arms)
    parts = [arms[k].top(plan, f"fetch_{k}").withColumn("chunk_type", F.lit(k)) for k in intent.TYPES]
    if "comparison" in intents:
        parts.append(compared(plan, found["code"], size["code"].rows, asked, config, embed).withColumn("chunk_type", F.lit("sides")))
    every = cut_lineage(reduce(DataFrame.unionByName, parts))
    of = lambda kind: every.where(F.col("chunk_type") == kind).drop("chunk_type")
    code, failed = of("code"), None
    if "comparison" in intents:
        # a comparison whose sides found something is answered by them
        code = code.join(of("sides").select("query_id").distinct(), "query_id", "left_anti").unionByName(of("sides"))
    if "relationship" in intents or "implementation" in intents or config.rerank:
        code, failed = code_lists(plan, code, arms["code"], found["code"], t, config, score)
    lists = {"code": code}
    for kind in intent.TYPES[1:]:
        lists[kind] = of(kind)
        if config.rerank:
            fetched = of(kind).join(plan.select("query_id", "rerank", F.col(f"limit_{kind}").alias("limit")), "query_id")
            ranked = reranked(fetched.where("rerank"), plan, found[kind], score).where(F.col("pos") <= F.col("limit"))
            if failed is not None:
                again = fetched if kind in ("folder", "file") else arms[kind].top(plan, f"limit_{kind}").withColumns({"rerank": F.lit(True), "limit": F.lit(0)})
                ranked = ranked.join(failed, "query_id", "left_anti").unionByName(again.join(failed, "query_id", "left_semi").select(ranked.columns))
            lists[kind] = fetched.where("not rerank").unionByName(ranked).select("query_id", "id", "score", "pos")
    parts = [d.select("query_id", F.lit(k).alias("chunk_type"), F.lit(n).alias("type_order"), "id", "score", "pos") for n, (k, d) in enumerate(lists.items())]
    places = [d.select(F.lit(k).alias("chunk_type"), "id", "file_path", "identifier", "project", "line") for k, d in found.items()]
    contexts = [d.select(F.lit(k).alias("chunk_type"), "id", "context") for k, d in found.items()]
    return Retrieved(plan, cut_lineage(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, places), reduce(DataFrame.unionByName, contexts))
