"""Call graph: one-hop lookups, breadth-first search, paths, and the merge of graph rows into results.

``edges`` are (caller, callee) pairs unless said otherwise; rows that stand
twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.vectors import tier_score
from lodestrata.runtime import cut_lineage

#: fixed values: words that name no target
STOP_WORDS = ["the", "a", "an", "this", "that", "my", "our", "your", "its", "function", "method", "class", "struct", "module", "file", "code", "in", "of", "to", "from", "for", "with"]


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(node, neighbour) one hop from ``nodes(node)``; direction is callers, callees or both."""
    out = []
    if direction in ("callers", "both"):
        out.append(edges.select(F.col("callee").alias("node"), F.col("caller").alias("neighbour")))
    if direction in ("callees", "both"):
        out.append(edges.select(F.col("caller").alias("node"), F.col("callee").alias("neighbour")))
    links = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return links.join(nodes, "node", "left_semi").distinct()


def bfs(edges: DataFrame, starts: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """(node, depth) reachable from ``starts(node)``, least depth each; the starts are left out.

    direction is callers, callees or both. Cycles end, and the search ends
    where nothing new is reached, however great ``max_depth`` is; depth 1 is
    always searched.
    """
    up, down = edges.select(F.col("callee").alias("from"), F.col("caller").alias("node")), edges.select(F.col("caller").alias("from"), F.col("callee").alias("node"))
    step = {"callers": up, "callees": down}.get(direction)
    step = (up.unionByName(down) if step is None else step).where("from is not null and node is not null").distinct()
    seen = starts.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max(1, max_depth) + 1):
        if depth % 8 == 0:
            seen = cut_lineage(seen)
        reached = front.select(F.col("node").alias("from")).join(step, "from").select("node").distinct().join(seen, "node", "left_anti")
        front = cut_lineage(reached.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 8) -> DataFrame:
    """One row (path array, length), none if there is no path; of equal lengths the smallest in dictionary order."""
    spark = edges.sparkSession
    first = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    if start == goal:
        return first.select("path", F.lit(0).alias("length"))
    step = edges.select(F.col("caller").alias("from"), F.col("callee").alias("node")).where("from is not null and node is not null").distinct()
    seen, front = first.select("node"), first
    for depth in range(1, max_depth + 1):
        grown = front.select(F.col("node").alias("from"), "path").join(step, "from").join(seen, "node", "left_anti")
        front = cut_lineage(grown.select("node", F.concat("path", F.array("node")).alias("path")).groupBy("node").agg(F.min("path").alias("path")))
        hit = front.where(F.col("node") == goal)
        if not hit.isEmpty():
            return hit.select("path", F.lit(depth).alias("length"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
    return first.where("false").select("path", F.lit(0).alias("length"))


def unique_identifiers(chunks: DataFrame) -> DataFrame:
    """(identifier, chunk_id): lower-cased identifiers that only one chunk has."""
    return chunks.select(F.lower("identifier").alias("identifier"), "chunk_id").groupBy("identifier").agg(F.min("chunk_id").alias("chunk_id"), F.max("chunk_id").alias("other")).where("chunk_id = other").drop("other")


def detect_direction(query: Column) -> Column:
    """callers, callees or both, by the wording."""
    q = F.lower(query)
    has = lambda *words: [q.contains(w) for w in words]
    by, by2, what, who, where, called, does, call, depend, uses = has("called by", "invoked by", "what calls", "who calls", "where is", "called", "does", "call", "depend on", "uses")
    return F.when(by | by2 | what | who | (where & called), "callers").when((does & call) | depend | uses, "callees").otherwise("both")


def _meaningful(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\s?.`]"), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))
    return F.get(words, F.lit(0))


def extract_target(query: Column) -> Column:
    """The identifier that a question is about, null if none is found."""
    after = lambda marker: _meaningful(F.regexp_extract(query, f"(?is)^.*?{marker}(.*)$", 1))
    quoted = F.regexp_extract(query, "`([^`]+)`", 1)
    return F.coalesce(
        after("what calls "), after("who calls "), after("called by "), _meaningful(F.regexp_extract(query, "(?is)what does (.*?) call", 1)), after("callers of "), after("callees of "), F.when(quoted != "", quoted)
    )


def resolve_target(candidates: DataFrame, unique: DataFrame) -> DataFrame:
    """(query_id, chunk_id, how) from ``candidates(query_id, term, id, identifier, rank)``.

    Test functions are left out unless there is nothing else. In order: the
    same identifier, a unique identifier of the graph, one that contains the
    term; without a term the first candidate. ``unique``: (identifier, chunk_id),
    or (query_id, identifier, chunk_id) where what is unique depends on the question.
    """
    test = F.col("identifier").startswith("test_")
    any_real = F.max((~test).cast("int")).over(Window.partitionBy("query_id"))
    usable = candidates.withColumn("real", any_real).where((F.col("real") == 0) | ~test)
    term, name = F.lower("term"), F.lower("identifier")
    own = usable.select("query_id", F.col("id").alias("chunk_id"), "rank", F.when(F.col("term").isNull(), 4).when(name == term, 1).when(F.contains(name, term), 3).alias("how")).where("how is not null")
    queries = usable.where("term is not null").select("query_id", term.alias("identifier")).distinct()
    known = queries.join(unique, ["query_id", "identifier"] if "query_id" in unique.columns else "identifier").select("query_id", "chunk_id", F.lit(0).alias("rank"), F.lit(2).alias("how"))
    w = Window.partitionBy("query_id").orderBy("how", "rank", "chunk_id")
    return own.unionByName(known).withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "chunk_id", "how")


def augment(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, score): one hop from ``targets(query_id, node, direction)`` over edges with a tier.

    Targets with a project_name keep to the edges of that project. The score is that of the best tier between target and chunk.
    """
    within = ["project_name"] if "project_name" in targets.columns else []
    callers = edges.select(F.col("callee").alias("node"), F.col("caller").alias("id"), "tier", F.lit("callers").alias("way"), *within)
    callees = edges.select(F.col("caller").alias("node"), F.col("callee").alias("id"), "tier", F.lit("callees").alias("way"), *within)
    hit = targets.join(callers.unionByName(callees), ["node", *within]).where((F.col("direction") == "both") | (F.col("direction") == F.col("way")))
    return hit.groupBy("query_id", "id").agg(F.min("tier").alias("tier")).select("query_id", "id", tier_score(F.col("tier")).alias("score"))


def merge(results: DataFrame, graph: DataFrame) -> DataFrame:
    """Results with the graph's rows added; a row that is there keeps its score. (query_id, id, score, from_graph)"""
    added = graph.select("query_id", "id", F.col("score").alias("added"), F.lit(True).alias("g"))
    both = results.select("query_id", "id", "score", F.lit(True).alias("r")).join(added, ["query_id", "id"], "full")
    return both.select("query_id", "id", F.when(F.col("r"), F.col("score")).otherwise(F.col("added")).alias("score"), F.coalesce("g", F.lit(False)).alias("from_graph"))


def merge_best(results: DataFrame, targets: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Of the results merged with :func:`augment`: all results, and of the graph's other rows those among each question's best ``n``, ties by id.

    The links of a target are found and ranked once, whatever the number of
    questions about it: each question then asks for its results among them and
    for the best ``n``, so a chunk that many edges lead to isn't repeated with
    all its links.
    """
    asks = [x for x in targets.columns if x != "query_id"]
    about = targets.select("query_id", F.struct(*asks).alias("about"))
    links = augment(about.select(F.col("about").alias("query_id"), "about.*").distinct(), edges).withColumnRenamed("query_id", "about")
    w = Window.partitionBy("about").orderBy(F.desc(F.round("score", 9)), "id")
    own, any_id = F.struct(F.lit(True).alias("own"), F.col("id").alias("want")), F.struct(F.lit(False).alias("own"), F.lit("").alias("want"))
    kinds = F.when(F.row_number().over(w) <= n, F.array(own, any_id)).otherwise(F.array(own))
    found = links.withColumn("kinds", kinds).select("about", F.col("id").alias("linked"), F.col("score").alias("added"), F.lit(True).alias("g"), F.inline("kinds"))
    lists = results.groupBy("query_id").agg(F.collect_list(F.struct("id", "score")).alias("rows")).join(about, "query_id", "full")
    kind = lambda own, want, score, ids: F.struct(F.lit(own).alias("own"), want.alias("want"), score.cast("double").alias("score"), ids.cast("array<string>").alias("ids"))
    asked = F.concat(F.transform(F.coalesce("rows", F.array()), lambda r: kind(True, r.id, r.score, F.lit(None))), F.array(kind(False, F.lit(""), F.lit(None), F.col("rows.id"))))
    both = lists.select("query_id", "about", F.inline(asked)).join(found, ["about", "own", "want"], "left")
    new = F.col("g") & ~F.coalesce(F.array_contains("ids", F.col("linked")), F.lit(False))
    mine = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    return both.where(F.col("own") | new).select("query_id", mine("want", "linked").alias("id"), mine("score", "added").alias("score"), F.coalesce("g", F.lit(False)).alias("from_graph"))


def reserve(rows: DataFrame, limit: int, least: int | Column) -> DataFrame:
    """The first ``limit`` of ``rows(query_id, id, score, from_graph, pos)``, at least ``least`` of them from the graph if there are so many.

    least may be a column of the rows.

    Graph rows below the cut push out the lowest-scored others above it.
    """
    q = Window.partitionBy("query_id")
    upper = F.col("pos") <= limit
    have = F.sum((upper & F.col("from_graph")).cast("int")).over(q)
    order = Window.partitionBy("query_id", "from_graph", "upper").orderBy("pos")
    base = rows.withColumn("upper", upper).withColumn("have", have).withColumn("nth", F.row_number().over(order))
    lifted = ~F.col("upper") & F.col("from_graph") & (F.col("nth") <= F.greatest(F.lit(0), (least if isinstance(least, Column) else F.lit(least)) - F.col("have")))
    base = base.withColumn("lifted", lifted).withColumn("lifts", F.sum(F.col("lifted").cast("int")).over(q)).withColumn("others", F.sum((F.col("upper") & ~F.col("from_graph")).cast("int")).over(q))
    best = Window.partitionBy("query_id", "upper", "from_graph").orderBy(F.desc(F.round("score", 9)), "pos")
    base = base.withColumn("best", F.row_number().over(best))
    stays = F.col("upper") & (F.col("from_graph") | (F.col("best") <= F.col("others") - F.least("lifts", "others")))
    kept = base.where(stays | F.col("lifted"))
    final = Window.partitionBy("query_id").orderBy(F.when(F.col("lifts") == 0, F.col("pos")), F.desc(F.round("score", 9)), "pos")
    return kept.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).select("query_id", "id", "score", "from_graph", "rank")


def prepend(rows: DataFrame, limit: int) -> DataFrame:
    """Graph rows first, best score first, at most ``limit`` - 1 of them; then the others in their order, ``limit`` in all."""
    w = Window.partitionBy("query_id", "from_graph").orderBy(F.when(F.col("from_graph"), -F.round("score", 9)), F.when(~F.col("from_graph"), F.col("pos")), "id")
    numbered = rows.withColumn("nth", F.row_number().over(w)).where(~F.col("from_graph") | (F.col("nth") <= limit - 1))
    final = Window.partitionBy("query_id").orderBy(F.desc("from_graph"), "nth")
    return numbered.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).select("query_id", "id", "score", "from_graph", "rank")
