"""What a question asks for, and how each kind of question is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.vectors import cosine_similarity

INTENTS = ["overview", "implementation", "relationship", "comparison"]
DEFAULT_INTENT = "implementation"

#: fixed values: example questions of each intent
PROTOTYPES = {
    "overview": [
        "What is this project?", "Tell me about this codebase", "Give me an overview", "What does this do?", "Describe the purpose",
        "What is the architecture?", "What is the purpose of this module?", "What is the role of this component?", "What is this package?",
    ],
    "implementation": [
        "How does this function work?", "Show me the implementation", "How is this implemented?", "Walk me through the logic",
        "How is this function implemented?", "Walk through this code step by step", "What are the steps of this algorithm?",
    ],
    "relationship": [
        "What calls this function?", "How does A relate to B?", "What depends on this?", "Show me the call chain", "What uses this module?",
        "What formats does this support?", "How do errors propagate through the system?",
    ],
    "comparison": [
        "Compare A and B", "What are the differences between X and Y?", "How does A differ from B?", "A versus B", "Contrast these approaches",
        "What are the pros and cons?", "What is the difference between X and Y?", "How does X compare to Y?", "Differences between X and Y",
    ],
}

#: fixed values: rows to fetch of each chunk type (code, readme, crate, module_doc, folder, file) by intent
ROUTES = {
    "overview": (5, 3, 3, 3, 4, 2),
    "implementation": (5, 1, 1, 2, 1, 1),
    "relationship": (5, 1, 2, 2, 0, 1),
    "comparison": (5, 2, 3, 2, 2, 1),
    "default": (5, 2, 3, 3, 0, 0),
}
#: fixed values: which arms run (bm25, rerank, folder vectors, file vectors, signature vectors) by intent
ARMS = {
    "overview": (True, True, True, True, False),
    "implementation": (False, True, True, True, False),
    "relationship": (True, True, False, True, False),
    "comparison": (False, False, True, True, False),
}
#: fixed values: how many times the limit is fetched when the results are reranked
RERANK_FACTOR = {"code": 4, "readme": 2, "crate": 1, "module_doc": 2, "folder": 2, "file": 2}
TYPES = ["code", "readme", "crate", "module_doc", "folder", "file"]
#: fixed values: phrasings of comparisons, the more exact first
COMPARISONS = [
    r"(?i)how\s+(?:does|do)\s+(.+?)\s+and\s+(.+?)\s+(?:differ|compare)",
    r"(?i)how\s+(?:does|do)\s+(.+?)\s+differ\s+from\s+(.+?)[?.]?$",
    r"(?i)differences?\s+between\s+(.+?)\s+and\s+(.+?)[?.]?$",
    r"(?i)compare\s+(.+?)\s+(?:and|with|to)\s+(.+?)[?.]?$",
    r"(?i)^(.+?)\s+(?:vs\.?|versus)\s+(.+?)[?.]?$",
]


def prototypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, ts in PROTOTYPES.items() for n, t in enumerate(ts)], "intent string, position int, text string")


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in ROUTES.items()], "intent string, " + ", ".join(f"{t}_limit int" for t in TYPES))


def arms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in ARMS.items()], "intent string, bm25 boolean, rerank boolean, folder_vectors boolean, file_vectors boolean, signature_vectors boolean")


def fetch_limits(spark: SparkSession, rerank: bool = True) -> DataFrame:
    """(intent, chunk_type, fetched): rows to fetch before the rerank."""
    return spark.createDataFrame([(i, t, n * (RERANK_FACTOR[t] if rerank else 1)) for i, r in ROUTES.items() for t, n in zip(TYPES, r)], "intent string, chunk_type string, fetched int")


def parse(name: Column) -> Column:
    """The intent of that name, null for any other."""
    return F.when(name.isin(INTENTS), name)


def pre_classify(query: Column) -> Column:
    """``comparison`` where the wording leaves no doubt, else null."""
    q = F.lower(query)
    idiom = F.contains(q, F.lit("difference this makes")) | F.contains(q, F.lit("difference that makes")) | F.contains(q, F.lit("difference it makes"))
    in_name = q.contains("_vs_") | q.contains("_vs.") | q.contains("-vs-")
    cue = q.contains("difference between") | q.contains("differences between") | q.rlike(r"(?:^|[^\p{L}\p{N}])differs?(?:$|[^\p{L}\p{N}])") | q.contains("compare ") | (~in_name & (q.contains(" vs ") | q.contains(" vs. ")))
    return F.when(~idiom & cue, "comparison")


def _canonical(raw: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.trim(raw), r"[?.,;:]+$", "")), "^(?:the|an|a) ", "")
    bare = F.trim(bare)
    return F.when(F.octet_length(bare).between(2, 60), bare)


def comparators(query: Column) -> Column:
    """The two things compared, as an array; null if there aren't two different ones."""
    raw = F.array(*[F.struct(F.regexp_extract(query, p, 1).alias("a"), F.regexp_extract(query, p, 2).alias("b")) for p in COMPARISONS])
    pairs = F.transform(raw, lambda p: F.transform(F.array(p["a"], p["b"]), _canonical))
    return F.get(F.filter(pairs, lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull() & (F.get(p, F.lit(0)) != F.get(p, F.lit(1)))), F.lit(0))


def similarities(queries: DataFrame, protos: DataFrame) -> DataFrame:
    """(query_id, intent, proto_id, similarity) of ``queries(query_id, vector)`` with ``protos(proto_id, intent, proto)``, a fixed few."""
    few = protos.select(F.collect_list(F.struct("proto_id", "intent", "proto")).alias("p")).first().p
    listed = F.array(*[F.struct(F.lit(r.proto_id).alias("proto_id"), F.lit(r.intent).alias("intent"), F.array(*[F.lit(float(x)) for x in r.proto]).alias("proto")) for r in few])
    wide = queries.select("query_id", "vector", F.explode(listed).alias("p"))
    return wide.select("query_id", "p.intent", "p.proto_id", cosine_similarity(F.col("vector"), F.col("p.proto")).alias("similarity"))


def _place(intent: Column) -> Column:
    return F.array_position(F.array(*[F.lit(i) for i in INTENTS]), intent)


def knn_vote(sims: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, intent, weight): similarity that the k nearest prototypes give each intent, 0 for the rest."""
    near = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), _place(F.col("intent")), "proto_id")
    top = sims.withColumn("n", F.row_number().over(near)).withColumn("w", F.when(F.col("n") <= k, F.col("similarity")).otherwise(0.0))
    seen = top.groupBy("query_id", "intent").agg(F.sum("w").alias("weight"))
    every = sims.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(i) for i in INTENTS])).alias("intent"))
    return every.join(seen, ["query_id", "intent"], "left").select("query_id", "intent", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def max_similarity(sims: DataFrame) -> DataFrame:
    return sims.groupBy("query_id", "intent").agg(F.max("similarity").alias("weight"))


def margins(weights: DataFrame) -> DataFrame:
    """(query_id, intent, confidence, margin): the first intent and its lead over the second."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 9)), _place(F.col("intent")))
    ranked = weights.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("weight").over(w))
    return ranked.where("n = 1").select("query_id", "intent", F.col("weight").alias("confidence"), (F.col("weight") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def classify(sims: DataFrame, k: int | None = 3, threshold: float = 0.3, margin: float = 0.0) -> DataFrame:
    """(query_id, intent, confidence, margin): below either bound the default intent."""
    best = margins(max_similarity(sims) if k is None else knn_vote(sims, k))
    sure = (F.col("confidence") >= threshold) & (F.col("margin") >= margin)
    return best.select("query_id", F.when(sure, F.col("intent")).otherwise(DEFAULT_INTENT).alias("intent"), "confidence", "margin")
