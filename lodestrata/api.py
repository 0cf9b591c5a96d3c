"""One object for the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import evaluation, graph
from lodestrata.operators import reconcile as rec
from lodestrata.plans.retrieve import EngineConfig, Retrieved, retrieve
from lodestrata.sources import bundle, workspace
from lodestrata.functions.text import searchable_text
from lodestrata.sources.store import ChunkStore, ingest_incremental
from lodestrata.sources.tables import Tables


class RetrievalEngine:
    """Search, graph and maintenance over a folder of chunk tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder)

    def retrieve(self, questions: DataFrame, config: EngineConfig | None = None, **seams) -> Retrieved:
        """Answers of ``questions(query_id, query)``; see :func:`lodestrata.plans.retrieve.retrieve` for the seams."""
        return retrieve(self.tables, questions, config, **seams)

    def search(self, questions: DataFrame, config: EngineConfig | None = None, **seams) -> DataFrame:
        """Ranked chunks of all types for each question."""
        return self.retrieve(questions, config, **seams).flat()

    def context(self, questions: DataFrame, config: EngineConfig | None = None, **seams) -> DataFrame:
        """What a language model is given for each question."""
        return self.retrieve(questions, config, **seams).context()

    def graph(self, identifier: str, direction: str = "both", depth: int = 1) -> DataFrame:
        """Chunks around the only chunk with that identifier; none if it isn't unique."""
        unique = graph.unique_identifiers(self.tables.code("identifier")).where(F.col("identifier") == identifier.lower())
        starts = unique.select(F.col("chunk_id").alias("node"))
        if depth <= 1:
            return graph.neighbours(self.tables.edges(), starts, direction).select(F.col("neighbour").alias("node"), F.lit(1).alias("depth"))
        return graph.bfs(self.tables.edges(), starts, direction, depth)

    def neighbors(self, chunk_id: str, before: int = 20, after: int = 20) -> DataFrame:
        """Chunks of the same file that begin within so many lines of a chunk."""
        code = self.tables.code("file_path", "start_line", "identifier")
        at = code.where(F.col("chunk_id") == chunk_id).select("file_path", F.col("start_line").alias("line"))
        near = code.join(at, "file_path").where((F.col("start_line") >= F.col("line") - before) & (F.col("start_line") <= F.col("line") + after))
        return near.drop("line")

    def source_lines(self, root: str, file_path: str, line: int, before: int = 20, after: int = 20) -> DataFrame:
        """(line, text) of a workspace file around a line, at most 500 either way."""
        before, after = (min(max(n, 0), 500) for n in (before, after))
        whole = self.spark.read.text(f"{root.rstrip('/')}/{file_path}", wholetext=True)
        lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "text")).select((F.col("at") + 1).alias("line"), "text")
        return lines.where(F.col("line").between(line - before, line + after)).orderBy("line")

    def list_projects(self) -> DataFrame:
        return self.tables.raw("code_chunks").select("project_name").distinct().orderBy("project_name")

    def overview(self) -> DataFrame:
        """Chunks, files and languages of each project."""
        return self.tables.code("project_name", "file_path", "language").groupBy("project_name").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))

    def reindex(self, root: str, store: ChunkStore | None = None) -> DataFrame:
        """The code table after an incremental run over a workspace; with a store it is that store's table, and written."""
        if store is not None:
            ingest_incremental(store, {"code_chunks": workspace.code_chunks(workspace.walk(self.spark, root)).withColumn("searchable_text", searchable_text(F.col("identifier"), F.col("signature"), F.col("docstring")))})
            return store.read("code_chunks")
        fresh = workspace.code_chunks(workspace.walk(self.spark, root))
        columns = [c for c in fresh.columns if c in self.tables.raw("code_chunks").columns]
        return rec.incremental(self.tables.code(*columns).select(*columns), fresh.select(*columns))

    def export(self, folder: str) -> None:
        bundle.write_bundle(self.tables, folder)

    def evaluate(self, cases: DataFrame, retrieved: DataFrame) -> DataFrame:
        return evaluation.case_metrics(cases, retrieved)
