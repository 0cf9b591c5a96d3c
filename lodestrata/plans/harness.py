"""The evaluation harness: all cases of a dataset as one batch, their metrics, and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import evaluation
from lodestrata.plans.retrieve import EngineConfig, retrieve
from lodestrata.runtime import cut_lineage
from lodestrata.sources.tables import Tables

KINDS = {"file": "expected_files", "identifier": "expected_identifiers", "chunk_type": "expected_chunk_types", "project": "expected_projects", "excluded": "excluded_files"}
MEANS = ["recall_5", "recall_10", "recall_pool", "mrr"]


def expectations(cases: DataFrame) -> DataFrame:
    """(case_id, kind, expected) of a dataset's cases."""
    each = F.concat(*[_of(k, c) for k, c in KINDS.items()])
    return cases.select(F.col("id").alias("case_id"), F.explode(each).alias("w")).select("case_id", "w.*")


def _of(kind: str, column: str):
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("expected")))


@dataclass
class Run:
    """retrieved: (case_id, rank, chunk_type, file_path, identifier, project, relevance). metrics: a row for each case. classified: (case_id, intent)."""

    cases: DataFrame
    retrieved: DataFrame
    metrics: DataFrame
    classified: DataFrame

    def summary(self) -> dict:
        """Means over all cases and by expected intent, and the share of intents that were recognised."""
        wide = self.metrics.join(self.cases.select(F.col("id").alias("case_id"), "expected_intent"), "case_id").join(self.classified, "case_id", "left")
        right = F.avg((F.col("intent") == F.col("expected_intent")).cast("double")).alias("intent_accuracy")
        means = [F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in MEANS], right]
        by = wide.groupBy("expected_intent").agg(*means).orderBy("expected_intent").collect()  # a handful of intents
        lost = [r.expected for r in evaluation.never_found(expectations(self.cases), self.retrieved).orderBy("expected").limit(50).collect()]
        return {"overall": wide.agg(*means).first().asDict(), "by_intent": [r.asDict() for r in by], "never_found": lost}

    def as_json(self) -> str:
        return json.dumps(self.summary(), ensure_ascii=False, indent=2, sort_keys=True)

    def as_markdown(self) -> str:
        s = self.summary()
        show = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
        columns = ["cases", *MEANS, "intent_accuracy"]
        rows = [("all", s["overall"]), *((r["expected_intent"] or "none", r) for r in s["by_intent"])]
        lines = ["| intent | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1), *("| " + " | ".join([name, *(show(r[c]) for c in columns)]) + " |" for name, r in rows)]
        return "\n".join([*lines, "", "Never found: " + (", ".join(s["never_found"]) or "none")])


def run(t: Tables, cases: DataFrame, config: EngineConfig | None = None, ground_truth: bool = False, tags: list[str] | None = None) -> Run:
    """All ``cases`` (of :func:`lodestrata.sources.workspace.parsed_cases`), or those with one of the tags, asked at once.

    ground_truth: the expected intents are used instead of classified ones.
    """
    chosen = cases if tags is None else cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    asked = chosen.select(F.col("id").alias("query_id"), "query", *([F.col("expected_intent").alias("intent")] if ground_truth else []))
    found = retrieve(t, asked, config)
    rows = cut_lineage(found.flat().withColumnRenamed("query_id", "case_id"))
    return Run(chosen, rows, evaluation.case_metrics(expectations(chosen), rows), found.plan.select(F.col("query_id").alias("case_id"), "intent"))
