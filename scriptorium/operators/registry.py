"""What the engine can do and how far: its parts by name, state and layer, and a gate in front of parts that are not ready."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ fixed values: (part, state, layer, module, what it waits for)
READY, PARTIAL, CONTRACT, NEEDS_DATA, NOT_STARTED = "ready", "partial", "contract", "needs_data", "not_started"
ENGINES = [
    ("normalizer", READY, 2, "functions.canonical", ""), ("diacritics", READY, 6, "functions.arabic", ""), ("ocr_corrector", READY, 3, "operators.repair", ""), ("layout", READY, 25, "operators.structure", ""),
    ("hadith_splitter", READY, 14, "operators.structure", ""), ("intent", READY, 54, "operators.reasoning", ""), ("fts", READY, 19, "operators.retrieval", ""),
    ("fuzzy", PARTIAL, 36, "operators.retrieval", "similarity of extents"), ("ranking", READY, 51, "operators.ranking", ""), ("entity_filter", READY, 8, "operators.entities", ""), ("contracts", READY, 0, "operators.contracts", ""),
    ("semantic", PARTIAL, 18, "operators.retrieval", "a sentence model"), ("entity_extraction", READY, 8, "operators.entities", ""), ("narrator_resolver", READY, 15, "operators.reasoning", ""), ("ontology", READY, 50, "operators.graph", ""),
    ("evidence_bundle", READY, 23, "operators.reasoning", ""), ("golden_eval", NEEDS_DATA, 58, "operators.learning", "judged questions"), ("pdf_import", NOT_STARTED, 1, "", "a PDF reader"),
]
# ------------------------------------------------------------------


class NotReady(RuntimeError):
    """A part was asked for that is not ready."""


def engines(spark: SparkSession) -> DataFrame:
    """(part, state, layer, module, waits_for) of every part."""
    return spark.createDataFrame(ENGINES, "part string, state string, layer int, module string, waits_for string")


def status(spark: SparkSession) -> DataFrame:
    """(state, parts, waiting) of each state."""
    return engines(spark).groupBy("state").agg(F.count("*").alias("parts"), F.sum((F.col("waits_for") != "").cast("int")).alias("waiting"))


def require(part: str, partial: bool = True) -> str:
    """The module of a part that is ready, or, unless refused, partly ready; raises for any other and for unknown ones."""
    state, module, waits = next(((s, m, w) for p, s, _, m, w in ENGINES if p == part), (NOT_STARTED, "", "unknown part"))
    if state != READY and not (partial and state == PARTIAL):
        raise NotReady(f"{part}: {state}, waits for {waits}")
    return module
