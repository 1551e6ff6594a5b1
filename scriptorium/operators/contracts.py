"""Contracts of records as boolean columns: what a row must be, and which rule a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------ fixed values: known types
ELEMENT_TYPES = ["matn", "sanad", "heading", "footnote", "hashiya", "takhrij", "hadith_number", "page_number", "running_head", "picture", "unknown"]
RELIABILITIES = ["trusted", "good", "unknown", "weak", "disputed"]
VERDICTS = ["answerable", "partial", "insufficient", "needs_review"]
# ------------------------------------------------------------------


def present(c: Column) -> Column:
    return F.coalesce(F.btrim(c.cast("string")) != "", F.lit(False))


def at_least(c: Column, least) -> Column:
    """Null passes: the field is optional."""
    return F.coalesce(c >= least, F.lit(True))


def share(c: Column) -> Column:
    """A number from 0 to 1, or null; NaN is none."""
    return F.coalesce(c.between(0, 1) & ~F.isnan(c.cast("double")), c.isNull())


def ordered(earlier: Column, later: Column) -> Column:
    return F.coalesce(earlier <= later, F.lit(True))


CONTRACTS = {
    "books": {"title": lambda: present(F.col("title")), "volumes": lambda: at_least(F.col("volumes"), 1), "language": lambda: F.col("language").isNull() | present(F.col("language"))},
    "page_elements": {
        "page": lambda: F.col("page_id").isNotNull(), "order": lambda: at_least(F.col("element_order"), 0), "page_number": lambda: at_least(F.col("page_number"), 1), "volume_number": lambda: at_least(F.col("volume_number"), 1),
        "type": lambda: F.coalesce(F.col("element_type").isin(ELEMENT_TYPES), F.lit(False)), "ocr_confidence": lambda: share(F.col("ocr_confidence")), "layout_confidence": lambda: share(F.col("layout_confidence")),
        "text": lambda: F.col("text_raw").isNotNull() | (F.col("text_display").isNull() & F.col("text_normalized").isNull()), "times": lambda: ordered(F.col("created_at"), F.col("updated_at")),
    },
    "narrators": {"name": lambda: present(F.col("canonical_name")), "generation": lambda: at_least(F.col("generation"), 1), "death_year": lambda: at_least(F.col("death_year"), 1)},
    "rerank_results": {"ranks": lambda: at_least(F.col("original_rank"), 0) & at_least(F.col("new_rank"), 0), "moved": lambda: F.coalesce(F.col("moved") == F.col("original_rank") - F.col("new_rank"), F.lit(True))},
}


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, rows): how many rows break each rule; one pass, one aggregate, a row for every rule."""
    row = df.agg(*[F.coalesce(F.sum((~rule()).cast("int")), F.lit(0)).cast("long").alias(name) for name, rule in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("r")).select("r.*")


def valid(df: DataFrame, rules: dict) -> DataFrame:
    """``df`` with broken, the rules each row breaks, in order; an empty list is a valid row."""
    return df.withColumn("broken", F.filter(F.array(*[F.when(~rule(), F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull()))


def valid_answer(answered: Column, sources: Column, reason: Column) -> Column:
    """An answer has sources; a refusal says why."""
    return F.when(F.coalesce(answered, F.lit(False)), F.coalesce(F.size(sources), F.lit(0)) > 0).otherwise(present(reason))
