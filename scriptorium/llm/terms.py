"""Frequency of every distinct term, and marks for those too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = "[\\u064B-\\u065F\\u0670\\u0640\\u200B-\\u200F\\u2060\\uFEFF]"


def term_of(c: Column) -> Column:
    """A label as a term: no vowel marks, tatweel or invisible characters, runs of white space one blank, none outside."""
    bare = F.regexp_replace(c, MARKS, "")
    return F.btrim(F.regexp_replace(bare, "[\\s\\u0085\\p{Z}]+", " "))


def term_counts(df: DataFrame, record: str = "element_id", label: str = "label", n: str = "frequency", key: str = "candidate_id") -> DataFrame:
    """(term, frequency, document_frequency): occurrences and distinct records of each term over the whole table.

    Rows delivered twice (same key) count once; null and empty terms do not count; a null or negative number of
    occurrences counts as none, and the record still as one. A row without record has no record to count and adds its
    occurrences only. Counts are combined by hash before each shuffle, so a term with a third of all rows arrives as
    one partial count per task.
    """
    # The key alone decides which rows are one: a copy may be compared by nothing else.
    rows = df.select(F.col(key).alias("k"), F.col(record).alias("r"), term_of(F.col(label)).alias("term"), F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    once = (
        rows.filter("term <> ''")
        .groupBy("k", "r", "term")
        .agg(F.max("n").alias("n"), F.when(F.col("k").isNull(), F.sum("n")).alias("all"))
        .select("r", "term", F.coalesce("all", "n").alias("n"))
    )
    per_record = once.groupBy("term", "r").agg(F.sum("n").alias("n"))
    return per_record.groupBy("term").agg(F.sum("n").alias("frequency"), F.count("r").alias("document_frequency"))


def marked_terms(df: DataFrame, common_share: float = 0.05, rare_records: int = 3, rare_frequency: int = 5, record: str = "element_id", label: str = "label", **names: str) -> DataFrame:
    """(term, mark) of the terms that are ``common`` (in more than ``common_share`` of the records with any term) or
    else ``rare`` (in fewer than ``rare_records`` records or occurring less than ``rare_frequency`` times)."""
    counts = term_counts(df, record, label, **names)
    total = df.filter(term_of(F.col(label)) != "").agg(F.count_distinct(record).alias("n")).scalar()
    return (
        counts.withColumn("total", total)
        .select(
            "term",
            F.when(F.col("document_frequency") > common_share * F.col("total"), "common")
            .when((F.col("document_frequency") < rare_records) | (F.col("frequency") < rare_frequency), "rare")
            .alias("mark"),
        )
        .filter("mark is not null")
    )
