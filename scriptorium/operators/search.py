"""The search engine and the way from a question to an answer, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.operators import answers, ranking, reasoning, retrieval


def search(elements: DataFrame, queries: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(query_id, element_id, place, score, reranked, deferred, ocr_quality, book_id, volume_number, page_number, text):
    ranked hits of each query (query_id, query), the page from ``offset`` on.

    ``elements`` are current elements with element_id, page_id, book_id, volume_number, page_number, element_type,
    text_raw and text_normalized. Full text and trigram hits are fused by rank, scored by graded signals and bonuses,
    reranked, and spread over pages; all steps are joins and windows by query over each engine's top rows. A null or
    empty query has no hit.
    """
    asked = queries.select("query_id", "query").filter(F.length(F.btrim(F.coalesce("query", F.lit("")))) > 0)
    held = elements.filter("text_normalized is not null")
    most = max(20, (offset + limit) * 2)
    full = retrieval.full_text(retrieval.postings(held, "element_id", "text_normalized"), retrieval.query_terms(asked), k=most)
    near = retrieval.fuzzy(retrieval.trigram_index(held, "element_id", "text_normalized"), asked.withColumn("query", arabic.search_form(F.col("query"))), k=most)
    hits = [h.select("query_id", F.lit(s).alias("source"), F.col("place").alias("arrival"), "element_id") for s, h in (("fts", full), ("fuzzy", near))]
    fused = ranking.fuse(hits[0].unionByName(hits[1]))
    texts = held.select(F.col("element_id").alias("e"), "page_id", "book_id", "volume_number", "page_number", "element_type", "text_raw", "text_normalized")
    q = asked.select(F.col("query_id").alias("q"), "query")
    rows = fused.join(texts, F.col("element_id") == F.col("e")).join(q, F.col("query_id") == F.col("q")).drop("e", "q")
    found = ranking.ranked(rows, F.col("query"), offset + limit).filter(F.col("final_place") > offset)
    return found.select("query_id", "element_id", F.col("final_place").alias("place"), "score", "reranked", "deferred", "ocr_quality", "book_id", "volume_number", "page_number", F.col("text_raw").alias("text"))


def answered(elements: DataFrame, books: DataFrame, queries: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    """Every stage from question to answer, by name: intents, hits, evidence, verdicts, checks, answers.

    Each is a plan over the one before; what is not read is not computed. books: (book_id, title)."""
    intents = queries.select("query_id", "query", reasoning.intent(F.col("query")).alias("i")).select("query_id", "query", F.col("i.label").alias("intent"), F.col("i.confidence").alias("intent_confidence"))
    hits = search(elements, queries, limit)
    b = books.select(F.col("book_id").alias("b"), "title")
    bundle = reasoning.evidence(hits.withColumn("score", F.col("reranked")).join(b, F.col("book_id") == F.col("b"), "left").drop("b"))
    confidences = intents.select("query_id", "intent_confidence")
    verdicts = reasoning.verdicts(bundle, confidences)
    told = answers.checks(verdicts, confidences)
    return {"intents": intents, "hits": hits, "evidence": bundle, "verdicts": verdicts, "checks": told, "answers": answers.composed(verdicts, told)}
