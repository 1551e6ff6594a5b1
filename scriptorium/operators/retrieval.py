"""Retrieval over page elements: full text from positional postings, trigram similarity, vectors; for query batches."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.runtime import cut, shuffle_partitions


def postings(elements: DataFrame, id: str, form: str) -> DataFrame:
    """(term, id, tf, positions): the inverted index of a folded text. A term is a run of letters and digits; its
    positions in one record, of which there are no more than the record has words, are gathered beside the record."""
    terms = F.filter(F.split(F.lower(form), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return (
        elements.select(id, F.posexplode(terms).alias("position", "term"))
        .groupBy("term", id)
        .agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    )


def query_terms(queries: DataFrame, id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, terms): the distinct terms of each query and their number."""
    t = F.array_distinct(F.filter(F.split(F.lower(arabic.search_form(F.col(text))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    return queries.select(id, F.explode(t).alias("term"), F.size(t).alias("terms"))


def cover_density(entries: Column, terms: Column) -> Column:
    """The cover density of a record, from its query words in order (array of struct(pos, term)) and how many terms there
    are: the sum over the covers, the shortest stretches that hold all terms, of a tenth, divided by one and the number
    of other words in the stretch.

    A word ends a cover if the earliest of the terms' last places up to it lies behind that of the cover before."""
    kind = "array<struct<pos:int,term:string,at:int>>"
    start = F.struct(F.array().cast(kind).alias("last"), F.lit(-1).alias("best"), F.lit(0).alias("at"), F.lit(0.0).cast("double").alias("score"))

    def step(acc, e):
        mine = F.struct(e["pos"].cast("int").alias("pos"), e["term"].alias("term"), acc["at"].alias("at"))
        last = F.array_append(F.filter(acc["last"], lambda x: x["term"] != e["term"]), mine)
        low = F.array_min(last)
        found = (F.size(last) == terms) & (low["pos"] > acc["best"])
        other = (e["pos"] - low["pos"]) - (acc["at"] - low["at"])
        return F.struct(last.alias("last"), F.when(found, low["pos"]).otherwise(acc["best"]).alias("best"), (acc["at"] + 1).alias("at"), (acc["score"] + F.when(found, 0.1 / (1 + other)).otherwise(0.0)).alias("score"))

    return F.aggregate(entries, start, step)["score"]


def full_text(index: DataFrame, queries: DataFrame, id: str = "element_id", k: int = 20) -> DataFrame:
    """(query_id, id, score, mode, place): the best ``k`` records of each query.

    All terms must occur; a query of several terms that no record holds all of is relaxed to any term. Records that hold
    all of several terms score their cover density; otherwise every occurrence is a cover of its own and scores 0.1.
    Equal scores by id, which may be a struct of what records are ordered by. A record's query words, of which there
    are no more than it has words, are gathered beside it.
    """
    hits = index.join(queries.select("query_id", F.col("term").alias("t"), "terms"), F.col("term") == F.col("t"))
    placed = F.when(F.col("terms") > 1, F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term"))))
    per = hits.groupBy("query_id", id, "terms").agg(F.count("*").alias("held"), F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list(placed))).alias("entries"))
    complete = per.filter("held = terms").select(F.col("query_id").alias("cq")).distinct()
    told = per.join(complete, F.col("query_id") == F.col("cq"), "left")
    kept = told.filter((F.col("held") == F.col("terms")) | F.col("cq").isNull())
    score = F.when((F.col("terms") > 1) & (F.col("held") == F.col("terms")), cover_density(F.col("entries"), F.col("terms"))).otherwise(0.1 * F.col("tf"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return (
        kept.select("query_id", id, F.round(score, 6).alias("score"), F.when(F.col("held") == F.col("terms"), "and").otherwise("or").alias("mode"))
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= k)
    )


def trigram_index(elements: DataFrame, id: str, text: str) -> DataFrame:
    """(gram, id, grams): distinct padded trigrams of each record and how many it has."""
    g = arabic.trigrams(F.col(text))
    return elements.select(id, g.alias("g")).select(id, F.size("g").alias("grams"), F.explode("g").alias("gram"))


def fuzzy(index: DataFrame, queries: DataFrame, id: str = "element_id", threshold: float = 0.18, k: int = 20, text: str = "query") -> DataFrame:
    """(query_id, id, similarity, place): trigram similarity of whole texts, shared over all distinct trigrams.

    A record whose number of trigrams rules the threshold out is dropped before the counting. Equal ones by id."""
    q = queries.select("query_id", arabic.trigrams(F.col(text)).alias("g")).select("query_id", F.size("g").alias("asked"), F.explode("g").alias("qg"))
    met = index.join(q, F.col("gram") == F.col("qg")).filter((F.col("grams") * threshold <= F.col("asked")) & (F.col("asked") * threshold <= F.col("grams")))
    shared = met.groupBy("query_id", id, "grams", "asked").agg(F.count("*").alias("shared"))
    sim = F.col("shared") / (F.col("grams") + F.col("asked") - F.col("shared"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id)
    return (
        shared.select("query_id", id, sim.alias("s")).filter(F.col("s") >= threshold).select("query_id", id, F.round("s", 6).alias("similarity"))
        .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    )


def word_similarity(index: DataFrame, queries: DataFrame, id: str = "element_id", text: str = "query") -> DataFrame:
    """(query_id, id, share): the share of a query's trigrams a record has, which bounds the similarity of the best
    run of whole words from above; an approximation of extent similarity, stated as one."""
    q = queries.select("query_id", arabic.trigrams(F.col(text)).alias("g")).select("query_id", F.size("g").alias("asked"), F.explode("g").alias("qg"))
    return index.join(q, F.col("gram") == F.col("qg")).groupBy("query_id", id, "asked").agg((F.count("*") / F.max("asked")).alias("share")).select("query_id", id, F.round("share", 6).alias("share"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, id: str, k: int = 10, block: int = 512) -> DataFrame:
    """(query_id, id, similarity, place): the ``k`` nearest by cosine of each query vector, exact, similarity above 0.

    A stated query set against all rows: the queries (query_id, vector) are cut into blocks of about ``block``, the
    rows into salted parts, and every block meets every part in an equi-join, so no side is broadcast and no task holds
    more than a part and a block."""
    blocks, parts = max(1, -(-queries.count() // block)), shuffle_partitions(vectors.sparkSession)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id)
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qp"))
    v = vectors.select(id, "embedding", F.pmod(F.xxhash64(id), F.lit(parts)).cast("int").alias("vp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"))
    met = v.join(q, (F.col("vb") == F.col("qb")) & (F.col("vp") == F.col("qp")))
    scored = met.select("query_id", id, F.round(arabic.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))
    return scored.filter("similarity > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


#: The vector index: cells, rows its centres are fitted on, rounds of fitting, and the cells a query asks by default.
CELLS, FIT_ROWS, ROUNDS, ASKED_CELLS = 64, 20_000, 8, 40


def fitted_centres(vectors: DataFrame, id: str, cells: int = CELLS, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the index's cells: spherical k-means over the first ``rows`` vectors by a hash of the id, a bounded
    sample; the rows themselves are all indexed."""
    sample = [r[0] for r in vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(id), id).limit(rows).select("embedding").collect()]
    if not sample:
        return np.zeros((0, 0))
    # Vectors of another size than most are in no cell.
    size = Counter(len(v) for v in sample).most_common(1)[0][0]
    x = np.array([v for v in sample if len(v) == size], np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            mine = x[near == c]
            if len(mine):
                centres[c] = mine.sum(0) / max(np.linalg.norm(mine.sum(0)), 1e-12)
    return centres


def _cells(vectors: DataFrame, id: str, vector: str, centres: np.ndarray, most: int) -> DataFrame:
    """(id, unit, cell): every vector at length 1 once for each of its ``most`` nearest cells, in Arrow batches; vectors
    without length or of another size are in none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # CELLS rows

    def place(batches):
        c = shared.value
        for pdf in batches:
            keep = [v is not None and len(v) == c.shape[1] for v in pdf[vector]] if len(c) else [False] * len(pdf)
            pdf = pdf[keep]
            x = np.array(list(pdf[vector]), np.float64).reshape(len(pdf), -1)
            size = np.linalg.norm(x, axis=1) if len(pdf) else np.zeros(0)
            pdf, x = pdf[size > 0], x[size > 0] / size[size > 0, None]
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most] if len(pdf) else np.zeros((0, 0), int)
            yield pd.DataFrame({id: pdf[id].to_numpy(), "unit": list(x), "cells": list(near)})

    kind = vectors.schema[id].dataType.simpleString()
    return vectors.select(id, vector).mapInPandas(place, f"{id} {kind}, unit array<double>, cells array<int>").select(id, "unit", F.explode("cells").alias("cell"))


def indexed_vectors(vectors: DataFrame, id: str, centres: np.ndarray) -> DataFrame:
    """(id, unit, cell): the index, every vector in its nearest cell; write it partitioned by cell to keep it."""
    return _cells(vectors, id, "embedding", centres, 1)


def nearest_in_cells(index: DataFrame, queries: DataFrame, id: str, centres: np.ndarray, k: int = 10, asked: int = ASKED_CELLS, block: int = 2048) -> DataFrame:
    """(query_id, id, similarity, place): the ``k`` nearest of each query vector (query_id, vector) among the vectors of
    the ``asked`` cells nearest to it. Approximate: what lies beyond those cells is missed, and with all cells asked
    nothing is. Recall is measured against the exact search in the tests.

    A cell's rows and its queries are both cut into blocks of about ``block`` by a hash of the id, and every block of the
    one meets every block of the other, so a cell with a third of all rows is many tasks and no task holds more than two
    blocks; similarities are matrix products in Arrow batches."""
    asking = cut(_cells(queries, "query_id", "vector", centres, asked))
    blocks = lambda df, name: df.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(index, "rb").join(blocks(asking, "qb").withColumnRenamed("c", "c2"), F.col("c") == F.col("c2")).drop("c2")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    mine = lambda key, n, name: F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(name)
    rows = index.join(sizes, F.col("cell") == F.col("c")).select("cell", mine(id, "rb", "part"), every("qb", "turn"), F.lit(False).alias("ask"), F.col(id).alias("i"), "unit")
    q = asking.join(sizes, F.col("cell") == F.col("c")).select("cell", every("rb", "part"), mine("query_id", "qb", "turn"), F.lit(True).alias("ask"), F.col("query_id").alias("i"), "unit")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "i": [], "similarity": []})
        s = np.round(np.array(list(a["unit"])) @ np.array(list(b["unit"])).T, 6)
        ids = b["i"].to_numpy()
        out = []
        for n, row in zip(a["i"], s):
            top = np.lexsort((ids, -row))[:k]
            top = top[row[top] > 0]
            out.append(pd.DataFrame({"query_id": n, "i": ids[top], "similarity": row[top]}))
        return pd.concat(out)

    met = rows.unionByName(q).groupBy("cell", "part", "turn").applyInPandas(meet, "query_id long, i long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "i")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", F.col("i").alias(id), "similarity", "place")
