"""Knowledge graph and concept expansion over edge tables (source, target, type, weight, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edges of the same ends and type as one: weights added, the greatest confidence, evidence counted."""
    return edges.groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))


def statistics(edges: DataFrame) -> DataFrame:
    """(type, edges, sources, targets) of each type."""
    return edges.groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, direction, type) of the given nodes (column node)."""
    n = nodes.select(F.col("node").alias("__n")).distinct()
    out = edges.join(n, F.col("source") == F.col("__n"), "left_semi").select(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit("out").alias("direction"), "type")
    into = edges.join(n, F.col("target") == F.col("__n"), "left_semi").select(F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit("in").alias("direction"), "type")
    return out.unionByName(into)


def common_neighbours(edges: DataFrame, a, b) -> DataFrame:
    """(node): what both a and b point to or are pointed at by."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.filter(F.col("source") == a).select(F.col("target").alias("node")).intersect(both.filter(F.col("source") == b).select("target"))


def paths(edges: DataFrame, starts: DataFrame, hops: int = 4, k: int = 10) -> DataFrame:
    """(start, target, hops, confidence, path): simple paths of up to ``hops`` edges to each wanted target.

    ``starts`` has (start, target). Confidence is the product of the edges'; the ``k`` best of each pair by hops,
    confidence, path. Each hop is one equi-join of the open paths with the edges; finished paths are not carried on."""
    e = merged_edges(edges).groupBy("source", "target").agg(F.max("confidence").alias("c")).select(F.col("source").alias("s"), F.col("target").alias("t"), "c")
    open_ = starts.distinct().select("start", "target", F.col("start").alias("at"), F.array(F.col("start")).alias("path"), F.lit(1.0).alias("confidence"))
    done = None
    for h in range(1, hops + 1):
        step = open_.join(e, F.col("at") == F.col("s")).filter(~F.array_contains("path", F.col("t"))).select(
            "start", "target", F.col("t").alias("at"), F.array_append("path", F.col("t")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence")
        )
        here = step.filter("at = target").select("start", "target", F.lit(h).alias("hops"), "confidence", "path")
        done = here if done is None else done.unionByName(here)
        open_ = step.filter("at <> target")
    rank = F.row_number().over(Window.partitionBy("start", "target").orderBy("hops", F.desc("confidence"), F.array_join("path", ">")))
    return done.withColumn("rank", rank).filter(F.col("rank") <= k).select("start", "target", "hops", F.round("confidence", 6).alias("confidence"), F.array_join("path", ">").alias("path"))


def subgraph(edges: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """(source, target, type) of the edges within ``depth`` steps, in either direction, of the nodes."""
    reach = nodes.select("node").distinct()
    e = edges.select("source", "target", "type").distinct()
    for _ in range(depth - 1):
        out = e.join(reach, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("node"))
        into = e.join(reach, F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("node"))
        reach = reach.unionByName(out).unionByName(into).distinct()
    a = e.join(reach, F.col("source") == F.col("node"), "left_semi")
    b = e.join(reach, F.col("target") == F.col("node"), "left_semi")
    return a.unionByName(b).distinct()


def expanded_terms(concepts: DataFrame, ids: DataFrame, levels: int = 5, most: int = 40) -> DataFrame:
    """(asked, term, source): labels and synonyms of each asked concept and its descendants to ``levels``, without the
    labels of what it excludes; the first ``most`` by level and term. concepts: (id, label, parent, synonyms, excludes)."""
    reach = ids.select(F.col("id").alias("asked"), F.col("id").alias("at"), F.lit(0).alias("level")).distinct()
    all_ = reach
    up = concepts.select(F.col("id").alias("cid"), "parent").filter("parent is not null and parent <> cid")
    for level in range(1, levels + 1):
        reach = reach.join(up, F.col("at") == F.col("parent")).select("asked", F.col("cid").alias("at"), F.lit(level).alias("level"))
        all_ = all_.unionByName(reach)
    nearest = all_.groupBy("asked", "at").agg(F.min("level").alias("level"))
    terms = concepts.select(F.col("id").alias("cid"), F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias("term"))
    found = nearest.join(terms, F.col("at") == F.col("cid")).filter("term is not null").groupBy("asked", "term").agg(F.min("level").alias("level"))
    bad = ids.join(concepts.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid")).select(F.col("id").alias("asked"), F.explode("excludes").alias("x"))
    bad = bad.join(concepts.select(F.col("id").alias("cid"), F.col("label").alias("term")), F.col("x") == F.col("cid")).select("asked", "term")
    kept = found.join(bad.distinct(), ["asked", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("asked").orderBy("level", "term"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).select("asked", "term", "level")


def concepts_in_texts(concepts: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, id): concepts whose label or a synonym, as whole words, a text (text_id, text) holds.

    Terms of m words meet the m-word sequences of the texts in an equi-join, not every text every term; sequences are
    made for every length that occurs among the terms."""
    synonyms = F.coalesce("synonyms", F.array().cast("array<string>")) if "synonyms" in concepts.columns else F.array().cast("array<string>")
    terms = F.explode(F.concat(F.array("label"), synonyms))
    labels = concepts.select("id", terms.alias("term")).select("id", arabic.match_key(F.col("term")).alias("key")).filter("key <> ''").distinct()
    lengths = sorted(r[0] for r in labels.select(F.size(F.split("key", " ")).alias("m")).distinct().collect())
    split = texts.select("text_id", F.explode(F.array(F.split(arabic.match_key(F.col("text")), " "))).alias("words"))
    words = F.col("words")
    def grams(n):
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    found = split.select("text_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams(m) for m in lengths]))).alias("g"))
    return found.join(labels, F.col("g") == F.col("key")).select("text_id", "id").distinct()


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(id, type, label): nodes of the same id as one; of several types and labels the least type and greatest label."""
    return nodes.filter("id is not null").groupBy("id").agg(F.min("type").alias("type"), F.max("label").alias("label"))


def term_index(concepts: DataFrame) -> DataFrame:
    """(key, concepts, id): every label and synonym as matched, with how many concepts it stands for and the least of
    them. concepts: (id, label, synonyms)."""
    terms = concepts.select("id", F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term"))
    keyed = terms.select("id", arabic.match_key(F.col("term")).alias("key")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.count_distinct("id").alias("concepts"), F.min("id").alias("id")).select("key", "concepts")


def derived_children(concepts: DataFrame) -> DataFrame:
    """(id, children): each concept's children as the other concepts' parents say, sorted; empty where none."""
    below = concepts.filter("parent is not null and parent <> id").groupBy(F.col("parent").alias("p")).agg(F.array_sort(F.collect_set("id")).alias("children"))
    return concepts.select("id").join(below, F.col("id") == F.col("p"), "left").select("id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
