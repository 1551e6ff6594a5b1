"""Ingestion, quality and learning over page elements: lines, chunks, lexicon, phrases, contexts, entities, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic

BLANKS = "[\\s\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]+"

def current_elements(df: DataFrame, *columns: str) -> DataFrame:
    """(element_id, columns): one row per element, the latest version (a null time is the earliest; of versions of one
    time the one with the greater values, so the result doesn't depend on the rows' order).

    Only the columns named are read and shuffled, besides the key and the time; all, where none is named. Without any
    text among them the rows are fixed-width or short, and the aggregation is partial before the shuffle.
    """
    kept = [c for c in (columns or df.columns) if c != "element_id"]
    if not kept:
        return df.select("element_id").distinct()
    last = df.groupBy("element_id").agg(F.max(F.struct(F.coalesce("updated_at", F.to_timestamp(F.lit("0001-01-01"))).alias("__at"), *kept)).alias("r"))
    return last.select("element_id", *[F.col("r")[c].alias(c) for c in kept])


def lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line_order from 1, line, words, characters) of each line with anything on it."""
    return (
        df.select(id, F.posexplode(F.split(text, "\n")).alias("p", "line"))
        .filter(F.length(F.btrim("line")) > 0)
        .select(id, (F.col("p") + 1).alias("line_order"), "line", F.size(F.filter(F.split("line", BLANKS), lambda w: w != "")).alias("words"), F.length("line").alias("characters"))
    )


def chunks(df: DataFrame, id: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk_order, start, chunk): pieces of ``size`` characters that overlap; blank pieces are left out. A chunk's
    order counts from 0 within its text."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)))
    cut = df.select(id, F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.col(text).substr(s + 1, F.lit(size)).alias("chunk")))).alias("p", "c"))
    cut = cut.select(id, "p", "c.start", "c.chunk").filter(F.length(F.btrim("chunk")) > 0)
    return cut.withColumn("chunk_order", F.row_number().over(Window.partitionBy(id).orderBy("p")) - 1).select(id, "chunk_order", "start", "chunk")


def quality_class(text: Column, least_words: int = 3) -> Column:
    """blank, noise (no letters, or more than a quarter tatweel), short or clean."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    tatweel = F.length(t) - F.length(F.replace(t, F.lit("ـ"), F.lit("")))
    return (
        F.when(t == "", "blank")
        .when(~t.rlike("\\p{L}"), "noise")
        .when(F.size(F.filter(F.split(t, BLANKS), lambda w: w != "")) < least_words, "short")
        .when(tatweel > 0.25 * F.length(t), "noise")
        .otherwise("clean")
    )


def exact_duplicates(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, first_id) of rows whose text another row with a smaller id has: the least id by text hash, joined back."""
    keyed = df.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.sha1(F.col(text)).alias("h")).distinct()
    first = keyed.groupBy(F.col("h").alias("h2")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, F.col("h") == F.col("h2")).filter("id <> first_id").select("id", "first_id")


def token_statistics(words: DataFrame, record: str = "element_id") -> DataFrame:
    """(token, frequency, document_frequency) of (record, tokens array), combined per record before the shuffle."""
    per = words.select(record, F.explode("tokens").alias("token")).groupBy("token", record).agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("frequency"), F.count("*").alias("document_frequency"))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrase_statistics(words: DataFrame, least: int = 2, most: int = 5, record: str = "element_id") -> DataFrame:
    """(phrase, n, frequency, document_frequency) of all word sequences of ``least`` to ``most`` words."""
    def sized(n: int) -> Column:
        return F.transform(ngrams(F.col("tokens"), n), lambda g: F.struct(g.alias("phrase"), F.lit(n).alias("n")))

    grams = F.flatten(F.array(*[sized(n) for n in range(least, most + 1)]))
    per = words.select(record, F.explode(grams).alias("g")).groupBy("g.phrase", "g.n", record).agg(F.count("*").alias("k"))
    return per.groupBy("phrase", "n").agg(F.sum("k").alias("frequency"), F.count("*").alias("document_frequency"))


def context_statistics(words: DataFrame, radius: int = 2) -> DataFrame:
    """(token, side, neighbour, frequency) within ``radius`` words, made inside each record without a join."""
    t = F.col("tokens")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(t)),
            lambda i: F.concat(
                F.transform(F.slice(t, F.greatest(i - radius, F.lit(1)), F.least(i - 1, F.lit(radius))), lambda w: F.struct(F.element_at(t, i).alias("token"), F.lit("left").alias("side"), w.alias("neighbour"))),
                F.transform(F.slice(t, i + 1, F.lit(radius)), lambda w: F.struct(F.element_at(t, i).alias("token"), F.lit("right").alias("side"), w.alias("neighbour"))),
            ),
        )
    )
    return words.filter(F.size("tokens") > 0).select(F.explode(pairs).alias("p")).groupBy("p.token", "p.side", "p.neighbour").agg(F.count("*").alias("frequency"))


def neighbours(contexts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest neighbours of each token and side; ties by the neighbour."""
    w = Window.partitionBy("token", "side").orderBy(F.desc("frequency"), "neighbour")
    return contexts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def suggested_phrases(phrases: DataFrame, query: str, k: int = 10, floor: float = 0.2) -> DataFrame:
    """Phrases for a query: an exact one first, then those that hold it, then frequent ones."""
    score = (
        F.when(F.col("phrase") == query, 1.0).otherwise(0.0)
        + F.when(F.contains(F.col("phrase"), F.lit(query)), 0.75).otherwise(0.0)
        + F.log1p("frequency") / 8 + F.log1p("document_frequency") / 15
    )
    return phrases.withColumn("score", F.round(score, 6)).filter(F.col("score") >= floor).orderBy(F.desc("score"), F.desc("frequency"), "phrase").limit(k)


def phrase_match(texts: DataFrame, id: str, text: str, phrase: str) -> DataFrame:
    """(id, score, matched, total, coverage): how well each text matches a phrase: the mean over the phrase's words of
    the weight of the best matching word. The strengths of a text's words are computed where the text lies and their
    maxima taken before any shuffle; a text without words scores 0 on an empty word."""
    asked = phrase.split()
    words = texts.select(id, F.explode(F.array_distinct(F.split(arabic.collapse(F.col(text)), " "))).alias("w"))
    best = words.groupBy(id).agg(*[F.max(arabic.strength_weight(arabic.match_strength(F.lit(q), F.col("w")))).alias(f"b{i}") for i, q in enumerate(asked)])
    weights = [F.col(f"b{i}") for i in range(len(asked))]
    matched = sum(((w > 0).cast("bigint") for w in weights), F.lit(0).cast("bigint"))
    return best.select(
        id, F.round(sum(weights, F.lit(0.0)) / max(len(asked), 1), 4).alias("score"), matched.alias("matched"), F.lit(len(asked)).alias("total"),
        F.round(matched / max(len(asked), 1), 4).alias("coverage"),
    )


def deduplicated_entities(df: DataFrame, label: str = "label", examples: int = 5) -> DataFrame:
    """Labels of one match key as one entity: sums, the greatest score, the longest label, variants counted, and up to
    ``examples`` of the least variants. Variants are made distinct before they are gathered, and the gathering keeps
    ``examples`` per key through a ranked filter, so no list grows with the data."""
    rows = df.select(arabic.match_key(F.col(label)).alias("key"), F.regexp_replace(label, f"^{arabic.SPACES}|{arabic.SPACES}$", "").alias("variant"), "frequency", "document_frequency", "score").filter("key <> ''")
    per = rows.groupBy("key", "variant").agg(F.sum("frequency").alias("f"), F.sum("document_frequency").alias("d"), F.max("score").alias("s"))
    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("variant"))).filter(F.col("place") <= examples)
    listed = ranked.groupBy(F.col("key").alias("k")).agg(F.array_sort(F.collect_list("variant")).alias("examples"))
    total = per.groupBy("key").agg(
        F.sum("f").alias("frequency"), F.sum("d").alias("document_frequency"), F.max("s").alias("score"),
        F.max(F.struct(F.length("variant").alias("n"), "variant"))["variant"].alias("label"), F.count("*").alias("variants"),
    )
    return total.join(listed, F.col("key") == F.col("k")).drop("k")


def hashed_dimensions(words: DataFrame, record: str, size: int = 256) -> DataFrame:
    """(record, dimension, weight): the hashing vector of each record in long form, L2-normalised. A word adds 1 to its
    dimension, each of its trigrams 0.35; the dimension is the first four bytes of the SHA-1 modulo ``size``."""
    def dim(c):
        return (F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("bigint") % size).cast("int")

    def grams(w):
        return F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("tri:"), w.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.transform("tokens", lambda w: F.concat(F.array(F.struct(w.alias("t"), F.lit(1.0).alias("v"))), F.transform(grams(w), lambda g: F.struct(g.alias("t"), F.lit(0.35).alias("v"))))))
    raw = words.select(record, F.explode(parts).alias("p")).groupBy(record, dim(F.col("p.t")).alias("dimension")).agg(F.sum("p.v").alias("v"))
    norm = raw.groupBy(F.col(record).alias("__r")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, F.col(record) == F.col("__r")).select(record, "dimension", (F.col("v") / F.col("norm")).alias("weight"))


def mean_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dimension, weight): the L2-normalised mean vector of each group, dimension by dimension."""
    parts = vectors.select(group, F.posexplode(vector).alias("dimension", "v")).groupBy(group, "dimension").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = parts.groupBy(F.col(group).alias("__g")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return parts.join(norm, F.col(group).eqNullSafe(F.col("__g"))).select(group, "dimension", (F.col("m") / F.col("norm")).alias("weight"))


def nested_mean_vectors(vectors: DataFrame, group: str, part: str, vector: str) -> DataFrame:
    """(group, dimension, weight): the mean of the group's parts' mean vectors, each of length 1, so a large part counts
    no more than a small one."""
    key = F.struct(F.col(group).alias("g"), F.col(part).alias("p"))
    parts = mean_vectors(vectors.select(key.alias("__key"), vector), "__key", vector)
    whole = parts.groupBy(F.col("__key.g").alias(group), "dimension").agg(F.avg("weight").alias("m"))
    norm = whole.groupBy(F.col(group).alias("__n")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return whole.join(norm, F.col(group).eqNullSafe(F.col("__n"))).select(group, "dimension", (F.col("m") / F.col("norm")).alias("weight"))


def backfilled(elements: DataFrame, version: str = "1.0.0") -> DataFrame:
    """The elements with a raw text whose normalised text another version made, or none: normalised anew, with the version
    and whether the text changes. What is current already is not touched."""
    stale = F.col("text_normalized").isNull() | ~F.col("canonicalizer_version").eqNullSafe(version)
    made = elements.filter(F.col("text_raw").isNotNull() & stale).withColumn("__made", arabic.search_form(F.col("text_raw")))
    return made.withColumn("changed", ~F.col("__made").eqNullSafe(F.col("text_normalized"))).withColumn("text_normalized", F.col("__made")).withColumn("canonicalizer_version", F.lit(version)).drop("__made")
