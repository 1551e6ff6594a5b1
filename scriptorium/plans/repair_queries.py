"""Queries over forms with a map to the raw text, and over the repair of torn words, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic, canonical
from scriptorium.operators import repair
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import ELEMENTS, _elements
from scriptorium.sources.tables import table


def _forms(spark, d):
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    return e.select("element_id", "text_raw", canonical.canonical(F.col("text_raw")).alias("c")).select("element_id", "text_raw", "c.*")


def canonical_forms(spark, d):
    """Every element's canonical form, and how far its map reaches into the raw text."""
    return _forms(spark, d).select("element_id", "canonical", F.size("offsets").alias("places"))


def word_excerpts(spark, d):
    """The raw text of the last word of every element's canonical form."""
    f = _forms(spark, d).withColumn("start", F.length("canonical") - F.length(F.substring_index("canonical", " ", -1)))
    return f.select("element_id", F.substring_index("canonical", " ", -1).alias("word"), canonical.raw_excerpt(F.col("text_raw"), F.col("offsets"), F.col("start"), F.length("canonical")).alias("excerpt"))


def _tokens(spark, d):
    e = _elements(spark, d, "text_normalized").filter("text_normalized is not null")
    return e.select("element_id", F.filter(F.split("text_normalized", arabic.SPACES), lambda w: w != "").alias("tokens"))


def corrected_elements(spark, d):
    """Every element corrected with the lexicon of all normalised texts."""
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    fixed = repair.corrected_texts(e, repair.lexicon_of(_tokens(spark, d)), "element_id", "text_raw")
    return fixed.select("element_id", "stretched", "ligatures", "merged", F.sha1("text").alias("text_hash"))


def vocabulary_repair(spark, d):
    """Elements whose normalised text changes when torn words are joined, in up to three passes."""
    texts = _tokens(spark, d)
    fixed, _ = repair.repaired_texts(texts)
    before = texts.select(F.col("element_id").alias("e"), F.array_join("tokens", " ").alias("was"))
    return fixed.join(before, F.col("element_id") == F.col("e")).select("element_id", F.array_join("tokens", " ").alias("text"), "was").filter("text <> was").select("element_id", "text")


def merge_patterns(spark, d):
    return repair.top_patterns(repair.repaired_texts(_tokens(spark, d))[1])


def vocabulary_sizes(spark, d):
    """The lexicon the repair counts."""
    return repair.lexicon_of(_tokens(spark, d)).filter("frequency >= 3")


def source_names(spark, d):
    """Sources of documents as file names: the first name there is, without folders and ending."""
    from scriptorium.functions import scoring

    s = table(spark, d, "documents").select("source").distinct()
    path = F.concat(F.lit("/a/b.c/"), F.col("source"), F.lit(".tar.txt"))
    return s.select("source", scoring.first_non_empty(F.col("source"), F.lit("none")).alias("named"), scoring.path_stem(path).alias("stem"))


QUERIES = {f.__name__: f for f in (canonical_forms, word_excerpts, corrected_elements, vocabulary_repair, merge_patterns, vocabulary_sizes, source_names)}

_FORM = duck.search_form("text_raw")
_KEY = f"translate({duck.match_key('t')}, 'ؤئ', 'وي')"
SQL = {
    "canonical_forms": f"with {ELEMENTS}, f as (select element_id, {_FORM} as canonical from e where text_raw is not null) select element_id, canonical, length(canonical) as places from f",
    "vocabulary_sizes": f"with {ELEMENTS}, w as (select unnest(list_filter(string_split({duck.collapse('text_normalized')}, ' '), lambda w: w <> '')) as t from e where text_normalized is not null) select {_KEY} as word, count(*) as frequency from w group by 1 having count(*) >= 3",
    "source_names": "select distinct source, coalesce(nullif(trim(source, ' '), ''), 'none') as named, source || '.tar' as stem from documents",
}
