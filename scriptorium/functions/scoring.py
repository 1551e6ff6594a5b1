"""Scores, word classes and keys of queries and results, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import arabic

# ------------------------------------------------------------------ fixed values: word lists and weights
STOPWORDS = (
    "في من على عن إلى الى و يا هل ما ماذا متى كيف قال فقال ثم قد كان كانت يكون تكون هذا هذه ذلك تلك الذي التي الذين اللاتي اللواتي ال ب ك ل ف "
    "إن أن أو بل حتى إذا إذ عند مع كل أي أين أينما حيث"
).split()
GENERIC_TERMS = ["قال", "في", "من", "على", "عن", "الله", "عبد", "عبدالله", "عبد الله", "السلام", "عليه", "عليها", "عليهم", "عليهما", "عليه السلام", "صلى", "النبي"]
LETTERS_KEPT = ["و", "ف", "ب", "ك", "ل"]
SOURCE_WEIGHTS = {"fts": 1.0, "fuzzy": 0.78, "semantic": 0.9}
INTENT_WORDS = {
    "identity": ["من هو", "من هي", "ترجم", "تعريف", "من هذا", "من هذه"],
    "bibliography": ["كتاب", "مؤلف", "طبعة", "إصدار", "ناشر", "باب", "فصل", "جزء", "مجلد"],
    "quran": ["آية", "سورة", "قرآن", "المصحف"],
    "hadith": ["حديث", "رواية", "سند", "إسناد", "راوي", "أبواب"],
}
# ------------------------------------------------------------------


def is_stopword(c: Column) -> Column:
    """No word, a listed one, or a single character that is no prefix letter."""
    w = F.btrim(F.coalesce(c, F.lit("")))
    return (w == "") | w.isin(STOPWORDS) | ((F.length(w) == 1) & ~w.isin(LETTERS_KEPT))


def is_generic_token(c: Column) -> Column:
    return is_stopword(c) | F.btrim(F.coalesce(c, F.lit(""))).isin(GENERIC_TERMS)


def is_generic_query(tokens: Column) -> Column:
    """Whether no word of the array says anything; true for no word at all."""
    return F.forall(tokens, is_generic_token)


def keeps_candidate(candidate: Column, original: Column) -> Column:
    """Whether an expansion may be asked: not empty, and no single generic word unless it is the query itself."""
    c = F.btrim(F.coalesce(candidate, F.lit("")))
    single = F.size(F.split(arabic.collapse(c), " ")) == 1
    return (c != "") & ~(single & is_generic_token(c) & (c != F.btrim(F.coalesce(original, F.lit("")))))


def overlap_ratio(query: Column, tokens: Column) -> Column:
    """Share of the query's distinct words that the text's words hold; both arrays. 0 for no query."""
    q = F.array_distinct(F.filter(query, lambda w: w != ""))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(0.0)


def generic_density(tokens: Column) -> Column:
    """Share of stop words; 1 for a text without words."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, is_stopword)) / F.size(tokens)).otherwise(1.0)


def phrase_quality(tokens: Column) -> Column:
    """Longer phrases of different words are better ones; generic phrases have none."""
    n = F.size(tokens)
    score = F.least(n / 4.0, F.lit(1.0)) + F.size(F.array_distinct(tokens)) / n * 0.35 + F.log1p(n.cast("double")) / 10.0
    return F.when((n == 0) | is_generic_query(tokens), 0.0).otherwise(score)


def generic_penalty(tokens: Column) -> Column:
    d = generic_density(tokens)
    return F.when(d <= 0.15, 0.0).otherwise(F.least(F.lit(0.65), d * 0.75))


def exact_bonus(query_form: Column, form: Column) -> Column:
    """For search forms: the same text, or a text that holds the query."""
    some = (query_form != "") & (form != "")
    return F.when(some & (query_form == form), 2.25).when(some & F.contains(form, query_form), 1.35).otherwise(0.0)


def coverage_boost(query: Column, tokens: Column) -> Column:
    return overlap_ratio(F.filter(query, lambda w: ~is_stopword(w)), tokens) * 1.35


def source_bonus(sources: Column) -> Column:
    return F.least(F.size(F.array_distinct(sources)), F.lit(4)) * 0.08


def source_weight(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv]), source), F.lit(0.8))


def simple_intent(query: Column) -> Column:
    """struct(label, confidence, hints): the intent by listed words of the search form; later lists overrule earlier ones."""
    q = arabic.search_form(query)
    tokens = F.filter(F.split(q, " "), lambda w: w != "")

    def some(kind: str) -> Column:
        out = F.lit(False)
        for word in INTENT_WORDS[kind]:
            out = out | F.contains(q, F.lit(word))
        return out

    who, book, quran, hadith = (some(k) for k in INTENT_WORDS)
    single = (F.size(tokens) == 1) & ~is_generic_query(tokens)
    label = F.when(single, "entity").when(hadith, "hadith").when(quran, "quran").when(book, "bibliography").when(who, "entity").otherwise("general")
    best = F.greatest(
        F.when(who, 0.78).otherwise(0.55), F.when(book, 0.72).otherwise(0.0), F.when(quran | hadith, 0.8).otherwise(0.0), F.when(single, 0.72).otherwise(0.0)
    )
    hints = F.array_compact(F.array(F.when(who, "identity"), F.when(book, "bibliography"), F.when(quran, "quran"), F.when(hadith, "hadith"), F.when(single, "single-term")))
    # A short general query keeps its base confidence, which is below the bound for short ones.
    return F.struct(label.alias("label"), F.round(best, 2).alias("confidence"), hints.alias("hints"))


def is_ocr_noise(c: Column) -> Column:
    """No text, or at least eight and half of it stretch and blanks. The surface form has no stretch left, so blanks
    decide."""
    s = arabic.surface_form(c)
    blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return (s == "") | (blanks >= F.greatest(F.lit(8), F.floor(F.length(s) / 2)))


def sigmoid(c: Column) -> Column:
    """The logistic function, its argument kept within 30 of 0."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))))


def cache_key(query: Column, limit: Column, offset: Column) -> Column:
    """SHA-1 of the request as JSON with sorted keys."""
    escaped = F.replace(F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.sha1(F.concat(F.lit('{"limit": '), limit.cast("string"), F.lit(', "offset": '), offset.cast("string"), F.lit(', "q": "'), escaped, F.lit('"}')))


def box_from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(x, y, width, height) of two opposite corners in any order."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("width"), F.abs(y1 - y0).alias("height"))


def valid_box(box: Column) -> Column:
    """Not left of or above the page, and with an area."""
    return F.coalesce((box["x"] >= 0) & (box["y"] >= 0) & (box["width"] > 0) & (box["height"] > 0), F.lit(False))


def valid_span(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end > start), F.lit(False))


def plain_citation(title: Column, volume: Column, page: Column) -> Column:
    """Title, volume and page; a zero is a number like any other, only a null is left out."""
    return F.concat_ws(" ", title, F.concat(F.lit("ج"), volume), F.concat(F.lit("ص"), page))


def document_text(*parts: Column) -> Column:
    """What a reranker reads of a result: title, snippet and text, blanks between."""
    return F.btrim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def first_non_empty(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(p), F.lit("")) for p in parts])


def path_stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]*$", "")
