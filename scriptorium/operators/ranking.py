"""Fusion of ranked runs, graded signals, bonuses, reranking, pruning and page diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic, scoring
from scriptorium.operators.corpus import ngrams

# ------------------------------------------------------------------ fixed values: weights and word lists
K = 60
SOURCE_WEIGHTS = {"fts": 1.0, "fuzzy": 0.7, "semantic": 0.8}
SIGNAL_WEIGHTS = {"ocr_penalty": 0.010, "coverage": 0.008, "completeness": 0.004, "density": 0.002, "length_prior": 0.008, "informativeness": 0.006}
LAYOUT_BONUS = {"matn": 0.012, "sanad": 0.006, "heading": 0.004, "takhrij": 0.0, "hashiya": -0.004, "footnote": -0.008, "running_head": -0.012, "hadith_number": -0.010, "page_number": -0.015, "unknown": 0.0}
BOILERPLATE = ["ان شا الله", "إن شاء الله", "الحمد لله", "الحمد الله", "صلي الله عليه واله", "صلى الله عليه وآله", "عليه السلام", "عليهم السلام", "عز وجل", "عزّ وجلّ", "تبارك وتعالي"]
SHORT_WORDS = "عن من في ما لا ان إن أن به له هو هي قد بن كل لم لن او أو يا ثم مع هذ ذا بل اي أي اذ إذ كم لك بك".split()
LONE_PUNCTUATION = ["،", ",", ".", ":", ";", "؛", "-", "(", ")", "[", "]"]
OPENERS = ["،", "و", "ف", ":", "(", ")"]
RATIOS = {"person": 0.08, "book": 0.08, "entity": 0.08, "passage": 0.12}
GENERIC_RATIO, UNCOVERED_RATIO = 0.55, 0.70
# ------------------------------------------------------------------

_ARABIC = "^[\\u0621-\\u064A\\u064B-\\u0652\\u0670]+$"


def fuse(hits: DataFrame, key: str = "element_id", k: int = K, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, key, rrf, sources, hit_count, ranks): reciprocal rank fusion of (query_id, source, arrival, key).

    ``ranks`` explains the sum: each source with the rank it gave and what that adds.

    A record counts once per source, at its first arrival; its rank is its place among the source's first arrivals.
    """
    weights = weights or SOURCE_WEIGHTS
    first = hits.groupBy("query_id", "source", key).agg(F.min("arrival").alias("arrival"), F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("arrival", key))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.5))
    ranked = first.withColumn("rank", rank).withColumn("part", weight / (k + F.col("rank")))
    return ranked.groupBy("query_id", key).agg(
        F.sum("part").alias("rrf"),
        F.array_sort(F.collect_set("source")).alias("sources"),  # one entry per engine
        F.sum("times").alias("hit_count"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col("source"), F.lit(": "), F.col("rank").cast("string"), F.lit(" -> "), F.format_string("%.6f", "part")))), " | ").alias("ranks"),
    )


def exact_form_boost(score: Column, query: str, raw: Column, normal: Column, boost: float = 0.5) -> Column:
    """Adds the boost where the raw text holds the query as typed, 0.3 of it where only the folded text does."""
    folded = arabic.search_form(F.lit(query))
    return score + F.when(F.contains(raw, F.lit(query)), boost).when(F.contains(normal, folded), boost * 0.3).otherwise(0.0)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), arabic.SPACES), lambda w: w != "")


def length_penalty(score: Column, text: Column, least: int = 3, penalty: float = 0.4) -> Column:
    n = F.size(words(text))
    return F.when(n < least, score - score * penalty * (1 - F.greatest(F.lit(0.1), n / least))).otherwise(score)


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\u0621-\\u064A]", "")


def is_fragment(c: Column) -> Column:
    """A short Arabic piece that is no word by itself."""
    return c.rlike(_ARABIC) & (F.length(letters(c)) <= 2) & ~letters(c).isin(SHORT_WORDS)


def without_stretch(text: Column) -> Column:
    """A text without tatweel, and with letters torn off behind a mark put back."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit("ـ"), F.lit(""))
    return F.regexp_replace(bare, "([\\u0621-\\u064A][\\u064B-\\u0652\\u0670])\\s+([\\u0621-\\u064A]{1,2})(?=\\s|$|[^\\u0621-\\u064A])", "$1$2")


def ocr_quality(text: Column, clean: Column, t: Column) -> Column:
    """1 for sound text, less for tatweel, fragments, punctuation inside words, misread letters and irregular lengths.
    ``clean`` is the text without stretch, ``t`` its words."""
    raw = F.coalesce(text, F.lit(""))
    n = F.size(t)
    tatweel = (F.length(raw) - F.length(F.replace(raw, F.lit("ـ"), F.lit("")))) / F.length(raw)
    fragments = F.size(F.filter(t, is_fragment)) / n
    at = F.when(n >= 3, F.sequence(F.lit(2), n - 1))
    a, b = lambda i: F.get(t, i - 2), lambda i: F.get(t, i)
    inner = F.size(F.filter(at, lambda i: F.get(t, i - 1).isin(LONE_PUNCTUATION) & (is_fragment(a(i)) | is_fragment(b(i))) & a(i).rlike(_ARABIC) & b(i).rlike(_ARABIC)))
    misread = F.least(F.lit(1.0), F.regexp_count(clean, F.lit("\\u0627\\u0627\\u0644\\u0644\\u0647|\\u0627\\s\\u0627\\u0644\\u0644\\u0647")) / n * 4)
    lone = F.size(F.filter(t, lambda w: w.isin(LONE_PUNCTUATION))) / n
    sizes = F.transform(F.filter(t, lambda w: w.rlike(_ARABIC)), lambda w: F.length(letters(w)).cast("double"))
    total, square = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x), F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x * x)
    m = F.size(sizes)
    variance = square / m - (total / m) * (total / m)
    irregular = F.when(m >= 4, F.least(F.lit(1.0), variance / 12)).otherwise(0.0)
    damage = tatweel * 0.7 + fragments * 1.4 + F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)) / n * 2.2 + misread * 1.2 + lone * 0.45 + irregular * 0.25
    return F.when((F.length(raw) == 0) | (n == 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), damage)), 4))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's words (array) that the text's words (array) hold."""
    return F.when(F.size(query) > 0, F.round(F.size(F.filter(query, lambda w: F.array_contains(text, w))) / F.size(query), 4)).otherwise(0.0)


def density(query: Column, text: Column) -> Column:
    hits = F.size(F.filter(text, lambda w: F.array_contains(query, w)))
    return F.when((F.size(query) > 0) & (F.size(text) > 0), F.round(F.least(F.lit(1.0), hits / F.size(text) / 0.25), 4)).otherwise(0.0)


def completeness(text: Column) -> Column:
    """1 for a whole sentence, less for a cut beginning or end, few words or a fragment at the end."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{arabic.SPACES}|{arabic.SPACES}$", "")
    t = words(s)
    last = F.replace(F.element_at(t, -1), F.lit("ـ"), F.lit(""))
    score = (
        F.lit(1.0)
        - F.when(F.element_at(t, 1).isin(OPENERS), 0.35).otherwise(0.0)
        - F.when(F.right(s, F.lit(1)).isin(".", "؟", "!", "۔"), 0.0).otherwise(0.25)
        - F.when(F.size(t) < 5, 0.25).otherwise(0.0)
        - F.when((F.length(last) <= 2) & last.rlike(_ARABIC), 0.15).otherwise(0.0)
    )
    return F.when(s == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 4))


def length_prior(n: Column) -> Column:
    return F.when(n <= 3, 0.0).when(n < 8, F.round((n - 3) / 5 * 0.6, 4)).when(n <= 30, 1.0).otherwise(F.round(F.greatest(F.lit(0.6), 1 - (n - 30) / 60), 4))


def informativeness(text: Column) -> Column:
    """1 less the share of words in set phrases."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{arabic.SPACES}|{arabic.SPACES}$", "")
    covered = sum((F.when(F.contains(s, F.lit(p)), len(p.split())).otherwise(0) for p in BOILERPLATE), F.lit(0))
    return F.when(s == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), covered / F.size(words(s)))), 4))


def is_index_line(text: Column) -> Column:
    """Dot leaders, or a long tail of digits."""
    s = F.coalesce(text, F.lit(""))
    return s.rlike("[.\\u2024\\u2026]{4,}|(?:\\.\\s){4,}") | s.rlike("[0-9\\u0660-\\u0669\\u06F0-\\u06F9\\s.\\u0640-]{12,}$")


def signals(rows: DataFrame, query: Column, raw: str, normal: str) -> DataFrame:
    """``rows`` with the six graded signals and their weighted sum; ``query`` is an array of words."""
    # Words are made once, each list in a projection of its own.
    one = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))
    staged = one(one(one(rows, "__t", words(F.col(normal))), "__clean", without_stretch(F.col(raw))), "__words", words(F.col("__clean")))
    t = F.col("__t")
    staged = one(staged, "__quality", ocr_quality(F.col(raw), F.col("__clean"), F.col("__words")))
    quality = F.col("__quality")
    out = staged.select(
        *rows.columns,
        F.when(is_index_line(F.col(normal)), F.least(quality, F.lit(0.15))).otherwise(quality).alias("ocr_quality"),
        coverage(query, t).alias("coverage"), completeness(F.col(normal)).alias("completeness"), density(query, t).alias("density"),
        length_prior(F.size(t)).alias("length_prior"), informativeness(F.col(normal)).alias("informativeness"),
    )
    total = sum((F.col(c) * w for c, w in SIGNAL_WEIGHTS.items() if c != "ocr_penalty"), F.lit(0.0)) - (1 - F.col("ocr_quality")) * SIGNAL_WEIGHTS["ocr_penalty"]
    return out.withColumn("graded", F.round(total, 8))


def layout_bonus(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LAYOUT_BONUS.items() for x in kv]), kind), F.lit(0.0))


def bonuses(form: Column, search_text: Column, sources: Column) -> Column:
    """Exact or contained query (its search form), shared words, agreement of engines."""
    shared = F.size(F.array_intersect(F.array_distinct(words(search_text)), F.array_distinct(words(form))))
    return (
        F.when(search_text == form, 0.030).when(F.contains(search_text, form), 0.012).otherwise(0.0)
        + F.least(shared, F.lit(6)) * 0.002
        + F.least(F.size(sources), F.lit(3)) * 0.004
    )


def ranked(fused: DataFrame, query: str | Column, k: int = 50) -> DataFrame:
    """Final score and order of fused hits that carry text_raw, text_normalized, element_type, page_id, page_number, for
    one query, or for the query of each row given as a Column.

    score = fusion + graded signals + bonuses + exact raw form + layout, less a fragment penalty, at least 0. Ordered
    by score, words, page number, then id; hits beyond the third of their page are ``deferred`` and come behind all
    others. ``reranked`` adds the exact-query and phrase bonuses of the reranker.
    """
    asked = F.lit(query) if isinstance(query, str) else query
    fused = fused.withColumn("__asked", asked).withColumn("__form", arabic.search_form(F.col("__asked")))
    asked, form = F.col("__asked"), F.col("__form")
    rows = signals(fused, F.array_distinct(words(form)), "text_raw", "text_normalized")
    search_text = F.coalesce("text_normalized", F.lit(""))
    n = F.size(words(F.col("text_raw")))
    base = F.col("rrf") + F.col("graded") + bonuses(form, search_text, F.col("sources")) + F.when(F.contains("text_raw", asked), 0.020).otherwise(0.0) + layout_bonus(F.col("element_type"))
    penalty = F.when(n < 3, -base * 0.5 * (1 - F.greatest(F.lit(0.1), n / 3))).otherwise(0.0)
    # The query and its first sequences of words; folding words one by one folds their sequences.
    said = words(form)
    phrases = F.slice(F.concat(F.array(form), *[ngrams(said, m) for m in (2, 3, 4)]), 1, 4)
    rerank = F.when(F.contains(search_text, form), 0.010).otherwise(0.0) + F.least(F.size(F.filter(phrases, lambda p: F.contains(search_text, p))) * 0.004, F.lit(0.012))
    scored = rows.withColumn("score", F.round(F.greatest(base + penalty, F.lit(0.0)), 8)).withColumn("reranked", F.round(F.col("score") + rerank, 8)).withColumn("n_words", n)
    by = [F.desc("score"), F.desc("n_words"), F.desc(F.coalesce("page_number", F.lit(0))), F.col("element_id")]
    again = [F.col("deferred"), F.desc("reranked"), *by[1:]]
    whole, page = Window.partitionBy("query_id").orderBy(F.col("deferred"), *by), Window.partitionBy("query_id", "page_id").orderBy(*by)
    return (
        scored.withColumn("deferred", F.row_number().over(page) > 3).withColumn("place", F.row_number().over(whole))
        .withColumn("final_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*again))).filter(F.col("final_place") <= k).drop("__asked", "__form")
    )


def pruned(rows: DataFrame, intent: str | None = None, safety: int = 10, query: str | None = None) -> DataFrame:
    """(…, ratio, kept, reason): rows whose score is near enough to their query's best; where none is, the first
    ``safety``. A phrase of general words that does not hold the query must come nearer, as must a text that shares no
    word with it; empty texts never pass. ``reason`` says why a row was left out."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    ratio = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    least = RATIOS.get(intent or "", 0.15)
    text = F.coalesce("text_normalized", F.lit(""))
    lacks = ~F.contains(text, arabic.search_form(F.lit(query))) if query else F.lit(True)
    named = intent in RATIOS and intent != "passage"
    far = {
        "empty": text == "", "below_relative_threshold": ratio < least, "generic_phrase": lacks & scoring.is_generic_query(words(text)) & (ratio < GENERIC_RATIO),
        "no_coverage": F.lit(False) if named else lacks & (F.col("coverage") == 0) & (ratio < UNCOVERED_RATIO),
    }
    why = F.coalesce(*[F.when((best > 0) | F.lit(k == "empty"), F.when(c, k)) for k, c in far.items()])
    keep = why.isNull()
    marked = rows.withColumn("ratio", F.round(ratio, 6)).withColumn("passes", keep).withColumn("reason", why)
    any_pass = F.max(F.col("passes").cast("int")).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "element_id"))
    kept = marked.withColumn("kept", F.when(any_pass == 1, F.col("passes")).otherwise(place <= safety)).drop("passes")
    return kept.withColumn("reason", F.when(~F.col("kept"), F.col("reason")))


def movement(rows: DataFrame, before: str, after: str, group: str = "query_id", item: str = "element_id", head: int = 50) -> DataFrame:
    """(group, item, place_before, place_after, moved): the first ``head`` re-ordered by ``after``, the tail untouched."""
    b = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(before), item))
    x = rows.select(group, item, before, after).withColumn("place_before", b)
    a = F.row_number().over(Window.partitionBy(group).orderBy(F.col("place_before") > head, F.when(F.col("place_before") <= head, -F.coalesce(F.col(after), F.lit(-1e300))).otherwise(F.col("place_before").cast("double")), item))
    x = x.withColumn("place_after", a)
    return x.select(group, item, "place_before", "place_after", (F.col("place_before") - F.col("place_after")).alias("moved"))
