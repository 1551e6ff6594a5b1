"""Entities learned from texts: spans around marker words, their kinds, what is worth keeping, and suggestions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic

# ------------------------------------------------------------------ fixed values: marker words, as the folded text has them
TRIGGERS = {"الامام": "person", "الشيخ": "person", "السيد": "person", "النبي": "person", "الرسول": "person", "الكتاب": "book", "كتاب": "book", "باب": "section", "حديث": "hadith", "المصنف": "person"}
GENEALOGY = ["بن", "ابن", "بنت"]
ROLES = ["عليه", "عليها", "عليهم", "عليهما", "رضي", "رحمه", "قدس", "سلام", "صلي"]
PAIR_MARKERS = ["كتاب", "الإمام", "الشيخ", "السيد", "النبي", "الرسول", "باب", "حديث", "سورة", "آية"]
BOOSTS = {"trigger": 1.5, "genealogy": 2.0, "role": 1.0, "pair": 0.75}
LEADING = "من في عن مع عند بعد قبل بين حتي لدي منذ خلال ثم او بل لكن و ف ب ل ك".split()
TRAILING = "عن و ثم في من بن ابن ، قال عنه عنها عنهم".split()
GENERIC = "الباب باب الحديث حديث الفصل فصل الجزء جزء المجلد مجلد الصفحه صفحه ابواب الكتاب كتاب المصدر نسخه مثله نحوه الاول الثاني الثالث الرابع الخامس".split()
PERSON_WORDS = "بن ابن ابو ابي ام بنت".split()
HONORIFICS = "الشيخ الامام السيد العلامه الحافظ القاضي المولي الحاج المحقق النبي رسول الرسول الصادق الباقر الكاظم الرضا".split()
BOOK_WORDS = "كتاب رساله شرح تفسير مختصر تهذيب وسائل".split()
SACRED_TITLES = ["النبي", "الرسول", "رسول الله", "امير المومنين"]
FORMULAS = ["صلي الله", "رضي الله"]
DIGITS = "[0-9\\u0660-\\u0669\\u06F0-\\u06F9]"
PUNCTUATION = "[()\\[\\]{}«»؛؟!*]"
# ------------------------------------------------------------------

_NASAB = "(?:^|\\s)(?:بن|ابن)\\s"


def _kept(words: Column, test) -> Column:
    """The words from the first to the last for which ``test`` holds."""
    n = F.size(words)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & test(F.get(words, i - 1)))
    first, last = F.array_min(places), F.array_max(places)
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(words, first, last - first + 1))


def _from_first(words: Column, test) -> Column:
    n = F.size(words)
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & test(F.get(words, i - 1))))
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(words, first, n))


def classified_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with the verdict on a label: kind (person, book, unknown, rejected), accepted, reason, cleaned, storable,
    kept.

    Rules in order, the first that fires: nothing, digits, punctuation no name has, a formula attached to a name, more
    than six words, function and general words only; then words of punctuation and function words are taken off both
    ends, and what is left is judged by its own words. ``storable`` labels are also short and without dot leaders;
    ``kept`` ones are accepted with a known kind. A null label is an empty one."""
    key = arabic.match_key
    raw = arabic.collapse(F.coalesce(F.col(label), F.lit("")))
    step = df.withColumn("__raw", raw)
    step = step.withColumn("__t", F.filter(F.split("__raw", " "), lambda w: w != "")).withColumn("__n", key(F.col("__raw")))
    sounding = _kept(F.col("__t"), lambda w: w.rlike("[\\p{L}\\p{N}]"))
    step = step.withColumn("__s", sounding)
    step = step.withColumn("__f", _from_first(F.col("__s"), lambda w: ~key(w).isin(LEADING)))
    # Taking off trailing words keeps what leads, so the two ends are done one after the other.
    step = step.withColumn("__b", F.reverse(_from_first(F.reverse("__f"), lambda w: ~key(w).isin(TRAILING))))
    step = step.withColumn("__c", _from_first(F.col("__b"), lambda w: key(w) != "بن")).withColumn("__k", F.transform("__c", key))
    sacred = F.lit(False)
    for t in SACRED_TITLES:
        sacred = sacred | F.col("__n").startswith(t)
    formula = F.lit(False)
    for f in FORMULAS:
        formula = formula | F.contains("__n", F.lit(f))
    has = lambda words: F.exists("__k", lambda w: w.isin(words))
    head = F.get("__k", F.lit(0))

    def verdict(kind: str, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    told = (
        F.when(F.size("__t") == 0, verdict("rejected", "empty"))
        .when(F.col("__raw").rlike(DIGITS), verdict("rejected", "digits"))
        .when(F.col("__raw").rlike(PUNCTUATION), verdict("rejected", "punctuation"))
        .when(formula & ~(sacred & ~F.col("__n").rlike(_NASAB)), verdict("rejected", "formula"))
        .when(F.size("__t") > 6, verdict("rejected", "long"))
        .when(F.forall("__t", lambda w: key(w).isin(LEADING + GENERIC)), verdict("rejected", "function words"))
        .when(F.size("__s") == 0, verdict("rejected", "punctuation only"))
        .when(F.size("__c") == 0, verdict("rejected", "nothing left"))
        .when(F.forall("__k", lambda w: w.isin(GENERIC)), verdict("rejected", "general words"))
        .when(head.isin(GENERIC) & ~head.isin(BOOK_WORDS), verdict("rejected", "section"))
        .when(has(PERSON_WORDS), verdict("person", "genealogy"))
        .when(has(HONORIFICS), verdict("person", "honorific"))
        .when(head.isin(BOOK_WORDS), verdict("book", "title"))
        .when(F.size("__c") <= 3, verdict("unknown", "plain name"))
        .otherwise(verdict("rejected", "no evidence"))
    )
    step = step.withColumn("__v", told)
    accepted = F.col("__v.kind") != "rejected"
    storable = accepted & (F.length("__raw") <= 60) & ~F.contains("__raw", F.lit("....")) & ~F.contains("__raw", F.lit(".. .")) & (F.regexp_count("__raw", F.lit(DIGITS)) <= 2)
    found = F.struct(
        "__v.kind", "__v.reason", accepted.alias("accepted"), F.when(accepted, F.array_join("__c", " ")).otherwise("").alias("cleaned"), storable.alias("storable"),
        (accepted & (F.col("__v.kind") != "unknown")).alias("kept"),
    )
    # Made once, behind a generator: a filter on the verdict does not take its expressions apart again.
    return step.select(*df.columns, F.explode(F.array(found)).alias("__w")).select(*df.columns, "__w.*")


def entity_spans(words: DataFrame, record: str = "element_id") -> DataFrame:
    """(record, pos, label, kind, boost) of each span (record, tokens) that may be an entity, in the order of learning:
    five words from a trigger on, two words before a genealogy word to two behind it, one word before a formula's word
    to three behind it, then pairs of neighbours with a marker that are none of these."""
    t, n = F.col("tokens"), F.size("tokens")
    entry = lambda i, k, lo, hi, kind, boost: F.struct((i * 3 + k).alias("pos"), F.array_join(F.slice(t, lo, hi - lo + 1), " ").alias("label"), (hi - lo + 1).alias("size"), kind.alias("kind"), F.lit(boost).alias("boost"))
    w = lambda i: F.get(t, i - 1)
    kinds = F.create_map(*[F.lit(x) for kv in TRIGGERS.items() for x in kv])
    places = F.when(n > 0, F.sequence(F.lit(1), n))
    spans = F.flatten(
        F.transform(
            places,
            lambda i: F.array(
                F.when(w(i).isin(list(TRIGGERS)), entry(i, 0, i, F.least(n, i + 4), F.element_at(kinds, w(i)), BOOSTS["trigger"])),
                F.when(w(i).isin(GENEALOGY), entry(i, 1, F.greatest(F.lit(1), i - 2), F.least(n, i + 2), F.lit("person"), BOOSTS["genealogy"])),
                F.when(w(i).isin(ROLES) & (i < n), entry(i, 2, F.greatest(F.lit(1), i - 1), F.least(n, i + 3), F.lit("person"), BOOSTS["role"])),
            ),
        )
    )
    long = F.filter(spans, lambda s: s.isNotNull() & (s["size"] >= F.when(s["boost"] == BOOSTS["trigger"], 2).otherwise(3)))
    first = words.filter(F.exists("tokens", lambda x: x.isin([*TRIGGERS, *GENEALOGY, *ROLES]) | x.rlike("|".join(PAIR_MARKERS)))).select(record, "tokens", F.explode(F.array(long)).alias("spans"))
    pairs = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)), lambda i: entry(n + i, 0, i, i + 1, F.lit("candidate"), BOOSTS["pair"]))
    seen = F.transform("spans", lambda s: s["label"])
    pairs = F.filter(pairs, lambda p: p["label"].rlike("|".join(PAIR_MARKERS)) & ~F.array_contains(seen, p["label"]))
    every = F.concat("spans", F.coalesce(pairs, F.array().cast("array<struct<pos:int,label:string,size:int,kind:string,boost:double>>")))
    return first.select(record, F.explode(every).alias("s")).select(record, "s.pos", "s.label", "s.kind", "s.boost")


def learned_entities(spans: DataFrame, record: str = "element_id") -> DataFrame:
    """(label, kind, frequency, score): labels worth storing, with the kind they were first seen as.

    The score is the greatest of a span's boost plus the logarithm of how often the label had been seen by then; for
    one boost that is at its last occurrence, so a label needs one count for each boost, not a running one."""
    at = F.struct(F.col(record).alias("r"), F.col("pos").alias("p"))
    occ = spans.select("label", "kind", "boost", at.alias("at"))
    total = occ.groupBy("label").agg(F.min_by("kind", "at").alias("kind"), F.count("*").alias("frequency"))
    last = occ.groupBy(F.col("label").alias("l"), F.col("boost").alias("b")).agg(F.max("at").alias("upto"))
    by = occ.join(last, (F.col("label") == F.col("l")) & (F.col("at") <= F.col("upto"))).groupBy("l", "b").agg(F.count("*").alias("rank"))
    best = by.groupBy("l").agg(F.round(F.max(F.col("b") + F.log1p(F.col("rank").cast("double"))), 6).alias("score"))
    rows = total.join(best, F.col("label") == F.col("l")).select("label", "kind", "frequency", "score")
    return classified_labels(rows.withColumnRenamed("kind", "seen_as")).filter("storable").select("label", F.col("seen_as").alias("kind"), "frequency", "score")


def suggested_entities(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(label, original_label, kind, score, frequency): learned entities for a query, the equal one first, then those
    that hold it or lie in it, judged by their words before the best ``k`` are taken."""
    q = arabic.search_form(F.lit(query))
    near = F.when(F.col("label") == q, 2.5).when(F.contains("label", q), 1.25).when(F.contains(q, F.col("label")), 0.75).otherwise(0.0)
    n = F.col("frequency").cast("double")
    scored = entities.select(F.col("label").alias("original_label"), "frequency", (F.col("score") + near + F.log1p(n) / 10 + F.log1p(n) / 20).alias("score")).filter(F.col("score") >= 0.25)
    told = classified_labels(scored, "original_label").filter("accepted")
    order = [F.desc("score"), F.desc("frequency"), F.desc("original_label")]
    return told.orderBy(*order).limit(k).select(F.col("cleaned").alias("label"), "original_label", "kind", F.round("score", 4).alias("score"), "frequency")


def suggested_words(vocabulary: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, word, score, place): for each query (query_id, query) the words (token, frequency, document_frequency)
    most like it, by the share of matching blocks, with a bonus for frequency and for the word itself.

    The ratio of matching blocks is at most the share of common letters, so a word is compared only where that bound
    and its bonuses reach the floor; the comparison runs in Arrow batches over the vocabulary, every word of it, against
    the stated queries, which are shipped with the task and are as many as were asked."""
    asked = [(r.query_id, r.q) for r in queries.select("query_id", arabic.search_form(F.col("query")).alias("q")).filter("q <> ''").collect()]

    def compare(batches):
        for pdf in batches:
            out = []
            for qid, q in asked:
                m = difflib.SequenceMatcher(None)
                m.set_seq2(q)
                for word, freq, bonus in zip(pdf["token"], pdf["frequency"], pdf["bonus"]):
                    m.set_seq1(word)
                    # SequenceMatcher's blocks depend on the order of its sides; the query is the first.
                    if m.quick_ratio() + bonus + (1.5 if word == q else 0.0) >= 0.25:
                        score = difflib.SequenceMatcher(None, q, word).ratio() + bonus + (1.5 if word == q else 0.0)
                        if score >= 0.25:
                            out.append((qid, word, round(score, 4), freq))
            yield pd.DataFrame(out, columns=["query_id", "word", "score", "frequency"])

    bonus = F.log1p(F.col("frequency").cast("double")) / 10 + F.log1p(F.col("document_frequency").cast("double")) / 20
    rows = vocabulary.select("token", "frequency", bonus.alias("bonus")).mapInPandas(compare, f"query_id {queries.schema['query_id'].dataType.simpleString()}, word string, score double, frequency long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("frequency"), F.desc("word"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "word", "score", "place")
