"""Queries over scores of phrases, learned entities and suggestions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic, scoring
from scriptorium.operators import corpus, entities
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import ELEMENTS, _elements, _words
from scriptorium.sources.tables import table

ASKED = "أبواب أحكام الصلاة"


def _labels(spark, d):
    return table(spark, d, "entity_candidates").filter("label is not null").select("label").distinct()


def entity_kinds(spark, d):
    """Every label's kind, what is left of it, and whether it is stored and shown."""
    return entities.classified_labels(_labels(spark, d)).drop("reason")


def rejection_reasons(spark, d):
    """Accepted and rejected labels by reason."""
    return entities.classified_labels(_labels(spark, d)).groupBy("kept", "kind", "reason").agg(F.count("*").alias("labels"))


def label_scores(spark, d):
    """Scores of every label as a phrase, and against a query."""
    t = _labels(spark, d).withColumn("form", arabic.search_form(F.col("label"))).withColumn("tokens", F.filter(F.split("form", " "), lambda w: w != ""))
    form = arabic.search_form(F.lit(ASKED))
    query = F.filter(F.split(form, " "), lambda w: w != "")
    t = t.withColumns({"query_form": form, "query": query})
    r = lambda c, name: F.round(c, 6).alias(name)
    tok = F.col("tokens")
    return t.select(
        "label", r(scoring.generic_density(tok), "density"), r(scoring.phrase_quality(tok), "quality"), r(scoring.generic_penalty(tok), "penalty"), r(scoring.overlap_ratio(F.col("query"), tok), "overlap"),
        r(scoring.coverage_boost(F.col("query"), tok), "coverage"), r(scoring.exact_bonus(F.col("query_form"), F.col("form")), "exact"), scoring.is_generic_query(tok).alias("generic"),
        scoring.keeps_candidate(F.col("form"), F.lit("الله")).alias("asked"),
    )


def label_intents(spark, d):
    """The simple intent of every label asked as a query."""
    return _labels(spark, d).select("label", scoring.simple_intent(F.col("label")).alias("i")).select("label", "i.label", "i.confidence", F.array_join("i.hints", ",").alias("hints")).toDF("query", "label", "confidence", "hints")


def noisy_elements(spark, d):
    """Elements that hold nothing but blanks and stretch."""
    e = _elements(spark, d, "text_raw")
    return e.filter(scoring.is_ocr_noise(F.col("text_raw"))).select("element_id")


def request_keys(spark, d):
    """Cache keys of every query's first pages of results."""
    q = table(spark, d, "rerank_results").select("query_id").distinct()
    page = q.select("query_id", F.explode(F.array(F.lit(0), F.lit(20))).alias("offset"))
    return page.select("query_id", "offset", scoring.cache_key(F.concat(F.lit('a "query" \\ '), F.col("query_id").cast("string")), F.lit(20), F.col("offset")).alias("key"))


def score_probabilities(spark, d):
    r = table(spark, d, "rerank_results").select("result_id", "original_score").distinct()
    return r.select("result_id", F.round(scoring.sigmoid(F.col("original_score").cast("double")), 8).alias("probability"))


def _spans(spark, d):
    return entities.entity_spans(_words(spark, d))


def entity_spans(spark, d):
    return _spans(spark, d).groupBy("label", "kind").agg(F.count("*").alias("times"))


def learned_entities(spark, d):
    return entities.learned_entities(_spans(spark, d))


def entity_suggestions(spark, d):
    return entities.suggested_entities(entities.learned_entities(_spans(spark, d)), "عبد الرحيم بن رزين")


def word_suggestions(spark, d):
    """Words like a misspelt one."""
    queries = spark.createDataFrame([(1, "الوضو"), (2, "manuscrpt"), (3, "")], "query_id int, query string")
    return entities.suggested_words(corpus.token_statistics(_words(spark, d)), queries)


QUERIES = {f.__name__: f for f in (entity_kinds, rejection_reasons, label_scores, label_intents, noisy_elements, request_keys, score_probabilities, entity_spans, learned_entities, entity_suggestions, word_suggestions)}

# ------------------------------------------------------------------------------------------------------------- SQL


def _in(words) -> str:
    return "(" + ", ".join(duck.q(w) for w in words) + ")"


def _first(x: str, test: str) -> str:
    """The list ``x`` from its first element on for which ``test`` (of e) holds."""
    return f"coalesce({x}[list_filter(range(1, len({x}) + 1), lambda i: list_transform([{x}[i]], lambda e: {test})[1])[1]:], [])"


_KEY = lambda x: duck.match_key(x)
_LETTER = "regexp_matches(e, '[\\p{L}\\p{N}]')"


def kinds(source: str) -> str:
    """CTEs that judge the labels of ``source`` (label): the last is v."""
    sacred = " or ".join(f"starts_with(n, {duck.q(t)})" for t in entities.SACRED_TITLES)
    has = lambda words: f"len(list_filter(k, lambda w: w in {_in(words)})) > 0"
    return f"""k0 as (select label, {duck.collapse('label')} as raw from {source}), k1 as (select *, list_filter(string_split(raw, ' '), lambda w: w <> '') as t, {_KEY('raw')} as n from k0),
 k2 as (select *, {_first('t', _LETTER)} as s0 from k1), k3 as (select *, list_reverse({_first('list_reverse(s0)', _LETTER)}) as s from k2), k4 as (select *, {_first('s', f"{_KEY('e')} not in {_in(entities.LEADING)}")} as f from k3),
 k5 as (select *, list_reverse({_first('list_reverse(f)', f"{_KEY('e')} not in {_in(entities.TRAILING)}")}) as b from k4), k6 as (select *, {_first('b', f"{_KEY('e')} <> 'بن'")} as c from k5),
 k7 as (select *, list_transform(c, lambda w: {_KEY('w')}) as k from k6),
 v as (select *, case when len(t) = 0 then 'rejected:empty' when {duck_match('raw', entities.DIGITS)} then 'rejected:digits' when {duck_match('raw', entities.PUNCTUATION)} then 'rejected:punctuation'
  when (contains(n, 'صلي الله') or contains(n, 'رضي الله')) and not (({sacred}) and not regexp_matches(n, '(?:^|\\s)(?:بن|ابن)\\s')) then 'rejected:formula' when len(t) > 6 then 'rejected:long'
  when len(list_filter(t, lambda w: {_KEY('w')} not in {_in(entities.LEADING + entities.GENERIC)})) = 0 then 'rejected:function words' when len(s) = 0 then 'rejected:punctuation only' when len(c) = 0 then 'rejected:nothing left'
  when len(list_filter(k, lambda w: w not in {_in(entities.GENERIC)})) = 0 then 'rejected:general words' when k[1] in {_in(entities.GENERIC)} and k[1] not in {_in(entities.BOOK_WORDS)} then 'rejected:section'
  when {has(entities.PERSON_WORDS)} then 'person:genealogy' when {has(entities.HONORIFICS)} then 'person:honorific' when k[1] in {_in(entities.BOOK_WORDS)} then 'book:title' when len(c) <= 3 then 'unknown:plain name' else 'rejected:no evidence' end as verdict from k7)"""


def duck_match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {duck.cls(pattern)})"


_STORABLE = f"not starts_with(verdict, 'rejected') and length(raw) <= 60 and not contains(raw, '....') and not contains(raw, '.. .') and len(regexp_extract_all(raw, {duck.cls(entities.DIGITS)})) <= 2"
_LABELS = "with l as (select distinct label from entity_candidates where label is not null)"
_STOP = lambda w: f"(trim({w}) = '' or trim({w}) in {_in(scoring.STOPWORDS)} or (length(trim({w})) = 1 and trim({w}) not in {_in(scoring.LETTERS_KEPT)}))"
_GENERIC = lambda w: f"({_STOP(w)} or trim({w}) in {_in(scoring.GENERIC_TERMS)})"
_WORDS = f"with {ELEMENTS}, w as (select element_id, list_filter(string_split(text_normalized, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) as t from e where text_normalized is not null)"
_PAIR = duck.q("|".join(entities.PAIR_MARKERS))
_SPANS = _WORDS + f""", x as (select element_id, t, len(t) as n, unnest(range(1, len(t) + 1)) as i from w),
 s0 as (select element_id, i * 3 as pos, t[i:least(n, i + 4)] as ws, 2 as least_words, case t[i] {' '.join(f"when {duck.q(k)} then '{v}'" for k, v in entities.TRIGGERS.items())} end as kind, 1.5 as boost from x where t[i] in {_in(entities.TRIGGERS)}
  union all select element_id, i * 3 + 1, t[greatest(1, i - 2):least(n, i + 2)], 3, 'person', 2.0 from x where t[i] in {_in(entities.GENEALOGY)}
  union all select element_id, i * 3 + 2, t[greatest(1, i - 1):least(n, i + 3)], 3, 'person', 1.0 from x where t[i] in {_in(entities.ROLES)} and i < n),
 s1 as (select element_id, pos, array_to_string(ws, ' ') as label, kind, boost from s0 where len(ws) >= least_words),
 pr as (select element_id, n + i as pos, t[i] || ' ' || t[i + 1] as label from x where i < n and regexp_matches(t[i] || ' ' || t[i + 1], {_PAIR})),
 sp as (select * from s1 union all select element_id, pos, label, 'candidate', 0.75 from pr anti join s1 using (element_id, label))"""
_LEARNED = _SPANS + """, oc as (select *, row_number() over (partition by label order by element_id, pos) as rk from sp),
 ag as (select label, arg_min(kind, (element_id, pos)) as kind, count(*) as frequency, round(max(boost + ln(1 + rk)), 6) as score from oc group by label), """ + kinds("ag") + f""",
 le as (select label, ag.kind, frequency, score, v.verdict, array_to_string(c, ' ') as cleaned from ag join v using (label) where {_STORABLE})"""
_FORM = duck.search_form("label")
_ASKED_FORM = duck.search_form(duck.q(ASKED))

SQL = {
    "entity_kinds": f"{_LABELS}, {kinds('l')} select label, split_part(verdict, ':', 1) as kind, not starts_with(verdict, 'rejected') as accepted, case when starts_with(verdict, 'rejected') then '' else array_to_string(c, ' ') end as cleaned, {_STORABLE} as storable, not starts_with(verdict, 'rejected') and not starts_with(verdict, 'unknown') as kept from v",
    "rejection_reasons": f"{_LABELS}, {kinds('l')} select not starts_with(verdict, 'rejected') and not starts_with(verdict, 'unknown') as kept, split_part(verdict, ':', 1) as kind, split_part(verdict, ':', 2) as reason, count(*) as labels from v group by all",
    "label_scores": f"""{_LABELS}, f as (select label, {_FORM} as form, {_ASKED_FORM} as qf from l), g as (select *, list_filter(string_split(form, ' '), lambda w: w <> '') as t, list_filter(string_split(qf, ' '), lambda w: w <> '') as q from f),
 d as (select *, case when len(t) = 0 then 1.0 else len(list_filter(t, lambda w: {_STOP('w')})) / len(t) end as dn, len(list_filter(t, lambda w: not {_GENERIC('w')})) = 0 as gen, list_filter(q, lambda w: not {_STOP('w')}) as qs from g)
 select label, round(dn, 6) as density, round(case when gen then 0.0 else least(len(t) / 4.0, 1.0) + len(list_distinct(t)) / len(t) * 0.35 + ln(1 + len(t)) / 10 end, 6) as quality, round(case when dn <= 0.15 then 0.0 else least(0.65, dn * 0.75) end, 6) as penalty,
  round(case when len(q) = 0 then 0.0 else len(list_intersect(list_distinct(q), t)) / len(list_distinct(q)) end, 6) as overlap, round(case when len(qs) = 0 then 0.0 else len(list_intersect(list_distinct(qs), t)) / len(list_distinct(qs)) * 1.35 end, 6) as coverage,
  case when qf = '' or form = '' then 0.0 when qf = form then 2.25 when contains(form, qf) then 1.35 else 0.0 end as exact, gen as generic, trim(form) <> '' and not (len(string_split({duck.collapse('form')}, ' ')) = 1 and {_GENERIC('form')} and trim(form) <> 'الله') as asked from d""",
    "label_intents": f"""{_LABELS}, f as (select label, {_FORM} as q from l), g as (select *, list_filter(string_split(q, ' '), lambda w: w <> '') as t, {', '.join('(' + ' or '.join(f"contains(q, {duck.q(w)})" for w in ws) + f') as {k}' for k, ws in scoring.INTENT_WORDS.items())} from f),
 h as (select *, len(t) = 1 and len(list_filter(t, lambda w: not {_GENERIC('w')})) > 0 as single from g)
 select label as query, case when single then 'entity' when hadith then 'hadith' when quran then 'quran' when bibliography then 'bibliography' when identity then 'entity' else 'general' end as label,
  greatest(case when identity then 0.78 else 0.55 end, case when bibliography or single then 0.72 else 0 end, case when quran or hadith then 0.8 else 0 end) as confidence,
  concat_ws(',', case when identity then 'identity' end, case when bibliography then 'bibliography' end, case when quran then 'quran' end, case when hadith then 'hadith' end, case when single then 'single-term' end) as hints from h""",
    "noisy_elements": f"with {ELEMENTS}, s as (select element_id, {duck.collapse(duck.shaped(duck.rep(duck.text('text_raw'), arabic.INVISIBLE)))} as s from e) select element_id from s where s = '' or length(s) - length(replace(s, ' ', '')) >= greatest(8, floor(length(s) / 2))",
    "request_keys": """select query_id, "offset", sha1('{"limit": 20, "offset": ' || "offset" || ', "q": "a \\"query\\" \\\\ ' || query_id || '"}') as key from (select distinct query_id from rerank_results), (values (0), (20)) v("offset")""",
    "score_probabilities": "select distinct result_id, round(1 / (1 + exp(-greatest(-30.0, least(30.0, original_score)))), 8) as probability from rerank_results",
    "entity_spans": _SPANS + " select label, kind, count(*) as times from sp group by all",
    "learned_entities": _LEARNED + " select label, kind, frequency, score from le",
    "entity_suggestions": _LEARNED + """, q as (select 'عبد الرحيم بن رزين' as q), sg as (select cleaned as label, label as original_label, split_part(verdict, ':', 1) as kind, score + case when label = q then 2.5 when contains(label, q) then 1.25 when contains(q, label) then 0.75 else 0 end + ln(1 + frequency) / 10 + ln(1 + frequency) / 20 as s, frequency from le, q)
 select label, original_label, kind, round(s, 4) as score, frequency from sg where s >= 0.25 order by s desc, frequency desc, original_label desc limit 10""",
}
