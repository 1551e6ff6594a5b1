"""Queries over retrieval and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.operators import corpus, ranking, retrieval
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import ELEMENTS
from scriptorium.plans.entity_queries import _GENERIC
from scriptorium.sources.tables import table

QUESTIONS = {1: "أبواب أحكام الصلاة", 2: "عبد الرحيم بن رزين", 3: "سألته عن الطهارة", 4: "narrator reports the chapter", 5: "الوضوء", 6: "تهذيب zzz"}
ASKED = "عبد الرحيم بن رزين"


def _elements(spark, d, *more):
    return corpus.current_elements(table(spark, d, "page_elements"), "text_normalized", *more).filter("text_normalized is not null")


def _questions(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id int, query string")


def full_text_hits(spark, d):
    # Records are known by their place, so that equal scores come in the order of pages.
    e = _elements(spark, d, "page_id", "element_order").withColumn("key", F.struct("page_id", "element_order", "element_id"))
    found = retrieval.full_text(retrieval.postings(e, "key", "text_normalized"), retrieval.query_terms(_questions(spark)), "key")
    return found.select("query_id", "key.element_id", "score", "mode", "place")


def postings_totals(spark, d):
    index = retrieval.postings(_elements(spark, d), "element_id", "text_normalized")
    return index.groupBy("term").agg(F.count("*").alias("records"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


def fuzzy_hits(spark, d):
    index = retrieval.trigram_index(_elements(spark, d), "element_id", "text_normalized")
    q = _questions(spark).withColumn("query", arabic.search_form(F.col("query")))
    return retrieval.fuzzy(index, q)


def fuzzy_titles(spark, d):
    """Titles similar to every title whose book_id is divisible by 20."""
    b = table(spark, d, "books")
    index = retrieval.trigram_index(b, "book_id", "title")
    q = b.filter("book_id % 20 = 0").select(F.col("book_id").alias("query_id"), F.col("title").alias("query"))
    return retrieval.fuzzy(index, q, id="book_id", k=50)


def trigram_shares(spark, d):
    index = retrieval.trigram_index(table(spark, d, "books"), "book_id", "title")
    return retrieval.word_similarity(index, _questions(spark), id="book_id")


def nearest_vectors(spark, d):
    """The 10 nearest of all vectors to every vector whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.nearest_vectors(v, q, "vec_id")


def indexed_nearest(spark, d):
    """The 10 nearest, by the vector index, to every vector whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    centres = retrieval.fitted_centres(v, "vec_id")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.nearest_in_cells(retrieval.indexed_vectors(v, "vec_id", centres), q, "vec_id", centres)


def _runs(spark, d):
    r = table(spark, d, "rerank_results").select("query_id", "element_id", "original_rank", "new_rank").distinct()
    a = r.select("query_id", F.lit("fts").alias("source"), F.col("original_rank").alias("arrival"), "element_id")
    b = r.select("query_id", F.lit("semantic").alias("source"), F.col("new_rank").alias("arrival"), "element_id")
    return a.unionByName(b)


def fused_runs(spark, d):
    f = ranking.fuse(_runs(spark, d))
    return f.select("query_id", "element_id", F.round("rrf", 8).alias("rrf"), F.array_join("sources", ",").alias("sources"), "hit_count", "ranks")


def source_counts(spark, d):
    return _runs(spark, d).groupBy("query_id", "source").agg(F.count("*").alias("hits"))


def element_signals(spark, d):
    words = F.array(*[F.lit(w) for w in ASKED.split()])
    return ranking.signals(_elements(spark, d, "text_raw"), words, "text_raw", "text_normalized").drop("text_raw", "text_normalized")


def _fused(spark, d):
    e = _elements(spark, d, "text_raw", "element_type", "page_id", "page_number")
    q = spark.createDataFrame([(1, ASKED)], "query_id int, query string")
    fts = retrieval.full_text(retrieval.postings(e, "element_id", "text_normalized"), retrieval.query_terms(q), k=200)
    fuz = retrieval.fuzzy(retrieval.trigram_index(e, "element_id", "text_normalized"), q, k=200)
    hits = fts.select("query_id", F.lit("fts").alias("source"), F.col("place").alias("arrival"), "element_id").unionByName(
        fuz.select("query_id", F.lit("fuzzy").alias("source"), F.col("place").alias("arrival"), "element_id")
    )
    f = ranking.fuse(hits)
    t = e.select(F.col("element_id").alias("e"), "text_raw", "text_normalized", "element_type", "page_id", "page_number")
    return f.join(t, F.col("element_id") == F.col("e")).drop("e")


def ranked_hits(spark, d):
    r = ranking.ranked(_fused(spark, d), ASKED)
    return r.select("query_id", "element_id", F.round("score", 6).alias("score"), F.round("reranked", 6).alias("reranked"), "deferred")


def pruned_hits(spark, d):
    r = ranking.ranked(_fused(spark, d), ASKED, k=1000)
    return ranking.pruned(r, "person", query=ASKED).select("query_id", "element_id", F.round("ratio", 4).alias("ratio"), "kept", "reason")


def boosted_titles(spark, d):
    """Exact-form boost and length penalty over titles at an equal base of 1."""
    b = table(spark, d, "books")
    boosted = ranking.exact_form_boost(F.lit(1.0), "الصلاة", F.col("title"), arabic.search_form(F.col("title")))
    return b.select("book_id", F.round(boosted, 6).alias("boosted"), F.round(ranking.length_penalty(F.lit(1.0), F.col("short_title")), 6).alias("penalised"))


def rank_movement(spark, d):
    r = table(spark, d, "rerank_results")
    last = r.groupBy("query_id", "element_id").agg(F.max(F.struct("scored_at", "original_score", "cross_score")).alias("l")).select("query_id", "element_id", "l.original_score", "l.cross_score")
    return ranking.movement(last, "original_score", "cross_score", head=20)


QUERIES = {
    f.__name__: f
    for f in (full_text_hits, postings_totals, fuzzy_hits, fuzzy_titles, trigram_shares, nearest_vectors, indexed_nearest, fused_runs, source_counts, element_signals, ranked_hits, pruned_hits, boosted_titles, rank_movement)
}

_E = f"with {ELEMENTS.replace('where rn = 1)', 'where rn = 1 and text_normalized is not null)')}"
_Q = "q as (select query_id, " + duck.search_form("query") + " as query from (values " + ", ".join(f"({i}, {duck.q(x)})" for i, x in QUESTIONS.items()) + ") v(query_id, query))"
_TERM = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_POST = "o as (select element_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as position from (select element_id, " + _TERM.replace("{0}", "text_normalized") + " as t from e)), i as (select term, element_id, count(*) as tf, min(position) as first from o group by all)"
_FTS = "qt as (select distinct query_id, unnest(t) as term, len(list_distinct(t)) as terms from (select query_id, " + _TERM.replace("{0}", "query") + """ as t from q)),
 p as (select query_id, element_id, terms, count(*) as held, sum(tf) as tf from i join qt using (term) group by all),
 c as (select distinct query_id from p where held = terms),
 en as (select query_id, o.element_id, qt.term, position as pos, row_number() over (partition by query_id, o.element_id order by position) as at_ from o join qt using (term) join p using (query_id, element_id) where p.held = p.terms and p.terms > 1),
 la as (select e.query_id, e.element_id, e.pos, e.at_, f.term, max(f.pos) as lp, max(f.at_) as la_ from en e join en f on e.query_id = f.query_id and e.element_id = f.element_id and f.pos <= e.pos group by all),
 lo as (select query_id, element_id, pos, at_, min(lp) as lp, min(la_) as la_, count(*) as n from la group by all), lw as (select lo.*, p.terms from lo join p using (query_id, element_id) where n = p.terms),
 cv as (select *, lp > coalesce(max(lp) over (partition by query_id, element_id order by pos rows between unbounded preceding and 1 preceding), -1) as cover from lw),
 cd as (select query_id, element_id, sum(0.1::double / (1 + (pos - lp) - (at_ - la_))) as density from cv where cover group by all),
 h as (select p.query_id, p.element_id, round(case when p.terms > 1 and held = p.terms then density else cast(0.1 * tf as double) end, 6) as score, case when held = p.terms then 'and' else 'or' end as mode from p left join cd using (query_id, element_id) where held = p.terms or query_id not in (select query_id from c)),
 fts as (select * from (select *, row_number() over (partition by query_id order by score desc, element_id) as place from h))"""
_GRAMS = "g as (select element_id, unnest(t) as gram, len(t) as grams from (select element_id, " + duck.trigrams("text_normalized") + " as t from e))"
_FUZZY = "qg as (select query_id, unnest(t) as gram, len(t) as asked from (select query_id, " + duck.trigrams("query") + """ as t from q)),
 fs as (select query_id, element_id, cast(count(*) as double) / (max(grams) + max(asked) - count(*)) as s from g join qg using (gram) group by all),
 fuz as (select query_id, element_id, round(s, 6) as similarity, row_number() over (partition by query_id order by round(s, 6) desc, element_id) as place from fs where s >= 0.18)"""
_ONE = f"q as (select 1 as query_id, {duck.search_form(duck.q(ASKED))} as query)"
_AR = "'^[\\x{0621}-\\x{064A}\\x{064B}-\\x{0652}\\x{0670}]+$'"
_W = lambda x: f"list_filter(regexp_split_to_array(coalesce({x}, ''), {duck.cls(arabic.SPACES)}), lambda w: w <> '')"
_LETT = lambda x: f"regexp_replace({x}, '[^\\x{{0621}}-\\x{{064A}}]', '', 'g')"
_FRAG = lambda x: f"(regexp_matches({x}, {_AR}) and length({_LETT(x)}) <= 2 and {_LETT(x)} not in ({', '.join(duck.q(w) for w in ranking.SHORT_WORDS)}))"
_LONE = "(" + ", ".join(duck.q(w) for w in ranking.LONE_PUNCTUATION) + ")"
_TRIM = lambda x: f"regexp_replace(coalesce({x}, ''), {duck.cls('^' + arabic.SPACES + '|' + arabic.SPACES + '$')}, '', 'g')"
_BOIL = " + ".join(f"(case when contains(s, {duck.q(p)}) then {len(p.split())} else 0 end)" for p in ranking.BOILERPLATE)
_SIGNALS = f"""sg as (select *, {_W('text_normalized')} as t, {_TRIM('text_normalized')} as s from {{0}}),
 sig as (select *, list_value({', '.join(duck.q(w) for w in ASKED.split())}) as qw,
  case when s = '' then 0.0 else round(greatest(0.0, 1.0 - (case when t[1] in ('،', 'و', 'ف', ':', '(', ')') then 0.35 else 0 end) - (case when right(s, 1) in ('.', '؟', '!', '۔') then 0 else 0.25 end)
   - (case when len(t) < 5 then 0.25 else 0 end) - (case when length(replace(t[-1], 'ـ', '')) <= 2 and regexp_matches(replace(t[-1], 'ـ', ''), {_AR}) then 0.15 else 0 end)), 4) end as completeness,
  case when len(t) <= 3 then 0.0 when len(t) < 8 then round((len(t) - 3) / 5 * 0.6, 4) when len(t) <= 30 then 1.0 else round(greatest(0.6, 1 - (len(t) - 30) / 60), 4) end as length_prior,
  case when s = '' then 0.0 else round(greatest(0.0, 1 - least(1.0, ({_BOIL}) / len(t))), 4) end as informativeness from sg)"""

SQL = {
    "full_text_hits": f"{_E}, {_Q}, {_POST}, {_FTS.replace('order by score desc, element_id) as place from h)', 'order by score desc, page_id, element_order, element_id) as place from h join (select element_id, page_id, element_order from e) using (element_id))')} select query_id, element_id, score, mode, cast(place as int) as place from fts where place <= 20",
    "postings_totals": f"{_E}, {_POST} select term, count(*) as records, cast(sum(tf) as bigint) as occurrences, max(tf) as most from i group by term",
    "fuzzy_hits": f"{_E}, {_Q}, {_GRAMS}, {_FUZZY} select query_id, element_id, similarity, cast(place as int) as place from fuz where place <= 20",
    "fuzzy_titles": f"with g as (select book_id, unnest(t) as gram, len(t) as grams from (select book_id, {duck.trigrams('title')} as t from books)), s as (select b.book_id as query_id, a.book_id, cast(count(*) as double) / (max(a.grams) + max(b.grams) - count(*)) as s from g a join g b using (gram) where b.book_id % 20 = 0 group by all), r as (select query_id, book_id, round(s, 6) as similarity, row_number() over (partition by query_id order by round(s, 6) desc, book_id) as place from s where s >= 0.18) select query_id, book_id, similarity, cast(place as int) as place from r where place <= 50",
    "trigram_shares": f"with {_Q.replace(duck.search_form('query'), 'query')}, g as (select book_id, unnest(t) as gram from (select book_id, {duck.trigrams('title')} as t from books)), qg as (select query_id, unnest(t) as gram, len(t) as asked from (select query_id, {duck.trigrams('query')} as t from q)) select query_id, book_id, round(cast(count(*) as double) / max(asked), 6) as share from g join qg using (gram) group by query_id, book_id",
    "nearest_vectors": "with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.v, q.v), 6) as similarity from v, v q where q.vec_id % 20 = 0) select query_id, vec_id, similarity, cast(place as int) as place from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as place from s where similarity > 0) where place <= 10",
    "fused_runs": """with d as (select distinct query_id, element_id, original_rank, new_rank from rerank_results), h as (select query_id, 'fts' as source, original_rank as arrival, element_id from d union all select query_id, 'semantic', new_rank, element_id from d),
 f as (select query_id, source, element_id, min(arrival) as arrival, count(*) as times from h group by all), r as (select *, row_number() over (partition by query_id, source order by arrival, element_id) as rank from f)
 select query_id, element_id, round(sum((case source when 'fts' then 1.0::double else 0.8::double end) / (60 + rank)), 8) as rrf, array_to_string(list_sort(list(source)), ',') as sources, cast(sum(times) as bigint) as hit_count, array_to_string(list_sort(list(source || ': ' || rank || ' -> ' || printf('%.6f', (case source when 'fts' then 1.0::double else 0.8::double end) / (60 + rank)))), ' | ') as ranks from r group by query_id, element_id""",
    "source_counts": "with d as (select distinct query_id, element_id, original_rank, new_rank from rerank_results) select query_id, s as source, count(*) as hits from d, (values ('fts'), ('semantic')) v(s) group by all",
    "boosted_titles": f"select book_id, round(case when contains(title, 'الصلاة') then 1.5 when contains({duck.search_form('title')}, 'الصلاه') then 1.15 else 1.0 end, 6) as boosted, round(case when len({_W('short_title')}) < 3 then 1 - 0.4 * (1 - greatest(0.1, len({_W('short_title')}) / 3)) else 1.0 end, 6) as penalised from books",
    "rank_movement": """with l as (select query_id, element_id, original_score, cross_score from (select *, row_number() over (partition by query_id, element_id order by scored_at desc) as k from rerank_results) where k = 1),
 b as (select *, row_number() over (partition by query_id order by original_score desc, element_id) as pb from l), a as (select *, row_number() over (partition by query_id order by pb > 20, case when pb <= 20 then -coalesce(cross_score, -1e300) else pb end, element_id) as pa from b)
 select query_id, element_id, cast(pb as int) as place_before, cast(pa as int) as place_after, cast(pb - pa as int) as moved from a""",
}
# RE2 has no lookahead: what follows the piece is taken along and put back.
_CLEAN = "regexp_replace(replace(coalesce(text_raw, ''), 'ـ', ''), '([\\x{0621}-\\x{064A}][\\x{064B}-\\x{0652}\\x{0670}])\\s+([\\x{0621}-\\x{064A}]{1,2})(\\s|$|[^\\x{0621}-\\x{064A}])', '\\1\\2\\3', 'g')"
_OCR = f"""c0 as (select element_id, coalesce(text_raw, '') as raw, text_normalized, {_CLEAN} as clean from e),
 c1 as (select *, {_W('clean')} as t, length(raw) - length(replace(raw, 'ـ', '')) as tatweel from c0),
 c2 as (select *, list_transform(list_filter(t, lambda w: regexp_matches(w, {_AR})), lambda w: length({_LETT('w')})) as sizes from c1),
 c3 as (select *, len(t) as n, list_sum(sizes) as s1, list_sum(list_transform(sizes, lambda x: x * x)) as s2, len(sizes) as m from c2),
 c4 as (select element_id, text_normalized, case when length(raw) = 0 or n = 0 then 0.0 else round(greatest(0.0, 1 - least(1.0, tatweel / length(raw) * 0.7 + len(list_filter(t, lambda w: {_FRAG('w')})) / n * 1.4
   + len(list_filter(range(2, n), lambda i: t[i] in {_LONE} and ({_FRAG('t[i - 1]')} or {_FRAG('t[i + 1]')}) and regexp_matches(t[i - 1], {_AR}) and regexp_matches(t[i + 1], {_AR}))) / n * 2.2
   + least(1.0, len(regexp_extract_all(clean, 'االله|ا\\sالله')) / n * 4) * 1.2 + len(list_filter(t, lambda w: w in {_LONE})) / n * 0.45
   + case when m >= 4 then least(1.0, (s2 / m - (s1 / m) * (s1 / m)) / 12) else 0 end * 0.25)), 4) end as quality from c3),
 ocr as (select element_id as oe, case when regexp_matches(text_normalized, '[.\\x{{2024}}\\x{{2026}}]{{4,}}|(\\.\\s){{4,}}') or regexp_matches(text_normalized, '[0-9\\x{{0660}}-\\x{{0669}}\\x{{06F0}}-\\x{{06F9}}\\s.\\x{{0640}}-]{{12,}}$') then least(quality, 0.15) else quality end as ocr_quality from c4)"""
_SIG = _OCR + ", " + _SIGNALS.replace("{0}", "e") + """, sx as (select sig.*, ocr_quality, round(len(list_filter(qw, lambda w: list_contains(t, w))) / len(qw), 4) as coverage,
  case when len(t) > 0 then round(least(1.0, len(list_filter(t, lambda w: list_contains(qw, w))) / len(t) / 0.25), 4) else 0.0 end as density from sig join ocr on element_id = oe),
 sz as (select *, round(coverage * 0.008 + completeness * 0.004 + density * 0.002 + length_prior * 0.008 + informativeness * 0.006 - (1 - ocr_quality) * 0.010, 8) as graded from sx)"""
SQL["element_signals"] = f"{_E}, {_SIG} select element_id, ocr_quality, coverage, completeness, density, length_prior, informativeness, graded from sz"
_LB = "case element_type " + " ".join(f"when '{k}' then {v}" for k, v in ranking.LAYOUT_BONUS.items()) + " else 0.0 end"
_PHRASES = [ASKED, *[" ".join(ASKED.split()[i : i + m]) for m in (2, 3, 4) for i in range(len(ASKED.split()) - m + 1)]][:4]
_RERANK = f"case when contains(text_normalized, query) then 0.010 else 0 end + least(0.012, " + " + ".join(f"case when contains(text_normalized, {duck.search_form(duck.q(p))}) then 0.004 else 0 end" for p in _PHRASES) + ")"
_RANK = f"""{_POST}, {_FTS}, {_GRAMS}, {_FUZZY}, hh as (select query_id, 'fts' as source, place, element_id from fts where place <= 200 union all select query_id, 'fuzzy', place, element_id from fuz where place <= 200),
 rr as (select *, row_number() over (partition by query_id, source order by place, element_id) as rank from hh), ff as (select query_id, element_id as fe, sum((case source when 'fts' then 1.0::double else 0.7::double end) / (60 + rank)) as rrf, count(*) as engines from rr group by all),
 {_SIG}, j as (select ff.query_id, sz.*, rrf, engines, query, len({_W('text_raw')}) as n from ff join sz on fe = element_id join q using (query_id)),
 b as (select *, rrf + graded + (case when text_normalized = query then 0.030 when contains(text_normalized, query) then 0.012 else 0 end) + least(6, len(list_intersect(list_distinct(t), list_distinct(string_split(query, ' '))))) * 0.002 + least(engines, 3) * 0.004
   + (case when contains(text_raw, {duck.q(ASKED)}) then 0.020 else 0 end) + {_LB} as base, {_RERANK} as again from j),
 sc as (select *, round(greatest(0.0, base - case when n < 3 then base * 0.5 * (1 - greatest(0.1, n / 3)) else 0 end), 8) as score from b),
 pl as (select *, round(score + again, 8) as reranked, row_number() over (partition by query_id, page_id order by score desc, n desc, coalesce(page_number, 0) desc, element_id) > 3 as deferred from sc),
 fp as (select *, row_number() over (partition by query_id order by deferred, reranked desc, n desc, coalesce(page_number, 0) desc, element_id) as final_place from pl)"""
_E1 = f"{_E}, {_ONE}"
SQL["ranked_hits"] = f"{_E1}, {_RANK} select query_id, element_id, round(score, 6) as score, round(reranked, 6) as reranked, deferred from fp where final_place <= 50"
SQL["pruned_hits"] = f"{_E1}, {_RANK}, rt as (select *, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0 end as ratio from fp where final_place <= 1000), kr as (select *, case when coalesce(text_normalized, '') = '' then 'empty' when ratio < 0.08 then 'below_relative_threshold' when not contains(coalesce(text_normalized, ''), query) and len(list_filter(list_filter(string_split(coalesce(text_normalized, ''), ' '), lambda w: w <> ''), lambda w: not {_GENERIC('w')})) = 0 and ratio < 0.55 then 'generic_phrase' end as why from rt), ks as (select *, why is null as passes from kr), kk as (select *, case when bool_or(passes) over (partition by query_id) then passes else row_number() over (partition by query_id order by score desc, element_id) <= 10 end as kept from ks) select query_id, element_id, round(round(ratio, 6), 4) as ratio, kept, case when not kept then why end as reason from kk"
