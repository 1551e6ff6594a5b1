"""Queries over text forms and the learned corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.operators import corpus
from scriptorium.plans import duck
from scriptorium.sources.tables import table

FORMS = [
    ("عَلَم", "عَلَم"), ("عَلَم", "علم"), ("مسؤول", "مسئول"), ("إسماعيل", "اسماعيل"), ("صلاة", "صلاه"), ("الوضوء", "بالوضوء"), ("والوضوء", "وضوء"),
    ("کتاب", "كتاب"), ("كــتــاب", "كتاب"), ("علي", "عمر"), ("حسن", "حسين"), ("١٤٢٣", "1423"), ("", "علم"),
]


def _elements(spark, d, *columns):
    return corpus.current_elements(table(spark, d, "page_elements"), *columns)


def _words(spark, d):
    """(element_id, tokens) of the normalised text of each element."""
    e = _elements(spark, d, "text_normalized").filter("text_normalized is not null")
    return e.select("element_id", F.filter(F.split("text_normalized", " "), lambda w: w.rlike("[\\p{L}\\p{N}]")).alias("tokens"))


def element_lines(spark, d):
    return corpus.lines(_elements(spark, d, "text_raw"), "element_id", "text_raw")


def document_chunks(spark, d):
    return corpus.chunks(table(spark, d, "documents"), "doc_id", "text")


def search_forms(spark, d):
    return _elements(spark, d, "text_raw").filter("text_raw is not null").select("element_id", arabic.search_form(F.col("text_raw")).alias("form"))


def retrieval_forms(spark, d):
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    return e.select("element_id", arabic.canonical_form(F.col("text_raw")).alias("canonical"), arabic.retrieval_form(F.col("text_raw")).alias("retrieval"), arabic.diacritic_ratio(F.col("text_raw")).alias("ratio"))


def title_forms(spark, d):
    b = table(spark, d, "books")
    t = F.col("title")
    return b.select(
        "book_id", arabic.slugify(t).alias("slug_made"), arabic.infer_language(t).alias("inferred"), arabic.clip_text(t, 20).alias("clipped"),
        arabic.match_key(t).alias("key"), arabic.lexicon_key(t).alias("lexicon"), arabic.layout_form(t).alias("layout"), arabic.surface_form(t).alias("surface"),
    )


def narrator_name_lists(spark, d):
    n = table(spark, d, "narrators").select("id", "canonical_name").distinct()
    return n.select("id", F.explode(arabic.split_names(F.col("canonical_name"))).alias("name")).distinct()


def word_matches(spark, d):
    """Fixture: match strengths of word pairs."""
    pairs = spark.createDataFrame(FORMS, "query string, target string")
    s = arabic.match_strength(F.col("query"), F.col("target"))
    return pairs.select("query", "target", s.alias("strength"), arabic.strength_weight(s).alias("weight"))


def word_stems(spark, d):
    words = _words(spark, d).select(F.explode("tokens").alias("word")).distinct()
    return words.select("word", arabic.light_stem(F.col("word")).alias("stem"))


def phrase_match(spark, d):
    """Score of a fixed phrase on every element: the mean over its words of the best match."""
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    return corpus.phrase_match(e, "element_id", "text_raw", "أبواب أحكام الصلاة").select("element_id", "score", "matched")


def quality_classes(spark, d):
    e = _elements(spark, d, "text_raw")
    total = e.agg(F.count("*")).scalar()
    return e.select(corpus.quality_class(F.col("text_raw")).alias("class")).groupBy("class").agg(F.count("*").alias("elements"), F.round(100.0 * F.count("*") / F.max(total), 4).alias("percent"))


def exact_duplicates(spark, d):
    return corpus.exact_duplicates(_elements(spark, d, "text_raw"), "element_id", "text_raw")


def stale_elements(spark, d):
    """Null-safe version filter: what the current canonicaliser has not made."""
    e = _elements(spark, d, "text_raw", "text_normalized", "canonicalizer_version")
    return e.filter(F.col("text_normalized").isNull() | ~F.col("canonicalizer_version").eqNullSafe("1.0.0")).select("element_id", "canonicalizer_version", F.coalesce(F.nullif("text_normalized", F.lit("")), F.nullif("text_raw", F.lit("")), F.lit("")).alias("text"))


def token_statistics(spark, d):
    return corpus.token_statistics(_words(spark, d))


def phrase_statistics(spark, d):
    return corpus.phrase_statistics(_words(spark, d)).filter("frequency >= 2")


def context_neighbours(spark, d):
    return corpus.neighbours(corpus.context_statistics(_words(spark, d))).filter("place <= 5")


def phrase_suggestions(spark, d):
    return corpus.suggested_phrases(corpus.phrase_statistics(_words(spark, d)), "عبد الرحيم")


def entity_totals(spark, d):
    e = table(spark, d, "entity_candidates").select("candidate_id", "label", "frequency", "score", "element_id").distinct()
    per = e.withColumn("document_frequency", F.lit(1))
    return corpus.deduplicated_entities(per)


def hashed_vectors(spark, d):
    v = corpus.hashed_dimensions(_words(spark, d), "element_id")
    return v.withColumn("weight", F.round("weight", 6))


def label_centroids(spark, d):
    return corpus.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumn("weight", F.round("weight", 5))


QUERIES = {
    f.__name__: f
    for f in (
        element_lines, document_chunks, search_forms, retrieval_forms, title_forms, narrator_name_lists, word_matches, word_stems, phrase_match, quality_classes,
        exact_duplicates, stale_elements, token_statistics, phrase_statistics, context_neighbours, phrase_suggestions, entity_totals, hashed_vectors, label_centroids,
    )
}

ELEMENTS = "e as (select * from (select *, row_number() over (partition by element_id order by updated_at desc nulls last) as rn from page_elements) where rn = 1)"
WORDS = f"with {ELEMENTS}, w as (select element_id, list_filter(string_split(text_normalized, ' '), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as tokens from e where text_normalized is not null)"
_B = duck.cls(corpus.BLANKS)


def _nonblank(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {_B}), lambda x: x <> '')"



_PHR = WORDS + """, p as (select element_id, n, unnest(list_transform(range(1, len(tokens) - n + 2), lambda i: array_to_string(list_slice(tokens, i, i + n - 1), ' '))) as phrase
  from w, range(2, {0}) r(n) where len(tokens) >= n),
 t as (select phrase, cast(n as int) as n, count(*) as frequency, count(distinct element_id) as document_frequency from p group by all)"""


def _match(q: str, t: str) -> str:
    c1, c2, r1, r2 = duck.canonical_form(q), duck.canonical_form(t), duck.retrieval_form(q), duck.retrieval_form(t)
    return f"(select {q} as q0, {t} as t0, {c1} as c1, {c2} as c2, {r1} as r1, {r2} as r2)"


_STRENGTH = (
    "case when q0 = '' or t0 = '' then 'none' when q0 = t0 then 'exact' when c1 = c2 then 'canonical' when r1 = r2 then 'unvocalised' "
    f"when {duck.light_stem('r1')} = {duck.light_stem('r2')} and length({duck.light_stem('r1')}) >= 3 then 'stem' else 'none' end"
)
_WEIGHT = "case s when 'exact' then 1.0 when 'canonical' then 0.92 when 'unvocalised' then 0.7 when 'stem' then 0.45 else 0.0 end"
_VALUES = ", ".join(f"({duck.q(a)}, {duck.q(b)})" for a, b in FORMS)
_LIST = lambda ws: "[" + ", ".join(duck.q(w) for w in dict.fromkeys(corpus._keys(ws))) + "]"

SQL = {
    "element_lines": f"with {ELEMENTS} select element_id, cast(i as int) as line_order, line, len({_nonblank('line')}) as words, length(line) as characters from (select element_id, generate_subscripts(string_split(text_raw, chr(10)), 1) as i, unnest(string_split(text_raw, chr(10))) as line from e where text_raw is not null) where length(trim(line)) > 0",
    "document_chunks": "with s as (select doc_id, text, unnest(range(0, length(text), 800)) as start from documents where length(text) > 0), c as (select doc_id, start, substr(text, cast(start as int) + 1, 1000) as chunk from s) select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as int) as chunk_order, cast(start as int) as start, chunk from c where length(trim(chunk)) > 0",
    "search_forms": f"with {ELEMENTS} select element_id, {duck.search_form('text_raw')} as form from e where text_raw is not null",
    "retrieval_forms": f"with {ELEMENTS} select element_id, {duck.canonical_form('text_raw')} as canonical, {duck.retrieval_form('text_raw')} as retrieval, case when len(regexp_extract_all(text_raw, '[\\x{{0621}}-\\x{{064A}}]')) > 0 then round(least(1.0, len(regexp_extract_all(text_raw, {duck.cls(arabic.HARAKAT)})) / len(regexp_extract_all(text_raw, '[\\x{{0621}}-\\x{{064A}}]'))), 4) else 0.0 end as ratio from e where text_raw is not null",
    "title_forms": "with t as (select book_id, title, " + duck.collapse("title") + " as flat from books) select book_id, " + f"coalesce(nullif(regexp_replace(regexp_replace(lower({duck.tr('title', arabic.SHAPES_FROM, arabic.SHAPES_TO)}), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') as slug_made, case when trim(title) = '' then 'ar' when len(regexp_extract_all(title, '[\\x{{0600}}-\\x{{06FF}}]')) = 0 and len(regexp_extract_all(title, '[A-Za-z]')) = 0 then 'und' when len(regexp_extract_all(title, '[\\x{{0600}}-\\x{{06FF}}]')) >= len(regexp_extract_all(title, '[A-Za-z]')) then 'ar' else 'en' end as inferred, case when length(flat) <= 20 then flat else rtrim(substr(flat, 1, 20)) || '…' end as clipped, {duck.match_key('title')} as key, {duck.tr(duck.match_key('title'), 'ؤئ', 'وي')} as lexicon, {duck.layout_form('title')} as layout, {duck.collapse(duck.tr(duck.rep('title', arabic.INVISIBLE), arabic.SHAPES_FROM, arabic.SHAPES_TO))} as surface from t",
    "narrator_name_lists": "select distinct id, name from (select id, unnest(list_filter(list_transform(regexp_split_to_array(canonical_name, '[،,؛;/|]'), lambda x: trim(x)), lambda x: x <> '')) as name from narrators)",
    "word_matches": f"select query, target, s as strength, {_WEIGHT} as weight from (select query, target, (select {_STRENGTH} from {_match('trim(query)', 'trim(target)')}) as s from (values {_VALUES}) v(query, target))",
    "word_stems": WORDS + f", x as (select distinct word, {duck.retrieval_form('word')} as r from (select unnest(tokens) as word from w)) select word, {duck.light_stem('r')} as stem from x",
    "phrase_match": f"with {ELEMENTS}, t as (select distinct element_id, unnest(string_split({duck.collapse('text_raw')}, ' ')) as target from e where text_raw is not null), q as (select * from (values (0, 'أبواب'), (1, 'أحكام'), (2, 'الصلاة')) v(i, query)), m as (select element_id, i, (select {_STRENGTH} from {_match('trim(query)', 'trim(target)')}) as s from t, q), b as (select element_id, i, max({_WEIGHT}) as w from m group by all) select element_id, round(avg(w), 4) as score, cast(sum(case when w > 0 then 1 else 0 end) as bigint) as matched from b group by element_id",
    "quality_classes": f"with {ELEMENTS}, t as (select trim(coalesce(text_raw, '')) as t from e), c as (select case when t = '' then 'blank' when not regexp_matches(t, '\\p{{L}}') then 'noise' when len({_nonblank('t')}) < 3 then 'short' when length(t) - length(replace(t, 'ـ', '')) > 0.25 * length(t) then 'noise' else 'clean' end as class from t) select class, count(*) as elements, round(100.0 * count(*) / (select count(*) from c), 4) as percent from c group by class",
    "exact_duplicates": f"with {ELEMENTS}, m as (select element_id as id, min(element_id) over (partition by text_raw) as first_id from e where text_raw is not null) select id, first_id from m where id <> first_id",
    "stale_elements": f"with {ELEMENTS} select element_id, canonicalizer_version, coalesce(nullif(text_normalized, ''), nullif(text_raw, ''), '') as text from e where text_normalized is null or canonicalizer_version is distinct from '1.0.0'",
    "token_statistics": WORDS + " select token, count(*) as frequency, count(distinct element_id) as document_frequency from (select element_id, unnest(tokens) as token from w) group by token",
    "phrase_statistics": _PHR.replace('{0}', '6') + " select * from t where frequency >= 2",
    "context_neighbours": WORDS + """, u as (select element_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from w),
 c as (select a.token, case when b.i < a.i then 'left' else 'right' end as side, b.token as neighbour, count(*) as frequency from u a join u b on a.element_id = b.element_id and b.i between a.i - 2 and a.i + 2 and a.i <> b.i group by all)
 select token, side, neighbour, frequency, cast(place as int) as place from (select *, row_number() over (partition by token, side order by frequency desc, neighbour) as place from c) where place <= 5""",
    "phrase_suggestions": _PHR.replace('{0}', '6') + ", s as (select *, round((case when phrase = 'عبد الرحيم' then 1.0 else 0.0 end) + (case when contains(phrase, 'عبد الرحيم') then 0.75 else 0.0 end) + ln(1 + frequency) / 8 + ln(1 + document_frequency) / 15, 6) as score from t) select * from s where score >= 0.2 order by score desc, frequency desc, phrase limit 10",
    "entity_totals": f"""with o as (select distinct candidate_id, label, frequency, score, element_id from entity_candidates), r as (select {duck.match_key('label')} as key, {duck.rep('label', '^' + arabic.SPACES + '|' + arabic.SPACES + '$')} as variant, frequency, score from o),
 p as (select key, variant, sum(frequency) as f, count(*) as d, max(score) as s from r where key <> '' group by all),
 k as (select *, row_number() over (partition by key order by variant) as place from p)
 select key, cast(sum(f) as bigint) as frequency, cast(sum(d) as bigint) as document_frequency, max(s) as score, max(struct_pack(n := length(variant), v := variant)).v as label, count(*) as variants,
  list_sort(list(variant) filter (where place <= 5)) as examples from k group by key""",
    "hashed_vectors": WORDS + """, t as (select element_id, unnest(tokens) as x from w),
 p as (select element_id, x as t, 1.0 as v from t union all select element_id, 'tri:' || substr(x, cast(i as int), 3), 0.35 from t, range(1, 2000) r(i) where length(x) >= 3 and i <= length(x) - 2),
 s as (select element_id, cast(cast('0x' || substr(sha1(t), 1, 8) as bigint) % 256 as int) as dimension, sum(cast(v as double)) as v from p group by all),
 n as (select element_id, sqrt(sum(v * v)) as norm from s group by all) select element_id, dimension, round(v / norm, 6) as weight from s join n using (element_id)""",
    "label_centroids": """with u as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dimension from embeddings), m as (select label, cast(dimension as int) as dimension, avg(cast(v as double)) as m from u group by all),
 n as (select label, sqrt(sum(m * m)) as norm from m group by all) select m.label, dimension, round(m / norm, 5) as weight from m join n on m.label is not distinct from n.label""",
}
