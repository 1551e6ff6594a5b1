"""Queries from questions to reports over the results of every query, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic, scoring
from scriptorium.operators import answers, corpus, reasoning, search, structure
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import _words
from scriptorium.plans.store_queries import _HITS, _contains_any, _hits, _splits
from scriptorium.sources.tables import table


def _bundle(spark, d):
    return reasoning.evidence(_hits(spark, d))


def _confidences(bundle):
    return bundle.select("query_id").distinct().withColumn("intent_confidence", (F.col("query_id") % 10) / 10)


def _parts(spark, d):
    bundle = _bundle(spark, d)
    conf = _confidences(bundle)
    verdicts = reasoning.verdicts(bundle, conf)
    told = answers.checks(verdicts, conf)
    return bundle, verdicts, told, answers.composed(verdicts, told), answers.apparent_conflicts(bundle)


def title_queries(spark, d):
    """Every title read as a query."""
    b = table(spark, d, "books")
    f = b.select("book_id", answers.query_forms(F.col("title")).alias("f"))
    return f.select("book_id", "f.search_form", F.size("f.tokens").alias("words"), F.array_join("f.phrases", "|").alias("phrases"))


def title_candidates(spark, d):
    """Candidate questions of every title whose book_id is divisible by 20: itself and its words' neighbours."""
    q = table(spark, d, "books").filter("book_id % 20 = 0").select(F.col("book_id").alias("query_id"), F.col("title").alias("query"))
    near = corpus.neighbours(corpus.context_statistics(_words(spark, d)).groupBy("token", "neighbour").agg(F.sum("frequency").alias("frequency")).withColumn("side", F.lit("any")))
    none = spark.createDataFrame([], "query_id long, rank int, text string")
    return answers.candidate_queries(q, none, near)


def query_checks(spark, d):
    return _parts(spark, d)[2]


def query_answers(spark, d):
    return _parts(spark, d)[3]


def query_conflicts(spark, d):
    """Opposed sayings among the texts admitted for each query."""
    b = _bundle(spark, d).filter("admitted")
    c = reasoning.conflicts(b.select("query_id", F.col("element_id").alias("id"), "text"))
    told = F.array_join(F.transform("reconciliations", lambda r: F.concat_ws(":", r["kind"], r["confidence"].cast("string"))), "|")
    return c.withColumn("reconciliations", told)


def conflict_types(spark, d):
    b = _bundle(spark, d).filter("admitted")
    return reasoning.conflict_report(reasoning.conflicts(b.select("query_id", F.col("element_id").alias("id"), "text")))


def _chains(spark, d):
    b = _bundle(spark, d).filter("admitted").select("query_id", "element_id", "text")
    return b.select("query_id", F.explode(structure.chain_names(structure.split_report(F.col("text"))["isnad"])).alias("name"))


def narrator_counts(spark, d):
    """The narrators that the texts admitted for each query name most often."""
    return answers.narrator_counts(_chains(spark, d))


def query_reports(spark, d):
    """Every query's report, a row a line."""
    bundle, _, told, composed, conflicts = _parts(spark, d)
    n = answers.narrator_counts(_chains(spark, d), 10)
    lines = n.select("query_id", F.col("place").alias("ord"), F.concat("name", F.lit(" (ورد "), F.col("occurrences").cast("string"), F.lit(" مرة)")).alias("line"))
    return answers.report(composed, bundle, told, conflicts, lines)


def hit_texts(spark, d):
    """What a reranker reads of every hit, its plain citation, and how each source's weight counts."""
    h = _hits(spark, d)
    return h.select("query_id", "element_id", F.sha1(scoring.document_text(F.col("title"), F.substring("text", 1, 40), F.col("text"))).alias("read"), scoring.plain_citation(F.coalesce("title", F.lit("?")), F.col("volume_number"), F.col("page_number")).alias("citation"))


def _asked(spark, d):
    from scriptorium.plans.store_queries import _elements

    e = _elements(spark, d, "page_id", "book_id", "volume_number", "page_number", "element_type", "text_raw", "text_normalized")
    b = table(spark, d, "books")
    q = b.filter("book_id % 20 = 0").select(F.col("book_id").alias("query_id"), F.col("title").alias("query"))
    return e, b.select("book_id", "title"), q


def search_results(spark, d):
    """The first results of every title whose book_id is divisible by 20, against all elements."""
    e, _, q = _asked(spark, d)
    return search.search(e, q).select("query_id", "element_id", "place", F.round("score", 6).alias("score"), F.round("reranked", 6).alias("reranked"), "deferred")


def title_answers(spark, d):
    """The same titles asked from intent to answer."""
    stages = search.answered(*_asked(spark, d))
    return stages["answers"].join(stages["intents"].select(F.col("query_id").alias("q"), "intent"), F.col("query_id") == F.col("q")).drop("q")


QUERIES = {f.__name__: f for f in (title_queries, title_candidates, query_checks, query_answers, query_conflicts, conflict_types, narrator_counts, query_reports, hit_texts, search_results, title_answers)}

# ------------------------------------------------------------------------------------------------------------- SQL
_M = answers.MISSING
_FLAT = duck.rep("text", arabic.SPACES, " ")
_CITE = f"""{_HITS}, fl as (select *, {_FLAT} as body from ev)"""
_PAIRS = ", ".join(f"max(case when citable and contains(body, {duck.q(a)}) and not contains(body, {duck.q(b)}) then 1 else 0 end) * max(case when citable and contains(body, {duck.q(b)}) and not contains(replace(body, {duck.q(b)}, ''), {duck.q(a)}) then 1 else 0 end) as x{i}" for i, (a, b) in enumerate(reasoning.CONTRADICTIONS))
_VERDICT = f"""{_CITE}, p as (select query_id, sum(cast(admitted as int)) as items, sum(cast(citable as int)) as citable, count(distinct case when citable then (book_id, page_number) end) as ds, coalesce(avg(case when citable then ocr_quality end), 0) as quality, {_PAIRS} from fl group by query_id),
 c as (select *, {' + '.join(f'x{i}' for i in range(len(reasoning.CONTRADICTIONS)))} as conflicts, (query_id % 10) / 10 as ic from p),
 f as (select *, round(ic * 0.25 + least(1.0, citable / 2) * 0.25 + least(1.0, ds / 2) * 0.2 + quality * 0.2 + (case when conflicts > 0 then 0.4 else 1.0 end) * 0.1 + 1e-9, 4) as confidence, round(quality + 1e-9, 4) as q4 from c),
 v as (select *, case when conflicts > 0 then 'needs_review' when confidence >= 0.7 and citable >= 2 and ds >= 2 then 'answerable' when confidence >= 0.5 and citable >= 1 then 'partial' else 'insufficient' end as verdict from f),
 ck as (select query_id, 1 as ord, '{answers.CHECKS[0]}' as name, ic >= 0.4 as passed, 'ثقة النية ' || printf('%.2f', ic::double) as detail, '{_M['intent']}' as m from v union all select query_id, 2, '{answers.CHECKS[1]}', citable >= 2, citable::bigint || ' دليلاً صالحاً من ' || items::bigint, '{_M['citable']}' from v
  union all select query_id, 3, '{answers.CHECKS[2]}', ds >= 2, ds || ' موضعاً مستقلاً', '{_M['distinct']}' from v union all select query_id, 4, '{answers.CHECKS[3]}', q4 >= 0.5, 'متوسط جودة المسح ' || printf('%.2f', q4), '{_M['quality']}' from v
  union all select query_id, 5, '{answers.CHECKS[4]}', conflicts = 0, case when conflicts = 0 then 'لا تعارض ظاهر' else conflicts || ' تعارض محتمل' end, null from v),
 ms as (select query_id, string_agg(m, '; ' order by ord) as said from ck where not passed and m is not null group by 1),
 an as (select v.query_id, verdict in ('answerable', 'partial') and citable > 0 as answered, verdict, confidence, citable, coalesce(said, '') as said from v left join ms using (query_id)),
 ab as (select query_id, answered, verdict, confidence, case when answered then citable::bigint else 0 end as citations, case when answered then concat_ws('; ', case when verdict = 'partial' then '{answers.INCOMPLETE}' end, nullif(said, '')) else '' end as caveats, case when answered then '' else coalesce(nullif(said, ''), '{answers.NO_EVIDENCE}') end as refusal from an)"""
_STOPS = ", ".join(duck.q(w) for w in reasoning.TOPIC_STOPS)
_OPPOSED = sorted({x for a, b, _ in reasoning.OPPOSITES for x in (a, b)})
_Q, _I = duck.q("[\\x{0660}-\\x{0669}0-9]+|كرّ|كر|رطل|مدّ|مد|صاع"), duck.q(reasoning.IMAMS)
_has = lambda c, m: f"contains({c}, {duck.q(m)})"
_CONFLICTS = f"""{_CITE}, it as (select query_id, element_id as id, body from fl where admitted and {_contains_any('body', _OPPOSED)}), wd as (select *, list_distinct(list_filter(string_split(body, ' '), lambda w: length(w) > 2 and w not in ({_STOPS}))) as ws from it),
 pa as (select a.query_id, a.id as ia, b.id as ib, a.body as ta, b.body as tb, list_sort(list_intersect(a.ws, b.ws)) as shared from wd a join wd b on a.query_id = b.query_id and a.id < b.id), po as (select * from pa where len(shared) >= 3),
 op as (select *, case {' '.join(f"when {_has('ta', l)} and not {_has('ta', r)} and {_has('tb', r)} then {2 * i} when {_has('tb', l)} and not {_has('tb', r)} and {_has('ta', r)} then {2 * i + 1}" for i, (l, r, _) in enumerate(reasoning.OPPOSITES))} end as o,
  {_contains_any('ta', reasoning.SPECIFIERS)} <> {_contains_any('tb', reasoning.SPECIFIERS)} as sp, list_sort(list_distinct(regexp_extract_all(ta, {_Q}))) <> list_sort(list_distinct(regexp_extract_all(tb, {_Q}))) as qu, list_sort(list_distinct(regexp_extract_all(ta, {_I}))) as ma, list_sort(list_distinct(regexp_extract_all(tb, {_I}))) as mb from po),
 oz as (select *, o // 2 as k, o % 2 = 1 as swap, len(ma) > 0 and len(mb) > 0 and ma <> mb as im from op where o is not null),
 oy as (select *, ([{', '.join(f"'{k}'" for _, _, k in reasoning.OPPOSITES)}])[k + 1] as type, concat_ws('|', case when sp then 'general_specific:0.55' end, case when qu then 'absolute_restricted:0.45' end, case when im then 'different_case:0.4|taqiyya:0.2' end) as h from oz),
 cf as (select query_id, case when swap then ib else ia end as left_id, case when swap then ia else ib end as right_id, type, ([{', '.join(duck.q(a) for a, _, _ in reasoning.OPPOSITES)}])[k + 1] as left_marker, ([{', '.join(duck.q(b) for _, b, _ in reasoning.OPPOSITES)}])[k + 1] as right_marker, array_to_string(shared[1:3], ' ') as topic,
  case when h <> '' then h when type = 'purity' then 'different_case:0.35' else 'unresolved:0.0' end as reconciliations from oy)"""
_NAMES = f"{_HITS}, q0 as (select query_id, element_id, text as raw from ev where admitted), {_splits('q0')}, nn as (select query_id, unnest(names) as name from sl), nc as (select query_id, name, count(*) as occurrences, row_number() over (partition by query_id order by count(*) desc, name) as place from nn group by query_id, name)"
_FORM = duck.search_form("title")

SQL = {
    "title_queries": f"with f as (select book_id, {_FORM} as search_form from books), g as (select *, list_filter(string_split(search_form, ' '), lambda w: w <> '') as t from f), h as (select book_id, search_form, len(t) as words, list_concat([search_form], {', '.join(f'list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], chr(32)))' for n in (2, 3, 4))}) as l from g) select book_id, search_form, words, array_to_string(list_filter(l, lambda p, i: p <> '' and list_position(l, p) = i), '|') as phrases from h",
    "query_checks": f"{_VERDICT} select query_id, ord, name, passed, detail, case when not passed then m end as missing from ck",
    "query_answers": f"{_VERDICT} select * from ab",
    "query_conflicts": f"{_CONFLICTS} select * from cf",
    "conflict_types": f"{_CONFLICTS} select type, count(*) as conflicts, sum(case when reconciliations <> 'unresolved:0.0' then 1 else 0 end)::bigint as with_suggestion from cf group by 1",
    "narrator_counts": f"{_NAMES} select query_id, name, occurrences, place from nc where place <= 20",
    "query_reports": f"""{_NAMES}, {_VERDICT.removeprefix('with ' + _HITS.removeprefix('with '))[2:]}, cp as (select query_id, {', '.join(f'max(case when citable and contains(body, {duck.q(a)}) and not contains(body, {duck.q(b)}) then 1 else 0 end) * max(case when citable and contains(body, {duck.q(b)}) and not contains(replace(body, {duck.q(b)}, chr(0)), {duck.q(a)}) then 1 else 0 end) as x{i}' for i, (a, b) in enumerate(reasoning.CONTRADICTIONS))} from fl group by query_id),
 cl as ({' union all '.join(f"select query_id, {i + 1} as ord, 'تعارض ظاهر بين «{a}» و«{b}»' as line from cp where x{i} = 1" for i, (a, b) in enumerate(reasoning.CONTRADICTIONS))}),
 ra as (select *, row_number() over (partition by query_id order by score desc, element_id) as place from (select * from ev where citable and query_id in (select query_id from ab where answered))), rr as (select *, row_number() over (partition by query_id order by score desc, element_id) as place from ev where rejected),
 rp as (select query_id, 1 as s, 1 as ord, case when answered then 'وُجدت ' || citations || ' شواهد موثّقة تجيب عن السؤال.' else 'لم تكف الأدلة لإجابة موثّقة. ' || refusal end as line from ab
  union all select query_id, 2, place, concat_ws(' ', coalesce(title, 'مصدر غير مسمّى'), case when coalesce(volume_number, 0) <> 0 then 'ج' || volume_number end, case when coalesce(page_number, 0) <> 0 then 'ص' || page_number end) || ' — ' || substr(text, 1, 150) from ra where place <= 8
  union all select query_id, 3, place, name || ' (ورد ' || occurrences || ' مرة)' from nc where place <= 10 union all select query_id, 4, ord, line from cl union all select query_id, 5, ord, m from ck where not passed and m is not null
  union all select query_id, 5, place + 100, 'عنصر ' || element_id || ' استُبعد: جودة المسح ' || printf('%.2f', coalesce(ocr_quality, 0.0)) || ' دون العتبة' from rr where place <= 5
  union all select query_id, 6, ord, name || ': ' || detail || ' (' || case when passed then '{answers.PASSED}' else '{answers.FAILED}' end || ')' from ck)
 select query_id, ([{', '.join(duck.q(x) for x in answers.SECTIONS)}])[s] as section, ord, line from rp""",
    "hit_texts": f"{_HITS} select query_id, element_id, sha1(trim(concat_ws(' ', nullif(title, ''), nullif(substr(text, 1, 40), ''), nullif(text, '')), ' ')) as read, concat_ws(' ', coalesce(title, '?'), 'ج' || volume_number, 'ص' || page_number) as citation from h",
}
