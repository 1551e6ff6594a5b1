"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.llm import bpe, languages, lookalikes, mixing, names, neardup, outranking, pagetext, terms
from scriptorium.sources.tables import table


def p1_found(spark, d):
    return lookalikes.lookalike_pairs(table(spark, d, "page_elements"))


def p1_forms(spark, d):
    """The one form of every text_raw and text_normalized."""
    return lookalikes.consistent_forms(table(spark, d, "page_elements"))


def p2_found(spark, d):
    return neardup.near_duplicate_pairs(table(spark, d, "page_elements"))


def p2_groups(spark, d):
    """Every block's group of near-duplicates, and its number of links."""
    return neardup.near_duplicate_groups(table(spark, d, "page_elements"))


def p3_found(spark, d):
    return terms.marked_terms(table(spark, d, "entity_candidates"))


def p3_counts(spark, d):
    return terms.term_counts(table(spark, d, "entity_candidates"))


def p5_found(spark, d):
    return outranking.best_items(table(spark, d, "rerank_results"), table(spark, d, "signal_scores"))


def p5_flows(spark, d):
    """Every item with its flows, under preference thresholds of a tenth and a half of the percentiles."""
    flows = outranking.net_flows(outranking.scored_items(table(spark, d, "rerank_results"), table(spark, d, "signal_scores")), "query_id", "element_id", outranking.CRITERIA, 0.1, 0.5)
    return flows.select("query_id", "element_id", *[F.round(c, 6).alias(c) for c in ("positive", "negative", "flow")])


def p6_found(spark, d):
    return pagetext.noise_kinds(table(spark, d, "page_elements"), table(spark, d, "books"))


def p6_display(spark, d):
    return pagetext.display_texts(table(spark, d, "page_elements"), table(spark, d, "books"))


def p7_found(spark, d):
    return names.person_pairs(table(spark, d, "narrators"))


def p7_groups(spark, d):
    """Every entry with its person."""
    return names.person_groups(table(spark, d, "narrators"))


def p8_ids(spark, d):
    return bpe.encoded(table(spark, d, "documents"))


def p9_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.reached_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return languages.corrected_labels(table(spark, d, "documents"))


def p10_stretches(spark, d):
    """Every document with its stretches, one row each."""
    return languages.stretches(table(spark, d, "documents")).select("doc_id", "told", "main", "mixed", F.explode("parts").alias("p")).select("doc_id", "told", "main", "mixed", "p.*")


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_groups, p3_found, p3_counts, p5_found, p5_flows, p6_found, p6_display, p7_found, p7_groups, p8_ids, p9_mixture, p9_shares, p10_found, p10_stretches)}

_TERMS = """with t as (select candidate_id, element_id, greatest(coalesce(frequency, 0), 0) as n,
  trim(regexp_replace(regexp_replace(label, '[\\x{064B}-\\x{065F}\\x{0670}\\x{0640}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'),
  '[\\s\\x{0085}\\p{Z}]+', ' ', 'g')) as term from entity_candidates),
 o as (select candidate_id, element_id, term, max(n) as n from t where term <> '' group by all),
 c as (select term, cast(sum(n) as bigint) as frequency, count(distinct element_id) as document_frequency from o group by term)
"""

_SCORES = """with r as (select query_id, element_id, original_score, cross_score, row_number() over (partition by query_id, element_id
   order by scored_at desc) as k from rerank_results),
 i as (select r.query_id, r.element_id, original_score as a, cross_score as b, case when isnan(ocr_quality) then null else ocr_quality end as c,
   coverage as d from r left join signal_scores s on r.query_id = s.query_id and r.element_id = s.element_id where k = 1),
 l as (select query_id, element_id, 'a' as q, a as v from i union all select query_id, element_id, 'b', b from i
   union all select query_id, element_id, 'c', c from i union all select query_id, element_id, 'd', d from i),
 m as (select query_id, element_id, q, rank() over (partition by query_id, q order by v nulls first)
   + (count(*) over (partition by query_id, q, v) - 1) / 2.0 as mid, count(*) over (partition by query_id, q) as n from l),
 f as (select query_id, element_id, (sum(mid) - 2.0 * (max(n) + 1)) / (max(n) - 1) as flow from m group by query_id, element_id)
"""

SQL = {
    "p3_counts": _TERMS + "select term, frequency, document_frequency from c",
    "p3_found": _TERMS + """, n as (select count(distinct element_id) as total from o)
 select term, mark from (select term, case when document_frequency > 0.05 * total then 'common'
  when document_frequency < 3 or frequency < 5 then 'rare' end as mark from c, n) where mark is not null""",
    "p5_flows": _SCORES.replace("f as (", "pr as (select x.query_id, x.element_id, least(greatest(((x.mid - y.mid) / x.n - 0.1) / 0.4, 0), 1) as up, least(greatest(((y.mid - x.mid) / x.n - 0.1) / 0.4, 0), 1) as down, x.n from m x join m y on x.query_id = y.query_id and x.q = y.q), f as (")
    + " select query_id, element_id, round(sum(up) / (max(n) - 1), 6) as positive, round(sum(down) / (max(n) - 1), 6) as negative, round((sum(up) - sum(down)) / (max(n) - 1), 6) as flow from pr group by all",
    "p5_found": _SCORES + """select query_id, element_id from (select query_id, element_id,
  row_number() over (partition by query_id order by round(flow, 9) desc, element_id) as p from f) where p <= 3""",
}
