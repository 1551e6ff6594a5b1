"""Queries over reading and changing the store, its listings, contracts, indexes and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic, scoring
from scriptorium.operators import contracts, corpus, graph, reasoning, registry, repository
from scriptorium.operators.answers import VERSIONS
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import WORDS, _words
from scriptorium.plans.store_queries import _CONCEPTS, _E, _concepts, _edges, _elements
from scriptorium.sources.tables import table

SPLITTABLE = ["sanad", "matn"]


def books_by_language(spark, d):
    return repository.where_equal(table(spark, d, "books"), ["title", "book_id"], language="fa").select("book_id", "title", "slug")


def books_by_slug(spark, d):
    b = table(spark, d, "books")
    wanted = b.filter("book_id % 20 = 0").select("slug").unionByName(spark.createDataFrame([("no-such-slug",)], "slug string"))
    return repository.exists(b, "slug", wanted)


def titles_with(spark, d):
    b = table(spark, d, "books")
    return b.filter(repository.holds("title", "الصلاة") | repository.holds("title", "AND")).select("book_id", "title")


def page_listing(spark, d):
    """Elements of every page whose id is divisible by 20, in their order."""
    e = _elements(spark, d, "page_id", "element_order", "element_type")
    return repository.children(e, "page_id", ["element_order", "element_id"], e.filter("page_id % 20 = 0").select("page_id")).select("page_id", "element_id", "place", "element_type")


def volume_listing(spark, d):
    """Pages of every book and volume in order of their number."""
    e = _elements(spark, d, "book_id", "volume_number", "page_id", "page_number")
    pages = e.select("book_id", "volume_number", "page_id", "page_number").distinct()
    return pages.groupBy("book_id", "volume_number").agg(F.count_distinct("page_id").alias("pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def elements_of_public_books(spark, d):
    """Elements of books that are public, by book: a chain of semi-joins from the book down."""
    b, e = table(spark, d, "books"), _elements(spark, d, "book_id", "page_id")
    pages = e.select("book_id", "page_id").distinct()
    kept = repository.below_ancestor([(b, "book_id", "book_id"), (pages, "page_id", "page_id"), (e, "element_id", "")], F.col("is_public"))
    return kept.groupBy("book_id").agg(F.count("*").alias("elements"))


def part_suppliers(spark, d):
    """Suppliers of every part whose key is divisible by 20, through the lines that join them."""
    p, s, line = table(spark, d, "part"), table(spark, d, "supplier"), table(spark, d, "lineitem")
    some = p.filter("p_partkey % 20 = 0").select("p_partkey", "p_name")
    bridge = line.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    return repository.bridged(some, "p_partkey", bridge, s, "s_suppkey", "s_name").select("p_partkey", "p_name", F.array_join("s_name", ",").alias("suppliers"))


def splittable_elements(spark, d):
    """Elements of a kind that is taken apart, by kind."""
    return _elements(spark, d, "element_type").filter(F.col("element_type").isin(SPLITTABLE)).groupBy("element_type").agg(F.count("*").alias("elements"))


def deleted_elements(spark, d):
    """How many rows go, and how many stay, when the elements of the first book are deleted."""
    e = table(spark, d, "page_elements")
    stays, gone = repository.delete(e.select("element_id", "book_id"), "element_id", e.filter("book_id = 1").select("element_id"))
    return gone.select(F.lit("deleted").alias("what"), F.col("deleted").alias("rows")).unionByName(stays.agg(F.count("*").alias("rows")).select(F.lit("kept").alias("what"), "rows"))


def sampled_elements(spark, d):
    """Ten elements at random."""
    return repository.pick(_elements(spark, d, "page_id"), 7, 10, "element_id")


def record_violations(spark, d):
    """How many rows of each table break each rule of its contract."""
    parts = [contracts.violations(table(spark, d, t), rules).select(F.lit(t).alias("table"), "rule", "rows") for t, rules in contracts.CONTRACTS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def broken_elements(spark, d):
    rules = contracts.CONTRACTS["page_elements"]
    return contracts.valid(table(spark, d, "page_elements"), rules).filter(F.size("broken") > 0).select("element_id", F.array_join("broken", ",").alias("broken")).distinct()


def line_boxes(spark, d):
    """Boxes from corners, corners the wrong way round included, and whether they are boxes; the numbers are order lines'."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.box_from_corners(F.col("l_quantity"), F.col("l_discount"), F.lit(25.0), F.col("l_tax")).alias("b"))
    return line.select("l_orderkey", "l_linenumber", "b.x", F.round("b.width", 6).alias("width"), F.round("b.height", 6).alias("height"), scoring.valid_box(F.col("b")).alias("valid"), scoring.valid_span(F.col("b.x"), F.lit(10.0)).alias("span"))


def graph_nodes(spark, d):
    """Nodes of the concept graph by kind: with the same id as one, their labels the greatest."""
    c = _concepts(spark, d).select("id", F.lit("concept").alias("type"), "label")
    ends = _edges(spark, d).select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.lit("end").alias("type"), F.lit(None).cast("string").alias("label"))
    return graph.merged_nodes(c.unionByName(ends)).groupBy("type").agg(F.count("*").alias("nodes"), F.sum(F.col("label").isNotNull().cast("int")).alias("labelled"))


def concept_index(spark, d):
    """Terms that stand for more than one concept, with how many; children as the parents say."""
    return graph.term_index(_concepts(spark, d)).filter("concepts > 1")


def concept_children(spark, d):
    return graph.derived_children(_concepts(spark, d)).select("id", F.size("children").alias("children"))


def gazetteer_forms(spark, d):
    """Forms of names that stand for more than one entry."""
    n = table(spark, d, "narrators").select("id", "canonical_name", "aliases").distinct()
    forms = n.select("id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("form"))
    keyed = forms.select("id", arabic.match_key(F.col("form")).alias("key")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.count_distinct("id").alias("ids")).filter("ids > 1")


def training_summary(spark, d):
    """What there is to learn from: elements, tokens, distinct tokens, books, pages."""
    w = _words(spark, d)
    e = _elements(spark, d, "page_id", "book_id").agg(F.count("*").alias("elements"), F.count_distinct("page_id").alias("pages"), F.count_distinct("book_id").alias("books"))
    tokens = corpus.token_statistics(w).agg(F.sum("frequency").alias("tokens"), F.count("*").alias("words"))
    return e.crossJoin(tokens)  # one row each


def page_profiles(spark, d):
    """Scoped training: tokens and distinct tokens of every page of the first book."""
    w = _words(spark, d).join(_elements(spark, d, "page_id", "book_id").filter("book_id = 1").select(F.col("element_id").alias("e"), "page_id"), F.col("element_id") == F.col("e"))
    t = w.select("page_id", F.explode("tokens").alias("t"))
    return t.groupBy("page_id").agg(F.count("*").alias("tokens"), F.count_distinct("t").alias("words"))


def vector_profiles(spark, d):
    """Mean vectors of pages of vectors and, of those, of their labels, each of length 1: pages are tens of ids."""
    v = table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 10).alias("page"), "embedding")
    return corpus.nested_mean_vectors(v, "label", "page", "embedding").withColumn("weight", F.round("weight", 5))


def memory_statistics(spark, d):
    """Stored answers by verdict, and how many may be recalled."""
    e = table(spark, d, "events").select(F.when(F.col("value") > 20, "answerable").otherwise("partial").alias("verdict"), F.least(F.lit(1.0), F.col("value") / 50).alias("confidence"))
    return repository.summary(e, "verdict", {"sure": F.col("confidence") >= 0.7, "recalled": (F.col("verdict") == "answerable") & (F.col("confidence") >= 0.7)})


def metric_changes(spark, d):
    """Metrics of the new ranks against those of the original ones, lower latency being better."""
    from scriptorium.operators import learning

    r = table(spark, d, "rerank_results").select("query_id", "element_id", "original_rank", "new_rank").distinct()
    s = table(spark, d, "signal_scores").select(F.col("query_id").alias("q"), F.col("element_id").alias("e"), (F.coalesce(F.col("coverage"), F.lit(0.0)) >= 0.8).alias("relevant"))
    j = r.join(s, (F.col("query_id") == F.col("q")) & (F.col("element_id") == F.col("e")))
    now, before = (learning.metric_summary(learning.retrieval_metrics(j.select("query_id", (F.col(c) + 1).alias("place"), "relevant"))) for c in ("new_rank", "original_rank"))
    return learning.regressions(now, before, ["relevant_max"])


def name_coverage(spark, d):
    """How surely the entries of the gazetteer find themselves by their aliases."""
    n = table(spark, d, "narrators").select("id", "canonical_name", "aliases").distinct()
    forms = n.select("id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("form"), F.col("canonical_name").alias("canonical"))
    asked = n.select(F.explode("aliases").alias("name")).filter("name is not null")
    r = reasoning.resolve_names(asked, forms)
    return r.groupBy("resolution").agg(F.count("*").alias("names"), F.round(F.avg("confidence"), 4).alias("confidence"))


def version_prints(spark, d):
    """Elements by the canonicaliser that made them, against the engine's own versions."""
    e = _elements(spark, d, "canonicalizer_version")
    own = F.concat_ws(";", *[F.lit(f"{k}={v}") for k, v in VERSIONS.items()])
    return e.groupBy("canonicalizer_version").agg(F.count("*").alias("elements")).withColumn("engine", own)


def engine_status(spark, d):
    return registry.status(spark)


def backfilled_elements(spark, d):
    """Elements whose normalised text was not made by the current canonicaliser, made anew, with what changes."""
    e = _elements(spark, d, "text_raw", "text_normalized", "canonicalizer_version")
    return corpus.backfilled(e).select("element_id", F.sha1("text_normalized").alias("made"), "canonicalizer_version", "changed")


QUERIES = {
    f.__name__: f
    for f in (
        books_by_language, books_by_slug, titles_with, page_listing, volume_listing, elements_of_public_books, part_suppliers, splittable_elements, deleted_elements, sampled_elements, record_violations, broken_elements,
        line_boxes, graph_nodes, concept_index, concept_children, gazetteer_forms, training_summary, page_profiles, vector_profiles, memory_statistics, metric_changes, name_coverage, version_prints, engine_status, backfilled_elements,
    )
}

# ------------------------------------------------------------------------------------------------------------- SQL
_TYPES = ", ".join(duck.q(t) for t in contracts.ELEMENT_TYPES)
_SHARE = "({0} is null or ({0} between 0 and 1 and not isnan({0})))"
_RULES = {
    "books": {"title": "coalesce(trim(title, ' '), '') <> ''", "volumes": "coalesce(volumes >= 1, true)", "language": "language is null or trim(language, ' ') <> ''"},
    "page_elements": {
        "page": "page_id is not null", "order": "coalesce(element_order >= 0, true)", "page_number": "coalesce(page_number >= 1, true)", "volume_number": "coalesce(volume_number >= 1, true)", "type": f"coalesce(element_type in ({_TYPES}), false)",
        "ocr_confidence": _SHARE.format("ocr_confidence"), "layout_confidence": _SHARE.format("layout_confidence"), "text": "text_raw is not null or (text_display is null and text_normalized is null)", "times": "coalesce(created_at <= updated_at, true)",
    },
    "narrators": {"name": "coalesce(trim(canonical_name, ' '), '') <> ''", "generation": "coalesce(generation >= 1, true)", "death_year": "coalesce(death_year >= 1, true)"},
    "rerank_results": {"ranks": "coalesce(original_rank >= 0, true) and coalesce(new_rank >= 0, true)", "moved": "coalesce(moved = original_rank - new_rank, true)"},
}
_MEAN = "with v as (select label, vec_id // 10 as page, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dimension from embeddings)"
_METRICS = "r{0} as (select query_id, element_id, {0} + 1 as place from (select distinct query_id, element_id, original_rank, new_rank from rerank_results)), j{0} as (select r.query_id, place, coalesce(s.coverage, 0) >= 0.8 as relevant from r{0} r join signal_scores s on r.query_id = s.query_id and r.element_id = s.element_id), m{0} as (select query_id, case when sum(case when relevant then 1 else 0 end) > 0 then round(sum(case when relevant and place <= 10 then 1 else 0 end) / sum(case when relevant then 1 else 0 end), 6) end as recall_at_k, round(coalesce(1.0::double / min(case when relevant then place end), 0), 6) as reciprocal_rank, max(case when place = 1 then cast(relevant as int) end)::double as precision_at_1, sum(case when relevant then 1 else 0 end)::bigint as relevant from j{0} group by query_id), s{0} as (select 'recall_at_k' as metric, round(avg(recall_at_k), 4) as value from m{0} union all select 'reciprocal_rank', round(avg(reciprocal_rank), 4) from m{0} union all select 'precision_at_1', round(avg(precision_at_1), 4) from m{0} union all select 'relevant_p50', median(relevant) from m{0} union all select 'relevant_max', max(relevant) from m{0})"

SQL = {
    "books_by_language": "select book_id, title, slug from books where language = 'fa'",
    "books_by_slug": "with w as (select distinct slug from books where book_id % 20 = 0 union select 'no-such-slug') select w.slug, exists(select 1 from books b where b.slug is not distinct from w.slug) as found from w",
    "titles_with": "select book_id, title from books where title ilike '%الصلاة%' or title ilike '%and%'",
    "page_listing": _E + " select page_id, element_id, row_number() over (partition by page_id order by element_order, element_id) as place, element_type from e where page_id % 20 = 0",
    "volume_listing": _E + " select book_id, volume_number, count(distinct page_id) as pages, min(page_number) as first_page, max(page_number) as last_page from e group by all",
    "elements_of_public_books": _E + " select book_id, count(*) as elements from e where page_id in (select e.page_id from e join books b on e.book_id = b.book_id where b.is_public) group by 1",
    "part_suppliers": "select p_partkey, p_name, coalesce((select string_agg(n, ',' order by n) from (select distinct s_name as n from lineitem join supplier on l_suppkey = s_suppkey where l_partkey = p_partkey)), '') as suppliers from part where p_partkey % 20 = 0",
    "splittable_elements": _E + " select element_type, count(*) as elements from e where element_type in ('sanad', 'matn') group by 1",
    "deleted_elements": "with x as (select distinct element_id from page_elements where book_id = 1) select 'deleted' as what, count(*) as rows from page_elements where element_id in (from x) union all select 'kept', count(*) from page_elements where element_id not in (from x)",
    "record_violations": " union all ".join(f"select '{t}' as \"table\", '{r}' as rule, count(*) filter (not ({c})) as rows from {t}" for t, rs in _RULES.items() for r, c in rs.items()),
    "broken_elements": "with b as (select distinct element_id, concat_ws(',', " + ", ".join(f"case when not ({c}) then '{r}' end" for r, c in _RULES["page_elements"].items()) + ") as broken from page_elements) select * from b where broken <> ''",
    "line_boxes": "select l_orderkey, l_linenumber, least(l_quantity, 25.0) as x, round(abs(25.0 - l_quantity), 6) as width, round(abs(l_tax - l_discount), 6) as height, least(l_quantity, 25.0) >= 0 and least(l_discount, l_tax) >= 0 and abs(25.0 - l_quantity) > 0 and abs(l_tax - l_discount) > 0 as valid, least(l_quantity, 25.0) >= 0 and 10.0 > least(l_quantity, 25.0) as span from lineitem",
    "graph_nodes": _CONCEPTS + ", n as (select id, 'concept' as type, label from c union all select distinct id, 'end', null from (select source as id from ed union all select target from ed)), g as (select id, min(type) as type, max(label) as label from n group by id) select type, count(*) as nodes, count(label) as labelled from g group by 1",
    "concept_index": _CONCEPTS + f", t as (select id, unnest(list_append(coalesce(synonyms, []), label)) as term from c), k as (select id, {duck.match_key('term')} as key from t where term is not null) select key, count(distinct id) as concepts from k where key <> '' group by 1 having count(distinct id) > 1",
    "concept_children": _CONCEPTS + " select p.id, count(distinct c.id) as children from c p left join c on c.parent = p.id and c.id <> p.id group by 1",
    "gazetteer_forms": f"with f as (select id, unnest(list_concat([canonical_name], aliases)) as form from (select distinct id, canonical_name, aliases from narrators)), k as (select id, {duck.match_key('form')} as key from f) select key, count(distinct id) as ids from k where key <> '' group by 1 having count(distinct id) > 1",
    "training_summary": WORDS + ", t as (select unnest(tokens) as token from w) select (select count(*) from e) as elements, (select count(distinct page_id) from e) as pages, (select count(distinct book_id) from e) as books, (select count(*) from t) as tokens, (select count(distinct token) from t) as words",
    "page_profiles": WORDS + ", t as (select e.page_id, unnest(w.tokens) as t from w join e on w.element_id = e.element_id where e.book_id = 1) select page_id, count(*) as tokens, count(distinct t) as words from t group by 1",
    "vector_profiles": _MEAN + ", p as (select label, page, dimension, avg(x) as x from v group by all), pn as (select label, page, sqrt(sum(x * x)) as n from p group by all), u as (select p.label, p.page, dimension, x / n as x from p join pn on p.label = pn.label and p.page = pn.page), b as (select label, dimension, avg(x) as x from u group by all), bn as (select label, sqrt(sum(x * x)) as n from b group by label) select b.label, dimension, round(x / n, 5) as weight from b join bn on b.label = bn.label",
    "memory_statistics": "with e as (select case when value > 20 then 'answerable' else 'partial' end as verdict, least(1.0, value / 50) as c from events) select verdict, count(*) as rows, count(*) filter (c >= 0.7) as sure, count(*) filter (verdict = 'answerable' and c >= 0.7) as recalled from e group by 1",
    "metric_changes": "with " + _METRICS.format("new_rank") + ", " + _METRICS.format("original_rank") + " select a.metric, a.value, b.value as baseline, coalesce(case when a.metric = 'relevant_max' then a.value > b.value else a.value < b.value end, false) as worse from snew_rank a left join soriginal_rank b using (metric)",
    "engine_status": "select state, count(*) as parts, count(*) filter (waits <> '') as waiting from (values " + ", ".join(f"({duck.q(s)}, {duck.q(w)})" for _, s, _, _, w in registry.ENGINES) + ") v(state, waits) group by 1",
    "backfilled_elements": _E + f", s as (select element_id, text_normalized as was, {duck.search_form('text_raw')} as now from e where text_raw is not null and (text_normalized is null or canonicalizer_version is distinct from '1.0.0')) select element_id, sha1(now) as made, '1.0.0' as canonicalizer_version, was is distinct from now as changed from s",
    "version_prints": _E + f" select canonicalizer_version, count(*) as elements, '{';'.join(f'{k}={v}' for k, v in VERSIONS.items())}' as engine from e group by 1",
}
