"""Queries over structure, reasoning, graphs, learning, audits and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.operators import corpus, extract, graph, learning, reasoning, store, structure
from scriptorium.plans import duck
from scriptorium.plans.corpus_queries import ELEMENTS, WORDS, _words
from scriptorium.sources.tables import table
from scriptorium.streaming import events as stream

QUESTIONS = ["زرارة بن أعين", "باب نواقض الوضوء", "ما حكم الوضوء بماء البحر", "] 29214 [ ج 1 ص 45", "ما معنى الطهارة", "عن أحمد بن محمد عن علي بن الحكم", "وبإسناده عن سعد", "قال رسول الله الماء يطهر", "الوضوء", "", "هل يجوز المسح", "كتاب الصلاة"]
REPORTS = [
    "[ 29214 ] 1 ـ محمد بن يعقوب ، عن علي بن إبراهيم ، عن أبيه ، عن زرارة ، عن أبي جعفر ( عليه السلام ) قال سألته عن رجل نسي صلاة من صلاته حتى خرج وقتها ما يصنع",
    "عن محمد بن مسلم ، عن أحمد بن عيسى قال : الماء كله طاهر حتى يعلم أنه قذر", "قال الماء يطهر", "", "] ٧٣١ [ ١ ـ وبإسناده عن سعد بن عبد الله",
]
SAYINGS = [(1, "لا يجوز المسح على الخفين في السفر الطويل"), (2, "يجوز المسح على الخفين إذا كان في السفر الطويل"), (3, "الماء طاهر كله حتى تعلم قذارته"), (4, "هذا الماء نجس كله حتى تعلم طهارته"), (5, "يجب الغسل")]
NUMBERS = ["] ٠٢٦ [ ٦", "] ٧٣١ [ ١", "] ٨١١ ١ [", "[ 29214 ] 1", "[5]", "none", ""]
LIVES = [(1, 1, "الكليني", None, 329), (1, 2, "زرارة", None, 150), (2, 1, "ابن أبي عمير", None, 217), (2, 2, "حماد", None, 209), (2, 3, "مجهول", None, None), (3, 1, "ا", 100, 180), (3, 2, "ب", 80, 150)]


def _elements(spark, d, *columns):
    return corpus.current_elements(table(spark, d, "page_elements"), *columns)


def element_books(spark, d):
    """Element to book, with the number of elements on its page."""
    e = _elements(spark, d, "page_id", "book_id")
    on = e.groupBy(F.col("page_id").alias("p")).agg(F.count("*").alias("on_page"))
    b = table(spark, d, "books").select(F.col("book_id").alias("b"), "title", "category")
    return e.join(on, F.col("page_id") == F.col("p"), "left").join(b, F.col("book_id") == F.col("b"), "left").select("element_id", "page_id", "on_page", "title", F.coalesce("category", F.lit("?")).alias("category"))


def book_pages(spark, d):
    """Second page of ten books whose title holds a word, in title order."""
    b = table(spark, d, "books").filter(F.col("title").ilike("%ال%"))
    return store.page(b.select("book_id", "title"), ["title", "book_id"], 2, 10)


def layout_classes(spark, d):
    e = _elements(spark, d, "page_id", "element_order", "text_raw").filter("text_raw is not null")
    on = e.groupBy(F.col("page_id").alias("p")).agg(F.count("*").alias("n"))
    return structure.classified(e.join(on, F.col("page_id") == F.col("p")), "element_id", "text_raw", "element_order", "n")


def layout_distribution(spark, d):
    c = layout_classes(spark, d)
    total = c.agg(F.count("*")).scalar()
    return c.groupBy("kind").agg(F.count("*").alias("elements"), F.round(100.0 * F.count("*") / F.max(total), 4).alias("percent"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def report_numbers(spark, d):
    rows = spark.createDataFrame([(x,) for x in NUMBERS], "raw string")
    return rows.select("raw", structure.report_number(F.col("raw")).alias("n")).select("raw", "n.hadith", "n.sequence", "n.confidence")


def report_splits(spark, d):
    rows = spark.createDataFrame([(x,) for x in REPORTS], "raw string")
    return rows.select("raw", structure.split_report(F.col("raw")).alias("s")).select("raw", "s.*")


def element_splits(spark, d):
    """Every element's report parts and their places, with narrators and the one the chain ends with."""
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    s = e.select("element_id", "text_raw", structure.split_report(F.col("text_raw")).alias("s")).withColumn("same", structure.reassembled(F.col("text_raw"), F.col("s")) == F.col("text_raw"))
    return s.select(
        "element_id", "s.number", F.length("s.isnad").alias("isnad_length"), F.length("s.matn").alias("matn_length"), "s.confidence", "s.isnad_start", "s.isnad_end", "s.matn_start", "s.matn_end", "same",
        ((F.col("s.isnad") != "") & (F.col("s.matn") != "")).alias("complete"), F.array_join(structure.chain_names(F.col("s.isnad")), "|").alias("narrators"), structure.identify_imam(F.col("s.isnad")).alias("imam"),
    )


def stretch_and_ligatures(spark, d):
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    x = e.select("element_id", structure.remove_stretch(F.col("text_raw")).alias("s")).select("element_id", "s.removed", structure.fix_ligatures(F.col("s.text")).alias("l"))
    return x.select("element_id", "removed", "l.fixed", F.sha1("l.text").alias("text_hash"))


def torn_words(spark, d):
    words = _words(spark, d)
    lexicon = corpus.token_statistics(words).select(F.col("token").alias("word"), "frequency")
    return structure.split_word_merges(words, lexicon)


def question_intents(spark, d):
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "query string")
    return q.select("query", reasoning.intent(F.col("query")).alias("i")).select("query", "i.label", "i.confidence", reasoning.confident(F.col("i.confidence")).alias("confident"))


def question_routes(spark, d):
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "query string").select("query", reasoning.intent(F.col("query")).alias("i"))
    return q.select("query", F.explode(reasoning.routes(F.col("query"), F.col("i.label"), F.col("i.confidence"))).alias("r")).select("query", "r.route", "r.weight")


def document_figures(spark, d):
    return extract.figures(table(spark, d, "documents"), "doc_id", "text")


def document_words(spark, d):
    """How many blocks, words and links are extracted from every document."""
    t = table(spark, d, "documents").select("doc_id", "text")
    parts = [x.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(k).alias("what"), "n") for k, x in extract.extracted(t, "doc_id", "text").items() if k in ("blocks", "words", "links")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def table_of_contents(spark, d):
    return extract.contents(_elements(spark, d, "text_raw"), "element_id", "text_raw")


def _hits(spark, d):
    r = table(spark, d, "rerank_results")
    last = r.groupBy("query_id", "element_id").agg(F.max(F.struct("scored_at", "original_score")).alias("l")).select("query_id", "element_id", F.col("l.original_score").alias("score"))
    s = table(spark, d, "signal_scores").select(F.col("query_id").alias("q"), F.col("element_id").alias("e"), F.when(F.isnan("ocr_quality"), None).otherwise(F.col("ocr_quality")).alias("ocr_quality"))
    e = _elements(spark, d, "book_id", "volume_number", "page_number", "text_raw").select(F.col("element_id").alias("e2"), "book_id", "volume_number", "page_number", F.coalesce("text_raw", F.lit("")).alias("text"))
    b = table(spark, d, "books").select(F.col("book_id").alias("b"), "title")
    return last.join(s, (F.col("query_id") == F.col("q")) & (F.col("element_id") == F.col("e")), "left").join(e, F.col("element_id") == F.col("e2"), "left").join(b, F.col("book_id") == F.col("b"), "left").drop("q", "e", "e2", "b")


def evidence_items(spark, d):
    return reasoning.evidence(_hits(spark, d)).select("query_id", "element_id", "admitted", "rejected", "citable", "citation")


def query_verdicts(spark, d):
    hits = _hits(spark, d)
    conf = hits.select("query_id").distinct().withColumn("intent_confidence", (F.col("query_id") % 10) / 10)
    return reasoning.verdicts(reasoning.evidence(hits), conf)


def resolved_names(spark, d):
    n = table(spark, d, "narrators").select("id", "canonical_name", "aliases").distinct()
    forms = n.select("id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("form"), F.col("canonical_name").alias("canonical"))
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    names = e.select(F.explode(structure.chain_names(structure.split_report(F.col("text_raw"))["isnad"])).alias("name"))
    return reasoning.resolve_names(names, forms)


def lifespan_links(spark, d):
    return reasoning.chain_links(spark.createDataFrame(LIVES, "chain_id int, pos int, name string, birth int, death int"))


def chain_continuity(spark, d):
    return reasoning.chain_continuity(lifespan_links(spark, d))


def house_chains(spark, d):
    """Narrators of one house in order of death as a chain from the latest back."""
    n = table(spark, d, "narrators").filter("nisba is not null and death_year is not null").groupBy("id").agg(F.max("nisba").alias("nisba"), F.max("death_year").alias("death"))
    c = n.select(F.col("nisba").alias("chain_id"), F.struct((-F.col("death")).alias("d"), "id").alias("pos"), F.col("id").alias("name"), F.lit(None).cast("int").alias("birth"), "death")
    return reasoning.chain_continuity(reasoning.chain_links(c))


def saying_rulings(spark, d):
    s = spark.createDataFrame(SAYINGS, "id int, text string")
    return s.select("id", reasoning.ruling(F.col("text"), ["المسح", "الماء"]).alias("r")).select("id", "r.ruling", "r.marker", "r.strength")


def element_rulings(spark, d):
    e = _elements(spark, d, "text_raw").filter("text_raw is not null")
    return e.select(reasoning.ruling(F.col("text_raw"), []).alias("r")).groupBy("r.ruling", "r.strength").agg(F.count("*").alias("elements"))


def _concepts(spark, d):
    from scriptorium.operators.hierarchy import node_key

    c = table(spark, d, "concepts").select(node_key(F.col("id")).alias("id"), "label", node_key(F.col("parent")).alias("parent"), "synonyms", "related", "excludes", "updated_at").filter("id is not null")
    return c.groupBy("id").agg(F.max_by(F.struct("label", "parent", "synonyms", "related", "excludes"), F.struct("updated_at", "parent")).alias("r")).select("id", "r.*")


def _edges(spark, d):
    c = _concepts(spark, d)
    up = c.filter("parent is not null").select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("parent").alias("type"))
    rel = c.select(F.col("id").alias("source"), F.explode("related").alias("r")).select("source", F.lower(F.btrim("r")).alias("target"), F.lit("related").alias("type"))
    return up.unionByName(rel).withColumn("weight", F.lit(1.0)).withColumn("confidence", F.when(F.col("type") == "parent", 0.9).otherwise(0.6))


def merged_edges(spark, d):
    return graph.merged_edges(_edges(spark, d))


def graph_statistics(spark, d):
    return graph.statistics(_edges(spark, d))


def graph_paths(spark, d):
    """Paths from every concept whose number is divisible by 20 to its root's neighbours: its ancestors within 4 hops."""
    e = _edges(spark, d)
    s = e.filter(F.expr("try_cast(substr(source, 2) as bigint) % 20 = 0")).select(F.col("source").alias("start")).distinct()
    t = e.filter("type = 'related'").select(F.col("target")).distinct()
    first = s.join(e.select(F.col("source").alias("a"), F.col("target").alias("m")), F.col("start") == F.col("a")).select("start", "m")
    second = first.join(e.select(F.col("source").alias("a"), F.col("target").alias("t2")), F.col("m") == F.col("a")).select("start", F.col("t2").alias("target"))
    wanted = second.join(t.withColumnRenamed("target", "t3"), F.col("target") == F.col("t3"), "left_semi").filter("start <> target").distinct()
    return graph.paths(e, wanted)


def graph_neighbours(spark, d):
    e = _edges(spark, d)
    n = e.filter(F.expr("try_cast(substr(source, 2) as bigint) % 20 = 0")).select(F.col("source").alias("node"))
    return graph.neighbours(e, n)


def graph_subgraph(spark, d):
    return graph.subgraph(_edges(spark, d), spark.createDataFrame([("c000000005",)], "node string"))


def graph_common(spark, d):
    return graph.common_neighbours(_edges(spark, d), "c000000036", "c000000058")


def concept_expansion(spark, d):
    c = _concepts(spark, d)
    return graph.expanded_terms(c, c.filter(F.expr("try_cast(substr(id, 2) as bigint) % 20 = 0")).select("id"))


def concepts_in_texts(spark, d):
    e = _elements(spark, d, "text_normalized").filter("text_normalized is not null").select(F.col("element_id").alias("text_id"), F.col("text_normalized").alias("text"))
    return graph.concepts_in_texts(_concepts(spark, d), e)


def calibration(spark, d):
    s = table(spark, d, "signal_scores").select(F.col("coverage").alias("confidence"), (F.col("completeness") > 0.5).alias("correct"))
    b = learning.calibration_bins(s)
    return learning.smoothed(b).select("bin", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"), "count")


def calibration_error(spark, d):
    s = table(spark, d, "signal_scores").select(F.col("coverage").alias("confidence"), (F.col("completeness") > 0.5).alias("correct"))
    return learning.calibration_error(learning.calibration_bins(s))


def _judged(spark, d):
    r = table(spark, d, "rerank_results").select("query_id", "element_id", "new_rank").distinct()
    s = table(spark, d, "signal_scores").select(F.col("query_id").alias("q"), F.col("element_id").alias("e"), (F.coalesce(F.col("coverage"), F.lit(0.0)) >= 0.8).alias("relevant"))
    return r.join(s, (F.col("query_id") == F.col("q")) & (F.col("element_id") == F.col("e"))).select("query_id", (F.col("new_rank") + 1).alias("place"), "relevant")


def retrieval_metrics(spark, d):
    return learning.retrieval_metrics(_judged(spark, d))


def metric_summary(spark, d):
    return learning.metric_summary(learning.retrieval_metrics(_judged(spark, d)))


def ranker_scores(spark, d):
    """Scores of a ranker trained on the judged pairs of the fixture, over all signal rows."""
    good, bad = {"sig_coverage": 1.0, "sig_ocr_quality": 0.9}, {"sig_coverage": 0.2, "sig_ocr_quality": 0.9}
    w = learning.train_ranker([(good, bad)] * 20, ["sig_coverage", "sig_ocr_quality", "sig_density"])
    s = table(spark, d, "signal_scores").select("query_id", "element_id", F.when(F.isnan("ocr_quality"), None).otherwise(F.col("ocr_quality")).alias("sig_ocr_quality"), F.col("coverage").alias("sig_coverage"), F.col("density").alias("sig_density"))
    return s.select("query_id", "element_id", F.round(learning.ranker_score(w), 8).alias("score"))


def clean_queries(spark, d):
    return learning.clean_queries(_elements(spark, d, "text_normalized").filter("text_normalized is not null").select(F.col("element_id").alias("id"), F.col("text_normalized").alias("text")))


def distinctive_windows(spark, d):
    w = _words(spark, d)
    return learning.distinctive_window(w.withColumnRenamed("element_id", "id"), corpus.token_statistics(w))


def event_counts(spark, d):
    """An append-only log by actor and action."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def budget_trips(spark, d):
    return store.budget_trips(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 500.0)


def cache_hits(spark, d):
    return store.cache_hits(table(spark, d, "events"), "user_id", "ts", "event_id", 3600)


def valid_memories(spark, d):
    e = table(spark, d, "events").select(
        store.memory_key(F.col("event_type"), F.col("props")).alias("key"), "event_id", F.when(F.col("value") > 20, "answerable").otherwise("partial").alias("verdict"), F.least(F.lit(1.0), F.col("value") / 50).alias("confidence"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("stored_at"), F.create_map(F.lit("ranking"), F.when(F.col("event_id") % 3 == 0, "2.0").otherwise("2.3"), F.lit("ocr"), F.lit("1")).alias("versions"),
    )
    last = e.agg(F.max("stored_at")).scalar()
    return store.valid_memories(e.withColumn("now", last), {"ranking": "2.3", "ocr": "1"}, F.col("now")).select("key", "event_id")


def events_tumbling(spark, d):
    return stream.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def events_sliding(spark, d):
    return stream.sliding(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def events_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


def page_number_gaps(spark, d):
    return store.number_gaps(table(spark, d, "page_elements"), "book_id", "page_number")


def element_order_gaps(spark, d):
    return store.number_gaps(table(spark, d, "page_elements"), "page_id", "element_order")


def store_audit(spark, d):
    """Each table is read once: its checks are columns of one aggregate, turned to rows at the end."""
    e = _elements(spark, d, "page_id", "book_id", "page_number", "volume_number", "element_order", "element_type", "text_raw", "created_at", "updated_at")
    b = table(spark, d, "books")
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    text = F.col("text_raw")
    some = lambda cond: F.coalesce(F.sum(cond.cast("int")), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    count = lambda df: df.agg(F.count("*").alias("n"))
    per_text = e.filter("text_raw is not null").groupBy(F.sha1(text).alias("h")).agg(F.count("*").alias("n"))
    places = e.groupBy("book_id", "page_id", "element_order").agg(F.count("*").alias("n"))
    pages = places.groupBy("book_id", "page_id").agg(F.sum("n").alias("n"), some(F.col("n") > 1).alias("twice"))
    # A page of several books counts once, with all its elements.
    per_page = pages.groupBy("page_id").agg(F.sum("n").alias("n"))
    parts = [
        *[store.checks(count(df), {"n": (f"rows_{n}", "info")}) for n, df in t.items()],
        store.checks(
            b.agg(F.count("*").alias("books"), some(blank(F.col("title"))).alias("titles_missing"), some(blank(F.col("language"))).alias("languages_missing"), some(F.col("category").isNull()).alias("categories_missing")),
            {"books": ("books", "info"), "titles_missing": ("titles_missing", "fail"), "languages_missing": ("languages_missing", "fail"), "categories_missing": ("categories_missing", "warning")},
        ),
        store.checks(b.filter("slug is not null").groupBy("slug").count().filter("count > 1").agg(F.count("*").alias("n")), {"n": ("duplicate_slugs", "fail")}),
        store.checks(
            e.agg(
                F.count("*").alias("elements"), some(F.col("page_number") < 1).alias("page_numbers_below_1"), some(F.col("volume_number") < 1).alias("volumes_below_1"),
                some(F.coalesce(F.btrim(text), F.lit("")) == "").alias("empty_texts"), some(F.length(F.btrim(text)) < 3).alias("texts_below_3"),
                F.round(F.avg(F.length(text)), 4).alias("mean_length"), F.max(F.length(text)).alias("longest"), some(text.rlike("[\\u0000-\\u0008\\u000E-\\u001F]")).alias("control_characters"),
                some(text.rlike("^ | $")).alias("outer_blanks"), some(F.coalesce(F.col("element_type"), F.lit("?")).isin("?", "unknown")).alias("unknown_types"),
                some(F.col("updated_at") < F.col("created_at")).alias("updated_before_created"),
            ),
            {
                "elements": ("elements", "info"), "page_numbers_below_1": ("page_numbers_below_1", "fail"), "volumes_below_1": ("volumes_below_1", "fail"), "empty_texts": ("empty_texts", "warning"),
                "texts_below_3": ("texts_below_3", "info"), "mean_length": ("mean_length", "info"), "longest": ("longest", "info"), "control_characters": ("control_characters", "info"),
                "outer_blanks": ("outer_blanks", "info"), "unknown_types": ("unknown_types", "warning"), "updated_before_created": ("updated_before_created", "fail"),
            },
        ),
        store.checks(per_text.agg(some(F.col("n") > 10).alias("n")), {"n": ("repeated_texts", "info")}),
        store.checks(e.groupBy("page_id", "element_order").agg(F.count("*").alias("n")).agg(some(F.col("n") > 1).alias("n")), {"n": ("duplicate_orders", "fail")}),
        store.checks(
            per_page.agg(F.round(F.avg("n"), 4).alias("mean"), F.median("n").alias("median"), F.max("n").alias("max"), F.min("n").alias("min"), some(F.col("n") < 3).alias("sparse"), some(F.col("n") > 300).alias("dense"), F.max_by("page_id", F.struct("n", -F.col("page_id"))).alias("fullest")),
            {"mean": ("elements_per_page_mean", "info"), "median": ("elements_per_page_median", "info"), "max": ("elements_per_page_max", "info"), "min": ("elements_per_page_min", "info"), "sparse": ("sparse_pages", "warning"), "dense": ("dense_pages", "warning"), "fullest": ("fullest_page", "info")},
        ),
        store.checks(pages.groupBy("book_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")), {"n": ("pages_per_book_max", "info")}),
    ]
    links = [
        ("orphan_elements", "fail", store.orphans(e, "book_id", b, "book_id")), ("books_without_elements", "warning", store.childless(b, "book_id", e, "book_id")),
        ("nations_without_region", "fail", store.orphans(t["nation"], "n_regionkey", t["region"], "r_regionkey")), ("customers_without_nation", "fail", store.orphans(t["customer"], "c_nationkey", t["nation"], "n_nationkey")),
        ("orders_without_customer", "fail", store.orphans(t["orders"], "o_custkey", t["customer"], "c_custkey")), ("lines_without_order", "fail", store.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey")),
        ("orders_without_lines", "warning", store.childless(t["orders"], "o_orderkey", t["lineitem"], "l_orderkey")), ("customers_without_orders", "warning", store.childless(t["customer"], "c_custkey", t["orders"], "o_custkey")),
    ]
    return store.scorecard([*parts, *[store.checks(count(df), {"n": (name, severity)}) for name, severity, df in links]])


QUERIES = {
    f.__name__: f
    for f in (
        document_figures, document_words, table_of_contents, element_books, book_pages, layout_classes, layout_distribution, report_numbers, report_splits, element_splits, stretch_and_ligatures, torn_words, question_intents, question_routes,
        evidence_items, query_verdicts, resolved_names, lifespan_links, chain_continuity, house_chains, saying_rulings, element_rulings, merged_edges, graph_statistics,
        graph_paths, graph_neighbours, graph_subgraph, graph_common, concept_expansion, concepts_in_texts, calibration, calibration_error, retrieval_metrics, metric_summary, ranker_scores,
        clean_queries, distinctive_windows, event_counts, budget_trips, cache_hits, valid_memories, events_tumbling, events_sliding, events_sessions, page_number_gaps, element_order_gaps, store_audit,
    )
}

# ------------------------------------------------------------------------------------------------------------- SQL
_E = f"with {ELEMENTS}"
_ER = f"with {ELEMENTS.replace('where rn = 1)', 'where rn = 1 and text_raw is not null)')}"


def _values(rows, names: str) -> str:
    def one(v):
        return "null" if v is None else duck.q(v) if isinstance(v, str) else str(v)

    return "(values " + ", ".join("(" + ", ".join(one(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") v({names})"


def _contains_any(c: str, options) -> str:
    return "(" + " or ".join(f"contains({c}, {duck.q(o)})" for o in options) + ")"


def _starts_any(c: str, options) -> str:
    return "(" + " or ".join(f"starts_with({c}, {duck.q(o)})" for o in options) + ")"


def _count_any(c: str, options) -> str:
    return "(" + " + ".join(f"cast(contains({c}, {duck.q(o)}) as int)" for o in options) + ")"


def _regcount(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {duck.cls(pattern)}))"


def _regmatch(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {duck.cls(pattern)})"


_D = structure.D
_LAYOUT = f"""{_ER.replace("with e", "with e0", 1).replace("from page_elements", "from page_elements")}, pc as (select page_id as p, count(*) as on_page from e0 group by 1),
 r as (select element_id, element_order, on_page, {duck.rep("text_raw", "^" + arabic.SPACES + "|" + arabic.SPACES + "$")} as raw from e0 join pc on page_id = p),
 n as (select *, {duck.layout_form("raw")} as norm from r),
 m as (select *, string_split(norm, ' ') as ws, {_regcount("norm", structure.NASAB)} as nasab, {_regcount("norm", structure.TRANSMISSION)} as trans, trim(regexp_replace(norm, '^\\s*[\\]\\[][^\\]\\[]*[\\]\\[]', '')) as aft,
  {_count_any("norm", structure.FOOTNOTE_PHRASES)} as phrases, {_starts_any("norm", structure.TAKHRIJ_OPENERS)} as opens, {_starts_any("norm", structure.SANAD_OPENERS)} as starts, {_count_any("norm", structure.MATN_MARKERS)} as markers,
  regexp_matches(regexp_replace(regexp_replace(norm, {duck.cls("[)(]\\s*[" + _D + "]+\\s*[)(]\\s*[.،]?\\s*$")}, ''), '[ .،]+$', ''), '(?:{"|".join(structure.TAKHRIJ_TAILS)})$') as ends from n),
 k as (select *, least(0.95, (case when starts then 0.45 when list_contains(ws[1:4], 'بن') or list_contains(ws[1:4], 'ابن') then 0.28 else 0 end) + (case when nasab >= 2 then 0.30 when nasab = 1 then 0.12 else 0 end)
   + (case when trans >= 3 then 0.45 when trans = 2 then 0.32 when trans = 1 then 0.10 else 0 end) + (case when regexp_matches(norm, 'عن\\s+\\S+\\s+(?:بن|ابن)\\s') then 0.18 else 0 end) + (case when ends_with(regexp_replace(norm, '[ :.،]+$', ''), 'قال') then 0.10 else 0 end)) as sanad,
   (case when markers > 0 then 0.45 + 0.08 * least(markers, 3) else 0 end) + (case when len(ws) >= 6 and nasab = 0 then 0.20 else 0 end) + (case when regexp_matches(norm, '[؟:،]') then 0.05 else 0 end) as body,
   {_regcount("norm", "[0-9\\u0660-\\u0669\\u06F0-\\u06F9]")} / greatest(length(norm), 1) as digits from m),
 j as (select *, least(0.95, case when body < 0.55 and len(ws) >= 5 and nasab = 0 and digits < 0.15 and not opens and not starts then greatest(body, 0.58) else body end) as matn,
   aft <> '' and ({_starts_any("aft", structure.SANAD_OPENERS)} or ({_regcount("aft", structure.NASAB)} >= 1 and {_regcount("aft", structure.TRANSMISSION)} >= 1)) as chain from k),
 lay as (select element_id, case when raw = '' then ['unknown', '0'] when {_regmatch("raw", "^[" + _D + "]+$")} then ['page_number', '0.95'] when {_regmatch("raw", "^[" + _D + "]+\\s+(?:كتاب|أبواب|ابواب)\\s")} then ['running_head', '0.9']
   when {_regmatch("raw", "^[" + _D + "]+\\s*[ـ\\-–]\\s*(?:باب|أبواب|ابواب)")} then ['heading', '0.92'] when {_regmatch("raw", "^\\]\\s*[" + _D + "\\s]+\\[|^\\[\\s*[" + _D + "\\s]+\\]")} then (case when chain then ['sanad', '0.85'] else ['hadith_number', '0.8'] end)
   when {_regmatch("raw", "^[)(]\\s*[" + _D + "]+\\s*[)(]")} then ['footnote', '0.93'] when {_regmatch("raw", "^[" + _D + "]+\\s*[ـ\\-–]\\s*\\S[^:/]{0,28}[:/]\\s*[" + _D + "\\s/:.،]+$")} then ['footnote', '0.85']
   when regexp_matches(norm, '^(?:كتاب|أبواب|ابواب)\\s+\\S') and len(ws) <= 6 then ['heading', '0.8'] when phrases > 0 then ['footnote', cast(least(0.95, 0.62 + 0.08 * least(phrases, 3) + case when on_page > 0 and element_order >= on_page * 0.75 then 0.10 else 0 end) as varchar)]
   when opens or ends then ['takhrij', case when opens and ends then '0.7' else '0.6' end] when sanad >= matn and sanad >= 0.55 then ['sanad', cast(sanad as varchar)] when matn >= 0.55 then ['matn', cast(matn as varchar)] else ['unknown', cast(greatest(sanad, matn) as varchar)] end as v from j)"""

_S = arabic.SPACES
_strip = lambda x: duck.rep(x, f"^{_S}|{_S}$")


def _splits(source: str) -> str:
    """CTEs that divide the reports of ``source`` (key, raw): the last is sl, with names their chain's."""
    ok = lambda o: f"instr(body, {duck.q(o)}) > 1 and {_regcount(f'substr(body, 1, instr(body, {duck.q(o)}) - 1)', structure.TRANSMISSION)} >= 1 and {_regmatch(f'substr(body, 1, instr(body, {duck.q(o)}) - 1)', structure.NASAB)}"
    hon, edge = duck.cls(structure.HONORIFIC), duck.cls(structure.NAME_EDGE)
    imam = "case " + " ".join(f"when contains(isnad, {duck.q(m)}) then {duck.q(m)}" for m in structure.IMAM_MARKERS) + " else '' end"
    return f"""sa as (select *, coalesce(regexp_extract(raw, {duck.cls('(' + structure.NUMBER + ')')}, 1), '') as num from {source}), sb as (select *, substr(raw, length(num) + 1) as body from sa),
 sc as (select *, greatest(floor(length(body) * 0.75), 40) as lim, {_starts_any("ltrim(body, ' ')", structure.REPORT_OPENERS)} or ({_regcount('body', structure.TRANSMISSION)} >= 2 and {_regcount('body', structure.NASAB)} >= 1) as chain, list_transform(regexp_split_to_array(body, {hon}), lambda x: length(x)) as bl, list_transform(regexp_extract_all(body, {hon}), lambda x: length(x)) as fl from sb),
 sd as (select *, list_transform(range(1, len(fl) + 1), lambda i: list_sum(bl[1:i]) + coalesce(list_sum(fl[1:i - 1]), 0)) as st from sc), se as (select *, coalesce(list_max(list_transform(list_filter(range(1, len(fl) + 1), lambda i: st[i] < lim), lambda i: st[i] + fl[i])), 0)::int as honour, coalesce({', '.join(f'case when {ok(o)} then instr(body, {duck.q(o)}) - 1 + {len(o)} end' for o in structure.MATN_OPENERS)})::int as op from sd),
 sf as (select *, case when honour > 0 then honour else op end as cut from se), sg as (select *, substr(body, 1, cut) as head, {_strip('substr(body, 1, cut)')} as front, {_strip('substr(body, cut + 1)')} as back, {_strip('body')} as whole, length(num) as bs, length(raw) as n from sf),
 sh as (select *, case when {_strip('raw')} = '' or whole = '' then 1 when num = '' and not chain then 2 when cut is null and chain then 3 when cut is null then 4 when back = '' then 5 when len(regexp_split_to_array(back, {duck.cls(_S)})) < 3 then 6 else 7 end as way from sg),
 si as (select *, case when way = 3 then whole when way >= 5 then front else '' end as isnad, case when way in (2, 4) then whole when way = 7 then back else '' end as matn, case way when 1 then 0 when 2 then 0.3 when 3 then 0.55 when 4 then 0.5 when 5 then 0.55 when 6 then 0.5 else case when honour > 0 then case when {_regmatch('head', structure.TRANSMISSION)} or {_regmatch('head', structure.NASAB)} then 0.85 else 0.6 end else 0.7 end end as confidence,
  case when way in (3, 5, 6, 7) then bs else 0 end as isnad_start, case when way in (3, 5, 6) then n when way = 7 then bs + cut else 0 end as isnad_end, case when way in (2, 4) then bs when way = 7 then bs + cut else 0 end as matn_start, case when way in (2, 4, 7) then n else 0 end as matn_end, {_strip('num')} as number from sh),
 sk as (select *, {imam} as imam, list_filter(list_transform(regexp_split_to_array({duck.rep('isnad', _S, ' ')}, {duck.q(structure.NAME_BREAK)}), lambda p: regexp_replace(regexp_replace(p, {edge}, '', 'g'), {duck.q('^(?:' + '|'.join(structure.CHAIN_LEADS) + ')')}, '')), lambda p: p <> '' and len(string_split(p, ' ')) <= 6 and p not in ({', '.join(duck.q(w) for w in structure.NO_NAMES)})) as kept from si),
 sl as (select *, list_filter(list_transform(kept, lambda p: regexp_replace(regexp_replace(p, {duck.q(structure.NAME_FORMULA)}, ''), {edge}, '', 'g')), lambda p: length(p) >= 3 and not {_starts_any('p', structure.IMAM_MARKERS)}) as names from sk)"""


_HITS = _E + """, l as (select query_id, element_id, original_score as score from (select *, row_number() over (partition by query_id, element_id order by scored_at desc) as k from rerank_results) where k = 1),
 h as (select l.*, case when isnan(s.ocr_quality) then null else s.ocr_quality end as ocr_quality, e.book_id, e.volume_number, e.page_number, coalesce(e.text_raw, '') as text, b.title from l left join signal_scores s on l.query_id = s.query_id and l.element_id = s.element_id
  left join e on l.element_id = e.element_id left join books b on e.book_id = b.book_id),
 g as (select *, coalesce(ocr_quality, 0) >= 0.2 as good, sum(case when coalesce(ocr_quality, 0) >= 0.2 then 1 else 0 end) over (partition by query_id order by score desc, element_id rows between unbounded preceding and current row) as n from h),
 ev as (select *, good and n <= 10 as admitted, not good and n < 10 as rejected, good and n <= 10 and coalesce(book_id, 0) <> 0 and coalesce(page_number, 0) <> 0 and coalesce(ocr_quality, 0) >= 0.35 as citable from g)"""
_CON = ", ".join(f"max(case when citable and contains(text, {duck.q(a)}) and not contains(text, {duck.q(b)}) then 1 else 0 end) * max(case when citable and contains(text, {duck.q(b)}) and not contains(replace(text, {duck.q(b)}, ''), {duck.q(a)}) then 1 else 0 end) as x{i}" for i, (a, b) in enumerate(reasoning.CONTRADICTIONS))
_LIVES = _values(LIVES, "chain_id, pos, name, birth, death")


def _links(source: str) -> str:
    return f"""x as (select chain_id, pos, name, birth, death, lead(name) over w as t_name, lead(birth) over w as t_birth, lead(death) over w as t_death from {source} window w as (partition by chain_id order by pos)),
 y as (select *, coalesce(birth, death - 70) as sb, coalesce(death, birth + 70) as sd, coalesce(t_birth, t_death - 70) as tb, coalesce(t_death, t_birth + 70) as td from x where t_name is not null),
 z as (select *, case when sb is null or td is null then null when sb + 10 > td then 0 else greatest(0, least(sd, td) - greatest(sb + 10, tb + 10)) end as overlap from y),
 links as (select chain_id, pos, name, t_name as teacher, case when sb is null or td is null then 'unknown' when sb + 10 > td then 'impossible' when overlap < 5 then 'unknown' when birth is null or t_death is null then 'likely' else 'certain' end as relation, overlap from z)"""


_CONT = "select chain_id, count(*) as links, sum(case when relation = 'impossible' then 1 else 0 end)::bigint as breaks, sum(case when relation = 'unknown' then 1 else 0 end)::bigint as unknowns, round((count(*) - sum(case when relation = 'impossible' then 1 else 0 end) - 0.5 * sum(case when relation = 'unknown' then 1 else 0 end)) / count(*), 4) as continuity from links group by chain_id"
_OPTIONS = sorted([(k, m) for k, ms in reasoning.RULINGS.items() for m in ms], key=lambda x: -len(x[1]))


def _ruling(body: str, terms) -> tuple[str, str, str]:
    kind = "case " + " ".join(f"when contains({body}, {duck.q(m)}) then '{k}'" for k, m in _OPTIONS) + " else 'undetermined' end"
    marker = "case " + " ".join(f"when contains({body}, {duck.q(m)}) then {duck.q(m)}" for _, m in _OPTIONS) + " end"
    topic = _contains_any(body, terms) if terms else "true"
    strength = f"case when {marker} is null then 'irrelevant' when not {topic} then 'weak' when {marker} in ({', '.join(duck.q(x) for x in reasoning.EXPLICIT)}) then 'explicit' when contains({body}, ':') or contains({body}, 'قال') then 'apparent' else 'implied' end"
    return kind, marker, strength


_CONCEPTS = """with c0 as (select lower(regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as id, label, nullif(lower(regexp_replace(parent, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '') as parent, synonyms, related, excludes, updated_at from concepts),
 c as (select * from (select *, row_number() over (partition by id order by updated_at desc, parent desc nulls last) as rn from c0 where id <> '') where rn = 1),
 ed as (select id as source, parent as target, 'parent' as type, 1.0::double as weight, 0.9::double as confidence from c where parent is not null union all select id, lower(trim(r)), 'related', 1.0, 0.6 from (select id, unnest(related) as r from c))"""
_ASKED = "try_cast(substr({0}, 2) as bigint) % 20 = 0"
_NASAB_Q, _CHAPTER_Q = "(?:^|\\s)(?:بن|ابن)\\s", "^\\s*(?:باب|أبواب|ابواب|كتاب|فصل|مقدمة|مقدمه)\\s"
_INTENT = f"""with q as (select query, trim(query) as q from {_values(QUESTIONS, "query")}), f as (select *, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) as n, {_regcount("q", _NASAB_Q)} as nasab, {_regmatch("q", _CHAPTER_Q)} as chapter,
  {_regcount("q", "(?:^|\\s)(?:عن|حدثنا|حدّثنا|أخبرنا|اخبرنا)\\s")} as trans from q),
 t as (select query, q, n, [ (case when nasab = 1 then 0.55 when nasab > 1 then 0.75 else 0 end) + (case when {_regmatch("q", "(?:^|\\s)(?:أبو|ابو|أبي|ابي|أبا|ابا|أم|ام)\\s")} then 0.45 else 0 end) + (case when {_contains_any("q", reasoning.TITLES)} then 0.6 else 0 end) + (case when n between 2 and 6 and nasab > 0 then 0.3 else 0 end),
   (case when {_regmatch("q", "^\\s*(?:وبإسناده|بإسناده|وباسناده|باسناده|وعنه)")} then 0.8 else 0 end) + (case when trans >= 2 then 0.7 when trans = 1 and nasab > 0 then 0.4 else 0 end),
   (case when {_contains_any("q", reasoning.HADITH_MARKERS)} then 0.7 else 0 end) + (case when n >= 4 and nasab = 0 and not chapter then 0.35 else 0 end), case when chapter then 1.15 else 0 end,
   (case when {_contains_any("q", reasoning.RULING_MARKERS)} then 0.65 else 0 end) + (case when starts_with(q, 'ما حكم') or starts_with(q, 'هل ') then 0.5 else 0 end), case when {_contains_any("q", reasoning.CONCEPT_MARKERS)} then 1.05 else 0 end,
   case when {_regmatch("q", "[\\[\\]]\\s*[" + reasoning.D + "\\s]+[\\]\\[]|ج\\s*[" + reasoning.D + "]+|ص\\s*[" + reasoning.D + "]+")} then 1.10 else 0 end ] as tot from f),
 s as (select query, q, n, i, k, round((1 - pow(0.5, cast(tot[i] as double) / 0.35)) * ceil, 4) as s from t, (values {", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(reasoning.CEILINGS.items(), 1))}) c(i, k, ceil)),
 o as (select query, q, n, list(struct_pack(k := k, s := s) order by s desc, i) as l from s group by all),
 it as (select query, n, case when l[1].s < 0.35 then 'general' else l[1].k end as label, case when q = '' then 0.0 when l[1].s < 0.35 then round(least(0.45, 0.15 + 0.05 * n), 4) when l[1].s - l[2].s < 0.15 then round(l[1].s * 0.85, 4) else l[1].s end as confidence from o)"""
_JUDGED = "with r as (select distinct query_id, element_id, new_rank from rerank_results), j as (select r.query_id, new_rank + 1 as place, coalesce(s.coverage, 0) >= 0.8 as relevant from r join signal_scores s on r.query_id = s.query_id and r.element_id = s.element_id), m as (select query_id, case when sum(case when relevant then 1 else 0 end) > 0 then round(sum(case when relevant and place <= 10 then 1 else 0 end) / sum(case when relevant then 1 else 0 end), 6) end as recall_at_k, round(coalesce(1.0::double / min(case when relevant then place end), 0), 6) as reciprocal_rank, max(case when place = 1 then cast(relevant as int) end)::double as precision_at_1, sum(case when relevant then 1 else 0 end)::bigint as relevant from j group by query_id)"
_BINS = "with o as (select coverage as confidence, completeness > 0.5 as correct from signal_scores where coverage between 0 and 1 and completeness is not null), b as (select least(cast(floor(confidence * 10) as int), 9) as bin, avg(confidence) as predicted, avg(cast(correct as int)) as observed, count(*) as count from o group by 1 having count(*) >= 5)"
_AUDIT = [
    *[(f"rows_{n}", "info", f"select count(*) from {n}") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")],
    ("books", "info", "select count(*) from books"), ("elements", "info", "select count(*) from e"),
    ("orphan_elements", "fail", "select count(*) from e anti join books b on e.book_id = b.book_id"), ("books_without_elements", "warning", "select count(*) from books b anti join e on e.book_id = b.book_id"),
    ("nations_without_region", "fail", "select count(*) from nation anti join region on n_regionkey = r_regionkey"), ("customers_without_nation", "fail", "select count(*) from customer anti join nation on c_nationkey = n_nationkey"),
    ("orders_without_customer", "fail", "select count(*) from orders anti join customer on o_custkey = c_custkey"), ("lines_without_order", "fail", "select count(*) from lineitem anti join orders on l_orderkey = o_orderkey"),
    ("orders_without_lines", "warning", "select count(*) from orders anti join lineitem on l_orderkey = o_orderkey"), ("customers_without_orders", "warning", "select count(*) from customer anti join orders on o_custkey = c_custkey"),
    ("duplicate_slugs", "fail", "select count(*) from (select slug from books where slug is not null group by 1 having count(*) > 1)"), ("titles_missing", "fail", "select count(*) from books where coalesce(trim(title), '') = ''"),
    ("languages_missing", "fail", "select count(*) from books where coalesce(trim(language), '') = ''"), ("categories_missing", "warning", "select count(*) from books where category is null"),
    ("page_numbers_below_1", "fail", "select count(*) from e where page_number < 1"), ("volumes_below_1", "fail", "select count(*) from e where volume_number < 1"),
    ("empty_texts", "warning", "select count(*) from e where coalesce(trim(text_raw, ' '), '') = ''"), ("texts_below_3", "info", "select count(*) from e where length(trim(text_raw, ' ')) < 3"),
    ("mean_length", "info", "select round(avg(length(text_raw)), 4) from e"), ("longest", "info", "select max(length(text_raw)) from e"),
    ("repeated_texts", "info", "select count(*) from (select text_raw from e where text_raw is not null group by 1 having count(*) > 10)"), ("control_characters", "info", "select count(*) from e where regexp_matches(text_raw, '[\\x00-\\x08\\x0E-\\x1F]')"),
    ("outer_blanks", "info", "select count(*) from e where regexp_matches(text_raw, '^ | $')"), ("duplicate_orders", "fail", "select count(*) from (select page_id, element_order from e group by all having count(*) > 1)"),
    ("unknown_types", "warning", "select count(*) from e where coalesce(element_type, 'unknown') = 'unknown'"), ("updated_before_created", "fail", "select count(*) from e where updated_at < created_at"),
    ("elements_per_page_mean", "info", "select round(avg(n), 4) from pp"), ("elements_per_page_median", "info", "select median(n) from pp"), ("elements_per_page_max", "info", "select max(n) from pp"), ("elements_per_page_min", "info", "select min(n) from pp"),
    ("sparse_pages", "warning", "select count(*) from pp where n < 3"), ("dense_pages", "warning", "select count(*) from pp where n > 300"), ("fullest_page", "info", "select arg_max(page_id, (n, -page_id)) from (select page_id, count(*) as n from e group by page_id)"), ("pages_per_book_max", "info", "select max(n) from (select count(distinct page_id) as n from e group by book_id)"),
]

SQL = {
    "element_books": _E + ", n as (select page_id as p, count(*) as on_page from e group by 1) select element_id, page_id, on_page, title, coalesce(category, '?') as category from e left join n on page_id = p left join books b on e.book_id = b.book_id",
    "book_pages": "select book_id, title from books where title ilike '%ال%' order by title, book_id limit 10 offset 10",
    "layout_classes": _LAYOUT + " select element_id, v[1] as kind, round(cast(v[2] as double), 4) as confidence from lay",
    "layout_distribution": _LAYOUT + " select v[1] as kind, count(*) as elements, round(100.0 * count(*) / (select count(*) from lay), 4) as percent, round(avg(round(cast(v[2] as double), 4)), 6) as mean_confidence from lay group by 1",
    "report_numbers": f"with n as (select raw, list_sort(list_transform(regexp_extract_all({duck.tr('raw', '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')}, '[0-9]+'), lambda x: cast(x as bigint)), 'desc') as s from {_values(NUMBERS, 'raw')}) select raw, s[1] as hadith, s[2] as sequence, case when s[1] is null then 0.0 when s[2] is null then 0.85 when s[1] > s[2] * 3 then 0.9 else 0.6 end as confidence from n",
    "document_figures": f"with t as (select doc_id, coalesce(text, '') as t from documents) select doc_id, length(t) as characters, len(list_filter(regexp_split_to_array(t, {duck.cls(arabic.SPACES)}), lambda w: w <> '')) as words, case when t = '' then 0 else len(string_split(t, chr(10))) end as lines from t",
    "document_words": f"with x as (select doc_id, unnest([{{'what': 'blocks', 'n': len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda b: trim(b, ' ') <> ''))}}, {{'what': 'words', 'n': len(list_filter(regexp_split_to_array(text, {duck.cls(arabic.SPACES)}), lambda w: w <> ''))}}, {{'what': 'links', 'n': len(regexp_extract_all(text, {duck.q(extract.LINK)}))}}]) as r from documents) select doc_id, r.what as what, sum(r.n)::bigint as n from x group by all having sum(r.n) > 0",
    "table_of_contents": _E + f", t as (select element_id, regexp_replace(regexp_extract(text_raw, {duck.cls('(' + extract.HEADING + ')')}, 1), {duck.cls('^[0-9' + chr(92) + 'u0660-' + chr(92) + 'u0669]+' + chr(92) + 's*[ـ' + chr(92) + '-–]' + chr(92) + 's*')}, '') as title from e) select element_id, case " + " ".join(f"when starts_with(title, '{w}') then {n}" for w, n in extract.LEVELS.items()) + f" end as level, {duck.collapse('title')} as title from t where title <> ''",
    "report_splits": f"with q0 as (select raw from {_values(REPORTS, 'raw')}), {_splits('q0')} select raw, number, isnad, matn, confidence, isnad_start, isnad_end, matn_start, matn_end from sl",
    "element_splits": f"{_ER}, q0 as (select element_id, text_raw as raw from e), {_splits('q0')} select element_id, number, length(isnad) as isnad_length, length(matn) as matn_length, confidence, isnad_start, isnad_end, matn_start, matn_end, true as same, isnad <> '' and matn <> '' as complete, array_to_string(names, '|') as narrators, imam from sl",
    "concepts_in_texts": _CONCEPTS + ", " + _E.removeprefix("with ") + f", t as (select distinct id, {duck.match_key('term')} as key from (select id, unnest(list_append(coalesce(synonyms, []), label)) as term from c) where term is not null), x as (select element_id as text_id, ' ' || {duck.match_key('text_normalized')} || ' ' as body from e where text_normalized is not null), y as (select distinct unnest(string_split(body, ' ')) as w, text_id, body from x) select distinct text_id, id from t join y on y.w = string_split(key, ' ')[1] and contains(body, ' ' || key || ' ') where key <> ''",
    "stretch_and_ligatures": _ER + f", s as (select element_id, len(regexp_extract_all(text_raw, 'ـ+')) as removed, string_split(replace(text_raw, 'ـ', ''), ' ') as ws from e) select element_id, cast(removed as int) as removed, cast(len(list_filter(ws, lambda w: w in ({', '.join(duck.q(k) for k in structure.LIGATURES)}))) as int) as fixed, sha1(array_to_string(list_transform(ws, lambda w: case " + " ".join(f"when w = {duck.q(k)} then {duck.q(v)}" for k, v in structure.LIGATURES.items()) + " else w end), ' ')) as text_hash from s",
    "torn_words": WORDS + f""", p as (select tokens[i] as l, tokens[i + 1] as r from w, range(1, 3000) x(i) where i < len(tokens)), c as (select l as "left", r as "right", count(*) as times from p group by all), k as (select token as word, count(*) as f from (select unnest(tokens) as token from w) group by 1 having count(*) >= 3),
 g as (select *, "left" || "right" as joined, case when length("left") <= length("right") then "left" else "right" end as short from c where regexp_matches("left", '^[\\x{{0621}}-\\x{{064A}}]+$') and regexp_matches("right", '^[\\x{{0621}}-\\x{{064A}}]+$') and "left" not in ({", ".join(duck.q(x) for x in structure.PROTECTED)}) and "right" not in ({", ".join(duck.q(x) for x in structure.PROTECTED)}))
 select "left", "right", joined, times from g where least(length("left"), length("right")) <= 3 and length(joined) >= 4 and joined in (select word from k) and short not in (select word from k)""",
    "question_intents": _INTENT + " select query, label, confidence, confidence >= 0.7 as confident from it",
    "question_routes": _INTENT + ", pl as (select * from (values " + ", ".join(f"('{k}', '{r}', {v})" for k, rs in reasoning.PLANS.items() for r, v in rs.items()) + ") v(label, route, weight)) select query, 'fts' as route, 1.0 as weight from it where confidence < 0.4 union all select query, route, weight from it join pl using (label) where confidence >= 0.4 and (n > 2 or route <> 'semantic')",
    "evidence_items": _HITS + " select query_id, element_id, admitted, rejected, citable, concat_ws(' ', coalesce(title, 'مصدر غير مسمّى'), case when coalesce(volume_number, 0) <> 0 then 'ج' || volume_number end, case when coalesce(page_number, 0) <> 0 then 'ص' || page_number end) as citation from ev",
    "query_verdicts": _HITS + f", p as (select query_id, sum(cast(admitted as int)) as items, sum(cast(citable as int)) as citable, count(distinct case when citable then (book_id, page_number) end) as ds, coalesce(avg(case when citable then ocr_quality end), 0) as quality, {_CON} from ev group by query_id), c as (select *, " + " + ".join(f"x{i}" for i in range(len(reasoning.CONTRADICTIONS))) + """ as conflicts from p),
 f as (select *, round((query_id % 10) / 10 * 0.25 + least(1.0, citable / 2) * 0.25 + least(1.0, ds / 2) * 0.2 + quality * 0.2 + (case when conflicts > 0 then 0.4 else 1.0 end) * 0.1 + 1e-9, 4) as confidence from c),
 v as (select *, case when conflicts > 0 then 'needs_review' when confidence >= 0.7 and citable >= 2 and ds >= 2 then 'answerable' when confidence >= 0.5 and citable >= 1 then 'partial' else 'insufficient' end as verdict from f)
 select query_id, items::bigint as items, citable::bigint as citable, ds as distinct_sources, case when items > 0 then round(citable / items, 4) else 0.0 end as coverage, round(quality + 1e-9, 4) as quality, conflicts, confidence, verdict, verdict in ('answerable', 'partial') and citable > 0 as may_answer from v""",
    "lifespan_links": f"with {_links(_LIVES)} select * from links",
    "chain_continuity": f"with {_links(_LIVES)} {_CONT}",
    "house_chains": f"with n as (select id, max(nisba) as nisba, max(death_year) as death from narrators where nisba is not null and death_year is not null group by id), src as (select nisba as chain_id, (-death, id) as pos, id as name, cast(null as int) as birth, death from n), {_links('src')} {_CONT}",
    "saying_rulings": "with b as (select * from " + _values(SAYINGS, "id, body") + ") select id, {0} as ruling, {1} as marker, {2} as strength from b".format(*_ruling("body", ["المسح", "الماء"])),
    "element_rulings": _ER + f", b as (select {duck.rep('text_raw', arabic.SPACES, ' ')} as body from e) " + "select {0} as ruling, {2} as strength, count(*) as elements from b group by all".format(*_ruling("body", [])),
    "merged_edges": _CONCEPTS + " select source, target, type, sum(weight) as weight, max(confidence) as confidence, count(*) as evidence from ed group by all",
    "graph_statistics": _CONCEPTS + " select type, count(*) as edges, count(distinct source) as sources, count(distinct target) as targets from ed group by type",
    "graph_neighbours": _CONCEPTS + ", k as (select distinct source as node from ed where " + _ASKED.format("source") + ") select node, target as neighbour, 'out' as direction, type from ed join k on source = node union all select node, source, 'in', type from ed join k on target = node",
    "graph_subgraph": _CONCEPTS + ", n1 as (select 'c000000005' as node union select target from ed where source = 'c000000005' union select source from ed where target = 'c000000005') select distinct source, target, type from ed where source in (select node from n1) or target in (select node from n1)",
    "graph_common": _CONCEPTS + ", b as (select source, target from ed union select target, source from ed) select target as node from b where source = 'c000000036' intersect select target from b where source = 'c000000058'",
    "graph_paths": _CONCEPTS + ", e1 as (select source as s, target as t, max(confidence) as c from ed group by all), st as (select distinct source as start from ed where " + _ASKED.format("source") + """),
 wt as (select distinct start, b.target from st join ed a on start = a.source join ed b on a.target = b.source where b.target in (select target from ed where type = 'related') and start <> b.target),
 h as (with recursive x as (select start, target, start as at_, [start] as path, 1.0::double as confidence, 0 as hops from wt union all select start, target, t, list_append(path, t), confidence * c, hops + 1 from x join e1 on at_ = s where at_ <> target and not list_contains(path, t) and hops < 4) select * from x where at_ = target)
 select start, target, hops, round(confidence, 6) as confidence, p as path from (select *, array_to_string(path, '>') as p, row_number() over (partition by start, target order by hops, confidence desc, array_to_string(path, '>')) as rn from h) where rn <= 10""",
    "concept_expansion": _CONCEPTS + ", k as (select id from c where " + _ASKED.format("id") + """), d as (with recursive x as (select id as asked, id as at_, 0 as level from k union all select asked, c.id, level + 1 from x join c on c.parent = at_ and c.parent <> c.id where level < 5) select asked, at_, min(level) as level from x group by all),
 tm as (select asked, term, min(level) as level from (select asked, level, unnest(list_append(coalesce(synonyms, []), label)) as term from d join c on at_ = id) where term is not null group by all), bad as (select k.id as asked, l.label as term from k join c on k.id = c.id, unnest(c.excludes) u(x) join c l on l.id = u.x),
 pl as (select tm.*, row_number() over (partition by asked order by level, term) as p from tm anti join bad using (asked, term)) select asked, term, level from pl where p <= 40""",
    # The bins in order; one that falls below the one before is averaged with it, from the left.
    "calibration": _BINS.replace("with o as", "with recursive o as") + """, n as (select *, row_number() over (order by bin) as i from b),
 f as (select i, [bin] as bins, [predicted] as ps, [observed] as os, [count] as cs from n where i = 1 union all select n.i, list_append(bins, n.bin), list_append(ps, n.predicted),
  case when n.observed < os[-1] then list_append(list_append(os[:-2], (n.observed * n.count + os[-1] * cs[-1]) / (n.count + cs[-1])), (n.observed * n.count + os[-1] * cs[-1]) / (n.count + cs[-1])) else list_append(os, n.observed) end, list_append(cs, n.count) from f join n on n.i = f.i + 1)
 select unnest(bins) as bin, round(unnest(ps), 6) as predicted, round(unnest(os), 6) as observed, unnest(cs) as count from f where i = (select max(i) from f)""",
    "calibration_error": _BINS + " select round(coalesce(sum(abs(predicted - observed) * count) / sum(count), 0), 4) as ece from b",
    "retrieval_metrics": _JUDGED + " select * from m",
    "metric_summary": _JUDGED + " select * from (select 'recall_at_k' as metric, round(avg(recall_at_k), 4) as value from m union all select 'reciprocal_rank', round(avg(reciprocal_rank), 4) from m union all select 'precision_at_1', round(avg(precision_at_1), 4) from m union all select 'relevant_p50', median(relevant) from m union all select 'relevant_max', max(relevant) from m)",
    "clean_queries": _E + ", t as (select element_id as id, text_normalized as text, list_filter(regexp_split_to_array(trim(text_normalized), '[\\s\\p{Z}]+'), lambda w: w <> '') as ws from e where text_normalized is not null) select id, trim(text, ' ') as query from t where len(ws) between 6 and 22 and len(regexp_extract_all(text, '[0-9\\x{0660}-\\x{0669}\\x{06F0}-\\x{06F9}]')) <= 0.08 * length(text) and len(list_filter(ws, lambda w: length(w) <= 2 and regexp_matches(w, '^\\p{L}+$'))) <= 0.25 * len(ws) and not regexp_matches(text, '\\.{3,}')",
    "distinctive_windows": WORDS + ", f as (select token, count(*) as frequency from (select unnest(tokens) as token from w) group by 1), u as (select element_id as id, unnest(tokens) as token, generate_subscripts(tokens, 1) as p from w), x as (select id, p, sum(ln(1 + frequency)) over o as s, string_agg(u.token, ' ') over o as win, count(*) over o as n from u join f using (token) window o as (partition by id order by p rows between current row and 4 following)) select id, arg_min(win, (round(s, 9), p)) as window from x where n = 5 group by id",
    "event_counts": "select user_id, event_type, count(*) as n, max(ts) as last from events group by all",
    "budget_trips": "with r as (select user_id, ts, event_id, sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as used from events) select user_id, trip_at, round(used, 6) as used from (select user_id, event_id as trip_at, used, row_number() over (partition by user_id order by ts, event_id) as k from r where used > 500) where k = 1",
    # Each key's requests in order; a miss stores the value, which lives an hour.
    "cache_hits": "with recursive r as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events), x as (select user_id, event_id, n, t + 3600000000 as until, false as hit from r where n = 1 union all select r.user_id, r.event_id, r.n, case when r.t <= x.until then x.until else r.t + 3600000000 end, r.t <= x.until from x join r on r.user_id = x.user_id and r.n = x.n + 1) select event_id, hit from x",
    "valid_memories": "select substr(sha1(event_type || '::' || trim(regexp_replace(props, '\\s+', ' ', 'g'))), 1, 20) as key, event_id from events where value > 20 and least(1.0, value / 50) >= 0.7 and event_id % 3 <> 0 and (select max(floor(epoch_us(ts) / 1000000)) from events) - floor(epoch_us(ts) / 1000000) <= 604800",
    "events_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "events_sliding": "with w as (select date_trunc('hour', ts) - to_hours(k) as start, value from events, (values (0), (1)) v(k)) select start, count(*) as n, round(sum(value), 4) as total from w group by all",
    "events_sessions": "with g as (select user_id, ts, event_id, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 1800000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as start, max(ts) as last, count(*) as n from s group by user_id, k",
    "page_number_gaps": "with d as (select distinct book_id, page_number from page_elements where page_number is not null), x as (select *, lead(page_number) over (partition by book_id order by page_number) as n from d) select book_id, page_number as after, n - page_number - 1 as missing from x where n - page_number > 1",
    "element_order_gaps": "with d as (select distinct page_id, element_order from page_elements where element_order is not null), x as (select *, lead(element_order) over (partition by page_id order by element_order) as n from d) select page_id, element_order as after, n - element_order - 1 as missing from x where n - element_order > 1",
    "store_audit": _E + ", pp as (select count(*) as n from e group by page_id), a as (" + " union all ".join(f"select '{n}' as \"check\", '{s}' as severity, cast(({q}) as double) as value" for n, s, q in _AUDIT) + ") select * from a union all select 'score', 'info', greatest(0, 100 - 5 * sum(case when severity = 'fail' and value > 0 then 1 else 0 end) - sum(case when severity = 'warning' and value > 0 then 1 else 0 end)) from a",
}
