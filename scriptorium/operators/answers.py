"""From a question to an answer and its report: query forms, candidate questions, checks, composition, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic, scoring
from scriptorium.operators import corpus
from scriptorium.operators.reasoning import CONTRADICTIONS

# ------------------------------------------------------------------ fixed values: names and sentences of checks and reports
CHECKS = ["وضوح النية", "عدد الأدلة", "استقلال المواضع", "جودة النص", "الاتساق"]
MISSING = {
    "intent": "السؤال غير محدد النية — يُطلب توضيحه", "citable": "يلزم 2 أدلة صالحة على الأقل", "distinct": "الأدلة من موضع واحد — لا تعاضد بينها",
    "quality": "جودة المسح منخفضة — يُنصح بمراجعة الأصل",
}
NO_EVIDENCE, INCOMPLETE = "لا أدلة كافية", "الأدلة ناقصة — تُقدَّم بتحفّظ"
SECTIONS = ["الخلاصة", "الأدلة الموثّقة", "الرواة", "تعارضات ظاهرة", "ما يحتاج مراجعة", "أساس الحكم", "مسار المعالجة"]
PASSED, FAILED = "اجتاز", "لم يجتز"
LEAST = {"intent": 0.4, "citable": 2, "distinct": 2, "quality": 0.5}
VERSIONS = {"pipeline": "1.0.0", "ocr": "1.2.0", "signals": "1.1.0", "ranking": "2.3.0", "layout": "1.1.0"}
# ------------------------------------------------------------------


def query_forms(query: Column) -> Column:
    """struct(original, normalized, search_form, tokens, phrases): a query as searched; phrases are the search form and
    its sequences of two to four words, each once, in order."""
    original = F.btrim(F.coalesce(query, F.lit("")))
    form = arabic.search_form(original)
    tokens = F.filter(F.split(form, " "), lambda w: w != "")
    grams = F.concat(F.array(form), *[corpus.ngrams(tokens, n) for n in (2, 3, 4)])
    return F.struct(original.alias("original"), arabic.surface_form(original).alias("normalized"), form.alias("search_form"), tokens.alias("tokens"), F.filter(F.array_distinct(grams), lambda p: p != "").alias("phrases"))


def candidate_queries(queries: DataFrame, suggestions: DataFrame, neighbours: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, place, candidate): what is searched for each query (query_id, query): its own form first, then what
    was suggested for it (query_id, rank, text), then the neighbours (token, place, neighbour) of its first ``most`` words.

    Suggestions of one general word are left out; a short query of general words keeps only candidates of two words or
    more. Each candidate comes once, where it came first. Suggestions are bounded by their own top-k."""
    q = queries.select("query_id", query_forms(F.col("query")).alias("f")).select("query_id", "f.search_form", "f.tokens", "f.normalized", "f.original")
    own = q.select("query_id", F.posexplode(F.array("search_form", arabic.search_form(F.col("normalized")), arabic.search_form(F.col("original")))).alias("i", "candidate")).select("query_id", F.lit(0).alias("part"), "i", "candidate")
    told = suggestions.select("query_id", F.lit(1).alias("part"), F.col("rank").alias("i"), arabic.search_form(F.col("text")).alias("candidate"))
    words = q.select("query_id", F.posexplode(F.slice("tokens", 1, most)).alias("w", "t"))
    near = words.join(neighbours, F.col("t") == F.col("token")).select("query_id", F.lit(2).alias("part"), (F.col("w") * 100 + F.col("place")).alias("i"), F.col("neighbour").alias("candidate"))
    facts = q.select(F.col("query_id").alias("q"), "search_form", (scoring.is_generic_query(F.col("tokens")) & (F.size("tokens") <= 2)).alias("short"))
    every = own.unionByName(told).unionByName(near).join(facts, F.col("query_id") == F.col("q"))
    fit = (F.col("part") == 0) | scoring.keeps_candidate(F.col("candidate"), F.col("search_form"))
    wide = ~F.col("short") | (F.col("candidate") == F.col("search_form")) | (F.size(F.split("candidate", " ")) >= 2)
    first = every.filter((F.col("candidate") != "") & fit & wide).groupBy("query_id", "candidate").agg(F.min(F.struct("part", "i")).alias("at"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "candidate")).alias("place"), "candidate")


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def checks(verdicts: DataFrame, confidences: DataFrame) -> DataFrame:
    """(query_id, ord, name, passed, detail, missing): the five checks of each verdict, in order."""
    v = verdicts.join(confidences.withColumnRenamed("query_id", "__q"), F.col("query_id") == F.col("__q"), "left").withColumn("ic", F.coalesce("intent_confidence", F.lit(0.0)))
    text = lambda c: c.cast("string")
    rows = [
        (F.col("ic") >= LEAST["intent"], F.concat(F.lit("ثقة النية "), _two(F.col("ic"))), MISSING["intent"]),
        (F.col("citable") >= LEAST["citable"], F.concat(text(F.col("citable")), F.lit(" دليلاً صالحاً من "), text(F.col("items"))), MISSING["citable"]),
        (F.col("distinct_sources") >= LEAST["distinct"], F.concat(text(F.col("distinct_sources")), F.lit(" موضعاً مستقلاً")), MISSING["distinct"]),
        (F.col("quality") >= LEAST["quality"], F.concat(F.lit("متوسط جودة المسح "), _two(F.col("quality"))), MISSING["quality"]),
        (F.col("conflicts") == 0, F.when(F.col("conflicts") == 0, "لا تعارض ظاهر").otherwise(F.concat(text(F.col("conflicts")), F.lit(" تعارض محتمل"))), None),
    ]
    made = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), p.alias("passed"), d.alias("detail"), F.when(~p, F.lit(m).cast("string")).alias("missing")) for i, (n, (p, d, m)) in enumerate(zip(CHECKS, rows), 1)]
    return v.select("query_id", F.explode(F.array(*made)).alias("c")).select("query_id", "c.*")


def apparent_conflicts(bundle: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, ord, line): the opposed words that citable texts of one query hold apart from each other."""
    c = F.col("citable")
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), arabic.SPACES, " ")
    has = [(F.max((c & F.contains(t, F.lit(a)) & ~F.contains(t, F.lit(b))).cast("int")) * F.max((c & F.contains(t, F.lit(b)) & ~F.contains(F.replace(t, F.lit(b), F.lit("")), F.lit(a))).cast("int"))).alias(f"x{i}") for i, (a, b) in enumerate(CONTRADICTIONS)]
    per = bundle.groupBy("query_id").agg(*has)
    lines = [F.when(F.col(f"x{i}") == 1, F.struct(F.lit(i).alias("ord"), F.lit(f"تعارض ظاهر بين «{a}» و«{b}»").alias("line"))) for i, (a, b) in enumerate(CONTRADICTIONS)]
    return per.select("query_id", F.explode(F.array_compact(F.array(*lines))).alias("l")).select("query_id", "l.*")


def composed(verdicts: DataFrame, told_checks: DataFrame) -> DataFrame:
    """(query_id, answered, verdict, confidence, citations, caveats, refusal): the answer, or why there is none. No
    answer without something to cite; a partial one says that it is incomplete."""
    missing = told_checks.groupBy(F.col("query_id").alias("m")).agg(F.array_sort(F.collect_list(F.when(F.col("missing").isNotNull(), F.struct("ord", "missing")))).alias("l"))
    v = verdicts.join(missing, F.col("query_id") == F.col("m"), "left")
    said = F.array_join(F.transform("l", lambda x: x["missing"]), "; ")
    answered = F.col("may_answer")
    caveats = F.concat_ws("; ", F.when(F.col("verdict") == "partial", INCOMPLETE), F.nullif(said, F.lit("")))
    return v.select(
        "query_id", answered.alias("answered"), "verdict", "confidence", F.when(answered, F.col("citable")).otherwise(0).cast("long").alias("citations"),
        F.when(answered, caveats).otherwise("").alias("caveats"), F.when(answered, "").otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit(NO_EVIDENCE))).alias("refusal"),
    )


def report(answers: DataFrame, bundle: DataFrame, told_checks: DataFrame, conflicts: DataFrame, narrators: DataFrame, evidence: int = 8) -> DataFrame:
    """(query_id, section, ord, line): the report of each answer, a row a line.

    Sections are the summary; up to ``evidence`` cited texts, the best first; the narrators (query_id, line, ord);
    apparent conflicts (query_id, ord, line); what is missing and up to five rejected hits; and the checks. A section
    without lines does not appear."""
    line = lambda df, n, ord_, text: df.select("query_id", F.lit(n).alias("section"), ord_.cast("int").alias("ord"), text.alias("line"))
    summary = F.when(F.col("answered"), F.concat(F.lit("وُجدت "), F.col("citations").cast("string"), F.lit(" شواهد موثّقة تجيب عن السؤال."))).otherwise(F.concat(F.lit("لم تكف الأدلة لإجابة موثّقة. "), F.col("refusal")))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "element_id")
    cited = bundle.join(answers.filter("answered").select(F.col("query_id").alias("__a")), F.col("query_id") == F.col("__a"), "left_semi").filter("citable").withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= evidence)
    refused = bundle.filter("rejected").withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= 5)
    parts = [
        line(answers, 1, F.lit(1), summary),
        line(cited, 2, F.col("place"), F.concat("citation", F.lit(" — "), F.substring(F.coalesce("text", F.lit("")), 1, 150))),
        line(narrators, 3, F.col("ord"), F.col("line")),
        line(conflicts, 4, F.col("ord") + 1, F.col("line")),
        line(told_checks.filter("missing is not null"), 5, F.col("ord"), F.col("missing")),
        line(refused, 5, F.col("place") + 100, F.concat(F.lit("عنصر "), F.col("element_id").cast("string"), F.lit(" استُبعد: جودة المسح "), _two(F.coalesce("ocr_quality", F.lit(0.0))), F.lit(" دون العتبة"))),
        line(told_checks, 6, F.col("ord"), F.concat("name", F.lit(": "), "detail", F.lit(" ("), F.when(F.col("passed"), PASSED).otherwise(FAILED), F.lit(")"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = F.element_at(F.create_map(*[x for i, s in enumerate(SECTIONS, 1) for x in (F.lit(i), F.lit(s))]), F.col("section"))
    return out.withColumn("section", names)


def narrator_counts(names: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, name, occurrences, place): the ``k`` names that the chains of each query's hits (query_id, name) have
    most often; equal ones by name."""
    n = names.groupBy("query_id", "name").agg(F.count("*").alias("occurrences"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("occurrences"), "name"))).filter(F.col("place") <= k)
