"""Questions and evidence: intents, plans, evidence bundles, verdicts, name resolution, lifespans, rulings, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import arabic
from scriptorium.runtime import stored

# ------------------------------------------------------------------ fixed values: markers, weights, thresholds
D = "0-9\\u0660-\\u0669"
RULING_MARKERS = ["ما حكم", "حكم", "هل يجوز", "هل يجب", "يجوز", "يجب", "يحرم", "مستحب", "مكروه", "واجب", "حرام", "مباح", "فتوى"]
CONCEPT_MARKERS = ["ما معنى", "معنى", "ما هو", "ما هي", "تعريف", "المقصود", "الفرق بين"]
HADITH_MARKERS = ["قال رسول", "قال النبي", "قال أبو", "قال ابو", "سألت", "سالت", "سألته", "روي", "روى", "عن النبي", "عن رسول"]
TITLES = ["الكليني", "الصدوق", "الطوسي", "المفيد", "البرقي", "الصفار", "الحلبي", "زرارة", "محمد بن مسلم", "أبي بصير", "ابي بصير"]
CEILINGS = {"narrator": 0.95, "isnad": 0.93, "hadith": 0.92, "chapter": 0.95, "ruling": 0.9, "concept": 0.9, "citation": 0.93}
PLANS = {
    "narrator": {"fts": 1.0, "fuzzy": 0.9, "gazetteer": 1.2}, "isnad": {"fts": 1.0, "fuzzy": 1.0, "gazetteer": 1.1, "graph": 1.0},
    "hadith": {"fts": 1.0, "fuzzy": 0.9, "semantic": 0.8}, "chapter": {"fts": 1.2}, "ruling": {"fts": 0.9, "semantic": 1.1},
    "concept": {"semantic": 1.3, "fts": 0.7}, "citation": {"fts": 1.3}, "general": {"fts": 1.0, "fuzzy": 0.9},
}
CHECK_WEIGHTS = {"intent": 0.25, "citable": 0.25, "distinct": 0.2, "quality": 0.2, "consistency": 0.1}
RULINGS = {
    "obligatory": ["يجب", "واجب", "فريضة", "لا بد", "عليه أن"], "recommended": ["يستحب", "مستحب", "ينبغي", "أفضل", "سنة"],
    "permissible": ["يجوز", "لا بأس", "مباح", "لا حرج", "واسع"], "disliked": ["يكره", "مكروه", "لا أحب"],
    "forbidden": ["لا يجوز", "حرام", "يحرم", "لا يحل", "نهى"], "valid": ["يجزئ", "صحيح", "تم", "أجزأه"], "invalid": ["يعيد", "باطل", "لا يجزئ", "أعاد"],
}
EXPLICIT = ["يجب", "لا يجوز", "حرام", "واجب", "يحرم"]
OPPOSITES = [
    ("يجوز", "لا يجوز", "negation"), ("يجب", "لا يجب", "obligation"), ("واجب", "مستحب", "obligation"), ("لا بأس", "لا يجوز", "negation"),
    ("طاهر", "نجس", "purity"), ("يطهر", "لا يطهر", "purity"), ("حلال", "حرام", "negation"), ("يعيد", "لا يعيد", "obligation"), ("عليه", "ليس عليه", "obligation"),
]
CONTRADICTIONS = [("يجوز", "لا يجوز"), ("يجب", "لا يجب"), ("لا بأس", "لا يجوز"), ("طاهر", "نجس"), ("يطهر", "لا يطهر"), ("نعم", "لا")]
TOPIC_STOPS = "في من عن على الى ما لا ان قال الله عليه السلام به له هو هي ثم".split()
SPECIFIERS = ["إلا", "الا", "إذا", "اذا", "إن كان", "ان كان", "في حال", "عند", "ما لم", "بشرط"]
QUANTITY = "[\\u0660-\\u06690-9]+|كرّ|كر|رطل|مدّ|مد|صاع"
IMAMS = "أبا جعفر|ابا جعفر|أبي جعفر|ابي جعفر|أبا عبد الله|ابا عبد الله|أبي عبد الله|ابي عبد الله|أبا الحسن|ابا الحسن|الرضا|الصادق|الباقر"
HINTS = {
    "specific": ("general_specific", 0.55), "quantity": ("absolute_restricted", 0.45), "case": ("different_case", 0.4), "dissimulation": ("taqiyya", 0.2),
    "purity": ("different_case", 0.35), "none": ("unresolved", 0.0),
}
LIFESPAN, HEARING_AGE, OVERLAP = 70, 10, 5
FEW_WORDS = 10
LEADING_PARTICLES = ["وعن ", "فعن ", "ثم عن ", "عن ", "وعنه عن ", "عنه عن ", "و ", "ف ", "حدثنا ", "حدّثنا ", "أخبرنا ", "اخبرنا ", "وباسناده عن ", "وبإسناده عن ", "باسناده عن ", "بإسناده عن "]
TRAILING_PARTICLES = [" عن", " قال", " رحمه الله", " رضي الله عنه", " ،"]
# ------------------------------------------------------------------


def _any(c: Column, options: list[str]) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | F.contains(c, F.lit(o))
    return out


def intent(query: Column) -> Column:
    """struct(label, confidence, second): weighted evidence per intent, saturating below its ceiling; a close second
    lowers the confidence; without evidence the intent is general."""
    q = F.btrim(F.coalesce(query, F.lit("")))
    n = F.size(F.filter(F.split(q, arabic.SPACES), lambda w: w != ""))
    nasab = F.regexp_count(q, F.lit("(?:^|\\s)(?:بن|ابن)\\s"))
    chapter = q.rlike("^\\s*(?:باب|أبواب|ابواب|كتاب|فصل|مقدمة|مقدمه)\\s")
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    trans = F.regexp_count(q, F.lit("(?:^|\\s)(?:عن|حدثنا|حدّثنا|أخبرنا|اخبرنا)\\s"))
    totals = {
        "narrator": F.when(nasab == 1, 0.55).when(nasab > 1, 0.75).otherwise(0.0) + w(q.rlike("(?:^|\\s)(?:أبو|ابو|أبي|ابي|أبا|ابا|أم|ام)\\s"), 0.45) + w(_any(q, TITLES), 0.6) + w((n >= 2) & (n <= 6) & (nasab > 0), 0.3),
        "isnad": w(q.rlike("^\\s*(?:وبإسناده|بإسناده|وباسناده|باسناده|وعنه)"), 0.8) + F.when(trans >= 2, 0.7).when((trans == 1) & (nasab > 0), 0.4).otherwise(0.0),
        "hadith": w(_any(q, HADITH_MARKERS), 0.7) + w((n >= 4) & (nasab == 0) & ~chapter, 0.35),
        "chapter": w(chapter, 1.15),
        "ruling": w(_any(q, RULING_MARKERS), 0.65) + w(q.startswith("ما حكم") | q.startswith("هل "), 0.5),
        "concept": w(_any(q, CONCEPT_MARKERS), 1.05),
        "citation": w(q.rlike(f"[\\[\\]]\\s*[{D}\\s]+[\\]\\[]|ج\\s*[{D}]+|ص\\s*[{D}]+"), 1.10),
    }
    # Of equal scores the earlier intent of this list is first.
    scored = F.array(*[F.struct((-F.round((1 - F.pow(F.lit(0.5), t / 0.35)) * CEILINGS[k], 4)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, t) in enumerate(totals.items())])
    order = F.array_sort(scored)
    top, second = F.element_at(order, 1), F.element_at(order, 2)
    best, next_ = -top["s"], -second["s"]
    return F.struct(
        F.when(best < 0.35, "general").otherwise(top["k"]).alias("label"),
        F.when(q == "", 0.0).when(best < 0.35, F.round(F.least(F.lit(0.45), 0.15 + 0.05 * n), 4)).when(best - next_ < 0.15, F.round(best * 0.85, 4)).otherwise(best).alias("confidence"),
        second["k"].alias("second"),
    )


def confident(confidence: Column) -> Column:
    return confidence >= 0.7


def routes(query: Column, label: Column, confidence: Column) -> Column:
    """array of struct(route, weight): the engines a question goes to. Unclear questions go to full text only; short
    ones not to vectors."""
    n = F.size(F.filter(F.split(F.btrim(F.coalesce(query, F.lit(""))), arabic.SPACES), lambda w: w != ""))
    plan = F.array().cast("array<struct<route:string,weight:double>>")
    for k, parts in PLANS.items():
        arr = F.array(*[F.struct(F.lit(r).alias("route"), F.lit(float(v)).alias("weight")) for r, v in parts.items()])
        plan = F.when(label == k, arr).otherwise(plan)
    cheap = F.array(F.struct(F.lit("fts").alias("route"), F.lit(1.0).alias("weight")))
    return F.when(confidence < 0.4, cheap).otherwise(F.filter(plan, lambda r: (n > 2) | (r["route"] != "semantic")))


def evidence(hits: DataFrame, most: int = 10, least_quality: float = 0.2) -> DataFrame:
    """``hits`` (query_id, element_id, book_id, title, volume_number, page_number, score, ocr_quality) with admitted,
    citable and citation: hits of too poor a scan are rejected, the first ``most`` others admitted."""
    good = F.coalesce(F.col("ocr_quality"), F.lit(0.0)) >= least_quality
    place = F.sum(good.cast("int")).over(Window.partitionBy("query_id").orderBy(F.desc("score"), "element_id").rowsBetween(Window.unboundedPreceding, 0))
    full = (F.coalesce("book_id", F.lit(0)) != 0) & F.col("element_id").isNotNull() & (F.coalesce("page_number", F.lit(0)) != 0)
    return hits.withColumn("n", place).withColumn("admitted", good & (F.col("n") <= most)).withColumn("rejected", ~good & (F.col("n") < most)).withColumn(
        "citable", F.col("admitted") & full & (F.col("ocr_quality") >= 0.35)
    ).withColumn(
        "citation",
        F.concat_ws(" ", F.coalesce("title", F.lit("مصدر غير مسمّى")), F.when(F.coalesce("volume_number", F.lit(0)) != 0, F.concat(F.lit("ج"), F.col("volume_number"))), F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit("ص"), F.col("page_number")))),
    ).drop("n")


def verdicts(bundle: DataFrame, confidences: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, items, citable, distinct_sources, coverage, quality, conflicts, confidence, verdict, may_answer)."""
    c = F.col("citable")
    with_a = [F.max((c & F.contains(F.col(text), F.lit(a)) & ~F.contains(F.col(text), F.lit(b))).cast("int")).alias(f"a{i}") for i, (a, b) in enumerate(CONTRADICTIONS)]
    with_b = [F.max((c & F.contains(F.col(text), F.lit(b)) & ~F.contains(F.replace(F.col(text), F.lit(b), F.lit("")), F.lit(a))).cast("int")).alias(f"b{i}") for i, (a, b) in enumerate(CONTRADICTIONS)]
    per = bundle.groupBy("query_id").agg(
        F.sum(F.col("admitted").cast("int")).alias("items"), F.sum(c.cast("int")).alias("citable"),
        F.count_distinct(F.when(c, F.struct("book_id", "page_number"))).alias("distinct_sources"),
        F.coalesce(F.avg(F.when(c, F.col("ocr_quality"))), F.lit(0.0)).alias("quality"), *with_a, *with_b,
    )
    conflicts = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(len(CONTRADICTIONS))), F.lit(0))
    told = per.withColumn("conflicts", conflicts).join(confidences.withColumnRenamed("query_id", "__q"), F.col("query_id") == F.col("__q"), "left")
    ic = F.coalesce("intent_confidence", F.lit(0.0))
    w = CHECK_WEIGHTS
    confidence = F.round(
        ic * w["intent"] + F.least(F.lit(1.0), F.col("citable") / 2) * w["citable"] + F.least(F.lit(1.0), F.col("distinct_sources") / 2) * w["distinct"]
        + F.col("quality") * w["quality"] + F.when(F.col("conflicts") > 0, 0.4).otherwise(1.0) * w["consistency"] + 1e-9, 4,
    )
    verdict = (
        F.when(F.col("conflicts") > 0, "needs_review")
        .when((F.col("confidence") >= 0.7) & (F.col("citable") >= 2) & (F.col("distinct_sources") >= 2), "answerable")
        .when((F.col("confidence") >= 0.5) & (F.col("citable") >= 1), "partial").otherwise("insufficient")
    )
    return told.withColumn("confidence", confidence).withColumn("verdict", verdict).select(
        "query_id", "items", "citable", "distinct_sources", F.when(F.col("items") > 0, F.round(F.col("citable") / F.col("items"), 4)).otherwise(0.0).alias("coverage"),
        F.round(F.col("quality") + 1e-9, 4).alias("quality"), "conflicts", "confidence", "verdict", (F.col("verdict").isin("answerable", "partial") & (F.col("citable") > 0)).alias("may_answer"),
    )


def strip_particles(name: Column) -> Column:
    """A name without the particles before and behind it, however many."""
    edge = "[ .،:؛()\\[\\]«»]+"
    out = F.regexp_replace(F.coalesce(name, F.lit("")), f"^{edge}|{edge}$", "")
    lead = "|".join(sorted(LEADING_PARTICLES, key=len, reverse=True))
    tail = "|".join(TRAILING_PARTICLES)
    return F.regexp_replace(F.regexp_replace(out, f"^(?:(?:{lead}) *)+", ""), f"(?:(?:{tail})[ .،:؛]*)+$", "")


def _rarest(rows: DataFrame, words: str, frequency: DataFrame) -> DataFrame:
    """``rows`` once for each of the rarest words (column rare, all in rarest) by which names with 0.6 of their words in common meet."""
    keys = [c for c in rows.columns if c != words]
    x = rows.select("*", F.explode(words).alias("w")).join(frequency, F.col("w") == F.col("fw"), "left")
    # A name has few words: the list is as long as the name.
    per = x.groupBy(*keys, words).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "w"))).alias("l"))
    n = F.size(words)
    first = F.slice("l", 1, F.greatest(n - F.greatest(F.lit(2), F.ceil(n * 0.6 - 1e-9).cast("int")) + 1, F.lit(0)))
    return per.select(*keys, words, F.transform(first, lambda r: r["w"]).alias("rarest")).select(*keys, words, "rarest", F.explode("rarest").alias("rare"))


def _subsets(words: Column) -> Column:
    """The subsets of a short sorted list of words, blank between, by which names with 0.6 of their words, and two, in
    common are equal."""
    n = F.size(words)
    least = F.greatest(F.lit(2), F.ceil(n * 0.6 - 1e-9).cast("int"))
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1), lambda m: F.bit_count(m) >= least)
    return F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, i: F.getbit(m, i) == 1), " "))


def resolve_names(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(name, resolution, id, confidence): names against (id, form, canonical) forms.

    One id by its form is exact or an alias, several are ambiguous; else the nearest entry with two words or more in
    common and at least 0.6 of the longer name's words; else unresolved. The nearest is found by equality: two names have a
    set of words in common if either has it among its subsets, so the best entry of each subset and length is kept, and no
    names are compared pair by pair. Only where one has more than ``FEW_WORDS`` words, names meet by their rarest words."""
    forms = gazetteer.select("id", arabic.match_key(F.col("form")).alias("key"), (arabic.match_key(F.col("form")) == arabic.match_key(F.col("canonical"))).alias("main")).filter("key <> ''")
    forms = forms.groupBy("id", "key").agg(F.max("main").alias("main"))
    asked = names.select("name").distinct().withColumn("nk", arabic.match_key(strip_particles(F.col("name"))))
    held = forms.groupBy("key").agg(F.count("*").alias("ids"), F.min("id").alias("one"), F.max("main").alias("main"))
    direct = stored(asked.join(held, F.col("nk") == F.col("key"), "left"))  # read twice, and names are costly to make
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    open_names = direct.filter("ids is null and nk <> ''").select("name", words(F.col("nk")).alias("nws"))
    entries = forms.select("id", words(F.col("key")).alias("fws")).groupBy("fws").agg(F.max_by("id", F.struct(F.reverse(F.col("id")), "id")).alias("id"))
    sets, entries = stored(open_names.select("nws").distinct()), stored(entries)
    scored = lambda shared, n, m: F.round(shared / F.greatest(n, m), 4)
    top = lambda: F.max_by(F.struct("id", "score"), F.struct("score", F.reverse(F.col("id")), F.col("id")))
    few = lambda df, c: df.filter(F.size(c) <= FEW_WORDS).select("*", F.explode(_subsets(F.col(c))).alias("part"))
    held_by = few(entries, "fws").groupBy("part", F.size("fws").alias("fn")).agg(F.max_by("id", F.struct(F.reverse(F.col("id")), "id")).alias("id"))
    met = few(sets, "nws").withColumnRenamed("part", "asked").join(held_by, F.col("asked") == F.col("part"))
    met = met.select("nws", "id", scored(F.size(F.split("part", " ")), F.size("nws"), F.col("fn")).alias("score"))
    # A long one and its like: the rarest words of both, as many as may be missing and one more, have one in common.
    least = -(-6 * (FEW_WORDS + 1) // 10)
    longer_form, longer_name = entries.filter(F.size("fws") >= least), sets.filter(F.size("nws") >= least)
    frequency = longer_form.select(F.explode("fws").alias("fw")).groupBy("fw").agg(F.count("*").alias("often"))
    rare_form = _rarest(longer_form, "fws", frequency)
    rare_name = _rarest(longer_name.select("*", F.lit(0).alias("k")), "nws", frequency).select("nws", F.col("rarest").alias("rarest2"), F.col("rare").alias("rare2"))
    pairs = rare_name.join(rare_form, F.col("rare2") == F.col("rare")).filter(F.greatest(F.size("nws"), F.size("fws")) > FEW_WORDS)
    far = pairs.select("nws", "id", scored(F.size(F.array_intersect("nws", "fws")), F.size("nws"), F.size("fws")).alias("score"))
    found = met.unionByName(far).filter("score >= 0.6").groupBy("nws").agg(top().alias("b"))
    best = open_names.join(found.withColumnRenamed("nws", "__w"), F.col("nws") == F.col("__w")).select(F.col("name").alias("bn"), "b")
    j = direct.join(best, F.col("name") == F.col("bn"), "left")
    kind = F.when(F.col("ids") == 1, F.when(F.col("main"), "exact").otherwise("alias")).when(F.col("ids") > 1, "ambiguous").when(F.col("b").isNotNull(), "fuzzy").otherwise("unresolved")
    return j.select(
        "name", kind.alias("resolution"),
        F.when(F.col("ids") == 1, F.col("one")).when(F.col("ids") > 1, None).otherwise(F.col("b.id")).alias("id"),
        F.when(F.col("ids") == 1, F.when(F.col("main"), 1.0).otherwise(0.9)).when(F.col("ids") > 1, 0.5).otherwise(F.coalesce(F.col("b.score"), F.lit(0.0))).alias("confidence"),
    )


def can_meet(s_birth: Column, s_death: Column, t_birth: Column, t_death: Column) -> Column:
    """struct(relation, overlap): whether a pupil can have heard a teacher; a missing end of a life is estimated."""
    sb, sd = F.coalesce(s_birth, s_death - LIFESPAN), F.coalesce(s_death, s_birth + LIFESPAN)
    tb, td = F.coalesce(t_birth, t_death - LIFESPAN), F.coalesce(t_death, t_birth + LIFESPAN)
    hearing = sb + HEARING_AGE
    overlap = F.greatest(F.lit(0), F.least(sd, td) - F.greatest(hearing, tb + HEARING_AGE))
    relation = (
        F.when(sb.isNull() | td.isNull(), "unknown").when(hearing > td, "impossible").when(overlap < OVERLAP, "unknown")
        .when(s_birth.isNull() | t_death.isNull(), "likely").otherwise("certain")
    )
    return F.struct(relation.alias("relation"), F.when(sb.isNull() | td.isNull(), None).when(hearing > td, 0).otherwise(overlap).alias("overlap"))


def chain_links(chains: DataFrame) -> DataFrame:
    """(chain_id, pos, name, teacher, relation, overlap) of neighbours in (chain_id, pos, name, birth, death)."""
    w = Window.partitionBy("chain_id").orderBy("pos")
    x = chains.select("chain_id", "pos", "name", "birth", "death", *[F.lead(c).over(w).alias(f"t_{c}") for c in ("name", "birth", "death")]).filter("t_name is not null")
    return x.withColumn("v", can_meet(F.col("birth"), F.col("death"), F.col("t_birth"), F.col("t_death"))).select("chain_id", "pos", "name", F.col("t_name").alias("teacher"), "v.relation", "v.overlap")


def chain_continuity(links: DataFrame) -> DataFrame:
    """(chain_id, links, breaks, unknowns, continuity)."""
    x = links.groupBy("chain_id").agg(F.count("*").alias("links"), F.sum((F.col("relation") == "impossible").cast("int")).alias("breaks"), F.sum((F.col("relation") == "unknown").cast("int")).alias("unknowns"))
    return x.withColumn("continuity", F.round((F.col("links") - F.col("breaks") - F.col("unknowns") * 0.5) / F.col("links"), 4))


def ruling(text: Column, terms: list[str]) -> Column:
    """struct(ruling, marker, strength): the longest ruling word of a text, and how plainly it speaks on the topic."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), arabic.SPACES, " ")
    options = [(k, m) for k, ms in RULINGS.items() for m in ms]
    # The longest marker wins; of equal ones the first listed.
    found = F.filter(F.array(*[F.struct(F.lit(-len(m)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(m).alias("m")) for i, (k, m) in enumerate(options)]), lambda s: F.contains(body, s["m"]))
    top = F.get(F.array_sort(found), F.lit(0))
    on_topic = _any(body, terms) if terms else F.lit(True)
    strength = (
        F.when(top.isNull(), "irrelevant").when(~on_topic, "weak").when(top["m"].isin(EXPLICIT), "explicit")
        .when(F.contains(body, F.lit(":")) | F.contains(body, F.lit("قال")), "apparent").otherwise("implied")
    )
    return F.struct(F.coalesce(top["k"], F.lit("undetermined")).alias("ruling"), top["m"].alias("marker"), strength.alias("strength"))


def topic_words(text: Column) -> Column:
    """The distinct words of three letters or more that say something."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), arabic.SPACES, " "), " "), lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOPS)))


def conflicts(items: DataFrame, group: str = "query_id", least_shared: int = 3) -> DataFrame:
    """(group, left_id, right_id, type, left_marker, right_marker, topic, reconciliations) of two texts of one group on one
    topic that say opposite things. ``items`` has (group, id, text); a group is what was admitted for one question, a
    bounded list, so pairs are made within groups only, and only between texts that hold an opposed word.

    Texts share a topic if ``least_shared`` topic words are common; it is named by the first three. The first opposition
    of the list counts, and the text with its first word is the left one. Reconciliations (kind, confidence) are all that
    the texts give reason for: a specifier in one only, other quantities, other imams, the kind of purity; else unresolved.
    """
    flat = items.select(group, "id", F.regexp_replace("text", arabic.SPACES, " ").alias("text")).filter(_any(F.col("text"), sorted({x for a, b, _ in OPPOSITES for x in (a, b)})))
    flat = flat.withColumn("words", topic_words(F.col("text")))
    a, b = (flat.select(F.col(group).alias(f"g{x}"), F.col("id").alias(f"i{x}"), F.col("text").alias(f"t{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    x = a.join(b, F.col("ga").eqNullSafe(F.col("gb")) & (F.col("ia") < F.col("ib"))).withColumn("shared", F.array_sort(F.array_intersect("wa", "wb"))).filter(F.size("shared") >= least_shared)
    has = lambda c, m: F.contains(F.col(c), F.lit(m))
    told = F.lit(None).cast("struct<type:string,left_marker:string,right_marker:string,swap:boolean>")
    for left, right, kind in reversed(OPPOSITES):
        one = has("ta", left) & ~has("ta", right) & has("tb", right)
        two = has("tb", left) & ~has("tb", right) & has("ta", right)
        s = lambda swap, kind=kind, left=left, right=right: F.struct(F.lit(kind).alias("type"), F.lit(left).alias("left_marker"), F.lit(right).alias("right_marker"), F.lit(swap).alias("swap"))
        told = F.when(one, s(False)).when(two, s(True)).otherwise(told)
    x = x.withColumn("c", told).filter("c is not null")
    found = lambda c, pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0))))
    sa, sb, qa, qb, ia, ib = _any(F.col("ta"), SPECIFIERS), _any(F.col("tb"), SPECIFIERS), found("ta", QUANTITY), found("tb", QUANTITY), found("ta", IMAMS), found("tb", IMAMS)
    hint = lambda cond, kind: F.when(cond, F.struct(F.lit(kind[0]).alias("kind"), F.lit(kind[1]).alias("confidence")))
    other = (F.size(ia) > 0) & (F.size(ib) > 0) & (ia != ib)
    hints = F.array_compact(F.array(hint(sa != sb, HINTS["specific"]), hint(qa != qb, HINTS["quantity"]), hint(other, HINTS["case"]), hint(other, HINTS["dissimulation"])))
    last = F.when(F.col("c.type") == "purity", F.array(hint(F.lit(True), HINTS["purity"]))).otherwise(F.array(hint(F.lit(True), HINTS["none"])))
    return x.withColumn("hints", hints).select(
        F.col("ga").alias(group), F.when(F.col("c.swap"), F.col("ib")).otherwise(F.col("ia")).alias("left_id"), F.when(F.col("c.swap"), F.col("ia")).otherwise(F.col("ib")).alias("right_id"),
        "c.type", "c.left_marker", "c.right_marker", F.array_join(F.slice("shared", 1, 3), " ").alias("topic"), F.when(F.size("hints") > 0, F.col("hints")).otherwise(last).alias("reconciliations"),
    )


def conflict_report(found: DataFrame) -> DataFrame:
    """(type, conflicts, with_suggestion): how many of each type, and for how many something but unresolved is offered."""
    return found.groupBy("type").agg(F.count("*").alias("conflicts"), F.sum(F.exists("reconciliations", lambda r: r["kind"] != "unresolved").cast("int")).alias("with_suggestion"))
