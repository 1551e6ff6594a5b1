"""Structure of page elements: layout classes, report numbers, chain and body of reports, narrators, OCR corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import arabic

# ------------------------------------------------------------------ fixed values: markers and patterns
D = "0-9\\u0660-\\u0669"
SANAD_OPENERS = ["وبإسناده", "بإسناده", "وباسناده", "باسناده", "حدثنا", "حدّثنا", "أخبرنا", "اخبرنا", "أنبأنا", "وعنه", "وعن", "عنه", "محمد بن يعقوب", "محمّد بن يعقوب"]
TAKHRIJ_OPENERS = ["ورواه", "رواه", "وأورده", "اورده", "وتقدم", "تقدم", "ويأتي", "يأتي", "وأخرجه", "اخرجه"]
TAKHRIJ_TAILS = ["مثله", "نحوه", "بمعناه", "باختلاف"]
MATN_MARKERS = ["قال رسول", "قال النبي", "قال أبو", "قال ابو", "سألته", "سالته", "سألت", "سالت", "عليه السلام ( :", "وآله ( :", "واله ( :"]
FOOTNOTE_PHRASES = ["في المصدر", "في نسخة", "في نسخه", "من الباب", "من أبواب", "من ابواب", "الكافي", "التهذيب", "الفقيه", "الاستبصار"]
MATN_OPENERS = ["قال :", "قال:", "فقال :", "قال ؟", "أنه قال", "انه قال"]
REPORT_OPENERS = ["محمد بن يعقوب", "محمّد بن يعقوب", "محم د بن يعقوب", "وبإسناده", "بإسناده", "وباسناده", "باسناده", "حدثنا", "حدّثنا", "أخبرنا", "اخبرنا", "وعنه", "وعن", "عنه"]
IMAM_MARKERS = [
    "أبا جعفر", "ابا جعفر", "أبي جعفر", "ابي جعفر", "أبا عبد الله", "ابا عبد الله", "أبي عبد الله", "ابي عبد الله", "أبا الحسن", "ابا الحسن",
    "أبي الحسن", "ابي الحسن", "الرضا", "الصادق", "الباقر", "الكاظم", "أمير المؤمنين", "امير المومنين", "رسول الله", "النبي",
]
NASAB = "(?:^|\\s)(?:بن|ابن)\\s"
TRANSMISSION = "(?:^|\\s)عن\\s"
NUMBER = f"^\\s*[\\[\\]]\\s*[{D}\\s]+[\\]\\[]\\s*(?:[{D}]+\\s*[ـ\\-–]?\\s*)?"
HONORIFIC = "[()]\\s*(?:علي[هى]\\s*ال?سلام|عليهم\\s*ال?سلام|عليهما\\s*ال?سلام|صل[يى]\\s*الل?ه\\s*علي[هى]\\s*و?[اآ]ل[هى]|سلام\\s*الله\\s*علي)\\s*[)(]"
LIGATURES = {"االله": "الله", "االلة": "الله", "اللة": "الله", "هللا": "الله", "اهللا": "الله", "رمحن": "رحمن"}
CHAIN_LEADS = ["عن ", "وعن ", "عنه ", "قال : سألت ", "قال : سالت ", "سألت ", "سالت "]
NO_NAMES = ["قال", "حدثنا", "أخبرنا", "وبإسناده", "بإسناده", "عنه"]
NAME_EDGE = "^[ .،:؛()\\[\\]]+|[ .،:؛()\\[\\]]+$"
NAME_BREAK = " *، *| +عن +"
NAME_FORMULA = " *[()]? *(?:علي[هى]|عليهم|عليهما|صل[يى]) .*$"
# ------------------------------------------------------------------


def _starts(c: Column, options: list[str]) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | c.startswith(o)
    return out


def _hits(c: Column, options: list[str]) -> Column:
    return sum((F.contains(c, F.lit(o)).cast("int") for o in options), F.lit(0))


def classified(df: DataFrame, id: str, text: str, order: str, on_page: str) -> DataFrame:
    """(id, kind, confidence): layout class of each element. The folded text is made once, in a projection of its own."""
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^{arabic.SPACES}|{arabic.SPACES}$", "")
    rows = df.select(id, order, on_page, F.explode(F.array(raw)).alias("__raw"))
    rows = rows.select(id, order, on_page, "__raw", F.explode(F.array(arabic.layout_form(F.col("__raw")))).alias("__norm"))
    found = F.explode(F.array(layout(F.col("__raw"), F.col("__norm"), F.col(order), F.col(on_page))))
    return rows.select(id, found.alias("__l")).select(id, "__l.kind", "__l.confidence")


def layout(raw: Column, norm: Column, order: Column, on_page: Column) -> Column:
    """Layout class and confidence of a trimmed text and its layout form: struct(kind, confidence). Rules in order, the
    first that fires."""
    words = F.split(norm, " ")
    n = F.size(words)
    nasab, trans = F.regexp_count(norm, F.lit(NASAB)), F.regexp_count(norm, F.lit(TRANSMISSION))
    after = F.btrim(F.regexp_replace(norm, "^\\s*[\\]\\[][^\\]\\[]*[\\]\\[]", ""))
    chain = (after != "") & (_starts(after, SANAD_OPENERS) | ((F.regexp_count(after, F.lit(NASAB)) >= 1) & (F.regexp_count(after, F.lit(TRANSMISSION)) >= 1)))
    phrases = _hits(norm, FOOTNOTE_PHRASES)
    low = (on_page > 0) & (order >= on_page * 0.75)
    foot = 0.62 + 0.08 * F.least(phrases, F.lit(3)) + F.when(low, 0.10).otherwise(0.0)
    opens = _starts(norm, TAKHRIJ_OPENERS)
    tail = F.regexp_replace(F.regexp_replace(norm, f"[)(]\\s*[{D}]+\\s*[)(]\\s*[.،]?\\s*$", ""), "[ .،]+$", "")
    ends = tail.rlike("(?:" + "|".join(TAKHRIJ_TAILS) + ")$")
    head = F.slice(words, 1, 4)
    sanad = F.least(
        F.lit(0.95),
        F.when(_starts(norm, SANAD_OPENERS), 0.45).when(F.array_contains(head, "بن") | F.array_contains(head, "ابن"), 0.28).otherwise(0.0)
        + F.when(nasab >= 2, 0.30).when(nasab == 1, 0.12).otherwise(0.0)
        + F.when(trans >= 3, 0.45).when(trans == 2, 0.32).when(trans == 1, 0.10).otherwise(0.0)
        + F.when(norm.rlike("عن\\s+\\S+\\s+(?:بن|ابن)\\s"), 0.18).otherwise(0.0)
        + F.when(F.regexp_replace(norm, "[ :.،]+$", "").endswith("قال"), 0.10).otherwise(0.0),
    )
    markers = _hits(norm, MATN_MARKERS)
    body = (
        F.when(markers > 0, 0.45 + 0.08 * F.least(markers, F.lit(3))).otherwise(0.0)
        + F.when((n >= 6) & (nasab == 0), 0.20).otherwise(0.0)
        + F.when(norm.rlike("[؟:،]"), 0.05).otherwise(0.0)
    )
    digits = F.regexp_count(norm, F.lit("[0-9\\u0660-\\u0669\\u06F0-\\u06F9]")) / F.greatest(F.length(norm), F.lit(1))
    prose = (body < 0.55) & (n >= 5) & (nasab == 0) & (digits < 0.15) & ~opens & ~_starts(norm, SANAD_OPENERS)
    matn = F.least(F.lit(0.95), F.when(prose, F.greatest(body, F.lit(0.58))).otherwise(body))

    def verdict(kind: str, confidence) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.round(confidence if isinstance(confidence, Column) else F.lit(confidence), 4).alias("confidence"))

    return (
        F.when(raw == "", verdict("unknown", 0.0))
        .when(raw.rlike(f"^[{D}]+$"), verdict("page_number", 0.95))
        .when(raw.rlike(f"^[{D}]+\\s+(?:كتاب|أبواب|ابواب)\\s"), verdict("running_head", 0.90))
        .when(raw.rlike(f"^[{D}]+\\s*[ـ\\-–]\\s*(?:باب|أبواب|ابواب)"), verdict("heading", 0.92))
        .when(raw.rlike(f"^\\]\\s*[{D}\\s]+\\[|^\\[\\s*[{D}\\s]+\\]"), F.when(chain, verdict("sanad", 0.85)).otherwise(verdict("hadith_number", 0.80)))
        .when(raw.rlike(f"^[)(]\\s*[{D}]+\\s*[)(]"), verdict("footnote", 0.93))
        .when(raw.rlike(f"^[{D}]+\\s*[ـ\\-–]\\s*\\S[^:/]{{0,28}}[:/]\\s*[{D}\\s/:.،]+$"), verdict("footnote", 0.85))
        .when(norm.rlike("^(?:كتاب|أبواب|ابواب)\\s+\\S") & (n <= 6), verdict("heading", 0.80))
        .when(phrases > 0, verdict("footnote", F.least(foot, F.lit(0.95))))
        .when(opens | ends, verdict("takhrij", F.when(opens & ends, 0.70).otherwise(0.60)))
        .when((sanad >= matn) & (sanad >= 0.55), verdict("sanad", sanad))
        .when(matn >= 0.55, verdict("matn", matn))
        .otherwise(verdict("unknown", F.greatest(sanad, matn)))
    )


def report_number(raw: Column) -> Column:
    """struct(hadith, sequence, confidence): of several numbers the greatest is the report's, the next its place."""
    runs = F.transform(F.regexp_extract_all(arabic.western_digits(raw), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))
    s = F.sort_array(runs, asc=False)
    first, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    return F.struct(
        first.alias("hadith"), second.alias("sequence"),
        F.when(first.isNull(), 0.0).when(second.isNull(), 0.85).when(first > second * 3, 0.9).otherwise(0.6).alias("confidence"),
    )


def _once(c: Column, use) -> Column:
    """``use`` of ``c``, which is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def split_report(text: Column) -> Column:
    """struct(number, isnad, matn, confidence, isnad_start, isnad_end, matn_start, matn_end): a report's number, chain and
    body, and where the last two stand in the text, counted from 0; a part that is not there has the span (0, 0).

    The chain ends after the last formula of respect that begins in the first three quarters (or forty characters) of
    what follows the number, or else with the first word that opens a body behind a chain; a text without number or
    chain is not divided; a body of less than three words is none.
    """
    numbered = lambda raw: _once(F.regexp_extract(raw, f"({NUMBER})", 1), lambda number: _once(F.substring(raw, F.length(number) + 1, F.length(raw)), lambda body: _parts(raw, number, body)))
    return _once(F.coalesce(text, F.lit("")), numbered)


def _parts(raw: Column, number: Column, body: Column) -> Column:
    limit = F.greatest(F.floor(F.length(body) * 0.75), F.lit(40)).cast("int")
    chain_like = _starts(F.ltrim(body), REPORT_OPENERS) | ((F.regexp_count(body, F.lit(TRANSMISSION)) >= 2) & (F.regexp_count(body, F.lit(NASAB)) >= 1))
    # Formulas and the texts between them, in turn: their lengths add up to where each formula begins.
    between = F.transform(F.split(body, HONORIFIC, -1), F.length)
    formulas = F.transform(F.regexp_extract_all(body, F.lit(HONORIFIC), F.lit(0)), F.length)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"))

    def walk(acc, both):
        begins = acc["at"] + both["b"]
        ends = begins + F.coalesce(both["f"], F.lit(0))
        return F.struct(ends.alias("at"), F.when(both["f"].isNotNull() & (begins < limit), ends).otherwise(acc["end"]).alias("end"))

    honoured = F.aggregate(F.zip_with(between, formulas, lambda x, y: F.struct(x.alias("b"), y.alias("f"))), start, walk)["end"]
    at = [F.instr(body, o) for o in MATN_OPENERS]
    ok = [
        (i > 1) & (F.regexp_count(body.substr(F.lit(1), i - 1), F.lit(TRANSMISSION)) >= 1) & body.substr(F.lit(1), i - 1).rlike(NASAB)
        for i in at
    ]
    opener = F.coalesce(*[F.when(c, i - 1 + len(o)) for c, i, o in zip(ok, at, MATN_OPENERS)])
    cut = lambda honour: F.when(honour > 0, honour).otherwise(opener)
    divided = _once(honoured, lambda honour: _once(cut(honour), lambda c: _divided(raw, number, body, chain_like, honour > 0, c)))
    return (
        F.when((_trim(raw) == "") | (_trim(body) == ""), _part(raw, number, F.lit(""), F.lit(""), 0.0))
        .when((number == "") & ~chain_like, _part(raw, number, F.lit(""), _trim(body), 0.3, m=(F.length(number), F.length(raw))))
        .otherwise(divided)
    )


def _part(raw: Column, number: Column, isnad: Column, matn: Column, c, i=None, m=None) -> Column:
    zero = (F.lit(0), F.lit(0))
    spans = [x.alias(n) for x, n in zip((*(i or zero), *(m or zero)), ("isnad_start", "isnad_end", "matn_start", "matn_end"))]
    return F.struct(_trim(number).alias("number"), isnad.alias("isnad"), matn.alias("matn"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), *spans)


def _divided(raw: Column, number: Column, body: Column, chain_like: Column, by_honour: Column, cut: Column) -> Column:
    """The parts of a text with a number or a chain, whose chain ends at ``cut``."""
    head = body.substr(F.lit(1), cut)
    front, back = _trim(head), _trim(body.substr(cut + 1, F.length(body)))
    confidence = F.when(by_honour, F.when(head.rlike(TRANSMISSION) | head.rlike(NASAB), 0.85).otherwise(0.6)).otherwise(0.7)
    few = F.size(F.split(back, arabic.SPACES)) < 3
    begin, whole = F.length(number), F.length(raw)
    none, rest = F.lit(""), (begin, whole)
    parts = lambda *a, **k: _part(raw, number, *a, **k)
    return (
        F.when(cut.isNull(), F.when(chain_like, parts(_trim(body), none, 0.55, i=rest)).otherwise(parts(none, _trim(body), 0.5, m=rest)))
        .when(back == "", parts(front, none, 0.55, i=rest))
        .when(few, parts(front, none, 0.5, i=rest))
        .otherwise(parts(front, back, confidence, (begin, begin + cut), (begin + cut, whole)))
    )


def reassembled(text: Column, parts: Column) -> Column:
    """The text put together from the spans of its parts, character by character the same."""
    raw = F.coalesce(text, F.lit(""))
    piece = lambda a, b: F.substring(raw, a + 1, b - a)
    first = F.when(parts["isnad_end"] > 0, parts["isnad_start"]).when(parts["matn_end"] > 0, parts["matn_start"]).otherwise(F.length(raw))
    return F.concat(piece(F.lit(0), first), piece(parts["isnad_start"], parts["isnad_end"]), piece(parts["matn_start"], parts["matn_end"]))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{arabic.SPACES}|{arabic.SPACES}$", "")


def identify_imam(isnad: Column) -> Column:
    """The first of the known names, in the list's order, that a chain holds; empty where none."""
    out = F.lit("")
    for m in reversed(IMAM_MARKERS):
        out = F.when(F.contains(isnad, F.lit(m)), m).otherwise(out)
    return out


def chain_names(isnad: Column) -> Column:
    """The names of a chain in order, without verbs, formulas and the one it ends with."""
    flat = F.regexp_replace(F.coalesce(isnad, F.lit("")), arabic.SPACES, " ")
    lead = "^(?:" + "|".join(CHAIN_LEADS) + ")"
    named = F.transform(F.split(flat, NAME_BREAK), lambda p: F.regexp_replace(F.regexp_replace(p, NAME_EDGE, ""), lead, ""))
    kept = F.filter(named, lambda p: (p != "") & (F.size(F.split(p, " ")) <= 6) & ~p.isin(NO_NAMES))
    bare = F.transform(kept, lambda p: F.regexp_replace(F.regexp_replace(p, NAME_FORMULA, ""), NAME_EDGE, ""))
    return F.filter(bare, lambda p: (F.length(p) >= 3) & ~_starts(p, IMAM_MARKERS))


def remove_stretch(text: Column) -> Column:
    """struct(text, removed): the text without tatweel and how many runs of it there were."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.replace(t, F.lit("ـ"), F.lit("")).alias("text"), F.regexp_count(t, F.lit("\\u0640+")).alias("removed"))


def fix_ligatures(text: Column) -> Column:
    """struct(text, fixed): known wrong ligatures put right where they are whole words."""
    words = F.split(F.coalesce(text, F.lit("")), " ")
    table = F.create_map(*[F.lit(x) for kv in LIGATURES.items() for x in kv])
    return F.struct(
        F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ").alias("text"),
        F.size(F.filter(words, lambda w: w.isin(list(LIGATURES)))).alias("fixed"),
    )


#: Words that are never joined to a neighbour.
PROTECTED = (
    "عن في من الى على او ثم قد لا ما بن ابن ابي ابو اب ام اذا ان انه به له هو هي هم كل بل لم لن يا قال عند بعد قبل غير بين حتي لو اي كم مع عليه الله"
).split()


def split_word_merges(words: DataFrame, lexicon: DataFrame, least: int = 3, longest: int = 3) -> DataFrame:
    """(left, right, joined, times): neighbours (element_id, tokens) that are one word torn apart.

    A piece of up to ``longest`` letters joins its neighbour if neither is a protected word, the joined word is known
    (``lexicon`` word, frequency at least ``least``) and the shorter piece is not. Pairs are counted before they meet
    the lexicon, so the join is over distinct pairs and never over the text."""
    t = F.col("tokens")
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct(F.element_at(t, i).alias("left"), F.element_at(t, i + 1).alias("right")))
    counted = words.filter(F.size("tokens") > 1).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("times"))
    pure = "^[\\u0621-\\u064A]+$"
    counted = counted.filter(F.col("left").rlike(pure) & F.col("right").rlike(pure) & ~F.col("left").isin(PROTECTED) & ~F.col("right").isin(PROTECTED))
    counted = counted.filter((F.least(F.length("left"), F.length("right")) <= longest) & (F.length("left") + F.length("right") >= 4))
    short = F.when(F.length("left") <= F.length("right"), F.col("left")).otherwise(F.col("right"))
    known = lexicon.filter(F.col("frequency") >= least)
    made = counted.withColumn("joined", F.concat("left", "right")).withColumn("short", short)
    made = made.join(known.select(F.col("word").alias("w1")), F.col("joined") == F.col("w1"), "left_semi")
    return made.join(known.select(F.col("word").alias("w2")), F.col("short") == F.col("w2"), "left_anti").select("left", "right", "joined", "times")
