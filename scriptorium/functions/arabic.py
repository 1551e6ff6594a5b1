"""Text forms as Column expressions: search, retrieval, match and layout forms, stems, strengths, digits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------ fixed values: characters and word lists
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\u2066-\\u2069\\uFEFF\\u00AD\\u0640]"
MARKS = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u08D3-\\u08FF\\u061A]"
SPACES = "[\\s\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
FOLD_FROM = "آأإٱٲٳٵىیةؤئکگپچژھۀە٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
FOLD_TO = "اااااااييهويككبجزههه01234567890123456789"
HARAKAT = "[\\u064B-\\u0652\\u0670\\u0653-\\u0655]"
CANON_FROM, CANON_TO = "ىةئیک", "يهؤيك"
HAMZA_FROM, HAMZA_TO = "آأإٱ", "اااا"
WORD_FIXES = {"االله": "الله", "االلة": "الله", "اللة": "الله", "هللا": "الله"}
PREFIXES = ["وال", "بال", "كال", "فال", "ال", "لل", "و", "ف", "ب", "ك", "ل", "س"]
SUFFIXES = ["هما", "كما", "هم", "هن", "كم", "كن", "نا", "ها", "ية", "ات", "ون", "ين", "ان", "ته", "تي", "ه", "ك", "ي", "ا", "ت", "ن"]
STRENGTHS = {"exact": 1.0, "canonical": 0.92, "unvocalised": 0.70, "stem": 0.45, "none": 0.0}
# ------------------------------------------------------------------


def presentation_forms() -> tuple[str, str]:
    """Single-letter compatibility forms (Arabic shapes, full width, super- and subscripts, ...) and their letters, by
    rule."""
    pairs = {}
    for lo, hi in ((0xAA, 0x33FF), (0xFB00, 0xFFEE)):
        for cp in range(lo, hi + 1):
            flat = unicodedata.normalize("NFKC", chr(cp))
            if len(flat) == 1 and flat != chr(cp):
                pairs[chr(cp)] = flat
    return "".join(pairs), "".join(pairs.values())


SHAPES_FROM, SHAPES_TO = presentation_forms()
#: Ligatures of two letters or three, Latin and lam-alef, by the same rule.
LIGATURE_FORMS = {chr(cp): unicodedata.normalize("NFKC", chr(cp)) for cp in (*range(0xFB00, 0xFB07), *range(0xFEF5, 0xFEFD))}


def shaped(c: Column) -> Column:
    """A text with its compatibility forms resolved."""
    out = F.translate(c, SHAPES_FROM, SHAPES_TO)
    apart = out
    for form, letters in LIGATURE_FORMS.items():
        apart = F.replace(apart, F.lit(form), F.lit(letters))
    return F.when(out.rlike("[\\uFB00-\\uFB06\\uFEF5-\\uFEFC]"), apart).otherwise(out)


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none outside."""
    return F.btrim(F.regexp_replace(c, SPACES, " "))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def search_form(c: Column) -> Column:
    """The form that is indexed and searched: no marks or tatweel, letters and digits folded, known misreadings fixed.
    A null text has the empty form."""
    bare = F.regexp_replace(F.regexp_replace(_text(c), INVISIBLE, ""), MARKS, "")
    out = collapse(F.translate(shaped(bare), FOLD_FROM + "ء", FOLD_TO))
    fixed = F.array_join(F.transform(F.split(out, " "), _fix_word), " ")
    return F.when(out.rlike("|".join(WORD_FIXES)), fixed).otherwise(out)


def _fix_word(w: Column) -> Column:
    fixed = w
    for bad, good in WORD_FIXES.items():
        fixed = F.when(w == bad, good).otherwise(fixed)
    return fixed


def surface_form(c: Column) -> Column:
    """Cleaned only: marks and letters stay."""
    return collapse(shaped(F.regexp_replace(_text(c), INVISIBLE, "")))


def tokens(c: Column) -> Column:
    """Words of the search form."""
    return F.filter(F.split(search_form(c), " "), lambda w: w != "")


def strip_tatweel(c: Column) -> Column:
    return F.replace(_text(c), F.lit("ـ"), F.lit(""))


def has_diacritics(c: Column) -> Column:
    return _text(c).rlike(HARAKAT)


def diacritic_ratio(c: Column) -> Column:
    """Marks to letters, at most 1, four decimals."""
    letters, marks = F.regexp_count(_text(c), F.lit("[\\u0621-\\u064A]")), F.regexp_count(_text(c), F.lit(HARAKAT))
    return F.when(letters > 0, F.round(F.least(F.lit(1.0), marks / letters), 4)).otherwise(0.0)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(_text(c), HARAKAT, "")


def canonical_form(c: Column) -> Column:
    """Spelling unified, marks kept; hamza as a combining mark is composed with its letter."""
    text = strip_tatweel(c)
    for mark, pairs in (("ٔ", ("اأ", "وؤ", "يئ")), ("ٕ", ("اإ",)), ("ٓ", ("اآ",))):
        for letter, made in pairs:
            text = F.replace(text, F.lit(letter + mark), F.lit(made))
    return collapse(F.translate(text, CANON_FROM, CANON_TO))


def retrieval_form(c: Column) -> Column:
    """The canonical form without marks, alef unified."""
    return collapse(F.translate(F.regexp_replace(canonical_form(c), HARAKAT, ""), HAMZA_FROM, HAMZA_TO))


def match_key(c: Column) -> Column:
    """The form in which names and labels are matched: no marks, alef, yeh and teh marbuta folded."""
    bare = F.regexp_replace(_text(c), "[\\u064B-\\u065F\\u0670\\u0640]", "")
    return collapse(F.translate(bare, "آأإٱىة", "اااايه"))


def layout_form(c: Column) -> Column:
    """Like the match key, with teh marbuta kept."""
    bare = F.regexp_replace(_text(c), "[\\u064B-\\u065F\\u0670\\u0640]", "")
    return collapse(F.translate(bare, "آأإٱى", "اااا" + "ي"))


def lexicon_key(c: Column) -> Column:
    """Like the match key, with hamza seats folded too."""
    return F.translate(match_key(c), "ؤئ", "وي")


def light_stem(c: Column) -> Column:
    """The retrieval form without one prefix and one suffix, the longest that leave four letters."""
    w = retrieval_form(c)
    front = "|".join(sorted(PREFIXES, key=len, reverse=True))
    back = "|".join(sorted(SUFFIXES, key=len, reverse=True))
    # The shortest stem of four letters or more leaves the longest suffix.
    stem = F.regexp_replace(F.regexp_replace(w, f"^(?:{front})(?=.{{4}})", ""), f"^(.{{4,}}?)(?:{back})$", "$1")
    return F.when(F.length(w) <= 3, w).otherwise(stem)


def word_forms(c: Column) -> Column:
    """raw, canonical, retrieval, stem, is_diacritised, diacritic_ratio as one struct."""
    return F.struct(
        _text(c).alias("raw"), canonical_form(c).alias("canonical"), retrieval_form(c).alias("retrieval"), light_stem(c).alias("stem"),
        has_diacritics(c).alias("is_diacritised"), diacritic_ratio(c).alias("diacritic_ratio"),
    )


def match_strength(q: Column, t: Column) -> Column:
    """How strongly two words match: exact, canonical, unvocalised, stem or none."""
    q, t = F.btrim(_text(q)), F.btrim(_text(t))
    return (
        F.when((q == "") | (t == ""), "none")
        .when(q == t, "exact")
        .when(canonical_form(q) == canonical_form(t), "canonical")
        .when(retrieval_form(q) == retrieval_form(t), "unvocalised")
        .when((light_stem(q) == light_stem(t)) & (F.length(light_stem(q)) >= 3), "stem")
        .otherwise("none")
    )


def strength_weight(s: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv]), s)


def western_digits(c: Column) -> Column:
    return F.translate(_text(c), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def slugify(c: Column) -> Column:
    """Lower case, anything but letters, digits and _ a hyphen; 'untitled' where nothing is left."""
    low = F.lower(shaped(_text(c)))
    slug = F.regexp_replace(F.regexp_replace(low, "[^\\p{L}\\p{N}_]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "untitled").otherwise(slug)


def clip_text(c: Column, limit: int = 320) -> Column:
    """White space collapsed; longer texts cut to ``limit`` characters and an ellipsis."""
    flat = collapse(_text(c))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…")))


def split_names(c: Column) -> Column:
    """Names of a list written with commas, semicolons, slashes or bars."""
    return F.filter(F.transform(F.split(_text(c), "[،,؛;/|]"), lambda x: F.btrim(x)), lambda x: x != "")


def infer_language(c: Column) -> Column:
    """ar or en by the letters that prevail, und where there are none; ar for no text at all."""
    ar, en = F.regexp_count(_text(c), F.lit("[\\u0600-\\u06FF]")), F.regexp_count(_text(c), F.lit("[A-Za-z]"))
    return F.when(F.btrim(_text(c)) == "", "ar").when((ar == 0) & (en == 0), "und").when(ar >= en, "ar").otherwise("en")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a lower-cased text, each word padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(_text(c)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where lengths differ or one has no length."""
    def norm(x):
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = norm(F.transform(a, lambda x: x.cast("double"))) * norm(F.transform(b, lambda x: x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)
