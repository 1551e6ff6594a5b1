"""Visually identical text with different characters: one consistent form.

Two stages. Characters that are drawn alike whatever the word (compatibility forms of width and Arabic shaping,
composed and decomposed marks, invisible characters, blanks, hyphens, Arabic letters that share a glyph at their place
in the word, digits that share a glyph in both Arabic series) are brought to one character. Letters of another script
(Cyrillic or Greek in a Latin word and the reverse) are then repaired per token: in tokens of several scripts the
look-alikes go to the dominant one, that of the token's unambiguous letters, and the substitution counts only if the
corpus vocabulary, the words of all forms, has the repaired word. Line ends, case, vowel marks, hamza, dots, tatweel and
letters or digits of another shape are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import cut, key_filter, stored

# Unicode code points drawn alike, stated as text.
CYRILLIC_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсух", "ABESIJKMHOPCTYXaesijopcyx"))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))
SAME_DIGITS = dict(zip("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"))
HYPHENS = "‐‑﹣"
_JOINER = "‌"

_COMPAT_RANGES = ((0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE))


def _character_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for lo, hi in _COMPAT_RANGES:
        for cp in range(lo, hi + 1):
            flat = unicodedata.normalize("NFKC", chr(cp))
            if flat != chr(cp):
                table[cp] = flat.replace("-", "-")
    for cp in (*range(0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080)):
        kind = unicodedata.category(chr(cp))
        if kind == "Zs" or cp == 9:
            table[cp] = " "
        elif kind == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x200C, 0x6DD, 0x8E2):
            table[cp] = None
    for cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10)):
        table[cp] = None
    for c in HYPHENS:
        table[ord(c)] = "-"
    for a, b in SAME_DIGITS.items():
        table[ord(a)] = b
    return table


_TABLE = _character_table()
_ODD = re.compile("[^\x0a\x20-\x7e]")
_SHY_END = re.compile("­(?=[ \t]*(?:\n|$))")
_MARKS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ"
_LETTER = "ؠ-يٮٯٱ-ۓەۺ-ۼۿ"
# Letters that do not join to the next letter.
_NO_JOIN = "ء-إاةد-زوىٱ-ٳٵ-ٷڈ-ڙۀۃ-ۋۍۏےۓە"
_ZWNJ = re.compile(_JOINER)
_BEFORE = re.compile(f"[{_LETTER}][{_MARKS}]*$")
_YEH_IN = re.compile(f"ی(?=[{_MARKS}]*[{_LETTER}ـ])")
_KEHEH_IN = re.compile(f"ک(?=[{_MARKS}]*[{_LETTER}ـ])")
_AE_END = re.compile(f"ە(?![{_MARKS}]*[{_LETTER}ـ])")
_USELESS_ZWNJ = re.compile(f"(?<![{_LETTER}{_MARKS}ـ])‌+|‌+(?![{_LETTER}])|(?<=[{_NO_JOIN}])‌+")
_DOUBLE_ZWNJ = re.compile("‌{2,}")


def drawn_form(text: str) -> str:
    """``text`` with every character that is drawn alike at its place brought to one."""
    if not _ODD.search(text):
        return text
    if "­" in text:
        text = _SHY_END.sub("-", text)
    text = unicodedata.normalize("NFC", text.translate(_TABLE))
    if "‌" in text:
        text = _DOUBLE_ZWNJ.sub("‌", _USELESS_ZWNJ.sub("", text))
    if "ی" in text:
        text = _YEH_IN.sub("ي", text).replace("ی", "ى")
    if "ک" in text:
        text = _KEHEH_IN.sub("ك", text)
    if "ە" in text:
        text = _AE_END.sub("ه", text)
    return text


_TO_LATIN = str.maketrans(CYRILLIC_LOOKS | GREEK_LOOKS)
_TO_CYRILLIC = str.maketrans({v: k for k, v in CYRILLIC_LOOKS.items()})
_TO_GREEK = str.maketrans({v: k for k, v in GREEK_LOOKS.items()})
_SETS = {"LATIN": frozenset(CYRILLIC_LOOKS.values()) | frozenset(GREEK_LOOKS.values()), "CYRILLIC": frozenset(CYRILLIC_LOOKS), "GREEK": frozenset(GREEK_LOOKS)}
_FOREIGN = re.compile("[Ͱ-ϿЀ-ӿ]")
_EDGES = re.compile(r"^\W+|\W+$")


def _script(c: str) -> str:
    cp = ord(c)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "LATIN"
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "GREEK"
    if 0x400 <= cp < 0x530:
        return "CYRILLIC"
    return "OTHER"


def letter_scripts(token: str) -> Counter:
    """How many letters of each script a token has."""
    return Counter(_script(c) for c in unicodedata.normalize("NFD", token) if c.isalpha())


def dominant_script(token: str) -> str | None:
    """The script of most of the token's letters that no other script draws alike; where there are none or two scripts
    have as many, of most of all its letters; null where that does not tell either."""
    own = Counter(_script(c) for c in unicodedata.normalize("NFD", token) if c.isalpha() and c not in _SETS.get(_script(c), ()))
    for votes in (own, letter_scripts(token)):
        best = votes.most_common(2)
        if best and (len(best) == 1 or best[0][1] > best[1][1]):
            return best[0][0]
    return None


def _repair(token: str, script: str) -> str:
    return token.translate({"LATIN": _TO_LATIN, "CYRILLIC": _TO_CYRILLIC, "GREEK": _TO_GREEK}.get(script, {}))


def mixed_tokens(form: str) -> list[tuple[str, str, str]]:
    """(token, repaired token, vocabulary key) of the tokens with letters of several scripts whose look-alikes, brought
    to the token's dominant script, leave one script.

    A token of one script that is written wholly in look-alikes of the text's script (a single letter, mostly) is no
    mixed token, yet reads the same: it is the one other case that is asked for, in the script of most of the text's
    letters.
    """
    if not _FOREIGN.search(form):
        return []
    whole, found = None, {}
    for token in form.split():
        if token in found or not _FOREIGN.search(token):
            continue
        scripts = letter_scripts(token)
        if len(scripts) > 1:
            script = dominant_script(token)
        else:
            whole = whole or letter_scripts(form).most_common(1)[0][0]
            mine = next(iter(scripts), None)
            script = whole if mine in _SETS and mine != whole and all(c in _SETS[mine] for c in token if c.isalpha()) else None
        fixed = _repair(token, script) if script else token
        if fixed != token and len(letter_scripts(fixed)) == 1:
            found[token] = (token, fixed, _EDGES.sub("", fixed).lower())
    return list(found.values())


def _forms(texts: pd.Series) -> pd.DataFrame:
    forms = [drawn_form(t) for t in texts]
    return pd.DataFrame({"form": forms, "mixed": [[{"token": a, "fixed": b, "word": w} for a, b, w in mixed_tokens(f)] for f in forms]})


def _replaced(forms: pd.Series, fixes: pd.Series) -> pd.Series:
    out = []
    for form, fix in zip(forms, fixes):
        m = {f["token"]: f["fixed"] for f in fix}
        out.append(re.sub(r"\S+", lambda x, m=m: m.get(x.group(), x.group()), form))
    return pd.Series(out, dtype=object)


def vocabulary_key(c: Column) -> Column:
    """A token as looked up in the corpus vocabulary: lower case, without characters at its ends that are no letters."""
    return F.lower(F.regexp_replace(c, "^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$", ""))


def one_form(df: DataFrame, id: str, text: str, kept: Column | None = None) -> DataFrame:
    """(id, raw, form): the consistent form of each text; ``raw`` is the text, or what ``kept`` makes of it.

    Null texts do not appear; an empty text's form is empty; texts of any length are treated whole; null ids stay. Rows
    alike in all three come once or more often. Only the two named columns are read. The texts are formed once, in
    Arrow batches, and written to the checkpoint folder; the vocabulary is the words of those forms.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("t")).filter("t is not null")
    forms = F.pandas_udf(_forms, "form string, mixed array<struct<token:string,fixed:string,word:string>>")
    replaced = F.pandas_udf(_replaced, "string")
    raw = F.col("t") if kept is None else kept
    rows = stored(rows.select("id", "t", forms("t").alias("f")).select("id", raw.alias("raw"), "f.form", "f.mixed"))
    odd = rows.filter(F.size("mixed") > 0)
    wanted = cut(odd.select(F.explode("mixed.word").alias("word")).distinct())
    maybe = key_filter(wanted, "word")
    # A repaired word has letters of one script, so a mixed token never counts as its evidence; only texts that hold a
    # script of the look-alike families can hold it.
    words = (
        rows.select("form")
        .filter(F.col("form").rlike("[\\p{IsLatin}\\p{IsGreek}\\p{IsCyrillic}]"))
        .select(F.explode(F.array_distinct(F.split("form", "[\\s\\p{Z}]+"))).alias("t"))
        .select(vocabulary_key(F.col("t")).alias("held"))
        .filter(maybe(F.col("held")))
        .distinct()
    )
    known = wanted.join(words, F.col("word") == F.col("held"), "left_semi").select(F.col("word").alias("k"))
    fixes = (
        odd.select("id", "raw", "form", F.explode("mixed").alias("m"))
        .join(known, F.col("m.word") == F.col("k"), "left")
        .groupBy("id", "raw", "form")
        .agg(F.collect_set(F.when(F.col("k").isNotNull(), F.col("m"))).alias("fixes"))  # no more than the text's words
        .select("id", "raw", replaced("form", "fixes").alias("form"))
    )
    return rows.filter(F.size("mixed") == 0).select("id", "raw", "form").unionByName(fixes)


def consistent_forms(df: DataFrame, id: str = "element_id", texts: tuple[str, ...] = ("text_raw", "text_normalized")) -> DataFrame:
    """(id, text, form): the consistent form of each named text column of every row, ``text`` naming the column.

    A null text has no row; a row delivered twice with the same text comes once; the vocabulary is of all columns."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("text"), F.col(c).alias("value")) for c in texts]))
    long = df.select(F.col(id).alias("i"), parts.alias("p")).select(F.struct("i", "p.text").alias("key"), F.col("p.value").alias("value"))
    forms = one_form(long, "key", "value", F.md5("t")).select(F.col("id.i").alias(id), F.col("id.text").alias("text"), "form")
    return forms.distinct()


def lookalike_pairs(df: DataFrame, id: str = "element_id", text: str = "text_raw") -> DataFrame:
    """(element_a, element_b): pairs of different elements whose texts look the same but differ in their characters.

    Elements are grouped by form, and within a form by text; only pairs of different texts of a form are joined to
    their members, so a text repeated in a third of all rows costs what it adds to the result. Rows without id or
    text give no pair; an element delivered twice counts once.
    """
    forms = one_form(df, id, text, F.md5("t")).filter("id is not null")
    keyed = cut(forms.select("id", F.md5("form").alias("form"), "raw").distinct())
    several = keyed.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo < hi").select("form")
    members = cut(keyed.join(several, "form", "left_semi"))
    kinds = members.select("form", "raw").distinct()
    other = kinds.select(F.col("form").alias("form_b"), F.col("raw").alias("raw_b"))
    pairs = kinds.join(other, (F.col("form") == F.col("form_b")) & (F.col("raw") < F.col("raw_b")))
    left = members.select(F.col("form").alias("f1"), F.col("raw").alias("r1"), F.col("id").alias("x"))
    right = members.select(F.col("form").alias("f2"), F.col("raw").alias("r2"), F.col("id").alias("y"))
    return (
        pairs.join(left, (F.col("form") == F.col("f1")) & (F.col("raw") == F.col("r1")))
        .join(right, (F.col("form_b") == F.col("f2")) & (F.col("raw_b") == F.col("r2")))
        .filter("x <> y")
        .select(F.least("x", "y").alias("element_a"), F.greatest("x", "y").alias("element_b"))
        .distinct()
    )
