"""Expressions in DuckDB's SQL, for the oracle texts: each function returns the text of an expression."""

from __future__ import annotations

from scriptorium.functions import arabic as a


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cls(pattern: str) -> str:
    """A Java pattern with \\uXXXX escapes as RE2 has them."""
    import re

    return q(re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern))


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {cls(pattern)}, {q(to)}, 'g')"


def tr(x: str, src: str, dst: str) -> str:
    return f"translate({x}, {q(src)}, {q(dst)})"


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def collapse(x: str) -> str:
    return f"trim({rep(x, a.SPACES, ' ')})"


def shaped(x: str) -> str:
    out = tr(x, a.SHAPES_FROM, a.SHAPES_TO)
    for form, letters in a.LIGATURE_FORMS.items():
        out = f"replace({out}, {q(form)}, {q(letters)})"
    return out


def search_form(x: str) -> str:
    out = collapse(tr(shaped(rep(rep(text(x), a.INVISIBLE), a.MARKS)), a.FOLD_FROM + "ء", a.FOLD_TO))
    cases = " ".join(f"when {q(b)} then {q(g)}" for b, g in a.WORD_FIXES.items())
    return f"array_to_string(list_transform(string_split({out}, ' '), lambda w: case w {cases} else w end), ' ')"


def canonical_form(x: str) -> str:
    t = f"replace({text(x)}, 'ـ', '')"
    for mark, pairs in (("ٔ", ("اأ", "وؤ", "يئ")), ("ٕ", ("اإ",)), ("ٓ", ("اآ",))):
        for letter, made in pairs:
            t = f"replace({t}, {q(letter + mark)}, {q(made)})"
    return collapse(tr(t, a.CANON_FROM, a.CANON_TO))


def retrieval_form(x: str) -> str:
    return collapse(tr(rep(canonical_form(x), a.HARAKAT), a.HAMZA_FROM, a.HAMZA_TO))


def match_key(x: str) -> str:
    return collapse(tr(rep(text(x), "[\\u064B-\\u065F\\u0670\\u0640]"), "آأإٱىة", "اااايه"))


def layout_form(x: str) -> str:
    return collapse(tr(rep(text(x), "[\\u064B-\\u065F\\u0670\\u0640]"), "آأإٱى", "اااا" + "ي"))


def light_stem(x: str) -> str:
    """Of an expression that is a retrieval form already."""
    front = "case " + " ".join(f"when starts_with({x}, {q(p)}) and length({x}) - {len(p)} >= 4 then substr({x}, {len(p) + 1})" for p in sorted(a.PREFIXES, key=len, reverse=True)) + f" else {x} end"
    back = "case " + " ".join(f"when ends_with(y, {q(s)}) and length(y) - {len(s)} >= 4 then substr(y, 1, length(y) - {len(s)})" for s in sorted(a.SUFFIXES, key=len, reverse=True)) + " else y end"
    return f"case when length({x}) <= 3 then {x} else (select {back} from (select {front} as y)) end"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def trigrams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text(x)}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
