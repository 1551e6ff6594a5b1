"""The search form with a map back to the raw text: which raw character each folded one came from."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import arabic

_DROPPED = re.compile(arabic.INVISIBLE)
_MARK = re.compile(arabic.MARKS)
_FOLD = dict(zip(arabic.FOLD_FROM, arabic.FOLD_TO)) | {"ء": ""}


class _Table(dict):
    """What each character becomes, folded or not; None for white space. Filled as characters are met."""

    def __init__(self, fold: bool):
        super().__init__()
        self.fold = fold

    def __missing__(self, c: str):
        if _DROPPED.match(c):
            out = ""
        elif c.isspace():
            out = None
        elif self.fold and _MARK.match(c):
            out = ""
        else:
            out = unicodedata.normalize("NFKC", c)
            if self.fold:
                out = "".join(_FOLD.get(x, x) for x in out if not _MARK.match(x))
        self[c] = out
        return out


_TABLES = {True: _Table(True), False: _Table(False)}


def canonicalized(text: str | None, fold: bool = True) -> tuple[str, list[int]]:
    """The canonical text and, for each of its characters, the place of the raw one it came from."""
    table, chars, places = _TABLES[fold], [], []
    blank = -1
    for i, c in enumerate(text or ""):
        made = table[c]
        if made is None:
            blank = i if chars else -1
        elif made:
            if blank >= 0:
                chars.append(" ")
                places.append(blank)
                blank = -1
            chars.extend(made)
            places.extend([i] * len(made))
    form = "".join(chars)
    if not fold or not any(bad in form for bad in arabic.WORD_FIXES):
        return form, places
    chars, fixed_places = [], []
    for m in re.finditer("[^ ]+| ", form):
        fixed = arabic.WORD_FIXES.get(m[0])
        chars.append(fixed or m[0])
        # A word put right belongs to where it began.
        fixed_places += [places[m.start()]] * len(fixed) if fixed else places[m.start() : m.end()]
    return "".join(chars), fixed_places


def canonical(text: Column, fold: bool = True) -> Column:
    """struct(canonical, offsets): the canonical form, with every compatibility form resolved, and the map to the raw
    text. Not folded, marks and letters stay. A null text is empty."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonicalized(t, fold) for t in texts], columns=["canonical", "offsets"])

    return F.pandas_udf(run, "canonical string, offsets array<int>")(text)


def raw_span(offsets: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the raw text of the canonical characters from ``start`` up to ``end``, counted from 0 and
    kept within the text; (0, 0) for an empty text or an empty span."""
    n = F.size(offsets)
    s = F.greatest(F.lit(0), F.least(start, n - 1))
    e = F.greatest(s + 1, F.least(end, n))
    none = (n <= 0) | (start >= end)
    return F.struct(F.when(none, 0).otherwise(F.get(offsets, s)).alias("start"), F.when(none, 0).otherwise(F.get(offsets, e - 1) + 1).alias("end"))


def raw_excerpt(raw: Column, offsets: Column, start: Column, end: Column) -> Column:
    """The raw text a span of the canonical form came from, marks and all."""
    span = raw_span(offsets, start, end)
    return F.substring(raw, span["start"] + 1, span["end"] - span["start"])
