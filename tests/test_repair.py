"""Canonical forms with their maps, and torn words, against fixtures and a plain reading."""

import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import arabic, canonical
from scriptorium.operators import repair

LEXICON = [("عليه", 16901), ("عبد", 10779), ("محمد", 2651), ("الله", 19673), ("قال", 16955), ("د", 16359), ("محم", 13427), ("حماد", 300), ("حم", 900), ("الحسن", 400), ("احمد", 800)]


def test_maps_point_to_the_raw_text(spark):
    texts = ["قَالَ  رَسُولُ الله", "ﻻ إله", " عَنْ ﷲ ", "", None, "كــتــاب ء", "عن االله"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = {r.id: r for r in df.select("id", "t", canonical.canonical(F.col("t")).alias("c")).select("id", "t", "c.*", canonical.raw_excerpt(F.col("t"), F.col("c.offsets"), F.lit(0), F.lit(3)).alias("x")).collect()}
    assert rows[0].canonical == "قال رسول الله" and rows[0].x == "قَالَ"[:4] and rows[1].canonical == "لا اله" and rows[2].canonical.startswith("عن ")
    assert rows[3].canonical == "" == rows[4].canonical and rows[3].x == "" and rows[5].canonical == "كتاب" and rows[6].canonical == "عن الله"
    for r in rows.values():
        assert len(r.canonical) == len(r.offsets) and r.offsets == sorted(r.offsets) and all(0 <= p < len(r.t or "") for p in r.offsets)


@given(st.text("اأإبتةىيء ًَّــ‌١٢ab\n", max_size=30))
@settings(max_examples=100, deadline=None)
def test_surface_forms_only_clean(text):
    form, places = canonical.canonicalized(text, fold=False)
    assert [unicodedata.normalize("NFKC", text[p]) if not text[p].isspace() else " " for p in places] == list(form)


def _fix(spark, texts):
    lexicon = spark.createDataFrame(LEXICON, "word string, frequency long")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "element_id int, t string").withColumns({c: F.lit(1) for c in ("left", "made", "w")})
    return {r.element_id: r for r in repair.corrected_texts(df, lexicon, "element_id", "t").collect()}


def test_torn_words_are_joined_and_others_stay(spark):
    got = _fix(spark, ["عن أحمد بن محمّ ، د عن علي", "عن حمّ ، اد عن حريز", "عن ا لحسن", "عــــن أبي عبد االله", "قال رسول الله ، الماء يطهر ولا يطهر", "1 من 2", None, ""])
    assert "محمّد" in got[0].text and "حمّاد" in got[1].text and got[2].text == "عن الحسن" and got[3].text == "عن أبي عبد الله"
    assert (got[3].stretched, got[3].ligatures) == (1, 1) and got[0].merged == 1
    assert got[4].text == "قال رسول الله ، الماء يطهر ولا يطهر" and got[5].text == "1 من 2" and got[6].text == got[7].text == ""


@pytest.mark.parametrize("text, want", [("محمّ د عن", "محمّد عن"), ("مّ وأُ", "مّ وأُ"), ("كَ من قال", "كَ من قال"), ("", "")])
def test_letters_behind_marks(text, want):
    assert repair.join_after_mark(text)[0] == want


def test_pieces_are_used_once():
    joins = {("a", "b", False), ("b", "c", False), ("c", "d", True)}
    assert repair.scan(["a", "b", "c", "،", "d"], joins, False) == (["ab", "cd"], ["a b -> ab", "c ، d -> cd"])
    assert repair.scan(["b", "c", "،", "d"], joins, True) == (["bc", "،", "d"], ["b c -> bc"])
    assert repair.scan([], joins, True) == ([], [])


def test_passes_end_where_nothing_joins(spark):
    rows = [(i, "حماد عن الحلبي".split()) for i in range(5)] + [(10 + i, "محمد بن يعقوب".split()) for i in range(6)] + [(20, "عن حم اد و محم د".split()), (21, [])]
    fixed, made = repair.repaired_texts(spark.createDataFrame(rows, "element_id int, tokens array<string>"))
    assert {r.element_id: r.tokens for r in fixed.filter("element_id >= 20").collect()} == {20: "عن حماد و محمد".split(), 21: []}
    assert [(r.pattern, r.times) for r in repair.top_patterns(made).collect()] == [("حم اد -> حماد", 1), ("محم د -> محمد", 1)]


def test_pieces_follow_the_columns_keys(spark):
    from scriptorium.operators import structure

    words = ["د", "محم", "حمّاد", "عَنْ", "على", "أحمد", "مؤمن", "رئة", "ـــ", "كــتب", "ٱلله", "abc", "ab", "د،", "،", "", "حم1", "ىة", "آأإ"]
    key = arabic.lexicon_key(F.col("w"))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", key.alias("key"), F.col("w").rlike("^[\\u0621-\\u064A\\u064B-\\u065F\\u0670\\u0671]+$").alias("letters"), key.isin(structure.PROTECTED).alias("kept")).collect()
    assert {r.w: repair._piece(r.w) for r in rows} == {r.w: 0 if not r.letters or r.kept else 2 if len(r.key) <= repair.SHORT else 1 for r in rows}


def test_long_texts_take_time_by_their_length(spark):
    letters = "بتثجحخدذرزسش"
    words = [a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "طظ"]
    tokens = [t for w in words for t in (w, "حم")] + ["اد", None, "،", "حم", "،", "اد"]
    texts = spark.createDataFrame([(1, tokens), (2, None), (3, []), (4, ["حم"])], "element_id int, tokens array<string>")
    began = time.time()
    got = {tuple(r) for r in repair._candidates(texts, "element_id").collect()}
    assert time.time() - began < 15
    assert got == {(1, a, b, False) for a, b in zip(tokens[:-5], tokens[1:-5])} | {(1, "حم", "اد", True)} | {(1, "حم", "اد", False)}
