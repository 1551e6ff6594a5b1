import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import bpe, languages, lookalikes, mixing, pagetext


# ------------------------------------------------------------------------------------------------- look-alikes
@pytest.mark.parametrize(
    "a, b",
    [
        ("ﻓﻲ ﺍﻟﻨﺬﻭﺭ", "في النذور"), ("ｔｈｅ", "the"), ("a b", "a b"), ("ال‏باب", "الباب"), ("أ", "أ"), ("علیه", "عليه"), ("کتاب", "كتاب"), ("الی", "الى"),
        ("أخلاە", "أخلاه"), ("۱۲۳", "١٢٣"), ("al‑X", "al-X"), ("َّ".join("بب"), "َّ".join("بب")), ("ﬁne", "fine"), ("a­b", "ab"), ("دا‌ر", "دار"),
    ],
)
def test_drawn_alike(a, b):
    assert lookalikes.drawn_form(a) == lookalikes.drawn_form(b)


@pytest.mark.parametrize("a, b", [("علي", "على"), ("كَتب", "كتب"), ("أحمد", "احمد"), ("ســلام", "سلام"), ("٤", "۴"), ("The", "the"), ("a\nb", "a b"), ("ملك", "ملک"), ("علي", "علی"), ("می‌شود", "میشود"), ("m²", "m2")])
def test_visibly_different(a, b):
    assert lookalikes.drawn_form(a) != lookalikes.drawn_form(b)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_forms_are_stable(text):
    once = lookalikes.drawn_form(text)
    assert lookalikes.drawn_form(once) == once


def test_pairs_of_lookalikes(spark):
    rows = [
        (1, "the narrator speaks"), (2, "the nаrrator speaks"), (3, "the narrator  speaks"), (4, "the narrator speaks"), (4, "the narrator speaks"), (5, "the narrator speaks"),
        (6, None), (7, ""), (8, "​"), (9, "раскат грома"), (10, "zzаzz unique"), (11, "zzazz unique"), (None, "the narrator speaks"),
    ]
    df = spark.createDataFrame(rows, "element_id long, text_raw string").withColumns({c: F.lit(1) for c in ("form", "raw", "id", "element_a", "f1")})
    got = {tuple(r) for r in lookalikes.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 4), (1, 5), (4, 5), (2, 5), (7, 8), (10, 11)}
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "one quіx"), (2, "one word")], "id int, t string")
    assert {r.id: r.form for r in lookalikes.one_form(df, "id", "t").collect()} == {1: "one quіx", 2: "one word"}
    assert lookalikes.dominant_script("привеt") == "CYRILLIC" and lookalikes.dominant_script("nаrrator") == "LATIN" and lookalikes.dominant_script("аa") is None
    assert [x[1] for x in lookalikes.mixed_tokens("the nаrrator саме привет")] == ["narrator"] and lookalikes.mixed_tokens("раскат сор") == []


def test_forms_of_both_texts(spark):
    rows = [(1, "ﻓﻲ  the nаrrator", None), (1, "ﻓﻲ  the nаrrator", None), (2, None, "the narrator"), (3, "", "ａ")]
    df = spark.createDataFrame(rows, "element_id long, text_raw string, text_normalized string").withColumns({c: F.lit(1) for c in ("text", "form", "key", "i")})
    got = sorted(tuple(r) for r in lookalikes.consistent_forms(df).collect())
    assert got == [(1, "text_raw", "في  the narrator"), (2, "text_normalized", "the narrator"), (3, "text_normalized", "a"), (3, "text_raw", "")]


# ------------------------------------------------------------------------------------------------- encoding
@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_vocabulary())


@given(st.lists(st.one_of(st.text(max_size=80), st.text("aab  \n'sستقل١½²_-", max_size=60)), max_size=6))
@settings(max_examples=150, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
def test_ids_equal_the_public_tokenizer(tokenizer, encoder, texts):
    texts = [t.replace("\x1c", "").replace("\x1d", "").replace("\x1e", "").replace("\x1f", "").replace("\x85", "") for t in texts]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoding_of_rows(spark, tokenizer):
    rows = [(1, "a <|endoftext|> b"), (2, None), (3, ""), (3, ""), (None, "ا" * 3000), (5, "x" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encoded(df).collect())
    assert got == sorted((i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert bpe.encoded(df.limit(0)).count() == 0
    n = {r.doc_id: r.tokens for r in bpe.token_counts(df, {"doc_id": F.col("doc_id")}).collect()}
    assert n[2] == 0 and n[5] == len(tokenizer.encode("x" * 20_000).ids)


# ------------------------------------------------------------------------------------------------- mixing
@given(st.floats(0.01, 4.9), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_rates_give_their_means(mean, cap):
    below = mixing.distribution(mean, cap)
    got = sum(1 - b for b in below)
    assert got == pytest.approx(min(mean, cap), abs=1e-6) and below == sorted(below)


def test_shares_are_reached_and_caps_kept(spark):
    rows = [(i, "word " * 20, s) for s, n, at in (("A ", 900, 0), ("b", 300, 1000), ("c", 100, 2000), (None, 20, 3000), ("unlisted", 20, 4000)) for i in range(at, at + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("empty", 0.0, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.reached_shares(docs, mix).collect()}
    assert set(got) == {"a", "b", "c", "empty"} and got["empty"].tokens == 0
    for s, share, cap in (("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 4)):
        assert abs(got[s].actual_share - share) < 0.04 and got[s].most_repeats <= cap
    drawn = mixing.mixture(docs, mix)
    assert [r.place for r in drawn.collect()] == sorted(r.place for r in drawn.collect()) and drawn.filter("source = 'unlisted'").count() == 0
    assert mixing.mixture(docs.limit(0), mix).count() == 0 and mixing.mixture(docs, mix.limit(0)).count() == 0


def test_the_default_total_lets_every_source_reach_its_share():
    sizes, targets = {"big": 1_000_000, "tiny": 10}, [("big", 0.5, 2), ("tiny", 0.5, 2)]
    means = mixing.plan(sizes, targets)
    assert means["tiny"] == (2.0, 2) and means["big"][0] == pytest.approx(0.00002)
    assert mixing.plan(sizes | {"shut": 50}, [("big", 0.5, 2), ("tiny", 0.25, 2), ("shut", 0.25, 0)])["shut"] == (0.0, 0)
    assert mixing.plan(sizes | {"shut": 50}, [("big", 0.5, 2), ("tiny", 0.25, 2), ("shut", 0.25, 0)])["tiny"] == (2.0, 2)
    # A larger total is drawn only where it is asked for.
    assert mixing.plan(sizes, targets, 500_000)["big"][0] == pytest.approx(0.25)


# ------------------------------------------------------------------------------------------------- languages
WORDS = {
    "ar": "عن قال في من على إلى الذي التي كان وقد بعد عند محمد أحمد كتاب الصلاة", "fa": "را است که این برای می شود کرده از با خواهد بود نیز کتاب چون", "ur": "ہے کے میں کی نے اور سے کا پر تک ہیں تھا لیے کتاب نماز",
    "en": "the of and that this narrator chapter reports every about within lawful which book their", "fr": "le la les une dans avec chaque mais notre sur témoin livre être cette pour", "tr": "bir bu ve için her bazı ile değildir olmuştur kitap şu eski fakat namaz ancak",
}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    rows = [(i, _text(rng, lang, 40), lang if i % 11 else "en") for i, lang in enumerate(list(WORDS) * 40)]
    extra = [
        (1001, _text(rng, "ar", 30) + " " + _text(rng, "en", 30), "ar"), (1002, _text(rng, "fa", 20), None), (1003, _text(rng, "tr", 20), "Turkish"), (1004, _text(rng, "en", 20) + " " + _text(rng, "ar", 4) + " " + _text(rng, "en", 20), "EN-gb"),
        (1005, None, "ar"), (1006, "", None), (1007, "12 / 7 : 33", None), (1008, _text(rng, "ur", 15), "und"), (1009, _text(rng, "fr", 6), " "), (1010, _text(rng, "fr", 20), "fr-FR"),
    ]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumns({"main": F.lit(1), "parts": F.lit("clash"), "told": F.lit(0)})


def test_labels_are_corrected(documents):
    got = {}
    for r in languages.corrected_labels(documents).filter("doc_id > 1000").collect():
        got.setdefault(r.doc_id, set()).add(r.language)
    assert got == {1001: {"ar", "en"}, 1002: {"fa"}, 1008: {"ur"}, 1009: {"fr"}}


def test_accuracy_on_held_out_texts(documents):
    rng = random.Random(77)
    w = languages.fit([r.text for r in documents.filter("doc_id < 240").collect()], [r.lang for r in documents.filter("doc_id < 240").collect()])
    who = languages.Identifier(w)
    texts = [(lang, _text(rng, lang, 12)) for lang in list(WORDS) * 30]
    t, lang, _, size, sure = who.stretches([x for _, x in texts])
    main = {i: languages.LANGUAGES[k] for i, k in zip(t.tolist(), lang.tolist())}
    assert np.mean([main[i] == want for i, (want, _) in enumerate(texts)]) > 0.97 and sure.min() >= 0.0 and sure.max() <= 1.0


def test_stretches_of_empty_tables(documents):
    assert languages.corrected_labels(documents.limit(0)).count() == 0
    assert languages.Identifier(np.zeros((languages.FEATURES, 7), np.float32)).stretches([None, "", "1"])[0].size == 0


# ------------------------------------------------------------------------------------------------- scanned pages
def _pages(spark):
    rng = random.Random(8)
    vocabulary = [a + b for a in ("mar", "gar", "nar", "lib", "cha", "wit", "vol", "tes", "com", "sen") for b in ("ket", "dens", "rator", "rary", "pters", "ness", "ume", "ting", "mon", "tence")]
    rows, element = [], 0
    for page in range(1, 121):
        body = [rng.choice(vocabulary) for _ in range(60)]
        head = f"{page + 3} The Book of Trials"
        for order, text in enumerate([head, " ".join(body[:30]) + "\n" + " ".join(body[30:]), f"- {page + 3} -"]):
            element += 1
            rows.append((element, page, 1, page, order, text))
    def put(page, order, text):
        i = (page - 1) * 3 + order
        rows[i] = (*rows[i][:5], text)

    put(5, 1, "chapters witness voluine\nnarrator")
    put(6, 1, "chapters wit-\nness self-\nrestraint")
    put(7, 1, "self-restraint market nar-")
    put(8, 1, "gardens library\n[4711]\nvolume")
    rows.append((9001, 7, 1, 7, 2, "rator chapters"))
    rows += [(9002, None, None, None, None, "loose volume"), (9003, 7, 1, 7, 3, None), (9004, 7, 1, 7, 4, ""), rows[0]]
    for i in range(200, 206):
        rows.append((9100 + i, i, 1, i, 1, "self-restraint gardens"))
    df = spark.createDataFrame(rows, "element_id long, page_id long, book_id long, page_number int, element_order int, text_raw string")
    return df.withColumns({"word": F.lit(1), "line": F.lit(2), "kind": F.lit("clash")}), spark.createDataFrame([(1, "The Book of Trials")], "book_id long, title string")


def test_noise_of_pages(spark):
    pages, books = _pages(spark)
    got = {}
    for r in pagetext.noise_kinds(pages, books).collect():
        got.setdefault(r.kind, set()).add(r.element_id)
    assert got["header"] == {3 * i + 1 for i in range(120)} and got["page_number"] == {3 * i + 3 for i in range(120)}
    assert got["broken_word"] == {17, 20}
    empty = pages.limit(0)
    assert pagetext.noise_kinds(empty, books).count() == 0


def test_display_text(spark):
    pages, books = _pages(spark)
    got = {r.element_id: r.text_display for r in pagetext.display_texts(pages, books).filter("element_id in (1, 3, 17, 23, 9002, 9003, 9004)").collect()}
    assert got == {1: "", 3: "", 17: "chapters witness self-restraint", 23: "gardens library [4711] volume", 9002: "loose volume", 9003: None, 9004: ""}


def test_words_divided_to_the_next_element_are_joined(spark):
    pages, books = _pages(spark)
    got = {r.element_id: r.text_display for r in pagetext.display_texts(pages, books).filter("element_id in (20, 9001)").collect()}
    assert got == {20: "self-restraint market narrator", 9001: "chapters"}


def test_halves_move_whole_or_not_at_all(spark):
    done = [(1, "one wit-"), (2, "ness, two nar-"), (3, "rator"), (4, "a mar-"), (5, "other ket"), (6, "x vo-"), (7, "lu-"), (8, "me y")]
    over = [(1, "wit", 2, "ness"), (2, "nar", 3, "rator"), (4, "mar", 5, "ket"), (6, "vo", 7, "lu"), (7, "lu", 8, "me")]
    moved = pagetext.carried(spark.createDataFrame(done, "element_id long, text_display string"), spark.createDataFrame(over, "element_id long, left string, next_id long, right string"))
    assert {r.m: r.text_moved for r in moved.collect()} == {1: "one witness,", 2: "two narrator", 3: "", 7: "lume", 8: "y"}


def test_editor_learns_the_recognisers_edits():
    rng = random.Random(2)
    letters = "abdeghiklmnoprstu"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(500)})
    frequent = [(w, 400) for w in words]
    rare = [(w.replace("e", "c", 1), 2) for w in words if "e" in w][:120] + [(w.replace("o", "0", 1), 1) for w in words if "o" in w][:60]
    e = pagetext.train_editor(sorted(frequent), sorted(set(rare)))
    assert {("c", "e"), ("0", "o")} <= set(e.edits)
    held = [w for w in words if "e" in w][120:170]
    hits = sum(any(p == w for p, _ in e.proposals(w.replace("e", "c", 1))) for w in held)
    assert hits >= 0.8 * len(held)
    assert not pagetext.train_editor([], []).edits


def test_joins_are_learned():
    letters = "abdeghiklmnoprstu"
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    # Torn pieces are no words; the parts of a compound are.
    torn = [("-", make(3), make(4) + "ing", 1, 30, 0, 1, 1) for _ in range(60)]
    own = [("-", make(6), make(6), 1, 0, 9, 40, 40) for _ in range(60)]
    j = pagetext.train_joiner(torn[:40] + own[:40])
    held = [(k, True) for k in torn[40:]] + [(k, False) for k in own[40:]]
    told = [j.joins(m, a, b, dict(zip(pagetext._COUNTS, (0, 0, na, nb)))) == goal for (m, a, b, _, _, _, na, nb), goal in held]
    assert np.mean(told) > 0.9 and j.joins("¬", "a", "b", dict.fromkeys(pagetext._COUNTS, 0))
    assert pagetext.train_joiner([]).weights == {}


def test_late_words_give_examples_too():
    rng = random.Random(9)
    letters = "abdhiklmnoprstu"
    make = lambda first, inner: first + "".join(rng.choice(letters) for _ in range(3)) + inner + "".join(rng.choice(letters) for _ in range(4))
    early = sorted({make("a", "e") for _ in range(6500)})
    late, own = sorted({make("z", "fa") for _ in range(200)}), sorted({make("z", "qo") for _ in range(200)})
    frequent = [(w, 400) for w in own + late + early]
    rare = [(w.replace("e", "c"), 2) for w in early] + [(w.replace("f", "q"), 2) for w in late[:150]]
    e = pagetext.train_editor(frequent, rare, epochs=1)
    hits = sum(w in [p for p, _ in e.proposals(w.replace("f", "q"))] for w in late[150:])
    assert hits >= 0.8 * len(late[150:])
    # A q before an a stands in the late misread words only.
    assert "nqa" in e.weights


def test_every_proposal_is_asked_for():
    # Eight edits above keeping; the collection may hold only the last.
    e = pagetext.Editor({"b": {f"{c}>{c.upper()}": 9.0 - k for k, c in enumerate("abcdefgh")}}, [(c, c.upper()) for c in "abcdefgh"])
    assert [p for p, _ in e.proposals("abcdefgh")][-1] == "abcdefgH" and len(e.proposals("abcdefgh")) == 8


def test_two_misread_places_are_repaired(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abdghiklmnoprstu") for _ in range(7)) for _ in range(300)})
    frequent = [w[:1] + "e" + w[2:5] + "e" + w[6:] for w in words]
    once, twice = {w.replace("e", "c", 1): w for w in frequent[:150]}, {w.replace("e", "c"): w for w in frequent[200:240]}
    rows = [(w, 400) for w in frequent] + [(w, 2) for w in once] + [(w, 1) for w in twice]
    got = {r.word: r.right for r in pagetext.corrections(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert sum(got.get(w) == right for w, right in twice.items()) >= 0.8 * len(twice)
    assert set(got) <= {*once, *twice}


def test_folding_is_the_same_on_both_sides(spark):
    texts = ["Ｆull ﬁne", "أحکام ﻓﻲ", "ذکَر", "Sīnān", "ﻻ ا", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(pagetext.folded(F.col("t")).alias("f")).collect()] == [pagetext.fold(t) for t in texts]
    assert unicodedata.normalize("NFC", pagetext.fold("Sīnān")) == "sinan"
