"""Noise in text from scanned pages: running headers, page numbers, divided words and misrecognised characters.

Furniture is told by its place on the page and by repetition over the book's pages. Words are repaired by a character
editor, an averaged perceptron that predicts keep, replace, delete or insert at each character of a word, and join or
keep at each mark that ends a line. It is trained here, on this collection: rare words that lie one edit from a word many times as
frequent show which edits the recogniser makes; edits that are as usual between frequent words are morphology and do
not count. A predicted edit stands only if it leads to a word the whole collection holds far more often.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lookalikes import CYRILLIC_LOOKS, GREEK_LOOKS, SAME_DIGITS
from scriptorium.runtime import cut, key_filter, stored

#: Words of each kind (established, rare) that the editor is fitted on, and passes over them.
FIT_WORDS, EPOCHS = 20_000, 3
#: A correction is so many times as frequent as the word it replaces, and occurs so often.
TIMES, LEAST = 12, 6
#: Kinds of line ends that the join operation is fitted on.
FIT_JOINS = 20_000
#: Longer runs of letters and digits are no words: they are not corrected, and nothing is corrected to them.
LONGEST_WORD = 40
#: A running header stands at the top of at least HEADER_PAGES pages, HEADER_SHARE of its occurrences in the places of a
#: header, on HEADER_DENSITY of the pages from its first to its last. A line of more than NUMBERED_WORDS words needs
#: these even where the page's number stands beside it.
HEADER_PAGES, HEADER_SHARE, HEADER_DENSITY, NUMBERED_WORDS = 2, 0.7, 0.1, 10
MARKS_AT_END = "-¬=­‐‑－ـ"


def _fold_table() -> tuple[str, str, str]:
    """(characters, what they become, characters dropped) of the form in which words are compared."""
    one: dict[str, str] = {}
    for lo, hi in ((0xFB50, 0xFDFF), (0xFE80, 0xFEFC), (0xFF10, 0xFF5E)):
        for cp in range(lo, hi + 1):
            flat = unicodedata.normalize("NFKC", chr(cp))
            if len(flat) == 1:
                one[chr(cp)] = flat
    one |= CYRILLIC_LOOKS | GREEK_LOOKS | SAME_DIGITS
    one |= {"ی": "ي", "ى": "ي", "ک": "ك", "ە": "ه", "ة": "ه", "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ؤ": "و", "ئ": "ي"}
    for c, v in list(one.items()):
        one[c] = one.get(v, v)
    for cp in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            one[chr(cp)] = base
    for cp in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9):
        one[chr(cp)] = " "
    drop = [chr(c) for c in (*range(0x300, 0x370), *range(0x610, 0x61B), *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6DD), 0x640, 0xAD, 0x61C, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)]
    return "".join(one), "".join(one.values()), "".join(drop)


_FROM, _TO, _DROP = _fold_table()
_FOLD = {ord(a): b for a, b in zip(_FROM, _TO)} | {ord(c): None for c in _DROP}
# Ligatures of more than one letter.
_LIGATURES = (("\uFB01", "fi"), ("\uFB02", "fl"), ("[\uFEF5-\uFEFC]", "\u0644\u0627"))
WORD = "[\\p{L}\\p{N}]+(?:[-'’][\\p{L}\\p{N}]+)*"


def folded(c: Column) -> Column:
    """A text in the form in which words are compared; line feeds stay."""
    for a, b in _LIGATURES:
        c = F.regexp_replace(c, a, b)
    return F.lower(F.translate(c, _FROM + _DROP, _TO))


def fold(text: str) -> str:
    for a, b in _LIGATURES:
        text = re.sub(a, b, text)
    return text.translate(_FOLD).lower()


def letters_key(c: Column) -> Column:
    """The letters of a folded line, one blank between words."""
    return F.btrim(F.regexp_replace(c, "[^\\p{L}]+", " "))


# ---------------------------------------------------------------------------------------------- page furniture


def elements(df: DataFrame) -> DataFrame:
    """The columns used, of the elements that have a text."""
    return df.select("element_id", "page_id", "book_id", "page_number", "element_order", "text_raw").filter("element_id is not null and text_raw is not null")


def printed_number(line: Column) -> Column:
    """The number of a line that is nothing but a number, as a page number is printed; null for other lines. Characters
    that recognition takes for digits count as them."""
    bare = F.regexp_replace(F.translate(line, _DROP, ""), "^[\\s\\p{Z}\\[\\](){}<>«».\\-–—‐ـ|*~]*(?:(?:ص|صفحه|صفحة|[Pp]age|[Pp]g?)[.\\s\\p{Z}:]*)?|[\\s\\p{Z}\\[\\](){}<>«».\\-–—‐ـ|*~]+$", "")
    # Digits of the Arabic series and letters misread for digits.
    digits = F.translate(bare, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹اأهoOQIlيSsBZzوgqب", "0123456789012345678911500011" + "25" + "5" + "8" + "22" + "9" + "99" + "1")
    plain = F.rlike(bare, F.lit("^(?=.*[\\p{N}])[\\p{N}اأهoOQIlيSsBZzوgqب]{1,5}$")) | F.rlike(bare, F.lit("^[اأه]{1,2}$"))
    return F.when(plain, digits.try_cast("int"))


#: A line of nothing but the characters a printed page number may have: what may be one, whatever its length.
_NUMBER_LINE = "(?m)^[[^\\S\\n]\\p{Z}\\p{N}\\p{Mn}\\p{Cf}\\[\\](){}<>«».:\\-–—‐ـ|*~اأهoOQIlيSsBZzوgqبصفحةPpae]+$"


def page_offsets(lines: DataFrame) -> DataFrame:
    """(book, shift): the commonest difference of printed and counted page numbers of each book."""
    seen = lines.filter("printed is not null and page_number is not null").select("book_id", (F.col("printed") - F.col("page_number")).alias("shift"))
    counts = seen.groupBy("book_id", "shift").count()
    return counts.groupBy(F.col("book_id").alias("book")).agg(F.max_by("shift", F.struct("count", (-F.abs("shift")).alias("s"))).alias("shift"))


def number_lines(rows: DataFrame, top_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element_id, line) of the lines that are nothing but the printed page number, and the books' shifts, for which
    numbers at the ends of top lines count as well."""
    # Only lines of such characters are taken apart; most elements have none.
    short = F.filter(F.transform(F.split("text_raw", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda x: x["text"].rlike(_NUMBER_LINE))
    lines = rows.filter(F.col("text_raw").rlike(_NUMBER_LINE)).select("element_id", "book_id", "page_number", F.explode(short).alias("x"))
    lines = cut(
        lines.select("element_id", "book_id", "page_number", "x.line", "x.text")
        .filter(F.col("text").rlike("[\\p{N}اه]"))
        .withColumn("printed", printed_number(F.col("text")))
        .filter("printed is not null")
        .select("element_id", "book_id", "page_number", "line", "printed")
    )
    beside = top_lines.filter("element_order <= 1 and not numbered").select("book_id", "page_number", F.col("edge").alias("printed"))
    shifts = cut(page_offsets(lines.select("book_id", "page_number", "printed").unionByName(beside)))
    return lines.join(shifts, F.col("book_id").eqNullSafe(F.col("book"))).filter("printed = page_number + shift").select("element_id", "line").distinct(), shifts


def _parts(line: Column) -> Column:
    """For each word of a key of two words or more: a hash of all the others at their places, its place, and itself."""
    words = F.when(F.size(F.split(line, " ")) >= 2, F.split(line, " "))
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, i))
    whole = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))
    return F.transform(words, lambda w, i: F.struct(whole.bitwiseXOR(F.xxhash64(w, i)).alias("rest"), i.alias("at"), w.alias("word")))


def first_lines(rows: DataFrame) -> DataFrame:
    """The first line of each page's first two elements, and of elements of one line, as far as it may be furniture:
    its letters (key), whether it stands alone, has a heading's number, any digits, and a number at an end (edge)."""
    first = F.substring_index("text_raw", "\n", 1)
    lines = rows.filter("element_order is not null and page_id is not null").select(
        "element_id", "book_id", "page_id", "page_number", "element_order", first.alias("line"), (F.instr("text_raw", "\n") == 0).alias("alone")
    )
    f = folded(F.col("line"))
    edge = F.coalesce(F.nullif(F.regexp_extract("f", "^(\\p{N}+) ", 1), F.lit("")), F.regexp_extract("f", " (\\p{N}+)$", 1))
    lines = lines.withColumn("f", f).select(
        "element_id", "book_id", "page_id", "page_number", "element_order", "alone", letters_key(F.col("f")).alias("key"),
        (F.col("f").rlike("^\\P{L}*\\p{N}+\\s*[-–.]") | F.col("line").rlike("^[^\\p{L}ـ]*\\p{N}+[\\s\\p{Z}]*ـ")).alias("numbered"),
        F.col("f").rlike("\\p{N}").alias("digits"),
        F.translate(edge, "٠١٢٣٤٥٦٧٨٩", "0123456789").try_cast("int").alias("edge"),
    )
    return cut(lines.filter((F.length("key") >= 3) & ((F.col("element_order") <= 1) | F.col("alone"))).distinct())


def header_lines(top_lines: DataFrame, books: DataFrame, shifts: DataFrame) -> DataFrame:
    """(element_id): elements whose first line is a running header.

    Top lines are the first line of a page's first element, and of the second where the first is a heading by itself.
    A key (the line's letters) is a header's if it is the book's title, or stands alone in an element somewhere in the
    book, at the top of HEADER_PAGES pages or more, most of its occurrences being top lines of neighbouring pages.
    A key that once has the page's printed number beside it needs no more than those pages. Headings have a number and a
    dash or dot before them; where none of a key's has, the first page that has it alone and without a number opens it. A line that misses a key by one badly read word counts too.
    """
    paged = F.coalesce((F.col("edge") == F.col("page_number") + F.col("shift")) & (F.size(F.split("key", " ")) <= NUMBERED_WORDS), F.lit(False))
    lines = top_lines.join(shifts, F.col("book_id").eqNullSafe(F.col("book")), "left").withColumn("paged", paged & ~F.col("numbered")).drop("book", "shift")
    top = (F.col("element_order") == 0) | ((F.col("element_order") == 1) & ~F.col("alone"))
    stats = lines.groupBy(F.col("book_id").alias("b"), F.col("key").alias("k")).agg(
        F.count_distinct(F.when(top & ~F.col("numbered"), F.col("page_id"))).alias("pages"),
        F.max(F.col("alone").cast("int")).alias("alone_once"),
        F.avg((top | F.col("numbered") | (F.col("element_order") <= 1)).cast("double")).alias("high"),
        F.min(F.when(F.col("alone"), F.col("page_id"))).alias("first_alone"),
        F.max(F.col("numbered").cast("int")).alias("numbered_once"),
        F.max((top & F.col("paged")).cast("int")).alias("paged_once"),
        (F.max("page_id") - F.min("page_id") + 1).alias("span"),
    )
    titles = books.select(F.col("book_id").alias("tb"), letters_key(folded(F.col("title"))).alias("tk")).filter("tk <> ''").distinct()
    stats = stats.join(titles, (F.col("b") == F.col("tb")) & (F.col("k") == F.col("tk")), "left")
    keys = cut(
        stats.filter(
            F.col("tk").isNotNull()
            | ((F.col("pages") >= HEADER_PAGES) & (F.col("paged_once") == 1))
            | ((F.col("pages") >= HEADER_PAGES) & (F.col("alone_once") == 1) & (F.col("high") >= HEADER_SHARE) & (F.col("pages") / F.col("span") >= HEADER_DENSITY))
        ).select("b", "k", F.when(F.col("numbered_once") == 0, F.col("first_alone")).alias("opens"), F.col("tk").isNotNull().alias("title"))
    )
    exact = lines.filter("element_order <= 1").join(keys, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("key") == F.col("k")), "left")
    exact = cut(exact.drop("b"))
    parts = keys.select("b", "k", "opens", "title", F.explode(_parts(F.col("k"))).alias("p")).select(F.col("b").alias("pb"), "p.rest", "p.at", F.size(F.split("k", " ")).alias("kn"), F.col("p.word").alias("right"), F.col("title").alias("t2"))
    near = (
        exact.filter("(k is null or not title) and not numbered")
        .withColumn("words", F.size(F.split("key", " ")))
        .join(keys.select(F.col("b").alias("b2"), F.size(F.split("k", " ")).alias("w2")).distinct(), F.col("book_id").eqNullSafe(F.col("b2")) & (F.col("words") == F.col("w2")), "left_semi")
        .select("element_id", "book_id", "words", F.explode(_parts(F.col("key"))).alias("q"))
        .join(parts, F.col("book_id").eqNullSafe(F.col("pb")) & (F.col("q.rest") == F.col("rest")) & (F.col("q.at") == F.col("at")) & (F.col("words") == F.col("kn")))
        .filter((F.length("right") >= 3) & (F.levenshtein("q.word", "right") <= F.when(F.length("right") > 4, 2).otherwise(1)))
        .groupBy(F.col("element_id").alias("e2"))
        .agg(F.max("t2").alias("t2"))
    )
    told = exact.join(near, F.col("element_id") == F.col("e2"), "left").withColumn("is_key", F.col("k").isNotNull() | F.col("e2").isNotNull() | F.col("paged"))
    heading = F.col("alone") & (F.col("numbered") | (F.coalesce(F.col("k").isNotNull() & ~F.col("title"), F.lit(False)) & ~F.coalesce(F.col("t2"), F.lit(False)) & ~F.col("digits") & F.coalesce(F.col("page_id") == F.col("opens"), F.lit(False))))
    told = cut(told.select("element_id", "page_id", "element_order", "is_key", "numbered", "alone", heading.alias("heading")))
    opened = told.filter("element_order = 0 and heading").select(F.col("page_id").alias("op")).distinct()
    at_zero = told.filter("element_order = 0 and is_key and not heading and not numbered").select("element_id")
    at_one = told.filter("element_order = 1 and is_key and not numbered and not heading").join(opened, F.col("page_id") == F.col("op"), "left_semi").select("element_id")
    return at_zero.unionByName(at_one).distinct()


# ---------------------------------------------------------------------------------------------- words and the editor


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): the folded words with a letter, counted over the whole collection."""
    words = rows.select(F.explode(F.regexp_extract_all(folded(F.col("text_raw")), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("word").rlike("\\p{L}"))


def single_edit(wrong: str, right: str) -> tuple[int, str, str] | None:
    """(place, what stands, what should) if the words differ in one place by at most two characters to two."""
    i = 0
    while i < min(len(wrong), len(right)) and wrong[i] == right[i]:
        i += 1
    j = 0
    while j < min(len(wrong), len(right)) - i and wrong[-1 - j] == right[-1 - j]:
        j += 1
    a, b = wrong[i : len(wrong) - j], right[i : len(right) - j]
    return (i, a, b) if max(len(a), len(b)) <= 2 and (a or b) else None


class Editor:
    """The averaged perceptron: weights of (feature, operation)."""

    def __init__(self, weights: dict[str, dict[str, float]], edits: list[tuple[str, str]]):
        self.weights, self.edits = weights, edits
        self.by_first: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for a, b in edits:
            self.by_first[a[:1]].append((a, b))

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = f"^^{word}$$"
        c, p, n = w[i + 2], w[i + 1], w[i + 3]
        kind = "d" if c.isdigit() else "l" if "a" <= c <= "z" else "o"
        around = "d" if p.isdigit() or n.isdigit() else "l"
        return [f"c{c}", f"p{p}{c}", f"n{c}{n}", f"t{p}{c}{n}", f"u{w[i]}{p}{c}", f"v{c}{n}{w[i + 4]}", f"k{kind}{around}", "b"]

    def score(self, feats: list[str], op: str) -> float:
        return sum(w.get(op, 0.0) for f in feats if (w := self.weights.get(f)))

    def steps(self, word: str, floor: float = 0.0):
        """(word made, margin over keeping, place, characters replaced, characters written) of every edit above the floor."""
        for i in range(len(word)):
            options = [e for e in self.by_first.get(word[i : i + 1], ()) if word.startswith(e[0], i)]
            if not options:
                continue
            feats = self.features(word, i)
            keep = self.score(feats, "keep")
            for a, b in options:
                s = self.score(feats, f"{a}>{b}") - keep
                made = word[:i] + b + word[i + len(a) :]
                if s > floor and made:
                    yield made, s, i, len(a), len(b)

    def proposals(self, word: str, floor: float = 0.0) -> list[tuple[str, float]]:
        """All words one edit away, the best first, with the editor's margin over keeping."""
        found: dict[str, float] = {}
        for made, s, *_ in self.steps(word, floor):
            found[made] = max(s, found.get(made, s))
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def double_proposals(self, word: str, floor: float = 0.0) -> list[tuple[str, float]]:
        """All words two edits at two places away, the second judged beside the first."""
        found: dict[str, float] = {}
        for first, s, i, _, b in self.steps(word, floor):
            for made, t, j, a, _ in self.steps(first, floor):
                if made != word and (j + a <= i or j >= i + b):
                    found[made] = max(s + t, found.get(made, s + t))
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def operations(word: str, edit: tuple[int, str, str] | None) -> list[tuple[int, str]]:
    """The operation at each character: keep, or the edit at its first character. What is missing altogether is written
    as a replacement of the character that follows or precedes."""
    out = [(i, "keep") for i in range(len(word))]
    if edit:
        i, a, b = edit
        out = [(j, op) for j, op in out if not i <= j < i + max(len(a), 1)]
        out.append((i, f"{a}>{b}"))
    return out


def train_editor(frequent: list[tuple[str, int]], rare: list[tuple[str, int]], epochs: int = EPOCHS) -> Editor:
    """Fit the editor on established words (kept as they are) and rare words (one edit from a far more frequent one).

    An edit is the recogniser's if it stands between words and words TIMES as frequent far oftener, in proportion to
    how often it stands between words of like frequency, than edits usually do: those are other words, no misreadings.
    """
    count = dict(frequent)
    index: dict[str, list[str]] = defaultdict(list)
    for w, _ in frequent:
        for k in range(len(w)):
            index[w[:k] + "\0" + w[k + 1 :]].append(w)
            if k + 1 < len(w):
                index[w[:k] + "\0" + w[k + 2 :]].append(w)

    def sources(w: str, n: int):
        seen = set()
        for k in range(len(w)):
            for hole in (w[:k] + "\0" + w[k + 1 :], w[:k] + "\0" + w[k + 2 :] if k + 1 < len(w) else ""):
                for c in index.get(hole, ()):
                    if c == w or c in seen or count[c] < TIMES * n or not (e := single_edit(w, c)):
                        continue
                    i, a, b = e
                    if not a or not b:
                        # An empty side is written with a neighbour, of two like characters with the like one. A last
                        # character too many or too few is an ending, not a misreading.
                        if i + len(a) >= len(w) or i + len(b) >= len(c):
                            continue
                        if i and (a or b)[0] == w[i - 1]:
                            i, a, b = i - 1, w[i - 1] + a, w[i - 1] + b
                        else:
                            a, b = a + w[i + len(a)], b + w[i + len(a)]
                    if len(a) <= 2 and len(b) <= 2:
                        seen.add(c)
                        yield c, (i, a, b)
                        if len(a) == len(b) == 1 and i:
                            yield c, (i - 1, w[i - 1] + a, w[i - 1] + b)

    noisy, natural = Counter(), Counter()
    pairs = []
    for w, n in rare:
        got = list(sources(w, n))
        for c, e in got:
            noisy[e[1], e[2]] += 1 / len(got)
            pairs.append((w, c, e))
    for w, n in frequent:
        for c, e in sources(w, n / TIMES):
            if count[c] < TIMES * n / 2:
                natural[e[1], e[2]] += 1
    # How many rare words stand beside one established one where the edit is morphology: the middle of all edits.
    ratios = sorted(noisy[e] / n for e, n in natural.items() if n >= 5)
    usual = ratios[len(ratios) // 2] if ratios else 0.0
    edits = {
        e for e, n in noisy.items()
        if n >= (3 if len(e[0]) == len(e[1]) == 1 else 6) and n > 3 * max(usual, 0.02) * natural[e] or n >= 2 and any(c.isdigit() for c in e[0]) and not any(c.isdigit() for c in e[1])
    }
    # A digit inside a word is no letter of it, whatever letter it stands for.
    chosen: dict[str, tuple] = {}
    for w, c, e in pairs:
        if (e[1], e[2]) in edits and (w not in chosen or noisy[e[1], e[2]] * count[c] > chosen[w][0]):
            chosen[w] = (noisy[e[1], e[2]] * count[c], e)
    examples = [(w, operations(w, e)) for w, (_, e) in sorted(chosen.items())]
    examples += [(w, operations(w, None)) for w, _ in frequent[: max(2000, len(examples) // 2)]]
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    ops_at: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edits):
        ops_at[a[:1]].append((a, f"{a}>{b}"))
    step = 1
    order = list(range(len(examples)))
    for epoch in range(epochs):
        order = sorted(order, key=lambda i: hash((i * 2654435761 + epoch * 40503) % 4294967291))
        for x in order:
            w, ops = examples[x]
            for i, op in ops:
                if i >= len(w):
                    continue
                can = [o for a, o in ops_at.get(w[i], ()) if w.startswith(a, i)]
                if not can:
                    continue
                feats = Editor.features(w, i)
                best = max([*can, "keep"], key=lambda o: (sum(weights[f][o] for f in feats), o == "keep"))
                if best != op:
                    for f in feats:
                        for o, d in ((op, 1.0), (best, -1.0)):
                            weights[f][o] += d
                            total[f][o] += step * d
                step += 1
    final = {f: {o: v - total[f][o] / step for o, v in ops.items() if v or total[f][o]} for f, ops in weights.items()}
    return Editor(final, sorted(edits))


def corrections(counts: DataFrame) -> DataFrame:
    """(word, right): misread words and what they should be.

    ``counts`` are the words of the whole collection. The editor, fitted on a bounded sample of them (the FIT_WORDS
    most frequent words and as many of all by hash), proposes every edit above keeping for every word; a proposal stands
    if the collection holds it TIMES as often as the word, and LEAST times at all; of several the one with the greatest
    margin plus logarithm of its frequency. Two edits at two places count for words that no single edit explains.
    """
    sized = counts.filter(F.length("word").between(2, LONGEST_WORD) & ~F.col("word").rlike("^[\\p{N}]"))
    frequent = [tuple(r) for r in sized.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(FIT_WORDS).collect()]
    seldom = counts.filter(F.length("word").between(3, LONGEST_WORD))
    rare = [tuple(r) for r in seldom.orderBy(F.xxhash64("word")).limit(FIT_WORDS).collect()]
    editor = counts.sparkSession.sparkContext.broadcast(_plain(train_editor(frequent, rare)))

    def propose(batches):
        e = Editor(*editor.value)
        for batch in batches:
            pairs = list(zip(*[c.to_pylist() for c in batch.columns]))
            out = [(w, n, p, s, single) for w, n in pairs for single, found in ((True, e.proposals(w)), (False, e.double_proposals(w))) for p, s in found]
            cols = list(zip(*out)) if out else [(), (), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "n", "proposal", "margin", "single"])

    judged = counts.filter(F.length("word").between(2, LONGEST_WORD)).select("word", "n").mapInArrow(propose, "word string, n long, proposal string, margin double, single boolean")
    held = counts.select(F.col("word").alias("right"), F.col("n").alias("m")).filter(F.col("m") >= LEAST)
    return (
        judged.join(held, F.col("proposal") == F.col("right"))
        .filter(F.col("m") >= TIMES * F.col("n"))
        .groupBy("word")
        .agg(F.max_by("right", F.struct("single", (F.col("margin") + F.log("m")).alias("s"), "right")).alias("right"))
    )


def _plain(e: Editor):
    return {f: dict(o) for f, o in e.weights.items()}, e.edits


# ---------------------------------------------------------------------------------------------- divided words

_DIVIDED = f"([\\p{{L}}\\p{{M}}\\p{{N}}]+)([{MARKS_AT_END}])[ \\t\\p{{Z}}]*\\n[ \\t\\p{{Z}}]*([\\p{{L}}\\p{{M}}\\p{{N}}]+)"
_OPEN_END = f"([\\p{{L}}\\p{{M}}\\p{{N}}]+)([{MARKS_AT_END}])[ \\t\\p{{Z}}]*$"


def crossings(rows: DataFrame) -> DataFrame:
    """(element_id, next_id, mark, left, right): last words with a mark, and the first word of the page's next element."""
    ends = rows.filter(F.col("text_raw").rlike(_OPEN_END)).select(
        F.col("element_id").alias("e"), F.col("page_id").alias("pg"), (F.col("element_order") + 1).alias("next"),
        F.regexp_extract("text_raw", _OPEN_END, 2).alias("mark"), F.regexp_extract("text_raw", _OPEN_END, 1).alias("left"),
    )
    begins = rows.select(F.col("element_id").alias("next_id"), "page_id", "element_order", F.regexp_extract("text_raw", "^[\\s\\p{Z}]*([\\p{L}\\p{M}\\p{N}]+)", 1).alias("right")).filter("right <> ''")
    return ends.join(begins, (F.col("pg") == F.col("page_id")) & (F.col("next") == F.col("element_order"))).select(F.col("e").alias("element_id"), "next_id", "mark", "left", "right")


def divisions(rows: DataFrame) -> DataFrame:
    """(element_id, mark, left, right) of the words that may be divided, over a line end or to the page's next element."""
    x = F.lit(_DIVIDED)
    inside = rows.filter(F.col("text_raw").rlike(f"[{MARKS_AT_END}][ \\t\\p{{Z}}]*\\n")).select(
        "element_id",
        F.explode(F.arrays_zip(*[F.regexp_extract_all("text_raw", x, F.lit(i)).alias(c) for i, c in ((2, "mark"), (1, "left"), (3, "right"))])).alias("d"),
    ).select("element_id", "d.mark", "d.left", "d.right")
    across = crossings(rows).drop("next_id")
    cut_off = inside.unionByName(across).distinct()
    return cut_off.select("element_id", "mark", folded(F.col("left")).alias("left"), folded(F.col("right")).alias("right")).filter("left <> '' and right <> ''").distinct()


_PLAIN = ("-", "‐", "‑", "－")
_COUNTS = ("joined", "hyphened", "left", "right")


class Joiner:
    """The perceptron's operation at a mark that ends a line: join the parts, or keep the hyphen as the word's own."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    @staticmethod
    def features(mark: str, left: str, right: str, n: dict[str, int]) -> list[str]:
        j, h, a, b = (min(n[c], 1000).bit_length() for c in _COUNTS)
        plain = "p" if mark in _PLAIN else "o"
        return [
            f"m{mark}", f"{plain}j{j > 0}h{h > 0}", f"d{(j > h) - (j < h)}", f"{plain}l{min(a, 4)}r{min(b, 4)}j{j > 0}h{h > 0}", f"a{a}", f"b{b}", f"{plain}v{min(a, b) >= 3}j{j > 0}h{h > 0}", f"e{left[-2:]}", f"s{right[:2]}", f"x{left[-1:]}{right[:1]}",
            f"n{min(len(left), 8)}", f"k{min(len(right), 8)}", plain,
        ]

    def margin(self, mark: str, left: str, right: str, n: dict[str, int]) -> float:
        """How much the join stands above keeping."""
        return sum(self.weights.get(f, 0.0) for f in self.features(mark, left, right, n))

    def joins(self, mark: str, left: str, right: str, n: dict[str, int]) -> bool:
        """A mark that is no hyphen always divides. Before a join was ever seen, what the collection holds decides."""
        if mark not in _PLAIN:
            return True
        return self.margin(mark, left, right, n) > 0 if self.weights else n["joined"] >= n["hyphened"]


def train_joiner(kinds: list[tuple], words: list[tuple[str, int]] = (), epochs: int = EPOCHS) -> Joiner:
    """Fit the join operation on kinds of line ends (mark, left, right, times, counts of the joined, hyphened, left and
    right forms) and on established words (word, count).

    The collection labels them: a plain hyphen is the word's own where the hyphened form is the more frequent, and a
    division where the joined one is. Each labelled kind is learned twice, once as if it was seen once and neither
    form was held, so that kinds of which the collection holds neither are told by the parts, their letters and lengths. Two established words side
    by side, as many pairs as there are divisions, are kept apart: what is torn leaves pieces, not words."""
    examples = []
    for mark, left, right, times, *n in kinds:
        told = dict(zip(_COUNTS, n))
        if mark in _PLAIN and told["joined"] != told["hyphened"]:
            goal = 1 if told["joined"] > told["hyphened"] else -1
            once = {"joined": 0, "hyphened": 0, "left": told["left"] - times + 1, "right": told["right"] - times + 1}
            examples += [(Joiner.features(mark, left, right, told), goal), (Joiner.features(mark, left, right, once), goal)]
    pairs = list(zip(words, words[1:]))[: sum(goal > 0 for _, goal in examples)]
    examples += [(Joiner.features("-", a, b, {"joined": 0, "hyphened": 0, "left": n, "right": m}), -1) for (a, n), (b, m) in pairs]
    if len({goal for _, goal in examples}) < 2:
        return Joiner({})
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    order = list(range(len(examples)))
    for epoch in range(epochs):
        order = sorted(order, key=lambda i: (i * 2654435761 + epoch * 40503) % 4294967291)
        for x in order:
            feats, goal = examples[x]
            if goal * sum(weights[f] for f in feats) <= 0:
                for f in feats:
                    weights[f] += goal
                    total[f] += step * goal
            step += 1
    return Joiner({f: v - total[f] / step for f, v in weights.items() if v or total[f]})


def divided_words(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(element_id, left, right) of the words that are divided, as the editor's line-join operation has it.

    The operation is fitted on a bounded sample of the kinds of line ends and of words written with a hyphen inside a
    line, and of established words (FIT_JOINS of each, by hash), and judges every kind of line end with the counts of its forms over the whole
    collection. Kinds, not occurrences, meet the counts."""
    found = cut(divisions(rows))
    kinds = found.groupBy("mark", "left", "right").agg(F.count("*").alias("times")).withColumn("inline", F.lit(False))
    two = F.split("word", "-")
    # Two words with a hyphen in the middle of a line say which hyphens are a word's own; its one occurrence is taken off.
    inline = counts.filter(F.col("word").rlike("^[^-'’]+-[^-'’]+$")).select(F.lit("-").alias("mark"), two[0].alias("left"), two[1].alias("right"), F.lit(1).cast("bigint").alias("times"), F.lit(True).alias("inline"))
    kinds = kinds.unionByName(inline.orderBy(F.xxhash64("left", "right")).limit(FIT_JOINS))
    forms = {"joined": F.concat("left", "right"), "hyphened": F.concat_ws("-", "left", "right"), "left": F.col("left"), "right": F.col("right")}
    asked = kinds.select("mark", "left", "right", "times", "inline", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("w")) for k, v in forms.items()])).alias("a")).select("mark", "left", "right", "times", "inline", "a.*")
    known = cut(_form_counts(asked, counts))
    sample = known.orderBy("inline", F.xxhash64("mark", "l", "r")).limit(2 * FIT_JOINS).select("mark", "l", "r", "times", "joined", (F.col("hyphened") - F.col("inline").cast("int")).alias("hyphened"), "left", "right").collect()
    common = [tuple(r) for r in counts.filter((F.col("n") >= LEAST) & F.col("word").rlike("^\\p{L}+$")).orderBy(F.xxhash64("word")).limit(FIT_JOINS).collect()]
    joiner = rows.sparkSession.sparkContext.broadcast(train_joiner([tuple(r) for r in sample], common).weights)

    def judge(batches):
        j = Joiner(joiner.value)
        for batch in batches:
            lines = list(zip(*[c.to_pylist() for c in batch.columns]))
            told = [j.joins(mark, left, right, dict(zip(_COUNTS, n))) for mark, left, right, *n in lines]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(told, pa.bool_())], ["mark", "l", "r", "divided"])

    judged = known.filter("not inline").select("mark", "l", "r", *_COUNTS).mapInArrow(judge, "mark string, l string, r string, divided boolean").filter("divided")
    told = found.join(judged.withColumnRenamed("mark", "m"), (F.col("mark") == F.col("m")) & (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")), "left_semi")
    return told.select("element_id", "left", "right").distinct()


def _form_counts(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(mark, l, r, times, inline, joined, hyphened, left, right): how often the collection holds each form of a kind."""
    told = asked.withColumnsRenamed({"left": "l", "right": "r"}).join(counts, F.col("w") == F.col("word"), "left")
    return told.groupBy("mark", "l", "r", "times", "inline").agg(*[F.coalesce(F.max(F.when(F.col("form") == k, F.col("n"))), F.lit(0)).alias(k) for k in _COUNTS])


# ---------------------------------------------------------------------------------------------- results


def whole_word_counts(counts: DataFrame, broken: DataFrame) -> DataFrame:
    """``counts`` without the parts of divided words, and with the words they are parts of."""
    parts = broken.select(F.explode(F.array(F.struct(F.col("left").alias("w"), F.lit(-1).alias("d")), F.struct(F.col("right").alias("w"), F.lit(-1).alias("d")), F.struct(F.concat("left", "right").alias("w"), F.lit(1).alias("d")))).alias("p"))
    change = parts.groupBy("p.w").agg(F.sum("p.d").alias("d"))
    return counts.join(change, F.col("word") == F.col("w"), "left").select("word", (F.col("n") + F.coalesce(F.col("d"), F.lit(0))).alias("n")).filter("n > 0")


def _noise(df: DataFrame, books: DataFrame):
    rows = elements(df)
    counts = stored(word_counts(rows))
    tops = first_lines(rows)
    found, shifts = number_lines(rows, tops)
    numbers = cut(found)
    headers = cut(header_lines(tops, books, shifts))
    broken = cut(divided_words(rows, counts))
    wrong = cut(corrections(cut(whole_word_counts(counts, broken))))
    # Words outside furniture: a header is a first line; number lines are known by their place.
    skip = numbers.select(F.col("element_id").alias("ne"), "line").groupBy("ne").agg(F.collect_set("line").alias("skip"))
    body = rows.join(headers.select(F.col("element_id").alias("he")), F.col("element_id") == F.col("he"), "left").join(skip, F.col("element_id") == F.col("ne"), "left")
    return rows, headers, numbers, broken, wrong, body


def misread_words(body: DataFrame, wrong: DataFrame, broken: DataFrame) -> DataFrame:
    """(element_id, word, right) of the misread words outside headers and page numbers; parts of divided words are none."""
    maybe = key_filter(wrong, "word")
    lines = F.split(folded(F.col("text_raw")), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~((F.col("he").isNotNull() & (i == 0)) | F.coalesce(F.array_contains("skip", i), F.lit(False)))), "\n")
    words = body.select("element_id", F.explode(F.array_distinct(F.regexp_extract_all(kept, F.lit(WORD), F.lit(0)))).alias("w")).filter(maybe(F.col("w")))
    hit = words.join(wrong, F.col("w") == F.col("word")).select("element_id", "word", "right").distinct()
    parts = broken.select(F.col("element_id").alias("be"), F.explode(F.array("left", "right")).alias("bw")).distinct()
    return hit.join(parts, (F.col("element_id") == F.col("be")) & (F.col("word") == F.col("bw")), "left_anti")


def noise_kinds(df: DataFrame, books: DataFrame) -> DataFrame:
    """(element_id, kind): header, page_number, broken_word and misread, once per element.

    Null texts have no noise; an element delivered twice counts once; empty tables give no row; texts of any length
    are read whole. Elements without page or order have no place and so no header.
    """
    rows, headers, numbers, broken, wrong, body = _noise(df, books)
    parts = [
        headers.select("element_id", F.lit("header").alias("kind")),
        numbers.select("element_id", F.lit("page_number").alias("kind")),
        broken.select("element_id", F.lit("broken_word").alias("kind")),
        misread_words(body, wrong, broken).select("element_id", F.lit("misread").alias("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def repaired_text(text: str, header: bool, skip: list[int], joins: set[tuple[str, str]], fixes: dict[str, str]) -> str:
    """One element's text without furniture, divided words joined, misread ones corrected, in one paragraph."""
    lines = [x for i, x in enumerate(text.split("\n")) if not (i == 0 and header) and i not in skip]
    out = ""
    for line in lines:
        line = line.strip()
        if not line:
            continue
        m = re.search(f"(\\w[\\w{_DROP}]*)[{MARKS_AT_END}]$", out)
        n = re.match(f"\\w[\\w{_DROP}]*", line)
        if m and n:
            if (fold(m[1]), fold(n[0])) in joins:
                out = out[:-1] + line
                continue
            out += line
            continue
        out += (" " if out else "") + line

    def fix(m):
        word = m.group()
        right = fixes.get(fold(word))
        if right is None:
            return word
        # Places of the folded word in the word as written.
        at = [i for i, c in enumerate(word) if fold(c)]
        if len(at) != len(fold(word)):
            return right
        made = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, fold(word), right, autojunk=False).get_opcodes():
            made.append(word[at[i1] : at[i2 - 1] + 1] if op == "equal" else right[j1:j2])
        return "".join(made)

    return _TOKEN.sub(fix, out) if fixes else out


def display_texts(df: DataFrame, books: DataFrame) -> DataFrame:
    """(element_id, text_display): every element's text repaired; null where the raw text is null, empty where only
    furniture or the rest of a divided word is left. An element delivered twice comes once; the second half of a word
    divided to the page's next element is moved to its first half, with the punctuation that follows it."""
    rows, headers, numbers, broken, wrong, body = _noise(df, books)
    pairs = broken.select(F.col("element_id").alias("pe"), F.col("left").alias("pl"), F.col("right").alias("pr"))
    over = crossings(rows).select("element_id", "next_id", folded(F.col("left")).alias("left"), folded(F.col("right")).alias("right"))
    over = over.join(pairs, (F.col("element_id") == F.col("pe")) & (F.col("left") == F.col("pl")) & (F.col("right") == F.col("pr")), "left_semi")
    # Where several elements have one place, one goes with one.
    over = over.groupBy("element_id", "left").agg(F.min(F.struct("next_id", "right")).alias("n")).groupBy("n").agg(F.min(F.struct("element_id", "left")).alias("e"))
    over = cut(over.select("e.element_id", "e.left", "n.next_id", "n.right"))
    halves = broken.unionByName(over.select(F.col("next_id").alias("element_id"), F.col("right").alias("left"), "right"))
    bad = misread_words(body, wrong, halves).groupBy(F.col("element_id").alias("me")).agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    split = broken.groupBy(F.col("element_id").alias("de")).agg(F.collect_set(F.struct("left", "right")).alias("joins"))

    def repair(texts: pd.Series, header: pd.Series, skip: pd.Series, joins: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for t, h, s, j, f in zip(texts, header, skip, joins, fixes):
            pairs = {(x["left"], x["right"]) for x in j} if j is not None else set()
            words = {x["word"]: x["right"] for x in f} if f is not None else {}
            out.append(repaired_text(t, bool(h), list(s) if s is not None else [], pairs, words))
        return pd.Series(out, dtype=object)

    run = F.pandas_udf(repair, "string")
    once = body.dropDuplicates(["element_id"]).join(bad, F.col("element_id") == F.col("me"), "left").join(split, F.col("element_id") == F.col("de"), "left")
    done = stored(once.select("element_id", run("text_raw", F.col("he").isNotNull(), "skip", "joins", "fixes").alias("text_display")))
    moved = carried(done, over)
    ids = df.select("element_id").filter("element_id is not null").distinct()
    told = ids.join(done.withColumnRenamed("element_id", "i"), F.col("element_id") == F.col("i"), "left").join(moved, F.col("element_id") == F.col("m"), "left")
    return told.select("element_id", F.coalesce("text_moved", "text_display").alias("text_display"))


def carried(done: DataFrame, over: DataFrame) -> DataFrame:
    """(m, text_moved): the texts that words divided to the next element change, at both of their ends.

    ``done`` has (element_id, text_display) after repair. A word is moved where both texts still have their half at
    their end and start, so nothing is taken from a text without coming into the other; an element that is nothing but
    the middle of a word divided twice stays."""
    asked = over.select(F.explode(F.array("element_id", "next_id")).alias("element_id"))
    texts = cut(done.filter(key_filter(asked, "element_id")(F.col("element_id"))))
    last, first = f"([\\p{{L}}\\p{{M}}\\p{{N}}]+)[{MARKS_AT_END}]$", "^([\\p{L}\\p{M}\\p{N}]+)"
    a = texts.select(F.col("element_id").alias("ia"), F.col("text_display").alias("ta"))
    b = texts.select(F.col("element_id").alias("ib"), F.col("text_display").alias("tb"))
    met = over.join(a, F.col("element_id") == F.col("ia")).join(b, F.col("next_id") == F.col("ib"))
    met = met.filter(F.endswith(folded(F.regexp_extract("ta", last, 1)), F.col("left")) & F.startswith(folded(F.regexp_extract("tb", first, 1)), F.col("right")))
    twice = over.select(F.col("element_id").alias("o"))
    middle = met.filter(~F.col("tb").rlike("\\s")).join(twice, F.col("next_id") == F.col("o"), "left_semi").select(F.col("next_id").alias("o"))
    met = met.join(middle, F.col("next_id") == F.col("o"), "left_anti")
    met = cut(met.select("element_id", "next_id", F.regexp_extract("tb", "^(\\S+)", 1).alias("half")))
    tails = met.select(F.col("element_id").alias("m"), F.col("half").alias("tail"), F.lit(None).cast("string").alias("head"))
    heads = met.select(F.col("next_id").alias("m"), F.lit(None).cast("string").alias("tail"), F.col("half").alias("head"))
    change = tails.unionByName(heads).groupBy("m").agg(F.max("tail").alias("tail"), F.max("head").alias("head"))
    x = texts.join(change, F.col("element_id") == F.col("m"))
    rest = F.when(F.col("head").isNull(), F.col("text_display")).otherwise(F.ltrim(F.expr("substring(text_display, length(head) + 1)")))
    return x.select("m", F.when(F.col("tail").isNull(), rest).otherwise(F.concat(F.regexp_replace(rest, f"[{MARKS_AT_END}]$", ""), F.col("tail"))).alias("text_moved"))
