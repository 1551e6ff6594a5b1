"""Language of each document and of each stretch of one language, with a confidence.

Hierarchical discrimination: a linear support vector machine first decides the language family of each part of a text,
by the best path over its words with a cost for each change of family. Within a part only the machines of its family
are asked, one for each two of its languages, and the best path over their duels gives the stretches. The machines are
linear in the words, so a word's scores are computed once per worker and a stretch's are sums.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = {"arabic": ("ar", "fa", "ur"), "latin": ("en", "fr", "tr")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
PAIRS = tuple((f[i], f[j]) for f in FAMILIES.values() for i in range(3) for j in range(i + 1, 3))
# Other notations of the languages.
NOTATIONS = {
    "ar": "ara arabic arb العربية", "fa": "fas per persian farsi فارسی", "ur": "urd urdu اردو",
    "en": "eng english", "fr": "fra fre french français", "tr": "tur turkish türkçe",
}

#: Hashed features of a word: its letters, pairs and triples of letters, and itself.
FEATURES = 1 << 17
#: Labelled documents per language that the machines are fitted on, characters of each of them, and words per training
#: piece. The bounds are for fitting alone; every text is judged whole.
FIT_DOCUMENTS = 700
FIT_CHARACTERS = 20_000
PIECE = 16
#: Words of a stretch that counts, cost of a change of language, and bound of a word's score.
STRETCH = 12
CHANGE = 6.0
BOUND = 2.5
#: Words kept in a worker's table before it is started afresh.
MAX_WORDS = 1_000_000


def language_of(label: Column) -> Column:
    """A label as one of the language codes: any case, region, three letters or name; null where it says none.
    A label of another language is kept as it is, so that it differs from every code."""
    key = F.lower(F.regexp_replace(label, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    main = F.regexp_extract(key, "^[^-_]*", 0)
    known = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        known = F.when(main.isin(code, *names.split()), code).otherwise(known)
    return F.when(main.isin("", "und", "unknown", "mul", "zxx", "none", "null"), None).otherwise(F.coalesce(known, main))


class _Letters(dict):
    """Character table: letters in lower case with the keyboards' twins as one, marks dropped, the rest a blank."""

    def __missing__(self, cp: int):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "L" and cp != 0x640:
            low = {"İ": "i", "ی": "ي", "ک": "ك"}.get(c) or c.lower()
        elif kind in ("Mn", "Cf", "Me") or cp == 0x640:
            low = None if cp < 0x300 or cp > 0x36F else c
        else:
            low = c if kind[0] == "M" else " "
        self[cp] = low
        return low


_LETTERS = _Letters()


def words_of(text: str) -> list[str]:
    """The words of a text that hold letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.translate(_LETTERS).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, end of each word's)."""
    padded = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(cp)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, of = [], []
    h = np.zeros(len(cp), np.uint64)
    for n in (1, 2, 3):
        step = np.zeros(len(cp), np.uint64)
        step[: len(cp) - n + 1] = cp[n - 1 :]
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(n))
        ok = at + n <= np.repeat(sizes, sizes)
        if n == 1:
            ok &= (at > 0) & (at < np.repeat(sizes, sizes) - 1)
        out.append(h[ok] + np.uint64(n))
        of.append(word[ok])
    whole = np.add.reduceat(_mix(cp * np.uint64(0xD6E8FEB86659FD93) + at.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), np.cumsum(sizes) - sizes) if len(words) else h
    out.append(_mix(whole))
    of.append(np.arange(len(words)))
    f, w = np.concatenate(out) % np.uint64(FEATURES), np.concatenate(of)
    o = np.argsort(w, kind="stable")
    return f[o].astype(np.int64), np.cumsum(np.bincount(w, minlength=len(words)))


class Bag:
    """Features of distinct words as one sparse matrix; each word's row has length 1."""

    def __init__(self, words: list[str]):
        self.f, ends = features(words)
        self.n = np.diff(np.r_[0, ends])
        self.word = np.repeat(np.arange(len(words)), self.n)
        self.value = np.repeat(1 / np.sqrt(self.n), self.n)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Word by machine."""
        if not len(self.n):
            return np.zeros((0, weights.shape[1]), np.float32)
        got = weights[self.f]
        got *= self.value[:, None].astype(np.float32)
        return np.add.reduceat(got, np.cumsum(self.n) - self.n, axis=0)


def fit(texts: list[str], labels: list[str], rounds: int = 2, epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (feature by machine: the family's, then one for each pair) from labelled texts, some labelled wrongly.

    Texts are cut into pieces of PIECE words; after the first round pieces whose label another language beats clearly
    are left out, which removes wrong labels and stretches of other languages. Averaged subgradient steps on the
    hinge loss; the same input gives the same weights.
    """
    number: dict[str, int] = {}
    pieces, told = [], []
    for t, label in zip(texts, labels):
        w = [number.setdefault(x, len(number)) for x in words_of(t)]
        for i in range(0, max(len(w) - PIECE // 2, min(len(w), 1)), PIECE):
            pieces.append(np.array(w[i : i + PIECE]))
            told.append(LANGUAGES.index(label))
    machines = 1 + len(PAIRS)
    weights = np.zeros((FEATURES, machines), np.float32)
    if not pieces:
        return weights
    bag, told = Bag(list(number)), np.array(told)
    word = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    share = 1 / np.bincount(piece)
    family = np.array([i // 3 for i in range(6)])[told]
    goals = [np.where(family == 0, 1, -1)] + [np.where(told == LANGUAGES.index(a), 1, np.where(told == LANGUAGES.index(b), -1, 0)) for a, b in PAIRS]
    starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
    word_starts = np.r_[0, np.cumsum(bag.n)]
    kept = np.ones(len(pieces), bool)
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        for m, goal in enumerate(goals):
            w, total, steps = np.zeros(FEATURES), np.zeros(FEATURES), 0
            mine = np.flatnonzero(kept & (goal != 0))
            for e in range(epochs):
                rng.shuffle(mine)
                for i in range(0, len(mine), 128):
                    take = mine[i : i + 128]
                    idx = _ranges(starts[take], starts[take + 1])
                    row = np.repeat(np.arange(len(take)), starts[take + 1] - starts[take])
                    fi = _ranges(word_starts[word[idx]], word_starts[word[idx] + 1])
                    fr = np.repeat(row, bag.n[word[idx]])
                    f, v = bag.f[fi], bag.value[fi] * share[take][fr]
                    margin = np.bincount(fr, v * w[f], len(take)) * goal[take]
                    wrong = margin < 1
                    rate = 1.0 / (1 + 0.02 * steps)
                    if wrong.any():
                        use = wrong[fr]
                        w += rate * np.bincount(f[use], v[use] * goal[take][fr[use]], FEATURES) * 0.25
                    w *= 1 - 1e-3 * rate
                    steps += 1
                    if e:
                        total += w
            weights[:, m] = total / max(1, steps * (epochs - 1) / epochs)
        machines_of = bag.scores(weights)
        by_language = np.repeat(family_scores(machines_of), 3, axis=1) + duel_scores(machines_of)
        mean = np.stack([np.bincount(piece, by_language[word, k], len(pieces)) for k in range(6)], 1) * share[:, None]
        own = mean[np.arange(len(pieces)), told]
        kept = own >= mean.max(1) - 0.3
    return weights


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, b), one after the other."""
    n = b - a
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - n), n)


def family_scores(machines: np.ndarray) -> np.ndarray:
    """Word by family, from word by machine."""
    fam = np.clip(machines[:, 0], -BOUND, BOUND)
    return np.stack([fam, -fam], 1).astype(np.float32)


def duel_scores(machines: np.ndarray) -> np.ndarray:
    """Word by language, from word by machine: the mean of the language's duels within its family."""
    out = np.zeros((len(machines), 6), np.float32)
    for m, (a, b) in enumerate(PAIRS, 1):
        duel = np.clip(machines[:, m], -BOUND, BOUND) / 2
        out[:, LANGUAGES.index(a)] += duel
        out[:, LANGUAGES.index(b)] -= duel
    return out


def best_paths(score: np.ndarray, sizes: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The state of each word on the best path of its text, given word by state; ``change`` is a change's cost. Texts
    go on side by side, the longest first."""
    n, states, starts = len(score), score.shape[1], np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # texts longer than t
    came = np.zeros((n, states), np.int8)
    value = np.zeros((len(order), states), np.float32)
    stay = np.arange(states, dtype=np.int8)
    last = np.zeros(len(order), np.int8)
    for t in range(longest):
        k = active[t]
        v, at = value[:k], first[:k] + t
        if t:
            top = v.argmax(1)
            best = v[np.arange(k), top] - change
            moved = best[:, None] > v
            came[at] = np.where(moved, top[:, None], stay)
            v = np.where(moved, best[:, None], v)
        value[:k] = v + score[at]
    state = value.argmax(1).astype(np.int8)
    path = np.zeros(n, np.int8)
    last[:] = state
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        path[at] = last[:k]
        last[:k] = came[at, last[:k]]
    return path


class Identifier:
    """Texts to stretches; words seen before are looked up."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, int] = {}
        self.families, self.duels = np.zeros((0, 2), np.float32), np.zeros((0, 6), np.float32)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = words_of(t)
                sizes[i] = len(w)
                words += w
        if len(self.known) > MAX_WORDS:
            self.known, self.families, self.duels = {}, self.families[:0], self.duels[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            machines = Bag(new).scores(self.weights)
            self.families = np.concatenate([self.families, family_scores(machines)])
            self.duels = np.concatenate([self.duels, duel_scores(machines)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), sizes

    def paths(self, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language of each word: its part's family first, then the best of the family's languages."""
        family = best_paths(self.families[number], sizes)
        if not len(family):
            return family
        text = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (text[1:] != text[:-1])])
        duels = self.duels[number]
        own = np.where(family[:, None] == 0, duels[:, :3], duels[:, 3:])
        return family * 3 + best_paths(own, np.diff(np.r_[begins, len(family)]))

    def stretches(self, texts: list[str | None]):
        """(text, language, first word, words, confidence) of each stretch, in order, as arrays."""
        number, sizes = self.numbers(texts)
        path = self.paths(number, sizes)
        text = np.repeat(np.arange(len(texts)), sizes)
        if not len(path):
            z = np.zeros(0, np.int64)
            return z, z, z, z, np.zeros(0)
        begins = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])])
        # Short pieces between two of one language belong to it: a quotation doesn't end a stretch.
        t, lang = text[begins].tolist(), path[begins].tolist()
        size = np.diff(np.r_[begins, len(path)]).tolist()
        runs: list[list[int]] = []
        for i in range(len(t)):
            run = [t[i], lang[i], int(begins[i]), size[i]]
            if len(runs) > 1 and runs[-1][0] == run[0] == runs[-2][0] and runs[-2][1] == run[1] and runs[-1][3] < STRETCH:
                quote = runs.pop()
                runs[-1][3] += quote[3] + run[3]
            elif runs and runs[-1][0] == run[0] and runs[-1][1] == run[1]:
                runs[-1][3] += run[3]
            else:
                runs.append(run)
        t, lang, begin, size = (np.array(x, np.int64) for x in zip(*runs))
        score = np.repeat(self.families[number], 3, axis=1) + self.duels[number]
        of = np.repeat(np.arange(len(t)), size)
        mean = np.stack([np.bincount(of, score[:, k], len(t)) for k in range(6)], 1) / size[:, None]
        own = mean[np.arange(len(t)), lang]
        mean[np.arange(len(t)), lang] = -np.inf
        surplus = (own - mean.max(1)) * np.sqrt(np.minimum(size, 100))
        starts = np.cumsum(sizes) - sizes
        return t, lang, begin - starts[t], size, 1 / (1 + np.exp(-np.clip(surplus, -30, 30)))


def labelled_sample(df: DataFrame, id: str, text: str, label: str, per_language: int = FIT_DOCUMENTS) -> list:
    """At most ``per_language`` labelled texts of each language, the first by a hash of the id: what fitting may use."""
    rows = df.select(F.xxhash64(id).alias("h"), F.substring(text, 1, FIT_CHARACTERS).alias("t"), language_of(F.col(label)).alias("l")).filter(F.col("l").isin(*LANGUAGES) & (F.length("t") > 60))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= per_language)
    return rows.select("t", "l").collect()


def _identifier(weights: np.ndarray, name: str) -> Identifier:
    kept = sys.__dict__.setdefault("_scriptorium_languages", {})
    if name not in kept:
        kept.clear()
        kept[name] = Identifier(weights)
    return kept[name]


def stretches(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(id, told, main, mixed, parts): of each text with words the language its label says (null where none), the
    language of most of its words, whether two languages or more hold a stretch of STRETCH words, and its stretches
    (language, first word, words, confidence) in order.

    Machines are fitted on a bounded sample of this table's labelled texts; every text is then judged whole, in one
    pass without a shuffle. Null and empty texts and texts without letters do not appear; repeated rows and null ids
    are kept. Without any labelled text all words score alike and everything is the first language, confidence 0.5.
    """
    sample = labelled_sample(df, id, text, label)
    weights = df.sparkSession.sparkContext.broadcast(fit([r[0] for r in sample], [r[1] for r in sample]))
    name = str(weights._jbroadcast.id()) if weights._jbroadcast is not None else str(id)
    name = f"{df.sparkSession.sparkContext.applicationId}-{name}"
    part = pa.struct([("language", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("confidence", pa.float64())])
    codes = np.array(LANGUAGES, object)

    def run(batches):
        who = _identifier(weights.value, name)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            t, lang, first, size, sure = who.stretches(texts)
            words = np.zeros((len(texts), 6), np.int64)
            np.add.at(words, (t, lang), size)
            long = np.zeros((len(texts), 6), bool)
            long[t[size >= STRETCH], lang[size >= STRETCH]] = True
            has = np.flatnonzero(words.sum(1) > 0)
            offsets = np.r_[0, np.cumsum(np.bincount(t, minlength=len(texts))[has])].astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(codes[lang], pa.string()), pa.array(first), pa.array(size), pa.array(np.round(sure, 4))], fields=list(part))
            took = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), pa.array(codes[words[has].argmax(1)], pa.string()), pa.array(long[has].sum(1) > 1), pa.ListArray.from_arrays(pa.array(offsets), parts)],
                [id, "told", "main", "mixed", "parts"],
            )

    kind = df.schema[id].dataType.simpleString()
    rows = df.select(id, language_of(F.col(label)).alias("told"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{id}` {kind}, told string, main string, mixed boolean, parts array<struct<language:string,first_word:bigint,words:bigint,confidence:double>>")


def corrected_labels(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(id, language): of each text whose label is missing or not its main language, and of each that mixes languages,
    its main language and every language that holds a stretch of STRETCH words."""
    rows = stretches(df, id, text, label).filter(F.col("mixed") | F.col("told").isNull() | (F.col("told") != F.col("main")))
    held = F.transform(F.filter("parts", lambda p: p["words"] >= STRETCH), lambda p: p["language"])
    return rows.select(id, F.explode(F.array_distinct(F.concat(F.array("main"), held))).alias("language")).distinct()
