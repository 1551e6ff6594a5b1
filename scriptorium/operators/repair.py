"""Words torn apart by recognition: joined again by the collection's own lexicon, text by text and pass by pass.

Which neighbours join depends on the two pieces and the lexicon alone, so it is decided once for each distinct pair, in
equi-joins with the word counts; only the texts that hold such a pair are then read from left to right, in Arrow
batches, each with its own few pairs. The lexicon is never shipped to the tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import arabic
from scriptorium.operators import structure
from scriptorium.runtime import cut, stored

# ------------------------------------------------------------------ fixed values
LONE_MARKS = ["،", ",", ".", ":", ";", "؛", "-", "ـ"]
STANDALONE = "و ا أ ف ب ل ك ي ء م ه".split()
NEVER_REPAIRED = "عنه عنها عنهم التي الذي هذا هذه ذلك".split()
TWO_LETTER_WORDS = "من في عن ما لا ان به له هو هي قد بن كل لم لن يا ثم مع او اي".split()
WORD_OPENERS = "وفبلكأإآء"
SHORT, LEAST, LEAST_LETTERS = 3, 3, 4
# ------------------------------------------------------------------

_TORN = re.compile(r"([ء-ي][ً-ْٰ])\s+([ء-ي]{1,2})(?=\s|$|[^ء-ي])")
_NO_LETTERS = re.compile("[\u064B-\u065F\u0670\u0640]")
_ONLY_LETTERS = re.compile("[\u0621-\u065F\u0670\u0671]+")
_KEYS = str.maketrans("آأإٱىةؤئ", "اااايهوي")  # with _NO_LETTERS, arabic.lexicon_key of a word of Arabic letters


def join_after_mark(text: str) -> tuple[str, int]:
    """A text whose one or two letters torn off behind a vowel mark are put back, and how many were. Two letters that are
    a word, or begin as a word does, stay."""
    if not text:
        return text or "", 0

    def join(m):
        tail = m[2]
        keep = tail in TWO_LETTER_WORDS or len(tail) > 1 and tail[0] in WORD_OPENERS
        return m[0] if keep else m[1] + tail

    out = _TORN.sub(join, text)
    return out, max(len(text.split()) - len(out.split()), 0)


def _piece(word: str) -> int:
    """Whether a word may be a piece: 0 if it is protected or has other characters than Arabic letters and marks, 2 if its
    lexicon key is short, else 1."""
    key = _NO_LETTERS.sub("", word).translate(_KEYS)
    return 0 if not _ONLY_LETTERS.fullmatch(word) or key in structure.PROTECTED else 2 if len(key) <= SHORT else 1


def _candidates(texts: DataFrame, id: str) -> DataFrame:
    """(id, left, right, apart) of neighbours, and of words with a lone mark between them, that may be one word: Arabic
    letters, neither a protected word, one short.

    Each distinct word of a batch is looked at once; the pairs are then found by the words' numbers, so no word is matched
    at its every occurrence."""
    kind = T.StructType([texts.schema[id]]).add("left", "string").add("right", "string").add("apart", "boolean")

    def find(batches):
        for b in batches:
            lists = b.column("tokens")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            coded = pc.fill_null(lists.flatten(), "").dictionary_encode()
            code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            kinds = np.fromiter((_piece(w) for w in words.to_pylist()), "int8", len(words))[code]
            mark = pc.is_in(words, pa.array(LONE_MARKS)).to_numpy(zero_copy_only=False)[code]
            for gap in (1, 2):
                n = max(len(code) - gap, 0)
                met = (row[:n] == row[gap:]) & (kinds[:n] > 0) & (kinds[gap:] > 0) & ((kinds[:n] == 2) | (kinds[gap:] == 2))
                at = np.flatnonzero(met & mark[1 : n + 1] if gap == 2 else met)
                yield pa.RecordBatch.from_arrays(
                    [b.column(id).take(pa.array(row[at])), words.take(pa.array(code[at])), words.take(pa.array(code[at + gap])), pa.array(np.full(len(at), gap == 2))], names=kind.names
                )

    return texts.select(id, "tokens").mapInArrow(find, kind)


def _counted(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct pairs with the lexicon's counts of the joined word (n_whole) and of the shorter piece (n_short)."""
    key = arabic.lexicon_key
    short = F.when(F.length(key(F.col("left"))) <= F.length(key(F.col("right"))), key(F.col("left"))).otherwise(key(F.col("right")))
    kinds = pairs.select("left", "right", "apart").distinct()
    kinds = stored(kinds).select("left", "right", "apart", F.concat(key(F.col("left")), key(F.col("right"))).alias("whole"), short.alias("short"))
    a, b = (lexicon.select(F.col("word").alias(f"w{x}"), F.col("frequency").alias(f"f{x}")) for x in "ab")
    return kinds.join(a, F.col("whole") == F.col("wa"), "left").join(b, F.col("short") == F.col("wb"), "left").select(
        "left", "right", "apart", "whole", "short", F.coalesce("fa", F.lit(0)).alias("n_whole"), F.coalesce("fb", F.lit(0)).alias("n_short")
    )


def corrector_rule(least: int = LEAST) -> Column:
    """Pairs the corrector joins: the whole is a word; where no mark stands between, the short piece must be none: no
    letter that stands alone (but the article's alef before lam), no word of the lexicon."""
    article = (F.col("short") == "ا") & F.col("whole").startswith("ال")
    single = article | ~F.col("short").isin(STANDALONE)
    alone = F.when(F.length("short") == 1, single).otherwise(F.col("n_short") < least)
    return (F.length("whole") >= 3) & (F.col("n_whole") >= least) & (F.col("apart") | alone)


def vocabulary_rule(least: int = LEAST) -> Column:
    """Pairs the vocabulary repair joins: the whole has four letters and is held; a short piece twenty times as frequent
    only where the whole is held three times as often as needed."""
    swamped = (F.length("short") >= 2) & (F.col("n_short") > F.col("n_whole") * 20)
    free = ~F.col("left").isin(NEVER_REPAIRED) & ~F.col("right").isin(NEVER_REPAIRED)
    return free & (F.length("whole") >= LEAST_LETTERS) & (F.col("n_whole") >= least) & (~swamped | (F.col("n_whole") >= least * 3))


def scan(tokens: list[str], joins: set[tuple], apart_first: bool) -> tuple[list[str], list[str]]:
    """The words after joining from left to right, each piece used once, and what was joined."""
    out, made, i = [], [], 0
    while i < len(tokens):
        tries = [(2, False), (3, True)]
        for size, apart in reversed(tries) if apart_first else tries:
            if i + size <= len(tokens) and (not apart or tokens[i + 1] in LONE_MARKS) and (tokens[i], tokens[i + size - 1], apart) in joins:
                out.append(tokens[i] + tokens[i + size - 1])
                made.append(" ".join(tokens[i : i + size]) + " -> " + out[-1])
                i += size
                break
        else:
            out.append(tokens[i])
            i += 1
    return out, made


def joined_words(texts: DataFrame, lexicon: DataFrame, rule: Column, apart_first: bool, id: str = "element_id") -> DataFrame:
    """(id, tokens, made): the texts (id, tokens) with their torn words joined by ``rule``, and what was joined.

    Texts without a joinable pair pass as they are. The lexicon is (word, frequency), words as lexicon keys. Ids are unique;
    a null or empty token list joins nothing."""
    # Written, since they are read twice, and since filters inferred from the joins would make every occurrence's key anew.
    pairs, lexicon = stored(_candidates(texts, id)), stored(lexicon.select("word", "frequency"))
    allowed = stored(_counted(pairs, lexicon).filter(rule).select(F.col("left").alias("l"), F.col("right").alias("r"), F.col("apart").alias("a")))
    mine = pairs.join(allowed, (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")) & (F.col("apart") == F.col("a")), "left_semi")
    mine = mine.groupBy(F.col(id).alias("__i")).agg(F.collect_set(F.struct("left", "right", "apart")).alias("joins"))  # no more than the text's words
    kind = T.StructType([texts.schema[id]]).add("tokens", T.ArrayType(T.StringType())).add("made", T.ArrayType(T.StringType()))

    def read(batches):
        for b in batches:
            strings = b.column("tokens").type
            form = pa.schema([(id, b.column(id).type), ("tokens", strings), ("made", strings)])
            torn = b.column("joins").is_valid()
            rest, b = b.filter(pc.invert(torn)), b.filter(torn)
            yield pa.RecordBatch.from_arrays([rest.column(id), rest.column("tokens"), pa.array([[]] * len(rest), strings)], schema=form)
            got = [scan(t, {(j["left"], j["right"], j["apart"]) for j in js}, apart_first) for t, js in zip(b.column("tokens").to_pylist(), b.column("joins").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array([g[0] for g in got], strings), pa.array([g[1] for g in got], strings)], schema=form)

    return texts.join(mine, F.col(id) == F.col("__i"), "left").select(id, "tokens", "joins").mapInArrow(read, kind)


def lexicon_of(texts: DataFrame) -> DataFrame:
    """(word, frequency) of (id, tokens), words as lexicon keys."""
    return texts.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).groupBy(arabic.lexicon_key(F.col("t")).alias("word")).agg(F.sum("n").alias("frequency"))


def corrected_texts(df: DataFrame, lexicon: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text, stretched, ligatures, merged): each text corrected: stretch out, blanks collapsed, ligatures put right,
    letters behind vowel marks and torn words joined. A null text is empty; counts say what was done."""
    after = F.pandas_udf(lambda s: pd.DataFrame([join_after_mark(t) for t in s], columns=["text", "n"]), "text string, n int")
    step = df.select(id, structure.remove_stretch(F.col(text)).alias("s"))
    step = step.select(id, F.col("s.removed").alias("stretched"), structure.fix_ligatures(arabic.collapse(F.col("s.text"))).alias("l"))
    torn = "[\\u0621-\\u064A][\\u064B-\\u0652\\u0670]\\s+[\\u0621-\\u064A]"
    step = step.select(id, "stretched", F.col("l.fixed").alias("ligatures"), F.col("l.text").alias("t"))
    odd = step.filter(F.col("t").rlike(torn)).select(id, "stretched", "ligatures", after("t").alias("a")).select(id, "stretched", "ligatures", F.col("a.text").alias("t"), F.col("a.n").alias("n"))
    step = cut(odd.unionByName(step.filter(~F.col("t").rlike(torn)).select(id, "stretched", "ligatures", "t", F.lit(0).alias("n"))))
    joined = joined_words(step.select(id, F.split("t", " ").alias("tokens")), lexicon, corrector_rule(), True, id)
    j = joined.select(F.col(id).alias("__j"), F.array_join("tokens", " ").alias("text"), F.size("made").alias("m"))
    return step.join(j, F.col(id) == F.col("__j")).select(id, "text", "stretched", "ligatures", (F.col("n") + F.col("m")).alias("merged"))


def repaired_texts(texts: DataFrame, passes: int = 3, id: str = "element_id") -> tuple[DataFrame, DataFrame]:
    """(id, tokens) after up to ``passes`` passes, each with a lexicon counted anew, and (pass, pattern, times) of what
    was joined. Stops at a pass that joins nothing; lineage is cut between passes."""
    made, current = None, stored(texts.select(id, "tokens"))
    for number in range(1, passes + 1):
        current = stored(joined_words(current.select(id, "tokens"), lexicon_of(current), vocabulary_rule(), False, id))
        here = current.select(F.lit(number).alias("pass"), F.explode("made").alias("pattern")).groupBy("pass", "pattern").agg(F.count("*").alias("times"))
        made = here if made is None else made.unionByName(here)
        if not current.filter(F.size("made") > 0).limit(1).count():
            break
    return current.select(id, "tokens"), made


def top_patterns(made: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` commonest joins of all passes; equal ones by pattern."""
    return made.groupBy("pattern").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "pattern").limit(k)
