"""What is extracted from the texts of pages or documents: figures, blocks, words, links, headings; all from one input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import arabic

# ------------------------------------------------------------------ fixed values: patterns
LINK = "https?://[^\\s<>\"'،]+"
HEADING = "^[0-9\\u0660-\\u0669]+\\s*[ـ\\-–]\\s*(?:باب|أبواب|ابواب|كتاب)[^\\n]*"
LEVELS = {"كتاب": 1, "أبواب": 2, "ابواب": 2, "باب": 3}
# ------------------------------------------------------------------


def figures(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, characters, words, lines) of each text; a null or empty one has none of each."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, arabic.SPACES), lambda w: w != "")
    return df.select(id, F.length(t).alias("characters"), F.size(words).alias("words"), F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).alias("lines"))


def blocks(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block_order from 1, block): what blank lines divide."""
    parts = F.filter(F.split(text, "\n[ \t]*\n"), lambda b: F.btrim(b) != "")
    return df.select(id, F.posexplode(parts).alias("i", "block")).select(id, (F.col("i") + 1).alias("block_order"), "block")


def words(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, word_order from 1, word)."""
    parts = F.filter(F.split(text, arabic.SPACES), lambda w: w != "")
    return df.select(id, F.posexplode(parts).alias("i", "word")).select(id, (F.col("i") + 1).alias("word_order"), "word")


def links(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, link_order from 1, url)."""
    found = F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(0))
    return df.select(id, F.posexplode(found).alias("i", "url")).select(id, (F.col("i") + 1).alias("link_order"), "url")


def contents(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, level, title): headings, of which a book's stand above chapters'."""
    title = F.regexp_replace(F.regexp_extract(F.col(text), f"({HEADING})", 1), "^[0-9\\u0660-\\u0669]+\\s*[ـ\\-–]\\s*", "")
    level = F.lit(None).cast("int")
    for word, n in reversed(LEVELS.items()):
        level = F.when(F.startswith("title", F.lit(word)), n).otherwise(level)
    return df.select(id, title.alias("title")).filter("title <> ''").select(id, level.alias("level"), arabic.collapse(F.col("title")).alias("title"))


def extracted(df: DataFrame, id: str, text: str) -> dict[str, DataFrame]:
    """Every extractor over one input."""
    return {f.__name__: f(df, id, text) for f in (figures, blocks, words, links, contents)}
