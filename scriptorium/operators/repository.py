"""Reading and changing tables as a store does: rows by key, pages, listings of a parent's children, deletes, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row in order; none of an empty table. A top-1, not a sort."""
    return df.orderBy(*order).limit(1)


def where_equal(df: DataFrame, order: list[str] | None = None, **values) -> DataFrame:
    """Rows whose columns have the values; a value of None asks for null. Reaches the scan as a pushed filter."""
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()), F.lit(True))
    found = df.filter(cond)
    return found.orderBy(*order) if order else found


def holds(column: str, part: str) -> Column:
    """Whether a text holds a part, whatever the case. Wildcards in the part work as such."""
    return F.col(column).ilike(f"%{part}%")


def exists(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, found) of each wanted key, in one semi-join instead of a lookup for each."""
    asked = wanted.select(F.col(key).alias("__w")).distinct()
    held = df.select(F.col(key).alias("__h")).distinct()
    return asked.join(held, F.col("__w").eqNullSafe(F.col("__h")), "left").select(F.col("__w").alias(key), F.col("__h").isNotNull().alias("found"))


def delete(df: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, (deleted) how many rows go) when the keys of ``doomed`` are deleted; unknown keys delete nothing."""
    k = doomed.select(F.col(key).alias("__k")).distinct()
    stays = df.join(k, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    gone = df.join(k, F.col(key).eqNullSafe(F.col("__k")), "left_semi").agg(F.count("*").alias("deleted"))
    return stays, gone


def children(df: DataFrame, parent: str, order: list[str], parents: DataFrame) -> DataFrame:
    """The children of each wanted parent with their place: (…, place), in one semi-join and one ordered window."""
    wanted = parents.select(F.col(parent).alias("__p")).distinct()
    mine = df.join(wanted, F.col(parent) == F.col("__p"), "left_semi")
    return mine.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def below_ancestor(levels: list[tuple[DataFrame, str, str]], ancestor: Column) -> DataFrame:
    """Rows of the lowest table whose topmost ancestor passes ``ancestor``. ``levels`` go from the top down: (table, its
    key, the column of the next table that refers to it); the last one's key is its own. The filter is on the smallest
    table, and each step is a semi-join, so no ancestor's columns travel down."""
    table, key, _ = levels[0]
    kept = table.filter(ancestor)
    for (_, k, ref), (lower, _, _) in zip(levels, levels[1:]):
        ids = kept.select(F.col(k).alias("__k")).distinct()
        kept = lower.join(ids, F.col(ref) == F.col("__k"), "left_semi")
    return kept


def bridged(left: DataFrame, left_key: str, bridge: DataFrame, right: DataFrame, right_key: str, names: str) -> DataFrame:
    """``left`` with ``names`` of the rows that a bridge table (left_key, right_key) joins it to, sorted, distinct; an
    empty list where it joins none. Both joins are equi-joins, and what is gathered is one row's partners."""
    r = right.select(F.col(right_key).alias("__r"), F.col(names).alias("__n"))
    met = bridge.select(F.col(left_key).alias("__l"), F.col(right_key).alias("__b")).join(r, F.col("__b") == F.col("__r"))
    got = met.groupBy("__l").agg(F.array_sort(F.collect_set("__n")).alias(names))
    return left.join(got, F.col(left_key) == F.col("__l"), "left").drop("__l").withColumn(names, F.coalesce(names, F.array().cast("array<string>")))


def imported(pages: DataFrame, document: str, text: str, template: str = "pages/{id}/{page}.png", dpi: int = 300) -> dict[str, DataFrame]:
    """books, editions, volumes, pages, elements and images made of documents' pages (document, page_number, text): one
    edition and volume per document, each line block an element of type text, each page an image by the template."""
    books = pages.select(F.col(document).alias("book")).distinct()
    p = pages.select(F.col(document).alias("book"), "page_number", F.col(text).alias("text")).withColumn("page", F.sha1(F.concat_ws("/", F.col("book").cast("string"), F.col("page_number").cast("string"))))
    blocks = p.select("page", F.posexplode(F.split("text", "\n[ \t]*\n")).alias("i", "block")).filter(F.btrim("block") != "")
    blocks = blocks.withColumn("element_order", F.row_number().over(Window.partitionBy("page").orderBy("i")))
    where = F.lit(template)
    for name, c in (("{id}", F.col("book").cast("string")), ("{page}", F.col("page_number").cast("string"))):
        where = F.replace(where, F.lit(name), c)
    return {
        "books": books, "editions": books.select(F.col("book").alias("edition"), "book"), "volumes": books.select(F.col("book").alias("volume"), F.col("book").alias("edition"), F.lit(1).alias("volume_number")),
        "pages": p.select("page", F.col("book").alias("volume"), "page_number"), "elements": blocks.select("page", "element_order", F.lit("text").alias("element_type"), F.col("block").alias("text_raw")),
        "images": p.select("page", where.alias("path"), F.lit(dpi).alias("dpi")),
    }


def pick(df: DataFrame, seed: int, k: int, key: str) -> DataFrame:
    """``k`` rows at random: the first by a seeded hash of the key, the same on any cluster and for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def summary(df: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """(group, rows, each flag's count)."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in flags.items()])
