"""Files in and out: learned artefacts, golden questions, plain texts, graphs and rankers, vector tables, audit logs.

Everything is a Spark source or sink; paths may lie on any file system the cluster reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_entries(df: DataFrame, path: str) -> None:
    """Learned entries as JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


def load_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Learned entries; lines that are no JSON or don't fit are left out, a folder without any gives no row."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    # The record of a bad line is asked for beside the columns, which Spark allows on rows that are kept.
    names = [c for c in rows.columns if c != "_corrupt_record"]
    whole = rows.select(*names, F.col("_corrupt_record").alias("bad")).filter(F.col("bad").isNull()).select(*names)
    return whole.filter(F.greatest(*[F.col(c).isNotNull() for c in names])) if len(names) > 1 else whole.filter(F.col(names[0]).isNotNull())


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, intent, relevant_element_ids, must_contain, must_not_contain) of golden questions in JSON lines; blank
    lines, lines that begin with // and lines that are no JSON are left out."""
    schema = "id string, query string, intent string, relevant_element_ids array<string>, must_contain array<string>, must_not_contain array<string>"
    lines = spark.read.text(path).select(F.btrim("value").alias("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("//")))
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*").filter("query is not null")


def next_golden_id(golden: DataFrame) -> DataFrame:
    """(id): the next free id qNNN."""
    n = F.regexp_extract("id", "^q([0-9]+)$", 1).try_cast("int")
    return golden.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit("q"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("id"))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole; bytes that are no UTF-8 are left out. An EPUB or DJVU is not read."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike("(?i)\\.txt$"))
    decoded = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    return files.select("path", decoded("content").alias("text"))


def text_lines(texts: DataFrame) -> DataFrame:
    """(path, line, text) of the lines of plain texts, counted from 1."""
    return texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_ranker(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    """A ranker's few weights as one JSON line."""
    spark.createDataFrame([(json.dumps(weights, sort_keys=True),)], "weights string").coalesce(1).write.mode("overwrite").text(path)


def load_ranker(spark: SparkSession, path: str) -> dict[str, float]:
    return json.loads(spark.read.text(path).first()[0])


def upsert_vectors(old: DataFrame | None, new: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(the vector table after the upsert, (key, reason) of rows refused): rows without a vector of ``size`` finite
    numbers are refused; of several rows of one key the greatest counts. A table of another size is given up whole."""
    good = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False)) & F.col(key).isNotNull()
    refused = new.filter(~good).select(key, F.when(F.col(key).isNull(), "no key").when(F.col(vector).isNull(), "no vector").when(F.size(vector) != size, "size").otherwise("not a number").alias("reason"))
    last = new.filter(good).groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*").select(*new.columns)
    if old is None:
        return last, refused
    kept = old.filter(F.size(vector) == size).join(last.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return kept.unionByName(last), refused


def append_audit(records: DataFrame, path: str) -> None:
    """Audit records behind those of a JSON log."""
    records.write.mode("append").json(path)
