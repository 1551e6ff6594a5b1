"""Keeping a store: audits, append-only logs, budgets, caches with a time limit, upserts, and pages of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.prefix import grouped_prefix_sums


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of one page in order; number and size are at least 1."""
    number, size = max(number, 1), max(size, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti").unionByName(new)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` has."""
    return child.join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def childless(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    return parent.join(child.select(F.col(child_key).alias("__c")), F.col(key) == F.col("__c"), "left_anti")


def number_gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, after, missing): gaps in the numbers of each group, each by the number before it."""
    d = df.filter(F.col(number).isNotNull()).select(group, number).distinct()
    nxt = F.lead(number).over(Window.partitionBy(group).orderBy(number))
    return d.withColumn("__n", nxt).filter(F.col("__n") - F.col(number) > 1).select(group, F.col(number).alias("after"), (F.col("__n") - F.col(number) - 1).alias("missing"))


def check(name: str, severity: str, value: DataFrame) -> DataFrame:
    """One audit row: value is a one-row, one-column DataFrame."""
    return value.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(value.columns[0]).cast("double").alias("value"))


def checks(row: DataFrame, told: dict[str, tuple[str, str]]) -> DataFrame:
    """Audit rows from the columns of one aggregated row: ``told`` has each column's check and severity."""
    made = [F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(c).cast("double").alias("value")) for c, (name, severity) in told.items()]
    return row.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def scorecard(parts: list[DataFrame]) -> DataFrame:
    """All audit rows and one more, the score: 100 less 5 for each failed check and 1 for each warning."""
    rows = reduce(DataFrame.unionByName, parts)
    failed = F.sum(((F.col("severity") == "fail") & (F.col("value") > 0)).cast("int"))
    warned = F.sum(((F.col("severity") == "warning") & (F.col("value") > 0)).cast("int"))
    # The rows are as many as there are checks: one list, so that no check is computed twice.
    whole = rows.agg(F.collect_list(F.struct("check", "severity", "value")).alias("all"), F.greatest(F.lit(0.0), 100.0 - 5 * failed - warned).alias("score"))
    return whole.select(F.explode(F.array_append("all", F.struct(F.lit("score").alias("check"), F.lit("info").alias("severity"), F.col("score").cast("double").alias("value")))).alias("c")).select("c.*")


def budget_trips(events: DataFrame, group: str, order: list[str], amount: str, limit: float) -> DataFrame:
    """(group, trip_at, used): the first event at which a group's running sum passes ``limit``; the limit itself is
    allowed. Groups that stay within it do not appear. A group with most of the events is summed over many tasks; rows
    equal in group and order must be one row."""
    spent = grouped_prefix_sums(events.select(group, *order, amount), [group], order, amount, "__before")
    x = spent.withColumn("used", F.col("__before") + F.coalesce(F.col(amount), F.lit(0))).filter(F.col("used") > limit)
    return x.groupBy(group).agg(F.min(F.struct(*order, "used")).alias("f")).select(group, F.col(f"f.{order[-1]}").alias("trip_at"), F.round("f.used", 6).alias("used"))


def cache_hits(requests: DataFrame, key: str, at: str, id: str, seconds: int = 300) -> DataFrame:
    """(id, hit): whether a request finds the key's value. A value is stored by the request that misses and lives
    ``seconds`` from then on, whoever asks for it meanwhile.

    Which request misses depends on the one that missed before, so each key's requests are read in order, in Arrow
    batches. A key's requests are first cut where none came for ``seconds``, since the one after such a pause misses
    whatever was before: these runs, not the keys, are the groups."""
    id_kind = requests.schema[id].dataType.simpleString()
    rows = requests.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(id).alias("i"))
    w = Window.partitionBy("k").orderBy("t", "i")
    rows = rows.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = grouped_prefix_sums(rows, ["k"], ["t", "i"], "new", "before").withColumn("run", F.col("before") + F.col("new"))

    def read(pdf):
        pdf = pdf.sort_values(["t", "i"])
        until, hits = None, []
        for t in pdf["t"]:
            hits.append(until is not None and t <= until)
            if not hits[-1]:
                until = t + seconds * 1_000_000
        return pdf[["i"]].assign(hit=hits)

    run = Window.partitionBy("k", "run")
    rows = rows.withColumn("n", F.count("*").over(run)).withColumn("p", F.row_number().over(run.orderBy("t", "i")))
    # In a run the first misses and the second, within the time, finds it; only longer runs need reading.
    short = rows.filter("n < 3").select("i", (F.col("p") > 1).alias("hit"))
    told = short.unionByName(rows.filter("n >= 3").groupBy("k", "run").applyInPandas(read, f"i {id_kind}, hit boolean"))
    return told.select(F.col("i").alias(id), "hit")


def valid_memories(entries: DataFrame, versions: dict[str, str], now, ttl: int = 604_800) -> DataFrame:
    """Entries (key, confidence, verdict, stored_at epoch, versions map) that may be recalled: answered surely enough,
    young enough and made by the same versions."""
    same = F.lit(True)
    for k, v in versions.items():
        same = same & (F.element_at("versions", k) == v)
    return entries.filter((F.col("verdict") == "answerable") & (F.col("confidence") >= 0.7) & (now - F.col("stored_at") <= ttl) & F.coalesce(same, F.lit(False)))


def memory_key(intent, query):
    """Twenty characters of the SHA-1 of intent and white-space-collapsed query."""
    return F.left(F.sha1(F.concat(intent, F.lit("::"), F.btrim(F.regexp_replace(query, "\\s+", " ")))), F.lit(20))
