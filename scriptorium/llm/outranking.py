"""One ranking from several differently-scaled scores: outranking net flow over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.prefix import grouped_prefix_sums
from scriptorium.runtime import cut


#: Preference of one item over another by the difference d of their percentiles: none up to INDIFFERENCE, whole from
#: FULL on, in proportion between. With 0 and 1 every difference counts by its size, so no score can decide more than
#: its quarter however its values are spread; a narrower range lets small differences count like large ones.
INDIFFERENCE, FULL = 0.0, 1.0


def net_flows(items: DataFrame, group: str, item: str, weights: dict[str, float], indifference: float = INDIFFERENCE, full: float = FULL) -> DataFrame:
    """(group, item, positive, negative, flow): the weighted outranking flows of each item within its group.

    For each score, item a is preferred to b to the degree P(a, b) that :data:`INDIFFERENCE` and :data:`FULL` give to
    the difference of their percentiles (mid-ranks over the group's size). ``positive`` is the mean of P(a, b) over
    the others, ``negative`` the mean of P(b, a), both summed over the scores by weight, and ``flow`` their difference.

    No pair is made. Let C(t) be how many items have a mid-rank of at most t; their mid-ranks sum to C (C + 1) / 2, as
    equal scores lie wholly on one side. An item of mid-rank x is wholly preferred to the C(x - b) items below x - b
    and in proportion to those up to x - a, where a and b are the thresholds in ranks; so its flows are four values of
    C, which a second sorted prefix sum over values and thresholds gives (none is needed where they are 0 and 1).

    A missing or NaN score counts as the lowest, equal scores share their mid-rank, an item alone in its group has
    flows 0. Groups may be of any size: values are counted first and the prefix sums run over range partitions.
    (group, item) must be unique; an empty table gives no row.
    """
    if not 0 <= indifference < full:
        raise ValueError("0 <= indifference < full")
    scores = [F.struct(F.lit(c).alias("criterion"), F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")).alias("value")) for c in weights]
    long = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.explode(F.array(*scores)).alias("s")).select("g", "i", "s.criterion", "s.value")
    values = long.groupBy("g", "criterion", "value").agg(F.count("*").alias("held"))
    ranked = grouped_prefix_sums(values, ["g", "criterion"], ["value"], "held", "below", whole="n")
    ranked = ranked.withColumn("mid", F.col("below") + (F.col("held") + 1) / 2)
    a, b, x = indifference * F.col("n"), full * F.col("n"), F.col("mid")
    at = {"far_below": x - b, "near_below": x - a, "near_above": x + a, "far_above": x + b}
    inside = {k: (t > 0) & (t < F.col("n")) & (t != x) for k, t in at.items()}
    # C outside the ranks is 0 or n, and at x itself all that stand up to x.
    count = {k: F.when(t <= 0, 0).when(t >= F.col("n"), F.col("n")).otherwise(F.col("below") + F.col("held")) for k, t in at.items()}
    if indifference > 0 or full < 1:
        ranked = cut(ranked)
        asked = F.filter(F.array(*[F.when(inside[k], F.struct(F.lit(k).alias("what"), t.alias("t"))) for k, t in at.items()]), lambda q: q.isNotNull())
        marks = ranked.select("g", "criterion", F.explode(asked).alias("q")).groupBy("g", "criterion", F.col("q.t").alias("t")).agg(F.lit(1).alias("asked"))
        points = ranked.select("g", "criterion", x.alias("t"), "held", F.lit(0).alias("asked")).unionByName(marks.select("g", "criterion", "t", F.lit(0).cast("bigint").alias("held"), "asked"))
        # At equal places the items come before the question, which counts them.
        told = cut(grouped_prefix_sums(points, ["g", "criterion"], ["t", "asked"], "held", "c").filter("asked = 1").select("g", "criterion", "t", "c"))
        for k, t in at.items():
            mine = told.select(F.col("g").alias("__g"), F.col("criterion").alias("__c"), F.col("t").alias("__t"), F.col("c").alias(f"c_{k}"))
            ranked = ranked.join(mine, F.col("g").eqNullSafe(F.col("__g")) & (F.col("criterion") == F.col("__c")) & (t == F.col("__t")), "left").drop("__g", "__c", "__t")
            count[k] = F.when(inside[k], F.col(f"c_{k}")).otherwise(count[k])
    total = {k: c * (c + 1) / 2 for k, c in count.items()}
    slope = b - a
    up = count["far_below"] + ((x - a) * (count["near_below"] - count["far_below"]) - (total["near_below"] - total["far_below"])) / slope
    down = (F.col("n") - count["far_above"]) + ((total["far_above"] - total["near_above"]) - (x + a) * (count["far_above"] - count["near_above"])) / slope
    others = F.greatest(F.col("n") - 1, F.lit(1))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("criterion")]
    r = ranked.select(F.col("g").alias("rg"), F.col("criterion").alias("rc"), F.col("value").alias("rv"), (weight * up / others).alias("up"), (weight * down / others).alias("down"))
    return (
        long.join(r, F.col("g").eqNullSafe(F.col("rg")) & (F.col("criterion") == F.col("rc")) & F.col("value").eqNullSafe(F.col("rv")))
        .groupBy("g", "i")
        .agg(F.sum("up").alias("positive"), F.sum("down").alias("negative"))
        .select(F.col("g").alias(group), F.col("i").alias(item), "positive", "negative", (F.col("positive") - F.col("negative")).alias("flow"))
    )


CRITERIA = {"original_score": 1.0, "cross_score": 1.0, "ocr_quality": 1.0, "coverage": 1.0}


def scored_items(results: DataFrame, signals: DataFrame) -> DataFrame:
    """(query_id, element_id, four scores): the latest scoring of each item, with its signals where it has any.

    Of several scorings the latest counts (a null time is the earliest; at equal times the higher scores); of several
    signal rows the one with the higher values. Rows without query or element are no items.
    """
    latest = (
        results.filter("query_id is not null and element_id is not null")
        .groupBy("query_id", "element_id")
        .agg(F.max(F.struct("scored_at", "original_score", "cross_score")).alias("last"))
        .select("query_id", "element_id", "last.original_score", "last.cross_score")
    )
    signal = signals.groupBy(F.col("query_id").alias("q"), F.col("element_id").alias("e")).agg(F.max(F.struct("ocr_quality", "coverage")).alias("s"))
    return latest.join(signal, (F.col("query_id") == F.col("q")) & (F.col("element_id") == F.col("e")), "left").select(
        "query_id", "element_id", "original_score", "cross_score", "s.ocr_quality", "s.coverage"
    )


def fused_ranking(results: DataFrame, signals: DataFrame) -> DataFrame:
    """(query_id, element_id, positive, negative, flow) over all items."""
    return net_flows(scored_items(results, signals), "query_id", "element_id", CRITERIA)


def best_items(results: DataFrame, signals: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, element_id): the ``k`` best items of each query; equal flows (to nine decimals) by the smaller
    element_id.

    Spark keeps k rows per query and task before it shuffles (a group limit below the window), so a large query is no
    hot task.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("flow", 9).desc(), "element_id")
    return fused_ranking(results, signals).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "element_id")
