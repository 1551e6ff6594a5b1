"""Learning to rank, confidence calibration and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["rrf_base", "sig_ocr_quality", "sig_coverage", "sig_completeness", "sig_density", "sig_length_prior", "sig_informativeness", "exact_raw", "layout", "cross_encoder_raw"]


def train_ranker(pairs: list[tuple[dict, dict]], features: list[str] | None = None, rate: float = 0.05, epochs: int = 40, margin: float = 0.01, bound: float = 0.03) -> dict[str, float]:
    """Weights of a linear ranker from judged (better, worse) pairs: where the better one does not lead by ``margin``
    its surplus of features is added, each weight kept within ``bound``. A sequential algorithm over a judged set of a
    few thousand pairs, run where the judgements are; scoring is a Column expression over any number of rows."""
    names = features or FEATURES
    w = dict.fromkeys(names, 0.0)
    gaps = [{n: float(g.get(n) or 0) - float(b.get(n) or 0) for n in names} for g, b in pairs]
    for _ in range(epochs):
        for gap in gaps:
            if sum(w[n] * gap[n] for n in names) < margin:
                for n in names:
                    w[n] = max(-bound, min(bound, w[n] + rate * gap[n]))
    return w


def ranker_score(weights: dict[str, float]):
    return sum((F.coalesce(F.col(n), F.lit(0.0)) * v for n, v in weights.items()), F.lit(0.0))


def calibration_bins(observed: DataFrame, bins: int = 10, least: int = 5) -> DataFrame:
    """(bin, predicted, observed, count) of (confidence, correct): means per bin with at least ``least`` observations."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    rows = observed.filter(F.col("confidence").between(0, 1) & F.col("correct").isNotNull())
    return rows.groupBy(b.alias("bin")).agg(F.avg("confidence").alias("predicted"), F.avg(F.col("correct").cast("double")).alias("observed"), F.count("*").alias("count")).filter(F.col("count") >= least)


def smoothed(bins: DataFrame) -> DataFrame:
    """The bins in order with falling ones averaged with the one before, in one pass from the left: at most as many
    rows as there are bins, so one ordered fold."""
    rows = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "predicted", "observed", "count"))).alias("b"))

    def fold(acc, x):
        last = F.element_at(acc, -1)
        falls = (F.size(acc) > 0) & (x["observed"] < last["observed"])
        both = (x["observed"] * x["count"] + last["observed"] * last["count"]) / (x["count"] + last["count"])
        def put(r, v):
            return F.struct(r["bin"].alias("bin"), r["predicted"].alias("predicted"), v.alias("observed"), r["count"].alias("count"))
        return F.when(falls, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(put(last, both), put(x, both)))).otherwise(F.array_append(acc, x))

    empty = F.array().cast("array<struct<bin:int,predicted:double,observed:double,count:bigint>>")
    return rows.select(F.explode(F.aggregate("b", empty, fold)).alias("r")).select("r.*")


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): the mean gap of predicted and observed, weighted by counts; 0 without bins."""
    return bins.agg(F.round(F.coalesce(F.sum(F.abs(F.col("predicted") - F.col("observed")) * F.col("count")) / F.sum("count"), F.lit(0.0)), 4).alias("ece"))


def retrieval_metrics(results: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall_at_k, reciprocal_rank, precision_at_1, relevant) of (query_id, place, relevant)."""
    rel = F.col("relevant")
    return results.groupBy("query_id").agg(
        F.when(F.sum(rel.cast("int")) > 0, F.round(F.try_divide(F.sum((rel & (F.col("place") <= k)).cast("int")), F.sum(rel.cast("int"))), 6)).alias("recall_at_k"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(rel, F.col("place")))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.max(F.when(F.col("place") == 1, rel.cast("double"))).alias("precision_at_1"), F.sum(rel.cast("int")).alias("relevant"),
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(metric, value): means of the metrics that are known, and the median and greatest number of relevant results."""
    row = metrics.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall_at_k", "reciprocal_rank", "precision_at_1")], F.median("relevant").cast("double").alias("relevant_p50"), F.max("relevant").cast("double").alias("relevant_max"))
    return row.select(F.explode(F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))


def regressions(now: DataFrame, before: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """(metric, value, baseline, worse): a metric against its baseline; unknown values are no regression."""
    b = before.select(F.col("metric").alias("m"), F.col("value").alias("baseline"))
    worse = F.when(F.col("metric").isin(lower_is_better), F.col("value") > F.col("baseline")).otherwise(F.col("value") < F.col("baseline"))
    return now.join(b, F.col("metric") == F.col("m"), "left").select("metric", "value", "baseline", F.coalesce(worse, F.lit(False)).alias("worse"))


def clean_queries(texts: DataFrame) -> DataFrame:
    """(id, query) of texts (id, text) fit to be judged: 6 to 22 words, few digits, few short words, no dot leaders."""
    words = F.filter(F.split(F.btrim("text"), "[\\s\\p{Z}]+"), lambda w: w != "")
    n = F.size(words)
    digits = F.regexp_count("text", F.lit("[0-9\\u0660-\\u0669\\u06F0-\\u06F9]"))
    short = F.size(F.filter(words, lambda w: (F.length(w) <= 2) & w.rlike("^\\p{L}+$")))
    return texts.filter(n.between(6, 22) & (digits <= 0.08 * F.length("text")) & (short <= 0.25 * n) & ~F.col("text").rlike("\\.{3,}")).select("id", F.btrim("text").alias("query"))


def distinctive_window(texts: DataFrame, counts: DataFrame, size: int = 5) -> DataFrame:
    """(id, window): the ``size`` neighbouring words of each text (id, tokens) whose frequencies add up least; the
    earliest of equal ones. counts: (token, frequency)."""
    w = texts.select("id", F.posexplode("tokens").alias("p", "token")).join(counts.select(F.col("token").alias("t"), "frequency"), F.col("token") == F.col("t"), "left")
    over = Window.partitionBy("id").orderBy("p").rowsBetween(0, size - 1)
    x = w.select("id", "p", F.sum(F.log1p(F.coalesce("frequency", F.lit(0)))).over(over).alias("s"), F.array_join(F.collect_list("token").over(over), " ").alias("window"), F.count("*").over(over).alias("n"))
    return x.filter(F.col("n") == size).groupBy("id").agg(F.min_by("window", F.struct(F.round("s", 9).alias("s"), "p")).alias("window"))
