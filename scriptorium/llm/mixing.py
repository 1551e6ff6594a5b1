"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.bpe import token_counts
from scriptorium.runtime import stored


def source_key(c: Column) -> Column:
    """A source name as compared: lower case, no white space outside; null where nothing is left."""
    key = F.lower(F.regexp_replace(c, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    return F.when(F.length(key) > 0, key)


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson number of the given rate that is cut off at ``cap``."""
    p, total, below = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        total += k * p
        below += p
        p *= rate / (k + 1)
    return total + cap * (1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose cut-off mean is ``mean`` (infinite where the cap leaves no smaller one)."""
    if mean >= cap:
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi if hi < 700 else math.inf


def distribution(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k = 0 .. cap - 1."""
    rate = rate_for(mean, cap)
    if math.isinf(rate):
        return [0.0] * cap
    p, out, below = math.exp(-rate), [], 0.0
    for k in range(cap):
        below += p
        out.append(below)
        p *= rate / (k + 1)
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, int]]:
    """Mean repetitions and cap of each listed source that has tokens: share * total / size, at most its cap.

    ``total`` is by default the largest size at which every source with tokens reaches its share within its
    repetitions, but not more than the listed sources hold. At a larger one, which must be passed, a source at its cap
    gives what it may, and its share stays short, as the report shows.
    """
    goal = {s: (share, max(int(cap), 0)) for s, share, cap in targets if sizes.get(s, 0) > 0 and share is not None and share > 0 and cap is not None}
    if total is None:
        held = float(sum(sizes[s] for s in goal if goal[s][1]))
        # A source that may not be drawn at all holds no other down.
        within = min((cap * sizes[s] / share for s, (share, cap) in goal.items() if cap), default=0.0)
        total = min(held, within)
    return {s: (min(share * total / sizes[s], float(cap)), cap) for s, (share, cap) in goal.items()}


def _targets(mix: DataFrame) -> list[tuple[str, float, int]]:
    rows = mix.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null")
    rows = rows.groupBy("s").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("s", "t.*")
    return [tuple(r) for r in rows.collect()]  # one row per source, a table made by hand


def mixture(documents: DataFrame, mix: DataFrame, seed: int = 17, total: float | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, repeat, tokens, text, place): the drawn documents, one row per repetition, shuffled globally.

    Each document of a listed source is repeated as often as a Poisson distribution, cut off at max_repeats and with
    the mean its source needs, says at the document's hash-seeded uniform number; ``place`` is the hash by which rows
    are ordered, so the shuffle is the same on any cluster. Documents whose source is null or not listed are not drawn;
    a listed source without documents, or without tokens, adds nothing. Null and empty texts have 0 tokens and are
    drawn like the others. Same doc_ids share their number of repetitions. An empty table gives an empty result.
    """
    sized = token_counts(documents, {"doc_id": F.col("doc_id"), "source": source_key(F.col("source")), "text": F.col("text")}, path=path)
    wanted = _targets(mix)
    listed = [s for s, _, _ in wanted]
    # Counted once; the compressed table is read again for the sizes and the sort's sample, which take no text, and for
    # the drawing.
    sized = stored(sized.filter(F.col("source").isin(listed)) if listed else sized.filter(F.lit(False)))
    sizes = {r[0]: int(r[1] or 0) for r in sized.groupBy("source").agg(F.sum("tokens")).collect()}  # listed sources only
    steps = {s: distribution(*of) for s, of in plan(sizes, wanted, total).items()}
    # A uniform number of 53 bits from the id alone.
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(2**53))
    count = F.lit(0)
    for s, below in steps.items():
        n = F.lit(0)
        for b in below:
            n = n + F.when(F.col("u") >= F.lit(b), 1).otherwise(0)
        count = F.when(F.col("source") == s, n).otherwise(count)
    return (
        sized.withColumn("u", u)
        .withColumn("times", count)
        .filter("times > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("repeat"), "tokens", "text")
        .withColumn("place", F.xxhash64("doc_id", "repeat", F.lit(seed + 1)))
        .orderBy("place", "doc_id", "repeat")
    )


def reached_shares(documents: DataFrame, mix: DataFrame, **options) -> DataFrame:
    """(source, target_share, max_repeats, documents, rows, tokens, actual_share, most_repeats) of each listed source."""
    drawn = mixture(documents, mix, **options).drop("text").groupBy("source").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("repeat").alias("most_repeats")
    )
    targets = mix.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null")
    targets = targets.groupBy("s").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    rows = targets.join(drawn, F.col("s") == F.col("source"), "left")
    whole = rows.agg(F.sum("tokens")).scalar()
    return rows.select(
        F.col("s").alias("source"), "t.target_share", "t.max_repeats",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "rows", "tokens", "most_repeats")],
        F.round(F.coalesce(F.col("tokens"), F.lit(0)) / whole, 6).alias("actual_share"),
    )
