"""One ranking from several differently scaled scores.

Every score becomes its empirical percentile inside its own ranking (ties share the average
rank), the percentile is mapped through the inverse normal distribution, and the items of a
group are ordered by the weighted mean of those normal scores.

An item that a ranking did not return (no row, null or NaN score) stands below everything that
ranking returned, tied with all other items it did not return. A ranking that returned nothing
has no say. Ties of the final value go to the item with the smaller key.

Ranks are computed without gathering a group anywhere: equal scores are counted once, scores
fall into buckets by a monotone function of the score, ranks are counted inside each bucket, and
the rows of all lower buckets are added from a table of one row per (group, ranking, bucket). One
group may hold any share of all rows. Repeated rows count once (the larger score holds); empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the inverse normal distribution
# published by P. J. Acklam (relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, as plain JVM arithmetic."""
    low = 0.02425
    q_tail = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    tail = _horner(q_tail, _C) / (_horner(q_tail, _D) * q_tail + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    middle = _horner(r, _A) * q / (_horner(r, _B) * r + F.lit(1.0))
    return F.when(p < low, tail).when(p > 1 - low, -tail).otherwise(middle)


def _bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises: about 700 of them from x to 2 x."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e6) * 1024)


def average_ranks(scores: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct (group, value) with ``n_equal`` rows and ``below`` rows of smaller value."""
    once = scores.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_equal")).withColumn("_b", _bucket(F.col(value)))
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        once.groupBy(*group, "_b").agg(F.sum("n_equal").alias("_n"))
        .select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        once.withColumn("_inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
        .join(offsets, [*group, "_b"])
        .select(*group, value, "n_equal", (F.col("_inside") + F.col("_before")).alias("below"))
    )


def fuse_scores(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``scores(group_id, item, ranking, score)`` to ``(group_id, item, value, returned_by)``.

    ``weights`` gives the weight of a ranking by name (1 where it is not named)."""
    one = (
        scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy("group_id", "item", "ranking").agg(F.max("score").alias("score"))
    )
    sizes = scores.select("group_id", "item").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("items"))
    ranks = average_ranks(one, ["group_id", "ranking"], "score")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("ranking") == name, F.lit(float(w))).otherwise(weight)
    returned = ranks.groupBy("group_id", "ranking").agg(F.sum("n_equal").alias("returned"))
    scale = returned.join(sizes, "group_id").withColumn("w", weight)

    def normal(rank: Column) -> Column:
        return inverse_normal((rank - F.lit(0.5)) / F.col("items"))

    absent = F.col("items") - F.col("returned")
    placed = (
        ranks.join(scale, ["group_id", "ranking"])
        .withColumn("z", normal(absent + F.col("below") + (F.col("n_equal") + 1) / 2))
        .withColumn("z_absent", F.when(absent > 0, normal((absent + 1) / 2)).otherwise(F.lit(0.0)))
        .select("group_id", "ranking", "score", (F.col("w") * (F.col("z") - F.col("z_absent"))).alias("gain"))
    )
    floor = (
        scale.withColumn("z_absent", F.when(absent > 0, normal((absent + 1) / 2)).otherwise(F.lit(0.0)))
        .groupBy("group_id").agg(F.sum(F.col("w") * F.col("z_absent")).alias("floor"), F.sum("w").alias("total_w"))
    )
    gains = (
        one.join(placed, ["group_id", "ranking", "score"])
        .groupBy("group_id", "item").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("returned_by"))
    )
    return gains.join(floor, "group_id").select(
        "group_id", "item", ((F.col("gain") + F.col("floor")) / F.col("total_w")).alias("value"), "returned_by"
    )


def passage_scores(passages: DataFrame) -> DataFrame:
    """Both passage layouts as (group_id, item, ranking, score, chunk_id).

    ``item`` is the normalised chunk_id; a passage without one is an item of its own."""
    blank = r"^[ \t\r\n]+|[ \t\r\n]+$"
    clean = lambda c: F.lower(F.regexp_replace(c, blank, ""))
    key = F.nullif(clean(F.col("chunk_id")), F.lit(""))
    base = passages.select(
        F.col("query_id").alias("group_id"),
        F.coalesce(key, F.concat(F.lit("\x01"), F.col("passage_id").cast("string"))).alias("item"),
        "chunk_id", clean(F.col("retrieval_method")).alias("method"), "score", "source_scores",
    )
    single = base.where("method <> 'fusion' or method is null").select(
        "group_id", "item", F.coalesce("method", F.lit("")).alias("ranking"), F.col("score").cast("double").alias("score"), "chunk_id"
    )
    fused = base.where("method = 'fusion'").select(
        "group_id", "item", "chunk_id", F.explode_outer("source_scores").alias("ranking", "score")
    ).select("group_id", "item", F.coalesce(clean(F.col("ranking")), F.lit("")).alias("ranking"), F.col("score").cast("double").alias("score"), "chunk_id")
    return single.unionByName(fused)


def fused_passages(passages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, value, returned_by): every passage of every query with its value.

    ``chunk_id`` is as in the row; of several spellings the smallest stands."""
    scores = passage_scores(passages)
    names = scores.groupBy("group_id", "item").agg(F.min("chunk_id").alias("chunk_id"))
    return (
        fuse_scores(scores.drop("chunk_id"), weights).join(names, ["group_id", "item"])
        .select(F.col("group_id").alias("query_id"), "item", "chunk_id", "value", "returned_by")
    )


def first_passages(passages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The passage that comes first for each query."""
    ranked = fused_passages(passages, weights)
    best = ranked.groupBy("query_id").agg(
        F.min(F.struct((-F.round("value", 9)).alias("v"), "item", "chunk_id")).alias("best")
    )
    return best.select("query_id", F.col("best.chunk_id").alias("chunk_id"))
