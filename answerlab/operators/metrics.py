"""Ranking metrics, calibration and the paired bootstrap, as grouped plans.

Curves need running sums in the order of the score.  They are taken in two levels, sums per score
bucket first and then inside the buckets, so that no task holds a whole curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlab.functions.scalar import portable_hash

_BUCKETS = 256


def curve(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """Per group and distinct score: ``tp``, ``n`` and their running sums ``ctp``, ``cn`` from the highest score down.

    Rows with a null score or label never count; equal scores are one point of the curve.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    points = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(w * F.col(y)).alias("tp"), F.sum(w).alias("n"))
    ends = points.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    spot = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (_BUCKETS - 1))).otherwise(0)
    if by:
        points = points.join(ends, [*by]).withColumn("_b", spot)
    else:
        points = points.crossJoin(F.broadcast(ends)).withColumn("_b", spot)  # one row of least and greatest score
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy(*by, "_b").agg(F.sum("tp").alias("_t"), F.sum("n").alias("_n"))
    base = base.select(*by, "_b", F.coalesce(F.sum("_t").over(above), F.lit(0.0)).alias("_t0"), F.coalesce(F.sum("_n").over(above), F.lit(0.0)).alias("_n0"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return points.join(base, [*by, "_b"]).select(
        *by, "score", "tp", "n", (F.col("_t0") + F.sum("tp").over(inside)).alias("ctp"), (F.col("_n0") + F.sum("n").over(inside)).alias("cn")
    )


def average_precision(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """``(by, pr_auc)``: sum of recall steps times precision, ties grouped; NaN without positives or negatives."""
    points = curve(df, by, score, y, weight)
    value = F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.sum("tp")
    one_class = (F.sum("tp") == 0) | (F.sum("tp") == F.sum("n"))
    return points.where("n > 0").groupBy(*by).agg(F.when(one_class, F.lit(float("nan"))).otherwise(value).alias("pr_auc"))


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """``(by, roc_auc)``: the trapezoid over distinct scores; NaN without positives or negatives."""
    points = curve(df, by, score, y, weight)
    fp = F.col("n") - F.col("tp")
    area = F.sum(fp * (F.col("ctp") - F.col("tp") / 2))
    pos, neg = F.sum("tp"), F.sum(fp)
    return points.groupBy(*by).agg(F.when((pos == 0) | (neg == 0), F.lit(float("nan"))).otherwise(area / (pos * neg)).alias("roc_auc"))


def seed_mean(per_seed: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of a per-seed metric."""
    return per_seed.groupBy(*by).agg(F.avg(value).alias(value))


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """One row ``ece``: mean gap between label rate and mean probability, weighted by the bin's rows."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    each = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"))
    return each.agg((F.sum(F.abs(F.col("my") - F.col("mp")) * F.col("n")) / F.sum("n")).alias("ece"))


def accuracy(df: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Share of rows where p >= 0.5 says the label."""
    return df.groupBy(*by).agg(F.avg((F.col(p) >= 0.5).cast("int").eqNullSafe(F.col(y).cast("int")).cast("int")).alias("accuracy"))


def resamples(n: int, boots: int, spark) -> DataFrame:
    """``(boot, row_no, w)``: multiplicities of ``n`` draws with replacement from rows 0 … n-1, per boot.

    The draws are portable hashes, so any engine repeats them.  One row per drawn row and boot.
    """
    draws = spark.range(boots).select(F.col("id").alias("boot")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    row = portable_hash(F.concat_ws("-", F.lit("boot"), F.col("boot").cast("string"), F.col("i").cast("string"))) % n
    return draws.select("boot", row.alias("row_no")).groupBy("boot", "row_no").agg(F.count(F.lit(1)).alias("w"))


def bootstrap(scored: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """``(by, boot, pr_auc)`` of each resample; ``scored`` has ``row_no, score, y``.

    A resample is a multiset, so its curve is the curve with multiplicities as weights.
    """
    return average_precision(draws.join(scored, "row_no"), [*by, "boot"], weight=F.col("w"))


def ci95(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, mean, lo, hi)``: mean and linear 2.5 and 97.5 % quantiles of the finite values; NaN if none."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    q = F.percentile(finite, F.array(F.lit(0.025), F.lit(0.975)))
    nan = F.lit(float("nan"))
    return samples.groupBy(*by).agg(F.coalesce(F.avg(finite), nan).alias("mean"), F.coalesce(q[0], nan).alias("lo"), F.coalesce(q[1], nan).alias("hi"))


def paired_delta(boots_a: DataFrame, boots_b: DataFrame, by: list[str]) -> DataFrame:
    """``(by, boot, delta)``: difference of two arms on the same resamples."""
    a = boots_a.select(*by, "boot", F.col("pr_auc").alias("_a"))
    b = boots_b.select(*by, "boot", F.col("pr_auc").alias("_b"))
    return a.join(b, [*by, "boot"]).select(*by, "boot", (F.col("_a") - F.col("_b")).alias("delta"))


def verdict(lo: Column, hi: Column, margin: float, first: str = "first better", second: str = "second better") -> Column:
    """Significance before equivalence before inconclusive; NaN ends are inconclusive."""
    known = ~F.isnan(lo) & ~F.isnan(hi)
    return (
        F.when(known & (lo > 0), F.lit(first))
        .when(known & (hi < 0), F.lit(second))
        .when(known & (lo >= -margin) & (hi <= margin), F.lit("equivalent"))
        .otherwise(F.lit("inconclusive"))
    )


def stops_beating(lows: DataFrame, n: str = "n_labels", lo: str = "lo") -> DataFrame:
    """One row ``(status, stops_at)``: the first n after the first win whose low end is not above 0.

    ``status`` is 'never beats', 'stops' or 'keeps beating'.
    """
    win = lows.agg(F.min(F.when(F.col(lo) > 0, F.col(n))).alias("first_win"))
    after = lows.crossJoin(F.broadcast(win)).where((F.col(n) > F.col("first_win")) & (F.col(lo) <= 0)).agg(F.min(n).alias("stops_at"))  # one row each
    status = F.when(F.col("first_win").isNull(), "never beats").when(F.col("stops_at").isNull(), "keeps beating").otherwise("stops")
    return win.crossJoin(after).select(status.alias("status"), "stops_at")
