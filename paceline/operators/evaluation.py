"""Evaluation of predictions and scores: losses, calibration, AUC, rank correlation, baselines as of a date."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions.scalars import clamp_probability, wilson


def losses(rows: DataFrame, actual: str = "actual", probability: str = "probability") -> DataFrame:
    """n, accuracy (a half counts as 1), log loss and Brier score."""
    y, p = F.col(actual), clamp_probability(F.col(probability))
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(((p >= 0.5).cast("int") == y).cast("double")), 6).alias("accuracy"),
        F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"),
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
    )


def calibration_bins(rows: DataFrame, bins: int = 10, actual: str = "actual", probability: str = "probability") -> DataFrame:
    """Mean prediction, share of positives and its interval for each bin, empty ones included."""
    spark = rows.sparkSession
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("long")
    found = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("hits"), F.avg(probability).alias("m"))
    every = spark.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left")
    low, high = wilson(F.col("hits"), F.col("n"))
    return every.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("m", 6).alias("mean_p"), F.round(F.col("hits") / F.col("n"), 6).alias("share"), low.alias("low"), high.alias("high"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by mid-ranks, computed over distinct scores: no window runs over all rows."""
    by = rows.groupBy(score).agg(F.count("*").alias("m"), F.sum(F.col(label).cast("long")).alias("pos"))
    w = W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranked = by.withColumn("r", F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2)
    total = ranked.agg(F.sum(F.col("r") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("m") - F.col("pos")).alias("q"))
    area = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return total.select(F.col("p").alias("n_pos"), F.col("q").alias("n_neg"), F.round(F.when(F.col("p") * F.col("q") > 0, area).otherwise(0.5), 6).alias("auc"))


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation over mid-ranks within groups."""

    def mid(c: str):
        return F.rank().over(W.partitionBy(group).orderBy(c)) + (F.count("*").over(W.partitionBy(group, c)) - 1) / 2

    ranked = rows.select(group, mid(x).alias("rx"), mid(y).alias("ry"))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def as_of(queries: DataFrame, history: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """The last value at or before each query time, by one sort of the union: queries(key, when), history(key, when,
    value). A key's rows are sorted in one partition; keys are many and their histories short."""
    both = history.select(key, when, F.col(value).alias("v"), F.lit(0).alias("q")).unionByName(
        queries.select(key, when, F.lit(None).cast(history.schema[value].dataType).alias("v"), F.lit(1).alias("q"))
    )
    w = W.partitionBy(key).orderBy(when, "q").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v", True).over(w)).where("q = 1").select(key, when, value)


def latest(history: DataFrame, key: str, when: str, cut, *values: str) -> DataFrame:
    """Each key's last row at or before one date."""
    top = F.max(F.struct(when, *values)).alias("t")
    return history.where(F.col(when) <= cut).groupBy(key).agg(top).select(key, *[F.col(f"t.{c}").alias(c) for c in (when, *values)])


def fit_platt(pairs: list[tuple[float, int]], steps: int = 200, rate: float = 0.5) -> tuple[float, float]:
    """Slope and offset on logits by batch gradient descent."""
    a, b = 1.0, 0.0
    n = max(1, len(pairs))
    for _ in range(steps):
        ga = gb = 0.0
        for x, y in pairs:
            e = 1 / (1 + math.exp(-(a * x + b))) - y
            ga, gb = ga + e * x, gb + e
        a, b = a - rate * ga / n, b - rate * gb / n
    return a, b


def block_bootstrap(blocks: list[tuple[float, int]], rounds: int = 500, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Interval of a mean over resampled blocks, given each block's sum and count (aggregated in Spark)."""
    r = random.Random(seed)
    means = []
    for _ in range(rounds):
        drawn = r.choices(blocks, k=len(blocks))
        means.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
    means.sort()
    return means[int(alpha / 2 * rounds)], means[min(rounds - 1, int((1 - alpha / 2) * rounds))]
