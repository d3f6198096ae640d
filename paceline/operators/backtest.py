"""Backtests: oriented examples, held-out seasons, calibration in one row, segments, and the harness's own checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.domain import binary_entropy, first_by_hash
from paceline.functions.scalars import clamp_probability, wilson


def oriented(pairs: DataFrame) -> DataFrame:
    """left, right and label (1 if left won) of each comparison, the side fixed by a hash of race and sorted athletes, so that
    neither the result nor the identifiers decide it. pairs: race, winner, loser."""
    low, high = F.least("winner", "loser"), F.greatest("winner", "loser")
    sided = pairs.withColumn("left", F.when(first_by_hash(F.col("race"), low, high), low).otherwise(high))
    label = (F.col("left") == F.col("winner")).cast("long")
    return sided.select("race", "left", F.when(label == 1, F.col("loser")).otherwise(F.col("winner")).alias("right"), label.alias("label"))


def held_out(rows: DataFrame, season: str, last: int = 2) -> DataFrame:
    """Rows, those in the last seasons, and their share. The seasons are few, so their list is one row."""
    seasons = rows.groupBy(season).agg(F.count("*").alias("n"))
    ordered = seasons.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(season).alias("s"), "n")))).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    kept = F.aggregate(F.slice("x", 1, last), F.lit(0).cast("long"), lambda a, r: a + r["n"])
    first = F.array_min(F.transform(F.slice("x", 1, last), lambda r: r["s"]))
    return ordered.select(total.alias("n_rows"), kept.alias("n_held_out"), first.alias("first_season"), F.round(kept / total, 6).alias("share"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, expected calibration error, and among predictions from 0.7 to 0.8 the count, the share that came true and
    whether it is surely below 0.7. rows: actual, probability."""
    p = clamp_probability(F.col("probability"))
    place = F.least(F.floor(p * bins), F.lit(bins - 1))
    by = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("actual").alias("hits"), F.sum(p).alias("p"))
    near = (F.col("bin") == 7) if bins == 10 else F.lit(False)
    whole = by.agg(
        F.sum("n").alias("n"), F.sum(F.abs(F.col("hits") - F.col("p"))).alias("off"),
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("n_70"), F.sum(F.when(near, F.col("hits")).otherwise(0)).alias("hits_70"),
    )
    _, high = wilson(F.col("hits_70"), F.col("n_70"))
    return whole.select(
        "n", F.round(F.col("off") / F.col("n"), 6).alias("ece"), "n_70", F.round(F.when(F.col("n_70") > 0, F.col("hits_70") / F.col("n_70")).otherwise(0.0), 6).alias("rate_70"),
        F.coalesce(high < 70, F.lit(False)).alias("overconfident"),
    )


def segments(rows: DataFrame, bands: dict[str, Column]) -> DataFrame:
    """n and log loss by the bands of several segmentations, in one pass. rows: actual, probability."""
    y, p = F.col("actual"), clamp_probability(F.col("probability"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), v.cast("string").alias("bucket")) for k, v in bands.items()]))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    told = rows.select(loss.alias("loss"), cells.alias("c"))
    return told.groupBy("c.segment", "c.bucket").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("log_loss"))


def invariants(rows: DataFrame, slack: float = 0.1) -> DataFrame:
    """Whether a set of predictions can be what it says: the share of positives is near a half, the log loss is no less than
    its accuracy allows, and the calibration error is not merely 1 - mean(p). rows: actual, probability."""
    y, p = F.col("actual"), clamp_probability(F.col("probability"))
    one = rows.agg(
        F.avg(y).alias("rate"), F.avg(p).alias("mean_p"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.avg(F.abs(y - p)).alias("off"),
    )
    rules = {
        "labels_balanced": F.col("rate").between(0.4, 0.6), "loss_above_entropy": F.col("loss") >= binary_entropy(F.col("accuracy")) - slack,
        "labels_vary": F.abs(F.col("off") - (1 - F.col("mean_p"))) >= 1e-6,
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("holds")) for k, v in rules.items()])).alias("r")).select("r.*")
