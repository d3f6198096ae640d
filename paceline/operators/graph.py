"""Co-participation graphs: edges, degrees, components, distances."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.storage import cut


def edges(entries: DataFrame) -> DataFrame:
    """a < b and the number of races both were in. The join is on the race, whose size the sport bounds."""
    one = entries.select("race", "athlete").distinct()
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col("a.race") == F.col("b.race")) & (F.col("a.athlete") < F.col("b.athlete")))
    return met.groupBy(F.col("a.athlete").alias("a"), F.col("b.athlete").alias("b")).agg(F.count("*").alias("n_races"))


def memberships(entries: DataFrame) -> DataFrame:
    """athlete and the least athlete reachable over shared races, over the bipartite graph of athletes and races: no
    pairs of a race are made. Each task first joins what its races join, so that what is left has at most a row for each
    athlete and task; then each round passes the least label through races and shortens pointers."""
    rows = entries.select("race", "athlete").where("race is not null and athlete is not null")
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["athlete"].dataType.simpleString()
    rows = cut(rows.repartition(n, "race").mapInArrow(contracted, f"race {kind}, athlete {kind}").distinct())
    label = rows.select("athlete").distinct().withColumn("component", F.col("athlete"))
    while True:
        by_race = rows.join(label, "athlete").groupBy("race").agg(F.min("component").alias("m"))
        least = rows.join(by_race, "race").groupBy("athlete").agg(F.min("m").alias("component"))
        up = least.select(F.col("athlete").alias("component"), F.col("component").alias("top"))
        new = cut(least.join(up, "component").select("athlete", F.col("top").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "athlete").where("component <> old")
        if moved.isEmpty():
            return new
        label = new


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of whole races (race, athlete): the least athlete that each one reaches over them, and the athlete."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    race, athlete = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    _, race = np.unique(race, return_inverse=True)
    names, who = np.unique(athlete, return_inverse=True)
    who = who[np.argsort(race, kind="stable")]
    race.sort()
    starts = np.flatnonzero(np.r_[True, race[1:] != race[:-1]])
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, who, np.minimum.reduceat(label[who], starts)[race])
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(names[label]), pa.array(names)], ["race", "athlete"])


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("athlete")).unionAll(links.select("b"))
    return ends.groupBy("athlete").agg(F.count("*").alias("degree"))


def hops(links: DataFrame, start: list, most: int | None = None) -> DataFrame:
    """athlete and its distance from the start set over links (a, b): all that can be reached, or up to ``most`` steps."""
    spark = links.sparkSession
    both = cut(links.select("a", "b").unionAll(links.select("b", "a")).distinct())
    kind = links.schema["a"].dataType.simpleString()
    seen = spark.createDataFrame([(x, 0) for x in start], f"athlete {kind}, hop long")
    front = seen
    step = 0
    while most is None or step < most:
        step += 1
        near = front.join(both, front["athlete"] == both["a"]).select(F.col("b").alias("athlete")).distinct()
        front = cut(near.join(seen, "athlete", "left_anti").withColumn("hop", F.lit(step).cast("long")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def race_hops(entries: DataFrame, start: list) -> DataFrame:
    """athlete and its distance from the start set over shared races, until no athlete is new. The search goes over the
    bipartite graph of athletes and races, each race once, so no pairs of a race are made."""
    spark = entries.sparkSession
    rows = cut(entries.select("race", "athlete").distinct())
    kind = rows.schema["athlete"].dataType.simpleString()
    seen = spark.createDataFrame([(x, 0) for x in sorted(set(start))], f"athlete {kind}, hop long")
    front, step = seen.select("athlete"), 0
    left = rows
    while True:
        step += 1
        races = left.join(front, "athlete", "left_semi").select("race").distinct()
        races = cut(races)
        near = left.join(races, "race", "left_semi").select("athlete").distinct()
        front = cut(near.join(seen, "athlete", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front.withColumn("hop", F.lit(step).cast("long"))))
        left = cut(left.join(races, "race", "left_anti"))
