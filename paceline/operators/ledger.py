"""Race ledger: status and re-ranking, ordering keys, pairwise and ranking views, validation, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions.scalars import padded


def reranked(rows: DataFrame) -> DataFrame:
    """Ranks for all who took part: finishers by place, penalised after the last place in athlete order, and those who
    did not finish after all of them by time and athlete. rows: race, athlete, status, place, time."""
    w = W.partitionBy("race")
    finished = F.col("status") == "FIN"
    last = F.coalesce(F.max(F.when(finished, F.col("place"))).over(w), F.lit(0))
    n_pen = F.sum((F.col("status") == "PEN").cast("long")).over(w)
    nth = F.row_number().over(W.partitionBy("race", "status").orderBy(F.when(F.col("status") == "DNF", F.col("time")).asc_nulls_last(), "athlete"))
    rank = F.when(finished, F.col("place")).when(F.col("status") == "PEN", last + nth).when(F.col("status") == "DNF", last + n_pen + nth)
    return rows.withColumn("rank", rank.cast("long"))


def with_ordering_keys(rows: DataFrame) -> DataFrame:
    """race_ordering_key date|meet|0001|race and ordering_key with |rank|athlete added, both sortable as text."""
    race = F.concat_ws("|", F.date_format("date", "yyyyMMdd"), F.col("meet").cast("string"), padded(F.col("seq")), F.col("race").cast("string"))
    keyed = rows.withColumn("race_ordering_key", race)
    return keyed.withColumn("ordering_key", F.concat_ws("|", "race_ordering_key", padded(F.col("rank")), F.col("athlete").cast("string")))


def pairs(rows: DataFrame, weight: bool = False) -> DataFrame:
    """Winner and loser of every two ranked differently in a race, with 1 / (n - 1) as weight.

    The join is on the race, so its size follows the size of races, which the sport bounds."""
    sized = rows.withColumn("n", F.count("*").over(W.partitionBy("race")))
    a, b = sized.alias("a"), sized.alias("b")
    met = a.join(b, (F.col("a.race") == F.col("b.race")) & (F.col("a.rank") < F.col("b.rank")))
    out = met.select(F.col("a.race").alias("race"), F.col("a.athlete").alias("winner"), F.col("b.athlete").alias("loser"), F.col("a.n").alias("n"))
    return out.withColumn("weight", F.round(1 / (F.col("n") - 1), 6)).drop("n") if weight else out.drop("n")


def violations(rows: DataFrame) -> DataFrame:
    """How many ledger rows break each rule, in one pass and one look at duplicates."""
    dup = F.count("*").over(W.partitionBy("race", "athlete")) > 1
    marked = rows.withColumn("dup", dup)
    rules = {
        "null_race": F.col("race").isNull(), "null_athlete": F.col("athlete").isNull(),
        "rank_not_positive": F.coalesce(F.col("rank"), F.lit(0)) <= 0, "duplicate_entry": F.col("dup"),
        "unknown_status": ~F.col("status").isin("FIN", "PEN", "DNF", "DNS", "ADV"),
    }
    sums = marked.agg(*[F.sum(c.cast("long")).alias(k) for k, c in rules.items()])
    return sums.select(F.expr(f"stack({len(rules)}, {', '.join(f'{chr(39)}{k}{chr(39)}, {k}' for k in rules)}) as (rule, n_rows)"))


def dominant(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The most frequent value of each key, the least on a tie."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("c"), F.asc(value)))
    return counted.withColumn("n", n).where("n = 1").select(key, F.col(value).alias(out))


def status_audit(rows: DataFrame, status: str, athlete: str, rare_pct: float = 5.0) -> DataFrame:
    counted = rows.groupBy(status).agg(F.count("*").alias("n_rows"), F.countDistinct(athlete).alias("n_athletes"))
    share = F.round(F.col("n_rows") * 100 / F.sum("n_rows").over(W.partitionBy()), 2)
    return counted.withColumn("share_pct", share).withColumn("rare", F.col("share_pct") < rare_pct)
