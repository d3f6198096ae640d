"""Statistical tables: coverage, filters, distributions, placements, seasons, gaps, cohorts and retention.

Every function takes frames with the columns it names and returns a frame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions.scalars import ratio_pct, school_grade, stage_of_grade, wilson

K_ANONYMITY = 10


def coverage(rows: DataFrame, year: str, athlete: str, meet: str) -> DataFrame:
    """Rows, distinct athletes and distinct meets by year; empty names don't count."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return rows.groupBy(F.col(year).alias("year")).agg(
        F.count("*").alias("n_rows"), F.countDistinct(filled(athlete)).alias("n_athletes"),
        F.countDistinct(filled(meet)).alias("n_meets"),
    )


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that a row breaks, or 'kept'."""
    out = F
    for name, broken in rules:
        out = out.when(broken, name)
    return out.otherwise("kept")


def filter_log(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows dropped at each step of a filter cascade, in one pass."""
    return rows.groupBy(reject_reason(rules).alias("reason")).agg(F.count("*").alias("n_rows"))


def masked(metric: Column, n: Column, k: int = K_ANONYMITY) -> Column:
    return F.when(n >= k, metric)


def quantile_matrix(rows: DataFrame, keys: list[str], athlete: str, values: dict[str, str], points: list[float], k: int = K_ANONYMITY) -> DataFrame:
    """Quantiles of each value by keys; a family is masked if fewer than k athletes have it, on its own."""
    aggs = []
    for name, c in values.items():
        aggs.append(F.countDistinct(F.when(F.col(c).isNotNull(), F.col(athlete))).alias(f"n_{name}"))
        aggs.append(F.percentile(c, F.array(*map(F.lit, points))).alias(f"q_{name}"))
    grouped = rows.groupBy(*keys).agg(*aggs)
    out = [*map(F.col, keys)]
    for name in values:
        n = F.col(f"n_{name}")
        out += [n, (n < k).alias(f"{name}_insufficient")]
        out += [F.round(masked(F.col(f"q_{name}")[i], n, k), 6).alias(f"{name}_p{round(100 * p):02d}") for i, p in enumerate(points)]
    return grouped.select(*out)


def best_by_priority(rows: DataFrame, keys: list[str], priority: Column, *ties: Column) -> DataFrame:
    """The row of least priority in each group, and the group's size."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumn("group_size", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy(priority, *ties)))
    return ranked.where("n = 1").drop("n")


def pivot_least(rows: DataFrame, key: str, column: str, values: list[int], value: str, prefix: str) -> DataFrame:
    """The least value for each of a fixed set of columns."""
    cells = [F.min(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return rows.groupBy(key).agg(*cells)


def month_histogram(rows: DataFrame, meet: str, year: str, month: str) -> DataFrame:
    """Meets by the month they began in, with shares of all meets of the year and the half of the season."""
    first = rows.groupBy(year, meet).agg(F.min(month).alias("month"))
    counted = first.groupBy(year, "month").agg(F.count("*").alias("n_meets"))
    share = ratio_pct(F.col("n_meets"), F.sum("n_meets").over(W.partitionBy(year)))
    return counted.withColumn("share_pct", share).withColumn("half", F.when(F.col("month") >= 7, "start").otherwise("end"))


def participation(rows: DataFrame) -> DataFrame:
    """athlete × season: birth_year, sex, grade, stage, distinct meets, rows and the sorted codes.

    rows: athlete, season, birth_year, sex, meet, code.
    """
    grade = school_grade(F.col("season"), F.col("birth_year"))
    return rows.groupBy("athlete", "season", "birth_year", "sex").agg(
        F.countDistinct("meet").alias("n_meets"), F.count("*").alias("n_rows"),
        F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes"),
    ).withColumn("grade", grade).withColumn("stage", stage_of_grade(F.col("grade")))


def transitions(facts: DataFrame) -> DataFrame:
    """Each season's change against the seasons around it: profile changes, stops and final stops."""
    w = W.partitionBy("athlete").orderBy("season")
    before, after = F.lag("codes").over(w), F.lead("codes").over(w)
    kind = F.when(after.isNull(), "last").when(before.isNotNull() & (before != F.col("codes")), "transition").otherwise("same")
    return facts.select("athlete", "season", "codes", kind.alias("kind"), (after != F.col("codes")).alias("next_differs"))


def gap_episodes(facts: DataFrame) -> DataFrame:
    """Absences between two seasons of an athlete, those still open at the last season counted as censored.

    facts: athlete, season. A row for each gap of at least one season.
    """
    w = W.partitionBy("athlete").orderBy("season")
    last = facts.agg(F.max("season").alias("last_season"))
    following = facts.select("athlete", "season", F.lead("season").over(w).alias("next_season")).crossJoin(F.broadcast(last))
    gap = F.coalesce(F.col("next_season") - F.col("season") - 1, F.col("last_season") - F.col("season"))
    out = following.withColumn("gap", gap).withColumn("returned", F.col("next_season").isNotNull().cast("long"))
    return out.where("gap >= 1").select("athlete", "season", "next_season", "gap", "returned")


def gap_return_rates(episodes: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Cases and returns among gaps of at least each threshold; the buckets overlap."""
    marks = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("gap")))
    out = episodes.select(marks.alias("min_gap"), "returned").groupBy(F.col("min_gap").cast("long").alias("min_gap"))
    out = out.agg(F.count("*").alias("n_cases"), F.sum("returned").alias("n_returned"))
    return out.withColumn("return_pct", ratio_pct(F.col("n_returned"), F.col("n_cases")))


def stop_rule(rates: DataFrame, min_cases: int = 100, max_return_pct: float = 20.0) -> DataFrame:
    """The least gap after which enough cases show few enough returns; null with verdict 'hold' if there is none."""
    good = (F.col("n_cases") >= min_cases) & (F.col("return_pct") <= max_return_pct)
    found = rates.agg(F.min(F.when(good, F.col("min_gap"))).alias("stop_after"))
    return found.withColumn("verdict", F.when(F.col("stop_after").isNull(), "hold").otherwise("decided"))


def cohorts(facts: DataFrame, targets: tuple[int, ...] = (7, 10, 13)) -> DataFrame:
    """One row for each athlete: first and last season, seasons, grades reached and whether records begin before."""
    start = facts.agg(F.min("season").alias("first_known"))
    out = facts.groupBy("athlete").agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        F.countDistinct("season").alias("n_seasons"), F.min_by("grade", "season").alias("first_grade"),
        *[F.max((F.col("grade") >= t).cast("long")).alias(f"reached_{t}") for t in targets],
    )
    return out.crossJoin(F.broadcast(start)).withColumn(
        "left_censored", (F.col("first_season") == F.col("first_known")).cast("long")
    ).drop("first_known")


def segments_of(sex: str, grade: str, band: Column) -> Column:
    """The segments that a row counts in: all, its sex, its grade, its band."""
    part = lambda k, v: F.struct(F.lit(k).alias("split"), v.cast("string").alias("value"))
    return F.explode(F.array(part("all", F.lit("all")), part("sex", F.col(sex)), part("grade", F.col(grade)), part("band", band)))


def grade_retention(facts: DataFrame) -> DataFrame:
    """Athletes of each grade who are there in the next one too, overall and by sex, grade and four-year band."""
    base = facts.select("athlete", "grade", "sex", "season").distinct()
    after = base.select("athlete", (F.col("grade") - 1).alias("grade")).distinct().withColumn("stayed", F.lit(1))
    band = F.floor(F.col("season") / 4) * 4
    marked = base.join(after, ["athlete", "grade"], "left").select("stayed", segments_of("sex", "grade", band).alias("s"))
    out = marked.groupBy("s.split", "s.value").agg(F.count("*").alias("n_base"), F.count("stayed").alias("n_stayed"))
    low, high = wilson(F.col("n_stayed"), F.col("n_base"))
    return out.select("split", "value", "n_base", "n_stayed", ratio_pct(F.col("n_stayed"), F.col("n_base")).alias("pct"), low.alias("low"), high.alias("high"))


def mid_rank(w) -> Column:
    """Average rank of ties, in the order of w; w must partition as ties does."""
    return F.rank().over(w)


def pooled_percentile(best: DataFrame, least: int = 20) -> DataFrame:
    """Percentile of each athlete's best value in its season; seasons of fewer than ``least`` athletes are pooled with
    the seasons beside them, and left out if that is still too few.

    best: athlete, season, value (small is good). percentile = (n - r + 1) / n * 100 for the mid-rank r.
    """
    size = best.groupBy(F.col("season").alias("pool")).agg(F.count("*").alias("n_own"))
    valued = best.groupBy("season", "value").agg(F.count("*").alias("m"))
    reach = F.explode(F.sequence(F.col("season") - 1, F.col("season") + 1))
    near = valued.withColumn("pool", reach).join(size, "pool").where((F.col("pool") == F.col("season")) | (F.col("n_own") < least))
    counts = near.groupBy("pool", F.col("value").alias("v")).agg(F.sum("m").alias("m"))
    known = F.when(F.col("v").isNotNull(), F.col("m")).otherwise(0)
    each = W.partitionBy("pool")
    before = each.orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.select(
        "pool", "v", F.sum("m").over(each).alias("n"), known.alias("ties"),
        F.coalesce(F.sum(known).over(before), F.lit(0)).alias("below"),
    )
    met = best.join(ranked, (F.col("season") == F.col("pool")) & F.col("value").eqNullSafe(F.col("v")))
    r = F.col("below") + (F.col("ties") + 1) / 2
    return met.where(F.col("n") >= least).select("athlete", "season", "n", F.round((F.col("n") - r + 1) / F.col("n") * 100, 2).alias("percentile"))


def base_seasons(percentiles: DataFrame, born: DataFrame, grade: int = 6) -> DataFrame:
    """athlete, sex, season, percentile of each athlete's base season: that of the grade if there is one, else the first.

    percentiles: athlete, season, percentile; born: athlete, sex, birth_year."""
    first = [F.col("season") - F.col("birth_year") - 6 != grade, F.col("season")]
    k = F.row_number().over(W.partitionBy("athlete").orderBy(*first))
    picked = percentiles.join(born, "athlete").withColumn("k", k).where("k = 1")
    return picked.select("athlete", "sex", "season", "percentile")


def adaptive_bands(profiles: DataFrame, least: int = 30) -> DataFrame:
    """Four performance bands; the middle two are one for a sex with any band below ``least``, empty ones included.

    profiles: athlete, sex, percentile.
    """
    p = F.col("percentile")
    first = profiles.withColumn("band", F.when(p >= 90, "a").when(p >= 70, "b").when(p >= 50, "c").otherwise("d"))
    w = W.partitionBy("sex")
    counts = [F.sum((F.col("band") == b).cast("int")).over(w) for b in "abcd"]
    small = F.least(*counts) < least
    return first.select("athlete", "sex", "percentile", F.when(small & F.col("band").isin("b", "c"), "bc").otherwise(F.col("band")).alias("band"))


def improvements(best: DataFrame) -> DataFrame:
    """How much each athlete improved on the season just before. best: athlete, distance, season, value."""
    w = W.partitionBy("athlete", "distance").orderBy("season")
    before = F.when(F.lag("season").over(w) == F.col("season") - 1, F.lag("value").over(w))
    out = best.withColumn("previous", before).where("previous is not null")
    return out.select("athlete", "distance", "season", F.round(F.col("previous") - F.col("value"), 3).alias("gain"))
