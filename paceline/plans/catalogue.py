"""Registered queries of the engine, each beside its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions import scalars
from paceline.functions.quantiles import quantile
from paceline.operators import entity, evaluation, graph, ledger, marts, ratings
from paceline.plans.proxy import (
    ENTRIES_SQL, FACTS_SQL, RANKED_SQL, ROWS_SQL, dated_entries, entries, facts, rows,
)
from paceline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Aggregations and filters


@query(f"""WITH {ROWS_SQL} SELECT CAST(season AS BIGINT) AS year, count(*) AS n_rows, count(DISTINCT athlete) AS n_athletes,
  count(DISTINCT meet) AS n_meets FROM rows GROUP BY 1""")  # fmt: skip
def coverage(spark, d):
    return marts.coverage(rows(spark, d), "season", "athlete", "meet")


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 5 THEN 'too_fast' WHEN l_discount > 0.08 THEN 'discount'
  WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'late' ELSE 'kept' END AS reason, count(*) AS n_rows FROM lineitem GROUP BY 1""")  # fmt: skip
def filter_log(spark, d):
    late = F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    rules = [("returned", F.col("l_returnflag") == "R"), ("too_fast", F.col("l_quantity") < 5), ("discount", F.col("l_discount") > 0.08), ("late", late)]
    return marts.filter_log(table(spark, d, "lineitem"), rules)


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(DISTINCT l_suppkey) AS n_time, count(DISTINCT l_suppkey) < 10 AS time_insufficient,
  round(CASE WHEN count(DISTINCT l_suppkey) >= 10 THEN quantile_cont(l_quantity, 0.1) END, 6) AS time_p10,
  round(CASE WHEN count(DISTINCT l_suppkey) >= 10 THEN quantile_cont(l_quantity, 0.5) END, 6) AS time_p50,
  round(CASE WHEN count(DISTINCT l_suppkey) >= 10 THEN quantile_cont(l_quantity, 0.9) END, 6) AS time_p90,
  count(DISTINCT CASE WHEN l_extendedprice > 100000 THEN l_suppkey END) AS n_rank,
  count(DISTINCT CASE WHEN l_extendedprice > 100000 THEN l_suppkey END) < 10 AS rank_insufficient,
  round(CASE WHEN count(DISTINCT CASE WHEN l_extendedprice > 100000 THEN l_suppkey END) >= 10
    THEN quantile_cont(CASE WHEN l_extendedprice > 100000 THEN l_extendedprice END, 0.1) END, 6) AS rank_p10,
  round(CASE WHEN count(DISTINCT CASE WHEN l_extendedprice > 100000 THEN l_suppkey END) >= 10
    THEN quantile_cont(CASE WHEN l_extendedprice > 100000 THEN l_extendedprice END, 0.5) END, 6) AS rank_p50,
  round(CASE WHEN count(DISTINCT CASE WHEN l_extendedprice > 100000 THEN l_suppkey END) >= 10
    THEN quantile_cont(CASE WHEN l_extendedprice > 100000 THEN l_extendedprice END, 0.9) END, 6) AS rank_p90
  FROM lineitem GROUP BY ALL""")  # fmt: skip
def dist_quantiles_kanon(spark, d):
    lines = table(spark, d, "lineitem").withColumn("high", F.when(F.col("l_extendedprice") > 100000, F.col("l_extendedprice")))
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return marts.quantile_matrix(lines, keys, "l_suppkey", {"time": "l_quantity", "rank": "high"}, [0.1, 0.5, 0.9])


@query(f"""WITH {FACTS_SQL} SELECT sex, stage, count(DISTINCT athlete) AS n_meets_n, round(quantile_cont(n_rows, 0.5), 6) AS rows_p50,
  round(quantile_cont(n_rows, 0.9), 6) AS rows_p90 FROM facts GROUP BY 1, 2 HAVING count(DISTINCT athlete) >= 10""")  # fmt: skip
def participation_quantiles(spark, d):
    g = facts(spark, d).groupBy("sex", "stage").agg(
        F.countDistinct("athlete").alias("n_meets_n"), F.round(quantile(F.col("n_rows"), 0.5), 6).alias("rows_p50"),
        F.round(quantile(F.col("n_rows"), 0.9), 6).alias("rows_p90"),
    )
    return g.where("n_meets_n >= 10")


@query("""SELECT coalesce(a.k, b.k) AS k, CAST(a.n AS DOUBLE) AS n_lines, CAST(b.n AS DOUBLE) AS n_orders FROM
  (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) a FULL JOIN
  (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) b ON a.k = b.k""")  # fmt: skip
def full_outer_align(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").cast("double").alias("n_lines"))
    b = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("n_orders"))
    return a.join(b, "k", "full_outer")


@query(f"""WITH {ROWS_SQL} SELECT athlete, season, race, priority, group_size FROM (SELECT *, count(*) OVER (PARTITION BY athlete, season) AS group_size,
  row_number() OVER (PARTITION BY athlete, season ORDER BY priority, value DESC, race) AS n FROM rows) WHERE n = 1""")  # fmt: skip
def best_placement(spark, d):
    best = marts.best_by_priority(rows(spark, d), ["athlete", "season"], F.col("priority"), F.desc("value"), F.col("race"))
    return best.select("athlete", "season", "race", "priority", "group_size")


@query(f"""WITH {ENTRIES_SQL} SELECT athlete, race, time FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY time, race) AS n
  FROM entries) WHERE n = 1""")  # fmt: skip
def fastest_argmin(spark, d):
    return marts.best_by_priority(entries(spark, d), ["athlete"], F.col("time"), F.col("race")).select("athlete", "race", "time")


@query(f"""WITH {ROWS_SQL} SELECT athlete, min(CASE WHEN season - birth_year = 10 THEN value END) AS age10,
  min(CASE WHEN season - birth_year = 12 THEN value END) AS age12, min(CASE WHEN season - birth_year = 14 THEN value END) AS age14
  FROM rows GROUP BY 1""")  # fmt: skip
def age_matrix_pivot(spark, d):
    aged = rows(spark, d).withColumn("age", F.col("season") - F.col("birth_year"))
    return marts.pivot_least(aged, "athlete", "age", [10, 12, 14], "value", "age")


@query(f"""WITH {ROWS_SQL} SELECT athlete, min(season) AS first_season, min(value) AS best, max(value) AS worst,
  array_to_string(list(priority ORDER BY date, race) FILTER (WHERE season - birth_year <= 14), ',') AS youth
  FROM rows GROUP BY 1""")  # fmt: skip
def youth_summary(spark, d):
    young = F.collect_list(F.when(F.col("season") - F.col("birth_year") <= 14, F.struct("date", "race", "priority")))
    out = rows(spark, d).groupBy("athlete").agg(F.min("season").alias("first_season"), F.min("value").alias("best"), F.max("value").alias("worst"), young.alias("y"))
    listed = F.array_join(F.transform(F.array_sort("y"), lambda x: x["priority"]), ",")
    return out.select("athlete", "first_season", "best", "worst", F.when(F.size("y") > 0, listed).alias("youth"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, array_to_string(list_filter([
  CASE WHEN l_quantity < 2 THEN 'below_bound' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END,
  CASE WHEN l_extendedprice > 2 * m THEN 'far_above_group' END], lambda x: x IS NOT NULL), ', ') AS reasons
  FROM (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linenumber) AS m FROM lineitem)
  WHERE l_quantity < 2 OR l_discount >= 0.1 OR l_extendedprice > 2 * m""")  # fmt: skip
def outlier_reasons(spark, d):
    lines = table(spark, d, "lineitem")
    mean = lines.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    met = lines.join(F.broadcast(mean), ["l_returnflag", "l_linenumber"])  # a row for each of a few flags and numbers
    reasons = F.array_compact(F.array(
        F.when(F.col("l_quantity") < 2, "below_bound"), F.when(F.col("l_discount") >= 0.1, "discount"),
        F.when(F.col("l_extendedprice") > 2 * F.col("m"), "far_above_group"),
    ))
    out = met.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.array_join(reasons, ", ").alias("reasons"))
    return out.where("reasons <> ''")


@query("""WITH f AS (SELECT year(o_orderdate) AS y, o_custkey AS m, min(month(o_orderdate)) AS month FROM orders GROUP BY 1, 2),
  c AS (SELECT y, month, count(*) AS n_meets FROM f GROUP BY 1, 2)
  SELECT CAST(y AS BIGINT) AS year, CAST(month AS BIGINT) AS month, n_meets, round(n_meets * 100.0 / sum(n_meets) OVER (PARTITION BY y), 2) AS share_pct,
  CASE WHEN month >= 7 THEN 'start' ELSE 'end' END AS half FROM c""")  # fmt: skip
def month_histogram(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("meet"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))
    return marts.month_histogram(o, "meet", "year", "month")


# Seasons, gaps and cohorts


@query(f"WITH {FACTS_SQL} SELECT * FROM facts")
def participation_fact(spark, d):
    return facts(spark, d)


@query(f"WITH {FACTS_SQL} SELECT season, count(DISTINCT athlete) AS n_athletes, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM facts GROUP BY 1")
def season_activity(spark, d):
    return facts(spark, d).groupBy("season").agg(F.countDistinct("athlete").alias("n_athletes"), F.sum("n_rows").alias("n_rows"))


@query(f"""WITH {FACTS_SQL}, t AS (SELECT season, codes, lag(codes) OVER w AS b, lead(codes) OVER w AS a FROM facts WINDOW w AS (PARTITION BY athlete ORDER BY season))
  SELECT season, CASE WHEN a IS NULL THEN 'last' WHEN b IS NOT NULL AND b <> codes THEN 'transition' ELSE 'same' END AS kind,
  count(*) AS n, CAST(coalesce(sum(CASE WHEN a <> codes THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_next_differs FROM t GROUP BY 1, 2""")  # fmt: skip
def transition_summary(spark, d):
    t = marts.transitions(facts(spark, d))
    return t.groupBy("season", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("next_differs").cast("long")), F.lit(0)).alias("n_next_differs"))


GAPS_SQL = FACTS_SQL + """,
s AS (SELECT DISTINCT athlete, season FROM facts), e AS (SELECT athlete, season, lead(season) OVER (PARTITION BY athlete ORDER BY season) AS next_season,
  (SELECT max(season) FROM s) AS last_season FROM s),
gaps AS (SELECT athlete, season, next_season, coalesce(next_season - season - 1, last_season - season) AS gap,
  CAST(next_season IS NOT NULL AS BIGINT) AS returned FROM e WHERE coalesce(next_season - season - 1, last_season - season) >= 1),
rates AS (SELECT CAST(t AS BIGINT) AS min_gap, count(*) AS n_cases, CAST(sum(returned) AS BIGINT) AS n_returned,
  round(sum(returned) * 100.0 / count(*), 2) AS return_pct FROM gaps JOIN (VALUES (1), (2), (3), (4)) v(t) ON gap >= t GROUP BY 1)"""


def _gaps(spark, d):
    return marts.gap_episodes(facts(spark, d).select("athlete", "season").distinct())


@query(f"WITH {GAPS_SQL} SELECT * REPLACE (CAST(next_season AS DOUBLE) AS next_season) FROM gaps")
def gap_episodes(spark, d):
    return _gaps(spark, d).withColumn("next_season", F.col("next_season").cast("double"))


@query(f"WITH {GAPS_SQL} SELECT * FROM rates")
def gap_return_rates(spark, d):
    return marts.gap_return_rates(_gaps(spark, d))


@query(f"""WITH {GAPS_SQL} SELECT CAST(min(CASE WHEN n_cases >= 100 AND return_pct <= 20 THEN min_gap END) AS DOUBLE) AS stop_after,
  CASE WHEN min(CASE WHEN n_cases >= 100 AND return_pct <= 20 THEN min_gap END) IS NULL THEN 'hold' ELSE 'decided' END AS verdict FROM rates""")  # fmt: skip
def stop_rule(spark, d):
    found = marts.stop_rule(marts.gap_return_rates(_gaps(spark, d)))
    return found.withColumn("stop_after", F.col("stop_after").cast("double"))


@query(f"""WITH {FACTS_SQL} SELECT athlete, min(season) AS first_season, max(season) AS last_season, count(DISTINCT season) AS n_seasons,
  arg_min(grade, season) AS first_grade, CAST(max(grade >= 7) AS BIGINT) AS reached_7, CAST(max(grade >= 10) AS BIGINT) AS reached_10,
  CAST(max(grade >= 13) AS BIGINT) AS reached_13, CAST(min(season) = (SELECT min(season) FROM facts) AS BIGINT) AS left_censored FROM facts GROUP BY 1""")  # fmt: skip
def cohort(spark, d):
    return marts.cohorts(facts(spark, d))


WILSON = """round(100 * greatest(0.0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 2) AS low,
  round(100 * least(1.0, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 2) AS high"""


@query(f"""WITH {FACTS_SQL}, b AS (SELECT DISTINCT athlete, grade, sex, season FROM facts),
  m AS (SELECT b.*, n.athlete IS NOT NULL AS stayed, CAST(floor(season / 4.0) * 4 AS BIGINT) AS band FROM b LEFT JOIN (SELECT DISTINCT athlete, grade - 1 AS grade FROM b) n
    ON b.athlete = n.athlete AND b.grade = n.grade),
  s AS (SELECT 'all' AS split, 'all' AS value, stayed FROM m UNION ALL SELECT 'sex', sex, stayed FROM m
    UNION ALL SELECT 'grade', CAST(grade AS VARCHAR), stayed FROM m UNION ALL SELECT 'band', CAST(band AS VARCHAR), stayed FROM m),
  g AS (SELECT split, value, count(*) AS n, CAST(sum(CASE WHEN stayed THEN 1 ELSE 0 END) AS BIGINT) AS k FROM s GROUP BY 1, 2), h AS (SELECT *, k / n AS p FROM g)
  SELECT split, value, n AS n_base, k AS n_stayed, round(k * 100.0 / n, 2) AS pct, {WILSON} FROM h""")  # fmt: skip
def grade_retention(spark, d):
    return marts.grade_retention(facts(spark, d))


@query(f"""WITH {FACTS_SQL}, c AS (SELECT athlete, any_value(sex) AS sex, max(grade >= 7) AS r7, max(grade >= 10) AS r10, max(grade >= 13) AS r13 FROM facts GROUP BY 1)
  SELECT coalesce(sex, 'all') AS sex, count(*) AS n, round(avg(CAST(r7 AS INT)) * 100, 2) AS pct_7, round(avg(CAST(r10 AS INT)) * 100, 2) AS pct_10,
  round(avg(CAST(r13 AS INT)) * 100, 2) AS pct_13 FROM c GROUP BY GROUPING SETS ((), (sex))""")  # fmt: skip
def stage_reach(spark, d):
    c = facts(spark, d).groupBy("athlete").agg(F.min("sex").alias("sex"), *[F.max((F.col("grade") >= t).cast("int")).alias(f"r{t}") for t in (7, 10, 13)])
    g = c.rollup("sex").agg(F.count("*").alias("n"), *[F.round(F.avg(f"r{t}") * 100, 2).alias(f"pct_{t}") for t in (7, 10, 13)])
    return g.withColumn("sex", F.coalesce("sex", F.lit("all")))


BEST_SQL = ROWS_SQL + ", best AS (SELECT athlete, season, min(value) AS value FROM rows GROUP BY 1, 2)"
PCT_SQL = BEST_SQL + """, own AS (SELECT *, count(*) OVER (PARTITION BY season) AS n_own FROM best),
pct AS (SELECT a.athlete, a.season, count(*) AS n, round((count(*) - (sum(CASE WHEN b.value < a.value THEN 1 ELSE 0 END)
  + (sum(CASE WHEN b.value = a.value THEN 1 ELSE 0 END) + 1) / 2) + 1) / count(*) * 100, 2) AS percentile
  FROM own a JOIN best b ON abs(b.season - a.season) <= CASE WHEN a.n_own < 20 THEN 1 ELSE 0 END GROUP BY 1, 2 HAVING count(*) >= 20)"""


def _best(spark, d):
    return rows(spark, d).groupBy("athlete", "season").agg(F.min("value").alias("value"))


@query(f"WITH {PCT_SQL} SELECT * FROM pct WHERE season >= 2000")
def baseline_percentile(spark, d):
    return marts.pooled_percentile(_best(spark, d).where("season >= 1999")).where("season >= 2000")


BANDS_SQL = PCT_SQL + """, prof AS (SELECT p.athlete, r.sex, p.percentile FROM pct p JOIN (SELECT DISTINCT athlete, sex FROM rows) r USING (athlete) WHERE season = 2000),
  b1 AS (SELECT *, CASE WHEN percentile >= 90 THEN 'a' WHEN percentile >= 70 THEN 'b' WHEN percentile >= 50 THEN 'c' ELSE 'd' END AS band FROM prof),
  b2 AS (SELECT athlete, sex, percentile, CASE WHEN band IN ('b', 'c') AND least(sum(CASE WHEN band = 'a' THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN band = 'b' THEN 1 ELSE 0 END) OVER w,
    sum(CASE WHEN band = 'c' THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN band = 'd' THEN 1 ELSE 0 END) OVER w) < 30 THEN 'bc' ELSE band END AS band FROM b1 WINDOW w AS (PARTITION BY sex))"""


def _bands(spark, d):
    pct = marts.pooled_percentile(_best(spark, d)).where("season = 2000")
    sex = rows(spark, d).select("athlete", "sex").distinct()
    return marts.adaptive_bands(pct.join(sex, "athlete").select("athlete", "sex", "percentile"))


@query(f"WITH {BANDS_SQL} SELECT * FROM b2")
def adaptive_bands(spark, d):
    return _bands(spark, d)


@query(f"""WITH {BANDS_SQL}, k AS (SELECT DISTINCT athlete FROM rows WHERE season = 2001),
  g AS (SELECT sex, band, count(*) AS n, count(k.athlete) AS k FROM b2 LEFT JOIN k USING (athlete) GROUP BY 1, 2), h AS (SELECT *, k / n AS p FROM g)
  SELECT sex, band, n, k AS n_stayed, {WILSON} FROM h""")  # fmt: skip
def band_retention_wilson(spark, d):
    after = rows(spark, d).where("season = 2001").select("athlete").distinct().withColumn("k", F.lit(1))
    g = _bands(spark, d).join(after, "athlete", "left").groupBy("sex", "band").agg(F.count("*").alias("n"), F.count("k").alias("n_stayed"))
    low, high = scalars.wilson(F.col("n_stayed"), F.col("n"))
    return g.select("sex", "band", "n", "n_stayed", low.alias("low"), high.alias("high"))


# The same over every season, from each athlete's own base season


@query(f"WITH {PCT_SQL} SELECT * FROM pct")
def baseline_percentile_all(spark, d):
    return marts.pooled_percentile(_best(spark, d))


BANDS_ALL_SQL = PCT_SQL + """, born AS (SELECT DISTINCT athlete, sex, birth_year FROM rows),
  prof AS (SELECT athlete, sex, season, percentile FROM (SELECT p.*, sex, row_number() OVER (PARTITION BY athlete ORDER BY CASE WHEN season - birth_year - 6 = 6 THEN 0 ELSE 1 END, season) AS k
    FROM pct p JOIN born USING (athlete)) WHERE k = 1),
  b1 AS (SELECT *, CASE WHEN percentile >= 90 THEN 'a' WHEN percentile >= 70 THEN 'b' WHEN percentile >= 50 THEN 'c' ELSE 'd' END AS first_band FROM prof),
  s AS (SELECT sex, least(count(*) FILTER (WHERE first_band = 'a'), count(*) FILTER (WHERE first_band = 'b'), count(*) FILTER (WHERE first_band = 'c'), count(*) FILTER (WHERE first_band = 'd')) AS fewest FROM b1 GROUP BY 1),
  b2 AS (SELECT athlete, sex, season, percentile, CASE WHEN first_band IN ('b', 'c') AND fewest < 30 THEN 'bc' ELSE first_band END AS band FROM b1 JOIN s USING (sex))"""


def _bands_all(spark, d):
    born = rows(spark, d).select("athlete", "sex", "birth_year").distinct()
    prof = marts.base_seasons(marts.pooled_percentile(_best(spark, d)), born)
    return marts.adaptive_bands(prof).join(prof.select("athlete", "season"), "athlete")


@query(f"WITH {BANDS_ALL_SQL} SELECT * FROM b2")
def adaptive_bands_all(spark, d):
    return _bands_all(spark, d)


@query(f"""WITH {BANDS_ALL_SQL}, k AS (SELECT DISTINCT athlete, season FROM rows),
  f AS (SELECT b2.*, b2.season + 1 < (SELECT max(season) FROM rows) AS followed, k.athlete IS NOT NULL AS stayed FROM b2 LEFT JOIN k ON k.athlete = b2.athlete AND k.season = b2.season + 1),
  g AS (SELECT sex, band, count(*) AS n_band, count(*) FILTER (WHERE followed) AS n, count(*) FILTER (WHERE followed AND stayed) AS k FROM f GROUP BY 1, 2),
  h AS (SELECT *, k / nullif(n, 0) AS p FROM g), i AS (SELECT sex, band, n_band, n, k, {WILSON} FROM h)
  SELECT sex, band, n_band, n AS n_followed, k AS n_stayed, CASE WHEN n > 0 THEN low END AS low, CASE WHEN n > 0 THEN high END AS high FROM i""")  # fmt: skip
def band_retention_all(spark, d):
    """Whoever's next season is the table's last, which may not be over, or comes after it, is in n_band but is not followed."""
    r = rows(spark, d)
    last = r.agg(F.max("season").alias("last"))
    after = r.select("athlete", (F.col("season") - 1).alias("season")).distinct().withColumn("stayed", F.lit(1))
    followed = F.col("season") + 1 < F.col("last")
    g = _bands_all(spark, d).join(after, ["athlete", "season"], "left").crossJoin(F.broadcast(last)).groupBy("sex", "band").agg(
        F.count("*").alias("n_band"), F.count(F.when(followed, 1)).alias("n_followed"), F.count(F.when(followed, F.col("stayed"))).alias("n_stayed")
    )
    n = F.when(F.col("n_followed") > 0, F.col("n_followed"))
    low, high = (F.when(n.isNotNull(), x) for x in scalars.wilson(F.col("n_stayed"), n))
    return g.select("sex", "band", "n_band", "n_followed", "n_stayed", low.alias("low"), high.alias("high"))


@query(f"""WITH {ROWS_SQL}, b AS (SELECT athlete, code AS distance, season, min(value) AS value FROM rows GROUP BY 1, 2, 3),
  l AS (SELECT *, lag(season) OVER w AS ps, lag(value) OVER w AS pv FROM b WINDOW w AS (PARTITION BY athlete, distance ORDER BY season))
  SELECT athlete, distance, season, round(pv - value, 3) AS gain FROM l WHERE ps = season - 1""")  # fmt: skip
def improvement_pairs(spark, d):
    return marts.improvements(_by_distance(spark, d))


def _by_distance(spark, d):
    return rows(spark, d).groupBy("athlete", F.col("code").alias("distance"), "season").agg(F.min("value").alias("value"))


@query(f"""WITH {ROWS_SQL}, b AS (SELECT athlete, code AS distance, season, min(value) AS value FROM rows GROUP BY 1, 2, 3),
  l AS (SELECT *, lag(season) OVER w AS ps, lag(value) OVER w AS pv FROM b WINDOW w AS (PARTITION BY athlete, distance ORDER BY season)),
  g AS (SELECT distance, season, round(pv - value, 3) AS gain FROM l WHERE ps = season - 1)
  SELECT distance, season, count(*) AS n, round(quantile_cont(gain, 0.25), 4) AS p25, round(quantile_cont(gain, 0.5), 4) AS p50, round(quantile_cont(gain, 0.75), 4) AS p75 FROM g GROUP BY 1, 2""")  # fmt: skip
def improvement_rate(spark, d):
    g = marts.improvements(_by_distance(spark, d)).groupBy("distance", "season")
    return g.agg(F.count("*").alias("n"), *[F.round(quantile(F.col("gain"), q), 4).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query(f"""WITH {FACTS_SQL}, o AS (SELECT DISTINCT athlete FROM facts WHERE stage = 'college'), f AS (SELECT athlete, arg_min(stage, season) AS origin, any_value(sex) AS sex FROM facts GROUP BY 1)
  SELECT sex, origin, count(*) AS n, count(o.athlete) AS n_outcome FROM f LEFT JOIN o USING (athlete) GROUP BY 1, 2""")  # fmt: skip
def reverse_distribution(spark, d):
    f = facts(spark, d)
    outcome = f.where("stage = 'college'").select("athlete").distinct().withColumn("o", F.lit(1))
    origin = f.groupBy("athlete").agg(F.min_by("stage", "season").alias("origin"), F.min("sex").alias("sex"))
    return origin.join(outcome, "athlete", "left").groupBy("sex", "origin").agg(F.count("*").alias("n"), F.count("o").alias("n_outcome"))


# Scalars


@query(r"""SELECT o_orderkey, round(CAST(o_orderkey % 7 AS DOUBLE) * 60 + (o_orderkey % 600) / 10.0, 6) AS seconds,
  CAST(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS BIGINT) AS rank,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(61.5 AS DOUBLE) END AS plain FROM orders""")  # fmt: skip
def time_parse(spark, d):
    text = F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(":"), F.format_string("%.1f", (F.col("o_orderkey") % 600) / 10.0))
    plain = F.when(F.col("o_orderkey") % 3 == 0, "x:61.5").otherwise("1:1.5")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(scalars.parse_seconds(text), 6).alias("seconds"), scalars.first_int(F.col("o_orderpriority")).alias("rank"),
        scalars.parse_seconds(plain).alias("plain"),
    )


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  left(sha256(CAST(o_custkey AS VARCHAR) || 'salt'), 12) AS key,
  CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS BIGINT) AS season FROM orders""")  # fmt: skip
def keys_and_slugs(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.slug(F.col("o_orderpriority")).alias("slug"), scalars.anon_key(F.col("o_custkey"), "salt").alias("key"), scalars.season_start(F.col("o_orderdate")).alias("season"))


@query("""WITH n AS (SELECT CASE l_returnflag WHEN 'A' THEN 'FIN' WHEN 'N' THEN 'DNF' ELSE 'PEN' END AS status, l_suppkey FROM lineitem)
  SELECT status, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_athletes, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS share_pct,
  round(count(*) * 100 / sum(count(*)) OVER (), 2) < 5 AS rare FROM n GROUP BY 1""")  # fmt: skip
def status_audit(spark, d):
    lines = table(spark, d, "lineitem").withColumn("status", scalars.normalised_status(F.col("l_returnflag")))
    return ledger.status_audit(lines, "status", "l_suppkey")


# Ledger


LEDGER_SQL = RANKED_SQL + """, l0 AS (SELECT race, athlete, status, rank AS place, time FROM ranked),
l1 AS (SELECT *, coalesce(max(CASE WHEN status = 'FIN' THEN place END) OVER (PARTITION BY race), 0) AS last,
  sum(CASE WHEN status = 'PEN' THEN 1 ELSE 0 END) OVER (PARTITION BY race) AS n_pen,
  row_number() OVER (PARTITION BY race, status ORDER BY CASE WHEN status = 'DNF' THEN time END ASC NULLS LAST, athlete) AS nth FROM l0),
led AS (SELECT race, athlete, status, CAST(CASE status WHEN 'FIN' THEN place WHEN 'PEN' THEN last + nth ELSE last + n_pen + nth END AS BIGINT) AS rank FROM l1)"""


def _ledger(spark, d):
    return ledger.reranked(entries(spark, d).select("race", "athlete", "status", F.col("rank").alias("place"), "time"))


@query(f"""WITH {LEDGER_SQL} SELECT race, athlete, status, rank, strftime(o_orderdate, '%Y%m%d') || '|' || o_custkey || '|0001|' || race AS race_ordering_key,
  strftime(o_orderdate, '%Y%m%d') || '|' || o_custkey || '|0001|' || race || '|' || lpad(CAST(rank AS VARCHAR), 4, '0') || '|' || athlete AS ordering_key
  FROM led JOIN orders ON race = o_orderkey""")  # fmt: skip
def race_ledger(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("race"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("meet"))
    keyed = ledger.with_ordering_keys(_ledger(spark, d).join(o, "race").withColumn("seq", F.lit(1)))
    return keyed.select("race", "athlete", "status", "rank", "race_ordering_key", "ordering_key")


@query(f"""WITH {RANKED_SQL}, s AS (SELECT race, athlete, rank, count(*) OVER (PARTITION BY race) AS n FROM ranked)
  SELECT a.race, a.athlete AS winner, b.athlete AS loser, round(1 / (a.n - 1), 6) AS weight FROM s a JOIN s b ON a.race = b.race AND a.rank < b.rank""")  # fmt: skip
def pairwise_weighted(spark, d):
    return ledger.pairs(entries(spark, d).select("race", "athlete", "rank"), weight=True)


@query(f"""WITH {LEDGER_SQL}, v AS (SELECT *, count(*) OVER (PARTITION BY race, athlete) > 1 AS dup FROM led)
  SELECT 'null_race' AS rule, count(*) FILTER (WHERE race IS NULL) AS n_rows FROM v UNION ALL
  SELECT 'null_athlete', count(*) FILTER (WHERE athlete IS NULL) FROM v UNION ALL
  SELECT 'rank_not_positive', count(*) FILTER (WHERE coalesce(rank, 0) <= 0) FROM v UNION ALL
  SELECT 'duplicate_entry', count(*) FILTER (WHERE dup) FROM v UNION ALL
  SELECT 'unknown_status', count(*) FILTER (WHERE status NOT IN ('FIN', 'PEN', 'DNF', 'DNS', 'ADV')) FROM v""")  # fmt: skip
def ledger_validation(spark, d):
    return ledger.violations(_ledger(spark, d))


@query(f"""WITH {ROWS_SQL}, c AS (SELECT athlete, code, count(*) AS c FROM rows GROUP BY 1, 2),
  m AS (SELECT athlete, code FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY c DESC, code) AS n FROM c) WHERE n = 1)
  SELECT athlete, min(season) AS debut_season, max(season) AS last_season, count(DISTINCT season) AS n_seasons, min(birth_year) AS birth_year,
  any_value(m.code) AS division FROM rows JOIN m USING (athlete) GROUP BY 1""")  # fmt: skip
def athlete_meta(spark, d):
    r = rows(spark, d)
    base = r.groupBy("athlete").agg(F.min("season").alias("debut_season"), F.max("season").alias("last_season"), F.countDistinct("season").alias("n_seasons"), F.min("birth_year").alias("birth_year"))
    return base.join(ledger.dominant(r, "athlete", "code", "division"), "athlete")


# As-of, baselines and evaluation


@query("""SELECT user_id, arg_max(ts, struct_pack(ts := ts, event_id := event_id)) AS ts, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id,
  arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 15 DAY FROM events) GROUP BY 1""")  # fmt: skip
def asof_latest(spark, d):
    e = table(spark, d, "events")
    cut = e.agg((F.min("ts") + F.expr("INTERVAL 15 DAY")).alias("cut"))
    near = e.crossJoin(F.broadcast(cut)).where("ts <= cut")
    return evaluation.latest(near, "user_id", "ts", F.col("cut"), "event_id", "value")


@query("""WITH h AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
  q AS (SELECT DISTINCT user_id, ts FROM events WHERE event_id % 2 = 1)
  SELECT q.user_id, q.ts, h.value FROM q ASOF LEFT JOIN h ON q.user_id = h.user_id AND q.ts >= h.ts""")  # fmt: skip
def asof_many(spark, d):
    e = table(spark, d, "events")
    history = e.where("event_id % 2 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return evaluation.as_of(e.where("event_id % 2 = 1").select("user_id", "ts").distinct(), history, "user_id", "ts", "value")


@query(f"""WITH {RANKED_SQL}, s AS (SELECT race, athlete, rank, o_orderdate AS date FROM ranked JOIN orders ON race = o_orderkey),
  m AS (SELECT athlete, date, max(CASE WHEN n > 1 THEN 1 - (rank - 1) / (n - 1) ELSE 0.5 END) AS score FROM (SELECT *, count(*) OVER (PARTITION BY race) AS n FROM s) GROUP BY 1, 2)
  SELECT athlete, date, round(score, 6) AS score, round(lag(score) OVER (PARTITION BY athlete ORDER BY date), 6) AS previous FROM m""")  # fmt: skip
def last_meet_percentile(spark, d):
    e = dated_entries(spark, d).withColumn("n", F.count("*").over(W.partitionBy("race")))
    score = F.when(F.col("n") > 1, 1 - (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(0.5)
    m = e.groupBy("athlete", "date").agg(F.max(score).alias("s"))
    return m.select("athlete", "date", F.round("s", 6).alias("score"), F.round(F.lag("s").over(W.partitionBy("athlete").orderBy("date")), 6).alias("previous"))


@query(f"""WITH {ROWS_SQL}, b AS (SELECT athlete, season, min(value) AS best FROM rows GROUP BY 1, 2)
  SELECT a.athlete, a.season, a.best, p.best AS previous, round((p.best - a.best) / greatest(p.best, a.best), 6) AS delta
  FROM b a JOIN b p ON a.athlete = p.athlete AND p.season = a.season - 1""")  # fmt: skip
def prev_season_best(spark, d):
    b = rows(spark, d).groupBy("athlete", "season").agg(F.min("value").alias("best"))
    p = b.select("athlete", (F.col("season") + 1).alias("season"), F.col("best").alias("previous"))
    return b.join(p, ["athlete", "season"]).withColumn("delta", F.round((F.col("previous") - F.col("best")) / F.greatest("previous", "best"), 6))


PAIRS_SQL = RANKED_SQL + """, s AS (SELECT race, athlete, rank, o_orderdate AS date FROM ranked JOIN orders ON race = o_orderkey),
  p AS (SELECT a.race, a.date, least(a.athlete, b.athlete) AS a, greatest(a.athlete, b.athlete) AS b, a.athlete AS winner
    FROM s a JOIN s b ON a.race = b.race AND a.rank < b.rank)"""


@query(f"""WITH {PAIRS_SQL}, h AS (SELECT a, b, date, max(winner) AS last_winner FROM p GROUP BY 1, 2, 3),
  l AS (SELECT *, lag(last_winner) OVER (PARTITION BY a, b ORDER BY date) AS before FROM h),
  j AS (SELECT p.winner, l.before FROM p JOIN l USING (a, b, date))
  SELECT count(*) AS n, count(before) AS n_known, CAST(sum(CASE WHEN before = winner THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
  round(avg(-ln(CASE WHEN before IS NULL THEN 0.5 WHEN before = winner THEN 0.65 ELSE 0.35 END)), 6) AS log_loss FROM j""")  # fmt: skip
def head_to_head_asof(spark, d):
    dated = dated_entries(spark, d).select("race", "date").distinct()
    p = ledger.pairs(entries(spark, d).select("race", "athlete", "rank")).join(dated, "race")
    p = p.select("date", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"), "winner")
    day = p.groupBy("a", "b", "date").agg(F.max("winner").alias("last"))
    day = day.withColumn("before", F.lag("last").over(W.partitionBy("a", "b").orderBy("date"))).drop("last")
    j = p.join(day, ["a", "b", "date"])
    prob = F.when(F.col("before").isNull(), 0.5).when(F.col("before") == F.col("winner"), 0.65).otherwise(0.35)
    return j.agg(F.count("*").alias("n"), F.count("before").alias("n_known"), F.sum(F.when(F.col("before") == F.col("winner"), 1).otherwise(0)).alias("n_right"), F.round(F.avg(-F.log(prob)), 6).alias("log_loss"))


SCORED_SQL = """s AS (SELECT l.doc_id, quality AS actual, n_chars, 1 / (1 + exp(-(n_chars - 1500) / 1500.0)) AS probability, lang FROM labels l JOIN documents d USING (doc_id))"""


def _scored(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return x.select("doc_id", F.col("quality").alias("actual"), "n_chars", scalars.logistic((F.col("n_chars") - 1500) / 1500.0).alias("probability"), "lang")


CLAMPED = "least(greatest(probability, 1e-6), 1 - 1e-6)"


@query(f"""WITH {SCORED_SQL}, c AS (SELECT actual, {CLAMPED} AS p FROM s) SELECT count(*) AS n, round(avg(CASE WHEN CAST(p >= 0.5 AS INT) = actual THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(-avg(actual * ln(p) + (1 - actual) * ln(1 - p)), 6) AS log_loss, round(avg((p - actual) * (p - actual)), 6) AS brier FROM c""")  # fmt: skip
def metrics_logloss(spark, d):
    return evaluation.losses(_scored(spark, d))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT CAST(least(floor(probability * 10), 9) AS BIGINT) AS bin, count(*) AS n, sum(actual) AS k, avg(probability) AS m FROM s GROUP BY 1),
  h AS (SELECT range AS bin, n, k, m, k / n AS p FROM range(10) LEFT JOIN g ON range = bin)
  SELECT bin, coalesce(n, 0) AS n, round(m, 6) AS mean_p, round(p, 6) AS share, CASE WHEN n > 0 THEN low END AS low, CASE WHEN n > 0 THEN high END AS high
  FROM (SELECT *, {WILSON} FROM h)""")  # fmt: skip
def ece_bins(spark, d):
    return evaluation.calibration_bins(_scored(spark, d))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT actual, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM s),
  t AS (SELECT sum(CASE WHEN actual = 1 THEN r ELSE 0 END) AS s, CAST(sum(actual) AS BIGINT) AS p, CAST(sum(1 - actual) AS BIGINT) AS q FROM r)
  SELECT p AS n_pos, q AS n_neg, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t""")  # fmt: skip
def auc_midrank(spark, d):
    return evaluation.auc(_scored(spark, d), "actual", "n_chars")


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS ry FROM part)
  SELECT p_brand, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")  # fmt: skip
def spearman(spark, d):
    return evaluation.spearman(table(spark, d, "part"), "p_brand", "p_size", "p_retailprice")


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS band, actual, {CLAMPED} AS p FROM s),
  u AS (SELECT 'lang' AS kind, lang AS segment, actual, p FROM c UNION ALL SELECT 'band', band, actual, p FROM c)
  SELECT kind, segment, count(*) AS n, round(-avg(actual * ln(p) + (1 - actual) * ln(1 - p)), 6) AS log_loss FROM u GROUP BY 1, 2""")  # fmt: skip
def segments(spark, d):
    p = scalars.clamp_probability(F.col("probability"))
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    kinds = F.explode(F.array(F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("segment")), F.struct(F.lit("band").alias("kind"), band.alias("segment"))))
    u = _scored(spark, d).select(kinds.alias("k"), "actual", p.alias("p")).select("k.*", "actual", "p")
    loss = -F.avg(F.col("actual") * F.log("p") + (1 - F.col("actual")) * F.log(1 - F.col("p")))
    return u.groupBy("kind", "segment").agg(F.count("*").alias("n"), F.round(loss, 6).alias("log_loss"))


# Age model


@query("""WITH v AS (SELECT user_id % 12 AS age, list_sort(list(value)) AS x FROM events WHERE value IS NOT NULL GROUP BY 1)
  SELECT age, CAST(len(x) AS BIGINT) AS n, x[CAST(floor((len(x) - 1) * 0.25::DOUBLE + 0.5) AS INT) + 1] AS p25, x[CAST(floor((len(x) - 1) * 0.5::DOUBLE + 0.5) AS INT) + 1] AS p50,
  x[CAST(floor((len(x) - 1) * 0.75::DOUBLE + 0.5) AS INT) + 1] AS p75 FROM v WHERE len(x) >= 10""")  # fmt: skip
def age_baseline_nearest(spark, d):
    e = table(spark, d, "events").where("value is not null")
    g = e.groupBy((F.col("user_id") % 12).alias("age")).agg(F.count("*").alias("n"), *[quantile(F.col("value"), q, "nearest").alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)])
    return g.where("n >= 10")


@query("""WITH l AS (SELECT user_id % 12 AS age, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events)
  SELECT age, count(delta) AS n, round(stddev_pop(delta), 6) AS volatility FROM l WHERE delta IS NOT NULL GROUP BY 1""")  # fmt: skip
def age_volatility(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select((F.col("user_id") % 12).alias("age"), (F.col("value") - F.lag("value").over(w)).alias("delta"))
    return e.where("delta is not null").groupBy("age").agg(F.count("delta").alias("n"), F.round(F.stddev_pop("delta"), 6).alias("volatility"))


@query(f"""WITH {ROWS_SQL}, a AS (SELECT athlete, sex, season - birth_year AS age, max(value) AS v FROM rows GROUP BY 1, 2, 3)
  SELECT athlete, sex, age, rank() OVER (PARTITION BY age, sex ORDER BY v DESC) AS place,
  round(rank() OVER (PARTITION BY age, sex ORDER BY v DESC) / count(*) OVER (PARTITION BY age, sex), 6) AS share FROM a""")  # fmt: skip
def top_share(spark, d):
    a = rows(spark, d).groupBy("athlete", "sex", (F.col("season") - F.col("birth_year")).alias("age")).agg(F.max("value").alias("v"))
    w = W.partitionBy("age", "sex")
    place = F.rank().over(w.orderBy(F.desc("v"))).cast("long")
    return a.select("athlete", "sex", "age", place.alias("place"), F.round(place / F.count("*").over(w), 6).alias("share"))


# Graph and identity


@query(f"""WITH {ENTRIES_SQL} SELECT a.athlete AS a, b.athlete AS b, count(*) AS n_races FROM entries a JOIN entries b ON a.race = b.race AND a.athlete < b.athlete GROUP BY 1, 2""")
def graph_edges(spark, d):
    return graph.edges(entries(spark, d))


@query(f"""WITH {ENTRIES_SQL}, e AS (SELECT DISTINCT a.athlete AS a, b.athlete AS b FROM entries a JOIN entries b ON a.race = b.race AND a.athlete <> b.athlete),
  g AS (SELECT a, count(*) AS degree FROM e GROUP BY 1) SELECT degree, count(*) AS n_athletes FROM g GROUP BY 1""")  # fmt: skip
def degree_dist(spark, d):
    return graph.degrees(graph.edges(entries(spark, d))).groupBy("degree").agg(F.count("*").alias("n_athletes"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    WHERE a.l_extendedprice > 90000 AND b.l_extendedprice > 90000),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS athlete, min(b) AS component FROM r GROUP BY 1""")  # fmt: skip
def components(spark, d):
    dear = table(spark, d, "lineitem").where("l_extendedprice > 90000")
    return graph.memberships(dear.select(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("athlete")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
    WHERE a.l_extendedprice > 90000 AND b.l_extendedprice > 90000),
  h(athlete, hop) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.b, hop + 1 FROM h JOIN e ON e.a = h.athlete WHERE hop < 3)
  SELECT athlete, min(hop) AS hop FROM h GROUP BY 1""")  # fmt: skip
def bfs_hops(spark, d):
    dear = table(spark, d, "lineitem").where("l_extendedprice > 90000")
    return graph.hops(graph.edges(dear.select(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("athlete"))), [1], 3)


# The same over all rows, to the last hop


def _line_entries(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("athlete"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS athlete, min(b) AS component FROM r GROUP BY 1""")  # fmt: skip
def components_all(spark, d):
    return graph.memberships(_line_entries(spark, d))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey),
  h(athlete, hop) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.b, hop + 1 FROM h JOIN e ON e.a = h.athlete WHERE hop < (SELECT count(DISTINCT l_suppkey) FROM lineitem))
  SELECT athlete, min(hop) AS hop FROM h GROUP BY 1""")  # fmt: skip
def bfs_hops_all(spark, d):
    return graph.race_hops(_line_entries(spark, d), [1])


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS sub, c_custkey // 2 AS main FROM customer WHERE c_custkey > 1),
  r(sub, main) AS (SELECT sub, main FROM m UNION ALL SELECT r.sub, m.main FROM r JOIN m ON r.main = m.sub)
  SELECT sub, min(main) AS main FROM r GROUP BY 1""")  # fmt: skip
def id_chain_resolve(spark, d):
    c = table(spark, d, "customer").where("c_custkey > 1")
    return entity.resolve_chains(c.select(F.col("c_custkey").alias("sub"), F.expr("c_custkey div 2").alias("main")))


@query("""WITH h AS (SELECT p_type AS name, p_partkey AS id, p_brand AS event, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 7 END AS result FROM part WHERE p_partkey <= 400)
  SELECT a.name, a.id AS a, b.id AS b, a.event, CASE WHEN a.result IS NULL OR b.result IS NULL THEN 'insufficient' WHEN a.result = b.result THEN 'shared' ELSE 'conflict' END AS kind
  FROM h a JOIN h b ON a.name = b.name AND a.event = b.event AND a.id < b.id""".replace(" WHERE p_partkey <= 400", ""))  # fmt: skip
def conflict_check(spark, d):
    result = F.when(F.col("p_size") % 5 == 0, "").otherwise((F.col("p_size") % 7).cast("string"))
    return entity.conflicts(table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("event"), result.alias("result")))


@query("""WITH o AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
  n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
  SELECT * FROM o UNION ALL SELECT n.* FROM n LEFT JOIN o USING (user_id, event_type) WHERE o.event_id IS NULL""")  # fmt: skip
def append_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    old = e.where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return entity.append_new(old, e.where("event_id % 3 <> 0"), ["user_id", "event_type"], "event_id")


# Peers and population


@query(f"""WITH {ROWS_SQL}, m AS (SELECT athlete, sex, max(value) AS mu FROM rows GROUP BY 1, 2)
  SELECT athlete, sex, rank() OVER (PARTITION BY sex ORDER BY mu DESC) AS place,
  round(100 * rank() OVER (PARTITION BY sex ORDER BY mu DESC) / count(*) OVER (PARTITION BY sex), 6) AS top_pct FROM m""")  # fmt: skip
def ranking_population_pct(spark, d):
    m = rows(spark, d).groupBy("athlete", "sex").agg(F.max("value").alias("mu"))
    w = W.partitionBy("sex")
    place = F.rank().over(w.orderBy(F.desc("mu"))).cast("long")
    return m.select("athlete", "sex", place.alias("place"), F.round(100 * place / F.count("*").over(w), 6).alias("top_pct"))


@query(f"""WITH {ROWS_SQL}, p AS (SELECT sex, birth_year, season, count(DISTINCT athlete) AS n, quantile_cont(value, 0.5) AS p50 FROM rows GROUP BY 1, 2, 3),
  c AS (SELECT a.sex, a.birth_year, a.season, b.season AS used, b.n, round(b.p50, 4) AS p50, row_number() OVER (PARTITION BY a.sex, a.birth_year, a.season
    ORDER BY b.n < 60, abs(b.season - a.season), b.n DESC, b.season) AS k FROM p a JOIN p b ON a.sex = b.sex AND a.birth_year = b.birth_year AND abs(a.season - b.season) <= 2)
  SELECT sex, birth_year, season, used, n, p50 FROM c WHERE k = 1""")  # fmt: skip
def nearest_year_fallback(spark, d):
    p = rows(spark, d).groupBy("sex", "birth_year", "season").agg(F.countDistinct("athlete").alias("n"), quantile(F.col("value"), 0.5).alias("p50"))
    a = p.select("sex", "birth_year", "season", F.explode(F.sequence(F.col("season") - 2, F.col("season") + 2)).alias("used"))
    b = p.withColumnRenamed("season", "used")
    order = [F.col("n") < 60, F.abs(F.col("used") - F.col("season")), F.desc("n"), F.col("used")]
    k = F.row_number().over(W.partitionBy("sex", "birth_year", "season").orderBy(*order))
    c = a.join(b, ["sex", "birth_year", "used"]).withColumn("k", k).where("k = 1")
    return c.select("sex", "birth_year", "season", "used", "n", F.round("p50", 4).alias("p50"))


@query("""WITH g AS (SELECT l_linenumber AS y, l_returnflag AS f, quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS q FROM lineitem GROUP BY 1, 2),
  l AS (SELECT *, lag(q[2]) OVER (PARTITION BY f ORDER BY y) AS before FROM g)
  SELECT f AS flag, CAST(y AS BIGINT) AS line, q[1] <= q[2] AND q[2] <= q[3] AS monotone, round(abs(q[2] - before) / before, 6) AS jump FROM l""")  # fmt: skip
def quality_audit(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("y"), F.col("l_returnflag").alias("flag")).agg(F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    before = F.lag(F.col("q")[1]).over(W.partitionBy("flag").orderBy("y"))
    q = F.col("q")
    return g.select("flag", F.col("y").cast("long").alias("line"), ((q[0] <= q[1]) & (q[1] <= q[2])).alias("monotone"), F.round(F.abs(q[1] - before) / before, 6).alias("jump"))


# Diagnostics and trajectories


@query("""SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END), ''), nullif(trim(o_orderpriority), ''), '') AS label,
  coalesce(nullif(trim(o_orderstatus), ''), '') AS status FROM orders""")  # fmt: skip
def alias_coalesce(spark, d):
    from paceline.sources.tables import with_aliases

    o = table(spark, d, "orders").withColumn("old", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")))
    named = with_aliases(o, {"key": ["o_orderkey"], "label": ["old", "missing", "o_orderpriority"], "status": ["state", "o_orderstatus"]})
    return named.select(F.col("key").cast("long").alias("o_orderkey"), "label", "status")


@query(f"""WITH {FACTS_SQL}, c AS (SELECT season, stage AS b, CASE WHEN n_rows >= 4 THEN 'college' WHEN n_rows >= 2 THEN 'high' ELSE 'middle' END AS a FROM facts)
  SELECT season, count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS n_agree, round(avg(CASE WHEN a = b THEN 100.0 ELSE 0.0 END), 2) AS agree_pct,
  avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) >= 0.2 AND count(*) >= 100 AS ready FROM c GROUP BY 1""")  # fmt: skip
def class_agreement(spark, d):
    a = F.when(F.col("n_rows") >= 4, "college").when(F.col("n_rows") >= 2, "high").otherwise("middle")
    same = (a == F.col("stage")).cast("long")
    g = facts(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.sum(same).alias("n_agree"), F.round(F.avg(same) * 100, 2).alias("agree_pct"), F.avg(same).alias("m"))
    return g.withColumn("ready", (F.col("m") >= 0.2) & (F.col("n") >= 100)).drop("m")


@query(f"""WITH {ROWS_SQL}, f AS (SELECT athlete, sex, code, value FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY date, race) AS k FROM rows) WHERE k = 1),
  s AS (SELECT sex, avg(value) AS m FROM f GROUP BY 1), c AS (SELECT sex, code, count(*) AS n, quantile_cont(value, 0.5) AS p50, stddev_samp(value) AS sd FROM f GROUP BY 1, 2)
  SELECT c.sex, c.code, c.n, round(least(1.0, c.n / 50.0) * p50 + (1 - least(1.0, c.n / 50.0)) * s.m, 4) AS prior, round(sd, 4) AS sd FROM c JOIN s ON c.sex = s.sex""")  # fmt: skip
def debut_priors(spark, d):
    first = marts.best_by_priority(rows(spark, d), ["athlete"], F.col("date"), F.col("race"))
    whole = first.groupBy("sex").agg(F.avg("value").alias("m"))
    cells = first.groupBy("sex", "code").agg(F.count("*").alias("n"), quantile(F.col("value"), 0.5).alias("p50"), F.stddev_samp("value").alias("sd"))
    w = F.least(F.lit(1.0), F.col("n") / 50.0)
    return cells.join(whole, "sex").select("sex", "code", "n", F.round(w * F.col("p50") + (1 - w) * F.col("m"), 4).alias("prior"), F.round("sd", 4).alias("sd"))


@query("""WITH q AS (SELECT quantile_cont(l_quantity, 0.333333) AS a, quantile_cont(l_quantity, 0.666667) AS b FROM lineitem),
  c AS (SELECT CASE WHEN l_quantity <= a THEN 'low' WHEN l_quantity <= b THEN 'middle' ELSE 'high' END AS sigma, CAST(least(floor(l_discount * 50), 4) AS BIGINT) AS mu, l_extendedprice AS v FROM lineitem, q)
  SELECT sigma, mu, count(*) AS n, round(avg(v), 4) AS mean FROM c GROUP BY 1, 2""")  # fmt: skip
def sigma_control_grid(spark, d):
    lines = table(spark, d, "lineitem")
    edges = lines.agg(quantile(F.col("l_quantity"), 0.333333).alias("a"), quantile(F.col("l_quantity"), 0.666667).alias("b"))
    sigma = F.when(F.col("l_quantity") <= F.col("a"), "low").when(F.col("l_quantity") <= F.col("b"), "middle").otherwise("high")
    mu = F.least(F.floor(F.col("l_discount") * 50), F.lit(4)).cast("long")
    c = lines.crossJoin(F.broadcast(edges)).select(sigma.alias("sigma"), mu.alias("mu"), "l_extendedprice")  # edges: one row
    return c.groupBy("sigma", "mu").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


SHARE_SQL = ROWS_SQL + """, a AS (SELECT athlete, sex, season - birth_year AS age, max(value) AS v FROM rows GROUP BY 1, 2, 3),
sh AS (SELECT athlete, sex, age, rank() OVER (PARTITION BY age, sex ORDER BY v DESC) / count(*) OVER (PARTITION BY age, sex) AS share FROM a),
best AS (SELECT athlete, min(share) FILTER (WHERE age <= 14) AS early, min(share) FILTER (WHERE age > 14) AS late FROM sh GROUP BY 1)"""


def _best_shares(spark, d):
    a = rows(spark, d).groupBy("athlete", "sex", (F.col("season") - F.col("birth_year")).alias("age")).agg(F.max("value").alias("v"))
    w = W.partitionBy("age", "sex")
    sh = a.withColumn("share", F.rank().over(w.orderBy(F.desc("v"))) / F.count("*").over(w))
    part = lambda c: F.min(F.when(c, F.col("share")))
    return sh.groupBy("athlete").agg(part(F.col("age") <= 14).alias("early"), part(F.col("age") > 14).alias("late"))


@query(f"""WITH {SHARE_SQL} SELECT t AS top, count(*) FILTER (WHERE early <= t) AS n_early, count(*) FILTER (WHERE late <= t) AS n_late, count(*) FILTER (WHERE early <= t AND late <= t) AS n_both,
  round(count(*) FILTER (WHERE early <= t AND late <= t) * 100.0 / nullif(count(*) FILTER (WHERE early <= t), 0), 2) AS late_given_early,
  round(count(*) FILTER (WHERE early <= t AND late <= t) * 100.0 / nullif(count(*) FILTER (WHERE late <= t), 0), 2) AS early_given_late
  FROM best, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) v(t) GROUP BY 1""")  # fmt: skip
def bidirectional_rates(spark, d):
    t = _best_shares(spark, d).select("*", F.explode(F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5))).alias("top"))
    e, l = F.col("early") <= F.col("top"), F.col("late") <= F.col("top")
    g = t.groupBy("top").agg(F.count_if(e).alias("n_early"), F.count_if(l).alias("n_late"), F.count_if(e & l).alias("n_both"))
    pct = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_both") * 100.0 / F.col(n), 2))
    return g.select("*", pct("n_early").alias("late_given_early"), pct("n_late").alias("early_given_late"))


@query(f"""WITH {SHARE_SQL} SELECT athlete, round(early, 6) AS early, round(late, 6) AS late FROM best WHERE late <= 0.1 AND (early IS NULL OR early > 0.5)""")
def late_bloomers(spark, d):
    b = _best_shares(spark, d).where("late <= 0.1 and (early is null or early > 0.5)")
    return b.select("athlete", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"))


@query(f"""WITH {FACTS_SQL}, x AS (SELECT athlete, season, season - birth_year AS age FROM facts),
  j AS (SELECT x.age, x.athlete, max(CASE WHEN n.athlete IS NOT NULL THEN 1 ELSE 0 END) AS stayed FROM x LEFT JOIN x n ON x.athlete = n.athlete AND n.age = x.age + 1 GROUP BY 1, 2)
  SELECT age, count(*) AS n, CAST(sum(1 - stayed) AS BIGINT) AS n_left, round(avg(1 - stayed) * 100, 2) AS left_pct FROM j GROUP BY 1""")  # fmt: skip
def attrition(spark, d):
    x = facts(spark, d).select("athlete", (F.col("season") - F.col("birth_year")).alias("age")).distinct()
    after = x.select("athlete", (F.col("age") - 1).alias("age"), F.lit(1).alias("stayed"))
    g = x.join(after, ["athlete", "age"], "left").groupBy("age")
    gone = F.col("stayed").isNull().cast("long")
    return g.agg(F.count("*").alias("n"), F.sum(gone).alias("n_left"), F.round(F.avg(gone) * 100, 2).alias("left_pct"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size FROM part)
  SELECT a.name, a.id AS a, b.id AS b, CASE WHEN a.brand = b.brand AND abs(a.size - b.size) <= 5 THEN 'auto' WHEN a.brand = b.brand OR abs(a.size - b.size) <= 5 THEN 'review' ELSE 'reject' END AS verdict
  FROM p a JOIN p b ON a.name = b.name AND a.id < b.id""")  # fmt: skip
def dup_candidates(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return entity.duplicates(p)


@query(f"""WITH {FACTS_SQL}, x AS (SELECT DISTINCT athlete, stage, season FROM facts)
  SELECT a.stage AS stage_from, b.stage AS stage_to, count(DISTINCT a.athlete) AS n_bridges FROM x a JOIN x b ON a.athlete = b.athlete AND b.season = a.season + 1 AND a.stage <> b.stage GROUP BY 1, 2""")  # fmt: skip
def bridge_cells(spark, d):
    x = facts(spark, d).select("athlete", "stage", "season").distinct()
    after = x.select("athlete", (F.col("season") - 1).alias("season"), F.col("stage").alias("stage_to"))
    met = x.withColumnRenamed("stage", "stage_from").join(after, ["athlete", "season"]).where("stage_from <> stage_to")
    return met.groupBy("stage_from", "stage_to").agg(F.countDistinct("athlete").alias("n_bridges"))


@query(f"""WITH {ROWS_SQL}, q AS (SELECT sex, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM rows GROUP BY 1)
  SELECT race, round(CASE WHEN value <= q[1] THEN 8 WHEN value <= q[2] THEN 10 + 15 * (value - q[1]) / (q[2] - q[1]) WHEN value <= q[3] THEN 25 + 25 * (value - q[2]) / (q[3] - q[2])
    WHEN value <= q[4] THEN 50 + 25 * (value - q[3]) / (q[4] - q[3]) WHEN value <= q[5] THEN 75 + 15 * (value - q[4]) / (q[5] - q[4]) ELSE 94 END, 4) AS percentile FROM rows JOIN q USING (sex)""")  # fmt: skip
def piecewise_percentile(spark, d):
    r = rows(spark, d)
    q = r.groupBy("sex").agg(F.percentile("value", F.array(*map(F.lit, [0.1, 0.25, 0.5, 0.75, 0.9]))).alias("q"))
    v, at = F.col("value"), lambda i: F.col("q")[i]
    part = lambda i, low, wide: low + wide * (v - at(i)) / (at(i + 1) - at(i))
    p = F.when(v <= at(0), 8.0).when(v <= at(1), part(0, 10, 15)).when(v <= at(2), part(1, 25, 25)).when(v <= at(3), part(2, 50, 25)).when(v <= at(4), part(3, 75, 15)).otherwise(94.0)
    return r.join(F.broadcast(q), "sex").select("race", F.round(p, 4).alias("percentile"))


# Ratings (state over time: tests hold them against published and closed-form examples)


@query()
def glicko2_snapshots(spark, d):
    return ratings.snapshots(dated_entries(spark, d), ratings.Glicko2)


@query()
def trueskill_snapshots(spark, d):
    return ratings.snapshots(dated_entries(spark, d), ratings.TrueSkill)


@query()
def smoothed_ratings(spark, d):
    return ratings.smoothed(dated_entries(spark, d), ratings.TrueSkill)


# Sources


@query()
def html_rows(spark, d):
    from paceline.sources.tables import html_rows as rows_of

    return rows_of(table(spark, d, "pages"), "page_id", "html")
