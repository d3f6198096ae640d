"""The engine's inputs made from the driver's tables: race entries, participation rows and event histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalars import normalised_status, season_start
from paceline.operators import marts
from paceline.session import table

#: The same inputs in SQL, as common table expressions.
ENTRIES_SQL = """entries AS (SELECT l_orderkey AS race, l_suppkey AS athlete, max(l_extendedprice) AS score,
  min(l_quantity) AS time, CASE min(l_returnflag) WHEN 'A' THEN 'FIN' WHEN 'N' THEN 'DNF' ELSE 'PEN' END AS status
  FROM lineitem GROUP BY 1, 2)"""
RANKED_SQL = ENTRIES_SQL + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY race ORDER BY score DESC) AS rank FROM entries)"""
ROWS_SQL = """rows AS (SELECT o_custkey AS athlete, o_orderdate AS date, o_orderkey AS race,
  CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS BIGINT) AS season,
  1982 + o_custkey % 8 AS birth_year, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  o_orderdate AS meet, o_orderstatus AS code, o_totalprice AS value, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FACTS_SQL = ROWS_SQL + """,
facts AS (SELECT athlete, season, birth_year, sex, count(DISTINCT meet) AS n_meets, count(*) AS n_rows,
  array_to_string(list_sort(list(DISTINCT code)), '|') AS codes, season - birth_year - 6 AS grade,
  CASE WHEN season - birth_year - 6 <= 0 THEN 'excluded' WHEN season - birth_year - 6 <= 6 THEN 'elementary'
    WHEN season - birth_year - 6 <= 9 THEN 'middle' WHEN season - birth_year - 6 <= 12 THEN 'high' ELSE 'college' END AS stage
  FROM rows GROUP BY athlete, season, birth_year, sex)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """race, athlete, score, time, status, rank: a row for each supplier of an order. Lines are dealt
    by order once, which serves their sums, the ranks and joins by order."""
    lines = table(spark, d, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("athlete")).agg(
        F.max("l_extendedprice").alias("score"), F.min("l_quantity").alias("time"), F.min("l_returnflag").alias("flag")
    )
    from pyspark.sql import Window as W

    rank = F.rank().over(W.partitionBy("race").orderBy(F.desc("score"))).cast("long")
    return lines.withColumn("status", normalised_status(F.col("flag"))).drop("flag").withColumn("rank", rank)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """athlete, date, race, season, birth_year, sex, meet, code, value, priority: a row for each order."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").alias("athlete"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("race"),
        season_start(F.col("o_orderdate")).alias("season"), (F.col("o_custkey") % 8 + 1982).alias("birth_year"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"), F.col("o_orderdate").alias("meet"),
        F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    return marts.participation(rows(spark, d))


def dated_entries(spark: SparkSession, d: str) -> DataFrame:
    """entries with their race's date and month number (period)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("race"), F.col("o_orderdate").alias("date"))
    period = (F.year("date") * 12 + F.month("date")).cast("long")
    return entries(spark, d).join(o, "race").withColumn("period", period)
