"""Queries of backtests, identities, audits and graphs of divisions, each beside its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import domain as D
from paceline.operators import backtest as B
from paceline.operators import graph
from paceline.operators import identity as I
from paceline.plans.catalogue import query
from paceline.plans.proxy import ROWS_SQL, rows
from paceline.session import table
from paceline.storage import cut

# Predictions: a row for each line, its discount and quantity as probability

_PREDICTIONS = """preds AS (SELECT l_orderkey AS race, CASE WHEN (l_partkey * 7 + l_suppkey) % 100 < 20 + l_quantity THEN 1 ELSE 0 END AS actual,
  0.05 + l_quantity * 0.018 AS probability, l_partkey % 30 AS games, l_partkey % 20 AS age, l_quantity AS sigma, l_returnflag AS status FROM lineitem)"""
_P = "least(greatest(probability, 0.000001), 0.999999)"
_LOSS = f"-(actual * ln({_P}) + (1 - actual) * ln(1 - {_P}))"


def predictions(spark, d):
    hit = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100 < F.col("l_quantity") + 20
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("race"), hit.cast("int").alias("actual"), (F.col("l_quantity") * 0.018 + 0.05).alias("probability"),
        (F.col("l_partkey") % 30).alias("games"), (F.col("l_partkey") % 20).alias("age"), F.col("l_quantity").alias("sigma"), F.col("l_returnflag").alias("status"),
    )


_EVEN = "CAST('0x' || right(sha256(race || '|' || least(winner, loser) || '|' || greatest(winner, loser)), 1) AS INTEGER) % 2 = 0"


@query(f"""WITH p AS (SELECT l_orderkey AS race, l_suppkey AS winner, l_partkey + 1000000 AS loser FROM lineitem),
s AS (SELECT *, CASE WHEN {_EVEN} THEN least(winner, loser) ELSE greatest(winner, loser) END AS l FROM p)
SELECT race, l AS left, CASE WHEN l = winner THEN loser ELSE winner END AS right, CAST(l = winner AS BIGINT) AS label FROM s""")  # fmt: skip
def oriented_examples(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("winner"), (F.col("l_partkey") + 1000000).alias("loser"))
    return B.oriented(t)


@query(f"""WITH {ROWS_SQL}, s AS (SELECT season, count(*) AS n, row_number() OVER (ORDER BY season DESC) AS k FROM rows GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (WHERE k <= 2) AS BIGINT) AS n_held_out, min(season) FILTER (WHERE k <= 2) AS first_season,
  round(sum(n) FILTER (WHERE k <= 2) / sum(n), 6) AS share FROM s""")  # fmt: skip
def holdout_selection(spark, d):
    return B.held_out(rows(spark, d), "season")


@query(f"""WITH {_PREDICTIONS}, b AS (SELECT least(CAST(floor({_P} * 10) AS BIGINT), 9) AS bin, count(*) AS n, sum(actual) AS hits, sum({_P}) AS p FROM preds GROUP BY 1),
w AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(abs(hits - p)) AS off, CAST(coalesce(sum(n) FILTER (WHERE bin = 7), 0) AS BIGINT) AS m, coalesce(sum(hits) FILTER (WHERE bin = 7), 0) AS h FROM b)
SELECT n, round(off / n, 6) AS ece, m AS n_70, round(CASE WHEN m > 0 THEN h / m ELSE 0.0 END, 6) AS rate_70,
  coalesce((h / m + 1.9208 / m + 1.96 * sqrt(h / m * (1 - h / m) / m + 0.9604 / (m * m))) / (1 + 3.8416 / m) < 0.7, false) AS overconfident FROM w""")  # fmt: skip
def calibration_summary(spark, d):
    return B.calibration(predictions(spark, d))


@query(f"""WITH {_PREDICTIONS}, c AS (SELECT {_LOSS} AS loss, CASE WHEN games <= 5 THEN '0-5' WHEN games <= 20 THEN '6-20' ELSE '21+' END AS g,
  CASE WHEN age <= 0 THEN '(unknown-age)' WHEN age <= 12 THEN '<=12' WHEN age <= 15 THEN '13-15' ELSE '16+' END AS a,
  CASE WHEN sigma <= 17 THEN 'low' WHEN sigma <= 33 THEN 'mid' ELSE 'high' END AS s, status FROM preds),
u AS (SELECT 'games' AS segment, g AS bucket, loss FROM c UNION ALL SELECT 'age', a, loss FROM c UNION ALL SELECT 'sigma', s, loss FROM c UNION ALL SELECT 'status', status, loss FROM c)
SELECT segment, bucket, count(*) AS n, round(avg(loss), 6) AS log_loss FROM u GROUP BY 1, 2""")  # fmt: skip
def segment_losses(spark, d):
    bands = {"games": D.games_band(F.col("games")), "age": D.age_band(F.col("age")), "sigma": D.tercile_band(F.col("sigma"), F.lit(17.0), F.lit(33.0)), "status": F.col("status")}
    return B.segments(predictions(spark, d), bands)


@query(f"""WITH {_PREDICTIONS}, o AS (SELECT avg(actual) AS r, avg({_P}) AS p, avg(CASE WHEN ({_P} >= 0.5) = (actual = 1) THEN 1.0 ELSE 0.0 END) AS acc, avg({_LOSS}) AS l,
  avg(abs(actual - {_P})) AS off FROM preds)
SELECT 'labels_balanced' AS rule, r BETWEEN 0.4 AND 0.6 AS holds FROM o UNION ALL
SELECT 'loss_above_entropy', l >= -(acc * ln(acc) + (1 - acc) * ln(1 - acc)) - 0.1 FROM o UNION ALL SELECT 'labels_vary', abs(off - (1 - p)) >= 1e-6 FROM o""")  # fmt: skip
def harness_invariants(spark, d):
    return B.invariants(predictions(spark, d))


# Identities: customers as ids, their market segment and nation as names that many share

_KNOWN = """known AS (SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 3 = 0 THEN 'Kim ' ELSE 'kim-' END, CAST(c_custkey % 400 AS STRING)) AS name,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c_mktsegment AS region, 1982 + c_custkey % 8 AS birth_year,
  CASE WHEN c_custkey % 4 = 0 THEN 'A|B' WHEN c_custkey % 4 = 1 THEN ' A ' ELSE '' END AS affiliation, count(o_orderkey) AS n_rows,
  min(year(o_orderdate)) AS first_season, max(year(o_orderdate)) AS last_season FROM {c} LEFT JOIN {o} ON c_custkey = o_custkey GROUP BY ALL)"""
_KNOWN_SQL = _KNOWN.format(c="customer", o="orders")


def known(spark, d):
    return spark.sql("WITH " + _KNOWN + " SELECT * FROM known", c=table(spark, d, "customer"), o=table(spark, d, "orders"))


@query(f"""WITH {_KNOWN_SQL}, u AS (SELECT id, name, gender, region, affiliation FROM known UNION ALL SELECT id % 500, name, '', region, 'C' FROM known
  UNION ALL SELECT id, upper(name), gender, '', affiliation FROM known WHERE id % 2 = 0),
s AS (SELECT id, {", ".join(f"array_to_string(list_sort(list(DISTINCT nullif(trim({c}), '')) FILTER (WHERE nullif(trim({c}), '') IS NOT NULL)), '|') AS {c}s" for c in ("name", "gender", "region", "affiliation"))}, count(*) AS n_rows FROM u GROUP BY 1)
SELECT id, coalesce(names, '') AS names, coalesce(genders, '') AS genders, coalesce(regions, '') AS regions, coalesce(affiliations, '') AS affiliations, n_rows FROM s""")  # fmt: skip
def identity_profiles(spark, d):
    k = cut(known(spark, d)).select("id", "name", "gender", "region", "affiliation")
    two = k.select((F.col("id") % 500).alias("id"), "name", F.lit("").alias("gender"), "region", F.lit("C").alias("affiliation"))
    three = k.where("id % 2 = 0").select("id", F.upper("name").alias("name"), "gender", F.lit("").alias("region"), "affiliation")
    return I.profiles([k, two, three])


@query(f"""WITH {_KNOWN_SQL}, m AS (SELECT *, {", ".join(f"first({c}) OVER w AS m_{c}" for c in ("id", "gender", "region", "n_rows"))} FROM known
  WINDOW w AS (PARTITION BY name, birth_year ORDER BY n_rows DESC, id))
SELECT id AS sub, m_id AS main, name, CASE WHEN gender <> m_gender THEN 'reject' WHEN region = m_region AND n_rows <= 5 AND n_rows * 10 <= m_n_rows THEN 'auto_merge'
  WHEN region = m_region OR (n_rows <= 5 AND n_rows * 10 <= m_n_rows) THEN 'review' ELSE 'reject' END AS verdict FROM m WHERE id <> m_id""")  # fmt: skip
def merge_candidates(spark, d):
    return I.candidates(known(spark, d))


_CONFIRMED = "confirmed AS (SELECT c_custkey AS sub, c_custkey - 1 AS main FROM customer WHERE c_custkey % 5 = 0)"
_PROPOSED = "proposed AS (SELECT c_custkey AS sub, c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 2 END AS main FROM customer WHERE c_custkey % 5 < 2)"


def _merge_lists(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sub"))
    confirmed = c.where("sub % 5 = 0").withColumn("main", F.col("sub") - 1)
    return confirmed, c.where("sub % 5 < 2").withColumn("main", F.col("sub") - F.when(F.col("sub") % 10 == 0, 1).otherwise(2))


@query(f"""WITH {_CONFIRMED}, {_PROPOSED} SELECT coalesce(c.sub, p.sub) AS sub, coalesce(c.main, p.main) AS main,
  CASE WHEN c.sub IS NULL THEN 'proposed' WHEN p.main <> c.main THEN 'confirmed_over_other' ELSE 'confirmed' END AS source
FROM proposed p FULL JOIN confirmed c ON p.sub = c.sub""")  # fmt: skip
def merge_union(spark, d):
    return I.merged_lists(*_merge_lists(spark, d))


@query(f"""WITH {_KNOWN_SQL}, k AS (SELECT *, regexp_replace(lower(name), '[\\s\\-_.]+', '', 'g') AS key FROM known WHERE gender <> ''),
a AS (SELECT *, coalesce(first_season > max(last_season) OVER (PARTITION BY key, gender, birth_year ORDER BY first_season, last_season, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS apart FROM k)
SELECT key, gender, birth_year, count(DISTINCT id) AS n_ids, CASE WHEN count(DISTINCT name) > 1 THEN 'spelling'
  WHEN count(DISTINCT affiliation) > 1 AND bool_or(apart) THEN 'affiliation_change' ELSE 'namesake' END AS kind FROM a GROUP BY 1, 2, 3 HAVING count(DISTINCT id) > 1""")  # fmt: skip
def split_signals(spark, d):
    return I.split_signals(known(spark, d))


_TARGETS = """SELECT o_orderkey AS id, year(o_orderdate) AS year, CASE o_custkey % 4 WHEN 0 THEN concat('National Winter Games ', CAST(o_custkey % 9 AS STRING))
  WHEN 1 THEN 'President Cup' WHEN 2 THEN concat('open ', CAST(o_custkey % 5 AS STRING)) ELSE 'Cup' END AS name FROM {o}"""
_INDEX = """SELECT 1990 + c_custkey % 15 AS year, CASE c_custkey % 5 WHEN 0 THEN concat('national-winter-games ', CAST(c_custkey % 9 AS STRING)) WHEN 1 THEN 'The President Cup (final)'
  WHEN 2 THEN concat('OPEN', CAST(c_custkey % 5 AS STRING)) ELSE 'President  Cup' END AS name, concat('m', CAST(c_custkey % 50 AS STRING)) AS code, CAST(c_custkey % 2 + 1 AS STRING) AS class FROM {c}"""
_BARE = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""WITH t AS (SELECT *, {_BARE.format('name')} AS k FROM ({_TARGETS.format(o='orders')})), i AS (SELECT *, {_BARE.format('name')} AS k FROM ({_INDEX.format(c='customer')})),
m AS (SELECT t.id, i.code, i.class, CASE WHEN t.k = i.k THEN 3 WHEN (contains(t.k, i.k) OR contains(i.k, t.k)) AND least(length(t.k), length(i.k)) >= 8 THEN 2 ELSE 0 END AS s FROM t JOIN i ON t.year = i.year),
g AS (SELECT id, s, list(DISTINCT code) AS codes, list(DISTINCT code) FILTER (WHERE class = '2') AS liked FROM m WHERE s > 0 GROUP BY 1, 2),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1),
c AS (SELECT t.id, b.s, CASE WHEN len(codes) = 1 THEN codes[1] WHEN len(liked) = 1 THEN liked[1] END AS code FROM t LEFT JOIN b ON t.id = b.id)
SELECT id, coalesce(code, '') AS code, CASE WHEN s IS NULL THEN 'name-not-matched' WHEN code IS NULL THEN 'ambiguous' ELSE 'matched' END AS status FROM c""")  # fmt: skip
def fuzzy_meet_match(spark, d):
    targets, index = spark.sql(_TARGETS, o=table(spark, d, "orders")), spark.sql(_INDEX, c=table(spark, d, "customer"))
    return I.matched_meets(targets, index, "2")


@query(f"""WITH {_CONFIRMED}, r AS (SELECT o_orderkey % 700 AS race, coalesce(main, o_custkey) AS athlete FROM orders LEFT JOIN confirmed ON o_custkey = sub)
SELECT race, athlete, count(*) OVER (PARTITION BY race, athlete) > 1 AS collides FROM r""")  # fmt: skip
def identity_merge(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 700).alias("race"), F.col("o_custkey").alias("athlete"))
    return I.merged_ledger(t, _merge_lists(spark, d)[0]).select("race", "athlete", "collides")


@query("""SELECT c_custkey AS athlete, CASE WHEN max(o_orderkey) IS NULL THEN 'no_history' WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'has_target'
  ELSE 'other_meets_only' END AS coverage FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip
def participant_coverage(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("athlete"))
    return I.coverage_class(people, table(spark, d, "orders").withColumnRenamed("o_custkey", "athlete"), F.col("o_orderstatus") == "F")


@query(f"WITH {_KNOWN_SQL}, e AS (SELECT trim(unnest(string_split(affiliation, '|'))) AS item FROM known) SELECT item, count(*) AS n FROM e WHERE item <> '' GROUP BY 1")
def affiliation_counts(spark, d):
    return I.exploded_counts(known(spark, d), "affiliation")


@query("""WITH b AS (SELECT c_nationkey AS t, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
SELECT CASE WHEN n >= 60 THEN CAST(t AS VARCHAR) ELSE '(small)' END AS team, CAST(sum(n) AS BIGINT) AS n_athletes, count(*) AS n_teams FROM b GROUP BY 1""")  # fmt: skip
def team_breakdown(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("athlete"), F.col("c_nationkey").cast("string").alias("team"))
    return I.folded_counts(t, "team", 60)


@query(f"""WITH {ROWS_SQL}, a AS (SELECT athlete, season, quantile_cont(season - birth_year - (race % 4), 0.5) AS age FROM rows GROUP BY 1, 2),
b AS (SELECT *, lag(age) OVER (PARTITION BY athlete ORDER BY season) AS p FROM a)
SELECT athlete, count(*) AS n_seasons, CAST(sum(CASE WHEN age < p THEN 1 ELSE 0 END) AS BIGINT) AS n_reversals FROM b GROUP BY 1""")  # fmt: skip
def age_reversals(spark, d):
    return I.age_reversals(rows(spark, d).select("athlete", "season", (F.col("season") - F.col("birth_year") - F.col("race") % 4).alias("age")))


_YEARS = """SELECT o_orderkey AS row, o_custkey AS athlete, o_orderkey % 90 AS meet, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 90 > 20 THEN CAST(year(o_orderdate) AS BIGINT) END AS year,
  CASE WHEN o_orderkey % 90 > 5 THEN 2000 + o_orderkey % 90 END AS numbered FROM {o}"""


@query(f"""WITH t AS ({_YEARS.format(o="orders")}), w AS (SELECT *, min(year) OVER (PARTITION BY athlete, meet) AS a, min(year) OVER (PARTITION BY meet) AS m FROM t)
SELECT "row", coalesce(year, a, m, numbered) AS year, CASE WHEN year IS NOT NULL THEN 'own' WHEN a IS NOT NULL THEN 'athlete' WHEN m IS NOT NULL THEN 'meet'
  WHEN numbered IS NOT NULL THEN 'number' ELSE 'none' END AS source FROM w""")  # fmt: skip
def filled_years(spark, d):
    return I.filled_years(spark.sql(_YEARS, o=table(spark, d, "orders")))


@query(f"""WITH {ROWS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY athlete, season - birth_year ORDER BY date DESC, value DESC) AS n FROM rows)
SELECT athlete, season - birth_year AS age, value AS mu FROM k WHERE n = 1""")  # fmt: skip
def last_by_age(spark, d):
    return I.last_by_age(rows(spark, d).select("athlete", (F.col("season") - F.col("birth_year")).alias("age"), F.col("date").alias("day"), F.col("value").alias("mu")))


_BORN = "SELECT o_custkey AS athlete, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 1990 ELSE 1980 + o_custkey % 8 END AS birth_year FROM {o}"


@query(f"""WITH b AS (SELECT athlete, count(DISTINCT birth_year) AS n FROM ({_BORN.format(o="orders")}) GROUP BY 1)
SELECT count(*) AS n_athletes, count(*) FILTER (WHERE n = 0) AS n_missing, count(*) FILTER (WHERE n > 1) AS n_conflicts,
  round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_one FROM b""")  # fmt: skip
def birth_audit(spark, d):
    return I.birth_audit(spark.sql(_BORN, o=table(spark, d, "orders")))


# Graphs by season and gender, and of divisions


@query()
def graph_shares(spark, d):
    """Components of every season's own graph of athletes in one meet, in one run: a node is an athlete in a season."""
    r = rows(spark, d).select("season", "athlete", F.concat_ws("|", "season", "meet", F.col("value").cast("long") % 7).alias("race"))
    keyed = r.select("race", F.concat_ws("|", F.col("season").cast("string"), F.col("athlete").cast("string")).alias("athlete"))
    found = graph.memberships(keyed).withColumn("graph", F.substring_index("athlete", "|", 1))
    return I.component_shares(found)


_DIVISIONS = "SELECT o_custkey AS athlete, CAST(year(o_orderdate) AS BIGINT) AS season, concat(o_orderpriority, CASE WHEN o_custkey % 40 = 3 THEN ' x' ELSE '' END) AS division FROM {o}"


@query(f"""WITH o AS (SELECT DISTINCT athlete, division FROM ({_DIVISIONS.format(o="orders")}))
SELECT a.division AS one, b.division AS two, count(*) AS n_athletes FROM o a JOIN o b ON a.athlete = b.athlete AND a.division < b.division GROUP BY 1, 2""")  # fmt: skip
def division_links(spark, d):
    return I.division_links(spark.sql(_DIVISIONS, o=table(spark, d, "orders")))


@query(f"""WITH o AS (SELECT DISTINCT athlete, season, division || CASE WHEN athlete % 40 = 3 THEN athlete ELSE 0 END AS division FROM ({_DIVISIONS.format(o="orders")})),
m AS (SELECT *, count(*) OVER (PARTITION BY athlete, season) AS n FROM o)
SELECT season, division, count(*) AS n_athletes FROM m GROUP BY 1, 2 HAVING max(n) = 1""")  # fmt: skip
def isolated_cells(spark, d):
    t = spark.sql(_DIVISIONS, o=table(spark, d, "orders"))
    own = F.when(F.col("athlete") % 40 == 3, F.col("athlete")).otherwise(0).cast("string")
    return I.isolated_cells(t.withColumn("division", F.concat("division", own)))
