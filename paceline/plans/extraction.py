"""Queries of the extraction steps, over raw result sheets made from the driver's tables.

The sheets' SQL is the same in Spark and in DuckDB, so the queries and their oracles read equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import domain as D
from paceline.functions.scalars import first_int, parse_seconds
from paceline.operators import extraction as X
from paceline.plans.catalogue import query
from paceline.session import table
from paceline.storage import cut

#: Result sheets: a race for each order, a row for each of its lines.
RAW = """SELECT CASE WHEN l_suppkey % 29 = 0 THEN '' ELSE concat('a', CAST(l_suppkey AS STRING)) END AS athlete_id, '' AS race_id,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('m', CAST(o_custkey % 30 AS STRING)) END AS meet_id,
  CASE o_custkey % 4 WHEN 0 THEN '전국 스피드 대회' WHEN 1 THEN '회장배 쇼트트랙 대회' WHEN 2 THEN concat('제', CAST(88 + o_custkey % 20 AS STRING), '회 전국동계체육대회')
    ELSE '스피드 쇼트트랙 축전' END AS meet_name,
  CASE WHEN o_orderkey % 100 = 2 THEN CAST(year(o_orderdate) AS STRING) ELSE '' END AS season_text,
  CASE o_orderkey % 4 WHEN 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '.') WHEN 2 THEN CASE WHEN o_orderkey % 100 = 2 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END
    WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 폐막') END AS date,
  CASE o_orderkey % 7 WHEN 0 THEN '500M' WHEN 1 THEN '1000 m' WHEN 2 THEN '1500 M S.F' WHEN 3 THEN '3000m 계주' WHEN 4 THEN '' WHEN 5 THEN ' 1000M|A' ELSE '500m SF' END AS event,
  CASE o_custkey % 10 WHEN 0 THEN '남자 초등부' WHEN 1 THEN '여자중학부' WHEN 2 THEN '남고부' WHEN 3 THEN '여자 대학·일반' WHEN 4 THEN '동호인부' WHEN 5 THEN '남자부'
    WHEN 6 THEN '유치부' WHEN 7 THEN '12세 이하' WHEN 8 THEN 'nan' ELSE '주니어-A' END AS category,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '남자' ELSE '여' END AS gender,
  CASE o_orderkey % 5 WHEN 0 THEN '500' WHEN 1 THEN '1000' WHEN 2 THEN '' WHEN 3 THEN '777' ELSE '1500' END AS distance_text,
  CASE o_orderkey % 9 WHEN 0 THEN '결승' WHEN 1 THEN '준결승 2조' WHEN 2 THEN '예선 13 조' WHEN 3 THEN '준준결승 1조' WHEN 4 THEN '결승 B' WHEN 5 THEN '3조' WHEN 6 THEN '채점 종합'
    WHEN 7 THEN '예선 Heat 4' ELSE '순위전' END AS round,
  CASE WHEN o_orderkey % 10 = 0 THEN '결승' WHEN o_orderkey % 10 = 1 THEN 'none' ELSE '' END AS round_kind,
  CASE WHEN o_orderkey % 7 = 2 THEN 'y' ELSE '' END AS sf_flag,
  CASE o_orderkey % 9 WHEN 0 THEN '3' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '' END AS class_cd,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS STRING) END AS race_seq,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat(CAST(l_linenumber AS STRING), '위') END AS place,
  CASE WHEN l_suppkey % 6 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN concat('1:', CAST(10 + l_partkey % 50 AS STRING), '.5') ELSE concat(CAST(40 + l_partkey % 60 AS STRING), '.25') END AS time,
  CASE l_suppkey % 13 WHEN 0 THEN '실격' WHEN 1 THEN 'DNF' WHEN 2 THEN '출발전포기' WHEN 3 THEN 'ok' WHEN 4 THEN 'PEN (yellow)' WHEN 5 THEN '경기중 기권'
    WHEN 6 THEN 'V-SR' WHEN 7 THEN 'adv' WHEN 8 THEN '기타 사유' WHEN 9 THEN 'No Time' ELSE '' END AS status,
  CASE WHEN l_suppkey % 17 = 0 THEN 'ADV A' ELSE '' END AS advanced,
  CASE l_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN '년' WHEN 2 THEN concat(CAST(1980 + l_suppkey % 20 AS STRING), '년') WHEN 3 THEN CAST(1980 + l_suppkey % 20 AS STRING)
    WHEN 4 THEN '1991.3' ELSE '91' END AS birth_year,
  o_orderkey AS race_no, l_linenumber AS line
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
RAW_SQL = "raw AS (" + RAW.format(lineitem="lineitem", orders="orders") + ")"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RAW, lineitem=table(spark, d, "lineitem"), orders=table(spark, d, "orders"))


# The same expressions in DuckDB


def _norm(c: str) -> str:
    return f"(CASE WHEN lower(trim(coalesce({c}, ''))) IN ('none', 'nan') THEN '' ELSE trim(coalesce({c}, '')) END)"


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_INT = "TRY_CAST(nullif(regexp_extract({}, '([0-9]+)', 1), '') AS BIGINT)"
_ROUND_TEXT = f"replace(coalesce(nullif({_norm('round_kind')}, ''), {_norm('round')}), ' ', '')"
_ROUND = f"""CASE WHEN contains({_ROUND_TEXT}, '채점종합') THEN 'score' WHEN starts_with({_ROUND_TEXT}, '결승B') THEN 'final_b'
  WHEN starts_with({_ROUND_TEXT}, '결승') THEN 'final' WHEN contains({_ROUND_TEXT}, '준준결승') THEN 'quarterfinal'
  WHEN contains({_ROUND_TEXT}, '준결승') THEN 'semifinal' WHEN contains({_ROUND_TEXT}, '예선') THEN 'heat' ELSE 'other' END"""
_HEAT = f"regexp_extract(regexp_extract({_norm('round')}, '(?i)[0-9]+\\s*조|heat\\s*[0-9]+'), '[0-9]+')"
_KEY = f"regexp_replace(upper({_norm('category')}), '[\\s\\-_/·.]+', '', 'g')"
_OPEN = "(" + ", ".join(f"'{x}'" for x in D.OPEN_CATEGORIES) + ")"
_STAGE = (
    f"CASE WHEN {_KEY} = '' THEN 'excluded' WHEN {_KEY} IN {_OPEN} THEN 'open' "
    + " ".join(f"WHEN {_any(_KEY, words)} THEN '{stage}'" for _, stage, words in D.CATEGORY_WORDS) + " ELSE 'excluded' END"
)
_RULE = (
    f"CASE WHEN {_KEY} = '' THEN 'empty' WHEN {_KEY} IN {_OPEN} THEN 'open' "
    + " ".join(f"WHEN {_any(_KEY, words)} THEN '{rule}'" for rule, _, words in D.CATEGORY_WORDS) + " ELSE 'other' END"
)
_PREFIX = f"regexp_extract({_norm('category')}, '^(남자|여자|남|여)', 1)"
_GENDER = f"substr(coalesce(nullif({_norm('gender')}, ''), {_PREFIX}), 1, 1)"
_BAND = f"trim(substr({_norm('category')}, length({_PREFIX}) + 1))"
_DIVISION = f"(coalesce(nullif({_GENDER}, ''), '-') || ':' || coalesce(nullif({_BAND}, ''), '-'))"
_EVENT = f"""(CASE WHEN {_norm('event')} <> '' THEN {_norm('event')} WHEN {_norm('category')} <> '' AND {_norm('distance_text')} <> ''
  THEN {_norm('category')} || '-' || {_norm('distance_text')} || 'm' WHEN {_norm('category')} <> '' THEN {_norm('category')} ELSE {_norm('distance_text')} END)"""
_MEET = f"""(CASE WHEN {_norm('meet_id')} <> '' THEN replace({_norm('meet_id')}, '|', '/') ELSE {_norm('season_text')} || ':' || {_norm('meet_name')} END)"""
_ROUND_NAME = f"coalesce(nullif({_norm('round')}, ''), {_norm('round_kind')})"
_RACE = f"""(CASE WHEN {_MEET} <> '' AND {_EVENT} <> '' AND {_ROUND_NAME} <> '' AND {_DIVISION} <> '-:-' THEN concat_ws('|', {_MEET}, replace({_DIVISION}, '|', '/'),
  replace({_EVENT}, '|', '/'), replace({_ROUND_NAME}, '|', '/'), coalesce(nullif({_HEAT}, ''), '-'), coalesce(nullif(upper({_norm('sf_flag')}), ''), '-'),
  coalesce(nullif({_norm('date')}, ''), '-')) ELSE '' END)"""
_RELAY = f"regexp_matches(concat_ws(' ', {_norm('event')}, {_norm('round')}, {_norm('round_kind')}, {_norm('meet_name')}, {_norm('category')}), '(?i)릴레이|relay|계주')"
_DISCIPLINE = f"""(CASE WHEN {_norm('class_cd')} IN ('1', '3') THEN {_norm('class_cd')}
  WHEN ({_ROUND}) = 'other' AND regexp_matches(replace({_norm('round')}, ' ', ''), '^[0-9]+조$') THEN '1'
  WHEN contains({_norm('meet_name')}, '스피드') AND NOT contains({_norm('meet_name')}, '쇼트트랙') THEN '1' ELSE '2' END)"""
_PLACE = _INT.format(_norm("place"))
_SECONDS = """(CASE WHEN contains(time, ':') THEN CAST(split_part(time, ':', 1) AS DOUBLE) * 60 + CAST(split_part(time, ':', 2) AS DOUBLE)
  ELSE TRY_CAST(time AS DOUBLE) END)"""
_S = f"lower({_norm('status')})"
_STATUS = f"""(CASE WHEN contains(lower({_norm('advanced')}), 'adv') OR contains({_S}, 'adv') THEN 'ADV'
  WHEN {_S} IN ({", ".join(f"'{x}'" for x in D.FINISH_WORDS)}) THEN CASE WHEN {_PLACE} IS NULL AND {_SECONDS} IS NULL THEN 'DNS' ELSE 'FIN' END
  WHEN {_any(_S, D.PENALTY_WORDS)} THEN 'PEN' WHEN {_any(_S, D.NO_START_WORDS)} THEN 'DNS' WHEN {_any(_S, D.NO_FINISH_WORDS)} THEN 'DNF'
  WHEN {_PLACE} IS NOT NULL OR {_SECONDS} IS NOT NULL THEN 'FIN' ELSE 'UNKNOWN' END)"""
_SEASON = f"""coalesce(CASE WHEN {_INT.format(_norm('season_text'))} BETWEEN 1900 AND 2099 THEN {_INT.format(_norm('season_text'))} END,
  TRY_CAST(nullif(regexp_extract({_norm('date')}, '((?:19|20)[0-9]{{2}})', 1), '') AS BIGINT))"""
CANONICAL_SQL = f"""{RAW_SQL}, canon AS (SELECT athlete_id, meet_id, date, {_norm('round')} AS round, {_norm('round_kind')} AS round_kind, {_EVENT} AS event, {_PLACE} AS place_num,
  {_INT.format(_norm('race_seq'))} AS seq, {_SECONDS} AS time_sec, {_SEASON} AS season, {_ROUND} AS round_class, {_RELAY} AS is_relay,
  contains({_norm('category')}, '동호인') AS is_hobby, {_GENDER} AS gender, {_DIVISION} AS division, {_DISCIPLINE} AS discipline,
  {_STATUS} AS status_norm, {_HEAT} AS heat_text, {_RACE} AS race_id FROM raw)"""
REASON_SQL = """CASE WHEN athlete_id = '' THEN 'no_athlete' WHEN race_id = '' THEN 'no_race' WHEN discipline <> '2' THEN 'discipline'
  WHEN is_relay THEN 'relay' WHEN round_class = 'score' THEN 'score_round' WHEN coalesce(season, 0) < {season} THEN 'season' WHEN is_hobby THEN 'hobby' ELSE 'kept' END"""
#: The driver's orders end in 2001, so the policies' first season is set back.
MIN_SEASON = 1990
CONSERVATIVE = X.Policy(min_season=MIN_SEASON)
AGGRESSIVE = X.Policy("last_place", "loss_to_finishers", "keep", X.POLICIES["aggressive"].rounds, min_season=MIN_SEASON)
PLACE_ONLY = X.Policy("last_place", "exclude", "keep", ("final", "final_b"), min_season=MIN_SEASON)


def _placed_sql(policy: X.Policy) -> str:
    rounds = ", ".join(f"'{r}'" for r in policy.rounds)
    gone = ["'DNS'"] + [f"'{s}'" for s, r in (("PEN", policy.penalty), ("DNF", policy.no_finish), ("ADV", policy.advanced)) if r == "exclude"]
    return f"""{CANONICAL_SQL}, prep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id, athlete_id
    ORDER BY place_num NULLS LAST, time_sec NULLS LAST, meet_id, date, round, round_kind, event, seq NULLS FIRST, season NULLS FIRST, round_class, is_relay, is_hobby, gender, division, discipline, status_norm) AS k
  FROM canon WHERE {REASON_SQL.format(season=policy.min_season)} = 'kept' AND round_class IN ({rounds})) WHERE k = 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n_rows, coalesce(max(place_num) OVER (PARTITION BY race_id), 0) AS last,
  row_number() OVER (PARTITION BY race_id, status_norm ORDER BY athlete_id) AS nth FROM prep),
people AS (SELECT *, CASE WHEN status_norm = 'PEN' THEN last + nth WHEN status_norm <> 'DNF' AND place_num > 0 THEN place_num END AS effective
  FROM sized WHERE n_rows >= 2 AND status_norm NOT IN ({", ".join(gone)}))"""


def _compare_sql(policy: X.Policy) -> str:
    out = f"""WITH {_placed_sql(policy)}, ranked AS (SELECT * FROM people WHERE effective IS NOT NULL AND status_norm IN ('FIN', 'ADV', 'PEN'))
SELECT a.race_id, a.athlete_id AS winner, b.athlete_id AS loser, a.effective AS winner_place, b.effective AS loser_place,
  a.status_norm || '-' || b.status_norm AS statuses, a.round_class, a.season, 1.0::DOUBLE AS weight
FROM ranked a JOIN ranked b ON a.race_id = b.race_id AND a.effective < b.effective"""
    if policy.no_finish == "loss_to_finishers":
        out += """ UNION ALL SELECT a.race_id, a.athlete_id, b.athlete_id, a.effective, NULL, a.status_norm || '-DNF', a.round_class, a.season, 1.0::DOUBLE
FROM ranked a JOIN people b ON a.race_id = b.race_id AND b.status_norm = 'DNF' WHERE a.status_norm <> 'PEN'"""
    return out


_DATE_FORM = "((?:19|20)[0-9]{2})[^0-9]*([0-9]{1,2})[^0-9]*([0-9]{1,2})"
_DATE = (
    f"try_strptime(regexp_extract(date, '{_DATE_FORM}', 1) || '-' || regexp_extract(date, '{_DATE_FORM}', 2) || '-' || regexp_extract(date, '{_DATE_FORM}', 3), '%Y-%m-%d')"
)
_ORDER = "event, CASE round_class WHEN 'heat' THEN 1 WHEN 'quarterfinal' THEN 2 WHEN 'semifinal' THEN 3 WHEN 'final_b' THEN 4 WHEN 'final' THEN 5 WHEN 'other' THEN 9 ELSE 99 END, heat, round_kind, race_id"
_PAD = "lpad(CAST({0} AS VARCHAR), CAST(greatest(4, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
LEDGER_SQL = f"""{_placed_sql(AGGRESSIVE)}, ranked AS (SELECT *, CASE WHEN status_norm = 'DNF' THEN top + behind ELSE effective END AS rank FROM (
  SELECT *, coalesce(max(effective) OVER (PARTITION BY race_id), 0) AS top,
    row_number() OVER (PARTITION BY race_id, status_norm ORDER BY time_sec NULLS LAST, athlete_id) AS behind FROM people)),
told AS (SELECT * REPLACE (coalesce(CAST(year({_DATE}) - CASE WHEN month({_DATE}) < 7 THEN 1 ELSE 0 END AS BIGINT), season) AS season),
  coalesce(strftime({_DATE}, '%Y%m%d'), season || '0101', '00000000') AS day, coalesce(nullif(replace(meet_id, '|', '/'), ''), '-') AS meet,
  coalesce(CAST(nullif(heat_text, '') AS BIGINT), 0) AS heat FROM ranked WHERE rank > 0),
races AS (SELECT race_id, min(day) AS day, min(meet) AS meet, min(seq) AS seq, min(event) AS event, min(round_class) AS round_class, min(heat) AS heat,
  min(round_kind) AS round_kind FROM told GROUP BY 1),
marked AS (SELECT *, CASE WHEN seq > 0 AND row_number() OVER (PARTITION BY day, meet, seq ORDER BY {_ORDER}) = 1 THEN seq END AS explicit FROM races),
slots AS (SELECT f.day, f.meet, f.s, row_number() OVER (PARTITION BY f.day, f.meet ORDER BY f.s) AS k FROM (
  SELECT g.day, g.meet, u.s FROM (SELECT day, meet, count(*) AS n FROM marked GROUP BY 1, 2) g, unnest(range(1, 2 * n + 10)) u(s)) f
  LEFT JOIN marked m ON m.day = f.day AND m.meet = f.meet AND m.explicit = f.s WHERE m.race_id IS NULL),
waiting AS (SELECT *, row_number() OVER (PARTITION BY day, meet ORDER BY {_ORDER}) AS k FROM marked WHERE explicit IS NULL),
seqs AS (SELECT race_id, day, meet, explicit AS race_seq FROM marked WHERE explicit IS NOT NULL
  UNION ALL SELECT w.race_id, w.day, w.meet, s.s FROM waiting w JOIN slots s ON w.day = s.day AND w.meet = s.meet AND w.k = s.k),
book AS (SELECT concat_ws('|', q.day, q.meet, {_PAD.format('q.race_seq')}, replace(t.race_id, '|', '/')) AS race_ordering_key, t.race_id, t.athlete_id, t.rank,
  t.status_norm AS status, q.day, q.meet, q.race_seq, t.season, t.round_class, 1.0::DOUBLE AS weight FROM told t JOIN seqs q USING (race_id)),
keyed AS (SELECT race_ordering_key, concat_ws('|', race_ordering_key, {_PAD.format('rank')}, athlete_id) AS ordering_key, * EXCLUDE (race_ordering_key) FROM book)"""


def book(spark: SparkSession, d: str, policy: X.Policy = AGGRESSIVE) -> DataFrame:
    return cut(X.ledger(X.prepared(X.canonical(raw(spark, d)), policy), policy))


# Queries


@query(f"""WITH {RAW_SQL} SELECT race_no, line, TRY_CAST(nullif(regexp_extract(replace(upper(event), ' ', ''), '(500|1000|1500|2000|3000)M', 1), '') AS BIGINT) AS distance,
  contains(replace(upper(event), ' ', ''), 'S.F') OR contains(replace(upper(event), ' ', ''), 'SF') AS super_final, {_ROUND} AS round_class, {_HEAT} AS heat,
  {_DISCIPLINE} AS discipline, {_RELAY} AS relay, contains({_norm('category')}, '동호인') AS hobby,
  CASE WHEN contains(meet_name, '전국동계체육대회') THEN TRY_CAST(nullif(regexp_extract(meet_name, '제\\s*([0-9]+)\\s*회', 1), '') AS BIGINT) - 88 + 2007 END AS games_year FROM raw""")  # fmt: skip
def event_and_round(spark, d):
    c = F.col
    distance, super_final = D.event_detail(c("event"))
    return raw(spark, d).select(
        "race_no", "line", distance.alias("distance"), super_final.alias("super_final"), D.round_of(c("round"), c("round_kind")).alias("round_class"),
        D.heat_number(c("round")).alias("heat"), D.discipline(c("class_cd"), c("meet_name"), c("round"), c("round_kind")).alias("discipline"),
        D.is_relay(c("event"), c("round"), c("round_kind"), c("meet_name"), c("category")).alias("relay"), D.is_hobby(c("category")).alias("hobby"),
        D.winter_games_year(c("meet_name")).alias("games_year"),
    )


_BIRTH = f"CASE WHEN {_INT.format(_norm('birth_year'))} BETWEEN 1900 AND 2099 THEN {_INT.format(_norm('birth_year'))} END"
_GRADED = "CASE WHEN g IS NULL THEN NULL WHEN g <= 0 THEN 'excluded' WHEN g <= 6 THEN 'elementary' WHEN g <= 9 THEN 'middle' WHEN g <= 12 THEN 'high' ELSE 'college' END"


@query(f"""WITH {RAW_SQL}, s AS (SELECT *, {_SEASON} - ({_BIRTH}) - 6 AS g, {_STAGE} AS sc, {_KEY} AS k, {_RULE} AS r FROM raw), t AS (SELECT *, {_GRADED} AS sg FROM s)
SELECT race_no, line, k AS category_key, r AS category_rule, sc AS stage_category, sg AS stage_grade, g AS grade,
  CASE WHEN sc = 'open' THEN 'open' WHEN sg <> 'excluded' THEN sg WHEN sg IS NULL AND sc <> 'excluded' THEN sc END AS stage,
  CASE WHEN sc = 'open' THEN 'open_category' WHEN sg <> 'excluded' THEN 'birth_year' WHEN sg = 'excluded' THEN 'grade_excluded' WHEN sc <> 'excluded' THEN 'category_fallback'
    ELSE 'excluded_or_unknown' END AS source FROM t""")  # fmt: skip
def stage_resolution(spark, d):
    t = raw(spark, d)
    named = first_int(D.norm(F.col("season_text")))
    year = F.coalesce(F.when(named.between(1900, 2099), named), D.meet_year(F.col("date")))
    return t.select("race_no", "line", D.resolved_stage(F.col("category"), D.birth_year(F.col("birth_year")), year).alias("s")).select("race_no", "line", "s.*")


@query(f"""WITH {RAW_SQL} SELECT race_no, line, {_GENDER} AS gender, {_BAND} AS band, {_DIVISION} AS division, {_EVENT} AS event, {_MEET} AS meet, {_RACE} AS race_id FROM raw""")
def race_identity(spark, d):
    c = F.col
    gender, band = D.division(c("category"), c("gender"))
    event, meet = D.event_key(c("event"), c("category"), c("distance_text")), D.meet_key(c("meet_id"), c("season_text"), c("meet_name"))
    key = D.race_key(meet, event, c("category"), c("gender"), c("round"), c("round_kind"), c("sf_flag"), c("date"))
    return raw(spark, d).select("race_no", "line", gender.alias("gender"), band.alias("band"), D.division_key(c("category"), c("gender")).alias("division"), event.alias("event"), meet.alias("meet"), key.alias("race_id"))


@query(f"""WITH {RAW_SQL} SELECT status, advanced, {_PLACE} IS NULL AS no_place, {_SECONDS} IS NULL AS no_time, {_STATUS} AS status_norm, count(*) AS n_rows,
  round(sum({_SECONDS}), 3) AS seconds FROM raw GROUP BY ALL""")  # fmt: skip
def status_rules(spark, d):
    t = raw(spark, d).select("status", "advanced", first_int(F.col("place")).alias("p"), parse_seconds(F.col("time")).alias("t"))
    told = t.withColumn("status_norm", D.status_of(F.col("status"), F.col("advanced"), F.col("p"), F.col("t")))
    keys = ["status", "advanced", F.col("p").isNull().alias("no_place"), F.col("t").isNull().alias("no_time"), "status_norm"]
    return told.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.round(F.sum("t"), 3).alias("seconds"))


@query(f"WITH {CANONICAL_SQL} SELECT {REASON_SQL.format(season=MIN_SEASON)} AS reason, count(*) AS n_rows FROM canon GROUP BY 1")
def ledger_exclusions(spark, d):
    return X.exclusion_log(X.canonical(raw(spark, d)), CONSERVATIVE)


@query(f"""WITH {CANONICAL_SQL} SELECT count(*) AS n_rows, round(avg(CASE WHEN status_norm = 'PEN' THEN 1.0 ELSE 0.0 END), 6) AS penalty_rate FROM canon
WHERE {REASON_SQL.format(season=MIN_SEASON)} = 'kept'""")  # fmt: skip
def penalty_rate(spark, d):
    return X.penalty_rate(X.canonical(raw(spark, d)), CONSERVATIVE)


def _compared(policy: X.Policy):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.comparisons(cut(X.placed(X.prepared(X.canonical(raw(spark, d)), policy), policy)), policy)

    return run


for _name, _policy in (("comparisons_conservative", CONSERVATIVE), ("comparisons_aggressive", AGGRESSIVE), ("comparisons_place_only", PLACE_ONLY)):
    _f = _compared(_policy)
    _f.__name__ = _name
    query(_compare_sql(_policy))(_f)


@query(f"WITH {LEDGER_SQL} SELECT * FROM keyed")
def ledger_book(spark, d):
    return book(spark, d)


@query(f"""WITH {LEDGER_SQL}, counted AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n FROM keyed)
SELECT a.race_id, a.athlete_id AS winner, b.athlete_id AS loser, a.rank AS winner_rank, b.rank AS loser_rank, a.status || '-' || b.status AS statuses,
  round((a.weight + b.weight) / 2 / (a.n - 1), 6) AS weight FROM counted a JOIN counted b ON a.race_id = b.race_id
  AND ((a.status IN ('FIN', 'ADV', 'PEN') AND b.status IN ('FIN', 'ADV', 'PEN') AND a.rank < b.rank) OR (a.status IN ('FIN', 'ADV') AND b.status = 'DNF'))""")  # fmt: skip
def pairwise_view(spark, d):
    return X.pairwise(book(spark, d))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT race_id, count(DISTINCT athlete_id) AS n FROM keyed GROUP BY 1)
SELECT count(*) AS n_races, min(n) AS least, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90,
  max(n) AS most, round(avg(CASE WHEN n BETWEEN 4 AND 6 THEN 1.0 ELSE 0.0 END), 6) AS share_4_to_6, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS n_pairs FROM s""")  # fmt: skip
def race_sizes(spark, d):
    return X.race_sizes(book(spark, d))


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT DISTINCT race_id, athlete_id FROM keyed), s AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n FROM o)
SELECT athlete_id, CAST(sum(n - 1) AS BIGINT) AS n_pairs, count(*) AS n_races FROM s GROUP BY 1""")  # fmt: skip
def pair_counts(spark, d):
    return X.pair_counts(book(spark, d))


@query(f"""WITH {LEDGER_SQL} SELECT 'repeated_athlete' AS rule, (SELECT count(*) FROM (SELECT 1 FROM keyed GROUP BY race_id, athlete_id HAVING count(*) > 1)) AS n_faults
UNION ALL SELECT 'tie_too_wide', (SELECT count(*) FROM (SELECT 1 FROM keyed WHERE status IN ('FIN', 'ADV') GROUP BY race_id, rank HAVING count(*) > 3))
UNION ALL SELECT 'shared_race_key', (SELECT count(*) FROM (SELECT 1 FROM keyed GROUP BY race_ordering_key HAVING count(DISTINCT race_id) > 1))
UNION ALL SELECT 'rank_below_1', (SELECT count(*) FROM keyed WHERE rank < 1)
UNION ALL SELECT 'key_without_day', (SELECT count(*) FROM keyed WHERE NOT starts_with(ordering_key, day))""")  # fmt: skip
def ledger_faults(spark, d):
    return X.ledger_faults(book(spark, d))


_SCHOOL = """CASE o_custkey % 9 WHEN 0 THEN '서울 한강초' WHEN 1 THEN '경기도수원중' WHEN 2 THEN '부산동고' WHEN 3 THEN '강원대' WHEN 4 THEN '성남시청'
  WHEN 5 THEN '서울특별시' WHEN 6 THEN '' WHEN 7 THEN ' 제주 빙상클럽' ELSE '전북도청팀' END"""
_T = "regexp_replace(trim(school), '\\s+', '', 'g')"
_SUFFIXED = "CASE " + " ".join(f"WHEN ends_with({_T}, '{a}') THEN {_T} || '{b}'" for a, b in D.SCHOOL_SUFFIXES) + f" ELSE {_T} END"
_REGION = "CASE " + " ".join(f"WHEN starts_with(k, '{r}') AND length(k) > {len(r)} THEN '{r}'" for r in sorted(D.REGIONS, key=len, reverse=True)) + " ELSE '' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_SCHOOL} AS school FROM orders), k AS (SELECT o_orderkey, {_SUFFIXED} AS k FROM r), p AS (SELECT *, {_REGION} AS region FROM k)
SELECT o_orderkey, k AS school, CASE WHEN ends_with(k, '초등학교') THEN '초' WHEN ends_with(k, '중학교') THEN '중' WHEN ends_with(k, '고등학교') THEN '고'
  WHEN ends_with(k, '대학교') THEN '대' WHEN {_any('k', D.EMPLOYERS)} THEN '실업' ELSE '기타' END AS school_group, region, substr(k, length(region) + 1) AS bare FROM p""")  # fmt: skip
def school_keys(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.expr(_SCHOOL).alias("school")).withColumn("school", D.school_key(F.col("school")))
    k = F.col("school")
    return t.select("o_orderkey", "school", D.school_group(k).alias("school_group"), D.region_prefix(k).alias("region"), D.without_region(k).alias("bare"))


_BIRTHS = """CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '년' WHEN 2 THEN '1999 년' WHEN 3 THEN '2001-05' WHEN 4 THEN '2001년 5월 3일' WHEN 5 THEN '19990101'
  WHEN 6 THEN '2003' WHEN 7 THEN 'unknown' ELSE '1998/12/1' END"""
_DAYS = """CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')
  WHEN 2 THEN concat('on ', CAST(CAST(o_orderdate AS DATE) AS STRING)) WHEN 3 THEN '' ELSE '2020-13-01' END"""
_MONTH = """coalesce(CASE WHEN TRY_CAST(regexp_extract(a, '^(?:19|20)[0-9]{2}-([0-9]{2})-[0-9]{2}$', 1) AS BIGINT) BETWEEN 1 AND 12 THEN CAST(regexp_extract(a, '^(?:19|20)[0-9]{2}-([0-9]{2})-[0-9]{2}$', 1) AS BIGINT) END,
  CASE WHEN TRY_CAST(regexp_extract(a, '^(?:19|20)[0-9]{2}[./]([0-9]{1,2})[./][0-9]{1,2}$', 1) AS BIGINT) BETWEEN 1 AND 12 THEN CAST(regexp_extract(a, '^(?:19|20)[0-9]{2}[./]([0-9]{1,2})[./][0-9]{1,2}$', 1) AS BIGINT) END)"""


@query(f"""WITH t AS (SELECT o_orderkey, {_DAYS} AS a, regexp_replace({_BIRTHS}, '\\s+', '', 'g') AS b FROM orders),
u AS (SELECT *, coalesce(CASE WHEN TRY_CAST(regexp_extract(a, '^([0-9]{{4}})', 1) AS BIGINT) BETWEEN 1900 AND 2099 THEN TRY_CAST(regexp_extract(a, '^([0-9]{{4}})', 1) AS BIGINT) END,
  TRY_CAST(nullif(regexp_extract(a, '((?:19|20)[0-9]{{2}})', 1), '') AS BIGINT)) AS year, {_MONTH} AS month FROM t)
SELECT o_orderkey, year, month, CASE WHEN month < 7 THEN year - 1 ELSE year END AS season, CASE WHEN b IN ('', '년') THEN 'empty_or_year_marker'
  WHEN regexp_matches(b, '^(19|20)[0-9]{{2}}년$') THEN 'year_only'
  WHEN regexp_matches(b, '^(19|20)[0-9]{{2}}[-./][0-9]{{1,2}}([-./][0-9]{{1,2}})?$|^(19|20)[0-9]{{2}}년[0-9]{{1,2}}월([0-9]{{1,2}}일)?$|^(19|20)[0-9]{{6}}$') THEN 'month_or_day_present'
  WHEN regexp_matches(b, '^(19|20)[0-9]{{2}}$') THEN 'year_digits_only' ELSE 'other' END AS birth_format FROM u""")  # fmt: skip
def dates_and_births(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.expr(_DAYS).alias("a"), F.expr(_BIRTHS).alias("b"))
    year, month = D.meet_year(F.col("a")), D.month_of(F.col("a"))
    return t.select("o_orderkey", year.alias("year"), month.alias("month"), D.season_of(year, F.col("a")).alias("season"), D.birth_format(F.col("b")).alias("birth_format"))


_NAME = "concat(CAST(year(o_orderdate) AS STRING), ' 제', CAST(o_custkey % 7 AS STRING), '회_', o_orderpriority, ' 빙상-대회! ', CASE WHEN o_orderkey % 5 = 0 THEN '쇼트트랙 스피드 종합 선수권 대회 겸 국가대표 선발전' ELSE '' END)"


@query(f"""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, trim({_NAME}) AS name FROM orders),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS words FROM t),
x AS (SELECT *, substr(words, length(CAST(y AS VARCHAR)) + 2) AS bare FROM w),
z AS (SELECT *, list_max(list_filter(range(0, length(bare) + 1), lambda n: strlen(substr(bare, 1, n)) <= 40)) AS n FROM x)
SELECT o_orderkey, words AS slug, y || '-' || regexp_replace(substr(bare, 1, n), '^-+|-+$', '', 'g') || '-' || left(sha1(y || ':' || name), 8) AS meet_slug FROM z""")  # fmt: skip
def meet_slugs(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr(_NAME).alias("name"))
    return t.select("o_orderkey", D.slug_text(F.col("name")).alias("slug"), D.meet_slug(F.col("y"), F.col("name"), 40).alias("meet_slug"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 30 <= 5 THEN '0-5' WHEN l_partkey % 30 <= 20 THEN '6-20' ELSE '21+' END AS games,
  CASE WHEN l_partkey % 20 <= 0 THEN '(unknown-age)' WHEN l_partkey % 20 <= 12 THEN '<=12' WHEN l_partkey % 20 <= 15 THEN '13-15' ELSE '16+' END AS age,
  CASE WHEN l_quantity <= 17 THEN 'low' WHEN l_quantity <= 33 THEN 'mid' ELSE 'high' END AS sigma,
  CASE WHEN l_quantity * 2 >= 70 THEN 'upper' WHEN l_quantity * 2 >= 30 THEN 'middle' ELSE 'lower' END AS reverse,
  round(ln((l_discount + 0.05) / (1 - (l_discount + 0.05))), 9) AS logit,
  round(-((l_discount + 0.05) * ln(l_discount + 0.05) + (0.95 - l_discount) * ln(0.95 - l_discount)), 9) AS entropy,
  CASE WHEN l_quantity * 3 < 60 THEN printf('%.2f초', l_quantity * 3) ELSE printf('%d분 %05.2f초', CAST(floor(l_quantity * 3 / 60) AS BIGINT), l_quantity * 3 - floor(l_quantity * 3 / 60) * 60) END AS clock,
  CAST('0x' || right(sha256(l_orderkey || '|' || l_suppkey || '|' || l_partkey), 1) AS INTEGER) % 2 = 0 AS left_first FROM lineitem""")  # fmt: skip
def bands_and_bits(spark, d):
    t = table(spark, d, "lineitem")
    p, q = F.col("l_discount") + 0.05, F.col("l_quantity")
    return t.select(
        "l_orderkey", "l_linenumber", "l_suppkey", D.games_band(F.col("l_partkey") % 30).alias("games"), D.age_band(F.col("l_partkey") % 20).alias("age"),
        D.tercile_band(q, F.lit(17.0), F.lit(33.0)).alias("sigma"), D.reverse_band(q * 2).alias("reverse"), F.round(D.logit(p), 9).alias("logit"),
        F.round(D.binary_entropy(p), 9).alias("entropy"), D.clock(q * 3).alias("clock"),
        D.first_by_hash(F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")).alias("left_first"),
    )
