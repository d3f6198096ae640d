import pytest
from paceline.functions import domain as D
from paceline.functions.scalars import padded
from paceline.operators import extraction as X
from pyspark.sql import functions as F

BASE = {c: "" for c in X.RAW} | {"race_id": "r1", "round": "결승", "season_text": "2020", "category": "남자 중학부", "event": "500M", "meet_id": "m", "date": "2020-02-01"}


def sheet(spark, rows):
    made = [{**BASE, **r} for r in rows]
    return spark.createDataFrame([[r[c] for c in X.RAW] for r in made], ", ".join(f"{c} string" for c in X.RAW))


def finishers(n):
    return [{"athlete_id": f"a{i}", "place": str(i), "time": f"4{i}.1"} for i in range(1, n + 1)]


def compared(spark, rows, policy):
    p = X.POLICIES[policy]
    return X.comparisons(X.placed(X.prepared(X.canonical(sheet(spark, rows)), p), p), p)


def test_six_finishers_make_fifteen_pairs(spark):
    assert compared(spark, finishers(6), "conservative").count() == 15


@pytest.mark.parametrize("status", ["PEN", "DNF"])
def test_policies(spark, status):
    rows = [*finishers(2), {"athlete_id": "a3", "status": status}]
    assert compared(spark, rows, "conservative").count() == 1
    assert compared(spark, rows, "aggressive").count() == 3


def test_ties_and_single_rows_make_no_pairs(spark):
    rows = [{"athlete_id": "a1", "place": "1", "time": "40"}, {"athlete_id": "a2", "place": "1", "time": "40"}, {"athlete_id": "b", "place": "1", "race_id": "r2"}]
    assert compared(spark, rows, "aggressive").count() == 0


def test_two_that_did_not_finish_are_not_compared(spark):
    rows = [*finishers(1), {"athlete_id": "x", "status": "DNF"}, {"athlete_id": "y", "status": "DNF"}]
    book = X.ledger(X.prepared(X.canonical(sheet(spark, rows)), X.POLICIES["aggressive"]), X.POLICIES["aggressive"])
    assert {(r["winner"], r["loser"], r["weight"]) for r in X.pairwise(book).collect()} == {("a1", "x", 0.5), ("a1", "y", 0.5)}
    assert [r["rank"] for r in book.orderBy("ordering_key").collect()] == [1, 2, 3]


def test_statuses_in_order(spark):
    cases = [("ok", "", 1, "FIN"), ("", "", None, "DNS"), ("adv dq", "", None, "ADV"), ("실격", "", 2, "PEN"), ("경기중 기권", "", None, "DNS"), ("RET", "", None, "DNF"), ("odd", "", 3, "FIN"), ("odd", "", None, "UNKNOWN"), (None, None, None, "DNS")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, a string, p long, want string")
    got = df.select("want", D.status_of(F.col("s"), F.col("a"), F.col("p"), F.lit(None).cast("double")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_sequences_fill_the_lowest_free_numbers(spark):
    rows = [("a", 3), ("b", None), ("c", 1), ("d", 3), ("e", None), ("f", 0)]
    df = spark.createDataFrame([(r, "20200101", "m", s, "500M", "final", 0, "") for r, s in rows], "race_id string, day string, meet string, seq long, event string, round_class string, heat long, round_kind string")
    assert {r["race_id"]: r["race_seq"] for r in X.sequenced(df).collect()} == {"a": 3, "c": 1, "b": 2, "d": 4, "e": 5, "f": 6}


def test_long_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(None,), (0,), (7,), (12345,)], "n long")
    assert [r[0] for r in df.select(padded(F.col("n"))).collect()] == ["0000", "0000", "0007", "12345"]


def test_divisions_part_races(spark):
    rows = [{"race_id": "", "athlete_id": "a", "category": "남자중학부"}, {"race_id": "", "athlete_id": "b", "category": "중학부", "gender": "남"}, {"race_id": "", "athlete_id": "c", "category": "여자중학부"}]
    found = {r["athlete_id"]: r["race_id"] for r in X.canonical(sheet(spark, rows)).collect()}
    assert found["a"] == found["b"] != found["c"] and found["a"].startswith("m|남:중학부|500M|결승|-|-|")
