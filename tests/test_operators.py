import collections
import math
import random

import duckdb
import pytest

from paceline.functions import scalars
from paceline.functions.quantiles import quantile
from paceline.operators import entity, evaluation, graph, ledger, marts
from paceline.operators.ratings import Glicko2, TrueSkill, _cdf, replay, snapshots
from paceline.plans import catalogue
from paceline.sources import tables
from pyspark.sql import functions as F


def test_glicko2_published_example():
    model, state = Glicko2(), {"a": [1500, 200, 0.06, 0], "b": [1400, 30, 0.06, 0], "c": [1550, 100, 0.06, 0], "d": [1700, 300, 0.06, 0]}
    model.update(state, {"a": [("b", 1, 1), ("c", 0, 1), ("d", 0, 1)]}, {})
    mu, phi, sigma, games = state["a"]
    assert abs(mu - 1464.06) < 0.01 and abs(phi - 151.52) < 0.01 and abs(sigma - 0.05999) < 1e-5 and games == 3


def test_trueskill_two_players_closed_form():
    model, state = TrueSkill(tau=0.0), {"a": [27.0, 2.0, 0], "b": [24.0, 3.0, 0]}
    model.race(state, [("a", 2), ("b", 1)], {})
    c = math.sqrt(2 * model.beta**2 + 4 + 9)
    t = (24 - 27) / c
    v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / _cdf(t)
    w = v * (v + t)
    assert state["b"][0] == pytest.approx(24 + 9 / c * v) and state["a"][0] == pytest.approx(27 - 4 / c * v)
    assert state["a"][1] == pytest.approx(2 * math.sqrt(1 - 4 / c**2 * w))


def test_trueskill_order_and_ties():
    model = TrueSkill()
    one, two, tied = {}, {}, {}
    model.race(one, [("a", 1), ("b", 2), ("c", 3)], {})
    model.race(two, [("c", 3), ("a", 1), ("b", 2)], {})
    assert one["a"][0] == pytest.approx(two["a"][0], abs=1e-6) and one["a"][0] > one["b"][0] > one["c"][0]
    model.race(tied, [("a", 1), ("b", 1)], {})
    assert tied == {}


def _season(n=40):
    r = random.Random(1)
    out = []
    for race in range(n):
        out += [(race // 4, race, a, i + 1) for i, a in enumerate(r.sample(range(8), 4))]
    return out


@pytest.mark.parametrize("make", [Glicko2, TrueSkill])
def test_resume_equals_cold_and_predictions_come_first(make):
    rows = _season()
    cold, state, _ = replay(make(), rows)
    half = [r for r in rows if r[0] < 5]
    first, s, last = replay(make(), half)
    rest, s2, _ = replay(make(), [r for r in rows if r[0] >= 5], s, last)
    assert first + rest == cold and s2 == state
    seen: list = []
    replay(make(), rows[:16], predictions=seen)
    assert all(p == pytest.approx(0.5) for period, _, _, p in seen if period == 0)


def test_snapshots_by_component(spark):
    rows = _season() + [(p, 1000 + r, a + 100, k) for p, r, a, k in _season()]
    df = spark.createDataFrame([(r, a, k, p) for p, r, a, k in rows], "race long, athlete long, rank long, period long")
    got = {(r["athlete"], r["period"]): r["mu"] for r in snapshots(df, TrueSkill).collect()}
    assert got[0, 9] == pytest.approx(got[100, 9]) and len(got) > 50


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    got = df.agg(*[quantile(F.col("v"), 0.5, r).alias(r) for r in ("linear", "nearest", "floor", "half_even", "fraction")]).first()
    assert got.asDict() == {"linear": 2.5, "nearest": 3.0, "floor": 2.0, "half_even": 3.0, "fraction": 3.0}


def test_scalars(spark):
    df = spark.createDataFrame([("1:02.5", "none"), ("45.1", " x "), ("1:2:3", None), ("a:1", "NaN")], "t string, s string")
    got = df.select(scalars.parse_seconds(F.col("t")).alias("t"), scalars.norm(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(62.5, ""), (45.1, "x"), (3723.0, ""), (None, "")]
    rounds = spark.createDataFrame([("Quarter final",), ("semi",), ("Final B",), ("final",), ("heat 3",)], "r string")
    assert [r[0] for r in rounds.select(scalars.round_class(F.col("r"))).collect()] == ["quarterfinal", "semifinal", "final_b", "final", "heat"]


def test_stop_rule(spark):
    rates = spark.createDataFrame([(1, 1633, 175)], "min_gap long, n_cases long, n_returned long")
    rates = rates.withColumn("return_pct", scalars.ratio_pct(F.col("n_returned"), F.col("n_cases")))
    assert rates.first()["return_pct"] == 10.72 and marts.stop_rule(rates).first()["stop_after"] == 1
    assert marts.stop_rule(rates.where("min_gap > 1")).first()["verdict"] == "hold"


def test_two_groups_make_two_components(spark):
    rows = [(f"r{i}", a) for i, g in enumerate([("a1", "a2"), ("a2", "a3"), ("b1", "b2"), ("b2", "b3")]) for a in g]
    got = graph.memberships(spark.createDataFrame(rows, "race string, athlete string")).collect()
    assert {r["athlete"]: r["component"] for r in got} == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1"}


def test_pairs_of_six_finishers(spark):
    df = spark.createDataFrame([(1, a, a) for a in range(1, 7)], "race long, athlete long, rank long")
    assert ledger.pairs(df).count() == 15


def test_chains_and_appends(spark):
    merges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)], "sub long, main long")
    assert {r["main"] for r in entity.resolve_chains(merges).collect()} == {1}
    old = spark.createDataFrame([(1, None, 1)], "a long, b long, n long")
    new = spark.createDataFrame([(1, None, 2), (2, 2, 3), (2, 2, 4)], "a long, b long, n long")
    assert sorted(r["n"] for r in entity.append_new(old, new, ["a", "b"], "n").collect()) == [1, 3]


def test_duplicates_of_one_name_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(entity, "TILE", 30, raising=False)
    rows = [(i % 290, "bolt", None if i % 17 == 0 else f"b{i % 3}", None if i % 13 == 0 else i % 20) for i in range(300)]  # ten ids twice
    rows += [(None, "bolt", "b1", 1), (7, None, "b1", 1), (8, None, "b1", 1), (9, "rod", "b1", 1), (10, "rod", "b1", 2), (11, "nut", "b1", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        got = catalogue.QUERIES["dup_candidates"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    part = duckdb.connect()
    part.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted((r["name"], r["a"], r["b"], r["verdict"]) for r in got) == sorted(part.sql(catalogue.ORACLES["dup_candidates"]).fetchall())
    tasks = collections.Counter(r["task"] for r in got if r["name"] == "bolt")
    assert len(tasks) == 4 and max(tasks.values()) < 0.6 * len(got)


def test_bootstrap_and_platt():
    low, high = evaluation.block_bootstrap([(float(i % 5), 2) for i in range(100)], 200)
    assert low < 1.0 < high
    a, b = evaluation.fit_platt([(x / 10, int(x > 0)) for x in range(-20, 21)])
    assert a > 1 and abs(b) < 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,x\n2,\n", encoding="utf-8")
    df = tables.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("2", "")]
    named = tables.with_aliases(df, {"key": ["nope", "id"], "label": ["name"], "none": ["zz"]})
    assert [tuple(r) for r in named.collect()] == [("1", "x", ""), ("2", "", "")]
    tables.write_by(df, str(tmp_path / "out"), "name", "id")
    back = tables.read_tree(spark, str(tmp_path / "out"))
    assert back.count() == 2 and tables.content_digest(df) == tables.content_digest(df.orderBy(F.desc("id")))
    pages = spark.createDataFrame([(1, "<table><tr><td colspan=2>H</td></tr><tr><td>a</td><td>b &amp; c</td></tr></table>")], "k long, h string")
    assert [tuple(r) for r in tables.html_rows(pages, "k", "h").collect()] == [(1, 1, "H", ["a", "b & c"])]


def test_streams(spark, tmp_path):
    from paceline.streaming.appends import append_stream, windowed_counts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", 2.0)], "id long, kind string, value double")
    rows = rows.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    append_stream(stream, out, ["id"], str(tmp_path / "c1")).awaitTermination()
    rows.where("id = 2").withColumn("id", F.lit(3).cast("long")).write.mode("append").parquet(src)
    append_stream(stream, out, ["id"], str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    counts = windowed_counts(stream, "ts", "kind", "value")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["kind"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 2)}


def test_percentiles_of_every_season_equal_brute_force(spark):
    r = random.Random(5)
    best = [(a, s, float(r.randint(1, 12))) for s, n in ((1990, 30), (1991, 8), (1992, 15), (1994, 9), (1997, 40)) for a in r.sample(range(60), n)]
    want = []
    for a, s, v in best:
        own = [x for _, t, x in best if t == s]
        pool = own if len(own) >= 20 else [x for _, t, x in best if abs(t - s) <= 1]
        if len(pool) >= 20:
            rank = sum(x < v for x in pool) + (sum(x == v for x in pool) + 1) / 2
            want.append((a, s, len(pool), (len(pool) - rank + 1) / len(pool) * 100))
    got = marts.pooled_percentile(spark.createDataFrame(best, "athlete long, season long, value double")).collect()
    assert sorted(tuple(x)[:3] for x in got) == sorted(x[:3] for x in want)
    assert {s for _, s, *_ in want} == {1990, 1991, 1992, 1997}
    near = {(a, s): p for a, s, _, p in want}
    assert all(abs(x["percentile"] - near[x["athlete"], x["season"]]) < 0.006 for x in got)


def test_base_season_is_each_athletes_own(spark):
    pct = [(1, 1999, 10.0), (1, 2000, 20.0), (1, 2001, 30.0), (2, 1996, 40.0), (2, 2000, 50.0)]
    born = [(1, "F", 1988), (2, "M", 1980)]
    got = marts.base_seasons(spark.createDataFrame(pct, "athlete long, season long, percentile double"), spark.createDataFrame(born, "athlete long, sex string, birth_year long"))
    assert sorted(map(tuple, got.collect())) == [(1, "F", 2000, 20.0), (2, "M", 1996, 40.0)]


def hops_from(rows, start):
    hop, front = dict.fromkeys(start, 0), set(start)
    while front:
        races = {r for r, a in rows if a in front}
        front = {a for r, a in rows if r in races} - hop.keys()
        hop |= dict.fromkeys(front, max(hop.values()) + 1)
    return hop


def test_hops_go_on_until_nobody_is_new(spark):
    chain = [(r, a) for r in range(7) for a in (r, r + 1)]
    rows = chain + [(2, 50), (9, 50), (9, 51), (9, 51), (20, 60), (20, 61), (21, 5)]
    df = spark.createDataFrame(rows, "race long, athlete long")
    want = sorted(hops_from(rows, [0]).items())
    assert max(h for _, h in want) == 7
    assert sorted(map(tuple, graph.race_hops(df, [0]).collect())) == want
    assert sorted(map(tuple, graph.hops(graph.edges(df), [0]).collect())) == want
    assert sorted(map(tuple, graph.hops(graph.edges(df), [0], 2).collect())) == [x for x in want if x[1] <= 2]


def test_graph_queries_read_every_line(spark, tmp_path):
    from paceline.plans import catalogue

    lines = [(1, 1, 95000.0), (1, 2, 100.0), (2, 2, 100.0), (2, 3, 95000.0), (3, 3, 1.0), (3, 4, 1.0), (4, 4, 1.0), (4, 5, 1.0), (5, 5, 1.0), (5, 6, 1.0), (6, 7, 1.0), (6, 8, 95000.0), (7, 9, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = [x[:2] for x in lines]
    hops = {tuple(x) for x in catalogue.QUERIES["bfs_hops_all"](spark, str(tmp_path)).collect()}
    assert hops == set(hops_from(rows, [1]).items()) and max(h for _, h in hops) == 5
    found = {tuple(x) for x in catalogue.QUERIES["components_all"](spark, str(tmp_path)).collect()}
    assert found == {(a, min(hops_from(rows, [a]))) for _, a in rows}


def test_meets_join_different_names_not_rows(spark):
    from paceline.operators.identity import matched_meets

    targets = spark.createDataFrame([(i, 2000 + i % 2, ["Open Cup", "open-cup", "The President Cup", None][i % 4]) for i in range(4000)], "id long, year long, name string")
    index = spark.createDataFrame([(2000 + i % 2, "president cup" if i % 3 else "OPEN CUP", f"m{i % 6}", str(1 + i % 2)) for i in range(3000)], "year long, name string, code string, class string")
    out = matched_meets(targets, index, "2")
    got = {r["id"]: (r["code"], r["status"]) for r in out.collect()}
    assert len(got) == 4000
    assert got[0] == ("m0", "matched") and got[1] == ("m3", "matched") and got[2] == ("", "ambiguous") and got[3] == ("", "name-not-matched")
    met = out.queryExecution.executedPlan if hasattr(out, "queryExecution") else out._jdf.queryExecution().executedPlan()
    made = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            made.append(rows.get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(met)
    assert made and max(made) <= 4000
