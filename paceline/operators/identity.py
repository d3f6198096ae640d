"""Who is who: profiles, candidate evidence, merge lists, split signals, fuzzy matches of meets, audits of ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profiles(parts: list[DataFrame]) -> DataFrame:
    """Per id the sets of names, genders, regions and affiliations over several sources, and how many rows it has.
    parts: id, name, gender, region, affiliation. Empty values don't count."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    filled = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(c)), F.lit("")))), "|")
    return whole.groupBy("id").agg(*[filled(c).alias(f"{c}s") for c in ("name", "gender", "region", "affiliation")], F.count("*").alias("n_rows"))


def candidates(known: DataFrame) -> DataFrame:
    """Pairs of ids of one name and birth year with a verdict. The id with more rows leads (the lesser on a tie).

    known: id, name, birth_year, gender, region, n_rows. Each id of a name meets the name's leading id only, as merges go to
    the leader, so a common name costs a row for each of its ids."""
    w = W.partitionBy("name", "birth_year").orderBy(F.desc("n_rows"), "id")
    lead = lambda c: F.first(c).over(w).alias(f"main_{c}")
    met = known.select("*", *[lead(c) for c in ("id", "gender", "region", "n_rows")]).where("id <> main_id")
    same_gender, same_region = F.col("gender") == F.col("main_gender"), F.col("region") == F.col("main_region")
    small = (F.col("n_rows") <= 5) & (F.col("n_rows") * 10 <= F.col("main_n_rows"))
    verdict = F.when(~same_gender, "reject").when(same_region & small, "auto_merge").when(same_region | small, "review").otherwise("reject")
    return met.select(F.col("id").alias("sub"), F.col("main_id").alias("main"), "name", verdict.alias("verdict"))


def merged_lists(confirmed: DataFrame, proposed: DataFrame) -> DataFrame:
    """sub, main, source: confirmed merges win; a proposed one of the same sub is left out and flagged where it differs."""
    met = proposed.alias("p").join(confirmed.alias("c"), F.col("p.sub") == F.col("c.sub"), "full_outer")
    source = F.when(F.col("c.sub").isNull(), "proposed").when(F.col("p.main") != F.col("c.main"), "confirmed_over_other").otherwise("confirmed")
    return met.select(F.coalesce("c.sub", "p.sub").alias("sub"), F.coalesce("c.main", "p.main").alias("main"), source.alias("source"))


def split_signals(known: DataFrame) -> DataFrame:
    """Groups of one normalised name, gender and birth year with two ids or more, and what that may mean: the name is
    spelled in several ways, the affiliation changed (seasons without overlap), or they are namesakes.
    known: id, name, gender, birth_year, affiliation, first_season, last_season."""
    key = F.regexp_replace(F.lower("name"), "[\\s\\-_.]+", "")
    keyed = known.withColumn("key", key).where("key <> '' and gender <> '' and birth_year is not null")
    w = W.partitionBy("key", "gender", "birth_year").orderBy("first_season", "last_season", "id")
    reach = F.max("last_season").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = keyed.withColumn("apart", F.coalesce(F.col("first_season") > reach, F.lit(False)))
    grouped = marked.groupBy("key", "gender", "birth_year").agg(
        F.countDistinct("id").alias("n_ids"), F.countDistinct("name").alias("n_names"), F.countDistinct("affiliation").alias("n_affiliations"),
        F.max("apart").alias("apart"),
    )
    kind = F.when(F.col("n_names") > 1, "spelling").when((F.col("n_affiliations") > 1) & F.col("apart"), "affiliation_change").otherwise("namesake")
    return grouped.where("n_ids > 1").select("key", "gender", "birth_year", "n_ids", kind.alias("kind"))


def matched_meets(targets: DataFrame, index: DataFrame, preferred: str, least: int = 8) -> DataFrame:
    """The code of each target's meet: 3 for an equal normalised name, 2 where one contains the other and both have ``least``
    characters; among the best, one code, or one of the preferred class, matches. targets: id, year, name; index: year, name,
    code, class. Each different name of a year meets each different name of the index in that year once, however many
    targets and meets have it."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    keyed = targets.select("id", "year", key("name").alias("key"))
    names = keyed.select("year", "key").where("year is not null and key is not null").distinct()
    meets = index.select("year", key("name").alias("key"), "code", "class").groupBy("year", "key").agg(
        F.collect_set("code").alias("codes"), F.collect_set(F.when(F.col("class") == preferred, F.col("code"))).alias("liked")
    )
    t, i = names.alias("t"), meets.alias("i")
    inside = F.contains(F.col("t.key"), F.col("i.key")) | F.contains(F.col("i.key"), F.col("t.key"))
    long = F.least(F.length("t.key"), F.length("i.key")) >= least
    score = F.when(F.col("t.key") == F.col("i.key"), 3).when(inside & long, 2).otherwise(0)
    met = t.join(i, F.col("t.year") == F.col("i.year")).select(F.col("t.year").alias("year"), F.col("t.key").alias("key"), "codes", "liked", score.alias("score"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    found = met.where("score > 0").groupBy("year", "key", "score").agg(flat("codes"), flat("liked"))
    best = found.groupBy("year", "key").agg(F.max_by(F.struct("codes", "liked"), "score").alias("b"))
    out = keyed.join(best, ["year", "key"], "left")
    code = F.when(F.size("b.codes") == 1, F.col("b.codes")[0]).when(F.size("b.liked") == 1, F.col("b.liked")[0])
    status = F.when(F.col("b").isNull(), "name-not-matched").when(code.isNull(), "ambiguous").otherwise("matched")
    return out.select("id", F.coalesce(code, F.lit("")).alias("code"), status.alias("status"))


def merged_ledger(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Ledger rows with merged athletes, and whether a race then holds an athlete twice, which forbids the merge.
    rows: race, athlete, ...; merges: sub, main."""
    moved = rows.join(merges, rows["athlete"] == merges["sub"], "left").withColumn("athlete", F.coalesce("main", "athlete")).drop("sub", "main")
    return moved.withColumn("collides", F.count("*").over(W.partitionBy("race", "athlete")) > 1)


def coverage_class(people: DataFrame, rows: DataFrame, target: Column) -> DataFrame:
    """Whether each participant has results at the target meet, at others only, or none. people: athlete; rows: athlete, ..."""
    seen = rows.groupBy("athlete").agg(F.max(target.cast("int")).alias("hit"))
    kind = F.when(F.col("hit").isNull(), "no_history").when(F.col("hit") == 1, "has_target").otherwise("other_meets_only")
    return people.join(seen, "athlete", "left").select("athlete", kind.alias("coverage"))


def exploded_counts(rows: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """How often each item occurs in lists written with a separator; blanks don't count."""
    items = rows.select(F.explode(F.split(column, f"\\{separator}")).alias("item")).withColumn("item", F.trim("item"))
    return items.where("item <> ''").groupBy("item").agg(F.count("*").alias("n"))


def folded_counts(rows: DataFrame, team: str, least: int) -> DataFrame:
    """Athletes by team, teams of fewer than ``least`` as one. rows: athlete and the team's column."""
    by = rows.groupBy(F.col(team).alias("team")).agg(F.countDistinct("athlete").alias("n"))
    return by.groupBy(F.when(F.col("n") >= least, F.col("team")).otherwise("(small)").alias("team")).agg(F.sum("n").alias("n_athletes"), F.count("*").alias("n_teams"))


def age_reversals(rows: DataFrame) -> DataFrame:
    """How often the median age of an athlete's season is below that of the season before. rows: athlete, season, age."""
    by = rows.groupBy("athlete", "season").agg(F.percentile("age", F.lit(0.5)).alias("age"))
    before = F.lag("age").over(W.partitionBy("athlete").orderBy("season"))
    return by.withColumn("before", before).groupBy("athlete").agg(F.count("*").alias("n_seasons"), F.sum((F.coalesce(F.col("age") < F.col("before"), F.lit(False))).cast("long")).alias("n_reversals"))


def filled_years(rows: DataFrame) -> DataFrame:
    """A missing year from the athlete's other rows of the meet, else from anyone's, else from the meet's number; and where
    it came from. rows: row, athlete, meet, year, numbered (the year that the meet's number stands for, or null)."""
    own = F.min("year").over(W.partitionBy("athlete", "meet"))
    any_ = F.min("year").over(W.partitionBy("meet"))
    source = F.when(F.col("year").isNotNull(), "own").when(own.isNotNull(), "athlete").when(any_.isNotNull(), "meet").when(F.col("numbered").isNotNull(), "number").otherwise("none")
    return rows.select("row", F.coalesce(F.col("year"), own, any_, F.col("numbered")).alias("year"), source.alias("source"))


def last_by_age(history: DataFrame) -> DataFrame:
    """Each athlete's last rating at every age. history: athlete, age, day, mu."""
    top = F.max(F.struct("day", "mu")).alias("t")
    return history.groupBy("athlete", "age").agg(top).select("athlete", "age", F.col("t.mu").alias("mu"))


def birth_audit(rows: DataFrame) -> DataFrame:
    """One row: athletes, those without a birth year, those with several, and the share with exactly one.
    rows: athlete, birth_year."""
    by = rows.groupBy("athlete").agg(F.countDistinct("birth_year").alias("n"))
    count = lambda c: F.sum(c.cast("long"))
    return by.agg(
        F.count("*").alias("n_athletes"), count(F.col("n") == 0).alias("n_missing"), count(F.col("n") > 1).alias("n_conflicts"),
        F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("share_one"),
    )


def component_shares(members: DataFrame) -> DataFrame:
    """Athletes, components, and the size and share of the largest and second, of each graph.
    members: graph, athlete, component."""
    sizes = members.groupBy("graph", "component").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("graph").orderBy(F.desc("n"), "component"))
    top = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return sizes.withColumn("k", place).groupBy("graph").agg(
        F.sum("n").alias("n_athletes"), F.count("*").alias("n_components"), top(1).alias("largest"), top(2).alias("second"),
        F.round(top(1) / F.sum("n"), 6).alias("giant_ratio"),
    )


def division_links(rows: DataFrame) -> DataFrame:
    """Divisions that share athletes, and how many: a graph over the few divisions. rows: athlete, division."""
    one = rows.select("athlete", "division").distinct()
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col("a.athlete") == F.col("b.athlete")) & (F.col("a.division") < F.col("b.division")))
    return met.groupBy(F.col("a.division").alias("one"), F.col("b.division").alias("two")).agg(F.count("*").alias("n_athletes"))


def isolated_cells(rows: DataFrame) -> DataFrame:
    """Cells of season and division none of whose athletes is in another division of the season. rows: athlete, season, division."""
    one = rows.select("athlete", "season", "division").distinct()
    many = one.withColumn("n", F.count("*").over(W.partitionBy("athlete", "season")))
    by = many.groupBy("season", "division").agg(F.count("*").alias("n_athletes"), F.max("n").alias("most"))
    return by.where("most = 1").select("season", "division", "n_athletes")
