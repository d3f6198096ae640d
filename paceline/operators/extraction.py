"""From raw result rows to the race ledger: canonical columns, filters with reasons, policies, sequences, comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions import domain as D
from paceline.functions.scalars import first_int, norm, padded, parse_seconds, season_start
from paceline.storage import cut

RAW = (
    "athlete_id", "race_id", "meet_id", "meet_name", "season_text", "date", "event", "category", "gender", "distance_text",
    "round", "round_kind", "sf_flag", "class_cd", "race_seq", "place", "time", "status", "advanced", "birth_year",
)


@dataclass(frozen=True)
class Policy:
    """What becomes of rows without a plain finish, and which rounds count."""

    penalty: str = "exclude"  # or last_place
    no_finish: str = "exclude"  # or loss_to_finishers
    advanced: str = "exclude"  # or keep
    rounds: tuple[str, ...] = ("heat", "quarterfinal", "semifinal", "final", "final_b")
    weights: tuple[tuple[str, float], ...] = ()
    min_season: int = 2013
    hobby: bool = False


POLICIES = {
    "conservative": Policy(),
    "aggressive": Policy("last_place", "loss_to_finishers", "keep", ("heat", "quarterfinal", "semifinal", "final", "final_b", "other")),
    "place_only": Policy("last_place", "exclude", "keep", ("final", "final_b")),
}


def canonical(raw: DataFrame) -> DataFrame:
    """Parsed columns beside the raw ones: event, place_num, seq, time_sec, season, round_class, is_relay, is_hobby, division,
    gender, birth, discipline, status_norm, and race_id rebuilt where the source has none."""
    t = raw.select(*[norm(F.col(c)).alias(c) if c in raw.columns else F.lit("").alias(c) for c in RAW])
    event = D.event_key(F.col("event"), F.col("category"), F.col("distance_text"))
    named = first_int(F.col("season_text"))
    season = F.coalesce(F.when(named.between(1900, 2099), named), F.nullif(F.regexp_extract("date", "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("long"))
    gender, band = D.division(F.col("category"), F.col("gender"))
    meet = D.meet_key(F.col("meet_id"), F.col("season_text"), F.col("meet_name"))
    key = D.race_key(meet, event, F.col("category"), F.col("gender"), F.col("round"), F.col("round_kind"), F.col("sf_flag"), F.col("date"))
    place, time = first_int(F.col("place")), parse_seconds(F.col("time"))
    rows = t.select(
        "athlete_id", "meet_id", "date", "round", "round_kind", "category", event.alias("event"), place.alias("place_num"),
        first_int(F.col("race_seq")).alias("seq"), time.alias("time_sec"), season.alias("season"),
        D.round_of(F.col("round"), F.col("round_kind")).alias("round_class"),
        D.is_relay(F.col("event"), F.col("round"), F.col("round_kind"), F.col("meet_name"), F.col("category")).alias("is_relay"),
        D.is_hobby(F.col("category")).alias("is_hobby"), gender.alias("gender"), band.alias("band"),
        D.division_key(F.col("category"), F.col("gender")).alias("division"), D.birth_year(F.col("birth_year")).alias("birth"),
        D.discipline(F.col("class_cd"), F.col("meet_name"), F.col("round"), F.col("round_kind")).alias("discipline"),
        D.status_of(F.col("status"), F.col("advanced"), place, time).alias("status_norm"),
        F.when(F.col("race_id") != "", F.col("race_id")).otherwise(key).alias("race_id"),
    )
    return cut(rows)


def exclusion(policy: Policy) -> Column:
    """Why a canonical row is left out of the ledger's input, by the first rule it breaks; 'kept' else."""
    out = (
        F.when(F.col("athlete_id") == "", "no_athlete").when(F.col("race_id") == "", "no_race")
        .when(F.col("discipline") != D.SHORT_TRACK, "discipline").when(F.col("is_relay"), "relay")
        .when(F.col("round_class") == "score", "score_round")
        .when(F.coalesce(F.col("season"), F.lit(0)) < policy.min_season, "season")
    )
    return (out if policy.hobby else out.when(F.col("is_hobby"), "hobby")).otherwise("kept")


def exclusion_log(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.groupBy(exclusion(policy).alias("reason")).agg(F.count("*").alias("n_rows"))


def prepared(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows of the policy's rounds, one of each athlete in a race (least place, then time), with the round's weight."""
    kept = rows.where(exclusion(policy) == "kept").where(F.col("round_class").isin(*policy.rounds))
    best = F.struct(F.col("place_num").isNull(), "place_num", F.col("time_sec").isNull(), "time_sec")
    others = [c for c in kept.columns if c not in ("race_id", "athlete_id")]
    one = kept.groupBy("race_id", "athlete_id").agg(F.min(F.struct(best, F.struct(*others))).alias("x"))
    weight = F.lit(1.0)
    for name, w in policy.weights:
        weight = F.when(F.col("round_class") == name, w).otherwise(weight)
    return one.select("race_id", "athlete_id", *[F.col(f"x.col2.{c}").alias(c) for c in others]).withColumn("weight", weight)


def penalty_rate(rows: DataFrame, policy: Policy) -> DataFrame:
    """Share of penalised rows among all that pass the structural filters, before a policy drops them."""
    kept = rows.where(exclusion(policy) == "kept")
    return kept.agg(F.count("*").alias("n_rows"), F.round(F.avg((F.col("status_norm") == "PEN").cast("double")), 6).alias("penalty_rate"))


def placed(rows: DataFrame, policy: Policy) -> DataFrame:
    """Participants with their effective place: finishers by place, penalised rows after the race's last place in athlete
    order, those who did not finish without a place. Rows that the policy leaves out are gone, as are races of one."""
    race = W.partitionBy("race_id")
    sized = rows.withColumn("n_rows", F.count("*").over(race)).withColumn("last", F.coalesce(F.max("place_num").over(race), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("race_id", "status_norm").orderBy("athlete_id"))
    out = sized.where("n_rows >= 2").withColumn("nth", nth)
    status = F.col("status_norm")
    gone = status == "DNS"
    for value, rule in (("PEN", policy.penalty), ("DNF", policy.no_finish), ("ADV", policy.advanced)):
        if rule == "exclude":
            gone = gone | (status == value)
    place = F.when(status == "PEN", F.col("last") + F.col("nth")).when(status != "DNF", F.when(F.col("place_num") > 0, F.col("place_num")))
    return out.where(~gone).withColumn("effective", place.cast("long")).drop("n_rows", "last", "nth")


def comparisons(people: DataFrame, policy: Policy) -> DataFrame:
    """Winner and loser of every two of different effective place in a race, and, where the policy says so, of every finisher
    and every athlete who did not finish. The join is on the race, whose size the sport bounds."""
    ranked = people.where(F.col("effective").isNotNull() & F.col("status_norm").isin("FIN", "ADV", "PEN"))
    a, b = ranked.alias("a"), ranked.alias("b")

    def out(met: DataFrame, place: Column) -> DataFrame:
        return met.select(
            F.col("a.race_id").alias("race_id"), F.col("a.athlete_id").alias("winner"), F.col("b.athlete_id").alias("loser"),
            F.col("a.effective").alias("winner_place"), place.alias("loser_place"),
            F.concat_ws("-", "a.status_norm", "b.status_norm").alias("statuses"), F.col("a.round_class").alias("round_class"),
            F.col("a.season").alias("season"), F.col("a.weight").alias("weight"),
        )

    same = F.col("a.race_id") == F.col("b.race_id")
    met = out(a.join(b, same & (F.col("a.effective") < F.col("b.effective"))), F.col("b.effective"))
    if policy.no_finish != "loss_to_finishers":
        return met
    lost = people.where("status_norm = 'DNF'").alias("b")
    finishers = ranked.where(F.col("status_norm") != "PEN").alias("a")
    return met.unionByName(out(finishers.join(lost, same), F.lit(None).cast("long")))


def sequenced(races: DataFrame) -> DataFrame:
    """race_seq of each race in its day and meet: explicit positive numbers first (the first race in order keeps one that is
    named twice), all others in order into the lowest free numbers. races: race_id, day, meet, seq and the order's columns
    event, round_class, heat, round_kind.

    A group's taken numbers t1 < t2 < ... leave t_i - i free ones before t_i, so the k-th free number is k plus how many
    taken ones have fewer than k free ones before them; no race waits for another."""
    known = F.create_map(*[F.lit(x) for kv in D.ROUND_ORDER.items() for x in kv])
    order = [F.col("event"), F.coalesce(known[F.col("round_class")], F.lit(99)), F.col("heat"), F.col("round_kind"), F.col("race_id")]
    group = W.partitionBy("day", "meet")
    first = F.row_number().over(W.partitionBy("day", "meet", "seq").orderBy(*order)) == 1
    marked = races.withColumn("explicit", F.when(first & (F.col("seq") > 0), F.col("seq")))
    taken = F.array_sort(F.collect_set("explicit").over(group))
    k = F.row_number().over(W.partitionBy("day", "meet", F.col("explicit").isNull()).orderBy(*order))
    ready = marked.withColumn("taken", taken).withColumn("k", k.cast("long"))
    before = F.size(F.filter(F.transform("taken", lambda t, i: t - i - 1), lambda free: free < F.col("k")))
    return ready.withColumn("race_seq", F.coalesce("explicit", F.col("k") + before)).drop("explicit", "taken", "k")


def date_in(text: Column) -> Column:
    """The first date in a text: a year 19xx or 20xx, month and day with anything but digits between them; else null."""
    form = "((?:19|20)[0-9]{2})[^0-9]*([0-9]{1,2})[^0-9]*([0-9]{1,2})"
    return F.try_to_date(F.concat_ws("-", *[F.regexp_extract(text, form, i) for i in (1, 2, 3)]), "yyyy-M-d")


def day_of(date: Column, season: Column) -> Column:
    """yyyyMMdd of the date in a text, else the first of January of the season, else zeros."""
    return F.coalesce(F.date_format(date_in(date), "yyyyMMdd"), F.concat(season.cast("string"), F.lit("0101")), F.lit("00000000"))


def ledger(rows: DataFrame, policy: Policy) -> DataFrame:
    """A row for each ranked participant, with race sequence and ordering keys; athletes who did not finish come after
    the last rank by time and identifier."""
    people = placed(rows, policy)
    race = W.partitionBy("race_id")
    top = F.coalesce(F.max("effective").over(race), F.lit(0))
    behind = F.row_number().over(W.partitionBy("race_id", "status_norm").orderBy(F.col("time_sec").asc_nulls_last(), "athlete_id"))
    ranked = people.withColumn("top", top).withColumn("behind", behind)
    ranked = ranked.withColumn("rank", F.when(F.col("status_norm") == "DNF", F.col("top") + F.col("behind")).otherwise(F.col("effective")).cast("long"))
    ranked = ranked.where("rank > 0").withColumn("day", day_of(F.col("date"), F.col("season")))
    ranked = ranked.withColumn("season", F.coalesce(season_start(date_in(F.col("date"))), F.col("season")))
    heat = F.coalesce(F.nullif(D.heat_number(F.col("round")), F.lit("")).cast("long"), F.lit(0))
    meet = F.coalesce(F.nullif(D.piece(F.col("meet_id")), F.lit("")), F.lit("-"))
    told = ranked.withColumn("meet", meet).withColumn("heat", heat)
    races = told.groupBy("race_id").agg(
        F.min("day").alias("day"), F.min("meet").alias("meet"), F.min("seq").alias("seq"), F.min("event").alias("event"),
        F.min("round_class").alias("round_class"), F.min("heat").alias("heat"), F.min("round_kind").alias("round_kind"),
    )
    keyed = told.drop("seq", "day", "meet", "heat").join(sequenced(races).select("race_id", "day", "meet", "race_seq"), "race_id")
    prefix = F.concat_ws("|", "day", "meet", padded(F.col("race_seq")), D.piece(F.col("race_id")))
    out = keyed.withColumn("race_ordering_key", prefix)
    key = F.concat_ws("|", "race_ordering_key", padded(F.col("rank")), D.piece(F.col("athlete_id")))
    return out.select("race_ordering_key", key.alias("ordering_key"), "race_id", "athlete_id", "rank", F.col("status_norm").alias("status"), "day", "meet", "race_seq", "season", "round_class", "weight")


def pairwise(book: DataFrame) -> DataFrame:
    """Comparisons of ledger rows with their weight in ratings, the mean of both rows' weights over n - 1. Two who did not
    finish are not compared; each of them lost to every finisher."""
    sized = book.withColumn("n", F.count("*").over(W.partitionBy("race_id")))
    a, b = sized.alias("a"), sized.alias("b")
    ranked = F.col("a.status").isin("FIN", "ADV", "PEN") & F.col("b.status").isin("FIN", "ADV", "PEN") & (F.col("a.rank") < F.col("b.rank"))
    lost = F.col("a.status").isin("FIN", "ADV") & (F.col("b.status") == "DNF")
    met = a.join(b, (F.col("a.race_id") == F.col("b.race_id")) & (ranked | lost))
    return met.select(
        F.col("a.race_id").alias("race_id"), F.col("a.athlete_id").alias("winner"), F.col("b.athlete_id").alias("loser"),
        F.col("a.rank").alias("winner_rank"), F.col("b.rank").alias("loser_rank"),
        F.concat_ws("-", "a.status", "b.status").alias("statuses"),
        F.round((F.col("a.weight") + F.col("b.weight")) / 2 / (F.col("a.n") - 1), 6).alias("weight"),
    )


def race_sizes(book: DataFrame) -> DataFrame:
    """One row: races, their sizes' spread and the share of races of four to six."""
    sizes = book.groupBy("race_id").agg(F.countDistinct("athlete_id").alias("n"))
    at = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return sizes.agg(
        F.count("*").alias("n_races"), F.min("n").alias("least"), F.round(at[0], 6).alias("p10"), F.round(at[1], 6).alias("p50"),
        F.round(at[2], 6).alias("p90"), F.max("n").alias("most"), F.round(F.avg(F.col("n").between(4, 6).cast("double")), 6).alias("share_4_to_6"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"),
    )


def pair_counts(book: DataFrame) -> DataFrame:
    """How many comparisons each athlete can have: n - 1 for each race of n."""
    one = book.select("race_id", "athlete_id").distinct()
    sized = one.withColumn("n", F.count("*").over(W.partitionBy("race_id")))
    return sized.groupBy("athlete_id").agg(F.sum(F.col("n") - 1).alias("n_pairs"), F.count("*").alias("n_races"))


def ledger_faults(book: DataFrame, ties: int = 3) -> DataFrame:
    """How many ledger rows or races break each rule: repeated athletes, ties of more than ``ties``, a rank below 1, two
    races with one key, keys that do not sort races by day, and comparisons of an athlete with itself."""
    athletes = book.groupBy("race_id", "athlete_id").agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("n"))
    tied = book.where("status in ('FIN', 'ADV')").groupBy("race_id", "rank").agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > ties).cast("long")).alias("n"))
    keys = book.groupBy("race_ordering_key").agg(F.countDistinct("race_id").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("n"))
    low = book.agg(F.sum((F.col("rank") < 1).cast("long")).alias("n"), F.sum((~F.startswith("ordering_key", F.col("day"))).cast("long")).alias("m"))
    rule = lambda name, df, c="n": df.select(F.lit(name).alias("rule"), F.coalesce(c, F.lit(0)).alias("n_faults"))
    return (
        rule("repeated_athlete", athletes).unionAll(rule("tie_too_wide", tied)).unionAll(rule("shared_race_key", keys))
        .unionAll(rule("rank_below_1", low)).unionAll(rule("key_without_day", low, "m"))
    )
