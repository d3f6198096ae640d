"""Expressions that read the sport's own texts: events, rounds, categories, divisions, schools, dates and statuses.

All are built-in expressions, so they stay inside generated code. A null text counts as empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.scalars import first_int, let, norm, school_grade, stage_of_grade

# Words and codes of the result sheets.
DISTANCES = "(500|1000|1500|2000|3000)M"
SEPARATORS = "[\\s\\-_/·.]+"
OPEN_CATEGORIES = ("남자부", "여자부", "MEN", "WOMEN")
#: Words of a category, in the order they are tested, with the stage they stand for.
CATEGORY_WORDS = (
    ("kindergarten", "excluded", ("유치",)),
    ("elementary", "elementary", ("초등", "12세이하")),
    ("middle", "middle", ("중학", "중등", "주니어")),
    ("high", "high", ("고등", "고교", "남고부", "여고부")),
    ("college", "college", ("대학", "일반", "실업", "동호인")),
)
SCHOOL_SUFFIXES = (("초", "등학교"), ("중", "학교"), ("고", "등학교"), ("대", "학교"))
SCHOOL_GROUPS = (("초등학교", "초"), ("중학교", "중"), ("고등학교", "고"), ("대학교", "대"))
EMPLOYERS = ("시청", "도청", "군청", "구청", "실업", "공사", "은행", "협회", "연맹", "클럽", "체육회")
REGIONS = (
    "서울특별시", "부산광역시", "대구광역시", "인천광역시", "광주광역시", "대전광역시", "울산광역시", "세종특별자치시",
    "강원특별자치도", "전북특별자치도", "제주특별자치도", "경기도", "강원도", "충청북도", "충청남도", "전라북도", "전라남도", "경상북도",
    "경상남도", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주",
)
RELAY = "(?i)릴레이|relay|계주"
SPEED, SHORT_TRACK, FIGURE = "1", "2", "3"
PENALTY_WORDS = ("pen", "dq", "disq", "disqualified", "실격", "부정출발")
NO_START_WORDS = ("dns", "출발전포기", "경기전포기", "미출전", "기권")
NO_FINISH_WORDS = ("dnf", "no time", "ret", "withdraw", "경기중포기", "경기중 기권", "포기")
FINISH_WORDS = ("", "ok", "finished", "finish", "완주", "정상완주", "v-sr")
WINTER_GAMES, FIRST_GAMES, FIRST_GAMES_YEAR = "전국동계체육대회", 88, 2007
ROUND_ORDER = {"heat": 1, "quarterfinal": 2, "semifinal": 3, "final_b": 4, "final": 5, "other": 9}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def compact(c: Column) -> Column:
    return F.replace(norm(c), F.lit(" "), F.lit(""))


# Events, rounds, disciplines


def event_detail(name: Column) -> tuple[Column, Column]:
    """Distance in metres (null if none is named) and whether the event is a super final."""
    t = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit(""))
    return F.nullif(F.regexp_extract(t, DISTANCES, 1), F.lit("")).cast("long"), has_any(t, ("S.F", "SF"))


def round_of(name: Column, kind: Column) -> Column:
    """The round's class; the kind, where there is one, says it."""
    t = F.replace(F.coalesce(F.nullif(norm(kind), F.lit("")), norm(name)), F.lit(" "), F.lit(""))
    return let(t, lambda t:
        F.when(F.contains(t, F.lit("채점종합")), "score").when(F.startswith(t, F.lit("결승B")), "final_b")
        .when(F.startswith(t, F.lit("결승")), "final").when(F.contains(t, F.lit("준준결승")), "quarterfinal")
        .when(F.contains(t, F.lit("준결승")), "semifinal").when(F.contains(t, F.lit("예선")), "heat").otherwise("other")
    )


def heat_number(name: Column) -> Column:
    """Digits before the word for group, or after heat; empty if there are none."""
    t = norm(name)
    return F.coalesce(
        F.nullif(F.regexp_extract(t, "(?i)([0-9]+)\\s*조|heat\\s*([0-9]+)", 1), F.lit("")),
        F.regexp_extract(t, "(?i)([0-9]+)\\s*조|heat\\s*([0-9]+)", 2),
    )


def discipline(mapped: Column, meet: Column, name: Column, kind: Column) -> Column:
    """Class code of a row: a mapped speed or figure code; else speed where the round is a bare group or the meet says so."""
    m, meet_text = norm(mapped), norm(meet)
    bare = (round_of(name, kind) == "other") & compact(name).rlike("^[0-9]+조$")
    speed = F.contains(meet_text, F.lit("스피드")) & ~F.contains(meet_text, F.lit("쇼트트랙"))
    return F.when(m.isin(SPEED, FIGURE), m).when(bare | speed, SPEED).otherwise(SHORT_TRACK)


def is_relay(*texts: Column) -> Column:
    return F.concat_ws(" ", *[norm(t) for t in texts]).rlike(RELAY)


def is_hobby(category: Column) -> Column:
    return F.contains(norm(category), F.lit("동호인"))


def is_team(entry_kind: Column, detail_code: Column, *texts: Column) -> Column:
    """Rows of teams: entered as a team, a detail code that ends in 07, or a relay by any text."""
    return (norm(entry_kind) == "T") | F.endswith(norm(detail_code), F.lit("07")) | is_relay(*texts)


# Categories and stages


def category_key(category: Column) -> Column:
    return F.regexp_replace(F.upper(norm(category)), SEPARATORS, "")


def category_stage(category: Column) -> Column:
    """Struct: the category's key, the stage that its words stand for, and the rule that told."""

    def told(key: Column) -> Column:
        rule = F.when(key == "", "empty").when(key.isin(*OPEN_CATEGORIES), "open")
        for name, _, words in CATEGORY_WORDS:
            rule = rule.when(has_any(key, words), name)
        return F.struct(key.alias("key"), rule.otherwise("other").alias("rule"))

    def staged(t: Column) -> Column:
        stage = F.when(t["rule"] == "open", "open")
        for name, means, _ in CATEGORY_WORDS:
            stage = stage.when(t["rule"] == name, means)
        return F.struct(t["key"].alias("key"), stage.otherwise("excluded").alias("stage"), t["rule"].alias("rule"))

    return let(let(category_key(category), told), staged)


def resolved_stage(category: Column, birth_year: Column, season: Column) -> Column:
    """Struct: stage, stage_category, stage_grade, grade, source, category_key, category_rule.

    Open categories stand; then the grade by birth year, which also excludes; then the category; else null."""
    grade = school_grade(season, birth_year)
    by_grade = F.when(grade.isNotNull(), stage_of_grade(grade))

    def resolve(t: Column) -> Column:
        c, by_category, g = t["c"], t["c"]["stage"], t["g"]
        graded = F.coalesce(g.isin("elementary", "middle", "high", "college"), F.lit(False))
        stage = F.when(by_category == "open", "open").when(graded, g).when(g.isNull() & (by_category != "excluded"), by_category)
        source = (
            F.when(by_category == "open", "open_category").when(graded, "birth_year").when(g == "excluded", "grade_excluded")
            .when(by_category != "excluded", "category_fallback").otherwise("excluded_or_unknown")
        )
        return F.struct(
            stage.alias("stage"), by_category.alias("stage_category"), g.alias("stage_grade"), t["n"].alias("grade"),
            source.alias("source"), c["key"].alias("category_key"), c["rule"].alias("category_rule"),
        )

    return let(F.struct(category_stage(category).alias("c"), by_grade.alias("g"), grade.alias("n")), resolve)


# Divisions and race identity


def division(category: Column, gender: Column) -> tuple[Column, Column]:
    """Gender (one character, from the category's prefix where it has no column) and the band that remains."""
    c, g = norm(category), norm(gender)
    prefix = F.regexp_extract(c, "^(남자|여자|남|여)", 1)
    return F.substring(F.coalesce(F.nullif(g, F.lit("")), prefix), 1, 1), F.trim(F.regexp_replace(c, "^(남자|여자|남|여)", ""))


def division_key(category: Column, gender: Column) -> Column:
    g, band = division(category, gender)
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return F.concat(dash(g), F.lit(":"), dash(band))


def event_key(event: Column, category: Column, distance: Column) -> Column:
    """The event's name, or category and distance where it has none."""
    e, c, d = norm(event), norm(category), norm(distance)
    both = F.when((c != "") & (d != ""), F.concat(c, F.lit("-"), d, F.lit("m"))).when(c != "", c).otherwise(d)
    return F.when(e != "", e).otherwise(both)


def piece(c: Column) -> Column:
    return F.replace(norm(c), F.lit("|"), F.lit("/"))


def meet_key(meet_id: Column, season: Column, meet: Column) -> Column:
    own = piece(meet_id)
    named = F.when((piece(season) != "") | (piece(meet) != ""), F.concat(piece(season), F.lit(":"), piece(meet))).otherwise("")
    return F.when(own != "", own).otherwise(named)


def race_key(meet: Column, event: Column, category: Column, gender: Column, name: Column, kind: Column, super_final: Column, date: Column) -> Column:
    """meet|division|event|round|heat|super final|date; empty if meet, event, round or division is unknown."""
    text = F.coalesce(F.nullif(norm(name), F.lit("")), norm(kind))
    parts = F.struct(meet.alias("m"), event.alias("e"), division_key(category, gender).alias("d"), text.alias("r"))
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))

    def joined(t: Column) -> Column:
        plain = [F.replace(t[x], F.lit("|"), F.lit("/")) for x in ("d", "e", "r")]
        whole = F.concat_ws("|", t["m"], *plain, dash(heat_number(t["r"])), dash(F.upper(piece(super_final))), dash(piece(date)))
        return F.when((t["m"] != "") & (t["e"] != "") & (t["r"] != "") & (t["d"] != "-:-"), whole).otherwise("")

    return let(parts, joined)


# Schools


def school_key(c: Column) -> Column:
    """A school's name without white space, its kind written out."""
    t = F.regexp_replace(norm(c), "\\s+", "")
    ends = [F.when(F.endswith(t, F.lit(end)), F.lit(more)) for end, more in SCHOOL_SUFFIXES]
    return F.concat(t, F.coalesce(*ends, F.lit("")))


def school_group(key: Column) -> Column:

    def told(t: Column) -> Column:
        out = F
        for end, group in SCHOOL_GROUPS:
            out = out.when(F.endswith(t, F.lit(end)), group)
        return out.when(has_any(t, EMPLOYERS), "실업").otherwise("기타")

    return let(norm(key), told)


def region_prefix(key: Column) -> Column:
    """The longest region that a name begins with, if anything follows it; else empty."""

    def told(t: Column) -> Column:
        out = F
        for r in sorted(REGIONS, key=len, reverse=True):
            out = out.when(F.startswith(t, F.lit(r)) & (F.length(t) > len(r)), r)
        return out.otherwise("")

    return let(norm(key), told)


def without_region(key: Column) -> Column:
    return F.substr(norm(key), F.length(region_prefix(key)) + 1)


# Dates and years


def meet_year(*dates: Column) -> Column:
    """Of the first date text with one: its first four digits between 1900 and 2099, else any 19xx or 20xx in it."""
    found = []
    for d in dates:
        t = F.trim(F.coalesce(d, F.lit("")))
        head = F.regexp_extract(t, "^([0-9]{4})", 1).try_cast("long")
        found += [F.when(head.between(1900, 2099), head), F.nullif(F.regexp_extract(t, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("long")]
    return F.coalesce(*found)


def month_of(*dates: Column) -> Column:
    """Month of the first text that is a whole date, written 2020-01-31, 2020.1.31 or 2020/1/31."""
    found = []
    for d in dates:
        for form in ("^(?:19|20)[0-9]{2}-([0-9]{2})-[0-9]{2}$", "^(?:19|20)[0-9]{2}[./]([0-9]{1,2})[./][0-9]{1,2}$"):
            m = F.regexp_extract(norm(d), form, 1).try_cast("long")
            found.append(F.when(m.between(1, 12), m))
    return F.coalesce(*found)


def season_of(year: Column, *dates: Column, first_month: int = 7) -> Column:
    return F.when(month_of(*dates) < first_month, year - 1).otherwise(year)


def birth_year(c: Column) -> Column:
    y = first_int(norm(c))
    return F.when(y.between(1900, 2099), y)


def birth_format(c: Column) -> Column:
    """What a birth field holds: nothing, a year, a year in digits, a month or day as well, or something else."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", "")
    return (
        F.when(t.isin("", "년"), "empty_or_year_marker").when(t.rlike("^(19|20)[0-9]{2}년$"), "year_only")
        .when(t.rlike("^(19|20)[0-9]{2}[-./][0-9]{1,2}([-./][0-9]{1,2})?$|^(19|20)[0-9]{2}년[0-9]{1,2}월([0-9]{1,2}일)?$|^(19|20)[0-9]{6}$"), "month_or_day_present")
        .when(t.rlike("^(19|20)[0-9]{2}$"), "year_digits_only").otherwise("other")
    )


def winter_games_year(meet: Column) -> Column:
    """The year of the n-th national winter games; null for other meets."""
    t = norm(meet)
    n = F.nullif(F.regexp_extract(t, "제\\s*([0-9]+)\\s*회", 1), F.lit("")).cast("long")
    return F.when(F.contains(t, F.lit(WINTER_GAMES)), n - FIRST_GAMES + FIRST_GAMES_YEAR)


# Results


def status_of(status: Column, advanced: Column, place: Column, time: Column) -> Column:
    """FIN, PEN, DNF, DNS, ADV or UNKNOWN. place and time are parsed; a finish without either did not start."""
    nothing = place.isNull() & time.isNull()

    def told(s: Column) -> Column:
        return (
            F.when(F.contains(F.lower(norm(advanced)), F.lit("adv")) | F.contains(s, F.lit("adv")), "ADV")
            .when(s.isin(*FINISH_WORDS), F.when(nothing, "DNS").otherwise("FIN"))
            .when(has_any(s, PENALTY_WORDS), "PEN").when(has_any(s, NO_START_WORDS), "DNS").when(has_any(s, NO_FINISH_WORDS), "DNF")
            .when(~nothing, "FIN").otherwise("UNKNOWN")
        )

    return let(F.lower(norm(status)), told)


# Bands, numbers, keys


def games_band(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n <= 5, "0-5").when(n <= 20, "6-20").otherwise("21+")


def age_band(age: Column) -> Column:
    a = F.coalesce(age, F.lit(0))
    return F.when(a <= 0, "(unknown-age)").when(a <= 12, "<=12").when(a <= 15, "13-15").otherwise("16+")


def tercile_band(value: Column, q1: Column, q2: Column) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v <= q1, "low").when(v <= q2, "mid").otherwise("high")


def reverse_band(percentile: Column) -> Column:
    return F.when(percentile.isNull(), "").when(percentile >= 70, "upper").when(percentile >= 30, "middle").otherwise("lower")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def binary_entropy(p: Column, edge: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def clock(seconds: Column) -> Column:
    """Seconds as text, from a minute on with the minutes, in the sport's units."""
    minute = F.floor(seconds / 60)
    rest = seconds - minute * 60
    return F.when(seconds < 60, F.format_string("%.2f초", seconds)).otherwise(F.format_string("%d분 %05.2f초", minute, rest))


def first_by_hash(*parts: Column) -> Column:
    """A fair coin fixed by the parts: whether their SHA-256 is even."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int") % 2 == 0


def slug_text(c: Column, otherwise: str = "meet") -> Column:
    """Lower-cased words of any script, joined by hyphens."""
    t = F.regexp_replace(F.lower(norm(c)), "[^\\p{L}\\p{N}\\s-]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\\s+", "-"), "-{2,}", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(t == "", otherwise).otherwise(t)


def trim_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters that fits into so many UTF-8 bytes."""
    letters = F.split(c, "")
    running = F.aggregate(
        letters, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda s, x: F.when(s["full"] | (F.octet_length(s["text"]) + F.octet_length(x) > most), F.struct(s["text"].alias("text"), F.lit(True).alias("full")))
        .otherwise(F.struct(F.concat(s["text"], x).alias("text"), F.lit(False).alias("full"))),
    )
    kept = F.when(F.octet_length(c) <= most, c).otherwise(running["text"])
    return F.regexp_replace(kept, "^-+|-+$", "")


def meet_slug(year: Column, name: Column, most: int = 80) -> Column:
    """year-words-digest: the name's words without a leading year, cut to so many bytes, and eight digits of a hash."""
    words = slug_text(name)
    bare = F.when(F.startswith(words, F.concat(year.cast("string"), F.lit("-"))), F.substr(words, F.length(year.cast("string")) + 2)).otherwise(words)
    digest = F.left(F.sha1(F.concat(year.cast("string"), F.lit(":"), norm(name))), F.lit(8))
    return F.concat_ws("-", year.cast("string"), trim_bytes(F.coalesce(F.nullif(bare, F.lit("")), words), most), digest)

