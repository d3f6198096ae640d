import re

import pytest
from helpers import WORD, empty, frame, texts
from paceline.llm import quality_rules, url_filters
from paceline.llm.registry import URL_RULES

SYMBOLS = set("#*$%&|<>")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams: dict = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    df, rows = frame(spark, texts())
    got = sorted((tuple(r)[:6] + (r["base_failed"],) for r in quality_rules.judge(df).collect()), key=str)
    want = []
    for r in rows:
        n, chars, symbols, dup, rep = brute(r[1])
        want.append((r[0], n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n))
    assert got == sorted(want, key=str)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_keeps_clean_and_takes_out_lines(spark):
    clean = " ".join(f"word{i}" for i in range(80)) + ".\nShort one.\nThe end."
    menu = "Home | News | Sport | About\n" + clean
    junk = "\n".join(" | ".join(f"item{i}{j}" for j in range(9)) for i in range(12))
    marks = " ".join(f"word{i}***" for i in range(90)) + "."
    df, _ = frame(spark, [clean, menu, junk, marks], repeat=False)
    kept = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert set(kept) == {0, 3} and kept[0]["text"] == clean == kept[3]["text"] and kept[3]["n_chars"] == len(clean)


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.Example.COM/en/7?x=/en/", "https://example.com/en/8#a", "http://com/en/", "http://x.com/en", "ftp://a.example.net/de/81", "http://b.net/de/8", "http://example.org/es/\n/x", "http://org/es/", "http://notexample.com.evil/en/7", "x://y://example.com/en/7", "http://com?/en/", "http://com#/en/", "http://.com/en/"]
    rows = [(i, u, "h", "extra") for i, u in enumerate(urls)] + [(3, urls[3], "h", "extra"), (None, urls[4], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_filters.judge(df, URL_RULES).collect()), key=str)
    assert got == sorted(((r[0], *judged(r[1])) for r in rows), key=str)
    assert url_filters.judge(df, []).where("verdict = 'allow' and rule is null").count() == len(rows)
    assert url_filters.judge(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("name", ["op1_url_filters", "op6_quality_rules"])
def test_native_plans(spark, name):
    from paceline.llm.registry import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
