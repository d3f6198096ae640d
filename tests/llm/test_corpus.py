import hashlib
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import LOWER, SCHEMA, WORD, empty, frame, texts
from paceline.llm import fingerprints, katz, ngram_join, suffix_dedup


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())


def groups(rows, n, threshold):
    sets = [shingles(r[1], n) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))], key=str)


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("n, threshold", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, hot, n, threshold):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    df, rows = frame(spark, texts(4, 12))
    got = sorted((tuple(r)[:3] for r in ngram_join.join(df, n, threshold).collect()), key=str)
    assert got == groups(rows, n, threshold)


def test_join_odd_tables(spark):
    assert ngram_join.join(empty(spark)).count() == 0
    df, rows = frame(spark, texts(4, 5))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, n, c in groups(rows, 5, 80) if n}
    assert {r["doc_id"] for r in kept.where("trim(text) <> ''").collect()} >= {c for c in want if c is not None}


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "the same words in every row of this", 1, 2, 3), (2, "the same words in every row of this", 4, 5, 6), (3, None, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lead_id long, OWN_hash long, lead_hash_ long")
    assert sorted(tuple(r) for r in ngram_join.keep_one(df).collect()) == [rows[0], rows[2]]


def near_copies(k):
    """k different near copies of one text, some of them near each other only through others."""
    r = random.Random(k)
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(k):
        w = list(base)
        for j in r.sample(range(80), 1 + i % 2):
            w[j] = f"x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_join_counts_every_link(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    df, rows = frame(spark, texts(4, 12) + near_copies(24))
    sets = [shingles(r[1], 4) for r in rows]
    nodes = {frozenset(s) for s in sets if s}
    link = lambda s: sum(100 * len(s & o) >= 85 * len(s | o) for o in nodes) - 1
    got = sorted(((r["doc_id"], r["n_links"]) for r in ngram_join.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(r[0], link(s) if s else 0) for r, s in zip(rows, sets)], key=str)


def test_prefix_tree_loses_nothing():
    r = np.random.default_rng(0)
    base = r.choice(2000, 200, replace=False)
    sets = [np.unique(np.concatenate([r.choice(base, 100, replace=False), r.choice(2000, 5)])) for _ in range(60)]
    tree = ngram_join.PrefixTree([(tuple(s.tolist()), len(s), 0) for s in sets], 60)
    for i, s in enumerate(sets):
        linked = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 60 * len(np.union1d(s, o))}
        assert linked <= set(tree.search(len(s), 0, frozenset(s.tolist())))


def removed(values, length):
    data = [(t or "").encode() for t in values]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 60])
def test_suffix_dedup_equals_brute_force(spark, length):
    df, rows = frame(spark, texts(8, 20))
    got = sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.dedup(df, length)).collect()), key=str)
    want = [(r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], length))]
    assert got == sorted(want, key=str)
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    assert suffix_dedup.without_repeats(df).columns == df.columns


def test_fingerprints_add_and_take_away():
    a, b = [x.encode() for x in "one two three four".split()], [b"five", b"two"]
    whole = fingerprints.fingerprint(a + b)
    assert np.array_equal(whole, fingerprints.fingerprint(b[::-1] + a))
    assert np.array_equal(whole, fingerprints.combine(fingerprints.fingerprint(a), fingerprints.fingerprint(b)))
    assert np.array_equal(fingerprints.fingerprint(a), fingerprints.combine(whole, fingerprints.fingerprint(b), -1))
    assert not np.array_equal(fingerprints.fingerprint([b"x"]), fingerprints.fingerprint([b"x", b"x"]))


@pytest.mark.parametrize("n, shared", [(20, 10), (200, 150), (2000, 1800), (2000, 0)])
def test_likeness_is_near_the_truth(n, shared):
    a = fingerprints.fingerprint([f"p{i}".encode() for i in range(n)])
    b = fingerprints.fingerprint([f"p{i if i < shared else i + 10**6}".encode() for i in range(n)])
    assert abs(fingerprints.likeness(a, b) - shared / n) < 0.25


@pytest.mark.parametrize("n, shared", [(1, 0), (20_000, 0), (20_000, 15_000), (100_000, 0)])
def test_likeness_has_no_longest_text(n, shared):
    prints = [fingerprints.fingerprint([f"p{i if i < shared else i + 10**6 * k}".encode() for i in range(n)]) for k in (1, 2)]
    assert abs(fingerprints.likeness(*prints) - shared / n) < 0.12


@pytest.mark.parametrize("repeated, single", [(1000, 1), (1000, 500), (10, 10)])
def test_likeness_weighs_repeats(repeated, single):
    once = [f"p{i}".encode() for i in range(single)]
    a, b = fingerprints.fingerprint([b"line"] * repeated + once), fingerprints.fingerprint([b"other"] * repeated + once)
    assert abs(fingerprints.likeness(a, b) - single / (repeated + single)) < 0.12


def test_likeness_of_unlike_texts():
    prints = [fingerprints.fingerprint([f"{i} {j}".encode() for j in range(5 + i % 20)]) for i in range(300)]
    found = [fingerprints.likeness(a, b) for a, b in zip(prints, prints[1:])]
    assert np.mean(found) < 0.05 and max(found) < 0.2


def test_fingerprint_query(spark):
    df, rows = frame(spark, texts(9, 20))
    got = sorted((tuple(r) for r in fingerprints.compare_edited(df).collect()), key=str)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want = []
    for i, r in enumerate(rows):
        t, f = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        p, q, z = fingerprints.fingerprint_texts([t, e, f])
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.text_of(p), fingerprints.text_of(q), fingerprints.likeness(p, q), fingerprints.likeness(p, z)))
    assert got == sorted(want, key=str)
    assert fingerprints.compare_edited(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [2, 11])
def test_katz_equals_recursion_and_adds_up(spark, seed):
    df, rows = frame(spark, [t for t in texts(seed, 40) if t is None or len(t) < 20000])
    held = lambda d: katz.fold(d) == 2
    docs = [WORD.findall((r[1] or "").translate(LOWER)) + [None] for r in rows]
    one, two = Counter(), Counter()
    for r, t in zip(rows, docs):
        if not held(r[0]):
            one.update(t)
            two.update(zip([None, *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    ones = [[sum(c == i for c in x.values()) for i in range(1, katz.K + 2)] for x in (one, two)]
    model = katz.Model(n, v, *ones)
    p1 = lambda w: float(model.word(np.array([one[w]]))[0])
    after: dict = {}
    for (h, w), c in two.items():
        after.setdefault(h, {})[w] = c
    memo: dict = {}

    def state(h):
        if h not in memo:
            mass = np.zeros((13, 1), np.int64)
            for w, c in after.get(h, {}).items():
                for base, x in ((0, c), (6, one[w])):
                    if x <= katz.K:
                        mass[base + x - 1] += 1
                    else:
                        mass[base + katz.K] += x
                        mass[12] += base == 6
            total, weight = model.backoff(mass)
            memo[h] = total, float(weight[0])
        return memo[h]

    def p2(h, w):
        total, weight = state(h)
        c = after.get(h, {}).get(w, 0)
        return float(model.pair(np.array([c]), total)[0]) if c else weight * p1(w)

    for h in [None, *list(after)[:12], "never seen"]:
        assert sum(p2(h, w) for w in one) + p2(h, ("unknown",)) == pytest.approx(1, abs=1e-9)
    got = sorted((r for r in katz.score(df, held).collect()), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    order = sorted(range(len(rows)), key=lambda i: (str(rows[i][0]), len(docs[i])))
    for r, i in zip(got, order, strict=True):
        t = docs[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(rows[i][0]), len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip([None, *t[:-1]], t)), rel=1e-9)
    assert katz.score(empty(spark), held).count() == 0


def test_katz_tables_leave_no_shuffle_behind(spark):
    dirs = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    held = lambda: {f for d in dirs for f in Path(d.toString()).glob("*/shuffle_*.data")}
    df = spark.createDataFrame(frame(spark, [t for t in texts(2, 40) if t is None or len(t) < 20000])[1], SCHEMA)
    before = held()
    kept = katz.train(df, lambda d: katz.fold(d) == 2)  # held, so that the driver's garbage says nothing
    size = lambda: sum(f.stat().st_size for f in held() - before if f.exists())
    end = time.time() + 5
    while size() > 5_000 and time.time() < end:
        time.sleep(0.1)
    assert size() <= 5_000  # what the counts of counts took
    assert kept[1].count() > 0


def test_cut_characters_go_whole_and_others_stay(spark):
    passage = "é" * 150 + "the passage that two texts share " * 5
    df = spark.createDataFrame([(1, "keep \ufffd this " + passage), (2, "ab " + passage + "\ufffd and more")], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert found == {1: "keep \ufffd this", 2: "ab\ufffd and more"}
    df = spark.createDataFrame([(1, "x" + "ä" * 120 + "1"), (2, "y" + "ä" * 120 + "2")], "doc_id long, text string")
    assert {r["text"] for r in suffix_dedup.without_repeats(df).collect()} == {"x1", "y2"}


def test_suffix_dedup_runs_do_not_depend_on_the_order_of_texts():
    r = random.Random(5)
    values = ["".join(r.choices("abc ", k=r.randint(150, 2500))) for _ in range(500)]  # several slices
    found = []
    for order in (values, values[::-1], sorted(values)):
        block = suffix_dedup.Block(order, 200)
        assert len(block.raw) > 2 * suffix_dedup.SLICE
        keys = [x.tolist() for x in block.keys()]
        block.choose(np.arange(len(block.hash)), np.zeros(len(block.hash), bool))
        different, count, _ = block.strings()
        found.append((different, count.tolist(), keys))
    assert found[0] == found[1] == found[2]


def test_suffix_dedup_parts_are_even():
    r = random.Random(6)
    block = suffix_dedup.Block(["".join(r.choices("abcdefgh ", k=200_000))], 200)
    sizes = np.diff(suffix_dedup.part_bounds(block.keys()[0], 50))
    assert sizes.max() < 2 * sizes.mean()


@pytest.mark.parametrize("length", [200, 60])
def test_suffix_dedup_cuts_hot_anchors(spark, length):
    r = random.Random(7)
    prose = lambda n: "".join(r.choices("etaoin shrdlu", k=n))
    line, passage = prose(90), prose(260)
    values = texts(8, 12) + [prose(200) + line + prose(200) for _ in range(40)] + [prose(100) + passage + prose(100) for _ in range(20)]
    df, rows = frame(spark, values)
    got = sorted((tuple(x) for x in suffix_dedup.digests(suffix_dedup.dedup(df, length, hot=10)).collect()), key=str)
    assert got == sorted(((x[0], *y) for x, y in zip(rows, removed([x[1] for x in rows], length))), key=str)


def test_suffix_dedup_hot_surroundings_go_to_many_collections():
    r = random.Random(8)
    line = "the line of 40 bytes that is everywhere."
    block = suffix_dedup.Block([f"{r.random()} " * 15 + line + f" {r.random()}" * 15 for _ in range(200)], 200)
    every = np.arange(len(block.hash))
    hashes, count = np.unique(block.hash, return_counts=True)
    assert count.max() > 40
    block.choose(every, np.isin(block.hash, hashes[count > 40]))
    assert np.unique(block.hash, return_counts=True)[1].max() < 20
