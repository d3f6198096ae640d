import re

import corpus_pipeline
from helpers import LOWER, WORD, empty, frame, texts
from paceline.llm import quality_rules
from paceline.llm.tokens import encoder


def test_stages(spark):
    docs, rows = frame(spark, texts(6, 25))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes and got
            docs = spark.createDataFrame(got, out.schema)
    assert sum(r["length"] for r in got) >= len({r["doc_id"] for r in got})


def test_near_copies_leave_one(spark):
    docs, _ = frame(spark, texts(6, 25))
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, ""), "")
    ids = [r["doc_id"] for r in kept.collect()]
    near = {3 * i for i in range(25, 31)}
    assert len(near & set(ids)) == 1 and len(ids) == len(set(ids))


def run_on(spark, tmp_path, docs):
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def kept_lines(text):
    """The quality rules, line by line, as plain code; None if the text is rejected."""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(again) > 50 * len(words):
        return None
    lines, lost = [], 0
    for line in text.split("\n"):
        bare = "".join(WORD.findall(line))
        fails = bool(bare) and (
            line.rstrip(" \t\n\x0b\x0c\r")[-1] not in quality_rules.SENTENCE_END
            or 10 * sum(c in "#*$%&|<>!" for c in line) > len(bare)
            or sum(c in "|»›•→" for c in line) >= 2
            or re.search(quality_rules.BOILERPLATE, line) is not None
        )
        lost += len(line) if fails else 0
        lines += [] if fails else [line]
    total = sum(len(x) for x in text.split("\n") if WORD.search(x))
    return None if lost > quality_rules.MAX_LOSS * total else "\n".join(lines)


def whole_pipeline(rows):
    """doc_id and text of what the first three stages leave, by brute force."""
    docs = [(r[0], kept_lines(r[1] or "")) for r in rows]
    docs = sorted({(d, t) for d, t in docs if t is not None}, key=lambda x: (x[0] is None, x[0], x[1]))
    sets = []
    for _, t in docs:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    left = [(docs[i][0], docs[i][1].encode()) for i in first.values()]
    starts = {}
    for d, (_, raw) in enumerate(left):
        for i in range(len(raw) - 199):
            starts.setdefault(raw[i : i + 200], []).append((d, i))
    gone = {(d, i + k) for at in starts.values() if len(at) > 1 for d, i in at for k in range(200)}
    out = []
    for d, (doc_id, raw) in enumerate(left):
        text, at = "", 0
        for c in raw.decode():
            size = len(c.encode())
            if not any((d, at + k) in gone for k in range(size)):
                text += c
            at += size
        out += [(doc_id, text)] if text else []
    return out


def test_run_equals_brute_force(spark, tmp_path):
    values = [t for t in texts(6, 25) if t is None or len(t) < 20_000]
    values += ["Home | News | Sport\n" + "\n".join(f"Line {i} of this text is a sentence with {i * 7} words or so." for i in range(12)) + "\nsubscribe to us."]
    docs, rows = frame(spark, values)
    got = run_on(spark, tmp_path, docs).collect()
    library = encoder("byte", corpus_pipeline.tokenizer_file("byte_bpe_50k.json"))
    want = sorted(((d, len(library.whole(t)) + 1) for d, t in whole_pipeline(rows)), key=str)
    assert sorted({(r["doc_id"], r["doc_tokens"]) for r in got}, key=str) == want and len(want) > 20
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    sizes = dict(want)
    for doc_id, parts in whole.items():
        ends = [0]
        for start, length in sorted(parts):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == sizes[doc_id]
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    least = -(-sum(sizes.values()) // 1024)
    assert len(used) <= 1.1 * least + 1  # padding


def test_run_on_an_empty_table(spark, tmp_path):
    out = run_on(spark, tmp_path, empty(spark))
    assert out.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
