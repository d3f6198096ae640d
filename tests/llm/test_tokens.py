import io
import os
import random
import uuid
import zlib

import numpy as np
import pytest
from helpers import empty, frame, texts
from paceline.llm import packing, sstable, tokens, word_table
from paceline.llm.common import tokenizer_file
from tokenizers import Tokenizer

BYTE, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind, path", [("byte", BYTE), ("word", WORDS)])
def test_cached_encoder_equals_library(kind, path):
    library = Tokenizer.from_file(path)
    r = random.Random(5)
    alphabet = "abcdefgABC 0123 \n\t.,!?'-_#%éÉßñΣς中ﬁ²½ªº \u00a0\u00ad\u0301\u2028\0"
    odd = ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(1500)]
    every = [t or "" for t in texts()] + odd
    got = tokens.encoder(kind, path).encode(every)
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [list(map(int, g)) for g in got] == want


def test_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    e = tokens.WordEncoder(WORDS)
    library = Tokenizer.from_file(WORDS)
    for seed in range(6):
        t = [x or "" for x in texts(seed, 10)]
        assert [list(map(int, g)) for g in e.encode(t)] == [x.ids for x in library.encode_batch(t, add_special_tokens=False)]


def test_full_cache_keeps_what_is_used_most(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    e = tokens.ByteEncoder(BYTE)
    often = [f"often{i}" for i in range(40)]
    e.encode([" " + " ".join(often * 1000)])
    for i in range(8):
        e.encode([" " + " ".join(f"once{i}x{k}" for k in range(60))])
        assert len(e._index) <= 2 * 50 + 60
    assert set(often) <= set(e._index)


def test_encoder_holds_the_pieces_of_few_texts_at_once(monkeypatch):
    e, most = tokens.ByteEncoder(BYTE), 0
    encode_group = e._encode_group

    def spy(group):
        nonlocal most
        most = max(most, sum(len(t) for t, _ in group))
        return encode_group(group)

    monkeypatch.setattr(e, "_encode_group", spy)
    found = e.encode([" word" * 20_000] * 40)
    assert len(found) == 40 and most <= 1_200_000


def test_packing_is_handed_few_texts_at_once(spark, monkeypatch):
    own, folder = packing.encoder, spark._jvm.java.lang.System.getProperty("java.io.tmpdir")
    log = os.path.join(folder, f"packing-{uuid.uuid4().hex}")

    def spied(kind, path):
        e = own(kind, path)

        class Spy:
            def encode(self, batch):
                with open(log, "a") as f:
                    f.write(f"{len(batch)} {sum(map(len, batch))}\n")
                return e.encode(batch)

        return Spy()

    monkeypatch.setattr(packing, "encoder", spied)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    df = spark.range(0, 900, 1, 1).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 6000) text")
    found = packing.pack(df, BYTE, 0, 1024)
    assert found.where("start = 0").count() == 900
    held = [tuple(map(int, x.split())) for x in open(log)]
    assert sum(n for n, _ in held) == 900 and max(size for _, size in held) < 6_000_000
    assert spark.conf.get(setting) == before


def test_word_table_round_trip(spark):
    import hashlib

    library = Tokenizer.from_file(WORDS)
    df, rows = frame(spark, texts())
    got = sorted(map(tuple, word_table.encode_and_decode(df, WORDS).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        a, b = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert word_table.encode_and_decode(empty(spark), WORDS).count() == 0


def test_shards_hold_and_find_everything():
    entries = [(None, np.arange(3, dtype=np.uint32))] + [(i * 7 - 500, np.arange(i % 900, dtype=np.uint32)) for i in range(2000)]
    entries.insert(5, (entries[4][0], np.array([9], np.uint32)))
    file = io.BytesIO()
    w = sstable.Writer(file, 2)
    for k, ids in entries:
        w.add(k, ids)
    size = w.close()
    assert size == len(file.getvalue())
    r = sstable.Reader(file)
    assert [(k, list(v)) for k, v in r.scan()] == [(k, list(v)) for k, v in entries]
    assert len(r.index) > 3
    for k in (None, -500, entries[4][0], 7 * 1999 - 500):
        assert [list(v) for v in r.get(k)] == [list(v) for q, v in entries if q == k]
    assert r.get(-499) == [] and r.get(10**12) == []
    broken = bytearray(file.getvalue())
    broken[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(broken))).scan())


def test_sstable_round_trip(spark):
    library = Tokenizer.from_file(WORDS)
    df, rows = frame(spark, texts())
    got = sorted(sstable.round_trip(df, WORDS, 1).collect(), key=lambda r: r["start"])
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    start = 0
    for g, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert sstable.round_trip(empty(spark), WORDS, 1).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing_places_all(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(40)}
    patterns = packing.pack_histogram(histogram, 64)
    held: dict[int, int] = {}
    for count, items in patterns:
        assert sum(items) <= 64
        for size in items:
            held[size] = held.get(size, 0) + count
    assert held == histogram and len(patterns) <= 2 * 64


def test_packing(spark):
    library = Tokenizer.from_file(BYTE)
    df, rows = frame(spark, texts())
    got = packing.pack(df, BYTE, 0, 128).collect()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    for g in got:
        own = ids[g["doc_id"]]
        assert g["doc_tokens"] == len(own) and g["ids_crc32"] == crc(own[g["start"] : g["start"] + g["length"]])
    assert sum(g["length"] for g in got) == sum(len(ids[r[0]]) for r in rows)
    by: dict[int, list] = {}
    for g in got:
        by.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty(spark), BYTE).count() == 0
