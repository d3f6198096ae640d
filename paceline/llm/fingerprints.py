"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs: its non-blank lines, stripped, long ones cut into sentences. Each paragraph is hashed to a wide vector of
32-bit lanes, and a text's fingerprint is the sum of its paragraphs' vectors modulo 2**32: it does not depend on
their order, and paragraphs are added or taken away by adding or subtracting their vectors.

The lanes are: ``DENSE`` lanes that hold hash bits, which decide equality; 4 lanes that count paragraphs; and
``WIDE`` lanes that hold ``SCALE`` times a Cauchy variate of the paragraph, rounded. The difference of two texts in
such a lane is again Cauchy, with the sum of the differences in number of each paragraph as its scale, so repeats
weigh what they are. ``likeness`` estimates 2 * shared / all paragraphs from the two fingerprints alone; the standard
error is (2 / WIDE)**.5 of 1 - likeness (0.044 where nothing is shared) at any length, as the estimate allows for
lanes that pass 2**32.

Nulls, empties and ties: a null text is empty; a text without paragraphs has the all-zero fingerprint; the
likeness of two such is 1. Equal texts have equal fingerprints, and so have texts of the same paragraphs. A null
doc_id sorts before all others; rows of one doc_id follow each other by text. Repeated rows are printed row by row, an
empty table gives no rows, and columns other than doc_id and text are ignored. Texts of any length are read whole,
their paragraphs a few hundred at a time.

Equality rests on the 256 bits of the dense lanes (the wide lanes follow from 64 more). Two different texts agree in
them by chance about once in 2**256 pairs, but sums modulo 2**32 of so few lanes can be made to agree on purpose by
a generalised birthday search, so fingerprints prove nothing against someone who writes texts in order to clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import partitions
from paceline.llm.grams import mix

DENSE, COUNT, WIDE, SCALE = 8, 4, 1024, 8
#: Lines of more characters than this are cut into sentences.
LONG = 200
LANES = DENSE + COUNT + WIDE
#: Paragraphs whose vectors are held at a time.
AT_ONCE = 256


def paragraphs(text: str) -> list[bytes]:
    """The stripped non-blank lines of a text; one of over LONG characters counts as its sentences."""
    out = []
    for line in text.split("\n"):
        for x in line.replace(". ", ".\n").split("\n") if len(line) > LONG else (line,):
            if p := x.strip():
                out.append(p.encode("utf-8", "surrogatepass"))
    return out


def vectors(parts: list[bytes]) -> np.ndarray:
    """A row of lanes for each paragraph."""
    digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=40).digest() for p in parts), np.uint8)
    digests = digests.reshape(len(parts), 40)
    out = np.zeros((len(parts), LANES), np.uint32)
    out[:, :DENSE] = digests[:, : 4 * DENSE].copy().view("<u4")
    out[:, DENSE] = 1
    seeds = digests[:, 4 * DENSE :].copy().view("<u8")
    with np.errstate(over="ignore"):
        bits = mix(seeds + np.arange(1, WIDE // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    angles = (bits.view(np.int32) + 0.5) * (np.pi / 2**32)
    out[:, DENSE + COUNT :] = np.rint(SCALE * np.tan(angles)).astype(np.int64).astype(np.uint32)
    return out


def fingerprint(parts: list[bytes]) -> np.ndarray:
    """Lanes of the multiset of paragraphs; the count lanes hold the number of paragraphs in base 2**16."""
    return _sums([parts])[0]


def _sums(texts: list[list[bytes]]) -> np.ndarray:
    """A row of lanes for each text's paragraphs; paragraphs that stand near each other again are hashed once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    summed = np.zeros((len(texts), LANES), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = [p for ps in texts for p in ps]
    start = 0
    while start < len(flat):
        place: dict[bytes, int] = {}
        end = start
        while end < len(flat) and end - start < 8 * AT_ONCE and len(place) < AT_ONCE:
            place.setdefault(flat[end], len(place))
            end += 1
        lanes = vectors(list(place))
        own = owner[start:end]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        rows = [place[p] for p in flat[start:end]]
        for a, b in zip(first, [*first[1:], len(rows)]):
            summed[own[a]] += lanes[rows[a:b]].sum(axis=0, dtype=np.uint32)
        start = end
    for i, n in enumerate(sizes):
        summed[i] = with_count(summed[i], int(n))
    return summed


def with_count(lanes: np.ndarray, n: int) -> np.ndarray:
    lanes = lanes.copy()
    lanes[DENSE : DENSE + COUNT] = [n >> 16 * i & 0xFFFF for i in range(COUNT)]
    return lanes


def count_of(lanes: np.ndarray) -> int:
    return sum(int(x) << 16 * i for i, x in enumerate(lanes[DENSE : DENSE + COUNT]))


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprint of a's paragraphs with b's added (sign 1) or taken away (sign -1)."""
    with np.errstate(over="ignore"):
        lanes = a + b if sign > 0 else a - b
    return with_count(lanes, count_of(a) + sign * count_of(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of 2 * shared / all paragraphs; 1 exactly if the fingerprints are equal."""
    if np.array_equal(a, b):
        return 1.0
    total = count_of(a) + count_of(b)
    least = max(1, abs(count_of(a) - count_of(b)))
    with np.errstate(over="ignore"):
        differ = (a - b)[DENSE + COUNT :].view(np.int32)
    return float(min(1.0, max(0.0, 1 - max(least, distance(differ)) / total)))


def distance(differ: np.ndarray) -> float:
    """The most likely scale of the Cauchy variates of which differ holds SCALE times the values modulo 2**32.

    The tangent of half a wrapped Cauchy angle is Cauchy too, of a scale that gives the first one's."""
    squares = np.tan(differ * (np.pi / 2**32)) ** 2
    scale = float(np.median(squares))
    if scale == 0:
        return 0.0
    for _ in range(8):
        part = squares / (squares + scale)
        step = (part.mean() - 0.5) / (part * (1 - part)).mean()
        scale *= float(np.exp(min(1.0, max(-1.0, step))))
        if abs(step) < 1e-4:
            break
    root = scale**0.5
    return -np.log((1 - root) / (1 + root)) * 2**32 / (2 * np.pi * SCALE) if root < 1 else float("inf")


def text_of(lanes: np.ndarray) -> str:
    return lanes.astype("<u4").tobytes().hex()


def fingerprint_texts(texts: Iterable[str]) -> list[np.ndarray]:
    """Fingerprints of many texts with one pass over the paragraphs of all of them."""
    return list(_sums([paragraphs(t) for t in texts]))


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by the first as many code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in the same partition, the document after it: rows of a partition are consecutive in
    ascending (doc_id, text), closed by the first row of the next range (``ghost``).

    Ranges are cut at quantiles of doc_id. What is held on the driver is one row of two numbers for each range,
    of which there are 4 for each shuffle partition.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    ranged = rows.withColumn("range", range_of("key"))
    found = sorted((r["first"], r["range"]) for r in ranged.groupBy("range").agg(F.min("key").alias("first")).collect())
    firsts = np.array([k for k, _ in found], np.int64)
    # the first row of a range closes the range before it; that of the first range closes the last one
    closes = np.array([found[i - 1][1] for i in range(len(found))], np.int32)

    @F.pandas_udf("int")
    def closed_by(k: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(firsts, k.to_numpy()), max(0, len(firsts) - 1))
        hit = firsts[at] == k.to_numpy() if len(firsts) else np.zeros(len(k), bool)
        return pd.Series(pd.array(np.where(hit, closes[at] if len(firsts) else -1, -1), dtype="int32"))

    leading = rows.withColumn("range", closed_by("key")).where("range >= 0")
    one = F.row_number().over(Window.partitionBy("key").orderBy("text"))
    ghosts = leading.withColumn("n", one).where("n = 1").drop("n").withColumn("ghost", F.lit(1))
    every = ranged.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return every.repartition(n, "range").sortWithinPartitions("range", "ghost", "key", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            held += list(f[["range", "ghost", "doc_id", "text"]].itertuples(index=False, name=None))
            while len(held) > 1:
                group, size = 0, 0
                while group < len(held) - 1 and size < 4_000_000:
                    size += len(held[group][3])
                    group += 1
                yield from _compare(held[: group + 1])
                held = held[group:]

    return in_order(docs).mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _compare(held: list[tuple]) -> Iterator[pd.DataFrame]:
    """Rows for all but the last of the held documents, each compared with the one after it."""
    at = [i for i in range(len(held) - 1) if not held[i][1]]
    texts = [edited(held[i][3], held[i + 1][3]) for i in at]
    # a text next to its edited text, which has most of its paragraphs
    places = sorted([*((i, 0) for i in range(len(held))), *((i, 1) for i in at)])
    new_text = dict(zip(at, texts))
    found = dict(zip(places, fingerprint_texts(new_text[i] if new_one else held[i][3] for i, new_one in places)))
    prints, new = [found[i, 0] for i in range(len(held))], [found[i, 1] for i in at]
    rows = [
        (
            held[i][2], len(held[i][3]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(),
            text_of(prints[i]), text_of(x), likeness(prints[i], x), likeness(prints[i], prints[i + 1]),
        )
        for i, t, x in zip(at, texts, new)
    ]
    if rows:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], dtype="Int64")
        yield out
