"""Katz back-off language model over word bigrams.

    P(w | h) = d(c) * c(h w) / c(h)         if h w was seen c > 0 times
             = a(h) * P(w)                  otherwise
    P(w)     = d1(c) * c(w) / N             if w was seen
             = what the discounts left      for all other words together

d and d1 are Good-Turing discounts of counts up to ``K`` (larger counts are kept), and a(h) makes every history's
probabilities add up to 1 exactly: (1 - mass of the words seen after h) / (1 - P of those words). The word before
a text's first is the end of a text.

Counts stand in tables of key ranges. Blocks of documents send each range their distinct words, and learn each
word's count; then they send their distinct bigrams by history, and learn each bigram's count and, for each
history, in how many words' counts its mass is made up of, from which any discounts' a(h) follows. Merged counts
are written as a table partitioned by level, which ``score`` reads. A history of more than a tenth of a range's
share is split over ranges by its second words; blocks ask for all its shares.

Words are 64-bit hashes; second words are told apart by 40 bits within a history.

Where counts of counts leave no valid Good-Turing discount for some count (small or odd corpora), K is lowered;
where none is valid, d(c) = (c - D) / c with D = n1 / (n1 + 2 n2), or 1/2 without n1.

Nulls, empties and ties: a null text is empty; an empty text is one end token. The text of a null doc_id is
empty for the fold. Repeated rows count once for each. Without training documents every probability is that of an
unknown word, 1. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import block_rows, expand, in_blocks, partitions, scratch_path, settings, squeeze
from paceline.llm.grams import in_groups, mix, word_hashes

K = 5
END = np.uint64(0x9D39247E33776D41)
SECOND_BITS = np.uint64(40)
#: Removes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATS = "n_tokens long, n_types long, ones array<long>"


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % 7


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by END, and where each text begins (one more at the end)."""
    parts, sizes = [], []
    for a, b in in_groups(texts):
        words, start = word_hashes(texts[a:b])
        n = np.diff(start)
        out = np.full(len(words) + len(n), END)
        at = np.ones(len(out), bool)
        at[np.cumsum(n + 1) - 1] = False
        out[at] = words
        parts.append(out)
        sizes.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def planes(values: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return squeeze(np.ascontiguousarray(raw.T).tobytes())


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(width, -1).T
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<u8")[:, 0]


def pack_seconds(seconds: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Second words as their sorted dictionary and indexes into it, and the first row of each."""
    found, at, index = np.unique(seconds, return_index=True, return_inverse=True)
    return planes(np.diff(found, prepend=np.uint64(0)), 5), planes(index, 4), at


def unpack_seconds(found: bytes, index: bytes) -> tuple[np.ndarray, np.ndarray]:
    index = unplanes(index, 4).astype(np.int64)
    return np.cumsum(unplanes(found, 5), dtype=np.uint64)[index], index


def pack_mass(mass: np.ndarray, ask: np.ndarray) -> bytes:
    """The numbers of the histories asked for, and for all which counts up to K their seconds have."""
    numbers = planes(mass[:, ask].ravel(), 8)
    return len(numbers).to_bytes(4, "little") + numbers + np.packbits(mass[:K] > 0).tobytes()


def unpack_mass(data: bytes, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = 4 + int.from_bytes(data[:4], "little")
    mass = np.zeros((13, len(ask)), np.int64)
    mass[:, ask] = unplanes(data[4:end], 8).astype(np.int64).reshape(13, -1)
    return mass, np.unpackbits(np.frombuffer(data, np.uint8, offset=end), count=K * len(ask)).reshape(K, len(ask))


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of sorted 64-bit keys begins."""
    edges = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Counts:
    """A block's tokens with what it asks of the tables, always in the same order."""

    def __init__(self, doc_ids: list, texts: list[str], held_out: Callable[[int | None], bool]):
        self.tokens, self.start = tokens_of(texts)
        self.held = np.array([held_out(None if pd.isna(d) else int(d)) for d in doc_ids], bool)
        trained = np.repeat(~self.held, np.diff(self.start))
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        self.word_count = np.bincount(self.word, weights=trained, minlength=len(self.words)).astype(np.int64)
        self.trained = trained

    def bigrams(self, counts: np.ndarray, share: float) -> None:
        """Histories and second words, given every word's count and the tokens that one range's tenth holds."""
        first = np.empty(len(self.tokens), np.int64)
        first[1:] = self.word[:-1]
        end = np.searchsorted(self.words, END)
        first[self.start[:-1]] = end
        cuts = np.maximum(1, np.ceil(counts / share)).astype(np.int64)
        second = self.words[self.word] >> np.uint64(64 - int(SECOND_BITS))
        cut = (second % cuts[first].astype(np.uint64)).astype(np.uint64)
        key = mix(self.words[first] + mix(cut + np.uint64(1)))
        # every share of every history, so that its whole mass is known
        row = np.repeat(np.arange(len(self.words)), cuts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        asked = mix(self.words[row] + mix(nth.astype(np.uint64) + np.uint64(1)))
        needed = np.zeros(len(self.words), bool)
        needed[first] = True
        keep = needed[row]
        self.asked_of, asked = row[keep], asked[keep]
        self.history, self.asked_at = np.unique(asked, return_inverse=True)
        of = np.searchsorted(self.history, key)
        pair = of.astype(np.uint64) << SECOND_BITS | second
        self.pairs, at, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_count = np.bincount(self.pair, weights=self.trained, minlength=len(self.pairs)).astype(np.int64)
        self.second_count = counts[self.word[at]]
        # only what stands before a pair that this block's training texts don't have can need to back off
        open_word = np.zeros(len(self.words), bool)
        open_word[first[self.pair_count[self.pair] == 0]] = True
        self.ask = np.zeros(len(self.history), bool)
        self.ask[self.asked_at[open_word[self.asked_of]]] = True
        self.per_history = np.bincount((self.pairs >> SECOND_BITS).astype(np.int64), minlength=len(self.history))
        self.first = first


def word_answers(dealt: DataFrame, parts: int, held_out: Callable) -> DataFrame:
    """level 1: (block, part, data: counts of the block's words in the part, stats of the part on one row)."""

    def send(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = block_rows(f)
        c = Counts(list(f["doc_id"]), list(f["text"]), held_out)
        at = ranges(c.words, parts)
        rows = [
            (key[0], p, planes(np.diff(c.words[a:b], prepend=np.uint64(0)), 8), planes(c.word_count[a:b], 8))
            for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a
        ]
        return pd.DataFrame(rows, columns=["block", "part", "keys", "counts"])

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(unplanes(x, 8), dtype=np.uint64) for x in f["keys"]]
        counts = np.concatenate([unplanes(x, 8) for x in f["counts"]])
        every, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        data = [planes(x, 8) for x in np.split(total[place], ends)]
        out = pd.DataFrame({"level": 1, "block": f["block"], "part": np.int32(key[0]), "data": data, "mass": None})
        model = planes(np.diff(every, prepend=np.uint64(0)), 8)
        return _with_stats(out, total, np.int32(key[0]), model, planes(total, 8))

    sent = dealt.groupBy("block").applyInPandas(send, "block int, part int, keys binary, counts binary")
    return sent.groupBy("part").applyInPandas(answer, ANSWER)


ANSWER = f"level int, block int, part int, data binary, mass binary, {STATS}"


def _with_stats(out: pd.DataFrame, total: np.ndarray, part: int, keys: bytes, counts: bytes) -> pd.DataFrame:
    """The answers and the part's own table (block -1) with its count of counts."""
    ones = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
    level = int(out["level"].iloc[0])
    own = pd.DataFrame(
        {"level": level, "block": -1, "part": part, "data": [keys], "mass": [counts],
         "n_tokens": [int(total.sum())], "n_types": [int((total > 0).sum())], "ones": [ones]}
    )
    out = out.assign(n_tokens=pd.NA, n_types=pd.NA, ones=None)
    return pd.concat([out, own], ignore_index=True).astype({"n_tokens": "Int64", "n_types": "Int64"})


def read_counts(f: pd.DataFrame, c: Counts, parts: int) -> np.ndarray:
    """Every word's count, from a block's answers of level 1."""
    at, out = ranges(c.words, parts), np.zeros(len(c.words), np.int64)
    for p, data in zip(f["part"], f["data"]):
        out[at[p] : at[p + 1]] = unplanes(data, 8)
    return out


def bigram_answers(dealt: DataFrame, words: DataFrame, parts: int, share: float, held_out: Callable) -> DataFrame:
    """level 2: (block, part, data: counts of the block's bigrams, mass: 13 numbers for each of its histories)."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "part", "keys", "sizes", "found", "seconds", "counts", "uni", "ask"]
        if not len(left):
            return pd.DataFrame([], columns=names)
        block, left = left["block"].iloc[0], block_rows(left)
        c = Counts(list(left["doc_id"]), list(left["text"]), held_out)
        c.bigrams(read_counts(right, c, parts), share)
        at = ranges(c.history, parts)
        row = np.concatenate([[0], np.cumsum(c.per_history)])
        rows = []
        for p, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b > a:
                x, y = row[a], row[b]
                second = c.pairs[x:y] & np.uint64((1 << int(SECOND_BITS)) - 1)
                found, index, first = pack_seconds(second)
                rows.append((block, p, planes(np.diff(c.history[a:b], prepend=np.uint64(0)), 8), planes(c.per_history[a:b], 8), found, index, planes(c.pair_count[x:y], 8), planes(c.second_count[x:y][first], 8), np.packbits(c.ask[a:b]).tobytes()))
        return pd.DataFrame(rows, columns=names)

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unplanes(x, 8), dtype=np.uint64) for x in f["keys"]]
        sizes = [unplanes(x, 8).astype(np.int64) for x in f["sizes"]]
        read = [unpack_seconds(x, y) for x, y in zip(f["found"], f["seconds"])]
        second = np.concatenate([x for x, _ in read])
        uni = np.concatenate([unplanes(x, 8)[y] for x, (_, y) in zip(f["uni"], read)])
        count = np.concatenate([unplanes(x, 8) for x in f["counts"]])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        pair = np.repeat(place, np.concatenate(sizes)).astype(np.uint64) << SECOND_BITS | second
        types, at, which = np.unique(pair, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=count, minlength=len(types)).astype(np.int64)
        of = (types >> SECOND_BITS).astype(np.int64)
        mass = np.zeros((13, len(every)), np.int64)
        seen = total > 0
        for base, value in ((0, total), (6, uni[at].astype(np.int64))):
            for r in range(1, K + 1):
                mass[base + r - 1] = np.bincount(of[seen & (value == r)], minlength=len(every))
            big = seen & (value > K)
            mass[base + K] = np.bincount(of[big], weights=value[big], minlength=len(every))
            if base:
                mass[12] = np.bincount(of[big], minlength=len(every))
        ends = np.cumsum([len(x) for x in keys])
        rows = np.cumsum([int(x.sum()) for x in sizes])
        data = [planes(x, 8) for x in np.split(total[which], rows[:-1])]
        asks = [np.unpackbits(np.frombuffer(a, np.uint8), count=len(k)).astype(bool) for a, k in zip(f["ask"], keys)]
        masses = [pack_mass(mass[:, x], a) for x, a in zip(np.split(place, ends[:-1]), asks)]
        out = pd.DataFrame({"level": 2, "block": f["block"], "part": np.int32(key[0]), "data": data, "mass": masses})
        model = np.unique(every[of[seen]], return_counts=True)
        table = b"".join(
            len(x).to_bytes(8, "little") + x
            for x in (planes(np.diff(model[0], prepend=np.uint64(0)), 8), planes(model[1], 8),
                      *pack_seconds(types[seen] & np.uint64((1 << int(SECOND_BITS)) - 1))[:2])
        )
        return _with_stats(out, total, np.int32(key[0]), table, planes(total[seen], 8))

    sent = dealt.groupBy("block").cogroup(words.where("block >= 0").groupBy("block")).applyInPandas(
        send, "block int, part int, keys binary, sizes binary, found binary, seconds binary, counts binary, uni binary, ask binary"
    )
    return sent.groupBy("part").applyInPandas(answer, ANSWER)


def discounts(n: list[int]) -> np.ndarray:
    """d(1) .. d(K) from the numbers of types seen 1 .. K+1 times."""
    for k in range(K, 0, -1):
        if n[0] <= 0 or any(n[r] <= 0 for r in range(1, k + 1)):
            continue
        cut = (k + 1) * n[k] / n[0]
        if cut >= 1:
            continue
        d = np.array([((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, k + 1)])
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([d, np.ones(K - k)])
    one = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return (np.arange(1, K + 1) - one) / np.arange(1, K + 1)


class Model:
    """Discounts and totals; everything else comes from the tables."""

    def __init__(self, n_tokens: int, n_types: int, word_ones: list[int], pair_ones: list[int]):
        self.n, self.v = n_tokens, n_types
        self.d1, self.d2 = discounts(word_ones), discounts(pair_ones)
        left = float(np.dot((1 - self.d1) * np.arange(1, K + 1), word_ones[:K])) if n_tokens else 0.0
        if n_tokens and left <= 0:  # no word was seen so seldom that it is discounted: every word gives a little
            self.d1 = None
        self.unknown = left / n_tokens if n_tokens and left > 0 else 1.0 / (n_tokens + n_types + 1)

    def word(self, count: np.ndarray) -> np.ndarray:
        """P of words seen so often."""
        if not self.n:
            return np.ones(len(count))
        if self.d1 is None:
            return (count + 1) / (self.n + self.v + 1)
        factor = np.where(count <= K, self.d1[np.clip(count, 1, K) - 1], 1.0)
        return np.where(count > 0, factor * count / self.n, self.unknown)

    def backoff(self, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals that counts are divided by, c(h), and a(h) of histories, from their 13 numbers."""
        r = np.arange(1, K + 1)
        total = r @ mass[:K] + mass[K]
        kept = (self.d2 * r) @ mass[:K] + mass[K]
        if not self.n:
            lower = np.zeros(mass.shape[1])
        elif self.d1 is None:
            lower = ((r + 1) @ mass[6 : 6 + K] + mass[6 + K] + mass[12]) / (self.n + self.v + 1)
        else:
            lower = ((self.d1 * r) @ mass[6 : 6 + K] + mass[6 + K]) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            left = 1 - kept / np.maximum(total, 1)
            # a history without a discounted successor would leave nothing: it is scaled as if seen once more
            bare = left <= 1e-12
            scale = np.where(bare, total / (total + 1.0), 1.0)
            left = np.where(bare, 1 / (total + 1.0), left)
            weight = np.where(total > 0, left / (1 - lower), 1.0)
        return np.where(total > 0, total / np.where(scale > 0, scale, 1.0), 1.0), weight

    def divisor(self, total: np.ndarray, present: np.ndarray) -> np.ndarray:
        """What backoff() gives as totals, from c(h) and which counts up to K the words after h have."""
        bare = ~(present.astype(bool) & (self.d2 < 1)[:, None]).any(axis=0)
        return np.where(total > 0, total + bare, 1)

    def pair(self, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        """P of seen bigrams, by their count and their history's total as backoff() gives it."""
        factor = np.where(count <= K, self.d2[np.clip(count, 1, K) - 1], 1.0)
        return factor * count / total


def train(docs: DataFrame, held_out: Callable[[int | None], bool]) -> tuple[DataFrame, DataFrame, Model, int, float]:
    """The dealt documents, the stored tables (level, part), the model, the parts and the share."""
    spark = docs.sparkSession
    parts = partitions(spark)
    dealt = in_blocks(docs)
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    share = max(1000.0, size / 6 / parts / 10)
    words = word_answers(dealt, parts, held_out)
    tables = words.unionByName(bigram_answers(dealt, words, parts, share, held_out))
    path = scratch_path(spark, "katz")
    # the blocks are dealt again to be scored: what was shuffled for the tables goes first
    with settings(spark, {SHUFFLES_GO: "true"}):
        tables.write.partitionBy("level").option("compression", "none").parquet(path)
    stored = spark.read.schema(ANSWER).parquet(path)
    stats = stored.where("block < 0").groupBy("level").agg(
        F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v"),
        *[F.sum(F.col("ones")[i]).alias(f"n{i}") for i in range(K + 1)],
    ).collect()
    by = {r["level"]: r for r in stats}
    ones = {level: [int(by[level][f"n{i}"]) for i in range(K + 1)] if level in by else [0] * (K + 1) for level in (1, 2)}
    n, v = (int(by[1]["n"]), int(by[1]["v"])) if 1 in by else (0, 0)
    return dealt, stored, Model(n, v, ones[1], ones[2]), parts, share


def score(docs: DataFrame, held_out: Callable[[int | None], bool]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    dealt, stored, model, parts, share = train(docs, held_out)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = block_rows(left)
        c = Counts(list(left["doc_id"]), list(left["text"]), held_out)
        counts = read_counts(right[right["level"] == 1], c, parts)
        c.bigrams(counts, share)
        at, row = ranges(c.history, parts), np.concatenate([[0], np.cumsum(c.per_history)])
        pair_count = np.zeros(len(c.pairs), np.int64)
        mass, present = np.zeros((13, len(c.history)), np.int64), np.zeros((K, len(c.history)), np.uint8)
        two = right[right["level"] == 2]
        for p, data, m in zip(two["part"], two["data"], two["mass"]):
            a, b = at[p], at[p + 1]
            pair_count[row[a] : row[b]] = unplanes(data, 8)
            mass[:, a:b], present[:, a:b] = unpack_mass(m, c.ask[a:b])
        add_up = lambda x: np.bincount(c.asked_of, weights=x[c.asked_at], minlength=len(c.words))
        whole = np.stack([add_up(x) for x in mass]).astype(np.int64)
        _, weight = model.backoff(whole)
        # every token is followed by one, an end by the next text's first, so a word's count is its count as a history
        total = model.divisor(counts, np.stack([add_up(x) for x in present]) > 0)
        found, lower = pair_count[c.pair], model.word(counts)[c.word]
        p = np.where(found > 0, model.pair(found, total[c.first]), weight[c.first] * lower)
        base = np.log10((counts + 1) / (model.n + model.v + 1))[c.word]
        begin = c.start[:-1]
        add = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has a token, its end
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(d) else int(d) for d in left["doc_id"]], dtype="Int64"),
                "held_out": c.held, "n_tokens": np.diff(c.start), "n_known": add((counts > 0)[c.word].astype(np.int64)),
                "train_tokens": model.n, "base_score": add(base), "score": add(np.log10(p)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = stored.where("block >= 0").select("level", "block", "part", "data", "mass")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
