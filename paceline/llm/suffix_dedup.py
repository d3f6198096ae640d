"""Removal of repeated passages, by column-wise construction over many documents at once.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the table. Strings
are judged on the input.

The collection is cut where strings can be alike. Every start's window of ``length`` bytes names one anchor: its
``GRAM``-byte gram of least hash (the last one on a tie). Equal windows have equal anchors at equal offsets, so
only anchors found twice can belong to repeats, and the surroundings of one anchor, aligned at it, are a
collection of strings of fewer than 2 * length bytes in which a repeat stands in the same columns.

For each collection the Burrows-Wheeler order is built column by column, from the right: each round reads the
next column, one symbol of each string, sorts the strings' suffixes by that symbol and their order so far, and
updates the common prefixes of neighbours: one more than the least common prefix between their places in the
round before, if the symbols agree, else none. Suffixes that start in one column are neighbours only to each
other, so a round's order is all that the next one needs, and the columns stand one after another in an array
that is read once. A start is repeated if its suffix shares ``length`` bytes with a neighbour, or if its whole
string came twice.

Blocks of documents send the hashes of their anchors, are told which came twice, send the surroundings of those
(each different one once), and are told which starts are repeated. What meets in one task is what differs around
one anchor: copies, however many, are one string for each block. An anchor found very often is hot: its starts are
cut into stretches, and surroundings meet only with those that agree in all bytes common to a stretch's windows.

Nulls, empties and ties: null and empty texts have no bytes and lose none, nor do texts shorter than length.
Repeated rows and copies of length bytes or more are repeats of each other and lose everything. An empty table
gives no rows. ``dedup`` carries all other columns.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import block_table, expand, in_blocks, squeeze
from paceline.llm.grams import _VALUE, mix

LENGTH = 200
GRAM = 32
KEY_BYTES = 7
#: Bytes of text for each part of the key space: blocks times parts is the number of messages.
PART_BYTES = 8_000_000
#: Runs (in one block at most 255) from which an anchor is hot, and into how many stretches its starts are then cut.
HOT = 16_000
STRETCHES = 8
#: Bytes whose anchors are found at once.
SLICE = 1 << 18
_BASE = np.uint64(0x5851F42D4C957F2D)
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        inverse = pow(int(_BASE), -1, 2**64)
        _tables.append(np.cumprod(np.full(2 * SLICE, _BASE)))
        _tables.append(np.cumprod(np.full(2 * SLICE, np.uint64(inverse))))
    return _tables


def gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    power, inverse = _powers()
    n = len(raw)
    if n > len(power):
        raise ValueError("slice too long")
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * power[:n])])
    return mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])


def anchors_in(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: for each start of a window, the place of its anchor, and all gram hashes."""
    h = gram_hash(raw)
    width = length - GRAM + 1
    low = np.uint64((1 << 22) - 1)
    value = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[: len(h)] = value
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (low - (least & low)).astype(np.int64), h


class Block:
    """The anchors of a block's texts: for run i, the hash, the first start, the number of starts and the anchor's
    place, all counted in the joined bytes of the texts."""

    def __init__(self, texts: list[str], length: int):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.length = length
        self.sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(data), np.uint8)
        found = [self._slice(a, b) for a, b in self._slices()]
        if found:
            self.hash, self.first, self.count, self.place = self._joined(*(np.concatenate(x) for x in zip(*found)))
        else:
            self.hash, (self.first, self.count, self.place) = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 3

    def _slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of bytes that overlap by a window, so that each start is in exactly one."""
        at = 0
        while at + self.length <= len(self.raw):
            yield at, min(len(self.raw), at + SLICE + self.length - 1)
            at += SLICE

    def _joined(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray):
        """Runs cut by a slice's end made whole again. Where slices end depends on the order of the block's texts, which
        differs from one reading of a shuffle to the next; whole runs are the same in any order."""
        goes_on = (place[1:] == place[:-1]) & (first[1:] == first[:-1] + count[:-1])
        goes_on &= np.searchsorted(self.begin, first[1:], side="right") == np.searchsorted(self.begin, first[:-1], side="right")
        new = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(first) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, new) if len(new) else count
        return hashes[new], first[new], total, place[new]

    def _slice(self, a: int, b: int):
        anchor, h = anchors_in(self.raw[a:b], self.length)
        start = np.arange(a, a + len(anchor))
        text = np.searchsorted(self.begin, start, side="right") - 1
        inside = start + self.length <= (self.begin + self.sizes)[text]
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if not len(start):
            return np.zeros(0, np.uint64), start, start, start
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(new, len(start)))
        # least hashes are small ones, so they are mixed again, or the first parts of the key space would have them all
        return mix(h[anchor[new]]), start[new], count, anchor[new] + a

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hash >> np.uint64(64 - 8 * KEY_BYTES), return_counts=True)

    def choose(self, chosen: np.ndarray, hot: np.ndarray) -> None:
        """Keeps the chosen runs only, and cuts those of hot anchors into stretches of starts. All windows of a stretch
        share more bytes than the anchor, which give the stretch its hash: so the surroundings of a hot anchor go to
        as many collections as they differ in those bytes, and equal windows still meet."""
        self.hash, self.first, self.count, self.place = (x[chosen] for x in (self.hash, self.first, self.count, self.place))
        hot = hot[chosen]
        if not hot.any():
            return
        starts = self.length - GRAM + 1
        wide = -(-starts // STRETCHES)
        low = self.first - self.place + starts - 1  # 0 is the start furthest left of the anchor
        pieces = np.where(hot, (low + self.count - 1) // wide - low // wide + 1, 1)
        run = np.repeat(np.arange(len(hot)), pieces)
        stretch = low[run] // wide + np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a = np.where(hot[run], np.maximum(low[run], stretch * wide), low[run])
        b = np.where(hot[run], np.minimum(low[run] + self.count[run], (stretch + 1) * wide), low[run] + self.count[run])
        self.hash, self.place = self.hash[run], self.place[run]
        self.first, self.count = self.place + a - starts + 1, b - a
        cut = np.flatnonzero(hot[run])
        from_, to = np.minimum((stretch[cut] + 1) * wide, starts) - 1, stretch[cut] * wide + self.length
        begin = self.place[cut] - starts + 1
        raw = self.raw.tobytes()
        fresh = [
            hashlib.blake2b(raw[i:j], digest_size=8, key=b"%d,%d" % (h, k)).digest()
            for i, j, h, k in zip((begin + from_).tolist(), (begin + to).tolist(), self.hash[cut].tolist(), stretch[cut].tolist())
        ]
        self.hash[cut] = np.frombuffer(b"".join(fresh), "<u8")

    def strings(self) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """The different surroundings among the runs, sorted: (hash, first column, starts, bytes); how many runs have
        each; and the row of each run."""
        raw = self.raw.tobytes()
        rows = [
            (h, f - p, c, raw[f : f + c - 1 + self.length])
            for h, f, c, p in zip(*(x.tolist() for x in (self.hash, self.first, self.count, self.place)))
        ]
        different = sorted(set(rows))
        index = {r: i for i, r in enumerate(different)}
        row = np.fromiter(map(index.__getitem__, rows), np.int64, len(rows))
        return different, np.bincount(row, minlength=len(different)), row


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    edges = (np.arange(parts + 1, dtype=np.float64) * (2.0 ** (8 * KEY_BYTES) / parts)).astype(np.uint64)
    return np.searchsorted(keys, edges)


def pack_keys(keys: np.ndarray) -> bytes:
    wide = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return squeeze(wide[:, :KEY_BYTES].T.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(KEY_BYTES, -1).T
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :KEY_BYTES] = raw
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


def repeated_starts(hashes: np.ndarray, columns: np.ndarray, starts: np.ndarray, data: list[bytes], twice: np.ndarray, length: int, skip: int = 0) -> np.ndarray:
    """Whether each start of each string is repeated; flags of all strings one after another.

    Strings of one hash are one collection; columns holds the column of each string's first byte, relative to the
    anchor. twice: strings that came more than once. skip: bytes before each string in data.
    """
    n = len(data)
    order = np.argsort(hashes, kind="stable")
    group = np.cumsum(np.concatenate([[0], hashes[order][1:] != hashes[order][:-1]])) if n else np.zeros(0, np.int64)
    flags = np.repeat(twice, starts)
    flag_at = np.cumsum(starts) - starts
    members = np.bincount(group, minlength=1)
    edges = np.searchsorted(group, np.arange(len(members) + 1))
    for a, b in _batches(members):
        here = slice(edges[a], edges[b])
        _collection(order[here], group[here], columns, starts, data, flags, flag_at, length, skip)
    return flags


def _batches(members: np.ndarray, most: int = 5_000) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, m in enumerate(members.tolist()):
        if total and total + m > most:
            yield start, i
            start, total = i, 0
        total += m
    if total:
        yield start, len(members)


def _collection(rows, group, columns, starts, data, flags, flag_at, length, skip) -> None:
    alone = np.bincount(group - group[0])[group - group[0]] < 2
    rows, group = rows[~alone], group[~alone]
    if not len(rows):
        return
    sizes = starts[rows] - 1 + length
    first = columns[rows]
    last = first + sizes - 1
    left, right = int(first.min()), int(last.max())
    # the columns, from the right, each a run of one symbol of every string
    width = right - left + 1
    lines = bytearray(len(rows) * width)
    for i, at, size in zip(rows.tolist(), (np.arange(len(rows)) * width + first - left).tolist(), sizes.tolist()):
        lines[at : at + size] = memoryview(data[i])[skip:]
    lines = np.frombuffer(lines, np.uint8).reshape(len(rows), width)
    order = np.arange(len(rows))  # strings in the order of their suffixes, by collection
    common = np.zeros(len(rows), np.int32)  # common prefix of the suffix at each place with the one before it
    bound = np.concatenate([[True], group[1:] != group[:-1]])  # places where a collection begins
    begin = np.flatnonzero(bound)
    of = np.cumsum(bound) - 1
    starts_here, at_flag = starts[rows], flag_at[rows]
    sentinel = np.int32(0)
    for k in range(width):
        if k % 32 == 0:
            table = np.ascontiguousarray(lines[:, max(0, width - k - 32) : width - k].T[::-1])
        at_column = right - k
        inside = (first <= at_column) & (at_column <= last)
        symbol = np.where(inside, table[k % 32].astype(np.int16) + 1, 0)[order]  # 0 stands for no symbol
        mixed = np.zeros(len(begin), bool)
        np.logical_or.at(mixed, of[1:], (symbol[1:] != symbol[:-1]) & ~bound[1:])
        there = symbol > 0
        common += there
        common[bound] = 0
        if mixed.any():
            at = np.flatnonzero(mixed[of])
            old, prefix, sym, g, edge = order[at], common[at] - there[at], symbol[at], of[at], bound[at]
            new = np.argsort(g.astype(np.int64) * 512 + sym, kind="stable")
            agree = np.concatenate([[False], (g[new][1:] == g[new][:-1]) & (sym[new][1:] == sym[new][:-1]) & (sym[new][1:] > 0)])
            fresh = np.full(len(at), sentinel)
            pair = np.flatnonzero(agree)
            fresh[pair] = 1 + _range_min(prefix, new[pair - 1] + 1, new[pair])
            order[at], common[at] = old[new], fresh
        start_no = at_column - first[order]
        live = (start_no >= 0) & (start_no < starts_here[order])
        if live.any():
            longest = np.maximum(common, np.append(common[1:], 0))
            hit = np.flatnonzero(live & (longest >= length))
            flags[at_flag[order[hit]] + start_no[hit]] = True


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[i] : high[i] + 1]) by doubling; low <= high."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        if here.any():
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _pack_strings(different: list[tuple], count: np.ndarray) -> bytes:
    h, c, s = (np.array([r[i] for r in different]) for i in range(3))
    head = np.array([len(different)], "<u4").tobytes()
    parts = [h.astype("<u8"), c.astype("<i4"), s.astype("<u4"), np.minimum(count, 2).astype(np.uint8)]
    return squeeze(head + b"".join(p.tobytes() for p in parts) + b"".join(r[3] for r in different))


def _unpack_strings(packed: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data = expand(packed)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at, out = 4, []
    for kind, size in (("<u8", 8), ("<i4", 4), ("<u4", 4), ("u1", 1)):
        out.append(np.frombuffer(data, kind, n, at))
        at += size * n
    sizes = out[2].astype(np.int64) - 1 + length
    ends = at + np.cumsum(sizes)
    return (*out, [data[e - z : e] for e, z in zip(ends.tolist(), sizes.tolist())])


def arrow_rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


def find_twice(dealt: DataFrame, parts: int, length: int, hot: int = HOT) -> DataFrame:
    """(block, part, flags): for the sorted anchor keys of a block in a part, 1 if they came twice or more, 2 if they are
    hot, else 0."""

    def send(key: tuple, f: pa.Table) -> pa.Table:
        keys, count = Block(block_table(f["rows"].to_pylist())["text"].to_pylist(), length).keys()
        at = part_bounds(keys, parts)
        count = np.minimum(count, 255).astype(np.uint8)
        rows = [(key[0].as_py(), p, pack_keys(keys[a:b]), squeeze(count[a:b].tobytes())) for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        return arrow_rows(rows, {"block": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "many": pa.binary()})

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_keys(x) for x in f["keys"]]
        many = [np.frombuffer(expand(m), np.uint8) for m in f["many"]]
        every, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(many), minlength=len(every))
        said = ((total > 1).astype(np.uint8) + (total > max(1, hot)))[place].astype(np.uint8)
        ends = np.cumsum([len(x) for x in lists])
        data = [squeeze(x.tobytes()) for x in np.split(said, ends[:-1])]
        return pd.DataFrame({"block": f["block"], "part": f["part"], "flags": data})

    sent = dealt.groupBy("block").applyInArrow(send, "block int, part int, keys binary, many binary")
    return sent.groupBy("part").applyInPandas(answer, "block int, part int, flags binary")


def choose_runs(block: Block, right: pd.DataFrame, parts: int) -> None:
    """Keeps the block's runs whose anchors came twice; those of hot anchors in stretches."""
    keys, _ = block.keys()
    at = part_bounds(keys, parts)
    said = np.ones(len(keys), np.uint8)
    for p, data in zip(right["part"], right["flags"]):
        said[at[p] : at[p + 1]] = np.frombuffer(expand(data), np.uint8)
    said = said[np.searchsorted(keys, block.hash >> np.uint64(64 - 8 * KEY_BYTES))]
    block.choose(np.flatnonzero(said), said > 1)


def _by_part(different: list[tuple], parts: int) -> np.ndarray:
    return part_bounds(np.array([r[0] >> (64 - 8 * KEY_BYTES) for r in different], np.uint64), parts)


def find_repeats(dealt: DataFrame, twice: DataFrame, parts: int, length: int) -> DataFrame:
    """(block, part, flags): for the sorted surroundings of a block in a part, which of their starts are repeated."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(block_table(left["rows"].to_pylist())["text"].to_pylist(), length)
        choose_runs(block, right.to_pandas(), parts)
        different, count, _ = block.strings()
        at = _by_part(different, parts)
        rows = [(left["block"][0].as_py(), p, _pack_strings(different[a:b], count[a:b])) for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        return arrow_rows(rows, {"block": pa.int32(), "part": pa.int32(), "strings": pa.binary()})

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        row: dict[bytes, int] = {}  # hash and first column in front of the string; its length tells the starts
        times = array("Q")
        place = []
        for packed in f["strings"]:
            h, c, _, m, data = _unpack_strings(packed, length)
            head = np.rec.fromarrays([h, c]).tobytes()
            here = np.empty(len(data), np.int64)
            for k, x in enumerate(data):
                here[k] = i = row.setdefault(head[12 * k : 12 * k + 12] + x, len(row))
                if i == len(times):
                    times.append(0)
            for i, x in zip(here.tolist(), m.tolist()):
                times[i] += x
            place.append(here)
            del data
        every = list(row)
        del row
        heads = np.frombuffer(b"".join([x[:12] for x in every]), np.dtype([("h", "<u8"), ("c", "<i4")]))
        starts = np.fromiter(map(len, every), np.int64, len(every)) - 12 - length + 1
        flags = repeated_starts(heads["h"], heads["c"].astype(np.int64), starts, every, np.array(times) > 1, length, 12)
        begin = np.cumsum(starts) - starts
        out = []
        for rows in place:
            n = starts[rows]
            at = np.arange(int(n.sum())) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)
            out.append(squeeze(np.packbits(flags[at]).tobytes()))
        return pd.DataFrame({"block": f["block"], "part": f["part"], "repeats": out})

    sent = dealt.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(
        send, "block int, part int, strings binary"
    )
    return sent.groupBy("part").applyInPandas(answer, "block int, part int, repeats binary")


def removed_bytes(block: Block, flags: pd.DataFrame, repeats: pd.DataFrame, parts: int) -> np.ndarray:
    """Whether each byte of the block's joined texts is removed."""
    choose_runs(block, flags, parts)
    different, _, row = block.strings()
    at = _by_part(different, parts)
    starts = np.array([r[2] for r in different], np.int64)
    begin = np.concatenate([[0], np.cumsum(starts)])
    hit = np.zeros(int(begin[-1]), bool)
    for p, data in zip(repeats["part"], repeats["repeats"]):
        a, b = begin[at[p]], begin[at[p + 1]]
        hit[a:b] = np.unpackbits(np.frombuffer(expand(data), np.uint8), count=int(b - a)).astype(bool)
    n = block.count
    source = np.arange(int(n.sum())) + np.repeat(begin[row] - (np.cumsum(n) - n), n)
    start = np.arange(int(n.sum())) + np.repeat(block.first - (np.cumsum(n) - n), n)
    start = start[hit[source]]  # ascending
    change = np.zeros(len(block.raw) + 1, np.int8)
    if len(start):
        apart = np.flatnonzero(start[1:] > start[:-1] + block.length)
        change[np.concatenate([start[:1], start[1:][apart]])] += 1
        change[np.concatenate([start[:-1][apart], start[-1:]]) + block.length] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, with the other bytes of every character of which a byte is gone."""
    if not len(raw):
        return gone
    character = np.cumsum((raw & 0xC0) != 0x80)
    return (np.bincount(character, weights=gone) > 0)[character]


def dedup(docs: DataFrame, length: int = LENGTH, characters: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; with characters, of those the ones in whole
    characters) and rest (all other columns, as a struct)."""
    dealt = in_blocks(docs, carry=True)
    parts = max(1, -(-dealt.text_bytes // PART_BYTES))
    twice = find_twice(dealt, parts, length, hot)
    repeats = find_repeats(dealt, twice, parts, length)
    told = twice.select("block", "part", "flags", F.lit(None).cast("binary").alias("repeats")).unionByName(
        repeats.select("block", "part", F.lit(None).cast("binary").alias("flags"), "repeats")
    )
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
         T.StructField("kept", T.BinaryType()), *([T.StructField("rest", T.StructType(rest))] if rest else [])]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = block_table(left["rows"].to_pylist())
        block = Block(left["text"].to_pylist(), length)
        told = right.to_pandas()
        gone = removed_bytes(block, told[told["flags"].notna()], told[told["repeats"].notna()], parts)
        rise = np.concatenate([gone[:1], gone[1:] & ~gone[:-1]]) if len(gone) else gone
        rise[block.begin[block.sizes > 0]] = gone[block.begin[block.sizes > 0]]
        total, rises = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, rise))
        a, b = block.begin, block.begin + block.sizes
        raw = block.raw
        if characters:
            gone = whole_characters(raw, gone)
        kept = [raw[i:j][~gone[i:j]].tobytes() for i, j in zip(a.tolist(), b.tolist())]
        columns = [left["doc_id"], pa.array(block.sizes), pa.array(total[b] - total[a]), pa.array(rises[b] - rises[a]), pa.array(kept, pa.binary())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if "rest" in left.column_names:
            columns.append(left["rest"])
            names.append("rest")
        return pa.table(columns, names=names)

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages taken out of text; documents that lose all their text go. A character cut in
    two loses its other bytes as well."""
    found = dedup(docs, length, characters=True).where("octet_length(kept) > 0")
    made = found.withColumn("text", F.col("kept").cast("string"))
    out = [
        F.col(c) if c in ("doc_id", "text")
        else F.length("text").cast("long").alias(c) if c == "n_chars"
        else F.col("rest")[c].alias(c)
        for c in docs.columns
    ]
    return made.select(*out)
