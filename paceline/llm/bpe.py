"""Byte-pair merges of many words at once, over arrays.

All words of a batch are merged in rounds: each round finds, for every word, its adjacent pair of lowest rank
and joins all places of that pair. A pair made by a merge always ranks after it, so the rounds give what
merging one pair at a time gives.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> (rank, merged id), as an open hash table in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(left))))) + 4)
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        todo, place = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.key[place] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            first = first[free[first]]
            at, rows = place[first], todo[first]
            self.key[at], self.rank[at], self.merged[at] = keys[rows], rows, merged[rows]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, place = todo[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's row of each pair; a row of rank _NONE if there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._place(keys)
        at = self.key[place]
        wrong = np.flatnonzero((at != keys) & (at != np.uint64(2**64 - 1)))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            at = self.key[place[wrong]]
            wrong = wrong[(at != keys[wrong]) & (at != np.uint64(2**64 - 1))]
        return place


def merge_words(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merged ids of all words one after another, and how many each has. symbols: first ids of all words."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    word = np.repeat(np.arange(len(sizes)), sizes)
    sym = symbols.astype(np.int64)
    while len(sym):
        inner = word[1:] == word[:-1]
        at = np.flatnonzero(inner)
        row = table.find(sym[at], sym[at + 1])
        rank = np.full(len(sym), _NONE, np.int32)
        rank[at] = table.rank[row]
        begin = np.flatnonzero(np.concatenate([[True], ~inner]))
        least = np.minimum.reduceat(rank, begin)
        span = np.diff(np.append(begin, len(sym)))
        best = np.repeat(least, span)
        hit = (rank == best) & (rank != _NONE)
        if hit.any():
            # of touching places of one pair, every second one is joined, from the left
            places = np.flatnonzero(hit)
            new_run = np.concatenate([[True], np.diff(places) != 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            joined = np.zeros(len(sym), np.int64)
            joined[at] = table.merged[row]
            sym[places] = joined[places]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
        else:
            keep = np.ones(len(sym), bool)
        over = np.repeat(least == _NONE, span)
        if over.any():
            out.append((word[over], sym[over], None))
            keep &= ~over
        sym, word = sym[keep], word[keep]
    if not out:
        return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
    words = np.concatenate([x[0] for x in out])
    ids = np.concatenate([x[1] for x in out])
    order = np.argsort(words, kind="stable")
    return ids[order].astype(np.uint32), np.bincount(words, minlength=len(sizes)).astype(np.int64)


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself, or one from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class ArrayBpe:
    """BPE of many pieces at once, for pieces of Latin characters; others are left to the library."""

    #: Characters whose handling is known to agree with the library: up to Latin Extended-A.
    simple = re.compile("[!-~¡-¬®-ſ\n]+")
    separator = "\0"
    cut: re.Pattern

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        left = np.array([vocab[a] for a, _ in pairs])
        right = np.array([vocab[b] for _, b in pairs])
        merged = np.array([vocab[a + b] for a, b in pairs])
        self.table = PairTable(left, right, merged)
        chars = byte_characters()
        self.inner = np.array([vocab[chars[b]] for b in range(256)])
        self.final = np.array([vocab[chars[b] + end] for b in range(256)])

    def joined(self, pieces: Sequence[str]) -> str:
        raise NotImplementedError

    def encode(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each matching ``simple`` whole, one after another, and how many each has."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = self.cut.findall(self.joined(pieces))
        rows = {w: i for i, w in enumerate(dict.fromkeys(cut))}
        data = [w.encode() for w in rows]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[raw[last]]
        ids, counts = merge_words(symbols, sizes, self.table)
        gone = rows.get(self.separator, -1)
        if gone >= 0:
            start = int(counts[:gone].sum())
            ids = np.delete(ids, slice(start, start + counts[gone]))
            counts[gone] = 0
        starts = np.concatenate([[0], np.cumsum(counts)])
        order = np.fromiter(map(rows.__getitem__, cut), np.int64, len(cut))
        flat, at = gather(ids, starts, order)
        ends = np.append(at[np.flatnonzero(order == gone)], at[-1])
        return flat, np.diff(ends, prepend=0)


class WordBpe(ArrayBpe):
    """Lower-cased words with word ends; white space is dropped."""

    cut = re.compile(r"\0|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w\0]|_)+")

    def joined(self, pieces: Sequence[str]) -> str:
        text = self.separator.join(pieces)
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


class ByteBpe(ArrayBpe):
    """Bytes, a space going with the word after it; every piece follows a space."""

    cut = re.compile(
        r"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼-¾]+| ?[\d²³¹¼-¾]+| ?(?:[^\s\w\0]|_)+|\s+(?![^\s\0])|\s+"
    )

    def joined(self, pieces: Sequence[str]) -> str:
        return " " + (self.separator + " ").join(pieces)


def gather(flat: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start[r]:start[r+1]] of the given rows one after another, and where each begins."""
    sizes = start[rows + 1] - start[rows]
    out_start = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(sizes, out=out_start[1:])
    at = np.arange(out_start[-1], dtype=np.int64) + np.repeat(start[rows] - out_start[:-1], sizes)
    return flat[at], out_start
