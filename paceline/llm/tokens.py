"""Cached encoding of whole texts with public tokenizer files.

Most words of a corpus repeat, and BPE never merges across the cuts made before it, so a text is cut at white
space, each distinct piece is encoded once for as long as it stays in a bounded cache, and ids are gathered by
position. A full cache keeps the pieces used most, so pieces that come once don't drive out those that repeat. Texts
whose cuts depend on their neighbours are encoded whole by the library.

An empty text has no ids. Equal pieces have equal ids wherever they stand, so repeats cost a look-up each. A text of any
length is cut whole; texts are encoded in groups of about a million characters, and a single one over that is its own
group. Nulls are the callers' matter: every operator makes them empty before.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from paceline.llm.bpe import ArrayBpe, ByteBpe, WordBpe, gather

#: Pieces that a full cache keeps; it is full at twice as many.
GENERATION = 200_000
#: Characters of texts that are encoded at once.
GROUP_CHARS = 1_000_000

_ENCODERS: dict[tuple[str, str], "CachedEncoder"] = {}


def encoder(kind: str, path: str) -> "CachedEncoder":
    """One encoder for each worker process, tokenizer kind ('byte' or 'word') and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = {"byte": ByteEncoder, "word": WordEncoder}[kind](path)
    return _ENCODERS[kind, path]


class _Index(dict):
    """Rows by piece, in order; a piece not yet known gets the next row and is noted as new."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self)
        self.new.append(piece)
        return row


class CachedEncoder:
    bpe_kind: type[ArrayBpe]
    #: What stands before every piece.
    before = ""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bpe = self.bpe_kind(path)
        self._index = _Index()
        self._uses = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)
        self._start = np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """The independent pieces of a text, or None if it must be encoded whole."""
        raise NotImplementedError

    def encode_pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        plain = self.bpe.simple.fullmatch
        odd = {p for p in pieces if not plain(p) or "<|" in p}
        if not odd:
            return self.bpe.encode(pieces)
        flat, sizes = self.bpe.encode([p for p in pieces if p not in odd])
        parts = iter(np.split(flat, np.cumsum(sizes)))
        every = [np.array(self.whole(self.before + p), np.uint32) if p in odd else next(parts) for p in pieces]
        return np.concatenate(every), np.fromiter(map(len, every), np.int64, len(every))

    def head(self, text: str) -> list[int]:
        """Ids of what stands before the pieces."""
        return []

    def _forget(self) -> None:
        """Keeps the most used pieces, of equally used ones the newest; what was used long ago counts half each time."""
        order = np.argsort(self._uses, kind="stable")[max(0, len(self._uses) - GENERATION) :]
        used = np.zeros(len(self._uses), bool)
        used[order] = True
        kept = [p for p, u in zip(self._index, used.tolist()) if u]
        self._flat, self._start = gather(self._flat, self._start, np.flatnonzero(used))
        self._index = _Index(zip(kept, range(len(kept))))
        self._uses = self._uses[used] // 2

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """The cache's row of each piece; new pieces are encoded."""
        if len(self._index) > 2 * GENERATION:
            self._forget()
        index = self._index
        rows = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        uses = np.bincount(rows, minlength=len(index))
        uses[: len(self._uses)] += self._uses
        self._uses = uses
        new, index.new = index.new, []
        if new:
            parts = [self.encode_pieces(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            flat, sizes = (np.concatenate(x) for x in zip(*parts))
            self._flat = np.concatenate([self._flat, flat])
            self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(sizes)])
        return rows

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, as arrays of unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        group: list[tuple[str, list[str] | None]] = []
        size = 0
        for text in texts:
            group.append((text, self.pieces(text)))
            size += len(text)
            if size > GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, group: list[tuple[str, list[str] | None]]) -> list[np.ndarray]:
        every = [p for _, pieces in group if pieces for p in pieces]
        rows = self._rows(every)
        flat, start = gather(self._flat, self._start, rows)
        out, at = [], 0
        for text, pieces in group:
            if pieces is None:
                out.append(np.array(self.whole(text), np.uint32))
                continue
            ids = flat[start[at] : start[at + len(pieces)]]
            at += len(pieces)
            head = self.head(text)
            out.append(np.concatenate([np.array(head, np.uint32), ids]) if head else ids)
        return out


class WordEncoder(CachedEncoder):
    """Tokenizers that drop white space: the pieces are the runs between it."""

    _odd = re.compile("[\x1c-\x1f]")

    bpe_kind = WordBpe

    @classmethod
    def odd(cls, text: str) -> bool:
        """Whether Python and the library part this text differently."""
        return cls._odd.search(text) is not None

    def pieces(self, text: str) -> list[str] | None:
        return None if self.odd(text) else text.split()


class ByteEncoder(CachedEncoder):
    """Byte-level BPE that joins a space to the word after it: the pieces are cut before single spaces."""

    _odd = re.compile(r" \s|<\|")

    bpe_kind = ByteBpe
    before = " "

    def pieces(self, text: str) -> list[str] | None:
        return None if self._odd.search(text) else text.split(" ")[1:]

    def head(self, text: str) -> list[int]:
        first = text.partition(" ")[0]
        return self.whole(first) if first else []
