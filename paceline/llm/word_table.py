"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space in Spark, block by block; each block sends every word it has once to the part of
the word table that the word's hash names; each part encodes a distinct word once, however many blocks sent it,
and answers every block with the ids of its words in the order sent; the block then joins ids back by position.
Decoding joins each id to its piece in the vocabulary, a table as large as the tokenizer file and no larger.

Blocks are groups of documents of some million characters, dealt by row, so copies of one text spread
over blocks, and a word that is in every text is sent once for each block and encoded once.

Nulls, empties and ties: a null text is empty and gives no ids, the digest of the empty string, and an empty
decoded text. Repeated rows are encoded row by row. A text with separators that the library treats in another
way than Python's split (U+001C to U+001F) is encoded whole. An empty table gives no rows. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paceline.llm.common import block_rows, expand, in_blocks, partitions, squeeze
from paceline.llm.tokens import WordEncoder, encoder

#: Bytes of text in a block, about: the more, the fewer words are sent more than once.
BLOCK_BYTES = 16_000_000

_PIECES: dict[str, list[str]] = {}


def words_by_part(texts: list[str], parts: int) -> dict[int, list[str]]:
    """The distinct words of a block, sorted, by the part of the table that keeps them."""
    found: set[str] = set()
    for t in texts:
        if not WordEncoder.odd(t):
            found.update(t.split())
    out: dict[int, list[str]] = {}
    for w in sorted(found):
        out.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts, []).append(w)
    return out


def joined(words: list[str]) -> bytes:
    return "\n".join(words).encode("utf-8", "surrogatepass")


def pack_ids(flat: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of ids as bytes or more, and ids as byte planes."""
    wide = 1 if not len(sizes) or sizes.max() < 255 else 4
    head = np.array([len(sizes), wide], "<u4").tobytes()
    planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return squeeze(head + sizes.astype(f"<u{wide}").tobytes() + planes, 9)


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = expand(data)
    n, wide = np.frombuffer(raw, "<u4", 2).tolist()
    sizes = np.frombuffer(raw, f"<u{wide}", n, 8).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=8 + n * wide).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0], sizes


def send_words(dealt: DataFrame, parts: int) -> DataFrame:
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found = words_by_part(list(block_rows(f)["text"]), parts)
        data = [squeeze(joined(ws), 9) for ws in found.values()]
        return pd.DataFrame({"block": np.int32(key[0]), "part": list(found), "words": data})

    return dealt.groupBy("block").applyInPandas(run, "block int, part int, words binary")


def answer(asked: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes each distinct word of a part once and answers every block that sent it."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sent = [expand(x) for x in f["words"]]
        lists = [x.decode("utf-8", "surrogatepass").split("\n") for x in sent]
        row = {w: i for i, w in enumerate({w: None for ws in lists for w in ws})}
        encode = encoder("word", tokenizer)
        words = list(row)
        made = [encode.encode_pieces(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]
        flat, sizes = (np.concatenate(x) for x in zip(*made))
        start = np.concatenate([[0], np.cumsum(sizes)])
        replies = []
        for ws in lists:
            rows = np.fromiter(map(row.__getitem__, ws), np.int64, len(ws))
            n = sizes[rows]
            at = np.arange(int(n.sum())) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
            replies.append(pack_ids(flat[at], n))
        digest = [zlib.crc32(x) for x in sent]
        return pd.DataFrame({"block": f["block"], "part": np.int32(key[0]), "digest": digest, "ids": replies})

    return asked.groupBy("part").applyInPandas(run, "block int, part int, digest long, ids binary")


def pieces_of(tokenizer: str) -> list[str]:
    """The piece of each id."""
    if tokenizer not in _PIECES:
        library = encoder("word", tokenizer).library
        _PIECES[tokenizer] = [library.id_to_token(i) for i in range(library.get_vocab_size())]
    return _PIECES[tokenizer]


def encode_and_decode(docs: DataFrame, tokenizer: str, texts_out: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with texts_out the ids and texts too."""
    parts = partitions(docs.sparkSession)
    dealt = in_blocks(docs, BLOCK_BYTES)
    replies = answer(send_words(dealt, parts), tokenizer)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        piece = pieces_of(tokenizer)
        left = block_rows(left)
        texts = list(left["text"])
        found = words_by_part(texts, parts)
        row: dict[str, int] = {}
        numbers: list[str] = []
        decoded: list[str] = []
        counts: list[int] = []
        number = list(map(str, range(len(piece))))

        def keep(w: str, ids: list[int]) -> None:
            row[w] = len(counts)
            numbers.append(" ".join([number[i] for i in ids]))
            decoded.append(" ".join([piece[i] for i in ids]))
            counts.append(len(ids))

        told = {int(p): (d, x) for p, d, x in zip(right["part"], right["digest"], right["ids"])}
        encode = encoder("word", tokenizer)
        for part, words in found.items():
            digest, data = told[part]
            if digest != zlib.crc32(joined(words)):
                raise ValueError(f"part {part} answered other words than this block sent")
            flat, sizes = unpack_ids(data)
            every, at = flat.tolist(), 0
            for w, n in zip(words, sizes.tolist()):
                keep(w, every[at : at + n])
                at += n
        rows = []
        for doc_id, text in zip(left["doc_id"], texts):
            if WordEncoder.odd(text):
                ids = encode.whole(text)
                n, a, b = len(ids), " ".join(map(str, ids)), " ".join(piece[i] for i in ids)
            else:
                at = list(map(row.__getitem__, text.split()))
                n = sum(map(counts.__getitem__, at))
                a, b = " ".join(map(numbers.__getitem__, at)), " ".join(map(decoded.__getitem__, at))
            digest = hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode("utf-8")).hexdigest()
            rows.append((doc_id, n, *digest, *((a, b) if texts_out else ())))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        frame = pd.DataFrame(rows, columns=names[: 6 if texts_out else 4])
        frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in left["doc_id"]], dtype="Int64")
        return frame

    both = dealt.groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInPandas(run, out + (", ids string, decoded string" if texts_out else ""))
