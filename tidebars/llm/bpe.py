"""Byte-level BPE, with content-defined chunks that are encoded once and joined exactly.

A text is cut where the hash of the eight bytes at a position has its low bits clear,
wherever that is, so equal passages in different documents give equal chunks. A chunk is
encoded once for each Python worker that meets it, alone, as if it were a text. That is
wrong around its ends, so every join is repaired: the ids around it are thrown away and the
text there is encoded again, in a window that grows on both sides, over whole chunks if it
must, until it ends at places where the encodings of the parts and of the whole agree for
certain. Such a place is one between two characters at which the pre-tokenizer starts a new
piece whatever stands around them: where a run of letters, digits or other signs ends, but
for an apostrophe before a letter, which may go with it, and for runs of blanks, whose last
one may go with what follows. Joins that are such places themselves need no repair.

Added tokens of the vocabulary are split off before anything else, as the library does.

Defined results: null is the empty text, which has no ids; repeated rows give repeated
results; a text of any length is cut and encoded whole; an empty table gives an empty
table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHUNK_BITS = 9  # cuts are 2**CHUNK_BITS bytes apart on average
CACHE_BYTES = 96_000_000  # kept chunks of one Python worker

_CODECS: dict[tuple[str, str, str], Codec] = {}

_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


@lru_cache(65536)
def _kind(c: str) -> str:
    """L, N, S or O as the pre-tokenizer sees a character; ? where that is not settled.

    Settled are the characters that Unicode 3.2, of 2002, had in the class that they have now: whichever version
    the pre-tokenizer was built with lies in between.
    """
    now, then = (x[0] if x[0] in "LN" else "?" if x[0] == "Z" or x == "Cn" else "O" for x in (unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)))
    return "S" if c in _SPACES else now if now == then else "?"


@lru_cache(65536)
def is_border(a: str, b: str) -> bool:
    """Whether a new piece starts between the characters ``a`` and ``b``, whatever stands around them."""
    x, y = _kind(a), _kind(b)
    if x == "?":  # a blank starts a piece after any sign; of what is not settled, only U+180E ever was one
        return y == "S" and a != "\u180e"
    return y != "?" and x != y and x != "S" and not (a == "'" and y == "L")


class Ids(NamedTuple):
    """How many ids, the ids as text, and the bytes that they decode to."""

    n: int
    joined: str
    decoded: bytes


class Chunk(NamedTuple):
    """A chunk encoded alone: its ids up to its first border, between the first and the last, and from there on, and the texts of both ends.

    Without a border all of it is head.
    """

    first: str
    last: str
    head_text: str
    tail_text: str | None
    head: Ids
    middle: Ids
    tail: Ids


class Codec:
    """Encodes with one vocabulary; chunks and windows that it has encoded it keeps, the latest ``CACHE_BYTES`` to twice as many."""

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer_path, encoding="utf-8") as f:
            self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: x.encode() for x, i in self.added.items()}
        self.young: dict[bytes | str, Chunk | Ids] = {}
        self.old: dict[bytes | str, Chunk | Ids] = {}
        self.size = self.asked = self.made = 0

    def keep(self, key: bytes | str, made: Chunk | Ids, size: int) -> None:
        self.size += 400 + 4 * size
        if self.size > CACHE_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[key] = made

    def known(self, key: bytes | str) -> Chunk | Ids | None:
        if (x := self.young.get(key)) is None and (x := self.old.get(key)) is not None:
            self.keep(key, x, len(key))
        return x

    def ids(self, tokens: list[int]) -> Ids:
        return Ids(len(tokens), ",".join(map(str, tokens)), b"".join(map(self.bytes_of.__getitem__, tokens)))

    def window(self, text: str) -> Ids:
        """A text from border to border."""
        if (x := self.known(text)) is None:
            x = self.ids(self.bpe.encode_ordinary(text))
            self.keep(text, x, len(text))
        return x

    def chunk(self, raw: bytes) -> Chunk:
        self.asked += len(raw)
        if (x := self.known(raw)) is not None:
            return x
        self.made += len(raw)
        text = raw.decode()
        tokens = self.bpe.encode_ordinary(text)
        low = next((i for i in range(1, len(text)) if is_border(text[i - 1], text[i])), None)
        none = Ids(0, "", b"")
        if low is None:
            x = Chunk(text[0], text[-1], text, None, self.ids(tokens), none, none)
        else:
            high = next(i for i in range(len(text) - 1, 0, -1) if is_border(text[i - 1], text[i]))
            head, tail = text[:low], text[high:]
            k = self.count(tokens, len(head.encode()))
            m = len(tokens) - self.count(tokens[::-1], len(tail.encode()))
            x = Chunk(text[0], text[-1], head, tail, self.ids(tokens[:k]), self.ids(tokens[k:m]), self.ids(tokens[m:]))
        self.keep(raw, x, len(raw))
        return x

    def count(self, tokens: list[int], size: int) -> int:
        """How many of the first tokens make up ``size`` bytes."""
        k = 0
        while size > 0:
            size -= len(self.bytes_of[tokens[k]])
            k += 1
        if size:
            raise ValueError("a token reaches over a border")
        return k

    def joined(self, chunks: list[bytes]) -> Iterator[Ids]:
        """The ids of the whole that the chunks are cut from, in parts."""
        wait: list[str] = []  # text whose end is still open
        own, last = None, ""  # its ids, if one chunk's tail is all of it
        for raw in chunks:
            c = self.chunk(raw)
            if wait and is_border(last, c.first):
                yield own or self.window("".join(wait))
                wait, own = [], None
            last = c.last
            if c.tail_text is None:  # no border: the window grows over it
                own = None if wait else c.head
                wait.append(c.head_text)
                continue
            yield self.window("".join([*wait, c.head_text])) if wait else c.head
            yield c.middle
            wait, own = [c.tail_text], c.tail
        if wait:
            yield own or self.window("".join(wait))


def codec(ranks_path: str | None = None, tokenizer_path: str | None = None) -> Codec:
    """The worker's codec for a vocabulary (and the tokenizer file that names its added tokens); the default is the installed public one."""
    import public_tokenizers

    key = (ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def cuts(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """Where the content says to cut ``data``, moved on to the start of a character."""
    n = len(data)
    if n < 16:
        return np.zeros(0, np.int64)
    found = []
    for k in range(8):  # the eight alignments of an 8-byte window
        view = np.frombuffer(data, dtype="<u8", offset=k, count=(n - k) // 8)
        hashed = (view * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        found.append(np.flatnonzero(hashed == 0) * 8 + k)
    cut = np.sort(np.concatenate(found))
    b = np.frombuffer(data + b" ", dtype=np.uint8)
    for _ in range(3):  # bytes inside a character
        cut = cut + ((b[cut] & 0xC0) == 0x80)
    return np.unique(cut)


def encode_texts(texts: list[str | None], coder: Codec, bits: int = CHUNK_BITS) -> Iterator[list[Ids]]:
    """For each text its ids in parts, which add up to the text's."""
    parts, ends = [], []  # of all texts, added tokens apart
    for x in texts:
        x = x or ""
        parts += coder.split.split(x) if coder.split is not None else [x]
        ends.append(len(parts))
    raws = [b"" if x in coder.added else x.encode("utf-8", "replace") for x in parts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)])
    cut = np.unique(np.concatenate([starts, cuts(b"".join(raws), bits)]))
    first = np.searchsorted(cut, starts)
    own = []
    for i, (part, raw) in enumerate(zip(parts, raws, strict=True)):
        if part in coder.added:
            own.append(coder.ids([coder.added[part]]))
        elif raw:
            at = (cut[first[i] : first[i + 1] + 1] - starts[i]).tolist()
            own += coder.joined([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        while ends and i + 1 == ends[0]:
            ends.pop(0)
            yield own
            own = []


def _slices(texts: list, most: int = 8_000_000) -> Iterator[slice]:
    """Slices of about ``most`` characters, so that memory does not follow the batch."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    yield slice(at, len(texts))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(ranks_path)
        for pdf in batches:
            texts = pdf[text_col].tolist()
            for s in _slices(texts):
                ids = [[int(i) for p in x if p.n for i in p.joined.split(",")] for x in encode_texts(texts[s], coder)]
                yield pd.DataFrame({id_col: pdf[id_col].iloc[s], "ids": ids})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(id, text) of every row of ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(ranks_path)
        for pdf in batches:
            texts = [b"".join(map(coder.bytes_of.__getitem__, x)).decode("utf-8", "replace") if x is not None else "" for x in pdf[ids_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "text": texts})

    return encoded.select(id_col, ids_col).mapInPandas(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids and the decoded text of every row, hashed where they are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(ranks_path)
        sha = hashlib.sha256
        for pdf in batches:
            texts = pdf[text_col].tolist()
            n, ids, back = [], [], []
            for s in _slices(texts):
                for pieces in encode_texts(texts[s], coder):
                    n.append(sum(p.n for p in pieces))
                    ids.append(sha(",".join([p.joined for p in pieces if p.n]).encode()).hexdigest())
                    text = b"".join([p.decoded for p in pieces]).decode("utf-8", "replace")
                    back.append(sha(text.encode()).hexdigest())
            yield pd.DataFrame({id_col: pdf[id_col], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
