"""BPE encoding and decoding by traversal of a trie of distinct words.

The words of a task's texts go into a trie, which is walked depth first; sorted words visit it in that order. At each node
stands the last token of the encoding of the prefix that leads to it: the one token that ends the prefix and may follow the
last token of what is left of it. Tokens may follow each other if merging both together would give the two again. So
prefixes that words share are encoded once, and a word's encoding is read off by stepping back from its last token.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose encodings a task remembers.
REMEMBERED = 400_000
#: Stands for the word-end mark, so that a symbol with it is one sign and this.
WORD_END = "\n"


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """A word-level BPE model: ids and merges of the symbols, the word-end mark, special strings and the word pattern."""

    ids: dict[str, int]
    halves: dict[int, tuple[int, int]]  # the two tokens that merge into a token
    merged: dict[tuple[int, int], int]  # rank of a merge
    rank: dict[int, int]  # rank of the merge that makes a token; a base symbol has none
    special: dict[str, int]
    pattern: str
    endings: dict[str, tuple[tuple[int, int], ...]]  # for each beginning of a token (WORD_END for the mark): tokens that end it, longest first, and their symbols
    follows: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        halves, merged, rank = {}, {}, {}
        for i, (a, b) in enumerate(spec["model"]["merges"]):
            whole = ids[a + b]
            merged.setdefault((ids[a], ids[b]), i)
            if whole not in halves:
                halves[whole], rank[whole] = (ids[a], ids[b]), i
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marked = {t.removesuffix(end) + WORD_END if end and t.endswith(end) and t != end else t: i for t, i in ids.items()}
        endings = {}
        for token in marked:
            for n in range(1, len(token) + 1):
                if (begun := token[:n]) not in endings:
                    own = [(marked[x], len(x) - x.endswith(WORD_END)) for k in range(n) if (x := begun[k:]) in marked]
                    endings[begun] = tuple(own)
        return cls(ids, halves, merged, rank, special, split["pattern"]["Regex"], endings)

    def _border_stands(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the border between two tokens comes before ``limit``, at any stage of their making.

        The later-made of the two tokens is taken apart first. A merge across the border is too late if its rank is not
        below that of the merge just undone; at equal rank the one further left goes first, which is the undone merge
        if it lies left of the border and the crossing one if it lies right.
        """
        while True:
            meeting = self.merged.get((left, right))
            if meeting is not None and meeting < limit:
                return False
            rank_left, rank_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                limit, left = rank_left, self.halves[left][1]
            else:
                limit, right = rank_right + 1, self.halves[right][0]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the token is the encoding of its own symbols and stays so after the token ``before`` (-1: the word's start)."""
        key = before << 32 | token
        known = self.follows.get(key)
        if known is None:
            if before < 0:
                halves = self.halves.get(token)
                known = halves is None or (all(self.may_follow(-1, x) for x in halves) and self._border_stands(*halves, self.rank[token]))
            else:
                known = self.may_follow(-1, token) and self._border_stands(before, token, float("inf"))
            self.follows[key] = known
        return known

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of distinct words of byte signs, given in sorted order."""
        endings, follows, may_follow = self.endings, self.follows, self.may_follow
        path = ""
        last: list[int] = []  # last token of path[:i + 1]
        begins: list[int] = []  # where it begins
        reach: list[int] = []  # where the longest beginning of a token begins that ends there
        for word in words:
            n, shared = len(word) - 1, 0
            most = min(n, len(path))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared:], begins[shared:], reach[shared:]
            path = word[:n]
            at = reach[-1] if shared else 0
            for end in range(shared + 1, n + 2):
                while (found := endings.get(word[at:end])) is None:
                    at += 1
                if end > n:
                    while (found := endings.get(word[at:] + WORD_END)) is None:
                        at += 1
                for token, size in found:
                    start = end - size
                    before = last[start - 1] if start else -1
                    ok = follows.get(before << 32 | token)
                    if may_follow(before, token) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no encoding for {word!r}")
                last.append(token)
                begins.append(start)
                reach.append(at)
            reach.pop()
            out, start = [last.pop()], begins.pop()
            while start:
                out.append(last[start - 1])
                start = begins[start - 1]
            yield word, tuple(reversed(out))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary.load(path)


class Encoder:
    """Encodes texts of one task; remembers the encodings of up to REMEMBERED words and starts over beyond."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.signs = _byte_signs()
        self.table = {b: s for b, s in enumerate(self.signs)}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pieces = {i: t for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}
        self.word = regex.compile(vocabulary.pattern)
        self.space = regex.compile(r"\s+")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def words(self, text: str) -> list[str]:
        """Normalized words of a text in order; a special string is marked by a line end, which no word holds."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [text[at : m.start()], m[0]]
            at = m.end()
        parts.append(text[at:])
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append("\n" + part)
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = part.lower() if part.isascii() else self.lower(part)
                out += self.word.findall(part)
        return out

    @staticmethod
    def lower(text: str) -> str:
        """Each code point by itself: a final sigma is not told apart."""
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        signed = {}
        for word in new:
            if word[0] == "\n":
                token = self.vocabulary.special[word[1:]]
                self.known[word] = pack("<I", token), word[1:]
            else:
                signed["".join(map(self.table.__getitem__, word.encode()))] = word
        for signs, tokens in self.vocabulary.encode_words(sorted(signed)):
            self.known[signed[signs]] = pack(f"<{len(tokens)}I", *tokens), " ".join(map(self.pieces.__getitem__, tokens))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit numbers, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            found = [self.known[w] for w in words]
            yield b"".join([x for x, _ in found]), " ".join([y for _, y in found])


def _encode(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    encoder = None
    for batch in batches:
        encoder = encoder or Encoder(load(path))
        texts = batch["text"].fill_null("")
        for row in range(0, len(batch), 256):
            part = texts.slice(row, 256).to_pylist()
            found = list(encoder.encode(part))
            if full:
                columns = [pa.array([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.string())]
                names = ["ids", "decoded"]
            else:
                columns = [
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([sha256(t.encode()).hexdigest() for _, t in found], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, 256), *columns], names=["doc_id", *names])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; ``path`` is a vocabulary file that every executor can open.

    A null text counts as empty and has no ids. Only doc_id and text are looked at.
    """
    return _rows(docs).mapInArrow(partial(_encode, path=path, full=True), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same, as digests of ids and decoded text."""
    return _rows(docs).mapInArrow(partial(_encode, path=path, full=False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
