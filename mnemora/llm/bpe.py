"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A word (a match of the pre-tokenisation pattern) is held as an array of part boundaries beside an
array of the ranks of the adjacent parts' merges. The smallest rank is found by a scan, its boundary
deleted and the two ranks beside it refreshed, until no merge is left. The scan is right for short
words; longer ones (`LONG_WORD` bytes and more, where repeated scans would grow with the square of
the length) take a heap over a linked list of the same parts, which merges in the same order.

Texts repeat their words, so a worker keeps the ids of the words it has met, and of the text between
two single spaces ("chunk"), which covers one or several words: no match of the pattern crosses a
single space between two other characters, except that it takes the space along. Both stores are
bounded and only save time. The vocabulary file's bytes (1.5 MB for the public 50k vocabulary) reach
the workers as a broadcast of that size; workers open no file.

Defined results: null and empty texts have no ids; special-token strings in a text become their ids,
as the file's added tokens say; each row has its own result, so ids may be null and rows may repeat; a text
may be as long as a row can hold, one such text being what a worker holds at a time; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, map_slices, whole_text

#: Bytes from which a word takes the heap; the ids are the same either way.
LONG_WORD = 96
CHUNKS_KEPT = 200_000
WORDS_KEPT = 200_000
_NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted: bytes
    that print as themselves do so, the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _late_letters():
    """Letters and digits that the pattern's library knows from a newer Unicode than the tokenizers
    library, for which they, and the character that replaces them here, are unassigned. The library
    itself is asked, about what this Python does not know either."""
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    unassigned = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    late = [c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if len(split("a" + c)) > 1 and len(split("1" + c)) > 1]
    return frozenset(late), dict.fromkeys(map(ord, late), "\u0378")


class ByteBPE:
    """Encodes and decodes with a vocabulary file in the JSON format of the tokenizers library
    (byte-level pre-tokenizer without prefix space, no normalizer)."""

    #: The pre-tokenisation pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

    def __init__(self, data: bytes) -> None:
        import regex

        spec = json.loads(data)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level vocabulary of the supported form")
        byte_of = byte_alphabet()
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        id_of = {}
        for s, i in vocab.items():
            if s not in self.special:
                id_of[as_bytes(s)] = i
                self.table[i] = as_bytes(s)
        for s, i in self.special.items():
            self.table[i] = s.encode()
        #: The rank of a pair of part ids, and by rank the id of the merged part.
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks.setdefault((id_of[a], id_of[b]), rank)
            self.merged.append(id_of[a + b])
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(self.PATTERN)
        self.late = None
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else lambda s: [s]
        #: Whether a space and ASCII letters are one word, whatever the letters.
        self.letters = not any(x.isalpha() for x in self.special)
        self.words: dict[str, bytes] = {}
        #: Two generations by chunk: when the younger is full, the older goes.
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        if text.isascii():
            return self.pattern.findall(text)
        if self.late is None:
            self.late = _late_letters()
        letters, as_unassigned = self.late
        if letters.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(as_unassigned))]

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        parts = [self.byte_id[b] for b in word]
        return self._scan(parts) if len(parts) < LONG_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = [get(pair, _NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # a part has changed meanwhile
            parts[i] = self.merged[rank]
            parts[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (rank := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    #: How the results of words make that of a text.
    join = staticmethod(b"".join)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word, as little-endian 32-bit numbers."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            ids = self._pack(self.word_ids(word.encode()))
            if len(word) < LONG_WORD:
                self.words[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without regard to chunks."""
        out = []
        for k, piece in enumerate(self.cut(text)):
            out += [self._pack([self.special[piece]])] if k % 2 else map(self._word, self.find(piece))
        return self.join(out)

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk with the space before it; None where its edges are spaces too."""
        ids = self.old.get(chunk)
        if ids is None:
            if self.letters and chunk.isascii() and chunk.isalpha():
                ids = self._word(" " + chunk)
            elif self.letters and chunk[-1:] in (".", ",") and chunk.isascii() and chunk[:-1].isalpha():
                ids = self.join([self._word(" " + chunk[:-1]), self._word(chunk[-1])])
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return None
            else:
                ids = self._plain(" " + chunk)
        if len(chunk) < LONG_WORD:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.chunks, self.old = {}, self.chunks
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        head, *rest = text.split(" ")
        if not head or head[0].isspace() or head[-1].isspace():
            return self._plain(text)
        found = list(map(self.chunks.get, rest))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.chunks.get(rest[i])
                    if found[i] is None:
                        found[i] = self._chunk(rest[i])
                    if found[i] is None:
                        return self._plain(text)
        return self.join([self._plain(head), *found])

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class Counter(ByteBPE):
    """A ByteBPE whose encode gives the number of ids."""

    join = staticmethod(sum)
    _pack = staticmethod(len)


@lru_cache(maxsize=2)
def _counter(data: bytes) -> Counter:
    return Counter(data)


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> ByteBPE:
    return ByteBPE(data)


def ship(spark: SparkSession, path: str):
    """The vocabulary file's bytes, broadcast; their size is that of the file, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, ids): ids as little-endian unsigned 32-bit numbers in a binary column."""
    data = ship(docs.sparkSession, tokenizer_path)

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = _loaded(data.value).encode
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([encode(x) for x in part.column("text").to_pylist()], pa.binary())], [id_col, "ids"])

    return map_slices(docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text")), "text", make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """(<id_col>, ids, text): the texts of the ids."""
    data = ship(encoded.sparkSession, tokenizer_path)

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decode = _loaded(data.value).decode
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array([decode(x) for x in part.column("ids").to_pylist()], pa.string())], [id_col, "ids", "text"])

    source = encoded.select(column(id_col).alias("id"), "ids")
    return map_slices(source, "ids", make, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, ids binary, text string")
