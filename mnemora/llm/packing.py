"""Best-fit packing of token sequences by the sum of squares.

Pieces of documents go into sequences ("bins") of a fixed number of tokens. While packing, N(g) is
the number of open bins with residual gap g. A piece goes where the sum of N(g)^2 over all gaps
becomes smallest (Csirik, Johnson, Kenyon et al., "On the Sum-of-Squares Algorithm for Bin Packing"),
the tightest gap winning ties and an open bin winning against a new one. Pieces are taken longest
first, so that ties, which are then most choices, amount to best fit.

Pieces are dealt into groups of about `GROUP_PIECES`, and groups are packed independently; a group wastes
part of its last bins only. The number of groups follows from a count over all pieces. Pieces that agree in
every column are counted first (an aggregation, combined before its shuffle) and then dealt in turn over
the groups from the one that their hash names, as many to each but one; so no group can be made large by a
source, a copied text, repeated rows or ids that are null.

Defined results: a null text is an empty one and has one token, END_ID; null and repeated ids are ids like any
other, and repeated rows are pieces of their own; a length outside 1..capacity is an error; a table without
rows gives no rows; pieces of equal length are packed in the order of their columns, nulls first, so results
repeat exactly; a text may be as long as a row can hold; other columns of docs are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_slices, whole_text, written
from .bpe import byte_alphabet, ship

CAPACITY = 4096
GROUP_PIECES = 16384
#: The id that ends each document.
END_ID = 1
CHUNKS_KEPT = 400_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, in the order given: the number of its bin and the offset in it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.int64(1) << 40
    leave = np.full(capacity + 1, never)  # change of the sum when a bin leaves gap g; no bin: never
    enter = np.ones(capacity + 1, np.int64)  # change when a bin enters gap g
    enter[0] = 0  # full bins don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if not 1 <= n <= capacity:
            raise ValueError(f"a piece of {n} tokens does not fit sequences of {capacity}")
        gap, least = capacity, never
        if n < capacity:
            change = leave[n:capacity] + enter[: capacity - n]
            at = int(change.argmin())
            gap, least = n + at, int(change[at])
        if least > int(enter[capacity - n]):
            gap, bin_ = capacity, made
            made += 1
        else:
            bin_ = stacks[gap].pop()
            left = len(stacks[gap])
            leave[gap] = 1 - 2 * left if left else never
            enter[gap] = 2 * left + 1
        bins[i], offsets[i] = bin_, capacity - gap
        if left := gap - n:
            stacks[left].append(bin_)
            leave[left] = 1 - 2 * len(stacks[left])
            enter[left] = 2 * len(stacks[left]) + 1
    return bins, offsets


def pack_sequences(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of pieces, with sequence_id and offset. Columns must be ones that rows can be grouped by."""
    columns = [f"c{k}" for k in range(len(pieces.columns))]
    size = columns[pieces.columns.index(length)]
    counted = written(pieces.toDF(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    total = counted.agg(F.sum("copies").alias("n")).first()["n"] or 0
    groups = max(1, -(-total // group_pieces))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = [(size, "descending"), *((c, "ascending") for c in columns)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        rows = rows.take(np.repeat(np.arange(len(rows)), rows.column("copies").to_numpy()))
        bins, offsets = sum_of_squares(rows.column(size).to_numpy(), capacity)
        rows = rows.select(columns).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    turn = F.posexplode(F.transform(F.sequence(F.lit(0), F.least("copies", F.lit(groups)) - 1), lambda k: F.floor((F.col("copies") - k - 1) / groups).cast("long") + 1)).alias("turn", "share")
    dealt = counted.select(*columns, turn).select(*columns, F.col("share").alias("copies"), F.pmod(F.pmod(F.xxhash64(*columns), F.lit(groups)) + F.col("turn"), F.lit(groups)).alias("group"))
    schema = ", ".join([*(f"{c} {t}" for c, (_, t) in zip(columns, pieces.dtypes, strict=True)), "sequence_id long", "offset long"])
    return dealt.groupBy("group").applyInArrow(pack, schema).toDF(*pieces.columns, "sequence_id", "offset")


class WordEncoder:
    """Ids by the tokenizers library of whole texts, through bounded stores of ids met before.

    What stands between ASCII white space is encoded by itself, which is right where a vocabulary's
    normalisation and pre-tokenisation drop white space. Where they are of the form in `_SPEC`, strings of
    characters below U+0300 (all composed already) are also lowered and split here, so that the
    library's model is asked once per word instead of running its pipeline per string.
    """

    #: Normalisers and pre-tokenisers, in the order of the vocabulary file.
    _SPEC = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])

    def __init__(self, data: bytes) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Two generations by string: when the younger is full, the older goes.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        spec = json.loads(data)
        steps = [[x["type"] for x in (spec[part] or {}).get(inner, [])] for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.split = None
        if tuple(steps) == self._SPEC:
            split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
            if (split["behavior"], split["invert"]) == ("Removed", True) and not byte_level["add_prefix_space"] and not byte_level["use_regex"]:
                self.split = regex.compile(split["pattern"]["Regex"].replace("\\s", r"\p{White_Space}")).findall
        self.sign = {b: c for c, b in byte_alphabet().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: Whether a string of ASCII letters is one word, whatever it is.
        self.letters = self.split is not None and not any(s.isalpha() for s in self.special)

    def _word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            text = word.decode()
            shown = text if text.isascii() and text.isprintable() else "".join(map(self.sign.__getitem__, word))
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            if len(self.words) >= CHUNKS_KEPT:
                self.words.clear()
            self.words[word] = found
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        young, word, late = self.young, self._word, []
        for c in chunks:
            # most strings are a word, or a word and a sign; the pattern is for the others
            if self.letters and c.isalpha():
                young[c] = word(c.lower())
                continue
            if self.letters and c[:-1].isalpha() and c[-1] in b".,":
                young[c] = word(c[:-1].lower()) + word(c[-1:])
                continue
            text = c.decode()
            if self.split is None or (not c.isascii() and max(text) >= "\u0300") or any(s in text for s in self.special):
                late.append(c)
            else:
                young[c] = b"".join(word(w.encode()) for w in self.split(text.lower()))
        for start in range(0, len(late), 4096):
            part = late[start : start + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                young[c] = np.array(e.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for t in texts:
            if len(self.young) >= CHUNKS_KEPT // 2:
                self.young, self.old = {}, self.young
            words = t.encode().split()
            found = list(map(self.young.get, words))
            if None in found:
                missing = {w for w, f in zip(words, found, strict=True) if f is None}
                for c in missing:
                    if (ids := self.old.get(c)) is not None:
                        self.young[c] = ids
                self._learn([c for c in missing if c not in self.young])
                found = map(self.young.__getitem__, words)
            yield b"".join(found)


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> WordEncoder:
    return WordEncoder(data)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document's ids, END_ID last: <id_col>, piece, start, length, ids (binary).
    Only documents of more than `capacity` ids are cut, every `capacity` ids."""
    data = ship(docs.sparkSession, tokenizer_path)
    end, width = END_ID.to_bytes(4, "little"), 4 * capacity

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, ids in zip(part.column("id"), _encoder(data.value).encode_batch(part.column("text").to_pylist()), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), width)):
                piece = ids[at : at + width]
                for column, value in zip(out, (doc.as_py(), k, at // 4, len(piece) // 4, piece), strict=True):
                    column.append(value)
        kinds = (part.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [id_col, "piece", "start", "length", "ids"])

    source = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_slices(source, "text", make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary")


def packed_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """token_pieces, with ids_crc32 in place of the ids, packed: the ids themselves need not be
    shuffled to be placed."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity)
    return pack_sequences(pieces.select(column(id_col), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "length", capacity, group_pieces)
