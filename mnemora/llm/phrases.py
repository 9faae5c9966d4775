"""Phrase collocations from compressed position bitmaps, as SPAM mines sequences.

*Shards.* An Arrow map deals the words of whole texts into shards of one language and about `SHARD` positions. Words
of a piece have consecutive positions and a position without a word ends each piece, so that nothing extends from one piece
into the next. A word's bitmap is compressed: of its blocks of eight positions, only those that are not empty are
kept, as a block number and a byte. A shard is a row of a table in the shared folder: its words, how often each
occurs, and their bitmaps.

*Words.* Their counts are summed over shards. Words that occur `LEAST` times or more in a language get a number.

*Longer phrases.* The phrases of each length are found from those one word shorter, since a phrase is at most as frequent as
what is left of it without its first or its last word. In every shard the tree of frequent phrases is walked depth-first,
a slice of first words at a time: a phrase's bitmap is shifted by one position, met with the bitmaps of the words that have bits
in the same blocks (AND), and the set bits of each meeting are counted (popcount). What is in the tree already
is walked further; what is a word longer than the tree gives a row, with its count, if its last words are in the tree. Shards are walked in
bundles of `BUNDLE` words and a shard at most, language by language, so that what several of them have in common is one row. Counts are
summed over bundles in a window over the phrase, so that each bundle's row also learns whether the phrase is frequent and which number it
has, and the frequent ones go back to their bundles as the next level of the tree.

*Sieve.* Most pairs and triples of frequent words are rare, and a row each would be most of the rows. So before those are walked, each bundle
counts its pairs and triples in hash buckets, of which there are as many as a share of the corpus's words; the counts are summed part by
part over the bundles that have them, and each bundle learns which of its own buckets reach `LEAST` in all. A phrase in another bucket cannot be
frequent and gives no row (as in Park, Chen and Yu's hash filter). Counts are rounded up, so that no frequent phrase is lost, whatever else shares its bucket.

A phrase is a row (prefix, word) of numbers, so texts are shuffled only as the distinct words of shards. Its row has the counts
of all its first and last parts, from which the cuts are scored in exact decimals.

Nothing is collected or broadcast by hint; which bundle a shard is in follows from a running sum over the shards' sizes, a row per shard. A task holds a bundle, its tree (at most one phrase per
position and length) and a slice of bitmaps. A frequent phrase has one row per bundle in its window, whatever its
count; no key has more rows than there are bundles (words: shards).

Defined results: null text = empty text, null language = `und`; rows that repeat count each, ids are not looked at; a text may be as
long as a row can hold (a shard ends after the text that fills it); ties by score go by count, then by the phrase's bytes; an empty table gives an
empty result; other columns are ignored, whatever their names. Counts are below 10^18.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import column, scope, whole_text, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Positions after which a shard ends, words after which a bundle ends, bitmap blocks that a walk extends at a time.
SHARD, BUNDLE, SLICE = 1 << 21, 3 << 20, 1 << 15
#: Lengths of phrases that the sieve counts, buckets of a part of it, words of the corpus per bucket, what a bucket must sum to.
SIEVED, BUCKETS, LOAD, FULL = (2, 3), 1 << 20, 16, 200
UNKNOWN = "und"

#: Upper case is lowered, tabs are spaces, and what ends a piece is a full stop.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


class _Shard:
    """Words of one language by number, in the order of their positions; -1 ends a piece."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {b".": -1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        # full stops are no words: each stands for the end of a piece
        words = text.translate(_FOLD).replace(b".", b" . ").split()
        if not words:
            return
        number = self.numbers
        for w in set(words).difference(number):
            number[w] = len(number) - 1
        self.parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.array([-1], np.int32))
        self.size += len(words) + 1

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """Words, their counts, their bitmaps one after another."""
        at = np.concatenate(self.parts)
        place = np.flatnonzero(at >= 0)
        order = np.argsort(at[place], kind="stable")
        place, word = place[order], at[place][order]
        blocks, masks, words = _united(word.astype(np.int64), place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        return list(self.numbers)[1:], np.bincount(word, minlength=len(self.numbers) - 1), _stored(words, blocks, masks)


def _united(owner: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, mask, owner) with one entry per owner and block, of entries sorted by both."""
    if not len(owner):
        return block, mask, owner
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
    return block[first], np.bitwise_or.reduceat(mask, first), owner[first]


def _stored(words: np.ndarray, blocks: np.ndarray, masks: np.ndarray) -> bytes:
    """Bitmaps of words 0, 1, ...: the number of entries, gaps between blocks as four planes of bytes, masks."""
    gaps = np.diff(blocks, prepend=0)
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else words
    gaps[starts] = blocks[starts]
    lengths = np.bincount(words, minlength=1).astype("<u4")
    planes = np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    raw = np.array([len(lengths), len(masks)], "<u4").tobytes() + lengths.tobytes() + planes.tobytes() + masks.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loaded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, mask) as they were stored."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    lengths = np.frombuffer(raw, "<u4", n, 8).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, 4 * m, 8 + 4 * n).reshape(4, m)
    run = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)
    words, masks = np.repeat(np.arange(n, dtype=np.int32), lengths), np.frombuffer(raw, np.uint8, m, 8 + 4 * n + 4 * m)
    before = np.r_[0, run][np.cumsum(lengths) - lengths]  # what ran up to a word's first gap
    run -= np.repeat(before, lengths)
    return words, run.astype(np.int32), masks


_SHARDS = "shard long, lang string, words array<binary>, counts array<long>, bitmaps binary"


def word_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", positions: int = SHARD) -> DataFrame:
    """The shards, as a written table."""
    names = [f.split()[0] for f in _SHARDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, counts, bitmaps = held.pop(lang).row()
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first + made, lang, words, counts, bitmaps), types, strict=True)], names)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                shard = held.setdefault(lang.as_py(), _Shard())
                shard.add(text.as_py())
                if shard.size >= positions:
                    yield out(lang.as_py())
            # many languages share the room of a few shards
            while sum(s.size for s in held.values()) >= 2 * positions:
                yield out(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            if held[lang].size:
                yield out(lang)

    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, _SHARDS))


def _meet(owner: np.ndarray, block: np.ndarray, mask: np.ndarray, words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(owner, word, block, mask): the bitmaps, shifted by one position, AND those of words, where not empty. words:
    first entry of each block, word, mask, by block."""
    starts, word, bits = words
    shifted = mask.astype(np.uint16) << 1
    carried = np.flatnonzero(shifted >> 8)
    owner, block, shifted = np.r_[owner, owner[carried]], np.r_[block, block[carried] + 1], np.r_[shifted & 255, shifted[carried] >> 8].astype(np.uint8)
    some = np.flatnonzero(shifted)
    owner, block, shifted = owner[some], block[some], shifted[some]
    n = starts[block + 1] - starts[block]
    entry = np.repeat(starts[block] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    both = np.repeat(shifted, n) & bits[entry]
    hit = np.flatnonzero(both)
    side = np.repeat(np.arange(len(owner)), n)[hit]
    return owner[side], word[entry[hit]], block[side], both[hit]


def _pair(prefix: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """A number per (prefix, word), which 32 bits do not hold from 46,341 words on."""
    return prefix.astype(np.int64) * words + word


def _bucket(words: list[np.ndarray], buckets: int) -> np.ndarray:
    """A bucket for each phrase, from the numbers of its words."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)).astype(np.int64) % buckets


class _Tree:
    """The frequent phrases of a shard, longer than a word: numbers by (prefix, word), and their suffixes."""

    def __init__(self, levels: list[list[np.ndarray]], words: np.ndarray) -> None:
        """levels: per length from 2, the columns id, prefix, word, suffix; words: numbers of the shard's frequent words, sorted."""
        self.words, self.levels, below = words, [], words
        for ids, prefix, word, suffix in levels:
            # places of prefixes and suffixes among the phrases one shorter, of words among words
            key, shorter = np.searchsorted(below, prefix) * len(words) + np.searchsorted(words, word), np.searchsorted(below, suffix)
            order, below = np.argsort(key), np.sort(ids)
            self.levels.append((key[order], ids[order], shorter[order], below))

    def find(self, level: int, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where among the level's phrases, by number, (prefix, word) is; -1 if nowhere. Both are places."""
        keys, ids, _, below = self.levels[level]
        if not len(keys):
            return np.full(len(prefix), -1, np.int64)
        key = _pair(prefix, word, len(self.words))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, np.searchsorted(below, ids[at]), -1)

    def suffixes(self, level: int) -> np.ndarray:
        """Places of suffixes, by place of phrases."""
        _, ids, suffix, below = self.levels[level]
        out = np.empty(len(below), np.int64)
        out[np.searchsorted(below, ids)] = suffix
        return out


    def words_of(self, level: int) -> list[np.ndarray]:
        """The numbers of their words, by place of phrases with `level` words more than one."""
        if not level:
            return [self.words]
        keys, ids, _, below = self.levels[level - 1]
        key = np.empty(len(below), np.int64)
        key[np.searchsorted(below, ids)] = keys
        return [*(w[key // len(self.words)] for w in self.words_of(level - 1)), self.words[key % len(self.words)]]


def _extended(tree: _Tree, entries: tuple[np.ndarray, ...], size: int, sieve: tuple[np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(prefix, word, suffix, count) of phrases a word longer than the tree, as numbers; entries: word, block and
    mask of the shard's frequent words, by place, sorted by word and block. With a sieve (full buckets, number of all) only those in full buckets."""
    word, block, mask = entries
    order = np.argsort(block, kind="stable")
    words = (np.searchsorted(block[order], np.arange(size + 2)), word[order], mask[order])
    depth = len(tree.levels)
    shorter = tree.suffixes(depth - 1) if depth else None
    spelt = tree.words_of(depth) if sieve else None
    # a slice holds whole words; the rest of the walk is depth-first
    cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True]) if len(word) else np.array([0])
    at = 0
    stack = []
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE, "right")) - 1)
        stack.append((0, word[cuts[at] : cuts[to]], block[cuts[at] : cuts[to]], mask[cuts[at] : cuts[to]]))
        at = to
        while stack:
            level, *phrase = stack.pop()
            prefix, follower, met, bits = _meet(*phrase, words)
            if level < depth:
                place = tree.find(level, prefix, follower)
                known = np.flatnonzero(place >= 0)
                known = known[np.lexsort((met[known], place[known]))]
                if len(known):
                    stack.append((level + 1, place[known], met[known], bits[known]))
                continue
            if depth:  # what is left without the first word must be in the tree
                suffix = tree.find(depth - 1, shorter[prefix], follower)
                known = np.flatnonzero(suffix >= 0)
                prefix, follower, bits, suffix = prefix[known], follower[known], bits[known], suffix[known]
                names = tree.levels[-1][3]
            else:
                suffix, names = follower, tree.words
            key = _pair(prefix, follower, len(tree.words))
            order = np.argsort(key, kind="stable")
            key = key[order]
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first)
            one = order[first]
            if sieve:
                full, buckets = sieve
                bucket = _bucket([*(w[prefix[one]] for w in spelt), tree.words[follower[one]]], buckets)
                kept = full[np.minimum(np.searchsorted(full, bucket), len(full) - 1)] == bucket
                one, count = one[kept], count[kept]
            yield names[prefix[one]], tree.words[follower[one]], names[suffix[one]], count


#: place is a bundle's number, in the upper half, and a count in it, so that rows are short.
_COUNTED = "prefix long, word long, suffix long, place long"
_PARTS = "bundle long, part long, bitmaps binary"
#: The levels of rows that hold full buckets, by part, and bitmaps: after all of the tree's.
_FULL, _BITMAPS = 98, 99


class _Bundle:
    """What the rows of a bundle hold: the tree's levels, then the bitmaps of its shards, one behind the other."""

    def __init__(self, number: int) -> None:
        self.number, self.levels, self.words, self.entries, self.end, self.full = number, {}, None, [], 0, []

    def add(self, part: pa.RecordBatch) -> None:
        """Rows by level and shard."""
        level = part.column("level").to_numpy()
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            if k == _BITMAPS:
                for i in rows.tolist():
                    self._take(part.column("shard")[i].as_py(), part.column("bitmaps")[i].as_py())
            elif k == _FULL:
                for i in rows.tolist():
                    kind, bucket, _ = _loaded(part.column("bitmaps")[i].as_py())
                    self.full.append((kind, bucket + part.column("shard")[i].as_py() * BUCKETS))
            else:
                columns = ("id", "prefix", "shard") if k == 1 else ("id", "prefix", "word", "suffix")
                self.levels.setdefault(k, []).append([part.column(c).to_numpy()[rows] for c in columns])

    def _whole(self, k: int) -> list[np.ndarray]:
        if len(self.levels[k]) > 1:
            self.levels[k] = [[np.concatenate(c) for c in zip(*self.levels[k], strict=True)]]
        return self.levels[k][0]

    def _take(self, shard: int, bitmaps: bytes) -> None:
        """The frequent words' entries, by place among their numbers; level 1 says which number a shard's own words have."""
        if 1 not in self.levels:
            return
        word, block, mask = _loaded(bitmaps)
        ids, own, of = self._whole(1)
        mine = of == shard
        if not len(word) or not mine.any():
            return
        if self.words is None:
            self.words = np.unique(ids)
        places = np.full(int(word[-1]) + 1, -1, np.int32)
        places[own[mine]] = np.searchsorted(self.words, ids[mine])
        place = places[word]
        kept = place >= 0
        self.entries.append((place[kept], block[kept] + np.int32(self.end), mask[kept]))
        self.end += int(block.max()) + 2

    def hashed(self, buckets: int, least: int) -> Iterator[pa.RecordBatch]:
        """(bundle, part, bitmaps): the buckets of phrases of each length in SIEVED, with how often they occur, as a share of `least` that is rounded up."""
        if not self.entries:
            return
        least = max(least, 1)
        blocks = [b for _, b, _ in self.entries]
        at = np.full(8 * (max(int(b.max(initial=0)) for b in blocks) + 2), -1, np.int32)
        for place, block, mask in self.entries:
            for bit in range(8):
                on = np.flatnonzero(mask & np.uint8(1 << bit))
                at[block[on].astype(np.int64) * 8 + bit] = place[on]
        self.entries.clear()
        each = []
        for kind, length in enumerate(SIEVED):
            places = [at[i : len(at) - length + 1 + i] for i in range(length)]
            starts = np.flatnonzero(np.logical_and.reduce([p >= 0 for p in places]))
            bucket, n = np.unique(_bucket([self.words[p[starts]] for p in places], buckets), return_counts=True)
            each.append((np.full(len(bucket), kind, np.int64), bucket, -(-np.minimum(n, least) * FULL // least)))
        kind, bucket, share = (np.concatenate(c) for c in zip(*each, strict=True))
        for part in np.unique(bucket // BUCKETS).tolist():
            own = np.flatnonzero(bucket // BUCKETS == part)
            data = _stored(kind[own], bucket[own] % BUCKETS, share[own].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["bundle", "part", "bitmaps"])

    def found(self, length: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """Phrases of that length. Where a shorter length has none that is frequent, this has none either."""
        if not self.entries or any(k not in self.levels for k in range(1, length)):
            return
        words = self.words
        place, block, mask = (np.concatenate(c) for c in zip(*self.entries, strict=True))
        self.entries.clear()
        order = np.argsort(place, kind="stable")
        entries = place[order], block[order], mask[order]
        tree = _Tree([self._whole(k) for k in sorted(self.levels) if k > 1], words)
        self.levels.clear()
        sieve = None
        if length in SIEVED:
            full = [bucket[kind == SIEVED.index(length)].astype(np.int64) for kind, bucket in self.full]
            sieve = np.sort(np.concatenate(full)) if full else np.empty(0, np.int64), buckets
            self.full.clear()
            if not len(sieve[0]):
                return
        for prefix, word, suffix, n in _extended(tree, entries, self.end, sieve):
            rows = [prefix, word, *([suffix] if tree.levels else []), n + (self.number << 32)]
            for i in range(0, len(n), 1 << 16):
                cut = [pa.array(x[i : i + (1 << 16)], pa.int64()) for x in rows]
                yield pa.RecordBatch.from_arrays(cut, ["prefix", "word", *(["suffix"] if tree.levels else []), "place"])


def _bundled(told: Callable[[_Bundle], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by bundle, level and shard; what is told of each bundle goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            owners = batch.column("bundle").to_numpy()
            cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1], True]).tolist() if len(owners) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if bundle is None or owners[a] != bundle.number:
                    if bundle is not None:
                        yield from told(bundle)
                    bundle = _Bundle(int(owners[a]))
                bundle.add(batch.slice(a, b - a))
        if bundle is not None:
            yield from told(bundle)
        pa.default_memory_pool().release_unused()

    return run


def _walk(length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of that length."""
    return _bundled(lambda bundle: bundle.found(length, buckets))


def _sieved(table: pa.Table) -> pa.Table:
    """A part of the sieve: of each bundle's buckets those that are full, counted over all bundles."""
    sums = np.zeros((len(SIEVED), BUCKETS), np.int64)
    for data in table.column("bitmaps"):
        kind, bucket, share = _loaded(data.as_py())
        sums[kind, bucket] += share  # a bundle has a bucket once
    kept = []
    for data in table.column("bitmaps"):
        kind, bucket, share = _loaded(data.as_py())
        full = np.flatnonzero(sums[kind, bucket] >= FULL)
        kept.append(_stored(kind[full].astype(np.int64), bucket[full].astype(np.int64), share[full]) if len(full) else None)
    some = pa.table({"bundle": table.column("bundle"), "part": table.column("part"), "bitmaps": pa.array(kept, pa.binary())})
    return some.filter(pc.is_valid(some.column("bitmaps")))


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, positions: int = SHARD, bundle: int = BUNDLE
) -> tuple[list[DataFrame], DataFrame]:
    """Per length from one word, a table of the phrases that occur `least` times: id, lang, phrase (binary), a, prefix, suffix,
    firsts and lasts (counts of the first and last 1, 2, ... words); and the words of each language, (lang, n)."""
    shards = word_shards(docs, lang_col, text_col, positions)
    sized = shards.select("shard", "lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    totals = sized.groupBy("lang").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1))
    dealt = written(sized.select("shard", "n", F.floor(F.coalesce(before, F.lit(0)) / bundle).alias("bundle")))
    buckets = BUCKETS * (1 + int((dealt.agg(F.sum("n").alias("n")).first()["n"] or 0) // (LOAD * BUCKETS)))
    dealt = dealt.drop("n")
    none, blank, zero = F.lit(None).cast("long"), F.lit(None).cast("binary").alias("bitmaps"), F.lit(0).cast("long")

    def numbered(rows: DataFrame, n: Column, *phrase: str) -> DataFrame:
        """The rows of frequent phrases, with their count a and their number id, as a table."""
        over = Window.partitionBy(*phrase)
        counted = rows.withColumn("row", F.monotonically_increasing_id()).withColumns({"a": F.sum(n).over(over), "id": F.min("row").over(over)})
        return written(counted.where(F.col("a") >= least).drop("row"))

    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("own", "x")).select("shard", "lang", F.col("own").cast("long"), F.col("x.words").alias("phrase"), F.col("x.counts").alias("n"))
    known = numbered(words, F.col("n"), "lang", "phrase")
    each = known.groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("lang", "phrase", "a")))
    phrases = [written(each.select("id", "lang", "phrase", "a", none.alias("prefix"), none.alias("suffix"), F.array("a").alias("firsts"), F.array("a").alias("lasts")))]
    tree = known.join(dealt, "shard").select("bundle", "shard", F.lit(1).alias("level"), "id", F.col("own").alias("prefix"), F.col("id").alias("word"), F.col("id").alias("suffix"), blank)
    bitmaps = shards.select("shard", "bitmaps").join(dealt, "shard").select("bundle", "shard", F.lit(_BITMAPS).alias("level"), *(zero.alias(c) for c in ("id", "prefix", "word", "suffix")), "bitmaps")
    by_bundle = lambda *rows: reduce(DataFrame.unionByName, rows).repartition("bundle").sortWithinPartitions("bundle", "level", "shard")
    hashed = by_bundle(tree, bitmaps).mapInArrow(_bundled(lambda b: b.hashed(buckets, least)), _PARTS)
    sieve = written(hashed.groupBy("part").applyInArrow(_sieved, _PARTS))
    sieve = sieve.select("bundle", F.col("part").alias("shard"), F.lit(_FULL).alias("level"), *(zero.alias(c) for c in ("id", "prefix", "word", "suffix")), "bitmaps")
    for level in range(2, longest + 1):
        # a pair's last word is its suffix
        schema = _COUNTED if level > 2 else _COUNTED.replace("suffix long, ", "")
        walked = by_bundle(tree, bitmaps, *([sieve] if level in SIEVED else [])).mapInArrow(_walk(level, buckets), schema)
        found = numbered(walked, F.col("place").bitwiseAND(0xFFFFFFFF), "prefix", "word")
        found = found.withColumns({"bundle": F.shiftright("place", 32), **({} if level > 2 else {"suffix": F.col("word")})})
        each = found.groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("prefix", "word", "suffix", "a")))
        before, after = phrases[-1].select(F.col("id").alias("prefix"), "lang", "phrase", "firsts"), phrases[-1].select(F.col("id").alias("suffix"), "lasts")
        last = phrases[0].select(F.col("id").alias("word"), F.col("phrase").alias("last"))
        joined = each.join(before, "prefix").join(after, "suffix").join(last, "word")
        phrase = F.concat("phrase", F.lit(b" "), "last").alias("phrase")
        phrases.append(written(joined.select("id", "lang", phrase, "a", "prefix", "suffix", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"))))
        tree = tree.unionByName(found.select("bundle", zero.alias("shard"), F.lit(level).alias("level"), "id", "prefix", "word", "suffix", blank))
    return phrases, totals


def _lowest_cut(length: int) -> Column:
    """(score, k, l, r) of the cut with the lowest score, ties to the smallest k, in exact decimals."""
    exact = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.get("firsts", F.lit(k - 1)), F.get("lasts", F.lit(length - k - 1))
        above = (exact(F.col("a")) * exact(F.col("n"))).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
        score = F.call_function("div", above, (exact(left) * exact(right)).cast("decimal(38,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, positions: int = SHARD, bundle: int = BUNDLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words by score, count
    and bytes, without those that a longer one of the same count contains."""
    with scope(docs.sparkSession) as tables:
        phrases, totals = frequent_phrases(docs, lang_col, text_col, least, longest, positions, bundle)
        scored = None
        for length in range(2, longest + 1):
            own = phrases[length - 1]
            if length < longest:
                # a longer phrase of the same count that contains it has a part one word longer, of the same count
                longer = phrases[length]
                inside = [longer.where(F.get(counts, F.lit(length - 1)) == F.col("a")).select(F.col(part).alias("id")) for part, counts in (("prefix", "firsts"), ("suffix", "lasts"))]
                own = own.join(inside[0].unionByName(inside[1]).distinct(), "id", "left_anti")
            rows = own.join(totals, "lang").select("lang", "phrase", "a", "n", _lowest_cut(length).alias("cut"))
            rows = rows.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
            scored = rows if scored is None else scored.unionByName(rows)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return tables.keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
