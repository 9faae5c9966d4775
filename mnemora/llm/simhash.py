"""SimHash near-duplicates: fingerprints, BK-tree search in shards, connected components.

*Fingerprints* (one Arrow map over whole texts): ASCII upper case is lowered, words are runs outside
``[\\x20\\x09-\\x0D]``, features are word 3-grams with repeats (all words if there are fewer than
three), each hashed by XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in over half of
the hashes. A text without words has fingerprint zero, linked like any other.

*Links.* Distinct fingerprints, each with the smallest document id that has it, are dealt into
shards. Fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks, so
each goes to the six shards named by a pair of blocks and their values. Shards with many members are
dealt again by pairs of four 8-bit blocks of the other 32 bits, by the same argument; two members of
such a shard differ in 16 bits only, so it holds 65,536 fingerprints at the very most. Both rules are
exact: no partner is lost and no shard is cut. In each shard a BK-tree is grown: the children of a
node are keyed by their Hamming distance to it, and a search with radius r follows the edges whose
key is within r of its own distance to the node. A search gives spanning links only (a union-find
forest), never all pairs of a group.

The trees are grown where their shard lies instead of being broadcast. A broadcast passes the driver, and all
trees together hold the fingerprints of all documents six times: 222 bytes a node as grown here, so 1.3 GB a
million fingerprints (96 MB a million packed at 16 bytes a node), without a bound as the corpus grows.

*Components* come from `connected_components`. A group of identical texts is one fingerprint, so its
size matters only to the last join, which adaptive execution splits.

Defined results: null text = empty text; rows with a null id are fingerprinted but link nothing (they
get the component of their fingerprint, null if no row with an id has it); rows that share an id are
one node; rows that repeat are fingerprinted each; a text may be as long as a row can hold; an empty table
gives an empty result; other columns are ignored.

This is the operator at a radius of two bits. `similar` has its form for a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import column, map_slices, whole_text, written
from .components import connected_components

RADIUS = 2
#: Members from which a shard is dealt again by the bits that its members may differ in; the links are the same
#: whether it is or not.
HOT_SHARD = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        features = [b" ".join(words)]
    else:
        features = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.array([xxh64_intdigest(x, 42) for x in features], dtype=">u8")
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed 64-bit number."""

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.array([fingerprint(x) for x in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values, pa.int64())], ["id", "fp"])

    return map_slices(docs.select(column(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")), "text", make, "id long, fp long")


class BKTree:
    """A tree over integers by Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        node = (value, {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            distance = (at[0] ^ value).bit_count()
            if distance == 0:
                return
            child = at[1].get(distance)
            if child is None:
                at[1][distance] = node
                return
            at = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            stack += [child for key, child in children.items() if distance - radius <= key <= distance + radius]


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.root(x)) != x]


#: Spanning links that a task holds before it sends them on.
FOREST_NODES = 500_000
MASK = (1 << 64) - 1


def _link_shards(radius: int):
    """Streams rows sorted by shard; memory holds one shard and a bounded forest."""

    def link(members: list[tuple[int, int]], forest: Forest) -> None:
        tree, node_of = BKTree(), {}
        for fp, node in members:
            fp &= MASK
            for other in tree.within(fp, radius):
                forest.join(node, node_of[other])
            tree.add(fp)
            node_of[fp] = node

    def out(forest: Forest) -> pa.RecordBatch:
        edges = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, shard, members = Forest(), None, []
        for batch in batches:
            for key, fp, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != shard:
                    if len(members) > 1:
                        link(members, forest)
                    shard, members = key, []
                    if len(forest.parent) > FOREST_NODES:
                        yield out(forest)
                        forest = Forest()
                members.append((fp, node))
        if len(members) > 1:
            link(members, forest)
        yield out(forest)

    return run


def _block(fp: Column, index: int, bits: int, low: int) -> Column:
    return F.shiftrightunsigned(fp, low + index * bits).bitwiseAND((1 << bits) - 1)


def _shards(fp: Column) -> Column:
    """The six shard numbers of a fingerprint: a pair of its four 16-bit blocks each."""
    pairs = list(combinations(range(4), 2))
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(_block(fp, i, 16, 0), 16)).bitwiseOR(_block(fp, j, 16, 0)) for k, (i, j) in enumerate(pairs)])


def _subshards(fp: Column, shard: Column) -> Column:
    """The six parts of a hot shard: pairs of 8-bit blocks of the 32 bits that its name leaves open."""
    pairs = list(combinations(range(4), 2))
    rest = F.lit(None).cast("long")
    for k, (i, j) in enumerate(pairs):
        a, b = (x for x in range(4) if x not in (i, j))
        open_bits = F.shiftleft(_block(fp, a, 16, 0), 16).bitwiseOR(_block(fp, b, 16, 0))
        rest = F.when(F.shiftright(shard, 32) == k, open_bits).otherwise(rest)
    return F.array(*[F.lit((k + 1) << 16).bitwiseOR(F.shiftleft(_block(rest, i, 8, 0), 8)).bitwiseOR(_block(rest, j, 8, 0)) for k, (i, j) in enumerate(pairs)])


def near_links(nodes: DataFrame, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Spanning links (src, dst) between the nodes of (fp, node) rows, fingerprints distinct, that
    differ in at most RADIUS bits."""
    dealt = nodes.select("fp", "node", F.explode(_shards(F.col("fp"))).alias("shard"))
    sizes = dealt.groupBy("shard").count()
    kept = dealt.join(sizes.where(F.col("count") > 1), "shard").select(
        "shard", "fp", "node", F.explode(F.when(F.col("count") > hot_shard, _subshards(F.col("fp"), F.col("shard"))).otherwise(F.array(F.lit(0).cast("long")))).alias("part")
    )
    key = F.xxhash64("shard", "part")
    keyed = kept.select(F.struct("shard", "part").alias("key"), "fp", "node", key.alias("spread"))
    packed = keyed.repartition("spread").sortWithinPartitions("key.shard", "key.part", "fp").select(F.concat_ws(":", "key.shard", "key.part").alias("key"), "fp", "node")
    return packed.mapInArrow(_link_shards(RADIUS), "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_shard: int = HOT_SHARD) -> DataFrame:
    """One row per row of docs: <id_col>, fingerprint (16 lower-case hex digits), component_id."""
    prints = written(fingerprints(docs, id_col, text_col))
    nodes = written(prints.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("node")))
    component = connected_components(written(near_links(nodes, hot_shard)))
    labels = nodes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
