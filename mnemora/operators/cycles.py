"""Cyclic components of the supersession graph.

Links that no cycle can use are trimmed. What is left goes to one task where it is small (a checked number
of links), as linear time beats any number of jobs. A larger core is worked on over the cluster, in steps whose rounds
grow with logarithms:

1. *Chains and rings.* In each round ends of chains are trimmed and a third of the links' inner nodes, those with one link in and
   one out and a smaller hash than both neighbours, are taken out, their two links becoming one. A ring ends as a node with a
   link to itself. Nodes taken out come back in reverse: one belongs to a component if both its neighbours are in it.
2. *Dense cores.* Every node chooses one of its links, by hash. Walks along the chosen links are doubled: 2, 4, 8, ... steps, a join
   each, with the smallest node on the way. Where walks end after as many steps as there are nodes are the cycles of the chosen links, and
   each is contracted into its smallest node. Where walks are short there are many such cycles; where they are long, their
   doubled steps are links that jump far.
3. *Colours.* When contraction stops paying, every node is a pivot: it is coloured by the first node, in an order by hash, that
   reaches it, along links and jumps; the nodes of a colour that reach its pivot are a component. Jumps make reach take about as many
   rounds as the logarithm of the distance, and the order by hash splits rows of components as random pivots do.

Rounds end in checkpoints, those of the second and third step in tables (a checkpoint carries the constraints of all plans before it, which
grow where a plan joins itself), and every loop runs to a fixpoint, so results do not depend on how far jumps reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import ensure_checkpoint_dir, scope, written

#: Links that one task takes to finish; more are shrunk, and coloured, in rounds over the cluster.
ONE_TASK_LINKS = 1_000_000
TRIMS = 2
#: Links that are coloured without contraction or jumps, as reach takes no more hops than links.
FEW_LINKS = 32
#: Shrinking goes on while a round leaves at most this share of the links.
SHRINKS = 0.9


def strong_components(links: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of more than one node, in linear time: nodes in order of finishing,
    then reachability over reversed links from the last to finish."""
    out: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    finished, seen = [], set()
    for start in sorted(out):
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(out[start]))]
        while walk:
            node, following = walk[-1]
            fresh = next((x for x in following if x not in seen), None)
            if fresh is None:
                finished.append(node)
                walk.pop()
            else:
                seen.add(fresh)
                walk.append((fresh, iter(out.get(fresh, ()))))
    found, taken = [], set()
    for root in reversed(finished):
        if root in taken:
            continue
        taken.add(root)
        group, reach = [root], [root]
        while reach:
            for x in back.get(reach.pop(), ()):
                if x not in taken:
                    taken.add(x)
                    group.append(x)
                    reach.append(x)
        if len(group) > 1:
            found.append(sorted(group))
    return found


def _trimmed(links: DataFrame) -> DataFrame:
    """Without links that no cycle can use: nothing leads to their source, or on from their target."""
    fed = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return fed.join(fed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for b in batches for p in zip(b["src"], b["dst"], strict=True)]
        rows = [(m, g[0]) for g in strong_components(pairs) for m in g]
        yield pd.DataFrame(rows, columns=["id", "cycle"])

    return links.coalesce(1).mapInPandas(run, "id string, cycle string")


def _spread(links: DataFrame, labels: DataFrame, within: bool) -> DataFrame:
    """The smallest label that reaches each node along links, to a fixpoint; within: only from nodes of
    the same colour. A round is a join and an aggregation, and ends in a table."""
    keys = ["id", "colour"] if within else ["id"]
    while True:
        own = labels.select(*keys, "label", F.lit(True).alias("own"))
        sent = own.where("label is not null").select(F.col("id").alias("src"), *keys[1:], "label")
        arriving = links.join(sent, "src").select(F.col("dst").alias("id"), *keys[1:], "label", F.lit(False).alias("own"))
        least = own.unionByName(arriving).groupBy(*keys).agg(F.min("label").alias("label"), F.min(F.when(F.col("own"), F.col("label"))).alias("before"), F.bool_or("own").alias("own"))
        after = written(least.where("own").select(*keys, "label", (~F.col("label").eqNullSafe(F.col("before"))).alias("moved")))
        if after.where("moved").isEmpty():
            return after.drop("moved")
        labels = after


def _coloured(links: DataFrame, jumps: DataFrame) -> DataFrame:
    """(id, cycle), in rounds: colour every node by the first node that reaches it; the nodes of a colour that reach its
    first node are its component. They leave, and the rest, trimmed, starts anew. jumps: links that stand for paths."""
    found = None
    while not links.isEmpty():
        nodes = written(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        both = links.unionByName(jumps).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
        both = written(both.where("src <> dst").select("src", "dst").distinct())
        colours = _spread(both, nodes.withColumn("label", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))), False).select("id", F.col("label").alias("colour"))
        back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        marked = _spread(back, colours.withColumn("label", F.when(F.col("id") == F.col("colour.id"), F.col("colour"))), True)
        part = written(marked.where("label = colour").select("id", F.col("colour.id").alias("cycle")))
        found = part if found is None else found.unionByName(part)
        gone = part.select("id")
        rest = links.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        links = written(_trimmed(rest))
    return found


def _walks(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst) jumps of 2, 4, 8, ... steps along one chosen link of each node, and (id, into) of the nodes on cycles of chosen
    links, into being a cycle's smallest node. There are as many jumps as nodes times the logarithm of their number."""
    step = written(links.groupBy("src").agg(F.min_by("dst", F.xxhash64(F.lit(turn), "src", "dst")).alias("dst")).withColumn("low", F.least("src", "dst")))
    count, length, jumps = step.count(), 1, step.where("false").select("src", "dst")
    while length < count:
        further = step.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("low").alias("end_low"))
        step = written(step.join(further, "dst").select("src", F.col("end").alias("dst"), F.least("low", "end_low").alias("low")))
        jumps, length = jumps.unionByName(step.select("src", "dst")), 2 * length
    ends = step.select(F.col("dst").alias("src")).distinct()
    return jumps, written(step.join(ends, "src").select(F.col("src").alias("id"), F.col("low").alias("into")))


def _renamed(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """links between contracted cycles."""
    moved = cycles.where("id <> into")
    for end in ("src", "dst"):
        links = links.join(moved.select(F.col("id").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
    return links.where("src <> dst").select("src", "dst").distinct()


def _contracted(links: DataFrame, enough: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Smaller links, jumps over them, and the cycles contracted by round."""
    merged, turn, n, jumps = [], 0, links.count(), links.where("false")
    while n > max(enough, FEW_LINKS):
        jumps, cycles = _walks(links, turn)
        links = written(_trimmed(_renamed(links, cycles)))
        jumps = written(_renamed(jumps, cycles))
        merged.append(cycles)
        turn, before, n = turn + 1, n, links.count()
        if n > SHRINKS * before:
            break
    return links, jumps, merged


def _inner(links: DataFrame, turn: int) -> DataFrame:
    """(id, before, after) of nodes with one link in and one out whose hash, another in each turn, is smaller than that
    of both neighbours; no two of them are neighbours."""
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("before")).where("n = 1").drop("n")
    onto = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("after")).where("n = 1").drop("n")
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c))
    return into.join(onto, "id").where((rank("id") < rank("before")) & (rank("id") < rank("after")))


def _shrunk(links: DataFrame, enough: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Smaller links with the same cycles, the nodes taken out by round, and nodes whose ring shrank to themselves."""
    taken, rings, turn, n = [], [], 0, links.count()
    while n > enough:
        out = written(_inner(links, turn))
        gone = out.select(F.col("id").alias("src"))
        kept = links.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        joined = out.select(F.col("before").alias("src"), F.col("after").alias("dst"))
        rings.append(joined.where("src = dst").select(F.col("src").alias("id")).distinct())
        links = written(_trimmed(kept.unionByName(joined.where("src <> dst")).distinct()))
        taken.append(out)
        turn, before, n = turn + 1, n, links.count()
        if n > SHRINKS * before:
            break
    return links, taken, rings


def _in_rounds(links: DataFrame, one_task_links: int) -> DataFrame:
    links, taken, rings = _shrunk(links, one_task_links)
    links, jumps, merged = _contracted(links, one_task_links)
    few = links.limit(one_task_links + 1).count() <= one_task_links
    found = _in_one_task(links) if few else _coloured(links, jumps)
    labels = found if found is not None else links.select(F.col("src").alias("id"), F.col("src").alias("cycle")).where("false")
    if not few:
        sizes = labels.groupBy("cycle").count().where("count > 1").select("cycle")
        labels = labels.join(sizes, "cycle", "left_semi").select("id", "cycle")
    labels = written(labels)
    for cycles in reversed(merged):
        # a contracted cycle that is in no larger component is one of its own
        alone = cycles.select(F.col("into").alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("cycle"))
        whole = labels.unionByName(alone)
        inside = cycles.where("id <> into").join(whole.withColumnRenamed("id", "into"), "into").select("id", "cycle")
        labels = written(whole.unionByName(inside))
    for out, ring in zip(reversed(taken), reversed(rings), strict=True):
        # a ring that shrank to a node is a component of its own, unless the node is in one
        labels = labels.unionByName(ring.join(labels, "id", "left_anti").select("id", F.col("id").alias("cycle")))
        before, after = (labels.select(F.col("id").alias(c), F.col("cycle").alias(f"{c}_cycle")) for c in ("before", "after"))
        back = out.join(before, "before").join(after, "after").where("before_cycle = after_cycle").select("id", F.col("before_cycle").alias("cycle"))
        labels = written(labels.unionByName(back))
    least = labels.groupBy("cycle").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return labels.join(least, "cycle").select("id", F.col("least").alias("cycle"))


def ensure_checkpoints(df: DataFrame) -> None:
    ensure_checkpoint_dir(df.sparkSession)


def supersession_cycles(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, cycle) for each member of a component of more than one node; cycle is its smallest member.
    links: (src, dst), superseder and superseded, both existing and different. Both ways of finishing, in one task or in
    rounds, give the same rows."""
    ensure_checkpoints(links)
    with scope(links.sparkSession) as tables:
        core = links.select("src", "dst").distinct()
        for _ in range(TRIMS):
            core = _trimmed(core)
        core = written(core)
        few = core.limit(one_task_links + 1).count() <= one_task_links
        return tables.keep(_in_one_task(core) if few else _in_rounds(core, one_task_links))
