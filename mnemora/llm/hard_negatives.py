"""Hard negatives by a two-dimensional block matrix multiply over integer vectors.

Anchors are scored against all rows, as a grid of tiles, in the manner of SUMMA:

1. *Quantised rows.* Components become floor(256 * x) as 64-bit integers in the JVM. Rows without an id, a label or a
   vector, and rows with a component that is null or not finite, take no part.
2. *Shards.* Anchors go into blocks of about `ANCHORS`, all rows into blocks of about `ROWS`, and each block is cut into
   chunks of `DIMENSIONS` components. Blocks are written once, so a row's place in its block is settled.
3. *Partial tiles.* A chunk of an anchor block goes to all row blocks and a chunk of a row block to all anchor blocks; the two
   meet in a join by (anchor block, row block, chunk), one product of two small matrices each. No row meets another
   by itself: pairs exist only as cells of a tile.
4. *Shuffle-add.* Partial tiles of the same place are added as 64-bit integers, one after another, so that a task holds
   two tiles however many chunks there are. They travel in the narrowest integers that hold them. Sums are written once.
5. *Tile top k.* Each tile gives the best rows of every anchor's own label, runs of tiles of one anchor block together,
   and a window with a group limit reduces them to the anchor's positives.
6. *Windows.* The positives of an anchor block meet its tiles again, in groups of `GROUP` row blocks. In each tile an
   anchor's rows of other labels are sorted once, by score and id; an (anchor, positive) window is then a slice of that
   order, found by bisection. The best of each window are reduced the same way.

Memory: two tiles of ANCHORS x ROWS 64-bit integers and a block's positives per task. Nothing is collected or broadcast by
hint; the driver learns the numbers of rows and anchors.

Defined results: of rows that repeat, each counts for itself, as an anchor, positive and negative; other rows are rows of
another id; ties go by the smaller id (of equal ids and scores, it does not matter which); a shorter vector ends in zeros; an
anchor without a positive, or a positive without a negative in its window, gives no rows; an empty table gives an empty
result; other columns are ignored, whatever their names. Scores beyond 2^56 stop the query with an error, as scores
and the window's bounds are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import column, scope, written

ANCHORS, ROWS, DIMENSIONS, GROUP = 256, 4096, 32, 16
TOP_POSITIVES, TOP_NEGATIVES = 5, 5
#: Scores are below this, so that 100 times a score is a 64-bit integer.
LARGEST = 1 << 56


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, q) of rows that take part; q is an array of 64-bit integers."""
    vector = column(vector_col)
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fits = F.forall(scaled, lambda x: F.abs(x) < float(LARGEST))
    q = F.when(fits, F.transform(scaled, lambda x: x.cast("long"))).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")))
    known = column(id_col).isNotNull() & column(label_col).isNotNull() & vector.isNotNull()
    return embeddings.where(known & finite).select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), q.alias("q"))


_BLOCKS = "block long, chunk int, n int, width int, ids binary, labels binary, data binary"


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers in the fewest bytes of 2, 4 or 8 that hold them, compressed by planes of bytes; the first byte names
    the number."""
    high = int(np.abs(values).max(initial=0))
    size = 2 if high < 1 << 15 else 4 if high < 1 << 31 else 8
    planes = np.ascontiguousarray(values.astype(f"<i{size}").reshape(-1).view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[1:], count * data[0], "zstd", asbytes=True), np.uint8).reshape(data[0], count)
    return np.ascontiguousarray(planes.T).view(f"<i{data[0]}").reshape(-1).astype(np.int64)


def _blocks(rows: DataFrame, size: int, dimensions: int) -> tuple[DataFrame, int]:
    """Blocks of rows, a row per chunk, and how many blocks there are. Parts are even, so blocks are nearly full."""
    count = rows.count()
    parts = max(1, -(-count // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, labels, vectors = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            labels += batch.column("label").to_pylist()
            vectors += [np.asarray(v.values) for v in batch.column("q")]
        if not ids:
            return
        matrix = np.zeros((len(ids), max(1, max(map(len, vectors)))), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        for chunk, at in enumerate(range(0, matrix.shape[1], dimensions)):
            part = matrix[:, at : at + dimensions]
            made = (TaskContext.get().partitionId(), chunk, len(ids), part.shape[1], np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), _packed(part))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "chunk", "n", "width", "ids", "labels", "data"])

    return written(rows.repartition(parts).mapInArrow(run, _BLOCKS)), parts


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles where no sum can pass 2^53, else in 64-bit integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound >= LARGEST:
        raise OverflowError("a score may pass 2^56")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 1 << 53 else a @ b.T


_TILES = "anchor_block long, row_block long, chunk int, anchors int, rows int, anchor_ids binary, anchor_labels binary, ids binary, labels binary, tile binary"
_NAMES = [f.split()[0] for f in _TILES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _row(values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            a, b = (_unpacked(r[d], r[n] * r[w]).reshape(r[n], r[w]) for d, n, w in (("a_data", "a_n", "a_width"), ("b_data", "b_n", "b_width")))
            width = min(a.shape[1], b.shape[1])
            first = r["chunk"] == 0  # ids and labels travel once
            names = (r["a_ids"], r["a_labels"], r["b_ids"], r["b_labels"]) if first else (None,) * 4
            yield _row([r["anchor_block"], r["row_block"], r["chunk"], r["a_n"], r["b_n"], *names, _packed(_product(a[:, :width], b[:, :width]))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place and chunk."""
    held, total = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            r = [batch.column(k)[i].as_py() for k in range(len(_NAMES))]
            part = _unpacked(r[-1], r[3] * r[4])
            if held is not None and held[:2] == r[:2]:
                total += part
                if int(np.abs(total).max(initial=0)) >= LARGEST:
                    raise OverflowError("a score passes 2^56")
                continue
            if held is not None:
                yield _row([*held[:-1], _packed(total)])
            held, total = r, part
    if held is not None:
        yield _row([*held[:-1], _packed(total)])


def score_tiles(rows: DataFrame, anchors: DataFrame, dimensions: int = DIMENSIONS, block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """The summed tiles of anchors against rows, both as `quantised` gives them, each with the ids and labels of its sides."""
    a, a_blocks = _blocks(anchors, block[0], dimensions)
    b, b_blocks = _blocks(rows, block[1], dimensions)
    fields = ("n", "width", "ids", "labels", "data")
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = a.select(F.col("block").alias("anchor_block"), "chunk", *(F.col(f).alias(f"a_{f}") for f in fields), to_all(b_blocks).alias("row_block"))
    right = b.select(F.col("block").alias("row_block"), "chunk", *(F.col(f).alias(f"b_{f}") for f in fields), to_all(a_blocks).alias("anchor_block"))
    # a chunk that only one side has multiplies zeros
    parts = left.join(right, ["anchor_block", "row_block", "chunk"]).mapInArrow(_multiplied, _TILES)
    place = ["anchor_block", "row_block"]
    dealt = parts.withColumn("group", F.floor(F.col("row_block") / GROUP)).repartition("anchor_block", "group").sortWithinPartitions(*place, "chunk")
    return written(dealt.select(*_NAMES).mapInArrow(_added, _TILES))


def _tile(r: dict) -> tuple[np.ndarray, ...]:
    scores = _unpacked(r["tile"], r["anchors"] * r["rows"]).reshape(r["anchors"], r["rows"])
    return scores, *(np.frombuffer(r[n], "<i8") for n in ("anchor_ids", "anchor_labels", "ids", "labels"))


def _best(k: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first k of (scores, ids) by descending score and ascending id."""
    scores, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, ids = None, [], None

        def out() -> pa.RecordBatch:
            rows = [(block, at, ids[at].item(), s, i) for at, (scores, of) in enumerate(best) for s, i in zip(scores.tolist(), of.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["anchor_block", "place", "anchor_id", "score", "id"])

        for batch in batches:
            for j in range(batch.num_rows):
                r = {name: batch.column(name)[j].as_py() for name in batch.schema.names}
                scores, anchor_ids, anchor_labels, row_ids, labels = _tile(r)
                if r["anchor_block"] != block:
                    if block is not None:
                        yield out()
                    block, best, ids = r["anchor_block"], [_NONE] * len(anchor_ids), anchor_ids
                for at in range(len(anchor_ids)):
                    same = np.flatnonzero((labels == anchor_labels[at]) & (row_ids != anchor_ids[at]))
                    best[at] = _best(k, best[at], (scores[at, same], row_ids[same]))
        if block is not None:
            yield out()

    return run


def _in_windows(k: int, lowest: int):
    """Rows carry a tile and the positives of its anchors: places, ranks and scores, sorted by nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, best = None, [], []

        def out() -> pa.RecordBatch:
            rows = [(block, w["place"], w["rank"], w["anchor_id"], w["id"], w["score"], s, i) for w, (scores, of) in zip(windows, best, strict=True) for s, i in zip(scores.tolist(), of.tolist(), strict=True)]
            names = ["anchor_block", "place", "positive_rank", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(8)], names)

        for batch in batches:
            for j in range(batch.num_rows):
                r = {name: batch.column(name)[j].as_py() for name in batch.schema.names}
                scores, _, anchor_labels, row_ids, labels = _tile(r)
                if r["anchor_block"] != block:
                    if block is not None:
                        yield out()
                    block, windows = r["anchor_block"], sorted(r["positives"], key=lambda w: (w["place"], w["rank"]))
                    best = [_NONE] * len(windows)
                at = None
                for n, w in enumerate(windows):
                    if w["place"] != at:
                        at = w["place"]
                        other = np.flatnonzero(labels != anchor_labels[at])
                        order = other[np.lexsort((row_ids[other], -scores[at, other]))]
                        down, of = scores[at, order], row_ids[order]
                    first = np.searchsorted(-down, -w["score"])
                    s, i = down[first : first + k], of[first : first + k]
                    inside = 100 * s >= lowest * w["score"]
                    if inside.any():
                        best[n] = _best(k, best[n], (s[inside], i[inside]))
        if block is not None:
            yield out()

    return run


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = TOP_POSITIVES, negatives: int = TOP_NEGATIVES, lowest: int = 80, dimensions: int = DIMENSIONS, block: tuple[int, int] = (ANCHORS, ROWS)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels that score at least `lowest` percent
    of the positive's score, and no more than it. rows and anchors are as `quantised` gives them."""
    tiles = score_tiles(rows, anchors, dimensions, block)
    of = Window.partitionBy("anchor_block", "place").orderBy(F.desc("score"), "id")
    best = tiles.mapInArrow(_top(positives), "anchor_block long, place long, anchor_id long, score long, id long").withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= positives)
    held = best.groupBy("anchor_block").agg(F.collect_list(F.struct("place", F.col("rank").cast("long").alias("rank"), "anchor_id", "id", "score")).alias("positives"))  # a block's: ANCHORS * positives
    groups = tiles.select("anchor_block", F.floor(F.col("row_block") / GROUP).alias("group")).distinct()
    met = tiles.withColumn("group", F.floor(F.col("row_block") / GROUP)).join(held.join(groups, "anchor_block"), ["anchor_block", "group"])
    made = met.select(*_NAMES, "positives").mapInArrow(
        _in_windows(negatives, lowest), "anchor_block long, place long, positive_rank long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long"
    )
    within = Window.partitionBy("anchor_block", "place", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    ranked = made.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100) -> DataFrame:
    """hard_negatives with the rows whose id is divisible by `every` as anchors."""
    with scope(embeddings.sparkSession) as tables:
        rows = written(quantised(embeddings, id_col, vector_col, label_col))
        return tables.keep(hard_negatives(rows, rows.where(F.col("id") % every == 0)))
