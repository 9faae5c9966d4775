"""Memory-model relations derived from the driver's tables, in Spark and as SQL.

The tables are no memory stores; these views make deterministic ones of them that reach every branch
of the checks. `SQL` holds the same definitions as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MEMORIES, SCOPE_DIMENSIONS

DIMENSIONS = SCOPE_DIMENSIONS
POLICY = [("user_id", "user-en", "user-de"), ("user_id", "user-en", "user-fr"), ("user_id", "user-es", "user-en")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(c) -> F.Column:
    return F.concat(F.lit("doc-"), F.lpad(c.cast("string"), 8, "0"))


def conversation_count(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "conversations").select("conv_id").distinct().count()


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    n = conversation_count(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    active = (F.col("quality") == 1).alias("active")

    def ref(pos: int) -> F.Column:
        turn = F.when(d % 11 != 0, ((d + pos) % 9).cast("int"))
        span = F.when((d % 4 != 0) & turn.isNotNull(), F.struct((d % 7).cast("int").alias("start"), (d % 7 + d % 400 + 1).cast("int").alias("end")))
        conv = F.concat(F.lit("conv-"), ((d + 7 * pos) % (n + n // 5)).cast("string"))
        return F.struct(conv.alias("transcript_id"), turn.alias("turn_idx"), span.alias("span"))

    refs = F.when(d % 13 == 0, F.array().cast("array<struct<transcript_id:string,turn_idx:int,span:struct<start:int,end:int>>>")).when(d % 6 == 0, F.array(ref(0), ref(1))).otherwise(F.array(ref(0)))
    place = d % 50
    cyclic = F.when(place < 2, d + 1).when(place == 2, d - 2)
    links = F.array_compact(F.array(F.when(cyclic.isNotNull(), doc_key(cyclic)).when(d % 3 == 0, doc_key(d + 1)), F.when(d % 97 == 0, F.concat(F.lit("missing-"), d.cast("string")))))
    user = F.when(d % 17 != 0, F.concat(F.lit("user-"), F.col("lang")))
    scope = lambda u: F.struct(u.alias("user_id"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("session_id")).alias("scope")
    base = docs.select(doc_key(d).alias("id"), F.col("text").alias("content"), refs.alias("source_refs"), F.when(d % 13 == 0, "unavailable").otherwise("declared").alias("provenance_status"), scope(user), active, links.alias("supersedes"))
    copied = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit(" . !"))
    other = F.when(d % 17 == 0, None).when(d % 10 == 0, F.lit("user-de")).otherwise(user)
    variants = docs.where(d % 5 == 0).select(
        F.concat(doc_key(d), F.lit("-v")).alias("id"), copied.alias("content"), F.array().cast(base.schema["source_refs"].dataType).alias("source_refs"),
        F.lit("unavailable").alias("provenance_status"), scope(other), active, F.array().cast("array<string>").alias("supersedes"),
    )
    both = base.unionByName(variants)
    for name, kind in (("created_at", "timestamp"), ("created_at_text", "string"), ("updated_at", "timestamp"), ("updated_at_text", "string"), ("embedding", "array<double>"), ("raw", "string")):
        both = both.withColumn(name, F.lit(None).cast(kind))
    return both.select(*(x.split(" ")[0] for x in MEMORIES.split(", ")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("transcript_id"), F.col("turn").cast("int").alias("turn_idx"), "role", F.col("text").alias("content"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("transcript_id").distinct()


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(POLICY)], "rule_idx int, dimension string, source_principal string, destination_principal string")


#: Every row whose id is divisible by ASKED_EVERY is a query, against all rows.
ASKED_EVERY, TOP_K = 50, 10
#: Vectors and queries of a part; how many of each are multiplied at a time; by how much a product of matrices may be off.
ROW_BLOCK, ASKED_BLOCK, TILE, ASKED_TILE, NEAR = 1 << 14, 1 << 14, 1 << 12, 1 << 10, 1e-9


def asked_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % ASKED_EVERY == 0)


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, at least `width` of them, padded with zeros; and their lengths, -1 where a
    vector or one of its components is null."""
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, held = lists.flatten(), np.maximum(lengths, 0)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    owner, ends = np.repeat(np.arange(len(held)), held), np.cumsum(held)
    matrix = np.zeros((len(held), max(width, int(held.max(initial=0)))))
    matrix[owner, np.arange(len(owner)) - np.repeat(ends - held, held)] = values
    lengths[owner[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return matrix, lengths


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, as SQL does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class _Vectors:
    def __init__(self, ids: np.ndarray, lists: pa.Array, width: int = 0) -> None:
        self.ids = ids
        self.values, self.lengths = _matrix(lists, width)
        self.norms = np.sqrt(_in_order(self.values, self.values))
        # products of matrices say nothing about vectors so long or so short
        self.odd = ~((self.norms > 1e-140) & (self.norms < 1e140))
        self.units = np.where(self.odd[:, None], 0.0, self.values / np.where(self.odd, 1.0, self.norms)[:, None])

    def __len__(self) -> int:
        return len(self.ids)

    def widened(self, width: int) -> None:
        if (more := width - self.values.shape[1]) > 0:
            self.values, self.units = (np.pad(x, ((0, 0), (0, more))) for x in (self.values, self.units))


class _Best:
    """The k nearest of a block of queries among the vectors that have passed. A product of matrices tells which may be
    among them, and the scores of these are summed in SQL's order."""

    def __init__(self, asked: _Vectors, k: int) -> None:
        self.asked, self.k, self.least = asked, k, np.full(len(asked), -np.inf)
        self.query, self.ids, self.scores, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)

    def meet(self, rows: _Vectors) -> None:
        asked = self.asked
        width = max(asked.values.shape[1], rows.values.shape[1])
        asked.widened(width)
        rows.widened(width)
        for start in range(0, len(asked), ASKED_TILE):
            part = slice(start, start + ASKED_TILE)
            near = asked.units[part] @ rows.units.T
            if (rows.lengths != asked.lengths[part][0]).any() or (asked.lengths[part] != asked.lengths[part][0]).any() or (rows.lengths < 0).any():
                near[(asked.lengths[part, None] != rows.lengths) | (rows.lengths < 0)] = -2.0  # no score: last
            own = np.flatnonzero(np.isin(rows.ids, asked.ids[part]))
            itself = asked.ids[part, None] == rows.ids[own]
            odd = rows.odd, asked.odd[part]
            near[:, odd[0]] = near[odd[1]] = -np.inf  # these may be anything
            near[:, own] = np.where(itself, -np.inf, near[:, own])
            least = self.least[part]
            if len(rows) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(near, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
            near[:, odd[0]] = near[odd[1]] = 2.0
            near[:, own] = np.where(itself, -np.inf, near[:, own])
            query, row = np.nonzero((near >= least[:, None] - NEAR) & (near > -np.inf))
            self._take(query + start, row, rows, part)

    def _take(self, query: np.ndarray, row: np.ndarray, rows: _Vectors, part: slice) -> None:
        asked = self.asked
        null = (asked.lengths[query] != rows.lengths[row]) | (rows.lengths[row] < 0)
        score = np.empty(len(query))
        with np.errstate(all="ignore"):
            for i in range(0, len(query), TILE * 16):
                q, r = query[i : i + TILE * 16], row[i : i + TILE * 16]
                score[i : i + TILE * 16] = _in_order(asked.values[q], rows.values[r]) / (asked.norms[q] * rows.norms[r])
        self._keep(query, rows.ids[row], score, null, part)

    def _keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, null: np.ndarray, part: slice) -> None:
        others = (self.query < part.start) | (self.query >= part.stop)
        old = ~others
        query, ids, scores, null = (np.concatenate([x[old], y]) for x, y in ((self.query, query), (self.ids, ids), (self.scores, scores), (self.null, null)))
        # as SQL orders: not a number is above all numbers, null below
        high = np.where(null, -1, np.isnan(scores).astype(np.int8))
        order = np.lexsort((ids, -np.where(high != 0, 0.0, scores), -high, query))
        query = query[order]
        first = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1] if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        kept = order[place < self.k]
        query = query[place < self.k]
        full = order[place == self.k - 1]
        value = np.where(high[full] == 0, scores[full], np.where(high[full] > 0, 2.0, -2.0))
        self.least[query[place[place < self.k] == self.k - 1]] = value
        self.query, self.ids, self.scores, self.null = (np.concatenate([x[others], y]) for x, y in ((self.query, query), (self.ids, ids[kept]), (self.scores, scores[kept]), (self.null, null[kept])))

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.query), 1 << 16):
            cut = slice(i, i + (1 << 16))
            score = pa.array(self.scores[cut], pa.float64(), mask=self.null[cut])
            yield pa.RecordBatch.from_arrays([pa.array(self.asked.ids[self.query[cut]]), pa.array(self.ids[cut]), score], ["q", "vec_id", "score"])


def _nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by part, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best, passing = None, [], None, []

        def meet() -> None:
            nonlocal best
            if best is None:
                table = pa.Table.from_batches(asked)
                best = _Best(_Vectors(table.column("id").to_numpy(), table.column("v").combine_chunks()), k)
                asked.clear()
            table = pa.Table.from_batches(passing)
            passing.clear()
            best.meet(_Vectors(table.column("id").to_numpy(), table.column("v").combine_chunks()))

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("row", "column", "kind")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1), True]).tolist() if len(at) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (part := tuple(at[a, :2])) != key:
                    if passing and (asked or best):
                        meet()
                    if best is not None:
                        yield from best.found()
                    key, asked, best, passing = part, [], None, []
                (passing if at[a, 2] else asked).append(batch.slice(a, b - a))
                if sum(x.num_rows for x in passing) >= TILE and (asked or best):
                    meet()
        if passing and (asked or best):
            meet()
        if best is not None:
            yield from best.found()
        pa.default_memory_pool().release_unused()

    return run


def top_k(vectors: DataFrame, asked: DataFrame, k: int, row_block: int = ROW_BLOCK, asked_block: int = ASKED_BLOCK) -> DataFrame:
    """(q, vec_id, rank, score): for each asked vector its k nearest others by cosine. Vectors and queries are
    dealt into blocks each, and a pair of blocks is one part: neither side is broadcast, a part holds a block of queries and their k
    best, and the vectors stream past. The best of the parts are merged. A vector is sent once for each block of queries."""
    known = [df.where("vec_id is not null") for df in (vectors, asked)]
    rows, columns = (-(-df.count() // n) or 1 for df, n in zip(known, (row_block, asked_block), strict=True))
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    given = [F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")]
    met = known[1].select(number(columns).alias("column"), every(rows).alias("row"), F.lit(0).alias("kind"), *given)
    met = met.unionByName(known[0].select(number(rows).alias("row"), every(columns).alias("column"), F.lit(1).alias("kind"), *given))
    dealt = met.repartition(rows * columns, "row", "column").sortWithinPartitions("row", "column", "kind")
    best = dealt.mapInArrow(_nearest(k), "q long, vec_id long, score double")
    whole = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("q", "vec_id", "rank", "score")


def expected_vectors(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, other): the vectors with the next two ids."""
    nexts = asked.select(F.col("vec_id").alias("q"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("vec_id"))
    return nexts.join(vectors.select("vec_id"), "vec_id", "left_semi").select("q", F.col("vec_id").alias("other"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded retrievals. Of three asked vectors in a row, by id, the first expects the next two ids and its nearest vector, the second its two
    nearest, the third the next two ids, so that retrieval meets some, all, or usually none of what is expected."""
    v = _table(spark, sf_dir, "embeddings")
    asked = asked_vectors(v)
    name = lambda c: F.concat(F.lit("vec-"), c.cast("string"))
    hits = top_k(v, asked, TOP_K).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", name(F.col("vec_id")).alias("memory_id"), "score"))).alias("h"))
    nexts = expected_vectors(v, asked).groupBy("q").agg(F.collect_list(name(F.col("other"))).alias("e"))
    nearest = lambda n: F.transform(F.slice("h", 1, n), lambda h: h["memory_id"])
    third, others = F.floor(F.col("q") / ASKED_EVERY) % 3, F.coalesce("e", F.array().cast("array<string>"))
    expected = F.when(third == 0, F.array_union(others, nearest(1))).when(third == 1, nearest(2)).otherwise(others)
    hit = F.transform("h", lambda h: F.struct(h["memory_id"].alias("memory_id"), h["rank"].alias("rank"), h["score"].alias("score")))
    return hits.join(nexts, "q", "left").withColumn("e", expected).where(F.size("e") > 0).select(
        name(F.col("q")).alias("request_id"), F.sha2(name(F.col("q")), 256).alias("query_sha256"), F.sort_array("e").alias("expected_memory_ids"), F.lit(TOP_K).alias("top_k"),
        F.lit("cosine").alias("retriever_id"), F.lit("1").alias("retriever_version"), hit.alias("hits"), F.lit(1).cast("long").alias("retrieval_calls"), F.size("h").cast("long").alias("candidate_count"),
    )


_FOLD = r"coalesce(nullif(regexp_replace({s}, '(?: *\p{{P}})+$', ''), ''), {s})"
_SPACED = r"trim(regexp_replace(replace(lower(content), 'ß', 'ss'), '\s+', ' ', 'g'))"

SQL = {
    "n_conv": "SELECT count(DISTINCT conv_id) AS n FROM conversations",
    "turns": "SELECT 'conv-' || conv_id AS transcript_id, turn AS turn_idx, role, text AS content FROM conversations",
    "transcripts": "SELECT DISTINCT transcript_id FROM turns",
    "base": (
        "SELECT d.doc_id, 'doc-' || lpad(d.doc_id::VARCHAR, 8, '0') AS id, text AS content, CASE WHEN d.doc_id % 17 <> 0 THEN 'user-' || lang END AS user_id, quality = 1 AS active, "
        "CASE WHEN d.doc_id % 13 = 0 THEN 'unavailable' ELSE 'declared' END AS provenance_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    ),
    "memories": (
        "SELECT * FROM base UNION ALL SELECT doc_id, id || '-v', '  ' || replace(content, ' ', '  ') || ' . !', "
        "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'user-de' ELSE user_id END, active, 'unavailable' FROM base WHERE doc_id % 5 = 0"
    ),
    "refs": (
        "SELECT b.id, p.pos, 'conv-' || ((b.doc_id + 7 * p.pos) % (n + n // 5)) AS transcript_id, CASE WHEN b.doc_id % 11 <> 0 THEN (b.doc_id + p.pos) % 9 END AS turn_idx, "
        "CASE WHEN b.doc_id % 4 <> 0 AND b.doc_id % 11 <> 0 THEN b.doc_id % 7 END AS span_start, CASE WHEN b.doc_id % 4 <> 0 AND b.doc_id % 11 <> 0 THEN b.doc_id % 7 + b.doc_id % 400 + 1 END AS span_end "
        "FROM base b CROSS JOIN n_conv JOIN (VALUES (0), (1)) p(pos) ON p.pos = 0 OR b.doc_id % 6 = 0 WHERE b.doc_id % 13 <> 0"
    ),
    "links": (
        "SELECT id AS src, 'doc-' || lpad((CASE WHEN doc_id % 50 < 2 THEN doc_id + 1 WHEN doc_id % 50 = 2 THEN doc_id - 2 ELSE doc_id + 1 END)::VARCHAR, 8, '0') AS dst FROM base "
        "WHERE doc_id % 50 <= 2 OR doc_id % 3 = 0 UNION ALL SELECT id, 'missing-' || doc_id FROM base WHERE doc_id % 97 = 0"
    ),
    "spaced": f"SELECT *, {_SPACED} AS s FROM memories",
    "folded": f"SELECT *, {_FOLD.format(s='s')} AS folded FROM spaced",
    "classified": (
        "SELECT r.*, length(t.content) AS turn_length, t.role, t.content, CASE WHEN k.transcript_id IS NULL THEN 'missing_transcript' WHEN r.turn_idx IS NULL THEN 'whole' "
        "WHEN t.content IS NULL THEN 'missing_turn' WHEN r.span_end > length(t.content) THEN 'invalid_span' ELSE 'ok' END AS outcome "
        "FROM refs r LEFT JOIN transcripts k ON r.transcript_id = k.transcript_id LEFT JOIN turns t ON r.transcript_id = t.transcript_id AND r.turn_idx = t.turn_idx"
    ),
    "segments": (
        "SELECT id, pos, transcript_id, turn_idx, role, span_start, span_end, CASE WHEN span_start IS NULL THEN content ELSE substr(content, span_start + 1, span_end - span_start) END AS text "
        "FROM classified WHERE outcome = 'ok' UNION ALL SELECT c.id, c.pos, c.transcript_id, t.turn_idx, t.role, NULL, NULL, t.content FROM classified c JOIN turns t ON c.transcript_id = t.transcript_id WHERE c.outcome = 'whole'"
    ),
    "uniq": "SELECT id, transcript_id, turn_idx, role, span_start, span_end, text, min(pos) AS pos, count(*) AS copies FROM segments GROUP BY ALL",
    "composed": (
        "SELECT id, string_agg(text, chr(10) ORDER BY transcript_id, turn_idx, coalesce(span_start, -1), coalesce(span_end, -1), pos, role, text) AS premise, sum(copies)::BIGINT AS segment_count, "
        "count(*) AS unique_segment_count, '[' || string_agg('{\"role\":\"' || role || '\",\"span\":' || coalesce('[' || span_start || ',' || span_end || ']', 'null') || ',\"transcript_id\":\"' || transcript_id || "
        "'\",\"turn_idx\":' || turn_idx || '}', ',' ORDER BY transcript_id, turn_idx, coalesce(span_start, -1), coalesce(span_end, -1), pos, role, text) || ']' AS coordinates FROM uniq GROUP BY id"
    ),
    "premises": (
        "SELECT b.id, b.content, c.premise, c.segment_count, c.unique_segment_count, c.coordinates, CASE WHEN i.id IS NOT NULL THEN 'resolution_issues' WHEN c.premise IS NULL OR trim(c.premise) = '' THEN 'no_evidence' ELSE 'assess' END AS outcome "
        "FROM base b LEFT JOIN (SELECT DISTINCT id FROM classified WHERE outcome IN ('missing_transcript', 'missing_turn', 'invalid_span')) i ON b.id = i.id LEFT JOIN composed c ON b.id = c.id WHERE b.provenance_status = 'declared'"
    ),
    "resolved": "SELECT l.src, l.dst, m.active AS dst_active FROM links l JOIN memories m ON l.dst = m.id WHERE l.src <> l.dst",
    "reach(a, b)": "SELECT src, dst FROM resolved UNION SELECT r.a, l.dst FROM reach r JOIN resolved l ON r.b = l.src",
    "members": "SELECT DISTINCT r.a AS id, (SELECT min(x) FROM (SELECT r.a AS x UNION ALL SELECT b FROM reach s WHERE s.a = r.a AND EXISTS (SELECT 1 FROM reach t WHERE t.a = s.b AND t.b = r.a))) AS cycle FROM reach r WHERE r.a = r.b",
    "rules(dimension, source, destination)": "VALUES ('user_id', 'user-en', 'user-de'), ('user_id', 'user-en', 'user-fr'), ('user_id', 'user-es', 'user-en')",
    "vectors": "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings",
    "hits": (
        f"SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS q, b.vec_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score "
        f"FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND a.vec_id % {ASKED_EVERY} = 0) QUALIFY rank <= {TOP_K}"
    ),
    "expected": f"""
SELECT DISTINCT q, 'vec-' || vec_id AS memory_id, 'vec-' || q AS request_id FROM (
  SELECT a.vec_id AS q, b.vec_id FROM vectors a JOIN vectors b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2)
  WHERE a.vec_id % {ASKED_EVERY} = 0 AND a.vec_id // {ASKED_EVERY} % 3 <> 1
  UNION ALL SELECT q, vec_id FROM hits WHERE rank <= q // {ASKED_EVERY} % 3 + 1 AND q // {ASKED_EVERY} % 3 < 2
)""",
    "cases": (
        "SELECT e.request_id, list(e.memory_id ORDER BY e.memory_id) AS expected, coalesce(list(e.memory_id ORDER BY e.memory_id) FILTER (WHERE h.vec_id IS NOT NULL), []) AS retrieved, "
        "coalesce(list(e.memory_id ORDER BY e.memory_id) FILTER (WHERE h.vec_id IS NULL), []) AS missing FROM expected e LEFT JOIN hits h ON e.q = h.q AND e.memory_id = 'vec-' || h.vec_id GROUP BY e.request_id"
    ),
}

_NEEDS = {
    "transcripts": ["turns"], "memories": ["base"], "refs": ["base", "n_conv"], "links": ["base"], "spaced": ["memories"], "folded": ["spaced"], "classified": ["refs", "transcripts", "turns"],
    "segments": ["classified", "turns"], "uniq": ["segments"], "composed": ["uniq"], "premises": ["base", "classified", "composed"], "resolved": ["links", "memories"], "reach(a, b)": ["resolved"],
    "members": ["reach(a, b)"], "hits": ["vectors"], "expected": ["vectors", "hits"], "cases": ["expected", "hits"],
}


def with_views(query: str, *names: str) -> str:
    """The query with the views that it needs as common table expressions."""
    names = tuple(next(k for k in SQL if k.split("(")[0] == n) for n in names)
    needed: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        need(n)
    head = "WITH RECURSIVE " if "reach(a, b)" in needed else "WITH "
    return head + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + "\n" + query
