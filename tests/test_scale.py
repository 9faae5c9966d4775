"""Forms that hold no group: factors of replicas, members of duplicates, digests in order, and dense supersession cores."""

import hashlib
import json
import random
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from mnemora.functions import ids
from mnemora.model import SCHEMA_VERSION, TRANSCRIPTS, TURNS
from mnemora.operators import checks as ck
from mnemora.operators import cycles
from mnemora.operators import mutations as mu

from .test_audit import make, memory, rows  # noqa: F401

RULES = "rule_idx int, dimension string, source_principal string, destination_principal string"


@pytest.fixture(scope="module")
def policy(spark):
    return spark.createDataFrame([(0, "user_id", "a", "b"), (1, "user_id", "a", "c"), (2, "agent_id", "x", "y"), (3, "user_id", "c", "b")], RULES)


def copies(rng, n):
    texts = ["User prefers Python.", "user prefers python", "  User   prefers Python!", "Other claim."]
    return [memory(f"m{i:03}", rng.choice(texts), user=rng.choice("abcd"), agent=rng.choice(["x", "y", None]), active=rng.choice([True, False, None]), session=rng.choice([None, "q"]), created=rng.choice([None, "2026-01-01T00:00:00Z"])) for i in range(n)]


def test_factors_are_the_replicas(make, policy):  # noqa: F811
    store = make(copies(random.Random(3), 120))
    found = ck.principals(store, ck.canonical_policy(policy)).cache()
    written_out = {(r["dimension"], r["rule"], r["source_id"], r["destination_id"], r["match_kind"], tuple(r["differing_fields"])) for r in ck.replicas(found).collect()}
    # by brute force over pairs of principals()
    sides = [r.asDict() for r in found.collect()]
    want = set()
    for s, d in product([x for x in sides if x["is_source"]], [x for x in sides if not x["is_source"]]):
        if (s["dimension"], s["rule"], s["sha"]) == (d["dimension"], d["rule"], d["sha"]):
            fields = [c[2:] for c in s if c.startswith("f_") and s[c] != d[c]] + [f"scope.{c}" for c in ("user_id", "agent_id", "session_id") if c != s["dimension"] and s[c] != d[c]]
            want.add((s["dimension"], s["rule"], s["id"], d["id"], "exact" if s["exact"] == d["exact"] else "normalized", tuple(sorted(fields))))
    assert written_out == want and len(want) > 100
    factors = ck.replica_factors(found).collect()
    assert sum(r["sources"] * r["destinations"] for r in factors) == len(want) and len(factors) < len(want)
    stats = ck.privacy_scope_violation(store, policy).stats.first()
    assert stats["details"]["replica_matches"] == len(want) and stats["findings_emitted"] == len({w[3] for w in want})
    found.unpersist()


def test_findings_do_not_depend_on_how_the_policy_is_joined(make, policy, spark):  # noqa: F811
    store = make(copies(random.Random(4), 60))
    broadcast = {k: r["finding_id"] for k, r in rows(ck.privacy_scope_violation(store, policy)).items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {k: r["finding_id"] for k, r in rows(ck.privacy_scope_violation(store, policy)).items()} == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for k, r in rows(ck.privacy_scope_violation(store, policy)).items():
        evidence = [{"kind": e["kind"], "data": json.loads(e["data"])} for e in r["evidence"]]
        assert r["finding_id"] == ids.finding_id_of("privacy_scope_violation", "2.0", "privacy_scope_violation", evidence, k)


def test_a_hot_claim_is_one_factor(spark, make):  # noqa: F811
    n = 10_000
    base = make([memory("s", user="a", active=True), memory("d", user="b", active=True)])
    store = base.crossJoin(spark.range(n).withColumnRenamed("id", "n")).withColumn("id", F.concat("id", F.col("n").cast("string"))).drop("n")
    rules = spark.createDataFrame([(0, "user_id", "a", "b")], RULES)
    factors = ck.replica_factors(ck.principals(store, ck.canonical_policy(rules))).collect()
    assert [(r["sources"], r["destinations"], r["match_kind"], r["differing_fields"]) for r in factors] == [(n, n, "exact", [])]


def test_duplicate_members(make):  # noqa: F811
    odd = [memory('q"uote', user="u"), memory("é \x01", user="u"), memory("b", "User prefers  Python", user="u"), memory("alone", "x", user="u"), memory("none"), memory("none2"), memory("v1", user="v", agent="g"), memory("v2", user="v", agent="g")]
    store = make(odd)
    findings, members = ck.duplicate_members(store)
    got = {r["finding_id"]: r for r in findings.collect()}
    want = {r["finding_id"]: r for r in ck.redundancy_bloat(store).findings.collect()}
    assert set(got) == set(want) and len(want) == 2
    by = {}
    for r in members.collect():
        by.setdefault(r["finding_id"], []).append(r["id"])
    for f, r in want.items():
        assert sorted(by[f]) == r["memory_ids"] and got[f]["n"] == len(by[f])
        assert (got[f]["kind"], got[f]["message"], got[f]["data"]) == tuple(r["evidence"][0][c] for c in ("kind", "message", "data"))
    assert all(df.isEmpty() for df in ck.duplicate_members(store.where("false")))


def test_a_hot_duplicate_group_streams(spark, make):  # noqa: F811
    n = 200_000
    store = make([memory("m", user="u")]).crossJoin(spark.range(n).withColumnRenamed("id", "n")).withColumn("id", F.concat("id", F.lpad(F.col("n").cast("string"), 9, "0"))).drop("n")
    findings, members = ck.duplicate_members(store)
    row = findings.first()
    wanted = ids.finding_id_of("redundancy_bloat", "3.0", "redundancy_bloat", [{"kind": row["kind"], "data": json.loads(row["data"])}], [f"m{i:09}" for i in range(n)])
    assert (row["finding_id"], row["n"], members.count()) == (wanted, n, n)


def test_transcripts_digest_is_canonical(spark):
    """As Python writes it: escapes, times, metadata, transcripts without turns, and turns of no known transcript."""
    hard = 'a "q" \\ \n\x01\x1f é 🙂'
    known = spark.createDataFrame([("b", '{"z": [1, 2.5], "a": "é"}'), ("a", None), ("none", None)], f"{TRANSCRIPTS}, metadata string") if "metadata" not in TRANSCRIPTS else spark.createDataFrame([("b", '{"z": [1, 2.5], "a": "é"}'), ("a", None), ("none", None)], TRANSCRIPTS)
    columns = TURNS if "timestamp_text" in TURNS else f"{TURNS}, timestamp_text string, metadata string"
    turns = [("a", 10, "user", hard, "2026-01-01T00:00:00Z", None), ("a", 9, "user", "x", None, '{"k": {"b": 1, "a": null}}'), ("b", 0, "assistant", "", None, None), ("lost", 0, "user", "y", None, None)]
    table = spark.createDataFrame(turns, columns).repartition(4)
    listed = lambda t: [{"index": i, "role": r, "content": c, "timestamp": s, "metadata": json.loads(m) if m else {}} for k, i, r, c, s, m in sorted(turns) if k == t]
    want = {"schema_version": SCHEMA_VERSION, "transcripts": [{"id": t, "metadata": json.loads(m) if m else {}, "turns": listed(t)} for t, m in (("a", None), ("b", '{"z": [1, 2.5], "a": "é"}'), ("none", None))]}
    assert mu.transcripts_digest((known.repartition(3), table)) == hashlib.sha256(ids.canonical(want).encode()).hexdigest()
    nothing = hashlib.sha256(ids.canonical({"schema_version": SCHEMA_VERSION, "transcripts": []}).encode()).hexdigest()
    assert mu.transcripts_digest((known.where("false"), table.where("false"))) == nothing


def test_store_merkle(make, monkeypatch):  # noqa: F811
    store = make([memory(f"m{i}", f"text {i}", user="u") for i in range(300)])
    root = mu.store_merkle(store)
    assert root == mu.store_merkle(store.repartition(7)) and root != mu.store_merkle(store.where("id <> 'm7'")) and root != mu.store_digest(store)
    monkeypatch.setattr(mu, "LEAF_RECORDS", 1)  # nine bits of leaves, two levels
    deep = mu.store_merkle(store)
    assert deep == mu.store_merkle(store.repartition(5)) and deep != mu.store_merkle(store.withColumn("content", F.when(F.col("id") == "m7", "other").otherwise(F.col("content"))))
    assert mu.store_digest(store.where("false")) == hashlib.sha256(ids.canonical({"adapter": "file", "memories": [], "schema_version": SCHEMA_VERSION}).encode()).hexdigest()
    assert len(mu.store_merkle(store.where("false"))) == 64


def test_digests_do_not_stream_through_the_driver(make, monkeypatch):  # noqa: F811
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    assert len(mu.store_digest(make([memory("a"), memory("b")]))) == 64


def by_cycle(spark, links, **options):
    return {r["id"]: r["cycle"] for r in cycles.supersession_cycles(spark.createDataFrame(links, "src string, dst string"), **options).collect()}


def wanted(links):
    return {m: g[0] for g in cycles.strong_components(links) for m in g}


@pytest.mark.parametrize("seed", range(4))
def test_dense_cores_match_linear_time(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([20, 40, 80])
    links = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([1.2, 1.6, 2.5])))) if a != b})
    assert by_cycle(spark, links, one_task_links=1) == wanted(links)


def test_a_dense_ring_takes_logarithmic_rounds(spark):
    n = 1000
    links = [(f"{i:04}", f"{(i + k) % n:04}") for i in range(n) for k in (1, 2)]
    by_cycle(spark, links[:40], one_task_links=1)
    began = time.time()
    got = by_cycle(spark, links, one_task_links=1)
    assert got == wanted(links) and len(got) == n and time.time() - began < 60


def test_links_both_ways_along_a_path(spark):
    """Chosen links trap walks in pairs here, so that jumps reach nowhere and contraction has to do it."""
    links = [(f"{i:04}", f"{i + 1:04}") for i in range(200)] + [(f"{i + 1:04}", f"{i:04}") for i in range(200)]
    assert by_cycle(spark, links, one_task_links=1) == wanted(links)


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from mnemora import scratch

    folder = scratch.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch.scope(spark) as outer:
        a = scratch.written(spark.range(3))
        with scratch.scope(spark) as inner:
            b = inner.keep(scratch.written(a.withColumn("x", F.col("id") * 2)).where("x > 0"))
        assert len(set(os.listdir(folder)) - before) == 2 and b.count() == 2
        c = outer.keep(b.select("x"))
    assert len(set(os.listdir(folder)) - before) == 1 and sorted(r["x"] for r in c.collect()) == [2, 4]
    by_cycle(spark, [("a", "b"), ("b", "a")], one_task_links=0)
    assert len(set(os.listdir(folder)) - before) == 2


def test_nearest_vectors(spark, monkeypatch):
    """In tiles and blocks of any size, the k nearest are those of a plain sort: ties, copies, odd lengths, nulls."""
    import math
    import random

    from mnemora.plans import views

    rng = random.Random(3)
    some = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(some)) for i in range(300)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300, 500)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [1.0, 2.0]), (503, [1e200] * 4), (504, [float("nan")] * 4), (550, [2.0, 4.0]), (600, None), (650, [float("inf")] * 4), (None, [1.0] * 4)]

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        fold = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        lengths = math.sqrt(fold(a, a)) * math.sqrt(fold(b, b))
        return fold(a, b) / lengths

    def place(x):
        s = score(*x[1:])
        return (2, 0.0, x[0]) if s is None else (0, 0.0, x[0]) if math.isnan(s) else (1, -s, x[0])

    known = [r for r in rows if r[0] is not None]
    want = sorted((q, i, n) for q, u in known if q % 50 == 0 for n, (i, _, _) in enumerate(sorted(((i, u, v) for i, v in known if i != q), key=place)[:10], 1))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for tile, asked_tile, row_block, asked_block in ((4096, 1024, 1 << 14, 1 << 14), (16, 3, 100, 5), (1, 1, 600, 2)):
        monkeypatch.setattr(views, "TILE", tile)
        monkeypatch.setattr(views, "ASKED_TILE", asked_tile)
        got = views.top_k(frame, views.asked_vectors(frame), 10, row_block, asked_block)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per pair of vectors
        assert sorted((r["q"], r["vec_id"], r["rank"]) for r in got.collect()) == want
    assert views.top_k(frame.where("false"), views.asked_vectors(frame), 10).count() == 0


def test_digests_go_from_task_to_task(spark, monkeypatch):
    from hashlib import sha256

    from mnemora.operators import mutations as mu

    texts = [f"{k}:é" * (k % 40) for k in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(5)
    monkeypatch.setattr(mu, "DIGEST_BYTES", 2000)
    spark.sparkContext.setJobGroup("digest", "ranges")
    got = mu._ordered_digest(rows, ["k"], "<", ">")
    assert got == sha256(("<" + "".join(texts) + ">").encode()).hexdigest()
    # a job per range
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("digest")) > len("".join(texts).encode()) // 2000
    monkeypatch.setattr(mu, "_resumable", lambda: False)
    assert mu._ordered_digest(rows, ["k"], "<", ">") == got
    assert mu._ordered_digest(rows.where("false"), ["k"], "<", ">") == sha256(b"<>").hexdigest()


#: Queries over recorded retrievals, whose step is `views.top_k`.
RETRIEVAL = ["c6_findings", "t8_top_k", "s17_observations", "j9_semi", "j9_anti", "q3_sufficiency_any"]


@pytest.mark.parametrize("name", RETRIEVAL)
def test_retrieval_over_copies(spark, sf, tmp_path, monkeypatch, name):
    """Copies of all vectors tie; each query equals its SQL, and makes no row per pair of vectors."""
    import duckdb

    from mnemora.plans import queries as q
    from mnemora.plans import views

    con = duckdb.connect()
    con.execute(f"create table embeddings as select e.* replace (vec_id + 100000 * i as vec_id) from '{sf}/embeddings.parquet' e, range(3) r(i)")
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    plans, top_k = [], views.top_k

    def seen(*args, **kwargs):
        plans.append(top_k(*args, **kwargs))
        return plans[-1]

    monkeypatch.setattr(views, "top_k", seen)
    got = q.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(got.columns)
    want = con.execute(f"select {columns} from ({q.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert plans and not any("Join" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


#: Queries over a mutated store.
MUTATED = ["m1_substitute_then_c5", "m2_conflict", "m3_stale_then_c3", "m4_invalid_span_then_c1", "m4_missing_transcript_then_c1", "m4_missing_turn_then_c1", "m5_crowd", "m6_inject"]


@pytest.mark.parametrize("name", MUTATED)
def test_mutated_store_is_rendered_once(spark, sf, monkeypatch, name):
    """The digest of a mutated store is that of the store as it is; it renders the records that changed, and its tasks hash ranges."""
    from mnemora.plans import queries as q

    rendered, made, store_digest = [], [], mu.store_digest
    canonical_rows, mutate = mu.canonical_rows, mu.mutate

    def seen(memories):
        rendered.append(memories.count())
        return canonical_rows(memories)

    def mutated(memories, *args, **kwargs):
        made.append((memories, mutate(memories, *args, **kwargs)))
        return made[-1][1]

    monkeypatch.setattr(mu, "canonical_rows", seen)
    monkeypatch.setattr(mu, "mutate", mutated)
    monkeypatch.setattr(mu, "DIGEST_BYTES", 100_000)
    q.QUERIES[name](spark, sf)
    ((memories, done),) = made
    changed = len(done.manifest["created_memory_ids"]) + len(done.manifest["modified_memory_ids"])
    assert changed and rendered == [memories.count(), changed]
    monkeypatch.setattr(mu, "DIGEST_BYTES", 1 << 40)
    assert done.manifest["mutated_store_digest"] == store_digest(done.memories) != done.manifest["base_store_digest"] == store_digest(memories)


@pytest.mark.parametrize("name", ["m4_missing_turn_then_c1", "m6_inject"])
def test_mutated_store_is_hashed_from_its_first_difference(spark, sf, monkeypatch, name):
    """The store is dealt into ranges once; records after all others take no job, and a changed one those of the ranges from its own on."""
    from pyspark import SparkContext

    from mnemora.plans import queries as q

    made, ranges, sorts, mutate = [], [], [], mu.mutate
    frame = type(spark.range(1))
    run_job, by_range = SparkContext.runJob, frame.repartitionByRange

    def ran(self, rdd, function, partitions=None, *args):
        ranges.extend(partitions or [])
        return run_job(self, rdd, function, partitions, *args)

    def dealt(self, n, *columns):
        if self.columns == ["id", "json"] and isinstance(n, int):
            sorts.append(n)
        return by_range(self, n, *columns)

    def mutated(memories, request, transcripts=None, adapter="file"):
        with monkeypatch.context() as m:
            m.setattr(SparkContext, "runJob", ran)
            m.setattr(frame, "repartitionByRange", dealt)
            made.append((memories, mutate(memories, request, transcripts, adapter)))
        return made[-1][1]

    monkeypatch.setattr(mu, "mutate", mutated)
    monkeypatch.setattr(mu, "transcripts_digest", lambda transcripts: None)
    monkeypatch.setattr(mu, "DIGEST_BYTES", 100_000)
    q.QUERIES[name](spark, sf)
    ((memories, done),) = made
    n = max(ranges) + 1
    # first() and the like run partition 0, too
    later = [k for k in ranges if k]
    assert n > 5 and len(sorts) == 1 and later == [*range(1, n)] * (2 if done.manifest["modified_memory_ids"] else 1)
    monkeypatch.setattr(mu, "DIGEST_BYTES", 1 << 40)
    assert done.manifest["mutated_store_digest"] == mu.store_digest(done.memories) != done.manifest["base_store_digest"] == mu.store_digest(memories)


@pytest.mark.parametrize("resumable", [True, False])
def test_digest_of_a_store_that_differs(make, monkeypatch, resumable):  # noqa: F811
    """Records before, between and after all others, without some, and in the order of UTF-8."""
    monkeypatch.setattr(mu, "DIGEST_BYTES", 2500)
    if not resumable:
        monkeypatch.setattr(mu, "_resumable", lambda: False)
    old = [memory(f"m{i:02}", f"text {i}") for i in range(30)]
    digests = mu._StoreDigests(mu.canonical_rows(make(old)), "file")
    base = digests.base()
    monkeypatch.setattr(mu, "DIGEST_BYTES", 1 << 40)
    assert base == mu.store_digest(make(old)) == digests.other(mu.canonical_rows(make(old)).where("false"), [])
    for added, gone in ((["a", "m05x", "m05y", "é", "\U0001f600", "\uffee"], ["m00", "m05", "m29"]), (["m30"], [f"m{i:02}" for i in range(30)])):
        new = [memory(i, "new") for i in added]
        want = mu.store_digest(make([m for m in old if m[0] not in gone] + new))
        assert digests.other(mu.canonical_rows(make(new)), gone) == want


def test_a_principal_is_not_one_task(spark, make, policy):  # noqa: F811
    """Without a broadcast, the memories of one user still meet the rules in several tasks."""
    store = make([memory(f"m{i:03}", "same", user="a") for i in range(400)])
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        found = ck.principals(store, ck.canonical_policy(policy))
        held = [r["count"] for r in found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(held) == 400 and max(held) < 300 and "slot" not in found.columns
