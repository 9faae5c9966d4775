"""After every batch, the changes so far sum up to the batch check over everything so far."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemora.model import MEMORIES
from mnemora.operators import checks as ck
from mnemora.streaming import incremental

from .test_audit import make, memory  # noqa: F401


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, incremental.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def batches(rng):
    texts = ["User prefers Python.", "user prefers python", "é ﬁ", "Other.", "x"]
    rows = [memory(f"m{i:03}", rng.choice(texts), user=rng.choice(["a", "b", None]), agent=rng.choice(["x", None])) for i in range(60)]
    return [rows[:25], rows[25:26], rows[26:55], rows[55:]]


def net(rows):
    total = Counter()
    for *what, change in rows:
        total[tuple(what)] += change
    return {k for k, n in total.items() if n} if all(n in (0, 1) for n in total.values()) else total


def follow(spark, tmp_path, make_changes, check, make):  # noqa: F811
    source, saved, seen, stored = tmp_path / "in", tmp_path / "saved", [], []
    source.mkdir()
    for given in batches(random.Random(8)):
        stored += given
        make(given).coalesce(1).write.mode("append").parquet(str(source))
        changes = make_changes(spark.readStream.schema(MEMORIES).parquet(str(source)))
        query = changes.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(saved)).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        check(seen, make(stored))


def test_duplicates(rocks, tmp_path, make):  # noqa: F811
    def check(seen, store):
        groups, want = ck.duplicate_groups(store).collect(), lambda r: (r["user_id"], r["agent_id"], r["session_id"], r["sha"], r["folded_length"])
        assert net([(*x[:5], *x[6:]) for x in seen if x[5] is None]) == {(*want(r), r["n"], r["is_exact"]) for r in groups}
        assert net([(*x[:6], x[8]) for x in seen if x[5] is not None]) == {(*want(r), i) for r in groups for i in r["memory_ids"]}

    follow(rocks, tmp_path, incremental.streamed_duplicates, check, make)


def test_replicas(rocks, tmp_path, make):  # noqa: F811
    rules = rocks.createDataFrame([(0, "user_id", "a", "b"), (1, "agent_id", "x", "y"), (2, "user_id", "b", "a")], "rule_idx int, dimension string, source_principal string, destination_principal string")

    def check(seen, store):
        factors = ck.replica_factors(ck.principals(store, ck.canonical_policy(rules))).groupBy("dimension", "rule", "sha").agg(F.sum(F.col("sources") * F.col("destinations")).alias("n"))
        assert {x[:3] + (x[5],) for x in net(seen)} == set(map(tuple, factors.collect()))

    follow(rocks, tmp_path, lambda m: incremental.streamed_replicas(m, rules), check, make)


def test_provider_is_required(spark, tmp_path, make):  # noqa: F811
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != incremental.PROVIDER:
        with pytest.raises(ValueError, match="RocksDB"):
            incremental.streamed_duplicates(make([memory("a")]))
