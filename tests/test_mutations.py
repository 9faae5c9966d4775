"""Defects that are injected are found, exactly where their manifest says."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mnemora.functions.judges import LexicalJudge
from mnemora.operators import checks as ck
from mnemora.operators import mutations as mu

from .test_audit import make, memory, talks  # noqa: F401

CLEAN = [memory("m1", "Live in Lyon", user="a", refs=[("t1", 0)], active=True), memory("m2", "Noted", user="a", refs=[("t1", 1)], active=True), memory("m3", "Other", user="b", active=True)]


@pytest.fixture(scope="module")
def store(make):  # noqa: F811
    return make(CLEAN)


def flagged(result):
    return {tuple(r["memory_ids"]) for r in result.findings.collect()}


def test_clean_store_is_clean(store, talks):  # noqa: F811
    assert not flagged(ck.orphaned_provenance(store, *talks)) and not flagged(ck.redundancy_bloat(store)) and not flagged(ck.stale_active(store)) and not flagged(ck.unsupported_claim(store, *talks, LexicalJudge()))


def test_unsupported(store, talks):  # noqa: F811
    done = mu.mutate(store, mu.Request("unsupported_claim", target_memory_id="m1", replace_from="in Lyon", replace_to="where winter never ends"), talks)
    assert flagged(ck.unsupported_claim(done.memories, *talks, LexicalJudge())) == {("m1",)} == {tuple(done.manifest["gold_label"]["memory_ids"])}
    for bad in ({"replace_from": "Live", "replace_to": "I"}, {"replace_from": "Nothing", "replace_to": "x"}):
        with pytest.raises(mu.PreconditionError):
            mu.mutate(store, mu.Request("unsupported_claim", target_memory_id="m1", **bad), talks)


def test_stale(store):
    done = mu.mutate(store, mu.Request("stale_active", target_memory_id="m2", replace_from="Noted", replace_to="Seen"))
    assert flagged(ck.stale_active(done.memories)) == {("m2",)} and done.memories.count() == 4
    assert done.manifest["targets"][1]["role"] == "superseding" and done.manifest["base_store_digest"] != done.manifest["mutated_store_digest"]


@pytest.mark.parametrize("subtype", mu.SUBTYPES["orphaned_provenance"])
def test_orphan(store, talks, subtype):  # noqa: F811
    done = mu.mutate(store, mu.Request("orphaned_provenance", subtype, seed=3), talks)
    result = ck.orphaned_provenance(done.memories, *talks).findings.collect()
    assert [list(r["memory_ids"]) for r in result] == [done.manifest["target_memory_ids"]] and result[0]["evidence"][0]["kind"] == subtype


@pytest.mark.parametrize(("subtype", "given"), [("cross_user_copy", {"destination_user_id": "z"})])
def test_scope(store, spark, subtype, given):
    done = mu.mutate(store, mu.Request("privacy_scope_violation", subtype, target_memory_id="m1", **given))
    rules = spark.createDataFrame([(0, "user_id", "a", "z")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    assert flagged(ck.privacy_scope_violation(done.memories, rules)) == {tuple(done.manifest["target_memory_ids"])}
    with pytest.raises(mu.PreconditionError):
        mu.mutate(store, mu.Request("privacy_scope_violation", "cross_agent_copy", destination_agent_id="q"))


def test_redundancy(store):
    done = mu.mutate(store, mu.Request("redundancy_bloat", seed=1))
    assert flagged(ck.redundancy_bloat(done.memories)) == {tuple(sorted(done.manifest["target_memory_ids"]))}


def test_others(store):
    conflict = mu.mutate(store, mu.Request("internal_contradiction", target_memory_id="m1", replace_from="Lyon", replace_to="Oslo", conflict_relation="exclusive_value"))
    assert conflict.manifest["gold_label"]["unit"] == "memory_pair" and conflict.memories.where("content = 'Live in Oslo'").count() == 1
    crowd = mu.mutate(store, mu.Request("retrieval_shadowing", query="Which editor?", distractor_family="editor", distractor_count=5))
    assert crowd.memories.count() == 8 and crowd.manifest["requires_runtime_validation"] and not crowd.manifest["gold_label"]["observed_positive"]
    told = mu.mutate(store, mu.Request("injected_instruction", seed=2))
    assert told.memories.where(F.contains("content", F.lit("teal"))).count() == 1


def test_choice_is_seeded(store):
    import random

    ids = sorted(r[0] for r in CLEAN)
    for seed in range(4):
        assert mu.choose(store.repartition(seed + 1), mu.Request("redundancy_bloat", seed=seed), None, "x")["id"] == random.Random(seed).choice(ids)


def test_digests(store, talks):  # noqa: F811
    assert mu.store_digest(store) == mu.store_digest(store.repartition(5)) and mu.store_fingerprint(store) == mu.store_fingerprint(store.repartition(2))
    assert mu.transcripts_digest(talks) == mu.transcripts_digest(tuple(t.repartition(2) for t in talks)) and mu.transcripts_digest(None) is None


def test_digest_is_of_the_written_store(make):  # noqa: F811
    """The digest is that of the store's canonical JSON, as Python writes it: numbers, escapes, spans and nulls."""
    from mnemora.functions.ids import canonical
    from mnemora.model import SCHEMA_VERSION
    from mnemora.plans.sinks import memory_dict

    hard = 'a "quote", a \\ and \\u001F, \t\n\x01\x1f\x7f, \u00df\u2028\U0001f600 </tag>'
    store = make([
        memory("m2", hard, active=False, embedding=[1e-5, 1e16, 0.1, -0.0, 123456789.0, 1e22, 5e-324, 3.0], user="u"),
        memory("m1", "x", refs=[("t", None, None), ("t", 1, (0, 3))], supersedes=["m2", 'q"']),
    ])
    rows = sorted((memory_dict(r) for r in store.collect()), key=lambda m: m["id"])
    assert mu.store_digest(store) == hashlib.sha256(canonical({"adapter": "file", "memories": rows, "schema_version": SCHEMA_VERSION}).encode()).hexdigest()


def test_embedding_guard(make):  # noqa: F811
    with pytest.raises(mu.PreconditionError, match="embedding"):
        mu.mutate(make([memory("m", "Live in Lyon", active=True, embedding=[1.0])]), mu.Request("stale_active", replace_from="Lyon", replace_to="Oslo"))


@pytest.mark.parametrize("bad", [{"defect_class": "odd"}, {"defect_class": "stale_active", "subtype": "odd"}, {"defect_class": "stale_active", "query": " "}, {"defect_class": "stale_active", "distractor_count": 6}])
def test_requests(bad):
    with pytest.raises(mu.PreconditionError):
        mu.Request(**bad)
