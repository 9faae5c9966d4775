"""The checks against small stores with known answers, and against brute force over random ones."""

import json
import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mnemora.functions import ids, judges, text
from mnemora.model import MEMORIES, TRANSCRIPTS, TURNS
from mnemora.operators import checks as ck
from mnemora.operators import constraints, cycles, evidence
from mnemora.plans import report


def memory(id, content="User prefers Python.", user=None, agent=None, session=None, refs=(), status=None, active=None, supersedes=(), embedding=None, created=None):
    status = status or ("declared" if refs else "unavailable")
    refs = [(t, i, s) for t, i, s in ((*r, None, None)[:3] for r in refs)]
    return (id, content, None, created, None, None, refs, status, (user, agent, session), active, list(supersedes), embedding, None)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, MEMORIES).repartition(3)


@pytest.fixture(scope="module")
def talks(spark):
    transcripts = spark.createDataFrame([("t1",), ("t2",), ("empty",)], TRANSCRIPTS)
    turns = spark.createDataFrame([("t1", 0, "user", "I live in Lyon 🙂"), ("t1", 1, "assistant", "Noted."), ("t2", 4, "user", "   ")], TURNS)
    return transcripts, turns


def rows(result):
    return {tuple(r["memory_ids"]): r for r in result.findings.collect()}


def test_golden_finding_id():
    evidence_ = [{"kind": "missing_turn", "data": {"source_ref_index": 0, "transcript_id": "t1", "turn_idx": 9}}]
    assert ids.finding_id_of("orphaned_provenance", "1.0", "orphaned_provenance", evidence_, ["m1"]) == "finding-40b457405be7323e58161e25"


def test_orphaned(make, talks):
    ms = make([
        memory("gone", refs=[("nowhere", 3)]), memory("turn", refs=[("t1", 9)]), memory("span", refs=[("t1", 1, (0, 7))]), memory("edge", refs=[("t1", 1, (0, 6))]), memory("emoji", refs=[("t1", 0, (15, 16))]),
        memory("whole", refs=[("t1",)]), memory("none"), memory("absent", status="known_absent"), memory("both", refs=[("nowhere", 1), ("t1", 0), ("t1", 9)]), memory("no-turns", refs=[("empty", 0)]),
    ])
    result = ck.orphaned_provenance(ms, *talks)
    got = {k[0]: [(e["kind"], json.loads(e["data"])) for e in r["evidence"]] for k, r in rows(result).items()}
    assert got == {
        "gone": [("missing_transcript", {"source_ref_index": 0, "transcript_id": "nowhere"})],
        "turn": [("missing_turn", {"source_ref_index": 0, "transcript_id": "t1", "turn_idx": 9})],
        "span": [("invalid_span", {"source_ref_index": 0, "span": [0, 7], "transcript_id": "t1", "turn_idx": 1, "turn_length": 6})],
        "both": [("missing_transcript", {"source_ref_index": 0, "transcript_id": "nowhere"}), ("missing_turn", {"source_ref_index": 2, "transcript_id": "t1", "turn_idx": 9})],
        "no-turns": [("missing_turn", {"source_ref_index": 0, "transcript_id": "empty", "turn_idx": 0})],
    }
    for k, r in rows(result).items():
        assert r["finding_id"] == ids.finding_id_of("orphaned_provenance", "1.0", "orphaned_provenance", [{"kind": a, "data": b} for a, b in got[k[0]]], k)
    s = result.stats.first()
    assert (s["memories_scanned"], s["findings_emitted"], s["details"]) == (10, 5, {"source_refs_scanned": 10})
    assert constraints.finding_violations(result.findings).isEmpty()


def test_evidence_order_is_textual(make, talks):
    result = ck.orphaned_provenance(make([memory("m", refs=[("x", None)] * 12)]), *talks)
    got = [json.loads(e["data"])["source_ref_index"] for e in rows(result)[("m",)]["evidence"]]
    assert got == sorted(range(12), key=lambda i: ids.canonical({"data": {"source_ref_index": i, "transcript_id": "x"}, "kind": "missing_transcript"}))


@pytest.mark.parametrize("c", ["User prefers Python", "User prefers Python!!!", "user  PREFERS\nPython. ", "User prefers Python . .", "User prefers Python"])
def test_folds_alike(make, c):
    found = rows(ck.redundancy_bloat(make([memory("b", user="u"), memory("a", c, user="u")])))
    assert list(found) == [("a", "b")] and found[("a", "b")]["evidence"][0]["kind"] == "normalized_duplicate"


def test_fold_paths_agree(spark):
    rng = random.Random(3)
    texts = ["", "...", " . ", "a . ! b ..", "$+<=>^`|~", "\x1c a\x1f", "Straße ﬁ É İ", "„“", "x　。"] + ["".join(chr(rng.randrange(1, 128)) for _ in range(12)) for _ in range(300)]
    df = text.with_folded(spark.createDataFrame([(t,) for t in texts], "content string"))
    assert all(r["folded"] == text.fold(r["content"]) for r in df.collect()) and df.count() == len(texts)
    assert [text.fold(t) for t in ("Straße!", "ﬁn.", "...", "a .,;")] == ["strasse", "fin", "...", "a"]


def test_blank(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(s, True) for s in ["", *spaces, "".join(spaces)]] + [("​", False), (" x ", False)], "s string, want boolean")
    assert df.where(text.is_blank(F.col("s")) != F.col("want")).isEmpty()


def test_duplicates_by_scope(make):
    ms = make([memory("a", user="u"), memory("b", user="u"), memory("c", user="v"), memory("d", user="u", agent="x"), memory("e"), memory("f"), memory("g", "other", user="u"), memory("h", session="s"), memory("i", session="s"), memory("j", "User prefers Python", session="s")])
    result = ck.redundancy_bloat(ms)
    got = {k: (r["evidence"][0]["kind"], json.loads(r["evidence"][0]["data"])) for k, r in rows(result).items()}
    assert set(got) == {("a", "b"), ("h", "i", "j")}
    assert got["a", "b"] == ("exact_duplicate", {"match_kind": "exact", "normalized_content_length": 19, "normalized_content_sha256": sha256(b"user prefers python").hexdigest(), "scope": {"user_id": "u", "agent_id": None, "session_id": None}})
    s = result.stats.first()
    assert s["details"] == {"eligible_memories": 8, "unscoped_memories_skipped": 2, "duplicate_groups": 2, "exact_duplicate_groups": 1, "normalized_duplicate_groups": 1}


def test_stale(make):
    ms = make([
        memory("old", active=True), memory("new1", supersedes=["old"]), memory("new2", supersedes=["old"]), memory("off", active=False), memory("new3", supersedes=["off", "lost", "new3"]),
        memory("c1", active=True, supersedes=["c2"]), memory("c2", supersedes=["c3"]), memory("c3", active=False, supersedes=["c1"]), memory("into", supersedes=["c1"]),
        memory("d1", active=False, supersedes=["d2"]), memory("d2", supersedes=["d1"]),
    ])
    result = ck.stale_active(ms)
    got = {k: [json.loads(e["data"]) for e in r["evidence"]] for k, r in rows(result).items()}
    assert got == {
        ("old",): [{"old_active": True, "superseding_memory_id": "new1"}, {"old_active": True, "superseding_memory_id": "new2"}],
        ("c1", "c2", "c3"): [{"active_members": ["c1"], "members": ["c1", "c2", "c3"]}],
    }
    s = result.stats.first()
    assert s["details"] == {"supersession_links_scanned": 11, "resolved_supersession_links": 9, "missing_targets_skipped": 1, "self_links_skipped": 1, "supersession_cycles": 2}
    assert [tuple(r) for r in result.extra["dangling_supersession_targets"].collect()] == [("new3", "lost")]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_cycles_against_reachability(spark, limit):
    rng = random.Random(limit + 1)
    links = list({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(48)} | {("x", "y"), ("y", "x"), ("y", "z")})
    links = [(a, b) for a, b in links if a != b]
    reach = defaultdict(set)
    for a, b in links:
        reach[a].add(b)
    for _ in range(45):
        for a in list(reach):
            reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
    want = {frozenset([a, *(b for b in reach[a] if a in reach[b])]) for a in list(reach) if a in reach[a]}
    got = defaultdict(set)
    for r in cycles.supersession_cycles(spark.createDataFrame(links, "src string, dst string"), limit).collect():
        got[r["cycle"]].add(r["id"])
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == c for c, g in got.items())


def test_scope_violation(make, spark):
    rules = spark.createDataFrame([(0, "user_id", "a", "b"), (1, "user_id", "a", "c"), (2, "agent_id", "x", "y")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    ms = make([
        memory("s1", user="a", active=True), memory("s2", "user prefers python", user="a", session="q"), memory("d1", user="b", active=True, embedding=[1.0]), memory("d2", "nothing alike", user="b"), memory("d3", user="c", agent="y"),
        memory("s3", user="z", agent="x"), memory("free", user="z"), memory("none"),
    ])
    result = ck.privacy_scope_violation(ms, rules)
    got = {k[0]: sorted(((d := json.loads(e["data"]))["authoritative_source_memory_id"], d["match_kind"], tuple(d["differing_fields"])) for e in r["evidence"]) for k, r in rows(result).items()}
    assert got == {
        "d1": [("s1", "exact", ("embedding",)), ("s2", "normalized", ("active", "content", "embedding", "scope.session_id"))],
        "d3": [("s1", "exact", ("active", "scope.agent_id")), ("s2", "normalized", ("content", "scope.agent_id", "scope.session_id")), ("s3", "exact", ("scope.user_id",))],
    }
    assert result.stats.first()["details"] == {"policy_rules_scanned": 2, "authoritative_candidates": 3, "destination_candidates": 4, "replica_matches": 5}


def test_evidence(make, talks):
    ms = make([memory("a", refs=[("t1",), ("t1", 0, (10, 14)), ("t1", 0, (10, 14)), ("t1", 5)]), memory("e", refs=[("empty",)])])
    refs = evidence.source_refs(ms)
    got = {(r["source_ref_index"], r["turn_idx"], r["text"]) for r in evidence.segments(refs, talks[1]).collect()}
    assert got == {(0, 0, "I live in Lyon 🙂"), (0, 1, "Noted."), (1, 0, "Lyon"), (2, 0, "Lyon")}
    r = evidence.composed(evidence.segments(refs, talks[1])).first()
    assert (r["premise"], r["segment_count"], r["unique_segment_count"]) == ("I live in Lyon 🙂\nLyon\nNoted.", 4, 3)


def test_unsupported(make, talks):
    ms = make([
        memory("yes", "Live in Lyon", refs=[("t1", 0)]), memory("no", "Works at night", refs=[("t1", 0)]), memory("part", "lyon oslo rome paris", refs=[("t1", 0)]), memory("broken", "x", refs=[("t1", 0), ("t1", 7)]),
        memory("blank", "x", refs=[("t2", 4)]), memory("nothing", "x", refs=[("empty",)]), memory("undeclared", "x"), memory("long", " ".join("w" * 50), refs=[("t1", 0)]),
    ])
    result = ck.unsupported_claim(ms, *talks, judges.LexicalJudge(max_words=40))
    got = {k[0]: json.loads(r["evidence"][0]["data"])["semantic_relation"] for k, r in rows(result).items()}
    assert got == {"no": "contradiction", "part": "neutral"}
    s = result.stats.first()
    assert s["details"] == {
        "declared_memories": 7, "assessed_memories": 3, "skipped_non_declared_provenance": 1, "skipped_resolution_issues": 1, "skipped_no_evidence": 2, "skipped_input_too_long": 1,
        "entailment_judgments": 1, "neutral_judgments": 1, "contradiction_judgments": 1,
    }
    assert s["model_calls"] == 3
    assert rows(result)[("part",)]["confidence"] == 0.25


class Broken:
    judge_id, judge_version = "broken", "1"

    def judge(self, *, premise, hypothesis):
        raise RuntimeError(f"secret {premise}")


def test_failing_judge_names_only_the_memory(make, talks):
    with pytest.raises(Exception, match="failed for memory m") as e:
        ck.unsupported_claim(make([memory("m", "Claim", refs=[("t1", 0)])]), *talks, Broken()).findings.collect()
    assert "Lyon" not in str(e.value) and "secret" not in str(e.value)


def test_softmax():
    assert judges.softmax_relation([1.0, 1.0, 0.0], ["neutral", "entailment", "contradiction"])[0] == "neutral"
    with pytest.raises(ValueError):
        judges.softmax_relation([0, 0, 0], ["a", "b", "c"])


def observation(spark, hits, expected=("m1", "m2"), k=5):
    from mnemora.model import OBSERVATIONS

    return spark.createDataFrame([("r", "0" * 64, list(expected), k, "v", "1", [(h, i + 1, 0.5) for i, h in enumerate(hits)], 1, 9)], OBSERVATIONS)


@pytest.mark.parametrize(("hits", "policy", "missing"), [(["m1", "m2"], "all_expected", None), (["m1"], "all_expected", ("m2",)), (["m1"], "any_expected", None), ([], "any_expected", ("m1", "m2"))])
def test_retrieval(spark, hits, policy, missing):
    result = ck.retrieval_shadowing(observation(spark, hits), policy)
    assert list(rows(result)) == ([missing] if missing else [])
    d = result.stats.first()["details"]
    assert d["hits_observed"] == len(hits) and d["expected_targets"] == 2 and d["candidate_count"] == 9


def test_order_does_not_matter(make, talks, spark):
    base = [memory(f"m{i}", "User prefers Python." if i % 3 else "x", user=f"u{i % 2}", refs=[("t1", i % 4)], active=bool(i % 2), supersedes=[f"m{(i + 1) % 9}"]) for i in range(9)]
    rules = spark.createDataFrame([(0, "user_id", "u0", "u1")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    seen = []
    for seed in (0, 1):
        random.Random(seed).shuffle(base)
        found = report.audit(make(base), transcripts=talks, rules=rules, judge=judges.LexicalJudge())
        seen.append(report.render(report.audit_dict(found)))
    assert seen[0] == seen[1] and "Python" not in seen[0]


def test_empty_store(make, talks, spark):
    rules = spark.createDataFrame([(0, "user_id", "a", "b")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    found = report.audit(make([memory("x")]).where("false"), transcripts=talks, rules=rules, judge=judges.LexicalJudge())
    assert found.findings.isEmpty() and {r["findings_emitted"] for r in found.stats.collect()} == {0}
    assert {r["status"] for r in report.preflight(make([memory("x")]).where("false"), adapter="file", has_transcripts=True, rules=rules, has_judge=True).collect()} == {"ready"}


def test_audit_skips(make):
    found = report.audit(make([memory("a", user="u")]))
    assert [r.checker_id for r in found.results] == ["redundancy_bloat", "stale_active"]
    assert found.skipped == [
        {"checker_id": "orphaned_provenance", "reasons": ["missing_transcripts"]}, {"checker_id": "privacy_scope_violation", "reasons": ["missing_scope_policy"]},
        {"checker_id": "unsupported_claim", "reasons": ["missing_transcripts", "missing_semantic_configuration"]},
    ]
    with pytest.raises(report.InputError):
        report.run_check("orphaned_provenance", report.Inputs(make([memory("a")])))


def test_preflight(make, spark):
    rules = spark.createDataFrame([(0, "user_id", "a", "b"), (1, "agent_id", "a", "b")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    ms = make([memory("a", user="u", agent="g", active=True, refs=[("t",)]), memory("b", user="u")])
    got = {r["checker_id"]: (r["status"], r["assessable_memories"], r["limitations"]) for r in report.preflight(ms, adapter="letta", has_transcripts=True, rules=rules).collect()}
    assert got == {
        "orphaned_provenance": ("degraded", 1, ["non_declared_provenance"]), "redundancy_bloat": ("ready", 2, []), "stale_active": ("degraded", 1, ["active_state_unavailable", "supersession_unsupported"]),
        "privacy_scope_violation": ("degraded", 1, ["policy_scope_unavailable"]), "unsupported_claim": ("blocked", 0, []),
    }


def test_constraints(make, spark):
    bad = {
        "content_blank": memory("c", " \x1c"), "supersedes_repeated": memory("r", supersedes=["x", "x"]), "supersedes_itself": memory("s", supersedes=["s"]), "provenance_mismatch": memory("p", status="declared"),
        "embedding_invalid": memory("e", embedding=[float("nan")]), "source_ref_invalid": memory("f", refs=[("t", None, (0, 1))]), "scope_blank": memory("g", user=" "), "provenance_unknown": memory("u", status="odd"),
    }
    got = {r["violated"]: r["id"] for r in constraints.memory_violations(make([*bad.values(), memory("fine", user="u")])).collect()}
    assert {k: v[0] for k, v in bad.items()}.items() <= got.items() and "fine" not in got.values()
    with pytest.raises(constraints.ConstraintError):
        constraints.require_valid_memories(make([memory("a"), memory("a")]))
    assert not constraints.observation_violations(observation(spark, ["m1", "m1"])).isEmpty()
    assert constraints.observation_violations(observation(spark, ["m1", "m3"])).isEmpty()


def test_sarif_and_gate(make):
    result = ck.redundancy_bloat(make([memory("b", user="u"), memory("a", user="u")]))
    doc = report.sarif([result])
    one = doc["runs"][0]["results"][0]
    assert one["level"] == "warning" and one["properties"]["memory_ids"] == ["a", "b"] and one["properties"]["evidence"][0]["data"]["scope"] == {"agent_id": None, "session_id": None, "user_id": "u"}
    assert [report.gate([result], t) for t in ("info", "warning", "error", None)] == [True, True, False, False]


def test_canonical_json(spark):
    strings = ["a\"b\\", "\x01\x0b\x1f\n", "\\u001F literal", "é🙂/", "\x7f"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", ids.json_of(b=F.lit(None).cast("int"), a=F.col("s")).alias("j"), ids.json_string(F.col("s")).alias("q"))
    for r in df.collect():
        assert r["j"] == ids.canonical({"a": r["s"], "b": None}) and r["q"] == json.dumps(r["s"], ensure_ascii=False)


def test_custom_check(make):
    from mnemora.model import RULES_BY_CHECKER, Rule

    def shouting(inputs):
        found = inputs.memories.where(F.upper("content") == F.col("content")).select(F.array("id").alias("memory_ids"), F.array(ids.evidence_item("shout", "All capitals.", F.lit("{}"))).alias("items"))
        return ck.CheckResult("shouting", ck._findings(found, "shouting"), ck._stats(inputs.memories.agg(F.count(F.lit(1)).alias("n")), "shouting", F.col("n"), F.lit(1), {"seen": F.col("n")}))

    report.register_check(Rule("shouting", "1.0", "memory.style.shouting", "1.0.0", "info"), shouting)
    try:
        result = report.run_check("shouting", report.Inputs(make([memory("a", "LOUD"), memory("b", "calm")])))
        assert [f["memory_ids"] for f in report.result_dict(result)["findings"]] == [["a"]]
    finally:
        del RULES_BY_CHECKER["shouting"], report._CUSTOM["shouting"]
    for bad in (Rule("stale_active", "9", "a.b", "1.0.0", "info"), Rule("x", "1", "Not Valid", "1.0.0", "info"), Rule("x", "1", "a.b", "01.0.0", "info"), Rule("x", "1", "a.b", "1.0.0", "loud")):
        with pytest.raises(report.InputError):
            report.register_check(bad, shouting)
    with pytest.raises(report.InputError):
        report.run_check("odd", report.Inputs(make([memory("a")])))


def test_long_chains_and_rings_in_rounds(spark):
    """A chain of 1,000 links, a ring of 1,000 nodes, 20 small rings, rings that share nodes, and chains between them."""
    import time

    from mnemora.operators import cycles

    links = [(f"c{i}", f"c{i + 1}") for i in range(1000)] + [(f"r{i:04}", f"r{(i + 1) % 1000:04}") for i in range(1000)]
    links += [(f"s{k:02}-{i}", f"s{k:02}-{(i + 1) % (2 + k % 4)}") for k in range(20) for i in range(2 + k % 4)]
    links += [("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("x2", "y1"), ("y1", "y2"), ("y2", "x2"), ("r0007", "s03-0"), ("c1000", "r0500"), ("x1", "c0"), ("x0", "x2")]
    want = {m: g[0] for g in cycles.strong_components(links) for m in g}
    df = spark.createDataFrame(links, "src string, dst string")
    began = time.time()
    got = {r["id"]: r["cycle"] for r in cycles.supersession_cycles(df, one_task_links=1).collect()}
    assert got == want and len(got) > 1050 and time.time() - began < 60
