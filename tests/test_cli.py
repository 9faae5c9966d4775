"""Commands end to end."""

import json

import pytest

from mnemora import cli


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("cli")
    records = [
        {"id": "a", "content": "User prefers Python.", "user_id": "u", "active": True, "source_refs": [{"transcript_id": "t", "turn_idx": 9}]}, {"id": "b", "content": "user prefers python", "user_id": "u", "active": True},
        {"id": "c", "content": "User prefers Python.", "user_id": "v", "supersedes": ["a"]},
    ]
    (d / "in.json").write_text(json.dumps({"memories": records}))
    (d / "talks.json").write_text(json.dumps({"schema_version": "0.1", "transcripts": [{"id": "t", "turns": [{"index": 0, "role": "user", "content": "Python"}]}]}))
    (d / "policy.json").write_text(json.dumps({"schema_version": "0.1", "rules": [{"dimension": "user_id", "authoritative_source_principal": "u", "prohibited_destination_principals": ["v"]}]}))
    assert cli.main(["dump", "--adapter", "file", "--source", str(d / "in.json"), "--output", str(d / "store.json")]) == 0
    return d


def test_dump(folder):
    store = json.loads((folder / "store.json").read_text())
    assert [m["id"] for m in store["memories"]] == ["a", "b", "c"] and store["adapter"] == "file" and "raw" not in store["memories"][0]


def test_audit_all(folder):
    args = ["audit", "--checker", "all", "--store", str(folder / "store.json"), "--transcripts", str(folder / "talks.json"), "--scope-policy", str(folder / "policy.json"), "--output", str(folder / "r.json"), "--sarif-output", str(folder / "r.sarif")]
    assert cli.main([*args, "--fail-on", "error"]) == 1
    r = json.loads((folder / "r.json").read_text())
    assert {x["checker_id"]: x["stats"]["findings_emitted"] for x in r["results"]} == {"orphaned_provenance": 1, "redundancy_bloat": 1, "stale_active": 1, "privacy_scope_violation": 1}
    assert r["skipped"] == [{"checker_id": "unsupported_claim", "reasons": ["missing_semantic_configuration"]}]
    assert len(json.loads((folder / "r.sarif").read_text())["runs"][0]["results"]) == 4
    assert "Python" not in (folder / "r.json").read_text()


def test_single_audit_and_gate(folder, capsys):
    args = ["audit", "--checker", "redundancy_bloat", "--store", str(folder / "store.json")]
    assert cli.main([*args, "--fail-on", "error"]) == 0 and cli.main([*args, "--fail-on", "warning"]) == 1
    assert json.loads(capsys.readouterr().out.split("}\n{")[0] + "}")["checker_id"] == "redundancy_bloat"


def test_mutate_then_audit(folder):
    args = ["mutate", "--store", str(folder / "store.json"), "--defect", "redundancy_bloat", "--target-id", "c", "--output", str(folder / "m.json"), "--manifest", str(folder / "gold.json")]
    assert cli.main(args) == 0
    gold = json.loads((folder / "gold.json").read_text())
    assert cli.main(["audit", "--checker", "redundancy_bloat", "--store", str(folder / "m.json"), "--output", str(folder / "mr.json")]) == 0
    assert sorted(gold["target_memory_ids"]) in [f["memory_ids"] for f in json.loads((folder / "mr.json").read_text())["findings"]]


def test_preflight_and_capabilities(folder, capsys):
    assert cli.main(["preflight", "--store", str(folder / "store.json")]) == 0
    assert [c["status"] for c in json.loads(capsys.readouterr().out)["checks"]] == ["blocked", "ready", "degraded", "blocked", "blocked"]
    assert cli.main(["capabilities", "--adapter", "letta"]) == 0
    assert json.loads(capsys.readouterr().out)["session_scope"] == "unsupported"


def test_retrieval(folder, capsys):
    o = {"request_id": "r", "query_sha256": "a" * 64, "expected_memory_ids": ["m1"], "top_k": 1, "retriever_id": "v", "retriever_version": "1", "hits": [], "usage": {"retrieval_calls": 1, "candidate_count": 0}}
    (folder / "o.json").write_text(json.dumps(o))
    assert cli.main(["retrieval-audit", "--observation", str(folder / "o.json"), "--policy", "any_expected", "--fail-on", "error"]) == 1
    assert json.loads(capsys.readouterr().out)["findings"][0]["memory_ids"] == ["m1"]


@pytest.mark.parametrize(
    "more",
    [["--checker", "all", "--output", "store.json"], ["--checker", "orphaned_provenance"], ["--checker", "all", "--semantic-model-id", "x"], ["--checker", "all", "--output", "o.x", "--sarif-output", "o.x"]],
)
def test_errors(folder, more, monkeypatch, capsys):
    monkeypatch.chdir(folder)
    before = (folder / "store.json").read_text()
    assert cli.main(["audit", "--store", "store.json", *more]) == 2
    assert "error" in capsys.readouterr().err and (folder / "store.json").read_text() == before
    assert cli.main(["audit", "--store", "none.json", "--checker", "stale_active"]) == 2
