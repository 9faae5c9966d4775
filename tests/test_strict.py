"""Loaders that take nothing loosely: recorded retrievals, policies and file records."""

import json

import pytest

from mnemora.sources import files, normalize

OBSERVATION = {
    "request_id": "r", "query_sha256": "a" * 64, "expected_memory_ids": ["m2", "m1"], "top_k": 3, "retriever_id": "v", "retriever_version": "1",
    "hits": [{"memory_id": "m1", "rank": 2, "score": None}, {"memory_id": "m3", "rank": 1, "score": 0.5}], "usage": {"retrieval_calls": 1, "candidate_count": 2},
}


def put(folder, name, value):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def hit(**changed):
    return {"hits": [{k: v for k, v in ({"memory_id": "m1", "rank": 1, "score": 0.5} | changed).items() if v is not ...}]}


BROKEN = {
    "top_k text": {"top_k": "3"}, "top_k zero": {"top_k": 0}, "top_k true": {"top_k": True}, "unknown field": {"query": "SECRET"}, "no usage": {"usage": ...}, "usage null": {"usage": None},
    "usage unknown": {"usage": {"retrieval_calls": 1, "candidate_count": 2, "cost": 3}}, "usage partly": {"usage": {"retrieval_calls": 1}}, "negative": {"usage": {"retrieval_calls": 1, "candidate_count": -5}},
    "calls text": {"usage": {"retrieval_calls": "1", "candidate_count": 2}}, "no rank": hit(rank=...), "null rank": hit(rank=None), "rank true": hit(rank=True), "rank zero": hit(rank=0), "rank text": hit(rank="1"),
    "blank hit": hit(memory_id=" "), "hit number": hit(memory_id=1), "no hit id": hit(memory_id=...), "score text": hit(score="0.5"), "score true": hit(score=True), "hit unknown": hit(text="SECRET"), "hit list": {"hits": [[1]]},
    "expected number": {"expected_memory_ids": [1]}, "expected none": {"expected_memory_ids": []}, "expected blank": {"expected_memory_ids": [" "]}, "expected twice": {"expected_memory_ids": ["a", "a"]}, "expected null": {"expected_memory_ids": None},
    "hits null": {"hits": None}, "hits missing": {"hits": ...}, "id number": {"request_id": 5}, "id blank": {"retriever_id": " "}, "hash upper": {"query_sha256": "A" * 64}, "hash short": {"query_sha256": "SECRET"}, "no version": {"retriever_version": ...},
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_observations(spark, tmp_path, name):
    value = {k: v for k, v in (OBSERVATION | BROKEN[name]).items() if v is not ...}
    for path in (put(tmp_path, "o.json", value), put(tmp_path, "o.jsonl", json.dumps(OBSERVATION) + "\n" + json.dumps(value) + "\n")):
        with pytest.raises(files.SourceError) as e:
            files.load_observations(spark, path)
        assert "SECRET" not in str(e.value)


def test_valid_observations(spark, tmp_path):
    integer_score = OBSERVATION | {"request_id": "s", "hits": [{"memory_id": "m1", "rank": 1, "score": 1}, {"memory_id": "m2", "rank": 2}]}
    empty = OBSERVATION | {"request_id": "t", "hits": []}
    got = {r["request_id"]: r for r in files.load_observations(spark, put(tmp_path, "o.jsonl", "\n".join(map(json.dumps, (OBSERVATION, integer_score, empty))))).collect()}
    assert [tuple(h) for h in got["r"]["hits"]] == [("m3", 1, 0.5), ("m1", 2, None)] and got["r"]["expected_memory_ids"] == ["m1", "m2"]
    assert [tuple(h) for h in got["s"]["hits"]] == [("m1", 1, 1.0), ("m2", 2, None)] and got["t"]["hits"] == []


RULE = {"dimension": "user_id", "authoritative_source_principal": "a", "prohibited_destination_principals": ["b", "c"]}


@pytest.mark.parametrize(
    "changed",
    [
        {"prohibited_destination_principals": []}, {"prohibited_destination_principals": None}, {"prohibited_destination_principals": ...}, {"prohibited_destination_principals": [1, True]}, {"prohibited_destination_principals": ["b", None]},
        {"prohibited_destination_principals": ["b", "b"]}, {"prohibited_destination_principals": [" "]}, {"prohibited_destination_principals": "b"}, {"prohibited_destination_principals": ["a"]},
        {"dimension": "session_id"}, {"dimension": 1}, {"dimension": ...}, {"authoritative_source_principal": None}, {"authoritative_source_principal": " "}, {"x": 1},
    ],
)
def test_broken_rules(spark, tmp_path, changed):
    """Beside a valid rule, so that a rule which vanishes would go unnoticed."""
    bad = {k: v for k, v in (RULE | changed).items() if v is not ...}
    with pytest.raises(Exception):
        files.load_policy(spark, put(tmp_path, "p.json", {"rules": [RULE | {"authoritative_source_principal": "z"}, bad]})).collect()


@pytest.mark.parametrize("policy", [{}, {"rules": None}, {"rules": {}}, {"rules": [1]}, {"rules": [RULE], "extra": 1}, []])
def test_broken_policies(spark, tmp_path, policy):
    with pytest.raises(Exception):
        files.load_policy(spark, put(tmp_path, "p.json", policy)).collect()


RECORD = {"id": "a", "content": "x"}


@pytest.mark.parametrize(
    "changed",
    [
        {"supersedes": [1]}, {"supersedes": "b"}, {"scope": {"user_id": 5}}, {"scope": {"tenant": "t"}}, {"scope": "u"}, {"scope": None}, {"user_id": 5}, {"source_refs": [{"transcript_id": "t", "page": 1}]}, {"source_refs": [{"turn_idx": 1}]},
        {"source_refs": [{"transcript_id": 1}]}, {"source_refs": [{"transcript_id": "t", "turn_idx": True}]}, {"source_refs": [{"transcript_id": "t", "turn_idx": 1, "span": [1]}]}, {"source_refs": [{"transcript_id": "t", "turn_idx": 1, "span": ["1", 2]}]},
        {"source_refs": {}}, {"embedding": ["1"]}, {"embedding": 1}, {"active": "yes"}, {"content": 7}, {"raw": "text"}, {"raw": None}, {"provenance_status": "odd"},
    ],
)
def test_broken_file_records(spark, tmp_path, changed):
    with pytest.raises(Exception):
        normalize.file_records(files.read_records(spark, put(tmp_path, "m.json", [RECORD | changed]))).collect()


def test_valid_file_records(spark, tmp_path):
    given = [
        RECORD | {"scope": {"user_id": "u", "agent_id": None}, "agent_id": "beside", "session_id": "s", "mood": 3},
        {"id": "b", "content": "y", "source_refs": [{"transcript_id": "t", "turn_idx": 1, "span": [0, 2]}, {"transcript_id": "t"}], "supersedes": ["a"], "embedding": [1, 0.5], "active": None},
    ]
    got = {r["id"]: r for r in normalize.file_records(files.read_records(spark, put(tmp_path, "m.json", given))).collect()}
    # a key of the scope wins, even where it is null
    assert tuple(got["a"]["scope"]) == ("u", None, "s") and json.loads(got["a"]["raw"])["source_metadata"] == {"mood": 3}
    assert [tuple(r) for r in got["b"]["source_refs"]] == [("t", 1, (0, 2)), ("t", None, None)] and list(got["b"]["embedding"]) == [1.0, 0.5] and got["b"]["supersedes"] == ["a"]
