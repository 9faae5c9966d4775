"""Files, exports, live scans and streams."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mnemora.functions.ids import canonical
from mnemora.model import OBSERVATIONS
from mnemora.sources import files, live, normalize
from mnemora.streaming.provenance import on_each_batch, streamed_issues

RECORD = {"id": "m1", "content": "User prefers Python.", "created_at": "2026-08-10T14:20:00+02:00", "source_refs": [{"transcript_id": "t1", "turn_idx": 4, "span": [0, 20]}], "scope": {"user_id": "u"}, "active": True, "note": {"k": [1, None]}}
YAML = """memories:
  - id: m1
    content: User prefers Python.
    created_at: "2026-08-10T14:20:00+02:00"
    source_refs:
      - {transcript_id: t1, turn_idx: 4, span: [0, 20]}
    scope: {user_id: u}
    active: true
    note: {k: [1, null]}
"""
MARKDOWN = """---
id: m1
created_at: "2026-08-10T14:20:00+02:00"
user_id: u
active: true
source_refs: [{transcript_id: t1, turn_idx: 4, span: [0, 20]}]
note: {k: [1, null]}
---

User prefers Python.

"""


def put(folder, name, content):
    p = folder / name
    p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(p)


def load(spark, path):
    return normalize.file_records(files.read_records(spark, path)).collect()


def test_formats_agree(spark, tmp_path):
    paths = [
        put(tmp_path, "a.json", {"memories": [RECORD]}), put(tmp_path, "b.JSON", RECORD), put(tmp_path, "c.json", [RECORD]), put(tmp_path, "d.jsonl", "\n" + json.dumps(RECORD) + "\n  \n"),
        put(tmp_path, "e.yaml", YAML), put(tmp_path, "f.yml", YAML), put(tmp_path, "g.md", MARKDOWN),
    ]
    seen = set()
    for p in paths:
        (r,) = load(spark, p)
        assert (r["id"], r["content"], r["created_at_text"], r["provenance_status"], r["active"], r["supersedes"]) == ("m1", "User prefers Python.", "2026-08-10T14:20:00+02:00", "declared", True, [])
        assert r["scope"]["user_id"] == "u" and r["source_refs"][0]["span"] == (0, 20)
        raw = json.loads(r["raw"])
        assert raw["source_metadata"] == {"note": {"k": [1, None]}}
        seen.add(raw["file_format"])
    assert seen == {"json", "jsonl", "yaml", "markdown"}


@pytest.mark.parametrize(
    ("name", "content"),
    [
        ("a.txt", "x"), ("b.json", "{"), ("c.json", "[1]"), ("d.json", '"text"'), ("e.jsonl", '{"content":"a"}\n{oops\n'), ("f.md", "no front matter"), ("g.md", "---\ncontent: x\n---\nbody"), ("h.md", "---\nid: x\n"),
        ("i.json", '{"content": 5}'), ("j.json", '{"content": "a", "active": "true"}'), ("k.json", '{"content": "a", "created_at": "2026-08-10T14:20:00"}'), ("l.json", '{"content": "a", "source_refs": {}}'),
        ("m.json", '{"content": "a", "scope": "u"}'), ("n.json", '{"content": "a", "provenance_status": "odd"}'),
    ],
)
def test_bad_files(spark, tmp_path, name, content):
    with pytest.raises(Exception):
        load(spark, put(tmp_path, name, content))


def test_errors_name_the_line(spark, tmp_path):
    with pytest.raises(files.SourceError, match="line 3"):
        files.read_records(spark, put(tmp_path, "e.jsonl", '{"content":"a"}\n\n{oops\n'))
    with pytest.raises(files.SourceError, match="does not exist"):
        files.read_records(spark, str(tmp_path / "none.json"))


def test_absent_is_not_null(spark, tmp_path):
    rows = [{"id": "a", "content": "x"}, {"id": "b", "content": "x", "source_refs": []}, {"id": "c", "content": "x", "user_id": "top", "scope": {"user_id": None}}, {"id": 7, "content": "x", "supersedes": ["a", "5"]}]
    got = {r["id"]: r for r in load(spark, put(tmp_path, "r.json", rows))}
    assert (got["a"]["provenance_status"], got["b"]["provenance_status"]) == ("unavailable", "known_absent")
    assert got["c"]["scope"]["user_id"] is None and got["7"]["supersedes"] == ["a", "5"]


def test_generated_ids(spark, tmp_path):
    refs = [{"transcript_id": "t2"}, {"transcript_id": "t1", "turn_idx": 1, "span": [0, 2]}, {"transcript_id": "t2"}]
    rows = [{"content": "é\"\n", "created_at": t, "source_refs": r, "scope": {"agent_id": "g"}} for t, r in (("2026-08-10T14:20:00+02:00", refs), ("2026-08-10T12:20:00Z", refs[::-1]), ("2026-08-10T12:20:00.5Z", []), (None, []))]
    got = [r["id"] for r in load(spark, put(tmp_path, "r.jsonl", "\n".join(map(json.dumps, rows))))]

    def want(at, refs):
        payload = {"adapter": "file", "content": 'é"\n', "created_at": at, "scope": {"user_id": None, "agent_id": "g", "session_id": None}, "source_refs": refs}
        return "file:" + sha256(canonical(payload).encode()).hexdigest()[:24]

    full = [{"transcript_id": "t1", "turn_idx": 1, "span": [0, 2]}, {"transcript_id": "t2", "turn_idx": None, "span": None}]
    full.sort(key=canonical)
    assert sorted(got) == sorted([want("2026-08-10T12:20:00Z", full)] * 2 + [want("2026-08-10T12:20:00.500000Z", []), want(None, [])])


def test_mem0(spark, tmp_path):
    rows = {"results": [{"id": 1, "memory": "x", "user_id": 5, "run_id": "r", "session_id": "s"}, {"id": "b", "memory": "y", "session_id": "s", "source_refs": []}]}
    got = {r["id"]: r for r in normalize.mem0_records(files.read_export(spark, put(tmp_path, "m.json", rows), "mem0"), {"user_id": "q", "agent_id": "g"}).collect()}
    assert tuple(got["1"]["scope"]) == ("5", "g", "r") and tuple(got["b"]["scope"]) == ("q", "g", "s")
    assert (got["1"]["provenance_status"], got["b"]["provenance_status"]) == ("unavailable", "known_absent")


def test_graphiti(spark, tmp_path):
    edges = [
        {"uuid": "a", "fact": "x", "group_id": "g", "episodes": ["e1", "e9", "e2"], "invalid_at": None, "fact_embedding": [1, 2.5]}, {"uuid": "b", "fact": "y", "group_id": "g"},
        {"uuid": "c", "fact": "z", "group_id": "g", "expired_at": "2026-01-01T00:00:00Z"},
    ]
    path = put(tmp_path, "g.json", {"edges": edges})
    found = normalize.graphiti_records(files.read_export(spark, path, "graphiti"), {"agent_id": "x"}, "user_id", {"e1": "t1", "e2": {"transcript_id": "t2", "turn_idx": 3}})
    got = {r["id"]: r for r in found.collect()}
    assert [got[k]["active"] for k in "abc"] == [True, None, False]
    assert [(r["transcript_id"], r["turn_idx"]) for r in got["a"]["source_refs"]] == [("t1", None), ("t2", 3)]
    assert (got["a"]["provenance_status"], got["b"]["provenance_status"], tuple(got["a"]["scope"])) == ("declared", "unavailable", ("g", "x", None))
    assert list(got["a"]["embedding"]) == [1.0, 2.5]
    with pytest.raises(Exception, match="conflicts"):
        normalize.graphiti_records(files.read_export(spark, path, "graphiti"), {"user_id": "other"}, "user_id").collect()


def test_letta(spark, tmp_path):
    export = {"blocks": [{"id": "b", "value": "core text", "embedding": [1.0]}], "passages": [{"id": "p", "text": "arch", "is_deleted": True, "embedding": [2.0]}, {"id": "q", "text": "arch", "active": None}]}
    got = {r["id"]: r for r in normalize.letta_records(files.read_export(spark, put(tmp_path, "l.json", export), "letta"), {"agent_id": "a"}).collect()}
    assert [(got[k]["active"], got[k]["embedding"]) for k in "bpq"] == [(True, None), (False, [2.0]), (None, None)]
    alone = normalize.letta_records(files.read_export(spark, put(tmp_path, "r.json", {"records": [{"id": "z", "memory_type": "core", "value": "v"}]}), "letta")).collect()
    assert [r["id"] for r in alone] == ["z"]


def test_transcripts_policy_observations(spark, tmp_path):
    t = {"schema_version": "0.1", "transcripts": [{"id": "a", "turns": [{"index": 4, "role": "user", "content": "hi", "timestamp": "2026-08-10T14:20:00+02:00"}]}, {"id": "b", "turns": []}]}
    known, turns = files.load_transcripts(spark, put(tmp_path, "t.json", t))
    assert {r["transcript_id"] for r in known.collect()} == {"a", "b"} and [(r["turn_idx"], r["content"]) for r in turns.collect()] == [(4, "hi")]
    rule = {"dimension": "user_id", "authoritative_source_principal": "a", "prohibited_destination_principals": ["b", "c"]}
    assert files.load_policy(spark, put(tmp_path, "p.json", {"schema_version": "0.1", "rules": [rule]})).count() == 2
    for bad in ({"rules": []}, {"rules": [rule | {"x": 1}]}, {"rules": [rule | {"authoritative_source_principal": 5}]}, {"rules": [rule | {"authoritative_source_principal": "b"}]}, {"schema_version": "9", "rules": [rule]}):
        with pytest.raises(Exception):
            files.load_policy(spark, put(tmp_path, "bad.json", bad)).collect()
    o = {"request_id": "r", "query_sha256": "a" * 64, "expected_memory_ids": ["m2", "m1"], "top_k": 3, "retriever_id": "v", "retriever_version": "1", "hits": [{"memory_id": "m1", "rank": 2}, {"memory_id": "m3", "rank": 1, "score": 0.5}], "usage": {"retrieval_calls": 0, "candidate_count": 7}}
    r = files.load_observations(spark, put(tmp_path, "o.json", o)).first()
    assert [h["rank"] for h in r["hits"]] == [1, 2] and r["expected_memory_ids"] == ["m1", "m2"] and r["retrieval_calls"] == 0
    with pytest.raises(files.SourceError) as e:
        files.load_observations(spark, put(tmp_path, "x.json", o | {"query_sha256": "SECRET"}))
    assert "SECRET" not in str(e.value)


def test_plain_values():
    from datetime import date
    from enum import Enum

    class Colour(Enum):
        RED = "red"

    assert files.plain({1: (date(2026, 1, 2), Colour.RED, None, True)}) == {"1": ["2026-01-02", "red", None, True]}
    for bad in (float("nan"), object()):
        with pytest.raises(files.SourceError):
            files.plain(bad)


class Mem0Client:
    def get_all(self, *, filters, page, page_size):
        rows = [{"id": f"m{i}", "memory": f"text {i}", "user_id": filters["user_id"]} for i in range(5)]
        part = rows[(page - 1) * page_size : page * page_size]
        return {"results": part, "next": page * page_size < len(rows) or None}


class Denied:
    def get_all(self, **_):
        raise type("AuthProblem", (Exception,), {})("no")


class Graph:
    def edges(self, groups, *, limit, after, with_embeddings):
        rows = [{"uuid": f"{i:02}", "fact": "f", "group_id": groups[0]} for i in range(6)]
        rest = [r for r in rows if after is None or r["uuid"] > after]
        if not rest:
            raise LookupError
        return rest[:limit]


class Letta:
    class Listing:
        def __init__(self, n, field):
            self.rows = [{"id": f"{i:04}", field: "x"} for i in range(n)]

        def list(self, agent, *, after, limit):
            return type("Page", (), {"items": [r for r in self.rows if after is None or r["id"] > after][:limit]})()

    def __init__(self):
        self.agents = type("Agents", (), {"blocks": self.Listing(3, "value"), "passages": self.Listing(401, "text")})()


def test_live_pages(spark):
    assert [r["id"] for r in live.mem0_pages(Mem0Client(), {"user_id": "u"}, 2)] == [f"m{i}" for i in range(5)]
    assert len(list(live.graph_pages(Graph(), ["g"], 3))) == 6 and len(list(live.graph_pages(Graph(), ["g"], 4))) == 6
    rows = list(live.letta_pages(Letta(), "a"))
    assert [sum(r["memory_type"] == t for r in rows) for t in ("core", "archival")] == [3, 401]
    for filters, size in (({"user_id": " "}, 10), ({"user_id": "u"}, 0), ({"user_id": "u"}, True), ({"user_id": "u"}, 201)):
        with pytest.raises(live.SourceError):
            live.check_mem0(filters, size)


def test_live_scan_on_executors(spark):
    found = live.live_records(spark, "mem0", Mem0Client, [{"filters": {"user_id": u}, "page_size": 2} for u in ("u", "v")], live.mem0_pages)
    got = normalize.mem0_records(found.select("v")).groupBy("scope.user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in got} == {"u": 5, "v": 5}
    with pytest.raises(Exception, match="authentication"):
        live.live_records(spark, "mem0", Denied, [{"filters": {"user_id": "u"}}], live.mem0_pages).collect()


def test_stream(spark, tmp_path):
    from mnemora.model import MEMORIES

    transcripts = spark.createDataFrame([("t1",)], "transcript_id string")
    turns = spark.createDataFrame([("t1", 0, "user", "hello")], "transcript_id string, turn_idx int, role string, content string")
    row = lambda i, t, k, s=None: (i, "c", None, None, None, None, [(t, k, s)], "declared", ("u", None, None), True, [], None, None)
    batch = spark.createDataFrame([row("a", "t1", 0), row("b", "no", 0), row("c", "t1", 3), row("d", "t1", 0, (0, 9))], MEMORIES)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MEMORIES).parquet(str(tmp_path / "in"))
    q = streamed_issues(stream, transcripts, turns).writeStream.format("memory").queryName("issues").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["id"], r["kind"]) for r in spark.table("issues").collect()} == {("b", "missing_transcript"), ("c", "missing_turn"), ("d", "invalid_span")}
    counts = []
    w = on_each_batch(stream, str(tmp_path / "store"), lambda df: counts.append(df.where(F.col("scope.user_id") == "u").count()))
    w.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert counts == [4]


def _store_file(path, **more):
    record = {"id": "a", "content": "text", "scope": {"user_id": "u"}, "source_refs": [{"transcript_id": "t", "turn_idx": 0, "span": [0, 1]}], "provenance_status": "declared", "embedding": [1, 0.5], "raw": {"k": 1}}
    store = {"schema_version": "0.1", "adapter": "file", "exported_at": "2024-01-02T03:04:05+00:00", "memories": [record | more]}
    path.write_text(json.dumps(store))
    return str(path)


def test_strict_store(spark, tmp_path):
    memories, adapter = files.load_store(spark, _store_file(tmp_path / "s.json"))
    r = memories.first()
    assert adapter == "file" and (r["id"], r["scope"]["user_id"], list(r["embedding"]), r["source_refs"][0]["span"]["end"]) == ("a", "u", [1.0, 0.5], 1)
    assert files.store_envelope(spark, str(tmp_path / "s.json")) == {"adapter": "file", "exported_at": "2024-01-02T03:04:05Z"}


@pytest.mark.parametrize(
    "more",
    [
        {"odd": 1}, {"scope": {"team": "x"}}, {"scope": {"user_id": 7}}, {"scope": "u"}, {"id": 7}, {"id": None}, {"content": 5}, {"content": None}, {"active": "yes"}, {"supersedes": "a"}, {"supersedes": [1]},
        {"embedding": ["x"]}, {"raw": "r"}, {"created_at": 5}, {"created_at": "2024-01-01T00:00:00"}, {"source_refs": [{"transcript_id": "t", "page": 1}]}, {"source_refs": [{"turn_idx": 1}]}, {"source_refs": [{"transcript_id": 3}]},
        {"provenance_status": "odd"},
    ],
)
def test_store_refuses(spark, tmp_path, more):
    with pytest.raises(Exception) as caught:
        memories, _ = files.load_store(spark, _store_file(tmp_path / "s.json", **more))
        memories.collect()
    assert "ParseException" not in str(type(caught.value)) and "AnalysisException" not in str(type(caught.value))


def test_store_envelope_refuses(spark, tmp_path):
    for more in ({"odd": 1}, {"adapter": " "}, {"adapter": 5}, {"exported_at": "yesterday"}, {"exported_at": "2024-01-01T00:00:00"}, {"schema_version": "9"}):
        (tmp_path / "s.json").write_text(json.dumps({"schema_version": "0.1", "adapter": "file", "memories": []} | more))
        with pytest.raises(Exception):
            files.load_store(spark, str(tmp_path / "s.json"))


@pytest.mark.parametrize("bad", [{"extra": 1}, {"id": 5}, {"id": " "}, {"turns": None}, {"turns": [{"index": 0, "role": "user"}]}, {"turns": [{"index": "0", "role": "user", "content": "x"}]}, {"turns": [{"index": 0, "role": "user", "content": "x", "odd": 1}]}, {"turns": [{"index": 1, "role": "u", "content": "x"}, {"index": 0, "role": "u", "content": "y"}]}])
def test_transcripts_refuse(spark, tmp_path, bad):
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": "0.1", "transcripts": [{"id": "t", "turns": [{"index": 0, "role": "user", "content": "x"}]} | bad]}))
    with pytest.raises(Exception):
        [df.collect() for df in files.load_transcripts(spark, str(tmp_path / "t.json"))]


def test_errors_name_the_record(spark, tmp_path):
    from mnemora.sources import normalize

    (tmp_path / "x.json").write_text(json.dumps({"memories": [{"content": "a"}, {"content": "b"}, {"content": 5}]}))
    with pytest.raises(Exception, match="record 2 is malformed"):
        normalize.file_records(files.read_records(spark, str(tmp_path / "x.json"))).collect()


def test_written_transcripts_come_back(spark, tmp_path):
    from mnemora.plans import sinks

    given = {"schema_version": "0.1", "transcripts": [{"id": "a", "metadata": {"k": [1]}, "turns": []}, {"id": "b", "metadata": {}, "turns": [{"index": i, "role": "user", "content": f"é {i}", "timestamp": "2024-01-01T00:00:00Z", "metadata": {}} for i in range(3)]}]}
    (tmp_path / "t.json").write_text(json.dumps(given))
    sinks.write_transcripts(*files.load_transcripts(spark, str(tmp_path / "t.json")), str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == given
    assert sum(df.count() for df in files.load_transcripts(spark, str(tmp_path / "o.json"))) == 5


def test_other_writers(spark):
    from mnemora.operators import checks as ck
    from mnemora.plans import sinks

    rules = spark.createDataFrame([(0, "user_id", "b", "z"), (1, "user_id", "a", "y"), (2, "user_id", "b", "c")], "rule_idx int, dimension string, source_principal string, destination_principal string")
    assert [r["prohibited_destination_principals"] for r in json.loads(sinks.policy_json(rules))["rules"]] == [["y"], ["c", "z"]]
    seen = spark.createDataFrame([("r", "0" * 64, ["m2", "m1"], 2, "v", "1", [("m1", 1, 0.5), ("m9", 2, None)], 1, 2)], OBSERVATIONS)
    (line,) = sinks.observation_lines(seen)
    assert json.loads(line)["expected_memory_ids"] == ["m1", "m2"] and json.loads(line)["usage"] == {"candidate_count": 2, "retrieval_calls": 1}
    (line,) = sinks.assessment_lines(ck.retrieval_sufficiency(seen, "any_expected"))
    assert json.loads(line)["sufficient"] is True and json.loads(line)["missing_expected_memory_ids"] == ["m2"]
    memories = spark.createDataFrame([("m", "declared", [("t", 0, (1, 3)), ("t", 7, None), ("u", None, None)])], "id string, provenance_status string, source_refs array<struct<transcript_id:string,turn_idx:int,span:struct<start:int,end:int>>>")
    talks, turns = spark.createDataFrame([("t",)], "transcript_id string"), spark.createDataFrame([("t", 0, "user", "hello")], "transcript_id string, turn_idx int, role string, content string")
    (line,) = sinks.resolution_lines(memories, talks, turns)
    assert [s["text"] for s in json.loads(line)["segments"]] == ["el"] and [i["kind"] for i in json.loads(line)["issues"]] == ["missing_turn", "missing_transcript"]


def test_registered_sources(spark):
    from mnemora.sources import live, normalize

    class Own:
        name = "own-store"

        def records(self, spark):
            return spark.sql("""SELECT parse_json('{"id": "a", "content": "x"}') AS v, 'json' AS file_format""")

        memories = staticmethod(normalize.file_records)

    live.register_source(Own())
    assert [r["id"] for r in live.scan(spark, "own-store").collect()] == ["a"]
    for bad in (Own(), object()):
        with pytest.raises(files.SourceError):
            live.register_source(bad)
    with pytest.raises(files.SourceError):
        live.scan(spark, "none")


def test_public_names():
    import mnemora

    for name in mnemora.__all__:
        assert getattr(mnemora, name) is not None
    with pytest.raises(AttributeError):
        mnemora.nothing  # noqa: B018


def test_model_judge_says_what_is_wrong(spark):
    from types import SimpleNamespace as N

    from mnemora.functions import judges

    names = {0: "ENTAILMENT", 1: "neutral", 2: "contradiction"}
    assert judges.label_order(N(id2label=names, label2id={v: k for k, v in names.items()})) == ["entailment", "neutral", "contradiction"]
    assert judges.label_order(N(label2id={"neutral": 2, "entailment": 0, "contradiction": 1}))[2] == "neutral"
    for bad in (N(), N(id2label={0: "a", 1: "b", 2: "c"}), N(id2label={True: "neutral", 1: "entailment", 2: "contradiction"}), N(id2label=names, label2id={"neutral": 0, "entailment": 1, "contradiction": 2}), N(label2id={"neutral": 0, "entailment": 0, "contradiction": 1})):
        with pytest.raises(judges.ModelConfigError):
            judges.label_order(bad)
    assert judges.input_limit(N(model_max_length=512), N(max_position_embeddings=1024), 4096) == 512
    with pytest.raises(judges.ModelConfigError):
        judges.input_limit(N(), N(), 4096)
    judge = judges.ModelJudge("nowhere", "id", "version", revision="pinned")
    with pytest.raises(Exception, match="torch and transformers"):
        judges.with_judgment(spark.createDataFrame([("a", "b")], "premise string, content string"), judge).collect()
