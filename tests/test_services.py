"""Services as data sources: options, scans, credentials, and streams that follow a cursor across restarts."""

import json

import pytest

from mnemora.sources import live, normalize, services


@pytest.fixture(scope="module")
def registered(spark):
    services.register(spark)
    return spark


def read(spark, name, scans, connect, **options):
    return spark.read.format(name).options(connect=f"tests.service_clients:{connect}", scans=json.dumps(scans), **options)


def test_a_partition_for_each_scan(registered):
    found = read(registered, "mem0_memories", [{"filters": {"user_id": u}, "page_size": 2} for u in "uvw"], "Mem0").load()
    assert found.rdd.getNumPartitions() == 3
    got = normalize.mem0_records(services.records(found).select("v")).groupBy("scope.user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in got} == {"u": 5, "v": 5, "w": 5}


@pytest.mark.parametrize(
    ("scans", "options"),
    [
        ([], {}), ([{"filters": {}}], {}), ([{"filters": {"user_id": "u"}, "page_size": 0}], {}), ([{"filters": {"user_id": "u"}, "pages": 1}], {}), ([1], {}), ([{"filters": {"user_id": "u"}}], {"connect": "os"}),
        ([{"filters": {"user_id": "u"}}], {"connect": "os:not a name"}), ([{"filters": {"user_id": "u"}}], {"token": "abc"}), ([{"filters": {"user_id": "u"}}], {"scans": "{"}),
    ],
)
def test_options_are_checked_first(scans, options):
    with pytest.raises(live.SourceError):
        services.Mem0Source({"connect": "tests.service_clients:Mem0", "scans": json.dumps(scans)} | options)


def test_refused_credentials(registered):
    with pytest.raises(Exception, match="authentication"):
        read(registered, "mem0_memories", [{"filters": {"user_id": "u"}}], "Denied").load().collect()
    with pytest.raises(Exception, match="MNEMORA_NO_SUCH_SECRET"):
        read(registered, "mem0_memories", [{"filters": {"user_id": "u"}}], "Mem0", secret="MNEMORA_NO_SUCH_SECRET").load().collect()


class Growing:
    """A graph in this process whose edges can be added to."""

    def __init__(self, n):
        self.n = n

    def edges(self, groups, *, limit, after, with_embeddings):
        rest = [{"uuid": f"{i:04}", "group_id": groups[0]} for i in range(self.n) if after is None or f"{i:04}" > after]
        if not rest:
            raise LookupError
        return rest[:limit]


def test_offsets_follow_the_cursor(monkeypatch):
    graph = Growing(7)
    monkeypatch.setattr(services, "_connector", lambda text, secret: lambda: graph)
    source = services.GraphSource({"connect": "a:b", "scans": json.dumps([{"group_ids": ["g"], "page_size": 3}, {"group_ids": ["h"], "page_size": 4}])})
    stream = source.streamReader(None)
    start = stream.initialOffset()
    first = stream.latestOffset()
    assert start == {"0": "", "1": ""} and first == {"0": "0006", "1": "0006"}
    ids = lambda a, b: [[json.loads(r[0])["uuid"] for r in stream.read(p)] for p in stream.partitions(a, b)]
    assert ids(start, first) == [[f"{i:04}" for i in range(7)]] * 2 and stream.partitions(first, first) == []
    graph.n = 12
    # what is read again is the same, whatever came since
    assert ids(start, first) == [[f"{i:04}" for i in range(7)]] * 2
    again = services.GraphSource(dict(source.options)).streamReader(None)
    second = again.latestOffset()
    assert second == {"0": "0011", "1": "0011"} and ids(first, second) == [[f"{i:04}" for i in range(7, 12)]] * 2
    with pytest.raises(live.SourceError):
        services.Mem0Source({"connect": "a:b", "scans": '[{"filters": {"user_id": "u"}}]'}).streamReader(None)


def test_letta_pages_by_cursor(monkeypatch):
    from .test_sources import Letta

    monkeypatch.setattr(services, "_connector", lambda text, secret: Letta)
    options = {"connect": "a:b", "scans": '[{"agent_id": "a"}]'}
    rows = list(services.LettaSource(options).reader(None).read(services.Scan(0, {"agent_id": "a"})))
    assert [sum(t == kind for _, t in rows) for kind in ("core", "archival")] == [3, 401]
    stream = services.LettaPassages(options).streamReader(None)
    end = stream.latestOffset()
    assert end == {"0": "0400"} and len(list(stream.read(stream.partitions({"0": "0399"}, end)[0]))) == 1 and len(list(stream.read(stream.partitions(stream.initialOffset(), end)[0]))) == 401


def test_a_stream_goes_on_where_it_was(registered, tmp_path):
    counted = tmp_path / "edges"
    counted.write_text("5")
    spark, out, saved = registered, str(tmp_path / "out"), str(tmp_path / "saved")

    def run():
        options = {"connect": "tests.service_clients:file_graph", "scans": json.dumps([{"group_ids": [str(counted)], "page_size": 2}])}
        stream = spark.readStream.format("graphiti_memories").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", saved).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(json.loads(r["value"])["uuid"] for r in spark.read.schema("value string, memory_type string").parquet(out).collect())

    assert run() == [f"{i:04}" for i in range(5)]
    counted.write_text("9")
    assert run() == [f"{i:04}" for i in range(9)]
