"""Duplicates and replicas as memories arrive, from state that a batch's own claims touch.

The state of a claim is a few numbers, whatever the size of its group: a batch reads and writes the claims that it holds,
never the store. Results are changes: a row with change -1 takes back what was said of a claim, one with change 1 says
what holds now, so that the changes of all batches sum up to the batch check over everything so far. State lives in the
state store and its checkpoints, which survive lost executors; the RocksDB provider is needed.

Defined results: null text and null parts of a scope as in the checks; memories without a scope take no part; a batch
without rows changes nothing; ids are trusted to be new, as a store's constraint on them is not this check's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import SCOPE_DIMENSIONS
from ..operators import checks as ck

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GROUP = (*SCOPE_DIMENSIONS, "sha", "folded_length")
GROUPS = "user_id string, agent_id string, session_id string, sha string, folded_length int, id string, n long, is_exact boolean, change int"
CLAIMS = "dimension string, rule string, sha string, sources long, destinations long, replicas long, change int"


class _Duplicates(StatefulProcessor):
    """n, the first member until there is a second, the hash of its text, and whether all texts are equal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, first string, exact string, same boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, first, exact, same = self.seen.get() if self.seen.exists() else (0, None, None, True)
        before, out, group = (n, same), [], None
        for part in rows:
            group = tuple(part[list(_GROUP)].iloc[0])
            exact = part["exact"].iloc[0] if n == 0 else exact
            same = bool(same and (part["exact"] == exact).all())
            ids = ([first] if n == 1 else []) + part["id"].tolist()
            n += len(part)
            if n == 1:
                first = ids[0]
            else:
                out.append(pd.DataFrame({"id": ids, "n": None, "is_exact": None, "change": 1}))
        if group is None:
            return
        self.seen.update((n, first if n == 1 else None, exact, same))
        said = [(*before, -1)] * (before[0] > 1) + [(n, same, 1)] * (n > 1)
        for c, s, change in said:
            out.append(pd.DataFrame({"id": [None], "n": [c], "is_exact": [s], "change": [change]}))
        for frame in out:
            for name, value in zip(_GROUP, group, strict=True):
                frame[name] = value if value is None or value == value else None
            yield frame[[*_GROUP, "id", "n", "is_exact", "change"]]

    def close(self) -> None:
        pass


class _Replicas(StatefulProcessor):
    """How many sources and destinations a claim has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "sources long, destinations long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sources, destinations = before = self.seen.get() if self.seen.exists() else (0, 0)
        claim = None
        for part in rows:
            claim = tuple(part[["dimension", "rule", "sha"]].iloc[0])
            given = int(part["is_source"].sum())
            sources, destinations = sources + given, destinations + len(part) - given
        if claim is None:
            return
        self.seen.update((sources, destinations))
        said = [(*claim, *before, before[0] * before[1], -1)] * (before[0] * before[1] > 0) + [(*claim, sources, destinations, sources * destinations, 1)] * (sources * destinations > 0)
        if said:
            yield pd.DataFrame(said, columns=[c.split()[0] for c in CLAIMS.split(", ")])

    def close(self) -> None:
        pass


def _require_provider(df: DataFrame) -> None:
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")


def streamed_duplicates(memories: DataFrame) -> DataFrame:
    """Changes of duplicate groups over a stream of memories: rows with n and is_exact are about a group, rows with an id name a
    member (a group's first when it gets a second)."""
    _require_provider(memories)
    claims = ck._claims(memories).withColumn("claim", F.sha2(F.to_json(F.struct(*_GROUP)), 256))
    return claims.groupBy("claim").transformWithStateInPandas(_Duplicates(), GROUPS, "Append", "None")


def streamed_replicas(memories: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes of the number of replicas by claim over a stream of memories and a fixed policy."""
    _require_provider(memories)
    found = ck.principals(memories, ck.canonical_policy(rules)).select("dimension", "rule", "sha", "is_source")
    return found.withColumn("claim", F.sha2(F.to_json(F.struct("dimension", "rule", "sha")), 256)).groupBy("claim").transformWithStateInPandas(_Replicas(), CLAIMS, "Append", "None")
