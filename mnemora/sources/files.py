"""Files of memories, transcripts, policies and recorded retrievals.

Readers give one row per record, as canonical JSON text in `record`; `normalize` turns records into
the memory schema. JSON and JSON lines stay inside the JVM as variants; only YAML and Markdown, which
Spark cannot read, are parsed in Python, a file at a time. A path may be a file, a folder or a glob.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import PurePath
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..model import OBSERVATIONS, SCHEMA_VERSION
from ..operators import constraints
from ..scratch import written

FORMATS = {".json": "json", ".jsonl": "jsonl", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".markdown": "markdown"}
#: Where an export keeps its records, first match wins.
ENVELOPES = {"mem0": ("results", "memories"), "graphiti": ("edges", "results"), "letta": ("records",)}


class SourceError(ValueError):
    """A file or record is not of the form that its format asks for."""


def fail(text: str | Column) -> Column:
    return F.raise_error(F.lit(text) if isinstance(text, str) else text)


def format_of(path: str) -> str:
    suffix = PurePath(path.rstrip("*")).suffix.lower()
    if suffix not in FORMATS:
        raise SourceError(f"unsupported file extension {suffix!r}; expected one of {', '.join(FORMATS)}")
    return FORMATS[suffix]


def _exists(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise SourceError(f"source does not exist: {path}")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    _exists(spark, path)
    return spark.read.text(path, wholetext=True)


def as_variant(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNull() & text.isNotNull(), fail("could not parse the source as JSON")).otherwise(parsed)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ..., VOID for null; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A\w+", 0)


def at(v: Column, key: str) -> Column:
    """The value under a key as a variant; null where the key is absent, a null variant where it is null."""
    return F.variant_get(v, f"$.{key}", "variant")


def _exploded(df: DataFrame, v: Column, keys: tuple[str, ...]) -> DataFrame:
    """A row per record: of the list under the first key present, of a list, or of a lone object."""
    inner = v
    for key in reversed(keys):
        inner = F.when((kind(v) == "OBJECT") & at(v, key).isNotNull(), at(v, key)).otherwise(inner)
    alone = F.when(kind(inner) == "OBJECT", F.array(inner))
    many = F.when(kind(inner) == "ARRAY", F.variant_get(inner, "$", "array<variant>"))
    rows = df.select(F.posexplode(F.coalesce(alone, many, fail("a source must hold a record, a list of records, or an envelope of one"))).alias("n", "v"))
    return rows.select("n", F.when(kind(F.col("v")) == "OBJECT", F.col("v")).otherwise(fail(F.concat(F.lit("record "), F.col("n").cast("string"), F.lit(" is malformed: it must be an object")))).alias("v"))


def _parsed(df: DataFrame, parse: Callable[[str], Any]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [json.dumps(plain(parse(x)), ensure_ascii=False, allow_nan=False) for x in b["value"]]})

    return df.mapInPandas(run, "value string")


def plain(value: Any) -> Any:
    """JSON-compatible data of what SDKs and YAML give; NaN, infinity and unknown types are errors."""
    import math
    from collections.abc import Mapping
    from datetime import date, datetime
    from enum import Enum

    match value:
        case None | bool() | int() | str():
            return value.value if isinstance(value, Enum) else value
        case float():
            if not math.isfinite(value):
                raise SourceError("values must be finite")
            return value
        case datetime() | date():
            return value.isoformat()
        case Enum():
            return plain(value.value)
        case PurePath():
            return str(value)
        case Mapping():
            return {str(k): plain(v) for k, v in value.items()}
        case list() | tuple():
            return [plain(v) for v in value]
    raise SourceError(f"a value of type {type(value).__name__} has no JSON form")


def parse_yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def parse_markdown(text: str) -> dict:
    """Front matter between lines of `---`, then the content, whose outer line ends go."""
    lines = text.splitlines(keepends=True)
    marks = [i for i, line in enumerate(lines) if line.strip() == "---"][:2]
    if len(marks) < 2 or marks[0] != 0:
        raise SourceError("a Markdown memory begins with front matter between lines of '---'")
    record = parse_yaml("".join(lines[1 : marks[1]])) or {}
    if not isinstance(record, dict):
        raise SourceError("front matter must be an object")
    if "content" in record:
        raise SourceError("content belongs in the body, not in the front matter")
    return record | {"content": "".join(lines[marks[1] + 1 :]).strip("\r\n")}


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    _exists(spark, path)
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    parsed = F.try_parse_json("value")
    bad = lines.where(parsed.isNull() | (kind(parsed) != "OBJECT"))
    if not bad.isEmpty():
        numbered = _whole(spark, path).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("n", "value")).where(~is_blank(F.col("value")))
        first = numbered.where(parsed.isNull() | (kind(parsed) != "OBJECT")).agg(F.min("n").alias("n")).first()["n"]
        raise SourceError(f"line {first + 1} is not a JSON object")
    return lines.select(parsed.alias("v"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(v, file_format): the memory records of a file, as variants."""
    fmt = format_of(path)
    if fmt == "jsonl":
        rows = _json_lines(spark, path)
    else:
        whole = _whole(spark, path)
        if fmt != "json":
            whole = _parsed(whole, parse_yaml if fmt == "yaml" else parse_markdown)
        rows = _exploded(whole, as_variant("value"), ("memories",))
    return rows.withColumn("file_format", F.lit(fmt))


def read_export(spark: SparkSession, path: str, adapter: str) -> DataFrame:
    """(v): the records of another store's export, JSON or YAML; letta's blocks and passages get their
    memory_type."""
    fmt = format_of(path)
    if fmt not in ("json", "yaml"):
        raise SourceError("exports must be JSON or YAML")
    whole = _whole(spark, path)
    whole = whole if fmt == "json" else _parsed(whole, parse_yaml)
    v = as_variant("value")
    if adapter != "letta":
        return _exploded(whole, v, ENVELOPES[adapter])
    parts = []
    for key, memory_type in (("blocks", "core"), ("passages", "archival")):
        items = at(v, key)
        checked = F.when(items.isNotNull() & (kind(items) != "ARRAY"), fail(f"{key} must be a list")).otherwise(F.variant_get(items, "$", "array<variant>"))
        rows = whole.where(kind(v) == "OBJECT").select(F.posexplode(checked).alias("n", "v"))
        parts.append(rows.select("n", F.when(kind(F.col("v")) == "OBJECT", F.col("v")).otherwise(fail(f"{key} holds something else than objects")).alias("v"), F.lit(memory_type).alias("memory_type")))
    rest = whole.where((kind(v) != "OBJECT") | (at(v, "blocks").isNull() & at(v, "passages").isNull()))
    others = _exploded(rest, v, ENVELOPES["letta"])
    return parts[0].unionByName(parts[1]).unionByName(others.withColumn("memory_type", F.variant_get("v", "$.memory_type", "string")))


# --- normalised files -----------------------------------------------------------------------------


def _only(v: Column, known: tuple[str, ...], what: str) -> Column:
    """v, an object without other fields than known."""
    extra = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, known)))
    wrong = F.when(F.coalesce(kind(v) != "OBJECT", F.lit(True)), fail(f"{what} must be an object"))
    unknown = F.when(F.size(extra) > 0, fail(F.concat(F.lit(f"{what} has unknown fields: "), F.array_join(extra, ", "))))
    return F.coalesce(wrong, unknown, v)


_KINDS = {"string": ("STRING",), "int": ("BIGINT",), "bigint": ("BIGINT",), "boolean": ("BOOLEAN",), "array<variant>": ("ARRAY",), "variant": ("OBJECT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}


def strict(v: Column, key: str, type_: str, what: str, required: bool = False) -> Column:
    """The value under a key, of exactly that type; null where it is absent or null, unless it is required."""
    found = at(v, key)
    absent = found.isNull() | (kind(found) == "VOID")
    value = F.when(~kind(found).isin(*_KINDS[type_]), fail(f"{what}: '{key}' must be of type {type_.replace('variant', 'object').replace('array<object>', 'list')}")).otherwise(F.variant_get(found, "$", type_))
    return F.when(absent, fail(f"{what} needs the field '{key}'") if required else F.lit(None)).otherwise(value)


def strict_list(v: Column, key: str, type_: str, what: str) -> Column:
    """The list under a key, every element of exactly that type; an empty one where it is absent."""
    items = strict(v, key, "array<variant>", what)
    checked = F.transform(items, lambda x: F.when(kind(x).isin(*_KINDS[type_]), F.variant_get(x, "$", type_)).otherwise(fail(f"{what}: '{key}' must hold values of type {type_}")))
    return checked


def _versioned(v: Column, what: str) -> Column:
    return F.when(~F.coalesce(F.variant_get(v, "$.schema_version", "string"), F.lit(SCHEMA_VERSION)).eqNullSafe(SCHEMA_VERSION), fail(f"{what}: unsupported schema_version")).otherwise(v)


def _store(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select(_versioned(_only(as_variant("value"), ("schema_version", "adapter", "exported_at", "memories"), "the store"), "the store").alias("v"))


def store_envelope(spark: SparkSession, path: str) -> dict[str, str | None]:
    """adapter and exported_at of a normalised store file; exported_at is a time with a zone, or null."""
    row = _store(spark, path).select(strict(F.col("v"), "adapter", "string", "the store", required=True).alias("adapter"), zulu(strict(F.col("v"), "exported_at", "string", "the store")).alias("exported_at")).first()
    if not row["adapter"].strip():
        raise SourceError("the store's adapter must not be blank")
    return row.asDict()


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(memories, adapter) of a normalised store file; unknown fields, values of another type and what breaks a
    constraint are errors."""
    from .normalize import normalized_records

    adapter = store_envelope(spark, path)["adapter"]
    rows = _store(spark, path).select(F.posexplode(strict(F.col("v"), "memories", "array<variant>", "the store")).alias("n", "v"))
    memories = written(normalized_records(rows))  # parsed once, whatever reads it
    constraints.require_valid_memories(memories)
    return memories, adapter


def load_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(transcripts, turns); a transcript may have no turns, which come in the order of their index. Unknown
    fields and values of another type are errors."""
    v = _versioned(_only(as_variant("value"), ("schema_version", "transcripts"), "the transcript set"), "the transcript set")
    each = _whole(spark, path).select(F.explode(strict(v, "transcripts", "array<variant>", "the transcript set")).alias("t")).select(_only(F.col("t"), ("id", "turns", "metadata"), "a transcript").alias("v"))
    metadata = lambda c, what: F.to_json(F.coalesce(strict(F.col(c), "metadata", "variant", what), F.parse_json(F.lit("{}"))))
    identity = strict(F.col("v"), "id", "string", "a transcript", required=True)
    known = each.select(identity.alias("transcript_id"), metadata("v", "a transcript").alias("metadata"))
    t = each.select(identity.alias("transcript_id"), F.posexplode(strict(F.col("v"), "turns", "array<variant>", "a transcript", required=True)).alias("place", "t"))
    t = t.select("transcript_id", "place", _only(F.col("t"), ("index", "role", "content", "timestamp", "metadata"), "a turn").alias("t"))
    get = lambda key, type_, **more: strict(F.col("t"), key, type_, "a turn", **more)
    turns = t.select(
        "transcript_id", get("index", "int", required=True).alias("turn_idx"), get("role", "string", required=True).alias("role"), get("content", "string", required=True).alias("content"),
        zulu(get("timestamp", "string")).alias("timestamp_text"), metadata("t", "a turn").alias("metadata"), "place",
    )
    known, turns = written(known), written(turns)
    blank = known.where(is_blank(F.col("transcript_id"))).select(F.col("transcript_id").alias("id"), F.lit("id_blank").alias("violated"))
    constraints.require("transcripts", constraints.duplicate_ids(known, "transcript_id").select("id", F.lit("id_repeated").alias("violated")).unionByName(blank))
    constraints.require("turns", constraints.turn_violations(turns))
    before = F.lag("turn_idx").over(Window.partitionBy("transcript_id").orderBy("place"))
    constraints.require("turns", turns.withColumn("before", before).where("turn_idx <= before").select(F.col("transcript_id").alias("id"), F.lit("not_in_order").alias("violated")))
    return known, turns.drop("place")


_RULE = ("dimension", "authoritative_source_principal", "prohibited_destination_principals")


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a scope policy, one destination a row. Rules are checked before their destinations become rows, so that none can
    vanish: fields of another type, unknown fields, and rules without destinations or with repeated ones are errors."""
    v = _versioned(_only(as_variant("value"), ("schema_version", "rules"), "the policy"), "the policy")
    each = _whole(spark, path).select(F.posexplode(strict(v, "rules", "array<variant>", "the policy", required=True)).alias("rule_idx", "r")).select("rule_idx", _only(F.col("r"), _RULE, "a rule").alias("r"))
    given = strict_list(F.col("r"), _RULE[2], "string", "a rule")
    checked = F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) == 0, fail("a rule needs a destination")).when(F.size(F.array_distinct(given)) < F.size(given), fail("a rule's destinations must be unique")).otherwise(given)
    rules = each.select("rule_idx", *(strict(F.col("r"), f, "string", "a rule", required=True).alias(n) for f, n in zip(_RULE, ("dimension", "source_principal"), strict=False)), F.explode(checked).alias("destination_principal"))
    if rules.isEmpty():
        raise SourceError("a policy needs a rule with a destination")
    constraints.require("policy", constraints.rule_violations(rules))
    return rules


_OBSERVATION = ("request_id", "query_sha256", "expected_memory_ids", "top_k", "retriever_id", "retriever_version", "hits", "usage")
_HIT, _USAGE = ("memory_id", "rank", "score"), ("retrieval_calls", "candidate_count")


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Recorded retrievals: a file of one object, or JSON lines of many. Every field must be there, of exactly its type, and no other;
    scores may be null. Errors never show the input."""
    rows = _json_lines(spark, path) if format_of(path) == "jsonl" else _whole(spark, path).select(as_variant("value").alias("v"))
    rows = rows.select(_only(F.col("v"), _OBSERVATION, "the observation").alias("v"))
    get = lambda key, type_="string": strict(F.col("v"), key, type_, "the observation", required=True)
    hits = F.transform(get("hits", "array<variant>"), lambda h: _only(h, _HIT, "a hit"))
    hit = F.transform(hits, lambda h: F.struct(
        strict(h, "memory_id", "string", "a hit", required=True).alias("memory_id"), strict(h, "rank", "int", "a hit", required=True).alias("rank"), strict(h, "score", "double", "a hit").alias("score"),
    ))
    usage = _only(get("usage", "variant"), _USAGE, "the usage")
    expected = F.when(get("expected_memory_ids", "array<variant>").isNotNull(), strict_list(F.col("v"), "expected_memory_ids", "string", "the observation"))
    found = rows.select(
        *(get(c).alias(c) for c in ("request_id", "query_sha256", "retriever_id", "retriever_version")), get("top_k", "int").alias("top_k"), F.sort_array(expected).alias("expected_memory_ids"),
        F.array_sort(hit, lambda a, b: a["rank"] - b["rank"]).alias("hits"), *(strict(usage, c, "bigint", "the usage", required=True).alias(c) for c in _USAGE),
    )
    try:
        valid = constraints.observation_violations(found).isEmpty()
    except PySparkException:
        valid = False
    if not valid:
        raise SourceError("the retrieval observation is not valid")
    return found.select(*(c.split(" ")[0] for c in OBSERVATIONS.split(", ")))


def zulu(text: Column) -> Column:
    """A time as results write it: UTC as Z, other offsets as they are; times without one are errors."""
    zone = text.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)\z")
    seconds = F.regexp_replace(F.regexp_replace(text, r"\A(\d{4}-\d\d-\d\d) ", "$1T"), r"(?:[+-]00:?00|z)\z", "Z")
    return F.when(text.isNull(), None).when(~zone | F.try_to_timestamp(text).isNull(), fail("a time must be valid and have a zone")).otherwise(seconds)
