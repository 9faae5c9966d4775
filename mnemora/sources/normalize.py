"""Records of each kind of source as memories.

Each normaliser is a projection of variants. Whether a key is absent or null decides the provenance
status and the active state, so values are looked up as variants first. Ids that a source does not
give are derived from a record's portable fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import json_string
from ..functions.text import is_blank
from ..model import MEMORIES, REF, SCOPE_DIMENSIONS
from . import files
from .files import at, kind, strict, strict_list, zulu

_V = F.col
_LOOSE_REFS = "array<struct<transcript_id:string,turn_idx:int,span:array<int>>>"


def fail(text: str) -> Column:
    """An error that names the record by its place in its source."""
    return files.fail(F.concat(F.lit("record "), F.coalesce(F.col("n").cast("string"), F.lit("of unknown place")), F.lit(f" is malformed: {text}")))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with their place n, null where the source has no order."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(None).cast("int"))


def _v() -> Column:
    return F.col("v")


def supplied(key: str) -> Column:
    return at(_v(), key).isNotNull()


def value(key: str, type_: str = "string") -> Column:
    return F.variant_get(_v(), f"$.{key}", type_)


def text_of(key: str) -> Column:
    """A scalar as text, written as its source's language would."""
    k = kind(at(_v(), key))
    return F.when(k == "BOOLEAN", F.when(value(key, "boolean"), "True").otherwise("False")).otherwise(value(key))


def required_text(key: str, what: str) -> Column:
    return F.when(F.coalesce(kind(at(_v(), key)) == "STRING", F.lit(False)), value(key)).otherwise(fail(f"{what} needs the string field '{key}'"))


def _refs(loose: Column) -> Column:
    span = lambda r: F.when(r["span"].isNotNull(), F.when(F.size(r["span"]) == 2, F.struct(r["span"][0].alias("start"), r["span"][1].alias("end"))).otherwise(fail("a span has two numbers")))
    return F.transform(loose, lambda r: F.struct(r["transcript_id"].alias("transcript_id"), r["turn_idx"].alias("turn_idx"), span(r).alias("span")))


def source_refs(key: str = "source_refs") -> Column:
    k = kind(at(_v(), key))
    listed = F.when(k == "ARRAY", value(key, _LOOSE_REFS)).when(supplied(key), fail(f"{key} must be a list"))
    return F.coalesce(_refs(listed), F.array().cast(f"array<{REF}>"))


def scope(user: Column, agent: Column, session: Column, fallback: dict[str, str] | None = None) -> Column:
    """Missing dimensions filled from the caller's scope."""
    parts = dict(zip(SCOPE_DIMENSIONS, (user, agent, session), strict=True))
    given = fallback or {}
    return F.struct(*(F.coalesce(c.cast("string"), F.lit(given.get(d)).cast("string")).alias(d) for d, c in parts.items()))


def status_by_refs(refs: Column) -> Column:
    return F.when(F.size(refs) > 0, "declared").when(supplied("source_refs"), "known_absent").otherwise("unavailable")


def utc_text(time_text: Column) -> Column:
    """The instant in UTC, microseconds only where there are any."""
    ts = F.try_to_timestamp(time_text)
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def generated_id(adapter: str, content: Column, created_at_text: Column, scope_: Column, refs: Column) -> Column:
    """`<adapter>:` and 24 hex digits over content, instant, scope, and the set of references."""
    string = lambda c: F.coalesce(json_string(c), F.lit("null"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    span = lambda r: F.coalesce(F.concat(F.lit("["), r["span"]["start"].cast("string"), F.lit(","), r["span"]["end"].cast("string"), F.lit("]")), F.lit("null"))
    ref = lambda r: F.concat(F.lit('{"span":'), span(r), F.lit(',"transcript_id":'), string(r["transcript_id"]), F.lit(',"turn_idx":'), number(r["turn_idx"]), F.lit("}"))
    listed = F.array_join(F.array_sort(F.array_distinct(F.transform(refs, ref))), ",")
    where = F.concat(F.lit('{"agent_id":'), string(scope_["agent_id"]), F.lit(',"session_id":'), string(scope_["session_id"]), F.lit(',"user_id":'), string(scope_["user_id"]), F.lit("}"))
    payload = F.concat(F.lit(f'{{"adapter":"{adapter}","content":'), string(content), F.lit(',"created_at":'), string(utc_text(created_at_text)), F.lit(',"scope":'), where, F.lit(',"source_refs":['), listed, F.lit("]}"))
    return F.concat(F.lit(f"{adapter}:"), F.substring(F.sha2(payload, 256), 1, 24))


def _times(df: DataFrame) -> DataFrame:
    for c in ("created_at", "updated_at"):
        df = df.withColumn(c, F.try_to_timestamp(F.col(f"{c}_text")))
    return df


def _finish(df: DataFrame, adapter: str, id_: Column) -> DataFrame:
    """Typed rows, with ids derived where the source gives none. A row per record, in no order: sinks sort."""
    derived = generated_id(adapter, F.col("content"), F.col("created_at_text"), F.col("scope"), F.col("source_refs"))
    return _times(df.withColumn("id", F.coalesce(id_, derived))).select(*(c.split(" ")[0] for c in MEMORIES.split(", ")))


def _active(key: str = "active") -> Column:
    k = kind(at(_v(), key))
    return F.when(k == "BOOLEAN", value(key, "boolean")).when(k.isNull() | (k == "VOID"), F.lit(None).cast("boolean")).otherwise(fail("active must be true, false or null"))


def _columns(content: Column, scope_: Column, refs: Column, status: Column, active: Column, supersedes: Column, embedding: Column, updated: Column, raw: Column) -> dict[str, Column]:
    return {
        "content": content, "scope": scope_, "source_refs": refs, "provenance_status": status, "active": active, "supersedes": F.coalesce(supersedes, F.array().cast("array<string>")),
        "embedding": embedding, "created_at_text": zulu(value("created_at")), "updated_at_text": updated, "raw": raw,
    }


_NORMALIZED = ("id", "content", "created_at", "updated_at", "source_refs", "provenance_status", "scope", *SCOPE_DIMENSIONS, "active", "supersedes", "embedding", "raw")


def _strict_refs(refs: Column) -> Column:
    """A list of source references, every field of exactly its type and no others."""
    each = F.transform(refs, lambda r: files._only(r, ("transcript_id", "turn_idx", "span"), "a source reference"))
    what = "a source reference"
    loose = lambda r: F.struct(strict(r, "transcript_id", "string", what, required=True).alias("transcript_id"), strict(r, "turn_idx", "int", what).alias("turn_idx"), strict_list(r, "span", "int", what).alias("span"))
    return F.coalesce(_refs(F.transform(each, loose)), F.array().cast(f"array<{REF}>"))


def file_records(rows: DataFrame) -> DataFrame:
    """Records of our own file formats. A scope object wins over fields beside it, by key. Fields that are known have exactly their
    type, in scopes and references too, which hold no others; other fields of the record are kept as metadata."""
    k = kind(at(_v(), "scope"))
    inner = F.when(supplied("scope"), F.when(k != "OBJECT", fail("scope must be an object")).otherwise(files._only(at(_v(), "scope"), SCOPE_DIMENSIONS, "a scope")))
    dims = [F.when(at(_v(), f"scope.{d}").isNotNull(), strict(inner, d, "string", "a scope")).otherwise(F.when(inner.isNull() | at(inner, d).isNull(), strict(_v(), d, "string", "a memory"))) for d in SCOPE_DIMENSIONS]
    listed = F.when(supplied("source_refs"), F.when(kind(at(_v(), "source_refs")) == "ARRAY", value("source_refs", "array<variant>")).otherwise(fail("source_refs must be a list")))
    refs = _strict_refs(listed)
    explicit = value("provenance_status")
    status = F.when(explicit.isNotNull(), F.when(explicit.isin("declared", "known_absent", "unavailable"), explicit).otherwise(fail("unknown provenance_status"))).otherwise(status_by_refs(refs))
    kept = F.map_filter(F.variant_get(_v(), "$", "map<string,variant>"), lambda key, _: ~key.isin(*_NORMALIZED))
    given = F.when(supplied("raw"), F.when(kind(at(_v(), "raw")) == "OBJECT", at(_v(), "raw")).otherwise(fail("raw must be an object")))
    raw = F.to_json(F.struct(F.col("file_format"), kept.alias("source_metadata"), F.coalesce(given, F.parse_json(F.lit("{}"))).alias("supplied_raw")))
    lists = strict_list(_v(), "supersedes", "string", "a memory"), strict_list(_v(), "embedding", "double", "a memory")
    columns = _columns(required_text("content", "a memory"), scope(*dims), refs, status, _active(), *lists, zulu(value("updated_at")), raw)
    return _finish(_numbered(rows).withColumns(columns), "file", F.when(~kind(at(_v(), "id")).isin("OBJECT", "ARRAY"), text_of("id")))


_FIELDS = ("id", "content", "created_at", "updated_at", "source_refs", "provenance_status", "scope", "active", "supersedes", "embedding", "raw")


def normalized_records(rows: DataFrame) -> DataFrame:
    """Records of a normalised store: every field of exactly its type, and no others."""
    rows = rows.withColumn("v", files._only(_v(), _FIELDS, "a memory"))
    get = lambda key, type_, **more: strict(_v(), key, type_, "a memory", **more)
    inner = F.when(get("scope", "variant").isNotNull(), files._only(at(_v(), "scope"), SCOPE_DIMENSIONS, "a scope"))
    dims = [strict(inner, d, "string", "a scope") for d in SCOPE_DIMENSIONS]
    refs = _strict_refs(get("source_refs", "array<variant>"))
    columns = _columns(
        get("content", "string", required=True), scope(*dims), refs, F.coalesce(get("provenance_status", "string"), F.lit("unavailable")), get("active", "boolean"),
        strict_list(_v(), "supersedes", "string", "a memory"), strict_list(_v(), "embedding", "double", "a memory"), zulu(get("updated_at", "string")), F.to_json(F.coalesce(get("raw", "variant"), F.parse_json(F.lit("{}")))),
    ) | {"created_at_text": zulu(get("created_at", "string"))}
    return _finish(_numbered(rows).withColumns(columns), "file", get("id", "string", required=True))


def mem0_records(rows: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """run_id, else session_id, is the session; the query's own filters fill what a record leaves out."""
    given = filters or {}
    fallback = {"user_id": given.get("user_id"), "agent_id": given.get("agent_id"), "session_id": given.get("run_id") if given.get("run_id") is not None else given.get("session_id")}
    refs = source_refs()
    where = scope(text_of("user_id"), text_of("agent_id"), F.coalesce(text_of("run_id"), text_of("session_id")), fallback)
    columns = _columns(required_text("memory", "a mem0 record"), where, refs, status_by_refs(refs), _active(), value("supersedes", "array<string>"), value("embedding", "array<double>"), zulu(value("updated_at")), F.to_json(_v()))
    return _finish(_numbered(rows).withColumns(columns), "mem0", text_of("id"))


def graphiti_records(rows: DataFrame, scope_: dict[str, str] | None = None, group_scope: str | None = None, episodes: dict[str, str | dict] | None = None) -> DataFrame:
    """Facts of a graph. A state is known only where invalid_at or expired_at is given; provenance only
    through the caller's map of episodes to transcripts; a group id only where the caller says it is a scope."""
    given = scope_ or {}
    parts = {d: F.lit(None).cast("string") for d in SCOPE_DIMENSIONS}
    if group_scope is not None:
        if group_scope not in SCOPE_DIMENSIONS:
            raise ValueError(f"unknown scope dimension {group_scope!r}")
        group = value("group_id")
        bad = F.coalesce(kind(at(_v(), "group_id")) != "STRING", F.lit(True)) | F.coalesce(is_blank(group), F.lit(True))
        conflict = (group != F.lit(given[group_scope])) if given.get(group_scope) is not None else F.lit(False)
        parts[group_scope] = F.when(bad, fail("the group scope needs a non-blank string group_id")).when(conflict, fail("group_id conflicts with the supplied scope")).otherwise(group)
    loose = []
    for key, ref in (episodes or {}).items():
        ref = {"transcript_id": ref} if isinstance(ref, str) else ref
        span = F.array(*map(F.lit, ref["span"])) if ref.get("span") else F.lit(None).cast("array<int>")
        loose += [F.lit(key), F.struct(F.lit(ref["transcript_id"]).alias("transcript_id"), F.lit(ref.get("turn_idx")).cast("int").alias("turn_idx"), span.alias("span"))]
    seen = F.when(supplied("episodes") & (kind(at(_v(), "episodes")) != "ARRAY"), fail("episodes must be a list")).otherwise(value("episodes", "array<string>"))
    mapped = F.filter(F.transform(seen, lambda e: F.try_element_at(F.create_map(*loose), e)), lambda r: r.isNotNull()) if loose else F.array().cast(_LOOSE_REFS)
    refs = F.coalesce(_refs(mapped), F.array().cast(f"array<{REF}>"))
    state = F.when(supplied("invalid_at") | supplied("expired_at"), value("invalid_at").isNull() & value("expired_at").isNull())
    none = F.lit(None).cast("string")
    columns = _columns(
        required_text("fact", "a graph edge"), scope(*parts.values(), given), refs, F.when(F.size(refs) > 0, "declared").otherwise("unavailable"), state, F.array().cast("array<string>"), value("fact_embedding", "array<double>"), none, F.to_json(_v())
    )
    return _finish(_numbered(rows).withColumns(columns), "graphiti", text_of("uuid"))


def letta_records(rows: DataFrame, scope_: dict[str, str] | None = None) -> DataFrame:
    """Core blocks (value) and archival passages (text); rows have memory_type."""
    core = F.col("memory_type") == "core"
    known = F.when(F.coalesce(F.col("memory_type").isin("core", "archival"), F.lit(False)), F.col("memory_type")).otherwise(fail("a letta record is 'core' or 'archival'"))
    content = F.when(known == "core", required_text("value", "a core block")).otherwise(required_text("text", "an archival passage"))
    refs = source_refs()
    active = F.when(supplied("active"), _active()).when(core, F.lit(True)).otherwise(~F.coalesce(value("is_deleted", "boolean"), F.lit(False)))
    none = F.lit(None).cast("string")
    columns = _columns(content, scope(none, none, none, scope_), refs, status_by_refs(refs), active, F.array().cast("array<string>"), F.when(~core, value("embedding", "array<double>")), zulu(value("updated_at")), F.to_json(_v()))
    return _finish(_numbered(rows).withColumns(columns), "letta", text_of("id"))
