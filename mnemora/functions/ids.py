"""Canonical JSON and the identifiers derived from it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER_ESCAPES = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, non-ASCII as it is; NaN is an error."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def short_hash(prefix: str, value: object) -> str:
    return f"{prefix}{hashlib.sha256(canonical(value).encode()).hexdigest()[:24]}"


def json_of(**fields: Column) -> Column:
    """Canonical JSON of an object. Nested structs must name their fields in order themselves."""
    text = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    # Jackson writes \u001F where canonical JSON has \u001f
    fixed = text
    for cp in _UPPER_ESCAPES:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{cp:04X}", rf"$1\\u{cp:04x}")
    return F.when(F.contains(text, F.lit("\\u00")) & text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def json_string(c: Column) -> Column:
    """A string as JSON."""
    wrapped = json_of(x=c)
    return F.substring(wrapped, F.lit(6), F.char_length(wrapped) - 6)


def json_strings(c: Column) -> Column:
    """An array of strings as JSON."""
    wrapped = json_of(x=c)
    return F.substring(wrapped, F.lit(6), F.char_length(wrapped) - 6)


def evidence_item(kind: str | Column, message: str | Column, data: Column) -> Column:
    """struct<identity, message, kind, data>; items sort as their identities' texts do."""
    kind, message = (F.lit(x) if isinstance(x, str) else x for x in (kind, message))
    return F.struct(F.concat(F.lit('{"data":'), data, F.lit(',"kind":"'), kind, F.lit('"}')).alias("identity"), message.alias("message"), kind.alias("kind"), data.alias("data"))


def finding_head(checker_id: str, rule) -> str:
    """What the hash of a finding's id starts with, up to its evidence."""
    return f'{{"checker_id":"{checker_id}","checker_version":"{rule.checker_version}","defect_class":"{rule.defect_class}","evidence":['


def finding_name(digest) -> str:
    """The id of a finding whose hash has taken all but the end."""
    digest.update(b"]}")
    return f"finding-{digest.hexdigest()[:24]}"


def finding_id(checker_id: str, checker_version: str, defect_class: str, items: Column, memory_ids: Column) -> Column:
    """`finding-` and 24 hex digits over the checker, the class, sorted evidence and sorted memories."""
    head = f'{{"checker_id":"{checker_id}","checker_version":"{checker_version}","defect_class":"{defect_class}","evidence":['
    payload = F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: x["identity"]), ","), F.lit('],"memory_ids":'), json_strings(memory_ids), F.lit("}"))
    return F.concat(F.lit("finding-"), F.substring(F.sha2(payload, 256), 1, 24))


def finding_id_of(checker_id: str, checker_version: str, defect_class: str, evidence: Iterable[dict], memory_ids: Iterable[str]) -> str:
    """The same for one finding, on the driver; evidence has data and kind."""
    items = sorted(({"data": e["data"], "kind": e["kind"]} for e in evidence), key=canonical)
    return short_hash("finding-", {"checker_id": checker_id, "checker_version": checker_version, "defect_class": defect_class, "evidence": items, "memory_ids": sorted(memory_ids)})
