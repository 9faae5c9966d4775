"""Personal data in whole texts: expressions propose spans, validators confirm them, nearby words adjust their score.

1. *Proposals.* Each kind has an expression, matched leftmost and without overlaps within the kind. All run in linear
   time: runs that an expression could start inside of are tried once, at their start, which finds the same matches.
2. *Validators.* Parts of addresses at most 255, Luhn for cards, 9 to 15 digits for phones; mod-97 and the country's
   length for IBANs and for French social security numbers, a letter by mod-23 for Spanish ids, issued ranges for
   American social security numbers. A match that fails is dropped, without another try inside it.
3. *Context.* A span has its kind's score, raised once where a word that goes with the kind stands nearby and lowered
   once where one stands there that speaks against it. Nearby are `BEFORE` code points before and `AFTER` after a span.

The base kinds (`BASE`) are always returned, whatever their score. The others need `THRESHOLD`, so that those whose
validators are weak appear only beside a word that names them, and must not touch a base span.

One Arrow map over whole texts in slices, no shuffle; a worker holds the spans of one slice.

Defined results: null text = empty text, which has no spans; every row gives one row, with its id as it is, null too, however often it
repeats; a text may be as long as a row can hold; offsets are code points, ends exclusive; spans go by start, then
by kind as listed in `KINDS`; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import column, map_slices, whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "nir", "dni", "national_phone")
BEFORE, AFTER, THRESHOLD = 48, 24, 0.5
RAISED, LOWERED = 0.3, 0.25

# Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# The letter of a Spanish id by its number's remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# A kind's score without context, and words nearby that speak for it or against it.
CONTEXT: dict[str, tuple[float, str, str]] = {
    "email": (0.7, "email mail e-mail contact contacto courriel correo kontakt", "example sample"),
    "ip": (0.5, "ip address host server addr adresse dirección client", "version release build chapter section"),
    "card": (0.6, "card credit visa mastercard amex carte tarjeta karte kreditkarte payment", "isbn order tracking serial part"),
    "phone": (0.6, "phone tel telephone call fax mobile téléphone teléfono telefon móvil handy", "isbn order serial"),
    "iban": (0.8, "iban bank account konto compte cuenta bic swift", "example sample"),
    "ssn": (0.4, "ssn social security", "order serial part isbn"),
    "nir": (0.5, "nir insee sécurité sociale social security", "order serial isbn"),
    "dni": (0.35, "dni nif nie documento identidad", "order serial part"),
    "national_phone": (0.35, "phone tel telephone call fax mobile téléphone teléfono telefon móvil handy", "isbn order serial"),
}
_WORDS = {kind: (score, frozenset(good.split()), frozenset(bad.split())) for kind, (score, good, bad) in CONTEXT.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Signs are met from the left; what may stand before one reaches back to the last match or sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(value: str) -> int:
    """The remainder of a number whose letters stand for 10 to 35."""
    return int("".join(str(int(c, 36)) for c in value)) % 97


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in found.split("."))


def _is_card(found: str) -> bool:
    return 12 <= len(d := _digits(found)) <= 19 and luhn(d)


def _is_iban(found: str) -> bool:
    value = found.replace(" ", "")
    return len(value) == IBAN_LENGTHS.get(value[:2]) and mod97(value[4:] + value[:4]) == 1


def _is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_nir(found: str) -> bool:
    value = found.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return len(value) == 15 and int(value[13:]) == 97 - int(value[:13]) % 97


def _is_dni(found: str) -> bool:
    first = "XYZ".find(found[0])
    return DNI_LETTERS[int((found[:-1] if first < 0 else str(first) + found[1:-1]).replace("-", "")) % 23] == found[-1]


#: Kind, expression, validator; e-mail addresses have a finder of their own. Runs of digits are entered at their start only.
_PATTERNS: list[tuple[str, re.Pattern[str], Callable[[str], bool]]] = [
    ("ip", re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), _is_ip),
    ("card", re.compile(r"[0-9]+(?:[ -][0-9]+)*"), _is_card),
    ("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), lambda found: 9 <= len(_digits(found)) <= 15),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _is_iban),
    ("ssn", re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"), _is_ssn),
    ("nir", re.compile(r"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])"), _is_nir),
    ("dni", re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z](?![A-Za-z0-9-])"), _is_dni),
    ("national_phone", re.compile(r"(?<![0-9().+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"), lambda found: True),
]


def _score(kind: str, text: str, start: int, end: int) -> float:
    score, good, bad = _WORDS[kind]
    nearby = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", f"{text[max(0, start - BEFORE) : start]} {text[end : end + AFTER]}".lower()))
    return round(min(1.0, score + RAISED * bool(nearby & good) - LOWERED * bool(nearby & bad)), 2)


def find_spans(text: str) -> list[Span]:
    """The spans of a text, by start and kind."""
    found = [Span("email", a, b, _score("email", text, a, b)) for a, b in _emails(text)]
    for kind, pattern, valid in _PATTERNS:
        found += [Span(kind, *m.span(), _score(kind, text, *m.span())) for m in pattern.finditer(text) if valid(m.group())]
    if all(s.kind in BASE for s in found):
        kept = found
    else:
        kept, others = [s for s in found if s.kind in BASE], sorted((s for s in found if s.kind not in BASE), key=lambda s: (s.start, KINDS.index(s.kind)))
        # both by start: a base span that touches is the last to start before the other ends, or one that reaches far
        ends, base = [], sorted(kept, key=lambda s: s.start)
        k = reach = 0
        for s in others:
            while k < len(base) and base[k].start < s.end:
                reach, k = max(reach, base[k].end), k + 1
            if s.score >= THRESHOLD and reach <= s.start:
                ends.append(s)
        kept += ends
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: <id_col> and spans, an array of (kind, start, end, score)."""

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = pa.array([[s._asdict() for s in find_spans(x)] for x in part.column("text").to_pylist()], _ARROW)
        yield pa.RecordBatch.from_arrays([part.column("id"), spans], ["id", "spans"])

    rows = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", SPANS)])
    return map_slices(rows, "text", make, schema).withColumnRenamed("id", id_col)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col> and <text_col> with each span replaced by its kind in angle brackets; of spans that overlap, the first."""

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for x in part.column("text").to_pylist():
            out, at = [], 0
            for s in find_spans(x):
                if s.start >= at:
                    out += [x[at : s.start], f"<{s.kind}>"]
                at = max(at, s.end)
            texts.append("".join([*out, x[at:]]))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_slices(rows, "text", make, rows.schema).withColumnsRenamed({"id": id_col, "text": text_col})


def listed(spans: str | Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span of these kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """<id_col>, n_<kind> of each base kind, base_sha256 over the base spans, spans as text."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(column(id_col), *counts, F.sha2(listed("spans", BASE), 256).alias("base_sha256"), listed("spans").alias("spans"))
