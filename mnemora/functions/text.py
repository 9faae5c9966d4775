"""Text folding for duplicate and replica matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python calls white space, as a Java character class.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
_ASCII_SPACE = r"[\x09-\x0d\x1c-\x20]+"
#: ASCII punctuation of Unicode category P; $ + < = > ^ ` | ~ are symbols.
_ASCII_TAIL = r"(?: *[!-#%-*,-/:;?@\[-\]_{}])+$"


def fold(text: str) -> str:
    """Compatibility composition, case folding, single spaces, no punctuation at the end; a text of
    punctuation only stays as it is."""
    spaced = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    end = len(spaced)
    while end and (unicodedata.category(spaced[end - 1])[0] == "P" or spaced[end - 1] == " "):
        end -= 1
    # trailing spaces go only behind punctuation, and spaced has none of its own
    return spaced[:end] or spaced


def _fold_exact(c: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold(t))

    return F.pandas_udf(run, "string")(c)


def _fold_ascii(c: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(c), _ASCII_SPACE, " "))
    short = F.regexp_replace(spaced, _ASCII_TAIL, "")
    return F.when(short == "", spaced).otherwise(short)


def with_folded(df: DataFrame, content: str = "content", out: str = "folded") -> DataFrame:
    """df with the folded content. ASCII rows are folded inside the JVM. Only the others' texts, null in their place
    elsewhere, go through Python, where alone full case folding and NFKC exist; df itself is computed once."""
    plain = F.coalesce(F.col(content).rlike(r"\A[\x00-\x7f]*\z"), F.lit(True))
    rest = _fold_exact(F.when(~plain, F.col(content)))
    return df.withColumn(out, rest).withColumn(out, F.when(plain, _fold_ascii(F.col(content))).otherwise(F.col(out)))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]")
