"""Semantic judges: does a premise entail a hypothesis?"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = ("entailment", "neutral", "contradiction")
JUDGMENT = "struct<status:string,relation:string,score:double,model_calls:bigint,input_tokens:bigint,output_tokens:bigint>"


class JudgeError(RuntimeError):
    """A judge that cannot work at all: the check stops with this error, whose text holds no memory's content."""


class DependencyError(JudgeError):
    """Libraries that the judge needs are missing."""


class ModelConfigError(JudgeError):
    """The model or its tokenizer is not of the form that the judge needs."""


class InputTooLong(ValueError):
    """The pair exceeds what the judge can read whole; the memory is skipped."""


@dataclass(frozen=True)
class Judgment:
    relation: str
    score: float
    model_calls: int = 1
    input_tokens: int = 0
    output_tokens: int = 0

    def __post_init__(self) -> None:
        if self.relation not in RELATIONS or not 0 <= self.score <= 1:
            raise ValueError("a judgment has a known relation and a score of 0 to 1")
        if min(self.model_calls, self.input_tokens, self.output_tokens) < 0:
            raise ValueError("usage cannot be negative")


@runtime_checkable
class Judge(Protocol):
    judge_id: str
    judge_version: str

    def judge(self, *, premise: str, hypothesis: str) -> Judgment: ...


def identity(judge: Judge) -> tuple[str, str]:
    ids = judge.judge_id, judge.judge_version
    if not all(isinstance(x, str) and x.strip() for x in ids):
        raise ValueError("a judge needs a non-blank id and version")
    return ids


@dataclass(frozen=True)
class LexicalJudge:
    """Deterministic: the share of the hypothesis's distinct words that the premise has."""

    entails: float = 0.5
    contradicts: float = 0.1
    max_words: int | None = None
    judge_id: str = "lexical-overlap"
    judge_version: str = "1"

    def judge(self, *, premise: str, hypothesis: str) -> Judgment:
        words = lambda s: [w for w in re.split("[^a-z0-9]+", s.lower()) if w]
        have, want = words(premise), words(hypothesis)
        if self.max_words is not None and len(have) + len(want) > self.max_words:
            raise InputTooLong
        share = len(set(want) & set(have)) / len(set(want)) if want else 0.0
        relation = "entailment" if share >= self.entails else "contradiction" if share < self.contradicts else "neutral"
        return Judgment(relation, share, 1, len(have) + len(want), 0)


def softmax_relation(logits: Sequence[float], labels: Sequence[str]) -> tuple[str, float]:
    """The first most probable of three relations and its probability."""
    import math

    if sorted(labels) != sorted(RELATIONS):
        raise ValueError("labels must name the three relations")
    top = max(logits)
    parts = [math.exp(x - top) for x in logits]
    best = max(range(3), key=lambda i: (parts[i], -i))
    return labels[best], parts[best] / sum(parts)


def label_order(config: object) -> list[str]:
    """The relation of each class number of a model, from id2label, label2id or both, which must agree."""

    def number(x: object) -> int:
        if isinstance(x, bool) or not (isinstance(x, int) or isinstance(x, str) and x.isdecimal()):
            raise ModelConfigError("class numbers must be whole numbers")
        return int(x)

    found = []
    if given := getattr(config, "id2label", None):
        found.append({number(k): v for k, v in given.items()})
    if given := getattr(config, "label2id", None):
        inverse = {number(v): k for k, v in given.items()}
        if len(inverse) != len(given):
            raise ModelConfigError("two labels have one class number")
        found.append(inverse)
    if not found:
        raise ModelConfigError("the model names no labels")
    maps = [{k: str(v).casefold() for k, v in m.items()} for m in found]
    if any(sorted(m) != [0, 1, 2] or sorted(m.values()) != sorted(RELATIONS) for m in maps):
        raise ModelConfigError("the model's labels must be the three relations")
    if maps[0] != maps[-1]:
        raise ModelConfigError("id2label and label2id disagree")
    return [maps[0][k] for k in range(3)]


def input_limit(tokenizer: object, config: object, most: int) -> int:
    """The tokens that a pair may have: the least of the declared limits, of which there must be one, and `most`."""
    declared = [x for x in (getattr(tokenizer, "model_max_length", None), getattr(config, "max_position_embeddings", None)) if isinstance(x, int) and not isinstance(x, bool) and x > 0]
    if not declared:
        raise ModelConfigError("neither model nor tokenizer declares an input limit")
    return min(*declared, most)


class ModelJudge:
    """A natural-language-inference model at a pinned revision, loaded on each worker when first used.
    Needs torch and transformers, which are not part of this package."""

    def __init__(self, model_id: str, judge_id: str, judge_version: str, max_tokens: int = 4096, revision: str | None = None) -> None:
        self.model_id, self.judge_id, self.judge_version, self.max_tokens, self.revision = model_id, judge_id, judge_version, max_tokens, revision
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _load(self):
        if self._loaded is None:
            try:
                from importlib import import_module

                torch, transformers = import_module("torch"), import_module("transformers")
            except ImportError as error:
                raise DependencyError("the model judge needs torch and transformers") from error
            options = {"revision": self.revision, "trust_remote_code": False}
            try:
                tokenizer = transformers.AutoTokenizer.from_pretrained(self.model_id, **options)
                model = transformers.AutoModelForSequenceClassification.from_pretrained(self.model_id, use_safetensors=True, **options).eval()
            except ImportError as error:
                raise DependencyError("the tokenizer's own dependencies are missing") from error
            except (OSError, RuntimeError, ValueError) as error:
                raise JudgeError(f"model {self.model_id!r} at revision {self.revision!r} could not be loaded") from error
            self._loaded = torch, tokenizer, model, label_order(model.config), input_limit(tokenizer, model.config, self.max_tokens)
        return self._loaded

    def judge(self, *, premise: str, hypothesis: str) -> Judgment:
        torch, tokenizer, model, labels, limit = self._load()
        pair = tokenizer(premise, hypothesis, truncation=False, return_tensors="pt")
        n = pair["input_ids"].shape[1]
        if n > limit:
            raise InputTooLong
        with torch.inference_mode():
            logits = model(**pair).logits[0].tolist()
        relation, score = softmax_relation(logits, labels)
        return Judgment(relation, score, 1, n, 0)


def with_judgment(df: DataFrame, judge: Judge, premise: str = "premise", hypothesis: str = "content", out: str = "judgment") -> DataFrame:
    """df with the judge's answers. status is `ok`, `too_long` or `failed`: a failure never shows the
    texts, and is raised by whoever reads the column. A judge that cannot work at all raises its own error."""
    identity(judge)

    @F.pandas_udf(JUDGMENT)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for premises, hypotheses in batches:
            rows = []
            for p, h in zip(premises, hypotheses, strict=True):
                try:
                    j = judge.judge(premise=p, hypothesis=h)
                    if not isinstance(j, Judgment):
                        raise TypeError("not a judgment")
                    rows.append(("ok", j.relation, float(j.score), j.model_calls, j.input_tokens, j.output_tokens))
                except JudgeError:
                    raise
                except InputTooLong:
                    rows.append(("too_long", None, None, 0, 0, 0))
                except Exception:
                    rows.append(("failed", None, None, 0, 0, 0))
            yield pd.DataFrame(rows, columns=["status", "relation", "score", "model_calls", "input_tokens", "output_tokens"])

    return df.withColumn(out, ask(F.col(premise), F.col(hypothesis)))
