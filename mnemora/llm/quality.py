"""A quality classifier: random-indexing word vectors, a small network, calibrated probabilities.

*Word vectors.* Each word is two terms: its letters in lower case, and its shape (runs of upper case,
lower case and digits as one sign each, other characters as they are). Terms hash into a fixed number
of buckets. Each bucket has a sparse random index vector; its word vector is that plus the index
vectors of the terms around it in the fitting texts (random indexing). A word that is its predecessor
again counts as one more term. A text is the mean of its words' vectors, whole texts always.

*Network.* Two layers in numpy, fitted by Adam on the labelled rows' vectors, then a temperature that
minimises the loss on a fold kept back from them, so that scores are probabilities.

Fitting uses at most `PER_CLASS` labelled rows of each class (a documented bound; which rows is decided by
a hash of the id, whatever their texts), weighted back to the classes' shares in all labelled rows. Their whole
texts are read on the executors: one pass adds up what stands around each term, as whole numbers, so that
the sums do not depend on how rows are dealt; a second makes the vectors. The driver gets the sums, one row
per bucket, and one vector per fitted row, fits the network in seconds, whatever the corpus, and broadcasts
vectors and network, some MB. Labels are taken only from rows whose crc32(id as text) mod 5 is not 0.
Scoring is one Arrow map without a shuffle.

Defined results: null text = empty text, which has the zero vector and gets its score from the
network like any other; without labelled rows every score is 0.5, with one class only its share (0
or 1); labels without a document, and null labels, are ignored; an id with both labels is fitted with
both, and of several texts under one id the smallest is fitted; a null id is scored, held_out null; rows that
repeat are scored alike; a text may be as long as a row can hold; an empty table gives an empty result;
other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import column, map_slices, slices, whole_text, written

PER_CLASS = 2000
WORD_BUCKETS, SHAPE_BUCKETS, DIM, NONZERO, NEAR = 1 << 15, 1 << 11, 48, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-3
FOLDS, CALIBRATION_FOLD = 5, 1
THRESHOLD = 0.3
WORDS_KEPT = 150_000

_LETTERS, _DIGITS, _AGAIN, _NO_LETTER = (re.compile(p) for p in (r"[^\W\d_]+", r"\d+", r"(\W|_)\1+", r"[\W_]+"))


def _case(letters: str) -> str:
    if letters.islower():
        return "a"
    if letters.isupper():
        return "AA" if len(letters) > 1 else "A"
    return "Aa" if letters[1:].islower() else "aA"


def shape(word: str) -> str:
    """E.g. `Word***` -> `Aa*`, `WORD!!` -> `AA!`, `word.` -> `a.`"""
    if word.isalpha():
        return _case(word)
    out = _LETTERS.sub(lambda m: _case(m[0]), word)
    return _AGAIN.sub(r"\1", _DIGITS.sub("0", out))


def term_buckets(word: str) -> int:
    """The word's letter bucket and shape bucket, in one number."""
    plain = word.lower() if word.isalnum() else _NO_LETTER.sub("", word.lower())
    return (zlib.crc32(plain.encode()) % WORD_BUCKETS) * SHAPE_BUCKETS + zlib.crc32(shape(word).encode()) % (SHAPE_BUCKETS - 1)


#: The bucket of the term "the word before again"; no shape hashes to it.
AGAIN = SHAPE_BUCKETS - 1


def index_vectors(buckets: int, seed: int) -> np.ndarray:
    """Sparse random vectors: NONZERO entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, DIM), np.float32)
    places = rng.random((buckets, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (buckets, NONZERO)), axis=1)
    return out


#: Neighbouring terms that are summed at a time.
PAIRS = 1 << 14


def add_contexts(around: np.ndarray, sequences: list[np.ndarray], index: np.ndarray) -> None:
    """Adds to each term's row the index vectors of what stands around it."""
    terms = np.concatenate([np.zeros(0, np.int64), *sequences])
    text = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
    for step in range(1, NEAR + 1):
        for start in range(0, len(terms) - step, PAIRS):
            end = min(start + PAIRS, len(terms) - step)
            same = text[start:end] == text[start + step : end + step]
            left, right = terms[start:end][same], terms[start + step : end + step][same]
            for here, there in ((left, right), (right, left)):
                order = here.argsort(kind="stable")
                found, firsts = np.unique(here[order], return_index=True)
                if len(found):
                    # whole numbers, exact in a chunk
                    around[found] += np.add.reduceat(index[there[order]], firsts, axis=0).astype(np.int64)


def word_vectors(index: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Index vectors plus the unit vectors of what stands around each term."""
    norm = np.linalg.norm(around, axis=1, keepdims=True)
    unit = np.divide(around, norm, out=np.zeros(around.shape), where=norm > 0)
    return index / np.float32(np.sqrt(NONZERO)) + unit.astype(np.float32)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None
    #: Buckets of words met, to save time.
    kept: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def vector(self, text: str) -> np.ndarray:
        tokens = text.split()
        if not tokens:
            return np.zeros(2 * DIM)
        kept, counts = self.kept, Counter(tokens)
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for w in counts:
            if w not in kept:
                kept[w] = term_buckets(w)
        ids = np.fromiter(map(kept.__getitem__, counts), np.int64, len(counts))
        weight = np.fromiter(counts.values(), np.float32, len(counts)) / len(tokens)
        again = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
        shapes = np.bincount(ids % SHAPE_BUCKETS, weight, SHAPE_BUCKETS)
        some = np.flatnonzero(shapes)
        return np.concatenate([weight @ self.words[ids // SHAPE_BUCKETS], shapes[some] @ self.shapes[some] + again * self.shapes[AGAIN]])

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((vectors - self.mean) / self.std @ a + b) @ c + d

    def scores(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        # one product per text, so that a score does not depend on the rows beside it
        return [round(float(1 / (1 + np.exp(-np.clip(self.logits(self.vector(t)) / self.temperature, -60, 60)))), 6) for t in texts]


def _fit_network(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> None:
    rng = np.random.default_rng(seed)
    model.mean, model.std = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - model.mean) / model.std
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    weight = weight / weight.sum()
    for step in range(1, EPOCHS + 1):
        a, b, c, d = layers
        hidden = np.tanh(z @ a + b)
        error = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -60, 60))) - y) * weight
        back = error[:, None] * c * (1 - hidden**2)
        slopes = [z.T @ back + DECAY * a, back.sum(axis=0), hidden.T @ error + DECAY * c, error.sum()]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers


def _fit_temperature(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    logits = model.logits(x)

    def loss(t: float) -> float:
        z = logits / t
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    return float(min(np.geomspace(0.25, 8, 61), key=loss))


SEED = 7


def fit_network(model: Model, vectors: np.ndarray, labels: list[int], folds: list[int], shares: dict[int, float], seed: int = SEED) -> Model:
    """Fits layers and temperature on the labelled rows' vectors; shares: each class's share of all labelled rows."""
    y, fold = np.array(labels, float), np.array(folds)
    share = {k: shares[k] / max(1, labels.count(k)) for k in (0, 1)}
    weight = np.array([share[k] for k in labels])
    kept_back = fold == CALIBRATION_FOLD
    if len(set(y[~kept_back])) < 2 or len(set(y[kept_back])) < 2:
        kept_back = np.zeros(len(y), bool)
    _fit_network(model, vectors[~kept_back], y[~kept_back], weight[~kept_back], seed)
    if kept_back.any():
        model.temperature = _fit_temperature(model, vectors[kept_back], y[kept_back], weight[kept_back])
    return model


#: The two tables of buckets, by number: their sizes, and how a word's buckets are read off its number.
TABLES = ((WORD_BUCKETS, lambda ids: ids // SHAPE_BUCKETS), (SHAPE_BUCKETS, lambda ids: ids % SHAPE_BUCKETS))


def _indexes() -> list[np.ndarray]:
    return [index_vectors(n, SEED + k) for k, (n, _) in enumerate(TABLES)]


def context_rows(sample: DataFrame) -> DataFrame:
    """(kind, bucket, v): per table and bucket, the sum of the index vectors around it in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes()
        sums, known = [np.zeros(x.shape, np.int64) for x in indexes], {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = [t.split() for t in part.column("text").to_pylist()]
                for w in {w for t in words for w in t}.difference(known):
                    known[w] = term_buckets(w)
                ids = [np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in words]
                if len(known) > WORDS_KEPT // 4:
                    known.clear()
                for around, index, (_, read) in zip(sums, indexes, TABLES, strict=True):
                    add_contexts(around, [read(i) for i in ids], index)
        for kind, around in enumerate(sums):
            some = np.flatnonzero(around.any(axis=1))
            for start in range(0, len(some), 4096):
                at = some[start : start + 4096]
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, DIM * len(at) + 1, DIM), pa.int32()), pa.array(around[at].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), v], ["kind", "bucket", "v"])

    each = sample.select("text").mapInArrow(run, "kind int, bucket int, v array<long>")
    return each.groupBy("kind", "bucket").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)))


def _vectors(sample: DataFrame, model: Model) -> DataFrame:
    """(id, label, v): the vectors of the texts."""
    data = sample.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = [data.value.vector(t).tolist() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(vectors, pa.list_(pa.float64()))], ["id", "label", "v"])

    return map_slices(sample.select("id", "label", "text"), "text", make, "id long, label int, v array<double>")


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)).cast("int")


#: Tasks that read the fitted texts.
FIT_TASKS = 16


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on at most per_class rows of each class, none of fold 0."""
    known = labels.select(column(id_col).cast("long").alias("id"), column(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    # a label without a document can't be read, so it must not take the place of one that can
    known = known.where(fold_of("id") != 0).join(docs.select(column(id_col).cast("long").alias("id")), "id", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [r for k in sorted(counts) for r in known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    model = Model(np.zeros((0, DIM)), np.zeros((0, DIM)), constant=0.5)
    if not chosen:
        return model
    # ids and labels of 2 * per_class rows at most
    few = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in chosen], "id long, label int").distinct()
    texts = docs.select(column(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    sample = written(texts.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text")).repartition(FIT_TASKS, "id"))
    found = sorted({r["label"] for r in sample.select("label").distinct().collect()})
    if len(found) < 2:
        model.constant = float(found[0]) if found else 0.5
        return model
    sums = [np.zeros(x.shape, np.int64) for x in _indexes()]
    for r in context_rows(sample).collect():  # a row per bucket at most
        sums[r["kind"]][r["bucket"]] = r[2:]
    words, shapes = (word_vectors(i, a) for i, a in zip(_indexes(), sums, strict=True))
    model = Model(words, shapes)
    rows = sorted(_vectors(sample, model).collect(), key=lambda r: (r["id"], r["label"]))  # 2 * per_class at most
    total = sum(counts.values())
    folds = [zlib.crc32(str(r["id"]).encode()) % FOLDS for r in rows]
    return fit_network(model, np.array([r["v"] for r in rows]), [r["label"] for r in rows], folds, {k: counts.get(k, 0) / total for k in (0, 1)})


def quality_scores(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, held_out, score, predicted, and the columns in keep, as they are.
    A model that train() gave before needs no labels."""
    keep = keep or []
    data = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, id_col, text_col))
    names = [f"k{i}" for i in range(len(keep))]

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = data.value.scores(part.column("text").to_pylist())
        rest = [part.column(c) for c in ("id", *names)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], ["id", *names, "score"])

    source = docs.select(column(id_col).alias("id"), *(column(c).alias(n) for c, n in zip(keep, names, strict=True)), whole_text(text_col).alias("text"))
    schema = StructType([f for f in source.schema if f.name != "text"]).add("score", "double")
    scored = map_slices(source, "text", make, schema)
    return scored.select(
        F.col("id").alias(id_col), *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), (fold_of("id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
