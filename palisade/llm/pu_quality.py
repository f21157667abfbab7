"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled web text, a mixture of
both kinds. The network minimises the non-negative unbiased risk

    prior * loss(positives, +1) + max(0, loss(unlabelled, -1) - prior * loss(positives, -1)),

where the second part is what negatives alone would cost; once a batch drives it below zero, the
step goes the other way instead of fitting noise. The class prior is the share of label 1 among all
labelled training rows, counted over the whole table.

A document is described by the make-up of its whole text: sizes, kinds of characters, use of marks,
repetition of words and lines. Labels, language, source and id are no inputs.

The fit uses at most ``FIT_ROWS`` positives and as many unlabelled documents, those with the
smallest hashes of their id; so what reaches the driver is bounded, and the same rows are drawn
whatever the layout. Everything else covers all rows.

Defined cases: null and empty texts get the score of an empty text; a null id is not held out and
is not learned from; if several labels name one document, 1 wins; without labelled positives every
score is 0.5. Columns of the input are kept, and one with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import codes_of, segment_hashes, slices, with_fields

#: Rows of each side that the fit uses at most.
FIT_ROWS = 12_000
#: Scores from here on are predicted 1.
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 256, 0.01, 1e-4, 7
#: Buckets in which marks are counted by their code point.
MARKS = 24
SLICE_BYTES = 1_000_000


def describe(texts: list[str | None]) -> np.ndarray:
    """One row of features per text."""
    texts = [t or "" for t in texts]
    rows = len(texts)
    codes, size = codes_of(texts)
    doc = np.repeat(np.arange(rows), size)
    ends = np.cumsum(size)
    starts = ends - size

    small = np.minimum(codes, _KINDS.shape[0] - 1)
    kind = np.where(codes < _KINDS.shape[0], _KINDS[small], _LETTER_LOW)
    chars = np.bincount(doc * 8 + kind, minlength=rows * 8).reshape(rows, 8).astype(float)
    letters = chars[:, _LETTER_LOW] + chars[:, _LETTER_UP]
    is_mark = kind == _MARK
    marks = np.bincount(
        doc[is_mark] * MARKS + codes[is_mark] % MARKS, minlength=rows * MARKS
    ).reshape(rows, MARKS)

    blank = (kind == _SPACE) | (kind == _LINE)
    words = _segments(blank, doc)
    lines = _segments(kind == _LINE, doc)
    n = np.maximum(size, 1)[:, None]
    word_part = _repetition(codes, words, doc, rows)
    line_part = _repetition(codes, lines, doc, rows)

    at, length = words
    of = doc[at]
    shape = np.stack([
        _mean(of, kind[at] == _LETTER_UP, rows),
        _mean(of, is_mark[at + length - 1], rows),
        _mean(of, is_mark[at], rows),
        _mean(of, length, rows) / 10,
        np.sqrt(np.maximum(_mean(of, length.astype(float) ** 2, rows) - _mean(of, length, rows) ** 2, 0)) / 10,
        _mean(of, (length <= 3), rows),
    ], axis=1)
    return np.concatenate([
        np.log1p(size)[:, None] / 10,
        chars[:, :6] / n,
        (chars[:, _LETTER_UP] / np.maximum(letters, 1))[:, None],
        np.sqrt(marks / n),
        word_part, line_part, shape,
    ], axis=1).astype(np.float32)


_LETTER_LOW, _LETTER_UP, _DIGIT, _SPACE, _LINE, _MARK = range(6)
_KINDS = np.array([
    _LINE if c in "\n\r" else _SPACE if c.isspace() else _DIGIT if c.isdigit()
    else _LETTER_UP if c.isupper() else _LETTER_LOW if c.isalpha() else _MARK
    for c in map(chr, range(0x3000))
])


def _segments(gap: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs without a gap; a new text begins a new run."""
    inside = ~gap
    new = np.ones(len(gap), bool)
    new[1:] = gap[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(inside & new)
    last = np.ones(len(gap), bool)
    last[:-1] = gap[1:] | (doc[1:] != doc[:-1])
    return at, np.flatnonzero(inside & last) + 1 - at


def _mean(of: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(of, value, minlength=rows) / np.maximum(np.bincount(of, minlength=rows), 1)


def _repetition(codes, segments, doc, rows) -> np.ndarray:
    """How many segments there are, and how much they repeat."""
    at, length = segments
    of = doc[at]
    total = np.bincount(of, minlength=rows)
    hashes = segment_hashes(codes, at, length)
    beside = np.zeros(len(at), bool)
    beside[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(at), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=rows)
    first = np.flatnonzero(new)
    times = np.diff(first, append=len(at))
    most = np.zeros(rows)
    np.maximum.at(most, of[order][first], times)
    n = np.maximum(total, 1)
    return np.stack([np.log1p(total) / 10, distinct / n, most / n, _mean(of, beside, rows)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        first, bias, last, shift = self.weights
        return 1 / (1 + np.exp(-(np.tanh(x @ first + bias) @ last + shift)))


def fit_model(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Adam on the non-negative risk with logistic loss."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    random = np.random.default_rng(seed)
    width = p.shape[1]
    weights = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN),
               random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        p_order, u_order = random.permutation(len(p)), random.permutation(len(u))
        for begin in range(0, max(len(p), len(u)), BATCH):
            take = np.arange(begin, begin + BATCH)
            xp, xu = p[p_order[take % len(p)]], u[u_order[take % len(u)]]
            x = np.concatenate([xp, xu])
            hidden = np.tanh(x @ weights[0] + weights[1])
            chance = 1 / (1 + np.exp(-(hidden @ weights[2] + weights[3])))
            cp, cu = chance[:BATCH], chance[BATCH:]
            negative = (-np.log(1 - cu + 1e-9)).mean() - prior * (-np.log(1 - cp + 1e-9)).mean()
            # Slopes of loss(+1) and loss(-1) in the output are chance - 1 and chance.
            slope_neg = np.concatenate([-prior * cp, cu]) / BATCH
            slope_pos = np.concatenate([prior * (cp - 1), np.zeros(BATCH)]) / BATCH
            slope = slope_pos + slope_neg if negative >= 0 else -slope_neg
            inner = slope[:, None] * weights[2] * (1 - hidden**2)
            gradients = [x.T @ inner, inner.sum(axis=0), hidden.T @ slope, slope.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(gradients):
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return Model(mean, scale, weights)


def _described(docs: DataFrame) -> DataFrame:
    """``features`` of the column ``text``, next to the other columns."""
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                rows = describe(part.column(at).to_pylist())
                columns = [part.column(i) for i in kept]
                features = pa.array(list(rows), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*columns, features], names=[*(part.schema.names[i] for i in kept), "features"]
                )

    schema = with_fields(docs.drop("text"), features=T.ArrayType(T.FloatType()))
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Fits on documents ``doc_id, text`` and labels ``doc_id, quality`` (both training rows only)."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    counts = marked.agg(F.count(F.lit(1)), F.sum((F.col("quality") == 1).cast("long"))).first()
    if not counts[1]:
        return None
    prior = counts[1] / counts[0]
    drawn = F.xxhash64(F.lit(SEED), "doc_id")
    positive = marked.where("quality = 1").select("doc_id", F.lit(True).alias("trusted"), drawn.alias("h"))
    positive = positive.orderBy("h").limit(rows)
    pool = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    pool = pool.select("doc_id", F.lit(False).alias("trusted"), F.xxhash64(F.lit(SEED + 1), "doc_id").alias("h"))
    pool = pool.orderBy("h").limit(rows)
    sample = F.broadcast(positive.unionByName(pool).drop("h"))  # at most 2 * rows
    # One row for each id, or a repeated id would go beyond the bound.
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "trusted").agg(F.min("text").alias("text"))
    chosen = _described(texts.select("trusted", "text"))
    found = chosen.toPandas()
    trusted = found["trusted"].to_numpy(bool) if len(found) else np.zeros(0, bool)
    if not trusted.any() or trusted.all():
        return None
    features = np.stack(found["features"].to_numpy()).astype(np.float64)
    order = np.lexsort(features.T[::-1])  # the fit doesn't depend on the order of rows
    features, trusted = features[order], trusted[order]
    return fit_model(features[trusted], features[~trusted], prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    made = ("score", "predicted")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                if fitted is None:
                    found = np.full(part.num_rows, 0.5)
                else:
                    found = fitted.score(describe(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.float64()),
                     pa.array((found >= THRESHOLD).astype(np.int32))],
                    names=[*part.schema.names, *made],
                )

    schema = with_fields(docs, score=T.DoubleType(), predicted=T.IntegerType())
    return docs.mapInArrow(run, schema)
