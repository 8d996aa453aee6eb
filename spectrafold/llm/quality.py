"""Quality classifier (operator 8): naive Bayes support vectors.

The indicators of a text's byte n-grams (two to four bytes, hashed into bins)
are scaled by the log ratio of their frequencies in good and bad texts, and the
scaled vector is normalised. A linear hinge-loss model is fitted on these
vectors by dual coordinate descent, and a logistic curve through its margins on
rows kept from that fit gives the score.

Fitting: at most about SAMPLE labelled rows, drawn by a hash of the id, whose
crc32(id as text) mod 3 is not 1. Only text and quality of these rows are read.

Scale: the sample's ids have a proven bound and are broadcast to the scan; their
packed features, a few kilobytes a row, are fitted on the driver; scoring is a
map with one weight vector, no shuffle.

Null and empty texts score as a text without n-grams (the curve at the bias).
Without labels of both kinds every text scores 0.5. Repeated rows repeat, a
document with several labels counts with the greatest, null ids and null labels
teach nothing, extra columns are dropped, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .langid import held_out
from .shared import parts, schema_with

BITS = 16
WIDTHS = (2, 3, 4)
#: Labelled rows that the model is fitted on, about.
SAMPLE = 8000
PENALTY = 1.0
EPOCHS = 12


def indicators(text: str | None) -> np.ndarray:
    """Bins of the n-grams of a text, each once, ascending."""
    codes = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, bool)
    for width in WIDTHS:
        seen[ngrams.hashed(codes, width, BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    #: Log-count ratio and weight of each bin.
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    #: The curve: score = 1 / (1 + exp(-(slope * margin + shift))).
    slope: float
    shift: float

    def margin(self, bins: np.ndarray) -> float:
        r = self.ratio[bins]
        norm = math.sqrt(float(r @ r))
        return float(self.weight[bins] @ r) / norm + self.bias if norm else self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss by dual coordinate descent; the bias is the weight of a constant feature."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    size = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            b, v, y = rows[i], values[i], sign[i]
            gradient = y * (float(w[b] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[b] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-6 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(theta[1])


def _ratio(features: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bin, good to bad, with one added to each count."""
    count = np.ones((2, 1 << BITS))
    for b, y in zip(features, label, strict=True):
        count[int(y), b] += 1
    return np.log(count[1] / (int((label == 1).sum()) + 2)) - np.log(count[0] / (int((label == 0).sum()) + 2))


def _scaled(ratio: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The ratios of a text's bins, as a vector of length 1."""
    r = ratio[bins]
    norm = math.sqrt(float(r @ r))
    return r / norm if norm else r


def train(features: list[np.ndarray], label: np.ndarray) -> Model:
    """Fit on bins and 0/1 labels of a bounded number of rows."""
    flat = Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0.0)
    good, bad = int((label == 1).sum()), int((label == 0).sum())
    if not good or not bad:
        return flat
    sign = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, PENALTY * len(label) / (2 * good), PENALTY * len(label) / (2 * bad))
    # Margins of rows that neither ratios nor weights have seen make the curve: two halves, each scored by the other's.
    half = np.arange(len(label)) % 2 == 0
    margin = np.zeros(len(label))
    for part in (half, ~half):
        own = np.flatnonzero(part)
        if len(set(label[own].tolist())) < 2:
            continue
        ratio = _ratio([features[i] for i in own], label[own])
        w, bias = _descend([features[i] for i in own], [_scaled(ratio, features[i]) for i in own], sign[own], cost[own])
        for i in np.flatnonzero(~part):
            margin[i] = float(w[features[i]] @ _scaled(ratio, features[i])) + bias
    slope, shift = _curve(margin, label)
    ratio = _ratio(features, label)
    w, bias = _descend(features, [_scaled(ratio, b) for b in features], sign, cost)
    return Model(ratio, w, bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn `quality` of labels (doc_id, quality) from the texts of docs (doc_id, text)."""
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scale = 1 << 30
    n = known.count()
    limit = int(min(1.0, sample / max(n, 1)) * scale)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < limit)
    # At most about `sample` ids: bounded whatever the input.
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            packed = [indicators(t).astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "quality", "bins"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality {labels.schema['quality'].dataType.simpleString()}, bins binary"
    rows = picked.select("doc_id", "text", "quality").mapInArrow(features, kinds).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    bins = [np.frombuffer(b.as_buffer(), "<u2").astype(np.int64) for b in rows["bins"]]
    return train(bins, np.array(rows["quality"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1, higher: better) and `predicted`; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors of 2^BITS numbers
    schema = schema_with(docs, score="double", predicted="integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in parts(batches):
            got = np.array([own.score(t) for t in batch.column(place).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of operator 8: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
