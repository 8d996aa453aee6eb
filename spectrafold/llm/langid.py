"""Language identification (operator 5): nearest centroid.

A text is lower-cased, everything but letters becomes one space, and its
character n-grams of one to three are hashed into bins. Its vector is
(1 + log count) * idf, normalised. Each language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the greatest
cosine. It is rejected when that cosine is far below what texts of the same
length have in training (distance-based rejection), or when it has no letter.

Fitting: document frequencies are summed over all training rows; centroids and
radii come from a sample of at most about SAMPLE rows a language, drawn by a
hash of the id. Training rows have a language and a crc32(id as text) mod 3
other than 1. Prediction reads the text alone.

Scale: two map passes with one bounded vector a task to sum, one bounded group
a language, and a map to predict; no text is shuffled but the sample's features.

Null texts and texts without a letter are `und` with score 0. Without training
rows every text is `und`. Repeated rows repeat, null ids count as the empty
text's checksum, extra columns are dropped, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .shared import array_parts, parts, schema_with

BITS = 13
WIDTHS = (1, 2, 3)
CENTROIDS = 4
#: Rows of a language that centroids and radii are fitted on, about.
SAMPLE = 1000
ROUNDS = 8
#: A text is too far where its cosine is below this share of the least in training at its length.
LENIENCE = 0.5
#: With fewer training texts of about a length than ENOUGH, only a cosine below FEW is too far.
ENOUGH, FEW = 20, 0.1
_LENGTHS = 24


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bins of a text, how often each occurs, and the number of letters."""
    codes = ngrams.code_points((text or "").lower())
    letter = ngrams.letters()[codes]
    n = int(letter.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[letter | np.concatenate(([True], letter[:-1]))]
    codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
    total = np.zeros(1 << BITS, np.int64)
    for width in WIDTHS:
        total += np.bincount(ngrams.hashed(codes, width, BITS), minlength=1 << BITS)
    bins = np.flatnonzero(total)
    return bins, total[bins].astype(np.float32), n


def _vector(bins: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[bins]
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).astype(np.float32)


def _length(letters: int) -> int:
    return min(_LENGTHS - 1, int(letters).bit_length())


@dataclass
class Model:
    languages: list[str]
    #: One row a centroid, and the place of its language.
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    #: Least cosine of a text that is not rejected: by language and length.
    radius: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        bins, count, n = counts(text)
        if not n or not len(self.owner):
            return "und", 0.0, True
        cosine = self.centroids[:, bins] @ _vector(bins, count, self.idf)
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        language = int(self.owner[best])
        return self.languages[language], score, bool(score < self.radius[language, _length(n)])


def _mean(vectors: np.ndarray, chosen: np.ndarray, width: int = 512) -> np.ndarray:
    """Mean of the chosen rows, some columns at a time: a cluster may have nearly all rows, and is not copied whole."""
    return np.concatenate([vectors[:, at : at + width][chosen].mean(0) for at in range(0, vectors.shape[1], width)])


def _cluster(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int(np.argmax(vectors @ vectors.mean(0)))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(CENTROIDS, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centres = vectors[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T, axis=1)
        rows = [_mean(vectors, own == k) for k in range(len(centres)) if (own == k).any()]
        centres = np.stack(rows)
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(norm > 0, norm, 1)
    return centres.astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and language of the training rows of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                bins, _, letters = counts(text)
                df[bins] += 1
                n += bool(letters)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(1 << BITS), -1)), pa.array(np.append(df, n))], names=["bin", "n"])

    summed = rows.select("text").mapInArrow(frequencies, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS, np.float64)
    inside = summed[summed.bin >= 0]
    df[inside.bin.to_numpy(np.int64)] = inside.n
    total = float(summed.n[summed.bin < 0].sum())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # About `sample` rows of each language, by the hash of the id and the text.
    scale = 1 << 30
    share = F.create_map(*[x for k, n in many.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * scale)))]) if many else None
    empty = Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64), idf, np.zeros((0, _LENGTHS)))
    if share is None:
        return empty
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < share[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [counts(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.astype("<u2").tobytes() for b, _, _ in got], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c, _ in got], pa.binary()), pa.array([n for _, _, n in got], pa.int64())],
                names=["lang", "bins", "counts", "letters"],
            )

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group.letters > 0].sort_values(["letters", "bins", "counts"], kind="stable")
        if group.empty:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        vectors = np.zeros((len(group), 1 << BITS), np.float32)
        for k, (b, c) in enumerate(zip(group.bins, group.counts, strict=True)):
            bins = np.frombuffer(b, "<u2").astype(np.int64)
            vectors[k, bins] = _vector(bins, np.frombuffer(c, "<f4"), idf)
        centres = _cluster(vectors)
        cosine = (vectors @ centres.T).max(1)
        length = np.array([_length(n) for n in group.letters])
        # Longer texts lie nearer: the least cosine among texts of about this length; lengths without a text take that of a shorter one.
        radius = np.zeros(_LENGTHS)
        for k in range(_LENGTHS):
            near = cosine[np.abs(length - k) <= 1]
            radius[k] = LENIENCE * near.min() if len(near) else radius[max(k - 1, 0)]
            if len(near) < ENOUGH:
                radius[k] = min(radius[k], FEW)
        return pd.DataFrame({"lang": group.lang.iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centres], "radius": [radius.astype("<f8").tobytes()] * len(centres)})

    found = (
        drawn.select("lang", "text").mapInArrow(features, "lang string, bins binary, counts binary, letters bigint")
        .groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, radius binary").toPandas()
    )
    if found.empty:
        return empty
    found = found.sort_values("lang", kind="stable")
    languages = sorted(set(found.lang))
    owner = np.array([languages.index(x) for x in found.lang])
    radius = np.stack([np.frombuffer(found.radius[found.lang == x].iloc[0], "<f8") for x in languages])
    return Model(languages, np.stack([np.frombuffer(c, "<f4") for c in found.centroid]), owner, idf, radius)


_PREDICTION = (("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("rejected", "boolean", pa.bool_()))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine) and rejected; columns of these names are replaced."""
    docs = docs.drop(*[n for n, _, _ in _PREDICTION])
    place = docs.columns.index(text)
    schema = schema_with(docs, **{name: kind for name, kind, _ in _PREDICTION})
    model = docs.sparkSession.sparkContext.broadcast(model)  # languages times a few centroids of fixed width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in parts(batches):
            got = [own.predict(t) for t in batch.column(place).to_pylist()]
            added = [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(_PREDICTION)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with their own columns, which stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as in identify()

    @F.arrow_udf("boolean")
    def near(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in array_parts(texts):
            yield pa.array([not shared.value.predict(t)[2] for t in part.to_pylist()], pa.bool_())

    return docs.where(near(F.col(text)))


def predict_documents(docs: DataFrame) -> DataFrame:
    """Digest of operator 5: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).drop("text")
