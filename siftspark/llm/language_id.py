"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the counts of its byte n-grams (1 to 4, A-Z lower-cased, other than letters as one separator) in 2**13
hashed dimensions, damped, weighted by inverse document frequency and normalised. Every language has up to
``CENTROIDS`` centroids from spherical k-means over its sampled rows. A text gets the language of the nearest
centroid by cosine. It is marked as rejected where it lies farther than the ``RADIUS`` quantile of the sampled
rows of that centroid; the nearest language is still told.

The fit uses at most ``per_language`` rows of each language (a documented bound; those whose seeded hash of the id
is smallest, none of them held out). Language, source and id are never inputs of a prediction.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any sampled row all are ``und``;
null languages are not learned; repeated rows are predicted each; texts of any length are read whole, by their bytes whether
UTF-8 or not; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LETTER, blocks, held_out, lean, mix, small_batches
from .features import sample_ids, sample_texts

DIMS = 1 << 13
NGRAMS = (1, 2, 3, 4)
CENTROIDS = 4
RADIUS = 0.999

_FOLD = np.full(256, 0x20, np.uint64)
_FOLD[_LETTER] = np.flatnonzero(_LETTER)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped n-gram counts, a row of DIMS for each text."""
    n = len(offsets) - 1
    letter = _FOLD[data]
    out = np.zeros((n, DIMS), np.float32)
    grams, valid = np.zeros(len(data), np.uint64), np.ones(len(data), bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    hashed: list[np.ndarray] = []
    for length in range(1, max(NGRAMS) + 1):
        m = len(data) - length + 1
        if m <= 0:
            break
        grams = grams[:m] << np.uint64(8) | letter[length - 1 :]
        valid = valid[:m] & (~edge[length - 1 : length - 1 + m] if length > 1 else True)
        if length in NGRAMS:
            bucket = (mix(grams + np.uint64(length << 40)) & np.uint64(DIMS - 1)).astype(np.int32)
            bucket[~valid] = -1
            hashed.append(bucket)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        for bucket in hashed:
            part = bucket[a:b]
            part = part[part >= 0]
            if len(part):
                out[i] += np.bincount(part, minlength=DIMS)
    return np.log1p(out)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    center: np.ndarray  # centroid x DIMS, normalised
    idf: np.ndarray
    radius: np.ndarray  # least cosine of each centroid


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    center = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ center.T).argmax(1)
        center = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else center[j] for j in range(len(center))]))
    return center


def fit(x: np.ndarray, language: list[str], *, k: int = CENTROIDS, seed: int = 5) -> Centroids:
    """``x``: rows of ``vectors``."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _unit(x * idf)
    language_of = np.array(language)
    names, centers, radii = [], [], []
    for name in sorted(set(language)):
        own = x[language_of == name]
        center = _kmeans(own, k, seed)
        near = own @ center.T
        for j in range(len(center)):
            mine = near[near.argmax(1) == j, j]
            names.append(name)
            centers.append(center[j])
            radii.append(np.quantile(mine, 1 - RADIUS) if len(mine) else 1.0)
    return Centroids(names, np.array(centers, np.float32).reshape(-1, DIMS), idf, np.array(radii))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for _, data, offsets in blocks(batch.column(2), 1 << 19, 256):
            out += [x.astype(np.float16).tobytes() for x in vectors(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, *, per_language: int = 600, most_languages: int = 256, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Centroids from at most ``per_language`` rows of each language, and ``most_rows`` in all, which is what comes to the driver; of more than
    ``most_languages`` values of lang those with the most rows are languages."""
    known = docs.where(~held_out(F.col(id_col))).where(F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("label"))
    labels = known.where("label is not null").groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(most_languages)
    labels = [r["label"] for r in labels.collect()]
    sample = sample_ids(known.where(F.col("label").isin(labels)), min(per_language, max(1, most_rows // len(labels)))) if labels else []
    if not sample:
        return Centroids([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))
    got = sample_texts(docs, sample, "string", id_col, text_col).mapInArrow(lean(_sampled), "doc_id long, label string, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32), [r["label"] for r in got])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Centroids = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, len(names) - 1), np.zeros(n)
            far = np.zeros(n, bool)
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if len(model.languages):
                for first, data, offsets in blocks(batch.column(0), 1 << 19, 256):
                    near = _unit(vectors(data, offsets) * model.idf) @ model.center.T
                    rows = slice(first, first + len(near))
                    best[rows] = near.argmax(1)
                    score[rows] = np.clip(near.max(1), 0, 1)
                    far[rows] = near.max(1) < model.radius[best[rows]]
            best[~letters] = len(names) - 1
            score[~letters] = 0
            cols = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(far | ~letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def language_id(docs: DataFrame, *, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    model = train(docs, per_language=per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x DIMS floats for each language
    text = F.col(text_col)
    rows = docs.select(text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(lean(_predicted(shared)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
