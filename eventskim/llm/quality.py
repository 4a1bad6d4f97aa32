"""Quality by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled text.
A document is cut into pieces, each compressed with both; the difference of the two
sizes over their sum, for the document and for its worst piece, is calibrated to a
probability by logistic regression on rows the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .labelled import fit_logistic, held_out, probability, sample

PER_CLASS = 2500  # most labelled rows of each class that a fit looks at
PIECE_BYTES = 600
DICTIONARY_BYTES = 64 << 10
PIECES_OF_A_TEXT = 8  # of each text, spread over it, in a dictionary's training set
LEVEL = 3
THRESHOLD = 0.3


def _cut(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on pieces of ``texts``; the pieces themselves if there are too few."""
    samples = []
    for text in texts:
        cut = _cut(text)
        samples += cut[:: -(-len(cut) // PIECES_OF_A_TEXT)]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


@dataclass
class CompressionModel:
    """Dictionaries of bad and good text and the calibration; ``constant`` if labels lack a class."""

    bad: bytes
    good: bytes
    coefficients: np.ndarray | None
    constant: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.bad, self.good):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))
        return out

    @staticmethod
    def features(compressors: list[zstandard.ZstdCompressor], text: bytes) -> tuple[float, float, float]:
        cut = _cut(text)
        bad, good = ([len(c.compress(piece)) for piece in cut] for c in compressors)
        bad, good = np.array(bad, float), np.array(good, float)
        each = (bad - good) / (bad + good)
        # Large where the dictionary of good text compresses better.
        return (bad.sum() - good.sum()) / (bad.sum() + good.sum()), each.min(), good.sum() / (len(text) + 10.0 * len(cut))

    def scores(self, compressors: list[zstandard.ZstdCompressor], texts: list[str | None]) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(compressors, (t or "").encode()) for t in texts]).reshape(-1, 3)
        return probability(x, self.coefficients)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> CompressionModel:
    """Fit on at most ``per_class`` rows of each label; half train dictionaries, half calibrate."""
    rows = sample(docs, labels, label, (per_class, per_class))
    y = rows.labels
    texts = [t.encode() for t in rows.texts]
    half = np.zeros(len(y), bool)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[::2]] = True
    rest = ~half
    if min((y[half] == 0).sum(), (y[half] == 1).sum(), (y[rest] == 0).sum(), (y[rest] == 1).sum()) == 0:
        share = [float((y == k).sum() * rows.weights[k]) for k in (0, 1)]
        return CompressionModel(b"", b"", None, share[1] / sum(share) if sum(share) else 0.5)
    bad, good = (_dictionary([t for t, h, v in zip(texts, half, y, strict=True) if h and v == k]) for k in (0, 1))
    model = CompressionModel(bad, good, None)
    compressors = model.compressors()
    x = np.array([model.features(compressors, t) for t, h in zip(texts, half, strict=True) if not h])
    model.coefficients = fit_logistic(x, y[rest], rows.weights)
    return model


def score(df: DataFrame, model: CompressionModel, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the probability ``into`` of label 1; NULL is scored as empty text."""

    def start():
        compressors = model.compressors() if model.coefficients is not None else []
        return lambda texts: [pa.array(model.scores(compressors, texts), pa.float64())]

    return mapped(df, text, {into: "double"}, start)


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probability that ``labels.quality`` is 1, for every document's whole text."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
