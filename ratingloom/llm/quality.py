"""Text quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is compressed
with both, in blocks of a fixed size so that the dictionaries count as much at the end of a long text
as at its start. The normalised difference of the sizes, together with how far the text compresses at
all, goes through a logistic calibration, which is fitted on labelled texts that built no dictionary.

Only a bounded sample of the labelled rows is gathered for fitting; every text is scored whole.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import slices


#: Bytes of a text whose difference counts half: a few bytes of one word say little.
SHORT = 100


@dataclasses.dataclass(frozen=True)
class Limits:
    """Bounds of the sample that a fit gathers, and sizes of the model."""

    rows_per_label: int = 2000
    max_chars: int = 20_000
    dictionary_bytes: int = 64 << 10
    block: int = 4096
    level: int = 3


@dataclasses.dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the weights of the calibration; what score() sends to the tasks."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    limits: Limits

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=self.limits.level, dict_data=_dictionary(d), write_content_size=False, write_checksum=False) if d else None for d in (self.good, self.bad)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        with_good, with_bad = self.compressors()
        return _logistic(_features(texts, with_good, with_bad, self.limits.block) @ np.array(self.weights))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _own_lines(texts: list[str], seen: Counter[str]) -> list[str]:
    """The texts without the lines that other texts share: passages found everywhere say nothing of quality."""
    own = ("\n".join(line for line in t.split("\n") if seen[line] < 2) for t in texts)
    return [t for t in own if t]


def _train(texts: list[str], limits: Limits) -> bytes:
    """A dictionary from the texts' blocks; plain content where there is too little to train on, nothing where there is none."""
    raw = [b for t in texts for b in _blocks(t.encode("utf-8", "surrogatepass"), limits.block)]
    try:
        return zstandard.train_dictionary(limits.dictionary_bytes, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(raw)[: limits.dictionary_bytes]


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _features(texts: list[str | None], with_good: zstandard.ZstdCompressor | None, with_bad: zstandard.ZstdCompressor | None, block: int) -> np.ndarray:
    """Rows of (1, normalised difference, its share of the text, compressed share, its square)."""
    out = np.zeros((len(texts), 5))
    out[:, 0] = 1
    if with_good is None or with_bad is None:
        return out
    for k, text in enumerate(texts):
        if text:
            data = text.encode("utf-8", "surrogatepass")
            parts = _blocks(data, block)
            a, b = sum(len(with_good.compress(x)) for x in parts), sum(len(with_bad.compress(x)) for x in parts)
            least = min(a, b) / len(data)
            sure = 10 * len(data) / (len(data) + SHORT)
            out[k, 1:] = sure * (b - a) / (a + b), sure * (b - a) / len(data), 10 * min(least, 1.0), 10 * min(least, 1.0) ** 2
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionModel:
    """Learn from docs joined with labels by id, from rows where ``learn`` (an expression on __id) holds.

    Of each label, at most limits.rows_per_label rows of 1 to limits.max_chars characters are used,
    those whose ids have the smallest hashes; only these come to the driver. Rows without a text, an id
    or a label of 0 or 1 teach nothing. Without any usable row of a label the score is the share of good
    labels, smoothed.
    """
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label in (0, 1)")
    if learn is not None:
        named = named.where(learn)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).where(F.length("__text").between(1, limits.max_chars))
    counts = {r["__label"]: r["count"] for r in named.groupBy("__label").count().collect()}
    total = sum(counts.values())
    # Hash order picks ids evenly; twice the rows are asked for because labelled texts can be missing or too long.
    picked = None
    for label in (0, 1):
        some = named.where(F.col("__label") == label).distinct().orderBy(F.xxhash64("__id"), "__id").limit(2 * limits.rows_per_label)
        picked = some if picked is None else picked.unionByName(some)
    rows = texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("__label", "__id", "__text")
    sample: dict[int, list[str]] = {0: [], 1: []}
    for label in (0, 1):
        of = rows.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id", "__text").limit(limits.rows_per_label)
        sample[label] = [r["__text"] for r in of.collect()]
    prior = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    if len(sample[0]) < 2 or len(sample[1]) < 2:
        return CompressionModel(b"", b"", (float(prior), 0.0, 0.0, 0.0, 0.0), limits)
    seen = Counter(line for v in sample.values() for t in v for line in set(t.split("\n")))
    built = {k: _train(_own_lines(v[::2], seen), limits) for k, v in sample.items()}
    model = CompressionModel(built[1], built[0], (), limits)
    with_good, with_bad = model.compressors()
    held = {k: v[1::2] for k, v in sample.items()}
    x = np.concatenate([_features(held[k], with_good, with_bad, limits.block) for k in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    share = np.where(y == 1, counts[1] / total / len(held[1]), counts[0] / total / len(held[0])) * len(y)
    return dataclasses.replace(model, weights=tuple(map(float, _calibrate(x, y, share))))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability, from the whole text alone, that a text's label is 1.

    One row for each row of docs. Null and empty texts get the calibration's value for no evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: CompressionModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least threshold; empty and null texts go by the same rule."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            yield batch.filter(pa.array(own.scores(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
