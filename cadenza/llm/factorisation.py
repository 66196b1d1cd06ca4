"""A factorisation machine over hashed words, structure statistics and metadata that scores document quality."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = 12
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class QualityModel:
    """``max_rows`` bounds the labelled rows that the model is fitted on (those of least hash); the rest is training."""

    bits: int = 13
    rank: int = 8
    max_rows: int = 6000
    epochs: int = 12
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


def statistics(text: str, words: list[str], n_distinct: int) -> list[float]:
    """Structure statistics of a text, each about 0 to 1; n_chars is the metadata that says nothing about its label."""
    n = max(len(text), 1)
    m = max(len(words), 1)
    lines = text.split("\n")
    marks = sum(text.count(c) for c in "#*$%&|<>")
    return [
        min(np.log1p(len(text)) / 12, 1.0),
        marks / n * 4,
        sum(text.count(c) for c in ".,;:") / n * 8,
        text.count("!") / n * 8,
        sum(w.isupper() for w in words) / m,
        sum(w[0].isupper() for w in words) / m,
        n_distinct / m,
        min(sum(map(len, words)) / m / 12, 1.0),
        1 - len(set(lines)) / len(lines),
        min(len(lines) / m * 4, 1.0),
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(text.count(d) for d in "0123456789") / n * 4,
    ]


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed lower-cased words (root of their counts, scaled to length 1), then the statistics."""
    text = text or ""
    words = _WORD.findall(text)
    counts: dict[int, int] = {}
    low: dict[str, int] = {}
    for w in words:
        low[w] = low.get(w, 0) + 1
    mask = (1 << bits) - 1
    for w, c in low.items():
        k = zlib.crc32(w.lower().encode()) & mask
        counts[k] = counts.get(k, 0) + c
    index = np.fromiter(counts.keys(), np.int32, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    norm = float(np.sqrt((value * value).sum())) or 1.0
    stats = np.array(statistics(text, words, len(low)), np.float32)
    return np.concatenate([index, (1 << bits) + np.arange(STATS, dtype=np.int32)]), np.concatenate([value / norm, stats]).astype(np.float32)


class FactorisationMachine:
    """Bias, weights w and factors V; the pairs' sum is half of (sum of Vx) squared less the sum of squares."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
        linear = np.add.reduceat(self.w[index] * value, starts)
        vx = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1)

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, model: QualityModel) -> FactorisationMachine:
        """Logistic loss by AdaGrad in small batches, in an order that the seed fixes. No rows, or one label only: a constant."""
        size = (1 << model.bits) + STATS
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
        rng = np.random.default_rng(model.seed)
        w, v = np.zeros(size, np.float32), (rng.standard_normal((size, model.rank)) * 0.01).astype(np.float32)
        fm = FactorisationMachine(float(np.log(share / (1 - share))), w, v)
        if len(set(labels.tolist())) < 2:
            v[:] = 0
            return fm
        gw, gv = np.full(size, 1e-6, np.float32), np.full((size, model.rank), 1e-6, np.float32)
        gb = 1e-6
        for _ in range(model.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), model.batch):
                pick = order[at : at + model.batch]
                index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                sizes = np.array([len(rows[i][0]) for i in pick])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = v[index] * value[:, None]
                sums = np.add.reduceat(vx, starts)
                margin = fm.bias + np.add.reduceat(w[index] * value, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(1)
                delta = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
                each = np.repeat(delta, sizes).astype(np.float32) * value
                uniq, inverse = np.unique(index, return_inverse=True)
                dw = np.bincount(inverse, each, len(uniq)).astype(np.float32) + model.decay * w[uniq]
                step = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                dv = np.zeros((len(uniq), model.rank), np.float32)
                np.add.at(dv, inverse, step)
                dv += model.decay * v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                w[uniq] -= model.rate * dw / np.sqrt(gw[uniq])
                v[uniq] -= model.rate * dv / np.sqrt(gv[uniq])
                gb += float(delta.sum()) ** 2
                fm.bias -= model.rate * float(delta.sum()) / gb**0.5
        return fm


def held_out(doc_id: Column) -> Column:
    """Whether a row may never be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, model: QualityModel = QualityModel()) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out; a doc_id with two different labels is left out."""
    known = labels.select("doc_id", F.col("quality").alias("q")).where("doc_id is not null and q in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("q2")).where("q = q2")
    chosen = known.select("doc_id", "q").orderBy(F.xxhash64("doc_id"), "doc_id").limit(model.max_rows)
    # One row a doc_id, the one of least text, so that the rows sent to the driver are bounded whatever repeats.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("q").alias("q"))
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                names=["doc_id", "q", "index", "value"],
            )

    table = sample.select("doc_id", "text", F.col("q").cast("int").alias("q")).mapInArrow(run, "doc_id bigint, q int, index array<int>, value array<float>").toArrow()
    rows = sorted(zip(table["doc_id"].to_pylist(), range(table.num_rows)))
    index, value, q = table["index"].combine_chunks(), table["value"].combine_chunks(), table["q"].to_pylist()
    picked = [(index[i].values.to_numpy(), value[i].values.to_numpy()) for _, i in rows]
    return FactorisationMachine.fit(picked, np.array([q[i] for _, i in rows], np.float32), model)


def score_quality(docs: DataFrame, fm: FactorisationMachine, model: QualityModel = QualityModel()) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted. Only the text (null: empty) enters the score; the model's size is fixed."""
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins: list[float] = []
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 256):
                margins += fm.margins([features(t, bits) for t in texts[at : at + 256]]).tolist()
            score = 1 / (1 + np.exp(-np.clip(np.array(margins, float), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, model: QualityModel = QualityModel()) -> DataFrame:
    """Fit and score. Empty labels give every document the same score; repeated rows get equal scores."""
    return score_quality(docs, fit_quality(docs, labels, model), model)
