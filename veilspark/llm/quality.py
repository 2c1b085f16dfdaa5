"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Statistics of the whole text (lengths, kinds of characters, repetition of words, word pairs and lines) are
standardised and mapped to cosines of random projections, which approximate a Gaussian kernel. Each partition sums its
part of the normal equations for each of FOLDS folds; the labelled rows are dealt to PARTS partitions first, so the driver gets few
matrices of fixed size whatever the input. Calibration is cross-fitted: each labelled row is scored by the ridge weights of
the other folds, partitions count these scores over a fixed grid, adjacent violators are pooled, and the curve runs straight
from the middle of one pool to the next. The outermost pools count half a row of the other label, so no score is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import packed, ship, written

U64 = np.uint64
COSINES, WIDTH, RIDGE, GRID = 256, 0.25, 1e-2, 400
#: Labelled rows that the model is fitted on: those of least hash.
MOST_LABELLED = 50_000
#: Folds of the cross-fitted calibration, and partitions that labelled rows are summed in.
FOLDS, PARTS = 5, 8

_KIND = np.full(256, 9, np.uint8)  # other ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10], _KIND[33] = 0, 1, 2, 3, 4, 5
_KIND[[44, 46, 58, 59, 63, 39, 45]] = 6
_KIND[[35, 36, 37, 38, 42]] = 7
_KIND[128:] = 8
KINDS = 10
FEATURES = 8 + KINDS


def _distinct(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many distinct hashes, and how often the commonest occurs."""
    if not len(doc):
        return np.zeros(docs), np.zeros(docs)
    order = T.by_doc(doc, hashes)
    doc, hashes = doc[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]))
    most = np.zeros(docs)
    np.maximum.at(most, doc[new], np.diff(np.append(new, len(doc))))
    return np.bincount(doc[new], minlength=docs).astype(float), most


_LINE = np.zeros(256, bool)
_LINE[10] = True


def statistics(chunk: T.Chunk) -> np.ndarray:
    """A row of FEATURES numbers for each document; zeros where there is no text."""
    docs, sizes = len(chunk.offsets) - 1, np.diff(chunk.offsets)
    owner = np.repeat(np.arange(docs), sizes)
    kinds = np.bincount(owner * KINDS + _KIND[chunk.data], minlength=docs * KINDS).reshape(docs, KINDS)
    w = T.words(chunk, T.SPACE, lower=True)
    n = np.diff(w.per_doc)
    length = (w.end - w.start).astype(float)
    per = lambda x: np.bincount(w.doc, weights=x, minlength=docs) / np.maximum(n, 1)
    unique, most = _distinct(w.doc, w.hash, docs)
    pair, whole = T.windows(w, 2)
    at = np.flatnonzero(whole)
    pairs, _ = _distinct(w.doc[at], pair[at], docs)
    lines = T.words(chunk, _LINE, lower=False)
    n_lines = np.diff(lines.per_doc)
    distinct_lines, _ = _distinct(lines.doc, lines.hash, docs)
    out = [np.log1p(sizes), np.log1p(n), per(length), unique / np.maximum(n, 1), most / np.maximum(n, 1), pairs / np.maximum(n - 1, 1), distinct_lines / np.maximum(n_lines, 1), per(length <= 3)]
    return np.column_stack([*out, kinds / np.maximum(sizes, 1)[:, None]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column(1)):
            x = statistics(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Calibrated score at each point of the grid.
    steps: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        w, b = rng.normal(0, WIDTH, (FEATURES, COSINES - 1)), rng.uniform(0, 2 * np.pi, COSINES - 1)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / COSINES) * np.cos(z @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    @staticmethod
    def cell(raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.5) * (GRID / 2)).astype(int), 0, GRID - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[self.cell(self.raw(x))]


def _sums(make):
    """One row a partition: the sum over its rows of make(x, y, fold), a fixed-size matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = make(_matrix(batch.column(0)), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["part"])

    return run


def _summed(rows: DataFrame, make) -> np.ndarray | None:
    parts = rows.mapInArrow(_sums(make), "part binary").collect()  # PARTS matrices at the most
    return sum(np.frombuffer(p.part) for p in sorted(parts)) if parts else None


def pooled(good: np.ndarray, n: np.ndarray) -> list[tuple[float, float, int]]:
    """Runs of cells (label 1, rows, number of cells) whose shares of label 1 don't fall, nearest to good / n."""
    blocks: list[list[float]] = []
    for g, m in zip(good, n, strict=True):
        blocks.append([g, m, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            g2, m2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + m2, blocks[-1][2] + c2]
    return [(g, m, int(c)) for g, m, c in blocks]


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing step function nearest to good / n, weighted by n; cells without rows take the value before."""
    return np.concatenate([np.full(c, (g + 0.5 * (m == 0)) / max(m, 1)) for g, m, c in pooled(good, n)])


def curve(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """isotonic() with straight lines between the pools' middles (of their rows) and outermost values short of certain."""
    middles, values, at = [], [], 0
    for g, m, c in pooled(good, n):
        weight = n[at : at + c] if m else np.ones(c)
        middles.append(float((np.arange(at, at + c) * weight).sum() / weight.sum()))
        values.append((g + 0.5) / (m + 1) if g in (0, m) else g / m)
        at += c
    return np.interp(np.arange(len(n)), middles, np.maximum.accumulate(values))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (array of doubles) for each row; a null text counts as empty. Repeated rows give repeated rows; other columns
    are ignored."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_features, f"id {docs.schema[0].dataType.simpleString()}, x array<double>")


def fit(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", *, most: int = MOST_LABELLED) -> Model:
    """Fit on features and labelled rows, most of them at the most. Null ids and labels teach nothing; where labels of one id
    disagree, 1 counts; rows that share an id all teach.

    Without rows of both labels every score is the share of label 1 among the rows there are, or 0.5 without any.
    """
    ship(found.sparkSession)
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = found.join(F.broadcast(labels), "id").select("x", "y", F.expr(f"cast(pmod(xxhash64(id, 5), {FOLDS}) as int)").alias("fold"))  # most rows of 16 bytes
    rows = written(rows.repartition(PARTS), "labelled")  # round robin: copies have one x
    moments = _summed(rows, lambda x, y, _: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    model = Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(COSINES), np.full(GRID, 0.5))
    if moments is None:
        return model
    n, ones = moments[:2]
    if ones in (0, n):
        model.steps = np.full(GRID, ones / n)
        return model
    model.mean = moments[2 : 2 + FEATURES] / n
    model.scale = np.sqrt(np.maximum(moments[2 + FEATURES :] / n - model.mean**2, 0)) + 1e-6

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = model.cosines(x)
        parts = [(z[fold == f], y[fold == f]) for f in range(FOLDS)]
        return np.concatenate([np.column_stack([a.T @ a, a.T @ b]).ravel() for a, b in parts])

    sums = _summed(rows, normal).reshape(FOLDS, COSINES, COSINES + 1)
    solved = lambda s: np.linalg.solve(s[:, :-1] + RIDGE * np.eye(COSINES), s[:, -1])
    model.weights = solved(sums.sum(axis=0))
    others = np.array([solved(sums.sum(axis=0) - s) for s in sums])

    def counted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        cell = model.cell((model.cosines(x) * others[fold]).sum(axis=1))
        return np.concatenate([np.bincount(cell, weights=y, minlength=GRID), np.bincount(cell, minlength=GRID).astype(float)])

    counts = _summed(rows, counted)
    model.steps = curve(counts[:GRID], counts[GRID:])
    return model


def score(found: DataFrame, model: Model) -> DataFrame:
    """id and score (0 to 1) for each row of features."""
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))) if len(batch) else [], pa.float64())], names=["id", "score"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, score double")
