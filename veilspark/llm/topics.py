"""Topics as clusters of hashed terms.

A text's vector holds, for WIDTH buckets of word hashes, the logarithm of the words that fall on them, scaled to length 1.
The mean vector of its language is taken off, so topics cut across languages. Spherical k-means starts from a
bounded sample (by hash of id and text, k-means++) and then runs ROUNDS rounds over all texts, each a sum by partition; clusters of
less than LEAST_SHARE of the texts are dissolved into the others. Vectors are written once, a byte a bucket; the driver
gets sums of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import packed, ship, written

WIDTH, TOPICS, ROUNDS = 256, 8, 3
#: Texts that the clusters start from, and the share of texts that a cluster, and a language with a mean of its own, must have.
SAMPLE, LEAST_SHARE, LANGUAGE_SHARE = 4096, 0.02, 1e-3
#: Rows whose vectors are made at once.
ROWS = 4096


def vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, last row and vectors (uint8) of runs of texts; a text without words has zeros."""
    for chunk in T.chunks(column):
        w = T.words(chunk, T.NON_ALNUM, lower=True)
        bucket = (w.hash % np.uint64(WIDTH)).astype(np.int64)
        for a in range(0, len(chunk.offsets) - 1, ROWS):
            b = min(a + ROWS, len(chunk.offsets) - 1)
            x, y = w.per_doc[a], w.per_doc[b]
            counts = np.log1p(np.bincount((w.doc[x:y] - a) * WIDTH + bucket[x:y], minlength=(b - a) * WIDTH).reshape(b - a, WIDTH))
            length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            yield chunk.first + a, chunk.first + b, np.rint(255 * counts / np.maximum(length, 1e-9)).astype(np.uint8)


@dataclass
class Topics:
    means: dict[str | None, np.ndarray]
    rest: np.ndarray
    centres: np.ndarray

    def centred(self, x: np.ndarray, languages: list) -> np.ndarray:
        kinds: dict = {}
        which = np.array([kinds.setdefault(v, len(kinds)) for v in languages], int)
        table = np.array([self.means.get(v, self.rest) for v in kinds], np.float32).reshape(-1, WIDTH)
        return x.astype(np.float32) / 255 - table[which]

    def numbers(self, x: np.ndarray, languages: list) -> np.ndarray:
        """The nearest centre of each row; -1 for a text without words."""
        if not len(x):
            return np.zeros(0, int)
        return np.where(x.any(axis=1), (self.centred(x, languages) @ self.centres.T).argmax(axis=1) if len(self.centres) else 0, -1)

    def names(self, texts: pa.Array, languages: list) -> list[str]:
        """topic and the number of the nearest centre, or empty."""
        out: list[str] = []
        for a, b, x in vectors(texts):
            out += ["empty" if n < 0 else f"topic{n}" for n in self.numbers(x, languages[a:b])]
        return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x in vectors(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["language", "draw", "vector"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _language_sums(known: set):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            x, languages = _matrix(batch.column(1)), batch.column(0).to_pylist()
            for v in set(languages):
                rows = x[[v == other for other in languages]]
                key = (v, True) if v in known else (None, False)
                old = sums.get(key, np.zeros(WIDTH + 1))
                sums[key] = old + np.append(rows.sum(axis=0, dtype=float) / 255, len(rows))
        rows = [(v, own, packed(s)) for (v, own), s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.bool_(), pa.binary()), strict=True)], names=["language", "own", "part"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("part").to_pylist())
    return pa.table({c: table.column(c).slice(0, 1) for c in table.column_names if c != "part"} | {"part": pa.array([packed(total)], pa.binary())})


def _cluster_sums(topics: Topics):
    k = len(topics.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k, WIDTH + 1))
        for batch in batches:
            x, languages = _matrix(batch.column(1)), batch.column(0).to_pylist()
            at = topics.numbers(x, languages)
            v = topics.centred(x, languages) if len(x) else np.zeros((0, WIDTH))
            for j in range(k):
                total[j] += np.append(v[at == j].sum(axis=0, dtype=float), (at == j).sum())
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId() % 64 if context else 0], pa.int32()), pa.array([packed(total)], pa.binary())], names=["k", "part"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    # rounded, so that the order in which partitions are added up doesn't show
    return np.round(x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9), 5).astype(np.float32)


def _start(v: np.ndarray, k: int) -> np.ndarray:
    """k-means++ and ten rounds on the sample; fewer centres where it has fewer different directions."""
    rng, u = np.random.default_rng(3), _unit(v)
    centres = u[:1]
    for _ in range(1, k):
        far = np.maximum(1 - (u @ centres.T).max(axis=1), 0).astype(float)
        if far.sum() < 1e-6:
            break
        centres = np.concatenate([centres, u[[rng.choice(len(u), p=far / far.sum())]]])
    for _ in range(10):
        at = (u @ centres.T).argmax(axis=1)
        centres = _unit(np.array([u[at == j].sum(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", topics: int = TOPICS) -> Topics:
    """Topics of all texts. Null texts count as empty, a null language as one of its own; texts without words teach nothing.

    Repeated rows count each time. Without any words there is no centre. Languages below LANGUAGE_SHARE share a mean, so means are bounded.
    """
    ship(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    found = docs.select(lang.alias("language"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw"))
    found = written(found.mapInArrow(_vectors, "language string, draw long, vector binary"), "vectors").filter(F.col("vector") != F.lit(bytes(WIDTH)))
    counts = written(found.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "languages")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Topics({}, np.zeros(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32))
    known = {r.language for r in counts.filter(F.col("n") >= total * LANGUAGE_SHARE).select("language").collect()}  # 1 / LANGUAGE_SHARE at the most
    pairs = found.select("language", "vector")
    sums = pairs.mapInArrow(_language_sums(known), "language string, own boolean, part binary").groupBy("language", "own").applyInArrow(_add, "language string, own boolean, part binary").collect()
    means, rest = {}, np.zeros(WIDTH, np.float32)
    for r in sums:
        s = np.frombuffer(r.part)
        mean = np.round(s[:-1] / max(s[-1], 1), 5).astype(np.float32)
        if r.own:
            means[r.language] = mean
        else:
            rest = mean
    model = Topics(means, rest, np.zeros((0, WIDTH), np.float32))
    # the draws below a bound that SAMPLE of all are expected to be; repeated rows share a draw, hence the limit
    few = found if total <= SAMPLE else found.filter(F.col("draw") < int(-(2**63) + 2**64 * SAMPLE / total))
    sample = sorted(few.limit(2 * SAMPLE).collect(), key=lambda r: (r.draw, bytes(r.vector), str(r.language)))  # twice SAMPLE vectors at the most
    model.centres = _start(model.centred(np.frombuffer(b"".join(bytes(r.vector) for r in sample), np.uint8).reshape(-1, WIDTH), [r.language for r in sample]), topics)
    for round_ in range(ROUNDS):
        parts = pairs.mapInArrow(_cluster_sums(model), "k int, part binary").groupBy("k").applyInArrow(_add, "k int, part binary").collect()  # 64 at the most
        sums = sum(np.frombuffer(r.part) for r in sorted(parts)).reshape(len(model.centres), WIDTH + 1)
        large = sums[:, -1] >= LEAST_SHARE * total if round_ == ROUNDS - 1 else sums[:, -1] > 0
        large[sums[:, -1].argmax()] = True
        order = np.argsort(-sums[:, -1], kind="stable")
        model.centres = _unit(sums[order[large[order]], :-1])
    return model


def topic_column(model: Topics, text: Column, language: Column) -> Column:
    """The topic's name of each row."""

    @F.arrow_udf("string")
    def named(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.array(model.names(texts, languages.to_pylist()), pa.string())

    return named(F.coalesce(text.cast("string"), F.lit("")), language.cast("string"))
