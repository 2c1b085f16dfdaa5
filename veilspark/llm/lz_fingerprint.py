"""Lempel-Ziv phrase fingerprints.

Each text is parsed (LZ78, over its UTF-8 bytes) into phrases, each a known phrase and one byte more. The set of
phrase hashes is dealt to SLOTS slots by hash and reduced to each slot's minimum; the share of equal minima estimates how much
of their dictionaries two texts have in common, as a compressor that learns from one while packing the other would see
it. A text and its edited form share the parse of the part they have in common. Fingerprints are hexadecimal, eight digits a slot.

Neighbours in the order of ids are paired without a global sort in one task: rows are dealt by range of id, each range
also gets a copy of the next range's first row, and each range is read in order.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import edges_below, ship

U64 = np.uint64
SLOTS = 64
#: Bytes of text in a range.
RANGE_BYTES = 4 << 20
#: Ranges at the most (half a gigabyte each at 100 TB); larger ones are sorted with spill and read row by row.
MOST_RANGES = 200_000
_SLOT = np.arange(SLOTS, dtype=np.uint64) << U64(58)
EMPTY = "f" * (8 * SLOTS)


def _grow(node: dict, root: dict, data: bytes, base: int, ends: list[int], made: list[tuple[dict, int]]) -> dict:
    """Go on parsing: ends gets the last byte's place of each new phrase, made where the trie grew."""
    end, grew = ends.append, made.append
    for i, c in enumerate(data, base):
        following = node.get(c)
        if following is None:
            node[c] = {}
            grew((node, c))
            end(i)
            node = root
        else:
            node = following
    return node


def phrase_ends(data: bytes) -> list[int]:
    """Where the phrases of an LZ78 parse end; a last phrase that repeats an earlier one is left out."""
    root: dict = {}
    ends: list[int] = []
    _grow(root, root, data, 0, ends, [])
    return ends


def _minima(data: bytes, ends: list[int]) -> str:
    """One hash of each phrase; the top bits choose its slot, the least of a slot stays. An empty slot takes the next
    full one's value, changed by the distance."""
    if not ends:
        return EMPTY
    last = np.array(ends)
    start = np.concatenate([[0], last[:-1] + 1])
    up, down = T._BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._CODES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    h = np.sort(T.mix((sums[last + 1] - sums[start]) * down[start] + (last + 1 - start).astype(np.uint64)))
    at = np.searchsorted(h, _SLOT)
    inside = at < len(h)
    inside[inside] = h[at[inside]] >> U64(58) == _SLOT[inside] >> U64(58)
    full = np.flatnonzero(inside)
    take = np.searchsorted(full, np.arange(SLOTS))
    source = np.concatenate([full, full[:1] + SLOTS])[take]
    value = h[at[source % SLOTS]] + U64(0x9E3779B97F4A7C15) * (source - np.arange(SLOTS)).astype(np.uint64)
    return (value & U64(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """Null and empty texts have no phrases: every digit is f."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return _minima(data, phrase_ends(data))


def fingerprint_pair(text: str, new: str, same: int) -> tuple[str, str]:
    """Fingerprints of two texts that agree in their first same characters, which are parsed once."""
    a, b = text.encode("utf-8", "surrogatepass"), new.encode("utf-8", "surrogatepass")
    cut = len(text[:same].encode("utf-8", "surrogatepass"))
    root: dict = {}
    ends: list[int] = []
    node = _grow(root, root, a[:cut], 0, ends, [])
    known, made = len(ends), []
    _grow(node, root, a[cut:], cut, ends, made)
    mark = _minima(a, ends)
    for where, c in reversed(made):
        del where[c]
    del ends[known:]
    _grow(node, root, b[cut:], cut, ends, [])
    return mark, _minima(b, ends)


def likeness(a: str, b: str) -> float:
    """Share of equal slots, 0 to 1; two texts without phrases are alike, one is unlike any other."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    return float(np.mean(x == y))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters give way to the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(names: list[str]):
    """Rows sorted by range and order; the copy of the next range's first row comes last in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ready = None  # (range, id, text); and the row of the one before, which waits for this one's fingerprint
        gc.disable()  # tries hold no cycles
        for batch in batches:
            out: list[tuple] = []
            for place, is_copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held and held[0] == place:
                    _, own_id, own = held
                    new = edited(own, text)
                    mark, new_mark = fingerprint_pair(own, new, len(own) - len(own) // 2)
                    if ready:
                        out.append((*ready, likeness(ready[3], mark)))
                    ready = (own_id, len(own), new, mark, new_mark, likeness(mark, new_mark))
                    if is_copy:
                        out.append((*ready, likeness(mark, fingerprint(text))))
                        ready = None
                held = None if is_copy else (place, doc_id, text)
            if out:
                kinds = (batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _copies(rows: DataFrame, present: list[int]) -> DataFrame:
    """The first row of each range, placed in the range before it; the first range's in the last."""
    least = rows.groupBy("place").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.col("k"), F.coalesce("text", F.lit("")))).alias("r"))
    before = rows.sparkSession.createDataFrame([(p, present[i - 1]) for i, p in enumerate(present)], "place int, before int")  # two numbers a range
    return least.join(F.broadcast(before), "place").select(F.col("before").alias("place"), F.lit(1).alias("copy"), F.lit(None).cast("long").alias("k"), F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_chars (long), edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of next smaller id, after the last the first; null ids come last and rows of one id
    follow by text. A single row is its own next. Null texts count as empty. Equal texts have equal fingerprints. Other
    columns are ignored; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(1, -(-(size[0] or 0) // range_bytes)))
    cuts = sorted(set(docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 and size[1] else []
    # ascending k is descending id; range numbers ascend with k
    key = F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1))
    edges = sorted(-int(c) for c in cuts)
    place = edges_below(F.col("k"), edges)
    rows = docs.withColumn("k", key).select(place.cast("int").alias("place"), F.lit(0).alias("copy"), "k", "doc_id", "text")
    present = sorted(r[0] for r in rows.select("place").distinct().collect())  # a number for each range
    if not present:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {_OUT}")
    rows = rows.unionByName(_copies(rows, present)).repartition(max(len(present), 1), "place").sortWithinPartitions("place", "copy", "k", F.coalesce("text", F.lit("")))
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.select("place", "copy", "doc_id", "text").mapInArrow(_walk(names), f"doc_id long, {_OUT}")
