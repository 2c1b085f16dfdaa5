"""Benchmark decontamination by winnowing.

A benchmark item's windows are its runs of ten words (an item of fewer words is one window). From every run of six
neighbouring five-word grams the one of least hash is kept as fingerprint, in items and documents alike, so a span of
ten common words always has a common fingerprint. A document fingerprint that an item has too is a hit; it is
extended to the up to six windows around it by comparing whole windows, and their words are marked. Items shorter
than a window are looked up by the hash of the whole item.

Windows count as equal where two independent 64-bit hashes agree (2**-128 a pair). Each distinct window is looked up
once, whatever number of items hold it, and the items are named from a list kept with the window.

A benchmark up to BLOCK_BYTES goes to every task, and documents are scanned once and never shuffled. A larger one
stays distributed: its fingerprints go to every task as a Bloom filter of at most 2**MOST_LOG_BITS bits, one scan
of the documents deals out only windows around hits, those are joined with the benchmark's windows, and a second scan
gives each document row what was found for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import bitmap, ship, written

U64 = np.uint64
#: Words in a window, in a fingerprint's gram, and grams that compete for one fingerprint.
WINDOW, GRAM = 10, 5
#: Bytes of benchmark text that may go to every task.
BLOCK_BYTES = 8 << 20
#: Bits of the Bloom filter that stands for a larger benchmark: 64 MB at most; sixteen bits a fingerprint below that.
MOST_LOG_BITS = 29
#: Pairs of a document's window and an item that are listed at once.
PAIRS = 2_000_000


def fingerprints(w: T.Words, full: np.ndarray, whole: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some whole window (of equal ones the first), and which of them each whole window has."""
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, _ = T.windows(w, gram)
    width = window - gram + 1
    low = T.sliding_min(grams, width)[: len(full)]
    at = np.flatnonzero(whole)
    pick = np.full(len(at), -1)
    for k in range(width - 1, -1, -1):
        pick = np.where(grams[at + k] == low[at], at + k, pick)
    pick, which = np.unique(pick, return_inverse=True)
    return pick, grams[pick], which


def item_windows(column: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each window of the items: row, number of words, both hashes, and the hash it is looked for by (its fingerprint, or its own)."""
    parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3)]
    for chunk in T.chunks(column):
        w = T.words(chunk, T.NON_ALNUM, lower=True)
        twin = T.checked(chunk, w, lower=True)
        full, whole = T.windows(w, window)
        check, _ = T.windows(twin, window)
        _, grams, which = fingerprints(w, full, whole, window, gram)
        at = np.flatnonzero(whole)
        parts.append((w.doc[at] + chunk.first, np.full(len(at), window), full[at], check[at], grams[which]))
        n = np.diff(w.per_doc)
        short = np.flatnonzero((n > 0) & (n < window))
        if len(short):
            own, other = (np.array([T.span_hash(x, w.per_doc[d], w.per_doc[d + 1]) for d in short], np.uint64) for x in (w, twin))
            parts.append((short + chunk.first, n[short], own, other, own))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Items:
    """Distinct windows of some benchmark items, sorted by hash, with the items that hold each, and their fingerprints."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram, self.ids = window, gram, ids
        row, size, own, check, probe = item_windows(pa.array(texts, pa.string()), window, gram)
        self.short = sorted(set(size[size < window].tolist()))
        self.print = np.unique(probe[size == window])
        order = np.lexsort((row, check, own))
        row, own, check = row[order], own[order], check[order]
        new = np.ones(len(row), bool)
        new[1:] = (own[1:] != own[:-1]) | (check[1:] != check[:-1])
        again = np.zeros(len(row), bool)  # an item holds a window of its own more than once
        again[1:] = ~new[1:] & (row[1:] == row[:-1])
        self.rows = row[~again]
        self.hash, self.check = own[new], check[new]
        kept_new = new[~again]
        self.first = np.append(np.flatnonzero(kept_new), len(self.rows))

    def has_hash(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, hashes), max(len(self.hash) - 1, 0))
        return self.hash[at] == hashes if len(self.hash) else np.zeros(len(hashes), bool)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Number of the window equal in both hashes, or -1."""
        at, out = np.searchsorted(self.hash, hashes), np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        while len(left):  # one step but for windows that agree in one hash only
            left = left[(at[left] < len(self.hash))]
            left = left[self.hash[at[left]] == hashes[left]]
            same = self.check[at[left]] == checks[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def names(self, doc: np.ndarray, found: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by document, and the distinct items (row numbers) of each, for pairs of document and window."""
        pairs = np.unique(doc * len(self.hash) + found) if len(doc) else np.zeros(0, np.int64)
        doc, found = (pairs // len(self.hash), pairs % len(self.hash)) if len(pairs) else (pairs, pairs)
        counts = self.first[found + 1] - self.first[found]
        cuts, parts, a = np.searchsorted(doc, np.arange(docs + 1)), [], 0
        while a < docs:
            # as many documents as have PAIRS items to list, one at least
            b = a + 1
            total = counts[cuts[a] : cuts[b]].sum()
            while b < docs and total + (more := counts[cuts[b] : cuts[b + 1]].sum()) <= PAIRS:
                total, b = total + more, b + 1
            d, f, n = doc[cuts[a] : cuts[b]], found[cuts[a] : cuts[b]], counts[cuts[a] : cuts[b]]
            ends = np.cumsum(n)
            item = self.rows[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.first[f], n)]
            parts.append(np.unique(np.repeat(d, n) * len(self.ids) + item))
            a = b
        both = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        doc, item = (both // len(self.ids), both % len(self.ids)) if len(both) else (both, both)
        return np.searchsorted(doc, np.arange(docs + 1)), item


def around(at: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Starts of the whole windows that hold a gram at one of the positions."""
    starts = np.unique((at[:, None] - np.arange(width)).ravel())
    starts = starts[(starts >= 0) & (starts < len(whole))]
    return starts[whole[starts]]


def occurrences(chunk: T.Chunk, w: T.Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and number (in items) of each window found in the chunk's documents."""
    full, whole = T.windows(w, items.window)
    at, grams, _ = fingerprints(w, full, whole, items.window, items.gram)
    place = np.minimum(np.searchsorted(items.print, grams), max(len(items.print) - 1, 0))
    at = at[items.print[place] == grams] if len(items.print) else at[:0]
    starts = around(at, whole, items.window - items.gram + 1)
    starts = starts[items.has_hash(full[starts])]
    likely = [(items.window, starts, full[starts])]
    for n in items.short:
        hashes, inside = T.windows(w, n)
        starts = np.flatnonzero(inside)
        starts = starts[items.has_hash(hashes[starts])]
        likely.append((n, starts, hashes[starts]))
    first, length, found = [], [], []
    if any(len(s) for _, s, _ in likely):
        twin = T.checked(chunk, w, lower=True)
        for n, starts, hashes in likely:
            if len(starts):
                number = items.find(hashes, T.windows(twin, n)[0][starts])
                ok = number >= 0
                first.append(starts[ok])
                length.append(np.full(int(ok.sum()), n))
                found.append(number[ok])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (first, length, found))


def _marked(n_words: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.flatnonzero(np.cumsum(steps)[:-1] > 0)


def _scan(items: Items, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                w = T.words(chunk, T.NON_ALNUM, lower=True)
                docs = len(chunk.offsets) - 1
                first, length, found = occurrences(chunk, w, items)
                hit = _marked(len(w.hash), first, length)
                of, item = items.names(w.doc[first], found, docs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, docs),
                    pa.array(np.diff(w.per_doc).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, w.per_doc), pa.int32()), pa.array((hit - w.per_doc[w.doc[hit]]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array([items.ids[i] for i in item], pa.string())),
                ], names=names)

    return run


def _clean_rows(items: Items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for chunk in T.chunks(batch.column(at)):
                w = T.words(chunk, T.NON_ALNUM, lower=True)
                first, _, _ = occurrences(chunk, w, items)
                keep[chunk.first + w.doc[first]] = False
            yield batch.filter(pa.array(keep))

    return run


# ---- a benchmark of any size ----


def _listed(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, own, check, probe = item_windows(batch.column(1), window, gram)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(size.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (own, check, probe)]], names=["item", "n", "hash", "check", "probe"])

    return run


def _places(probe: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(T.mix(probe ^ U64(salt)) >> U64(64 - log_bits) for salt in (0x9FB21C651E98DF25, 0x2545F4914F6CDD1D))


def _bloom_places(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), log_bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places).view(np.int64))], names=["place"])

    return run


def _likely(bits, log_bits: int, window: int, gram: int, short: list[int]):
    """Windows around fingerprints, and short windows, that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)

        def passes(probe: np.ndarray) -> np.ndarray:
            ok = np.ones(len(probe), bool)
            for place in _places(probe, log_bits):
                ok &= (table[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
            return ok

        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                w = T.words(chunk, T.NON_ALNUM, lower=True)
                full, whole = T.windows(w, window)
                at, grams, _ = fingerprints(w, full, whole, window, gram)
                starts = around(at[passes(grams)], whole, window - gram + 1)
                found = [(window, starts, full)]
                for n in short:
                    hashes, inside = T.windows(w, n)
                    starts = np.flatnonzero(inside)
                    found.append((n, starts[passes(hashes[starts])], hashes))
                if not any(len(s) for _, s, _ in found):
                    continue
                twin = T.checked(chunk, w, lower=True)
                for n, starts, hashes in found:
                    if len(starts):
                        doc = w.doc[starts]
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(doc + chunk.first)), pa.array(np.full(len(starts), n, np.int32)), pa.array((starts - w.per_doc[doc]).astype(np.int32)),
                            pa.array(hashes[starts].view(np.int64)), pa.array(T.windows(twin, n)[0][starts].view(np.int64)),
                        ], names=["k", "n", "start", "hash", "check"])

    return run


def _found_at_large(keyed: DataFrame, items: DataFrame, window: int, gram: int, most_log_bits: int) -> DataFrame:
    """k, starts (of struct n, start) and items of the keys in which a window occurs, by a join."""
    listed = written(items.mapInArrow(_listed(window, gram), "item string, n int, hash long, check long, probe long"), "windows")
    count = listed.agg(F.count(F.lit(1))).first()[0]
    log_bits = min(most_log_bits, max(16, (16 * count).bit_length()))
    short = sorted(r.n for r in listed.filter(F.col("n") < window).select("n").distinct().collect())  # window - 1 numbers at the most
    bits = keyed.sparkSession.sparkContext.broadcast(bitmap(listed.select("probe").mapInArrow(_bloom_places(log_bits), "place long"), "place", log_bits))
    kind = keyed.schema["k"].dataType.simpleString()
    likely = keyed.mapInArrow(_likely(bits, log_bits, window, gram, short), f"k {kind}, n int, start int, hash long, check long").distinct()
    windows = listed.groupBy("hash", "check").agg(F.collect_set("item").alias("items"))
    hits = likely.join(windows, ["hash", "check"])
    return hits.groupBy("k").agg(F.collect_set(F.struct("n", "start")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _bounded_items(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> tuple[DataFrame, bool]:
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 16)).first()[0] or 0
    return items, size <= block_bytes


def _collected(items: DataFrame, window: int, gram: int) -> Items:
    rows = items.collect()  # at most block_bytes, as just summed
    return Items([r.i for r in rows], [r.t for r in rows], window, gram)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_log_bits: int = MOST_LOG_BITS) -> DataFrame:
    """One row per input row: its id, n_words (long), hit_words (positions from 0, ascending), items (ids as text, sorted).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Null and empty texts have no
    words, on either side. An empty benchmark leaves every document clean. Items with equal texts are all named; an
    item id that is null is named by nothing, though its windows are marked. Repeated rows give repeated rows, whatever
    the size of the benchmark; rows that share an id are judged each by its own text. Other columns are ignored.
    """
    ship(docs.sparkSession)
    items, small = _bounded_items(benchmark, item_col, item_text, block_bytes)
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    names = [id_col, "n_words", "hit_words", "items"]
    if small:
        schema = f"`{id_col}` {docs.schema[0].dataType.simpleString()}, n_words long, hit_words array<int>, items array<string>"
        out = docs.mapInArrow(_scan(_collected(items, window, gram), names), schema)
    else:
        key = F.struct(F.col(id_col).alias("id"), F.xxhash64("_text").alias("h"), F.octet_length("_text").alias("b")).alias("k")
        keyed = docs.select(key, "_text")
        found = _found_at_large(keyed, items, window, gram, most_log_bits).withColumnRenamed("k", "found_k")
        # capitals count as letters, as they are lower-cased first
        words = F.coalesce(F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        rows = docs.select(key, words.alias("n_words"))
        marked = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
        out = rows.join(found, rows.k.eqNullSafe(found.found_k), "left")
        out = out.select(F.col("k.id").alias(id_col), "n_words", F.coalesce(marked, F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("items", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_log_bits: int = MOST_LOG_BITS) -> DataFrame:
    """The rows of docs in whose text no benchmark window occurs; columns as given, whatever their names.

    Each row is judged by its own text, so null and repeated ids don't matter; null and empty texts stay.
    """
    ship(docs.sparkSession)
    items, small = _bounded_items(benchmark, item_col, item_text, block_bytes)
    if small and docs.schema[text_col].dataType.simpleString() == "string":
        return docs.mapInArrow(_clean_rows(_collected(items, window, gram), docs.columns.index(text_col)), docs.schema)
    text = F.col(text_col).cast("string")
    key = F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("b"))
    found = _found_at_large(docs.select(key.alias("k"), text.alias("_text")), items, window, gram, most_log_bits).select(F.col("k").alias("leaked_k"))
    return docs.join(found, key == found.leaked_k, "left_anti")


def items_digest(ids: list[str]) -> str:
    """What the query's items_sha256 holds; used by the tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
