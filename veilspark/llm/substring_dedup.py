"""Removal of repeated word windows behind a count-min prefilter.

A window is twenty consecutive words of one document. Every word of a window that also starts earlier (in a document
of smaller id, or earlier in the same one) is removed; windows are judged on the input.

1. Sketch. Each window is represented by the ten-word gram of least hash among the eleven it holds (the first of equal
   ones). Two equal windows choose at the same place, so a repeated window's gram is chosen at two places at least.
   Each map task counts its chosen places in a count-min row (cells counted to 2) and sends it cell range by cell
   range; the rows of a range are added up in levels of FAN, so no task's share grows with the input. A cell
   overestimates: it holds all grams that fall on it.
2. Exact pass. Only windows whose cell counts 2 or more are dealt by their hash, once per batch: later ones of the batch
   are known to be repeats and are only reported. In each bucket the earliest occurrence of every window stays, all
   others are reported to their document. Windows that the sketch lets through by mistake find no second occurrence;
   none that is repeated is lost.
3. Documents meet their reports in packs of bounded size and drop the covered words.

The sketch's width follows the bytes of text (eight cells for a chosen gram, a power of two) and is broadcast up to
MAX_CELLS, a bit a cell. Beyond, the sketch stays where it was added up: chosen grams are dealt by range of cells, with
their document and place, each task counts its own range, and documents get back the places whose cells count 2 or more.
So the filter lets through as little at any size, and results are the same.

Windows count as equal where 96 bits of two independent hashes agree: for the 10^13 windows of 100 TB, one chance in
a thousand that any two different ones do. Where buckets are many, they are dealt in two levels (see WIDE).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import packed, ship

U64 = np.uint64
WINDOW = 20
#: One bit a cell is broadcast: 128 MB at most.
MAX_CELLS = 1 << 30
#: Ranges of the sketch, and parts of a range that are added up at once.
RANGES, FAN = 64, 64
#: More buckets than this are dealt in two levels, so that a batch never meets more than about its square root of them.
WIDE = 4096
#: Chosen grams, and windows, that a map task gathers before it deals them out.
FLUSH_GRAMS, FLUSH_WINDOWS = 1_500_000, 600_000
#: Bytes of text in a pack of documents, and in a bucket's share of windows.
PACK_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
_NULL_ID = -(1 << 63)
_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def _chosen(w: T.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each whole window its start and its chosen gram: 40 bits of hash over 24 bits of place in the chunk."""
    gram = window // 2
    _, whole = T.windows(w, window)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, _ = T.windows(w, gram)
    keys = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64) & U64(0xFFFFFF)
    low = T.sliding_min(keys, window - gram + 1)
    at = np.flatnonzero(whole)
    return at, low[at]


def _cell(chosen: np.ndarray, log_cells: int) -> np.ndarray:
    return T.mix(chosen >> U64(24)) >> U64(64 - log_cells)


def _slice(slices: int):
    """A number below slices for each batch that a map task sends off."""
    from pyspark import TaskContext

    context = TaskContext.get()
    n = context.partitionId() * 7919 if context else 0
    while True:
        yield n % slices
        n += 1


_SKETCH = {"range": pa.int32(), "slice": pa.int32(), "dense": pa.bool_(), "once": pa.binary(), "twice": pa.binary()}
_SKETCH_SQL = "range int, slice int, dense boolean, once binary, twice binary"


def _sketch(window: int, log_cells: int, slices: int):
    """Rows of one range each: cells met once and cells met more often by a batch."""
    shift = U64(log_cells - 6)

    def flush(held: list[np.ndarray], slice_: int) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(cells >> shift, np.arange(RANGES + 1))
        local, twice = (cells & ((U64(1) << shift) - U64(1))).astype(np.uint32), n > 1
        rows = [(i, slice_, False, packed(local[a:b][~twice[a:b]]), packed(local[a:b][twice[a:b]])) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SKETCH.values(), strict=True)], names=list(_SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, slice_ = [], 0, _slice(slices)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                _, low = _chosen(T.words(chunk, T.SPACE, lower=False), window)
                if not len(low):
                    continue
                new = np.ones(len(low), bool)
                new[1:] = low[1:] != low[:-1]  # neighbours that choose one place count it once
                held.append(_cell(low[new], log_cells))
                count += len(held[-1])
                if count >= FLUSH_GRAMS:
                    yield flush(held, next(slice_))
                    held, count = [], 0
        if held:
            yield flush(held, next(slice_))
        held.clear()
        T.release()

    return run


def _add_up(log_cells: int, slices: int):
    """The rows of a range and slice as one, with a bit for each cell met, and for each met more often."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << (log_cells - 6), np.uint8)
        for dense, once, twice in zip(*(table.column(c).to_pylist() for c in ("dense", "once", "twice")), strict=True):
            if dense:
                bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")
                counts = np.minimum(counts + bits(once) + bits(twice), 2)
            else:
                once = np.frombuffer(once, np.uint32)
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[np.frombuffer(twice, np.uint32)] = 2
        plane = lambda x: [packed(np.packbits(x, bitorder="little"))]
        row = ([table.column("range")[0].as_py()], [table.column("slice")[0].as_py() % slices], [True], plane(counts > 0), plane(counts > 1))
        return pa.table([pa.array(c, t) for c, t in zip(row, _SKETCH.values(), strict=True)], names=list(_SKETCH))

    return run


def sketch_bits(texts: DataFrame, window: int, log_cells: int, grams: int, flush: int = FLUSH_GRAMS, fan: int = FAN) -> bytes:
    """A bit for each cell that counts 2 or more, added up in levels of about fan batches."""
    slices = max(1, -(-grams // (flush * fan)))
    rows = texts.mapInArrow(_sketch(window, log_cells, slices), _SKETCH_SQL)
    while True:
        following = max(1, -(-slices // fan))
        rows = rows.groupBy("range", "slice").applyInArrow(_add_up(log_cells, following), _SKETCH_SQL)
        if slices == 1:
            break
        slices = following
    bits = bytearray((1 << log_cells) // 8)
    for r in rows.select("range", "twice").toLocalIterator():  # RANGES rows, a bit for each cell in all
        n = len(bits) // RANGES
        bits[r.range * n : (r.range + 1) * n] = r.twice
    return bytes(bits)


def _by_document(ids: np.ndarray, starts: np.ndarray, packs: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """(pack, ids, number of starts of each, starts), sorted."""
    pack = _pack_of(ids, packs)
    order = np.lexsort((starts, ids, pack))
    ids, starts, pack = ids[order], starts[order], pack[order]
    out = []
    at, where = np.unique(pack, return_index=True)
    where = np.append(where, len(ids))
    for p, a, b in zip(at, where, where[1:]):
        new = np.flatnonzero(np.concatenate([[True], ids[a:b][1:] != ids[a:b][:-1]]))
        out.append((int(p), packed(ids[a:b][new]), packed(np.diff(np.append(new, b - a)).astype(np.int32)), packed(starts[a:b].astype(np.uint32))))
    return out


def _pack_of(ids: np.ndarray, packs: int) -> np.ndarray:
    return (T.mix(ids.view(np.uint64)) % U64(packs)).astype(np.int32)


_ROWS = "kind int, place int, slice int, ids binary, counts binary, starts binary, hashes binary, checks binary"
_KINDS = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _arrow(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _reports(ids: np.ndarray, starts: np.ndarray, packs: int) -> list[tuple]:
    return [(1, p, 0, i, c, s, b"", b"") for p, i, c, s in _by_document(ids, starts, packs)]


def _dealt(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, starts: np.ndarray, places: np.ndarray, slice_: int) -> list[tuple]:
    """Rows of one place each, sorted by document."""
    order = np.lexsort((ids, places))
    hashes, checks, ids, starts, places = (x[order] for x in (hashes, checks, ids, starts, places))
    at, cut = np.unique(places, return_index=True)
    rows = []
    for p, x, y in zip(at, cut, np.append(cut[1:], len(places))):
        new = np.flatnonzero(np.concatenate([[True], ids[x:y][1:] != ids[x:y][:-1]]))
        rows.append((0, int(p), slice_, packed(ids[x:y][new]), packed(np.diff(np.append(new, y - x)).astype(np.int32)), packed(starts[x:y].astype(np.uint32)), packed(hashes[x:y]), packed(checks[x:y])))
    return rows


def _later_ones(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """All four sorted by window, then place; which come first of their window; which come later, in another place."""
    order = np.lexsort((starts, ids, checks, hashes))
    hashes, checks, ids, starts = (x[order] for x in (hashes, checks, ids, starts))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    at = np.maximum.accumulate(np.where(again, 0, np.arange(len(hashes))))
    return hashes, checks, ids, starts, ~again, again & ((ids != ids[at]) | (starts != starts[at]))  # a repeated row is the same document


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U64(20)) % U64(buckets)


def _window_rows(held: list[tuple], buckets: int, per: int, packs: int, slice_: int) -> list[tuple]:
    """Windows by place of per buckets, the first of each; the others as reports."""
    hashes, checks, ids, starts, first, later = _later_ones(*(np.concatenate([h[i] for h in held]) for i in range(4)))
    place = _bucket(hashes[first], buckets) // U64(per)
    return _reports(ids[later], starts[later], packs) + _dealt(hashes[first], checks[first], ids[first], starts[first], place, slice_)


def _passing(chunk: T.Chunk, w: T.Words, at: np.ndarray, doc_ids: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Hashes, checks, documents and starts of the windows that begin at the words."""
    hashes, _ = T.windows(w, window)
    checks, _ = T.windows(T.checked(chunk, w, lower=False), window)
    return hashes[at], (checks[at] >> U64(32)).astype(np.uint32), doc_ids[chunk.first + w.doc[at]], at - w.per_doc[w.doc[at]]


def _repeated(window: int, log_cells: int, bits, buckets: int, per: int, packs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(bits.value, np.uint8)
        held, count, slice_ = [], 0, _slice(per)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for chunk in T.chunks(batch.column(1)):
                w = T.words(chunk, T.SPACE, lower=False)
                at, low = _chosen(w, window)
                cell = _cell(low, log_cells)
                at = at[(sketch[cell >> U64(3)] >> (cell & U64(7)).astype(np.uint8)) & 1 > 0]
                if not len(at):
                    continue
                held.append(_passing(chunk, w, at, doc_ids, window))
                count += len(at)
                if count >= FLUSH_WINDOWS:
                    yield from _arrow(_window_rows(held, buckets, per, packs, next(slice_))).to_batches()
                    held, count = [], 0
        if held:
            yield from _arrow(_window_rows(held, buckets, per, packs, next(slice_))).to_batches()
        held.clear()
        T.release()

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    return get("hashes", np.uint64), get("checks", np.uint32), np.repeat(get("ids", np.int64), get("counts", np.int32)), get("starts", np.uint32).astype(np.int64)


def _deal_on(buckets: int, packs: int):
    """A slice of a place that holds several buckets, dealt on to them; reports pass."""

    def run(table: pa.Table) -> pa.Table:
        return table if table.column("kind")[0].as_py() == 1 else _arrow(_window_rows([_unpacked(table)], buckets, 1, packs, 0))

    return run


def _later(packs: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table
        _, _, ids, starts, _, later = _later_ones(*_unpacked(table))
        return _arrow(_reports(ids[later], starts[later], packs))

    return run


# ---- a sketch of any width, counted where its ranges are ----


def _places_chosen(at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Word at which each window's chosen gram begins; low holds its last 24 bits, and it lies shortly after the window's start."""
    return at + ((low & U64(0xFFFFFF)).astype(np.int64) - at) % (1 << 24)


def _gram_rows(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, buckets: int, per: int, packs: int, slice_: int) -> list[tuple]:
    """Grams by range of cells, one place of each; what is met here more than once is reported at all its places."""
    order = np.argsort(hashes, kind="stable")
    hashes, ids, starts = hashes[order], ids[order], starts[order]
    same = hashes[1:] == hashes[:-1]
    first, twice = np.ones(len(hashes), bool), np.zeros(len(hashes), bool)
    first[1:] = ~same
    twice[1:] |= same
    twice[:-1] |= same
    rows = _reports(ids[twice], starts[twice], packs)
    hashes, ids, starts = hashes[first], ids[first], starts[first]
    return rows + _dealt(hashes, np.zeros(len(hashes), np.uint32), ids, starts, _bucket(hashes, buckets) // U64(per), slice_)


def _grams(window: int, buckets: int, per: int, packs: int):
    """Chosen grams with their document and place."""

    def flush(held: list[tuple], slice_: int) -> pa.Table:
        return _arrow(_gram_rows(*(np.concatenate([h[i] for h in held]) for i in range(3)), buckets, per, packs, slice_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, slice_ = [], 0, _slice(per)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for chunk in T.chunks(batch.column(1)):
                w = T.words(chunk, T.SPACE, lower=False)
                at, low = _chosen(w, window)
                if not len(low):
                    continue
                new = np.ones(len(low), bool)
                new[1:] = low[1:] != low[:-1]
                place, doc = _places_chosen(at[new], low[new]), w.doc[at[new]]
                held.append((T.mix(low[new] >> U64(24)), doc_ids[chunk.first + doc], place - w.per_doc[doc]))
                count += int(new.sum())
                if count >= FLUSH_GRAMS:
                    yield from flush(held, next(slice_)).to_batches()
                    held, count = [], 0
        if held:
            yield from flush(held, next(slice_)).to_batches()
        held.clear()
        T.release()

    return run


def _grams_on(buckets: int, packs: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table
        hashes, _, ids, starts = _unpacked(table)
        return _arrow(_gram_rows(hashes, ids, starts, buckets, 1, packs, 0))

    return run


def _count_range(packs: int):
    """The sketch's range of one bucket, eight cells for a gram; the places of grams whose cells count 2 or more."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table
        hashes, _, ids, starts = _unpacked(table)
        cells = T.mix(hashes) >> U64(64 - max(6, (8 * len(hashes)).bit_length()))
        _, inverse, counts = np.unique(cells, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        return _arrow(_reports(ids[twice], starts[twice], packs))

    return run


def _located(reports: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and places of reports."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in reports.column(name).to_pylist()] or [np.zeros(0, kind)])
    return np.repeat(get("ids", np.int64), get("counts", np.int32)), get("starts", np.uint32).astype(np.int64)


def _repeated_at(window: int, buckets: int, per: int, packs: int):
    """Windows of a pack of documents whose chosen gram was reported."""

    def run(docs: pa.Table, reports: pa.Table) -> pa.Table:
        ids, places = _located(reports)
        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        doc_ids, held = docs.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False), []
        for chunk in T.chunks(docs.column("text")):
            w = T.words(chunk, T.SPACE, lower=False)
            at, low = _chosen(w, window)
            if not len(at) or not len(ids):
                continue
            doc = w.doc[at]
            place = _places_chosen(at, low) - w.per_doc[doc]
            passes = np.zeros(len(at), bool)
            cut = np.searchsorted(doc, np.arange(len(chunk.offsets)))
            for d in range(len(chunk.offsets) - 1):
                a, b = np.searchsorted(ids, doc_ids[chunk.first + d], "left"), np.searchsorted(ids, doc_ids[chunk.first + d], "right")
                passes[cut[d] : cut[d + 1]] = np.isin(place[cut[d] : cut[d + 1]], places[a:b])
            if passes.any():
                held.append(_passing(chunk, w, at[passes], doc_ids, window))
        slice_ = docs.column("place")[0].as_py() % per if len(docs) else 0
        return _arrow(_window_rows(held, buckets, per, packs, slice_) if held else [])

    return run


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    steps = np.zeros(n_words + window + 1, np.int32)
    starts = np.unique(starts)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps)[:n_words] > 0


def _apply(window: int):
    def run(docs: pa.Table, reports: pa.Table) -> pa.Table:
        starts: dict[int, list[np.ndarray]] = {}
        for ids, counts, at in zip(*(reports.column(c).to_pylist() for c in ("ids", "counts", "starts")), strict=True):
            ids, at = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(at, np.uint32)
            for i, part in zip(ids, np.split(at, np.cumsum(np.frombuffer(counts, np.int32))[:-1]), strict=True):
                starts.setdefault(i, []).append(part)
        out: list[tuple] = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            found = _SPLIT.findall((text or "").encode())
            gone = 0
            n = len(found)
            if at := starts.get(_NULL_ID if doc_id is None else doc_id):
                at = np.concatenate(at).astype(np.int64)
                drop = covered(n, at[at + window <= n], window)
                gone, found = int(drop.sum()), list(compress(found, ~drop))
            out.append((doc_id, n, gone, b" ".join(found).decode()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, max_cells: int = MAX_CELLS, bucket_bytes: int = BUCKET_BYTES, wide: int = WIDE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed (long), kept_text (kept words joined by one space).

    Words are runs of characters other than white space, unchanged. Null, empty and blank texts have no words and an
    empty kept_text. Rows with one id are one document: exact repeats of a row remove nothing from each other; rows
    that share an id with different texts share their reports. Null ids count as one document before all others.
    Texts below the window's words keep everything. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs, buckets = max(8, -(-size // PACK_BYTES)), max(8, -(-size // bucket_bytes))
    per = 1 if buckets <= wide else int(buckets**0.5) + 1
    log_cells = max(16, (8 * size // 36).bit_length())
    placed = docs.mapInArrow(_placed(packs), "doc_id long, text string, place int")
    if 1 << log_cells <= max_cells:
        sketch = spark.sparkContext.broadcast(sketch_bits(docs.select("text"), window, log_cells, size // 36))
        windows = docs.mapInArrow(_repeated(window, log_cells, sketch, buckets, per, packs), _ROWS)
    else:
        grams = docs.mapInArrow(_grams(window, buckets, per, packs), _ROWS)
        if per > 1:
            grams = grams.groupBy("kind", "place", "slice").applyInArrow(_grams_on(buckets, packs), _ROWS)
        likely = grams.groupBy("kind", "place").applyInArrow(_count_range(packs), _ROWS)
        windows = placed.groupBy("place").cogroup(likely.groupBy("place")).applyInArrow(_repeated_at(window, buckets, per, packs), _ROWS)
    if per > 1:
        windows = windows.groupBy("kind", "place", "slice").applyInArrow(_deal_on(buckets, packs), _ROWS)
    reports = windows.groupBy("kind", "place").applyInArrow(_later(packs), _ROWS)
    return placed.groupBy("place").cogroup(reports.groupBy("place")).applyInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_text string")


def _placed(packs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_pack_of(np.ascontiguousarray(ids), packs))], names=["doc_id", "text", "place"])

    return run
