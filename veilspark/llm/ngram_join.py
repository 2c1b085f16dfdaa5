"""Exact Jaccard join of word n-gram sets by token-combination prefixes.

Two documents link when the Jaccard similarity of their distinct shingles reaches the threshold. The tokens of
the join are shingles, ordered by how many different sets hold them, rarest first.

1. Every document gives its set's size and identity (a sum of mixed 64-bit shingle hashes). Equal sets count once
   from here on, so a group of exact copies weighs as much as one document.
2. Shingles seen in one set only match nothing. A set of n shingles with more than n - 0.8 n of those can't reach
   the threshold with any partner, as its whole prefix is made of them. They are counted exactly: 32-bit remainders
   are dealt by hash, and what a batch already knows to be shared is sent once, so a frequent shingle costs each
   batch one entry. (Collisions of remainders only keep a set in, never drop one.)
3. Sets that are left are ordered: rare shingles index singly; frequent ones fall into small classes by hash and
   index as pairs within a class. A class with q tokens in the prefix still offers a pair after the loss of q - 2,
   so the prefix grows until singles plus the sum of (q - 1) exceeds the number of shingles a partner may lack.
   Whichever prefix ends first in the common order, its shared tokens lie in both prefixes, and some single or pair
   of them survives: no link is lost. Class counts depend on the set's size band; a set near a band's end indexes
   in both bands.
4. Sets that share an index entry form candidate groups, found by linking each entry's sets to its smallest. A group
   that fits a block is verified in one task on bit sets: every pair of fitting sizes. A larger group is verified
   in whichever way moves and compares less: whole, cut into blocks of bounded size that meet pair by pair (a dense
   group of near copies), or entry by entry, where a pair is verified at the least entry it shares (sets that only a chain
   of chance entries holds together). A task returns how many links each set has, and only those links that join what
   is not yet joined. No list of pairs is ever made.
5. The components of those links and the sums of links, spread to the copies; sets with very many copies are broadcast
   to their rows, so no task gets all copies of a text.

Shingles are compared by 64-bit hashes: a pair of sets of n shingles counts one too many with a chance of n^2 / 2^64. Two
different sets are taken for copies with a chance of 2^-64 a pair: 0.03 in all for a thousand million different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import BROADCAST_ROWS, bounded, components, packed, ship, spread_join, unused, written

U64 = np.uint64
#: Shingles that more sets than this hold are frequent, and index as pairs.
FREQUENT = 32
#: Entries dealt to one task when shingles are counted.
COUNT_ENTRIES = 2_400_000
#: Entries a map task gathers before it deals them out.
FLUSH = 600_000
#: More buckets than this are dealt in two levels, so that a batch never meets more than about its square root of them.
WIDE = 4096
#: Bounds of a block in verification.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000


class _Sets:
    """Distinct shingles of each document of a chunk, sorted by document and hash."""

    def __init__(self, chunk: T.Chunk, size: int) -> None:
        w = T.words(chunk, T.SPACE, lower=True)
        docs = len(chunk.offsets) - 1
        hashes, whole = T.windows(w, size)
        at = np.flatnonzero(whole)
        doc, hashes = w.doc[at], hashes[at]
        counts = np.diff(w.per_doc)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.array([T.span_hash(w, w.per_doc[i], w.per_doc[i + 1]) for i in short], np.uint64)
            doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, extra])
        order = T.by_doc(doc, hashes)
        doc, hashes = doc[order], hashes[order]
        if len(doc):
            keep = np.ones(len(doc), bool)
            keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            doc, hashes = doc[keep], hashes[keep]
        self.doc, self.hash = doc, hashes
        self.n = np.bincount(doc, minlength=docs)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        sums = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(T.mix(hashes ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
        self.id = T.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def _summary(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(2)):
                s = _Sets(chunk, size)
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.id, mask=s.n == 0), pa.array(s.n.astype(np.int64))], names=["doc_id", "text_hash", "set_id", "n_shingles"])

    return run


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Two bytes a count where that is enough."""
    return counts.astype(np.uint16 if not len(counts) or counts.max() < 1 << 16 else np.int32)


def _widened(ids: bytes, counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint16 if 4 * len(counts) == len(ids) else np.int32).astype(np.int64)


_DEALT = {"place": pa.int32(), "slice": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "entries": pa.binary(), "shared": pa.binary()}
_DEALT_SQL = "place int, slice int, ids binary, counts binary, entries binary, shared binary"


def _by_place(ids: np.ndarray, which: np.ndarray, keys: np.ndarray, known: np.ndarray, per: int, slice_: int, kind: type) -> list[tuple]:
    """Rows of one place each: the sets met, how many entries each has, the entries, and those known to be shared.

    keys (bucket over 32 bits of a shingle's hash) belong to the sets ids[which], each pair once; known are keys that are
    shared already. What two sets have here is shared: it is listed once and counts for no set. A place holds
    per buckets.
    """
    order = np.argsort(keys, kind="stable")
    keys, which = keys[order], which[order]
    same = keys[1:] == keys[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    shared = np.unique(np.concatenate([keys[again], known]))
    keys, which = keys[~again], which[~again]
    place, shared_place = ((k >> U64(32)) // U64(per) for k in (keys, shared))
    order = np.lexsort((which, place))
    keys, which, place = keys[order], which[order], place[order]
    rows = []
    for p in np.union1d(place, shared_place):
        x, y = np.searchsorted(place, [p, p + U64(1)])
        u, v = np.searchsorted(shared_place, [p, p + U64(1)])
        w = which[x:y]
        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if y > x else np.zeros(0, np.int64)
        rows.append((int(p), slice_, packed(ids[w[cut]]), packed(_narrow(np.diff(np.append(cut, y - x)))), packed(keys[x:y].astype(kind)), packed(shared[u:v].astype(kind))))
    return rows


def _deal(size: int, buckets: int, per: int = 1, slices: int = 1):
    """Shingles by place: 32 bits of each where a place is a bucket, or the whole key where it holds several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = context.partitionId() * 7919 if context else 0
        held: list[tuple] = []
        count = docs = flushed = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            doc, hashes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            _, at = np.unique(ids, return_index=True)  # copies within the batch count once
            once = np.zeros(len(ids), bool)
            once[at] = True
            doc, hashes = doc[once[doc]], hashes[once[doc]]
            keys = ((hashes >> U64(32)) % U64(buckets)) << U64(32) | hashes & U64(0xFFFFFFFF)
            rows = _by_place(ids, doc, keys, keys[:0], per, (first + flushed) % slices, np.uint32 if per == 1 else np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.values(), strict=True)], names=list(_DEALT))

        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                s = _Sets(chunk, size)
                if not len(s.hash):
                    continue
                held.append((s.doc + docs, s.hash, s.id))
                count, docs = count + len(s.hash), docs + len(s.n)
                if count >= FLUSH:
                    yield flush()
                    held, count, docs, flushed = [], 0, 0, flushed + 1
        if held:
            yield flush()
        held.clear()
        T.release()

    return run


def _entries_of(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets, and for each distinct pair of set and entry their numbers; then what is known to be shared."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    ids, inverse = np.unique(get("ids", np.int64), return_inverse=True)
    counts = np.concatenate([_widened(i, c) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True)])
    which, entries = np.repeat(inverse, counts), get("entries", kind).astype(np.uint64)
    order = np.lexsort((which, entries))
    which, entries = which[order], entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = (entries[1:] != entries[:-1]) | (which[1:] != which[:-1])
    return ids, which[new], entries[new], get("shared", kind).astype(np.uint64)


def _refine(table: pa.Table) -> pa.Table:
    """A slice of a place that holds several buckets, dealt on to them."""
    ids, which, keys, known = _entries_of(table, np.uint64)
    alone = ~np.isin(keys, known)
    rows = _by_place(ids, which[alone], keys[alone], known, 1, 0, np.uint32)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.values(), strict=True)], names=list(_DEALT))


def _by_pack(ids: np.ndarray, n: np.ndarray, packs: int, per: int, slice_: int) -> pa.Table:
    pack = (ids.view(np.uint64) % U64(packs)).astype(np.int64) // per
    order = np.argsort(pack, kind="stable")
    at, where = np.unique(pack[order], return_index=True)
    where = np.append(where, len(ids))
    parts = [[packed(x[order[a:b]]) for a, b in zip(where, where[1:])] for x in (ids, n.astype(np.int32))]
    return pa.table({"pack": pa.array(at, pa.int32()), "slice": pa.array(np.full(len(at), slice_), pa.int32()), "ids": pa.array(parts[0], pa.binary()), "n": pa.array(parts[1], pa.binary())})


_PACKED_SQL = "pack int, slice int, ids binary, n binary"


def _alone(packs: int, per: int = 1, slices: int = 1):
    """For a bucket: how many entries of each set no other set has; dealt on by set."""

    def run(table: pa.Table) -> pa.Table:
        ids, which, entry, known = _entries_of(table, np.uint32)
        alone = np.ones(len(entry), bool)
        alone[1:] &= entry[1:] != entry[:-1]
        alone[:-1] &= entry[1:] != entry[:-1]
        alone &= ~np.isin(entry, known)
        n = np.bincount(which[alone], minlength=len(ids))
        return _by_pack(ids[n > 0], n[n > 0], packs, per, table.column("place")[0].as_py() % slices)

    return run


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("n").to_pylist()])
    ids, inverse = np.unique(ids, return_inverse=True)
    return ids, np.bincount(inverse, weights=n, minlength=len(ids)).astype(np.int64)


def _pack_on(packs: int):
    def run(table: pa.Table) -> pa.Table:
        return _by_pack(*_sums(table), packs, 1, 0)

    return run


def _total(table: pa.Table) -> pa.Table:
    ids, n = _sums(table)
    return pa.table({"set_id": ids, "alone": n})


def alone_counts(texts: DataFrame, size: int, buckets: int, wide: int) -> DataFrame:
    """set_id and how many of its shingles no other set has; sets that have none are left out.

    Up to wide buckets, each batch deals straight to them. Beyond, it deals to the square root of that many places, each
    in slices of a bucket's size, and the slices deal on: the rows dealt stay long, whatever the size of the input.
    """
    if buckets <= wide:
        dealt = texts.mapInArrow(_deal(size, buckets), _DEALT_SQL)
        alone = dealt.groupBy("place").applyInArrow(_alone(buckets), _PACKED_SQL)
    else:
        per = int(buckets**0.5) + 1
        dealt = texts.mapInArrow(_deal(size, buckets, per, per), _DEALT_SQL)
        dealt = dealt.groupBy("place", "slice").applyInArrow(_refine, _DEALT_SQL)
        alone = dealt.groupBy("place").applyInArrow(_alone(buckets, per, per), _PACKED_SQL)
        alone = alone.groupBy("pack", "slice").applyInArrow(_pack_on(buckets), _PACKED_SQL)
    return alone.groupBy("pack").applyInArrow(_total, "set_id long, alone long")


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                s = _Sets(chunk, size)
                some = np.flatnonzero(s.n > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.n[some])]), pa.int32()), pa.array(s.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.id[some]), pa.array(s.n[some].astype(np.int64)), lists], names=["set_id", "n", "tokens"])

    return run


def may_lack(n: int, percent: int) -> int:
    """How many of its n tokens a set may lack in a partner at the threshold."""
    return n - -(-percent * n // 100)


def size_bands(n: int, percent: int) -> list[int]:
    """Bands of size [2**b, 2**(b+1) * 100 / percent]: the smaller set of a linked pair shares its band with the larger."""
    top = n.bit_length() - 1
    return [top, top - 1] if top and n * percent <= (1 << top) * 100 else [top]


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, frequent: int = FREQUENT) -> np.ndarray:
    """Index entries of a set of n tokens, of which tokens (with df sets each, 2 or more) are shared by other sets."""
    alone = n - len(tokens)
    need = may_lack(n, percent) + 1 - alone
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, df, df > frequent))
    tokens, df = tokens[order], df[order]
    rare = int(np.searchsorted(df > frequent, True))
    singles = T.mix(tokens[: min(need, rare)] ^ U64(0x2545F4914F6CDD1D))
    if rare >= need:
        return singles
    out, common = [singles], tokens[rare:]
    for band in size_bands(n, percent):
        classes = max(1, 3 * (1 << band) // 10)
        kind = (T.mix(common ^ U64(0x9E3779B97F4A7C15)) % U64(classes)).astype(np.int64)
        met: dict[int, list[int]] = {}
        left = need - rare
        for token, k in zip(common.tolist(), kind.tolist(), strict=True):
            before = met.setdefault(k, [])
            if before:
                out.append(T.mix(T.mix(np.array(before, np.uint64) + U64(band + 1)) * U64(31) + T.mix(np.array([token], np.uint64))))
                left -= 1
            before.append(token)
            if left <= 0:
                break
    return np.unique(np.concatenate(out))


def _index(percent: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            where = batch.column(2).offsets.to_numpy()
            flat = batch.column(2).values
            df, tokens = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(np.uint64)
            found = [signatures(tokens[a:b], df[a:b], int(n), percent, frequent) for a, b, n in zip(where, where[1:], sizes)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in found]))], names=["entry", "set_id"])

    return run


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each element that two sets have at least, a row for each set."""
    m = len(sets)
    _, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    slot = np.cumsum(shared) - 1
    row = np.repeat(np.arange(m), [len(s) for s in sets])[shared[index]]
    bit = slot[index[shared[index]]]
    bits = np.zeros((m, int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, bit >> 6), U64(1) << (bit & 63).astype(np.uint64))
    return bits


def links_among(sets: list[np.ndarray], percent: int, split: int = 0, copies: np.ndarray | None = None, earlier: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the sets into their components, and for each set how many documents the sets it links with stand for.

    Every pair of fitting sizes is verified; with split, only pairs across that position are; with earlier, only pairs
    that have none of its elements in common (they were verified at one of those).
    """
    m = len(sets)
    copies = np.ones(m, np.int64) if copies is None else copies
    sizes = np.array([len(s) for s in sets])
    bits = _bits(sets)
    before = _bits(earlier) if earlier is not None else None
    label, found, links = np.arange(m), [], np.zeros(m, np.int64)
    for i in range(split or m - 1):
        others = np.arange(split, m) if split else np.arange(i + 1, m)
        a, b = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[100 * a >= percent * b]
        if before is not None and len(others):
            others = others[~(before[i] & before[others]).any(axis=1)]
        for k in range(0, len(others), 256):
            part = others[k : k + 256]
            both = np.bitwise_count(bits[i] & bits[part]).sum(axis=1, dtype=np.int64)
            linked = part[100 * both >= percent * (sizes[i] + sizes[part] - both)]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked[label[linked] != label[i]]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    found.append((i, int(j)))
    return found, links


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, group, block = (table.column(c).to_numpy() for c in ("set_id", "group_id", "block"))
        lists, marks = table.column("tokens").combine_chunks(), table.column("marks").combine_chunks()
        where, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        mark_at, mark = marks.offsets.to_numpy(), marks.values.to_numpy()
        by_entry = table.column("by_entry").to_numpy(zero_copy_only=False)
        split = bool(table.column("block_b")[0].as_py() != table.column("block_a")[0].as_py())
        order = np.lexsort((ids, block, group, by_entry))
        starts = (group[order][1:] != group[order][:-1]) | (by_entry[order][1:] != by_entry[order][:-1])
        cuts = np.flatnonzero(np.concatenate([[True], starts, [True]]))
        copies = table.column("copies").to_numpy()
        out: list[tuple[int, int]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts, cuts[1:]):
            rows = order[a:b]
            at = int(np.searchsorted(block[rows], block[rows][0], "right")) if split else 0
            if len(rows) > 1 and at < len(rows):
                earlier = None
                if by_entry[rows[0]]:
                    earlier = [x[x < group[rows[0]]] for x in (mark[mark_at[r] : mark_at[r + 1]] for r in rows)]
                found, links = links_among([flat[where[r] : where[r + 1]] for r in rows], percent, at, copies[rows], earlier)
                out += [(int(ids[rows[i]]), int(ids[rows[j]])) for i, j in found]
                counted.append((ids[rows[links > 0]], links[links > 0]))
        # a row is a spanning link, or a set with the links this task found
        some = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.int64)
        n = np.concatenate([c[1] for c in counted]) if counted else np.zeros(0, np.int64)
        return pa.table({
            "u": pa.concat_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array(some, pa.int64())]),
            "v": pa.concat_arrays([pa.array([y for _, y in out], pa.int64()), pa.nulls(len(some), pa.int64())]),
            "links": pa.concat_arrays([pa.nulls(len(out), pa.int64()), pa.array(n, pa.int64())]),
        })

    return run


def _blocks(members: str, total: str) -> F.Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK_SETS), F.ceil(F.col(total) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _candidates(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """group_id, by_entry (is the group an index entry), blocks, set_id and marks (the set's shared entries, by_entry only)."""
    each = sets.select("set_id", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    prefix = each.join(shared, "token").groupBy("set_id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    entries = written(prefix.join(sets.select("set_id", "n"), "set_id").select("set_id", "n", "shared").mapInArrow(_index(percent, frequent), "entry long, set_id long"), "entries")
    hub = entries.groupBy("entry").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = written(entries.join(hub, "entry"), "met")
    groups = components(met.filter("set_id <> hub").select("hub", "set_id"))
    sizes = sets.select("set_id", "n")
    grouped = groups.join(sizes, groups.node == sizes.set_id).select("set_id", F.col("component").alias("group_id"), "n")
    stats = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).withColumn("blocks", _blocks("members", "total"))
    stats = written(stats, "groups")
    # larger groups: rows to move and pairs to compare, whole or by entry
    large = stats.filter("blocks > 1")
    if large.isEmpty():
        sparse = large.select("group_id").limit(0)
    else:
        inside = met.join(grouped.join(large.select("group_id"), "group_id", "left_semi"), "set_id")
        costs = inside.groupBy("group_id").agg(F.sum("n").alias("moved"), F.sum("held").alias("compared"))
        sparse = written(large.join(costs, "group_id").filter("moved < total * blocks and compared < members * members").select("group_id"), "sparse")
    dense = grouped.join(sparse, "group_id", "left_anti").join(stats.select("group_id", "blocks"), "group_id")
    dense = dense.select("group_id", F.lit(False).alias("by_entry"), "blocks", "set_id", F.array().cast("array<long>").alias("marks"))
    if sparse.isEmpty():
        return dense
    inside = written(met.join(grouped.join(sparse, "group_id", "left_semi").select("set_id", "n"), "set_id").select("entry", "set_id", "n", "held"), "inside")
    marks = inside.groupBy("set_id").agg(F.sort_array(F.collect_list("entry")).alias("marks"))
    per = inside.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    by_entry = inside.join(per.select("entry", _blocks("members", "total").alias("blocks")), "entry").join(marks, "set_id")
    return dense.union(by_entry.select("entry", F.lit(True), "blocks", "set_id", "marks"))


def _labelled(docs: DataFrame, size: int, percent: int, frequent: int, broadcast_rows: int, wide: int) -> DataFrame:
    """For docs (doc_id, text_hash, text): doc_id, text_hash, n_shingles, low (the least row of its component: no_id,
    doc_id, text_hash) and n_links."""
    rows = written(docs.mapInArrow(_summary(size), "doc_id long, text_hash long, set_id long, n_shingles long"), "sizes")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = rows.filter("n_shingles > 0").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.min(row).alias("least"), F.count(F.lit(1)).alias("copies"))
    total, entries = sets.agg(F.sum("copies"), F.sum("n")).first()
    buckets = max(8, -(-(entries or 0) // COUNT_ENTRIES))
    alone = alone_counts(docs.select("text"), size, buckets, wide)
    left = written(sets.join(alone, "set_id", "left").filter(F.expr(f"100 * (n - coalesce(alone, 0)) >= {percent} * n and n > 1")).select("set_id", "n", F.col("least.doc_id").alias("doc_id"), "copies"), "left")
    chosen = left.select("doc_id").distinct()
    kept = docs.join(bounded(chosen, chosen.count(), broadcast_rows), docs.doc_id.eqNullSafe(chosen.doc_id), "left_semi")
    texts = kept.select("text").mapInArrow(_tokens(size), "set_id long, n long, tokens array<long>").dropDuplicates(["set_id"])
    texts = written(texts.join(left.select("set_id", "copies"), "set_id").select("set_id", "n", "tokens", "copies"), "sets")
    groups = written(_candidates(texts, percent, frequent), "candidates")
    placed = groups.join(texts, "set_id")
    bins = max(1, (placed.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES)
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(set_id), blocks) as int)"))
    # a group of one block shares a task with others; the blocks of a larger one meet pair by pair
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.expr(f"if(blocks = 1, pmod(xxhash64(group_id), {bins}), xxhash64(group_id, by_entry))").alias("place"),
        F.expr("if(blocks = 1, -1, least(block, other))").alias("block_a"),
        F.expr("if(blocks = 1, -1, greatest(block, other))").alias("block_b"),
        "group_id", "by_entry", "block", "set_id", "tokens", "marks", "copies",
    )
    found = written(placed.groupBy("place", "block_a", "block_b").applyInArrow(_verify(percent), "u long, v long, links long"), "links")
    joined = components(found.filter("v is not null").select("u", "v"))
    least = joined.join(sets, joined.node == sets.set_id).groupBy("component").agg(F.min("least").alias("low"))
    label = joined.join(least, "component").select(F.col("node").alias("set_id"), "low")
    links = found.filter("v is null").groupBy(F.col("u").alias("set_id")).agg(F.sum("links").alias("links"))
    label = sets.select("set_id", "least", "copies").join(label, "set_id", "left").join(links, "set_id", "left")
    label = written(label.select("set_id", F.coalesce("low", "least").alias("low"), "copies", F.expr("copies - 1 + coalesce(links, 0)").alias("n_links")), "labels")
    some = spread_join(rows.filter("n_shingles > 0"), label, ["set_id"], "copies", total or 0)
    none = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", row.alias("low"), F.lit(0).cast("long").alias("n_links"))
    return some.select("doc_id", "text_hash", "n_shingles", "low", "n_links").union(none)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80, frequent: int = FREQUENT, broadcast_rows: int = BROADCAST_ROWS, wide: int = WIDE, count_links: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles (long), component_id (the smallest id reachable by links); with count_links
    also n_links (long), the number of other rows it links with.

    Words are runs of bytes other than white space, A-Z lower-cased; a text with fewer words than size is one
    shingle. Texts without words (null, empty, blank) have size 0 and link with nothing, so component_id is their own
    id. Repeated rows link with each other like any copies. A null id is kept; it counts as no id when the smallest is
    taken. Input columns other than the two are ignored. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    out = _labelled(docs, size, percent, frequent, broadcast_rows, wide)
    return out.select("doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), *["n_links"] * count_links)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """Of each group of linked rows the one of least id stays (null ids last, of equal ids the one of least text hash).

    Rows equal in id and text are one document, of which one row stays; rows that share an id but not their text are
    judged each by its own text. Rows without words are linked with nothing. Columns are as given, whatever their names.
    """
    ship(docs.sparkSession)
    number, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(number.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    options = {"frequent": FREQUENT, "broadcast_rows": BROADCAST_ROWS, "wide": WIDE} | options
    found = _labelled(narrow, size, percent, **options)
    first = found.filter("doc_id <=> low.doc_id and text_hash = low.text_hash").select("doc_id", "text_hash").distinct()
    a, b, x, y = (unused(docs.columns, name) for name in ("first_id", "first_hash", "row_id", "row_hash"))
    first = first.toDF(a, b)
    marked = docs.select("*", number.alias(x), F.xxhash64(text).alias(y))
    stay = marked.join(first, marked[x].eqNullSafe(first[a]) & (marked[y] == first[b]), "left_semi")
    return stay.dropDuplicates([x, y]).select(*[f"`{c}`" for c in docs.columns])
