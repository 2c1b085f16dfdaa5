"""Shards along a Hilbert curve, with DataFrame functions only.

Each metadata dimension is quantised to 2**BITS steps: a number by its place among the dimension's quantiles, a text by
its place in the sorted dictionary of values, weighted by how often they occur. A value that many rows share lies in the
middle of the steps it covers, so four languages spread over the whole axis. The steps of a row are a cell of a cube,
and its index on the Hilbert curve through the cube orders the rows. Neighbours on the curve are neighbours in every
dimension, so each shard spans a small range of each and readers can skip files. Runs of the order are cut so that the
shards' counts differ by one at most.

Rows of one group (equal texts) follow each other, at the place of the group's least index. Where a cut falls into a
group that fits a shard, one part changes places with rows beyond the group that have no copies, so the group
stays whole and counts stay as they are. Groups larger than a shard are cut, as the law demands, and so is one in whose
two shards too few rows are without copies, or whose parts are above SWAP_ROWS.

The exact rank takes no global sort in one task: rows (ids and numbers, no texts) are dealt by range of the order and
written with the number of their range; counts of ranges give each its offset, and ranks are counted within ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm._spark import mid_ranks, spread_join, written

BITS = 8
SHARDS = 40
#: Rows in a range of the order, and ranges from which on they grow to MOST_ROWS each; a row here is ids and numbers of some 60 bytes.
RANGE_ROWS, MANY_RANGES, MOST_ROWS = 20_000, 10_000, 2_000_000
#: Rows of a group that may change places with others at one cut.
SWAP_ROWS = 2_000_000


def running(df: DataFrame, order: list[str], weight: Column, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """df with before (the sum of weight over the rows that come earlier in the order), and the sum of all."""
    rows = written(df.withColumn("_weight", weight.cast("long")), "keys")  # the range bounds and the rows must come from one reading
    count = rows.count()
    ranges = max(1, min(-(-count // range_rows), max(MANY_RANGES, -(-count // MOST_ROWS))))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges") if ranges > 1 else rows.withColumn("_range", F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum("_weight").alias("n")).collect()  # a number for each range
    offsets, total = [], 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        offsets.append((r["_range"], total))
        total += r.n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _offset long"))
    within = F.sum("_weight").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_sum", within).join(table, "_range").withColumn("before", F.col("_offset") + F.col("_sum") - F.col("_weight")).drop("_range", "_sum", "_offset", "_weight"), total


def quantised(df: DataFrame, dims: list[str], total: int, bits: int = BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with a step (q0, q1, ...) in place of each dimension. A null number has step 0, a null text comes before all."""
    steps = 1 << bits
    texts = [d for d in dims if df.schema[d].dataType.simpleString() == "string"]
    numbers = [d for d in dims if d not in texts]
    cuts = df.agg(*[F.percentile_approx(F.col(d).cast("double"), [i / steps for i in range(1, steps)], 20_000).alias(d) for d in numbers]).first() if numbers else {}
    for i, d in enumerate(dims):
        if d in texts:
            values, _ = running(df.groupBy(d).agg(F.count(F.lit(1)).alias("_n")), [d], F.col("_n"), range_rows)
            place = F.floor((F.col("before") + F.col("_n") / 2) * steps / max(total, 1))
            table = written(values.select(d, "_n", F.least(place, F.lit(steps - 1)).cast("long").alias(f"q{i}")), "steps")
            df = spread_join(df, table, [d], "_n", total).drop("_n")
        else:
            number = F.col(d).cast("double")
            df = df.withColumn(f"q{i}", F.when(number.isNull(), 0).otherwise(mid_ranks(number, cuts[d] or [])).cast("long"))
    return df


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index of a cube's cell on the Hilbert curve (Skilling's transform of axes, bit by bit, highest first)."""
    n = len(axes)
    names = [f"x{i}" for i in range(n)]
    start = F.struct(*[a.cast("long").alias(c) for a, c in zip(axes, names, strict=True)])

    def undo(state: Column, step: Column) -> Column:
        bit, axis = step["bit"], step["axis"]
        mask = bit - 1
        x0 = state["x0"]
        own = F.get(F.array(*[state[c] for c in names]), axis)
        is_set = own.bitwiseAND(bit) != 0
        swap = x0.bitwiseXOR(own).bitwiseAND(mask)
        first = F.when(is_set, x0.bitwiseXOR(mask)).otherwise(x0.bitwiseXOR(swap))
        others = [F.when((axis == i) & ~is_set, state[c].bitwiseXOR(swap)).otherwise(state[c]) for i, c in enumerate(names) if i]
        return F.struct(first.alias("x0"), *[o.alias(f"x{i}") for i, o in enumerate(others, 1)])

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def encode(s: Column) -> Column:
        gray = [s["x0"]]
        for c in names[1:]:
            gray.append(s[c].bitwiseXOR(gray[-1]))
        flips = F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]), F.lit(0).cast("long"), lambda t, b: F.when(gray[-1].bitwiseAND(b) != 0, t.bitwiseXOR(b - 1)).otherwise(t))
        return F.struct(*[g.bitwiseXOR(flips).alias(c) for g, c in zip(gray, names, strict=True)])

    def interleave(s: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for c in names:
                out = out * 2 + F.shiftright(s[c], b).bitwiseAND(1)
        return out

    # one-element transforms bind each stage's result to a name, so no stage is computed twice
    return F.get(F.transform(F.transform(F.array(F.aggregate(steps, start, undo)), encode), interleave), F.lit(0))


def _within(column: Column, spans: list[tuple[int, int, int]]) -> Column:
    """Which of the spans (number, from, to) a value lies in; null if none."""
    return reduce(lambda out, s: F.when((column >= s[1]) & (column < s[2]), s[0]).otherwise(out), spans, F.lit(None).cast("int"))


def keep_whole(rows: DataFrame, group: list[str], total: int, shards: int) -> DataFrame:
    """rows with ranks changed so that groups (copies tells their sizes) lie in one shard where that is possible.

    The driver handles at most one group a cut.
    """
    cuts = [-(-s * total // shards) for s in range(shards + 1)]
    inner = [c for c in cuts[1:-1] if 0 < c < total]
    if not inner:
        return rows
    at_cuts = {r["rank"]: r for r in rows.filter(F.col("rank").isin(sorted({r for c in inner for r in (c - 1, c)}))).select("rank", *group).collect()}  # two rows a cut
    key = lambda r: tuple(r[g] for g in group)
    straddling = {key(at_cuts[c]): c for c in inner if key(at_cuts[c]) == key(at_cuts[c - 1])}
    if not straddling:
        return rows
    spark = rows.sparkSession
    schema = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    wanted = F.broadcast(spark.createDataFrame(list(straddling), schema))
    spans = {key(r): (r.first, r.last + 1) for r in rows.join(wanted, group, "left_semi").groupBy(*group).agg(F.min("rank").alias("first"), F.max("rank").alias("last")).collect()}
    alone = dict(rows.filter("copies = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each shard
    moved, fresh = [], []  # (cut, from, to) of the rows that move, and of where rows without copies are taken
    taken: dict[int, int] = {}
    backwards = []
    for k, c in sorted(straddling.items(), key=lambda x: x[1]):
        (a, b), s = spans[k], cuts.index(c)
        low, high = cuts[s - 1], cuts[s + 1]
        if a < low or b > high:
            continue
        # the smaller part moves if there is room for it, or else the larger
        ways = sorted([(c - a, s, True), (b - c, s - 1, False)])
        way = next(((n, to, r) for n, to, r in ways if n <= SWAP_ROWS and taken.get(to, 0) + n <= alone.get(to, 0)), None)
        if way is None:
            continue
        n, to, rightwards = way
        taken[to] = taken.get(to, 0) + n
        moved.append((s, a, c) if rightwards else (s, c, b))
        fresh.append((s, b, high) if rightwards else (s, low, a))
        if not rightwards:
            backwards.append(s)
    if not moved:
        return rows
    first = reduce(lambda out, m: F.when(F.col("cut") == m[0], m[1]).otherwise(out), moved, F.lit(0))
    part = rows.select("rank", _within(F.col("rank"), moved).alias("cut")).filter("cut is not null").withColumn("i", (F.col("rank") - first + 1).cast("long"))
    sizes = F.broadcast(spark.createDataFrame([(s, b - a) for s, a, b in moved], "cut int, n long"))
    # two cuts may take from one shard: one from its front, the other from its back
    picks = []
    for backward in (False, True):
        some = [f for f in fresh if (f[0] in backwards) == backward]
        if some:
            near = rows.filter("copies = 1").select("rank", _within(F.col("rank"), some).alias("cut")).filter("cut is not null")
            order = F.col("rank").desc() if backward else F.col("rank")
            picks.append(near.withColumn("i", F.row_number().over(Window.partitionBy("cut").orderBy(order)).cast("long")).join(sizes, "cut").filter("i <= n").select("cut", "i", F.col("rank").alias("other")))
    pairs = written(part.join(reduce(DataFrame.union, picks), ["cut", "i"]).select("rank", "other"), "swaps")
    table = pairs.union(pairs.select("other", "rank")).toDF("_old", "_new")
    return rows.join(table, rows["rank"] == table["_old"], "left").withColumn("rank", F.coalesce("_new", "rank")).drop("_old", "_new")


def hilbert_shards(docs: DataFrame, dims: dict[str, Column], columns: list[Column], group: list[Column], ties: list[str], *, shards: int = SHARDS, bits: int = BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """columns of each row, with curve (the index of its place), shard (int) and slot (long, gapless from 0 in each shard).

    dims name up to seven expressions, numbers or texts; rows that agree in the group expressions are kept together.
    Rows of one place follow the ties columns (of the result); rows that agree in those too may take each other's place. Counts of
    shards differ by one at most, also with fewer rows than shards; an empty table gives an empty table.
    """
    names, keys = [f"_dim{i}" for i in range(len(dims))], [f"_group{i}" for i in range(len(group))]
    named = written(docs.select(*columns, *[d.alias(n) for d, n in zip(dims.values(), names, strict=True)], *[g.alias(n) for g, n in zip(group, keys, strict=True)]), "documents")
    total = named.count()
    axes = [f"q{i}" for i in range(len(dims))]
    cells = quantised(named, names, total, bits, range_rows)
    cells = written(cells.withColumn("curve", curve_index([F.col(a) for a in axes], bits)).drop(*axes, *names), "cells")
    groups = written(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("curve").alias("_least")).filter("copies > 1"), "groups")
    cells = spread_join(cells, groups, keys, "copies", total)
    cells = cells.withColumn("curve", F.coalesce("_least", "curve")).withColumn("copies", F.coalesce("copies", F.lit(1))).drop("_least")
    order = ["curve", *keys, *ties]
    rows, total = running(cells, order, F.lit(1), range_rows)
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    rows = written(rows.withColumnRenamed("before", "rank").withColumn("shard", shard), "ranked")
    rows = keep_whole(rows, keys, total, shards).withColumn("shard", shard)
    return rows.withColumn("slot", F.expr(f"rank - ((cast(shard as bigint) * {total} + {shards - 1}) div {shards})")).drop("rank", "copies", *keys)


def text_size(text: Column) -> Column:
    """Bytes of UTF-8, none for null, and 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot over the size, source and language of documents.

    A null text has the size and checksum of an empty one and is in its group. Groups are texts equal in two
    hashes and their length. Repeated rows and null ids each have a slot; columns other than doc_id, text, source and lang are
    ignored, so theirs may have any name.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    dims = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "size": text_size(text)}
    columns = [F.col("doc_id"), text_size(text).alias("size"), crc.alias("text_crc32")]
    return hilbert_shards(docs, dims, columns, [F.xxhash64(text), crc, F.octet_length(text)], ["doc_id"], shards=shards, **options)
