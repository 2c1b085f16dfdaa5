"""Written tables in the shared folder, and connected components."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.shipping import ship

#: Up to this many edges (16 bytes each) one executor task joins them; above it the rounds below run on all executors.
SMALL_EDGES = 1_000_000
#: Rows of 16 bytes or fewer that may be broadcast after they were counted.
BROADCAST_ROWS = 1_000_000
#: A key of more than this share of all rows is hot; there are at most as many hot keys as the share goes into one.
HOT_SHARE = 1e-5


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set (a local session), one in the warehouse folder."""
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the application ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/veilspark-{context.applicationId}"
    if getattr(context, "_veilspark_run_dir", None) != path:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        context._veilspark_run_dir = path
    return path


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only if the counted rows stay below the limit; otherwise the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """Node and the smallest node it can reach, for edges of two long columns; nodes without edges are not returned.

    Above the small bound: alternating large-star and small-star rounds, each two shuffles with partial minima,
    until the edges no longer change. No node's neighbours are ever gathered, nor do all of a hub's edges meet in one task.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).filter("u <> v").distinct(), "edges")
    n = edges.count()
    if n == 0:
        return spark.createDataFrame([], "node long, component long")
    if n <= small:
        return written(edges.coalesce(1).mapInArrow(_join_up, "node long, component long"), "components")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("held")), "low")
        star = spread_join(both.filter("v > u"), low, ["u"], "held", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        star = written(star, "large")
        low = written(star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("held")), "low")  # u > v in every row here
        star = spread_join(star, low, ["u"], "held", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        edges = written(star, "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def edges_below(column: Column, edges: list) -> Column:
    """How many of the sorted edges lie below the column's value (not null), looked up in two short steps."""
    if not edges:
        return F.lit(0)
    kind = "double" if isinstance(edges[0], float) else "bigint"
    width = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    # literal texts fold to constant arrays, however many edges there are
    lasts = F.split(F.lit(",".join(repr(g[-1]) for g in groups)), ",").cast(f"array<{kind}>")
    table = F.transform(F.split(F.lit(";".join(",".join(map(repr, g)) for g in groups)), ";"), lambda g: F.split(g, ",").cast(f"array<{kind}>"))
    past = F.size(F.filter(lasts, lambda e: e < column))
    return F.least(past * width, F.lit(len(edges))) + F.when(past < len(groups), F.size(F.filter(F.get(table, past), lambda e: e < column))).otherwise(0)


def bitmap(places: DataFrame, column: str, log_bits: int) -> bytes:
    """A bit for each place (a long from 0, below 2**log_bits) that occurs; bytes have their lowest bit first.

    Built where the rows are; the driver gets at most the 2**log_bits bits, 4 KB at a time.
    """
    place = F.col(column) + 1
    parts = places.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = bytearray(max((1 << log_bits) // 8, 4096))
    for r in parts.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = r.m
    return bytes(out)


def mid_ranks(column: Column, edges: list) -> Column:
    """How many of the sorted edges lie below the column's value (not null), and half of those equal to it.

    So a value that many edges fall on lies in the middle of them, and few distinct values still spread over the range.
    """
    values = sorted(set(edges))
    if not values:
        return F.lit(0)
    low = [bisect_left(edges, v) for v in values]
    middle = [(a + bisect_right(edges, v)) // 2 for v, a in zip(values, low, strict=True)]
    kind = "double" if isinstance(values[0], float) else "bigint"
    table = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    below = lambda i: F.get(table([*low, len(edges)], "int"), i)
    found = lambda i: F.when(F.get(table(values, kind), i) == column, F.get(table(middle, "int"), i)).otherwise(below(i))
    return F.get(F.transform(F.array(edges_below(column, values)), found), F.lit(0))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows left joined with a table that has one row a key, weight telling how many of the total rows have the key.

    No task gets all rows of a hot key: keys of more than HOT_SHARE of the rows are at most 1 / HOT_SHARE, and are
    broadcast; the others meet by shuffle, where the rows of one key are bounded by that share. Null keys match null.
    """
    many = max(100, int(total * HOT_SHARE))
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    table = table.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(table[n]) for k, n in names.items()])
    hot = F.broadcast(table.filter(F.col(weight) > many))
    cold = rows.join(hot, same, "left_anti").join(table.filter(F.col(weight) <= many), same, "left")
    return rows.join(hot, same).unionByName(cold).drop(*names.values())


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


__all__ = ["BROADCAST_ROWS", "SMALL_EDGES", "bitmap", "bounded", "components", "edges_below", "mid_ranks", "packed", "removed", "run_dir", "shared_dir", "ship", "spread_join", "unused", "written"]
