"""INSERT, UPDATE and DELETE as new snapshots, with presets, row filters, post-state checks and RETURNING."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.errors import Kind, reject
from veilspark.operators.relations import Build
from veilspark.plans.binder import BoundSelect, BoundWrite, Col, Const, Param
from veilspark.policy import WritePolicy, to_column, value_of
from veilspark.sources.snapshots import Snapshot, Store
from veilspark.types import Session


@dataclass
class Written:
    snapshot: Snapshot
    affected: int
    returning: DataFrame | None


class _Plain(Build):
    """Expressions over the stored columns of one table."""

    def __init__(self, store: Store, values: dict[str, Any]) -> None:
        self.spark, self.values, self.q = store.spark, values, BoundSelect([])

    def scalar(self, e: Any, like: T.DataType | None = None, outer: frozenset[int] = frozenset()) -> Column:
        return F.col(f"`{e.info.name}`") if isinstance(e, Col) else super().scalar(e, like, outer)


def _value(e: Any, values: dict[str, Any]) -> Any:
    value = e.value if isinstance(e, Const) else values[e.name] if isinstance(e, Param) else e
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else value


def _conflict(rows: DataFrame, check: Any, session: Session) -> bool:
    """Is there a row for which the check is not TRUE."""
    ok = F.coalesce(to_column(check, session, F.col), F.lit(False))
    return not rows.filter(~ok).isEmpty()


def _valid(rows: DataFrame, w: BoundWrite) -> bool:
    """Do all rows meet their columns' contracts."""
    ok = F.lit(True)
    for c in w.scope.resource.columns:
        ok = ok & c.contract.holds(F.col(f"`{c.name}`"))
    return rows.filter(~ok).isEmpty()


def apply(store: Store, snap: Snapshot, w: BoundWrite, policy: WritePolicy, session: Session, values: dict[str, Any], expected: int | None = None) -> Written:
    """Compute the next snapshot; nothing is published. A failed check or expectation leaves only unnamed files."""
    table = w.scope.resource.source
    schema = store.schemas(snap)[table]
    presets = {k: value_of(o, session) for k, o in policy.presets.items()}
    contracts = {c.name.lower(): c.contract for c in w.scope.resource.columns}
    if any(v is not None and not contracts[k.lower()].accepts(v) for k, v in presets.items()):
        raise reject(Kind.EXPECTATION_FAILED, "preset")
    if w.operation == "insert":
        return _insert(store, snap, w, policy, session, values, table, schema, presets, expected)
    current = store.read(snap, table)
    wanted = F.coalesce(to_column(policy.filter, session, F.col), F.lit(False))
    if w.where is not None:
        wanted = wanted & F.coalesce(_Plain(store, values).test(w.where), F.lit(False))
    hit = current.filter(wanted)
    counts = hit.select(F.col("_metadata.file_path").alias("f")).groupBy("f").count().collect() if snap.tables[table] else []  # a row for each touched file
    affected = sum(r["count"] for r in counts)
    if expected is not None and affected != expected:
        raise reject(Kind.EXPECTATION_FAILED)
    touched = {_plain_path(r["f"]) for r in counts}
    stay = [f for f in snap.tables[table] if _plain_path(f) not in touched]
    go = [f for f in snap.tables[table] if _plain_path(f) in touched]
    if not go:
        return Written(snap, 0, _returned(hit, w))
    rewritten = store.spark.read.schema(schema).parquet(*go)
    if w.operation == "delete":
        rest, shown = rewritten.filter(~wanted), rewritten.filter(wanted)
    else:
        new = {c.name.lower(): _value(e, values) for c, e in zip(w.columns, w.rows[0], strict=True)} | {k.lower(): v for k, v in presets.items()}
        fields = {f.name.lower(): f for f in schema.fields}
        change = lambda n: F.lit(new[n.lower()]).cast(fields[n.lower()].dataType)
        after = [change(f.name).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in schema.fields]
        changed = rewritten.filter(wanted).select(*after)
        if policy.check is not None and _conflict(changed, policy.check, session) or not _valid(changed, w):
            raise reject(Kind.EXPECTATION_FAILED, "check")
        rest = rewritten.select(*[F.when(wanted, change(f.name)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in schema.fields])
        shown = changed
    files = store.add(table, rest)
    return Written(replace(snap, tables=snap.tables | {table: tuple([*stay, *files])}), affected, _returned(shown, w))


def _plain_path(path: str) -> str:
    """file:/x, file:///x and /x name one file."""
    from urllib.parse import unquote, urlsplit

    parts = urlsplit(path)
    return f"{parts.netloc}{unquote(parts.path)}"


def _insert(store: Store, snap: Snapshot, w: BoundWrite, policy: WritePolicy, session: Session, values: dict[str, Any], table: str, schema: T.StructType, presets: dict[str, Any], expected: int | None) -> Written:
    if expected is not None and expected != len(w.rows):
        raise reject(Kind.EXPECTATION_FAILED)
    names = [c.name.lower() for c in w.columns] + [k.lower() for k in presets]
    rows = []
    for row in w.rows:
        given = dict(zip(names, [*[_value(e, values) for e in row], *presets.values()], strict=True))
        rows.append([given.get(f.name.lower()) for f in schema.fields])
    # texts of dates and numbers are cast to the stored types in one place
    raw = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.StringType, T.BooleanType, T.BinaryType)) else T.DoubleType() if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else T.LongType() if isinstance(f.dataType, T.IntegralType) else T.StringType()) for f in schema.fields])
    new = store.spark.createDataFrame([tuple(float(v) if isinstance(k.dataType, T.DoubleType) and v is not None else v for v, k in zip(r, raw.fields, strict=True)) for r in rows], raw)
    new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    if (policy.check is not None and _conflict(new, policy.check, session)) or not _valid(new, w):
        raise reject(Kind.EXPECTATION_FAILED, "check")
    files = store.add(table, new.coalesce(1))
    return Written(replace(snap, tables=snap.tables | {table: (*snap.tables[table], *files)}), len(rows), _returned(new, w))


def _returned(rows: DataFrame, w: BoundWrite) -> DataFrame | None:
    return rows.select(*[F.col(f"`{c.info.name}`").alias(n) for n, c in w.returning]) if w.returning else None


__all__ = ["Written", "apply"]
