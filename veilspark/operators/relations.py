"""A bound, authorised SELECT as a DataFrame: policies at the scans, then joins, filters, groups, windows, order, limit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspark.functions import sqlite
from veilspark.plans.authorize import Grants, expressions
from veilspark.plans.binder import BoundSelect, Col, Const, ExistsIn, Op, Param, RowNumber, Scope, walk
from veilspark.plans.syntax import unsupported
from veilspark.policy import columns_of, to_column
from veilspark.shipping import ship
from veilspark.types import STORED, Logical, Session


@dataclass
class Built:
    frame: DataFrame  # public columns, then a boolean for each redacted one
    names: list[str]
    flags: dict[str, str] = field(default_factory=dict)  # result name -> its visibility column
    scans: list[DataFrame] = field(default_factory=list)
    sources: list[DataFrame] = field(default_factory=list)

    @property
    def public(self) -> DataFrame:
        return self.frame.select(*self.names) if self.flags else self.frame


def _name(c: Col) -> str:
    return f"t{c.scope}__{c.info.name}"


def refs(e: Any) -> set[int]:
    """Scopes that an expression reads, without those it brings itself."""
    own = {x.scope.id for x in walk(e) if isinstance(x, ExistsIn)}
    return {x.scope for x in walk(e) if isinstance(x, Col)} - own


def conjuncts(e: Any) -> list[Any]:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, Op) and e.op == "AND" else [] if e is None else [e]


class Build:
    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], q: BoundSelect, grants: Grants, session: Session, values: dict[str, Any]) -> None:
        self.spark, self.table, self.q, self.grants, self.session, self.values = spark, table, q, grants, session, values
        self.scans: list[DataFrame] = []
        self.sources: list[DataFrame] = []
        self.used: dict[int, set[str]] = {}
        extra = [q.collection[1]] if q.collection else []
        for e in expressions(q) + extra:
            for x in walk(e):
                if isinstance(x, Col):
                    self.used.setdefault(x.scope, set()).add(x.info.name)
        self.key: str | None = None
        if q.collection:
            # elements follow the first stored column that the role may read, the key as a rule
            doc = q.collection[1]
            resource = next(s for s in q.scopes if s.id == doc.scope).resource
            names = {c.name.lower(): c.name for c in resource.columns if c.name in grants.by_scope[doc.scope].columns and c.name != doc.info.name}
            self.key = next((names[c.lower()] for c in table(resource.source).columns if c.lower() in names), None)
            if self.key:
                self.used[doc.scope].add(self.key)

    # -- expressions --

    def literal(self, value: Any, logical: Logical, stored: T.DataType | None) -> Column:
        if logical is Logical.JSON:
            value = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return F.lit(value).cast(stored if stored is not None else STORED[logical][0]())

    def scalar(self, e: Any, like: T.DataType | None = None, outer: frozenset[int] = frozenset()) -> Column:
        """like: the stored type of the other side; outer: scopes that lie outside the subquery being built."""
        match e:
            case Col():
                c = F.col(_name(e))
                return c.outer() if e.scope in outer else c
            case Const(value, logical):
                return self.literal(value, logical, like)
            case Param(name, logical):
                return self.literal(self.values[name], logical, like)
            case Op("||", args):
                return F.concat(*(self.scalar(a, None, outer) for a in args))
            case Op("TEXT", (inner,)):
                return sqlite.cast_text(self.scalar(inner, None, outer), self.stored(inner))
            case Op("LOWER", (inner,)):
                return sqlite.lower(self.scalar(inner, None, outer))
            case Op("UPPER", (inner,)):
                return sqlite.upper(self.scalar(inner, None, outer))
            case Op("JSON", (doc, _), _, (steps, kind)):
                return sqlite.json_extract(self.scalar(doc, None, outer), steps, kind)
            case Op("COUNT"):
                return F.col("veil__count")
            case Op("CASE", branches, _, otherwise):
                kind = next((s for s in (self.stored(r) for _, r in branches) if s is not None), None)
                out = None
                for c, r in branches:
                    test, value = self.test(c, outer), self.scalar(r, kind, outer)
                    out = F.when(test, value) if out is None else out.when(test, value)
                return out if otherwise is None else out.otherwise(self.scalar(otherwise, kind, outer))
            case RowNumber(partition, order):
                keys = [F.col(_name(c)).desc_nulls_last() if d else F.col(_name(c)).asc_nulls_first() for c, d in order]
                window = Window.partitionBy(*[F.col(_name(c)) for c in partition]).orderBy(*keys) if partition else Window.orderBy(*keys)
                return F.row_number().over(window).cast("long")
        raise unsupported("expression")

    def stored(self, e: Any) -> T.DataType | None:
        if isinstance(e, Col):
            return e.info.stored
        if isinstance(e, Op) and e.op == "CASE":
            return next((s for s in (self.stored(r) for _, r in e.args) if s is not None), None)
        return STORED[e.logical][0]() if isinstance(e, (Op, Const)) else None

    def test(self, e: Any, outer: frozenset[int] = frozenset()) -> Column:
        match e:
            case Op("AND", (a, b)):
                return self.test(a, outer) & self.test(b, outer)
            case Op("OR", (a, b)):
                return self.test(a, outer) | self.test(b, outer)
            case Op("NOT", (a,)):
                return ~self.test(a, outer)
            case Op("NULL", (a,)):
                return self.scalar(a, None, outer).isNull()
            case Op("NOTNULL", (a,)):
                return self.scalar(a, None, outer).isNotNull()
            case Op("IN" | "NOTIN" as op, (a, *items)):
                kind = self.stored(a)
                inside = self.scalar(a, None, outer).isin([self.scalar(i, kind, outer) for i in items])
                return inside if op == "IN" else ~inside
            case Op("LIKE" | "NOTLIKE" | "GLOB" | "NOTGLOB" as op, (a, p)):
                text = self.scalar(a, None, outer)
                known = p.value if isinstance(p, Const) else self.values[p.name] if isinstance(p, Param) else None
                if known is None:
                    made = self.scalar(p, None, outer)
                    if op.endswith("GLOB"):
                        ship(self.spark)
                    found = sqlite.glob_column(text, made) if op.endswith("GLOB") else sqlite.like_column(text, made)
                else:
                    found = sqlite.like_match(text, known) if op.endswith("LIKE") else sqlite.glob_match(text, known)
                return ~found if op.startswith("NOT") else found
            case Op(op, (a, b)):
                x, y = self.scalar(a, self.stored(b), outer), self.scalar(b, self.stored(a), outer)
                return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
            case ExistsIn(scope, where, _):
                if any(isinstance(x, ExistsIn) for x in walk(where) if where is not None):
                    raise unsupported("nested exists inside or, not or case")
                body = self.scan(scope)
                if where is not None:
                    body = body.where(self.test(where, frozenset(refs(where)) - {scope.id}))
                return body.exists()
        raise unsupported("predicate")

    # -- relations --

    def scan(self, scope: Scope) -> DataFrame:
        """Permitted columns of permitted rows; what only the policy reads ends here."""
        policy, source = self.grants.by_scope[scope.id], self.table(scope.resource.source)
        self.sources.append(source)
        stored = {c.name: c.name for c in scope.resource.columns}
        used = sorted(self.used.get(scope.id, set()))
        needed = set(used) | columns_of(policy.filter)
        for name in used:
            if name in policy.conditional:
                needed |= columns_of(policy.conditional[name])
        rows = source.select(*[F.col(stored[n]) for n in sorted(needed)]).filter(to_column(policy.filter, self.session, F.col))
        out = []
        for name in used:
            if name in policy.conditional:
                visible = to_column(policy.conditional[name], self.session, F.col)
                out += [F.when(visible, F.col(name)).alias(f"t{scope.id}__{name}"), F.coalesce(visible, F.lit(False)).alias(f"v{scope.id}__{name}")]
            else:
                out.append(F.col(name).alias(f"t{scope.id}__{name}"))
        scan = rows.select(*out) if out else rows.select(F.lit(1).alias(f"t{scope.id}__veil"))
        self.scans.append(scan)
        if policy.limit == 0 and scope not in self.q.scopes:  # an EXISTS over no rows
            return scan.filter(F.lit(False))
        return scan

    def attach(self, df: DataFrame, e: ExistsIn, negated: bool) -> DataFrame:
        """Semi or anti join; an EXISTS inside moves to the side it reads from."""
        right, on = self.scan(e.scope), []
        for c in conjuncts(e.where):
            inner, deny = (c.args[0], True) if isinstance(c, Op) and c.op == "NOT" and isinstance(c.args[0], ExistsIn) else (c, False)
            if not isinstance(inner, ExistsIn):
                on.append(c)
                continue
            reads = refs(inner)
            if reads <= {e.scope.id}:
                right = self.attach(right, inner, deny)
            elif e.scope.id not in reads and not negated:
                df = self.attach(df, inner, deny)
            elif not deny and not any(isinstance(x, ExistsIn) for x in walk(inner.where)):
                parts = conjuncts(inner.where)
                local = [p for p in parts if refs(p) <= {e.scope.id, inner.scope.id}]
                if not any(refs(p) == {e.scope.id, inner.scope.id} for p in local):
                    raise unsupported("nested exists without a link to the one around it")
                right = right.join(self.scan(inner.scope), self.all(local), "inner")
                on += [p for p in parts if p not in local]
            else:
                raise unsupported("nested exists")
        return df.join(right, self.all(on), "left_anti" if negated else "left_semi")

    def all(self, parts: list[Any]) -> Column:
        out = None
        for p in parts:
            out = self.test(p) if out is None else out & self.test(p)
        return F.lit(True) if out is None else out

    def filter(self, df: DataFrame, where: Any) -> DataFrame:
        parts = conjuncts(where)
        plain = [p for p in parts if not any(isinstance(x, ExistsIn) for x in walk(p))]
        if plain:
            df = df.filter(self.all(plain))
        for p in parts:
            if isinstance(p, ExistsIn):
                df = self.attach(df, p, False)
            elif isinstance(p, Op) and p.op == "NOT" and isinstance(p.args[0], ExistsIn):
                df = self.attach(df, p.args[0], True)
            elif p not in plain:
                df = df.filter(self.test(p))
        return df

    def number(self, e: Any) -> int | None:
        return None if e is None else e.value if isinstance(e, Const) else self.values[e.name]

    def run(self) -> Built:
        q = self.q
        names = [n for n, _ in q.projections]
        if q.root is None:
            df = self.spark.range(1).select(*[F.lit(e.value).cast(STORED[e.logical][0]()).alias(n) for n, e in q.projections])
            return Built(df, names)
        df = self.scan(q.root)
        for j in q.joins:
            df = df.join(self.scan(j.scope), self.test(j.on), j.kind)
        df = self.filter(df, q.where)
        if q.collection is not None:
            return self.collect_json(df, names)
        if q.grouped:
            df = df.groupBy(*[F.col(_name(c)) for c in dict.fromkeys(q.group)]).agg(F.count(F.lit(1)).alias("veil__count"))
            if q.having is not None:
                df = df.filter(self.test(q.having))
        flags = {}
        out = [self.scalar(e).alias(f"p{i}") for i, (_, e) in enumerate(q.projections)]
        for i in self.grants.redacted:
            c = q.projections[i][1]
            flags[names[i]] = f"veil_visible_{i}"
            out.append(F.col(f"v{c.scope}__{c.info.name}").alias(flags[names[i]]))
        shown = {e: f"p{i}" for i, (_, e) in enumerate(q.projections) if isinstance(e, (Col, RowNumber))}
        keys = []
        for k, (e, down) in enumerate(q.order):
            if e in shown:
                key = F.col(shown[e])
            else:
                out.append(self.scalar(e).alias(f"o{k}"))
                key = F.col(f"o{k}")
            keys.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        df = df.select(*out)
        if keys:
            df = df.orderBy(*keys)
        if q.offset is not None:
            df = df.offset(self.number(q.offset))
        limits = [x for x in (self.number(q.limit), self.grants.limit) if x is not None]
        if limits:
            df = df.limit(min(limits))
        final = [F.col(f"p{i}").alias(n) for i, n in enumerate(names)] + [F.col(f) for f in flags.values()]
        return Built(df.select(*final), names, flags, self.scans, self.sources)

    def collect_json(self, df: DataFrame, names: list[str]) -> Built:
        """One text of all elements, in one row: rows by key, equal or missing keys by document, elements in document order."""
        kind, doc, steps = self.q.collection
        values = (sqlite.json_each_values if kind == "json_each" else sqlite.json_tree_values)(F.col(_name(doc)), steps)
        key = F.col(f"t{doc.scope}__{self.key}") if self.key else F.lit(None).cast("int")
        rows = df.select(key.alias("key"), F.col(_name(doc)).alias("doc"), values.alias("items")).filter(F.size("items") > 0)
        sorted_ = F.sort_array(F.collect_list(F.struct("key", "doc", "items")))
        whole = rows.agg(F.concat(F.lit("["), F.array_join(F.flatten(F.transform(sorted_, lambda r: r["items"])), ","), F.lit("]")).alias("j"))
        return Built(whole.select(F.coalesce("j", F.lit("[]")).alias(names[0])), names, {}, self.scans, self.sources)
