"""Policies by resource, role and operation. What is not granted is refused.

A predicate is a one-key mapping: and, or (lists), not, or column: {operator: operand}. It becomes a Spark Column; the
same tree can be evaluated in plain three-valued logic, which the tests use as an oracle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.catalog import Catalog, ColumnInfo, Resource
from veilspark.errors import ActivationError, Kind, reject
from veilspark.functions.sqlite import like_column, like_match
from veilspark.types import Logical, Session, typed

COMPARE = ("eq", "neq", "lt", "lte", "gt", "gte")


@dataclass(frozen=True)
class Operand:
    kind: str  # literal, session or column
    value: Any


@dataclass(frozen=True)
class Test:
    column: ColumnInfo
    op: str
    operand: Any


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class SelectPolicy:
    columns: frozenset[str]
    conditional: dict[str, Any]
    filter: Any
    limit: int | None
    allow_aggregations: bool
    allow_windows: bool


@dataclass(frozen=True)
class WritePolicy:
    columns: frozenset[str]
    presets: dict[str, Operand]
    filter: Any
    check: Any
    returning: frozenset[str]


@dataclass(frozen=True)
class CommitCheck:
    name: str
    timeout_ms: int
    env: str | None


@dataclass(frozen=True)
class Policies:
    version: str
    by: dict[tuple[str, str, str], Any]  # (resource, role, operation)
    commit_checks: dict[str, CommitCheck]

    def get(self, resource: Resource, session: Session, operation: str) -> Any:
        found = self.by.get((resource.name.lower(), session.role, operation))
        if found is None:
            raise reject(Kind.MISSING_POLICY)
        return found


def _only(spec: Any, known: set[str]) -> dict:
    if not isinstance(spec, dict) or set(spec) - known:
        raise ActivationError("policy has an unknown key")
    return spec


def _literal(value: Any, column: ColumnInfo) -> Any:
    if value is None or column.contract.logical in (Logical.BYTES, Logical.JSON):
        raise ActivationError("literal is not usable here")
    logical = column.contract.logical
    try:
        return typed(float(value) if logical is Logical.NUMBER and isinstance(value, int) and not isinstance(value, bool) else value, logical)
    except Exception:
        raise ActivationError("literal does not have the column's type") from None


def _operand(spec: Any, column: ColumnInfo, resource: Resource) -> Operand:
    if isinstance(spec, dict):
        if len(spec) != 1:
            raise ActivationError("operand is not valid")
        (kind, value), = spec.items()
        if kind == "literal":
            return Operand("literal", _literal(value, column))
        if kind == "session":
            if column.contract.logical is not Logical.STRING or not isinstance(value, str):
                raise ActivationError("session values are strings")
            return Operand("session", value)
        if kind == "column":
            other = resource.column(str(value))
            if other is None or other.contract.logical is not column.contract.logical:
                raise ActivationError("column operand does not fit")
            return Operand("column", other)
        raise ActivationError("operand is not valid")
    return Operand("literal", _literal(spec, column))


def predicate(spec: Any, resource: Resource) -> Any:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ActivationError("predicate is not valid")
    (key, body), = spec.items()
    if key in ("and", "or"):
        if not isinstance(body, list) or not body:
            raise ActivationError("and / or need a list")
        return Logic(key, tuple(predicate(b, resource) for b in body))
    if key == "not":
        return Logic("not", (predicate(body, resource),))
    column = resource.column(key)
    if column is None or not isinstance(body, dict) or len(body) != 1:
        raise ActivationError("predicate names no column")
    (op, operand), = body.items()
    if op == "is_null":
        if not isinstance(operand, bool):
            raise ActivationError("is_null takes a boolean")
        return Test(column, op, operand)
    if op in ("in", "not_in"):
        if not isinstance(operand, list) or not operand:
            raise ActivationError("in takes a list")
        return Test(column, op, tuple(_literal(v, column) for v in operand))
    if op == "like" and column.contract.logical is not Logical.STRING or op not in (*COMPARE, "like"):
        raise ActivationError("operator does not fit")
    return Test(column, op, _operand(operand, column, resource))


def value_of(operand: Operand, session: Session) -> Any:
    if operand.kind == "session":
        if operand.value not in session.values:
            raise reject(Kind.FORBIDDEN_OPERATION, "session value is missing")
        return session.values[operand.value]
    return operand.value


def columns_of(tree: Any) -> set[str]:
    if isinstance(tree, Logic):
        return set().union(*(columns_of(p) for p in tree.parts))
    out = {tree.column.name}
    if isinstance(tree.operand, Operand) and tree.operand.kind == "column":
        out.add(tree.operand.value.name)
    return out


def to_column(tree: Any, session: Session, get: Callable[[str], Column]) -> Column:
    if isinstance(tree, Logic):
        parts = [to_column(p, session, get) for p in tree.parts]
        if tree.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.op == "and" else out | p
        return out
    left = get(tree.column.name)
    if tree.op == "is_null":
        return left.isNull() if tree.operand else left.isNotNull()
    kind = tree.column.stored
    if tree.op in ("in", "not_in"):
        inside = left.isin([F.lit(v).cast(kind) for v in tree.operand])
        return inside if tree.op == "in" else ~inside
    right = get(tree.operand.value.name) if tree.operand.kind == "column" else F.lit(value_of(tree.operand, session)).cast(kind)
    if tree.op == "like":
        return like_column(left, right) if tree.operand.kind == "column" else like_match(left, value_of(tree.operand, session))
    return {"eq": left == right, "neq": left != right, "lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[tree.op]


def evaluate(tree: Any, session: Session, row: dict[str, Any]) -> bool | None:
    """Three-valued logic without Spark."""
    if isinstance(tree, Logic):
        parts = [evaluate(p, session, row) for p in tree.parts]
        if tree.op == "not":
            return None if parts[0] is None else not parts[0]
        strong = tree.op == "or"
        return strong if strong in parts else None if None in parts else not strong
    left = row[tree.column.name]
    if tree.op == "is_null":
        return (left is None) == tree.operand
    if left is None:
        return None
    if tree.op in ("in", "not_in"):
        return (left in tree.operand) == (tree.op == "in")
    right = row[tree.operand.value.name] if tree.operand.kind == "column" else value_of(tree.operand, session)
    if right is None:
        return None
    if tree.op == "like":
        from veilspark.functions.sqlite import like_regex
        import re

        return bool(re.match(like_regex(right).replace(r"\z", r"\Z"), left))
    return {"eq": left == right, "neq": left != right, "lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[tree.op]


def _names(spec: Any, resource: Resource) -> frozenset[str]:
    found = [resource.column(c) if isinstance(c, str) else None for c in spec or []]
    if None in found or len({c.name for c in found}) != len(found):
        raise ActivationError("columns are unknown or repeated")
    return frozenset(c.name for c in found)


def _select(spec: Any, resource: Resource) -> SelectPolicy:
    spec = _only(spec, {"columns", "filter", "limit", "allow_aggregations", "allow_windows"})
    plain, conditional = [], {}
    for c in spec.get("columns") or []:
        if isinstance(c, dict):
            (name, how), = c.items() if len(c) == 1 else ((None, None),)
            column = resource.column(str(name))
            how = _only(how, {"visible_if", "on_deny"})
            if column is None or column.name in conditional or how.get("on_deny", "null") not in ("null", None) or column.contract.nullable:
                raise ActivationError("conditional column is not valid")
            conditional[column.name] = predicate(how["visible_if"], resource)
        else:
            plain.append(c)
    columns = _names(plain, resource)
    limit = spec.get("limit")
    if columns & set(conditional) or not (columns or conditional) or "filter" not in spec or (limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0)):
        raise ActivationError("select policy is not valid")
    return SelectPolicy(columns, conditional, predicate(spec["filter"], resource), limit, bool(spec.get("allow_aggregations", False)), bool(spec.get("allow_windows", False)))


def _write(spec: Any, resource: Resource, operation: str) -> WritePolicy:
    spec = _only(spec, {"insert": {"columns", "presets", "check", "returning"}, "update": {"columns", "presets", "filter", "check", "returning"}, "delete": {"filter", "returning"}}[operation])
    columns = _names(spec.get("columns"), resource)
    presets = {}
    for name, operand in (spec.get("presets") or {}).items():
        column = resource.column(name)
        if column is None or column.name in columns:
            raise ActivationError("presets and columns overlap or are unknown")
        presets[column.name] = _operand(operand, column, resource)
        if presets[column.name].kind == "column":
            raise ActivationError("a preset is a literal or a session value")
    need = {"insert": ("check",), "update": ("filter", "check"), "delete": ("filter",)}[operation]
    if any(k not in spec for k in need) or (operation != "delete" and not columns and not presets):
        raise ActivationError("write policy is not valid")
    tree = {k: predicate(spec[k], resource) for k in ("filter", "check") if k in spec}
    return WritePolicy(columns, presets, tree.get("filter"), tree.get("check"), _names(_only(spec.get("returning") or {}, {"columns"}).get("columns"), resource))


def activate_policies(spec: dict, catalog: Catalog) -> Policies:
    _only(spec, {"version", "resources", "commit_checks"})
    if spec.get("version") != 1:
        raise ActivationError("policy version is unknown")
    by: dict[tuple[str, str, str], Any] = {}
    for name, body in (spec.get("resources") or {}).items():
        resource = catalog.resource(name)
        if resource is None:
            raise ActivationError("policy names an unknown resource")
        for role, grants in (_only(body, {"roles"}).get("roles") or {}).items():
            from veilspark.types import good_name

            if not good_name(role):
                raise ActivationError("role is not valid")
            for operation, grant in _only(grants, {"select", "insert", "update", "delete"}).items():
                key = (resource.name.lower(), role, operation)
                if key in by:
                    raise ActivationError("policy is repeated")
                by[key] = _select(grant, resource) if operation == "select" else _write(grant, resource, operation)
    checks = {}
    for name, body in (spec.get("commit_checks") or {}).items():
        body = _only(body, {"timeout_ms", "env"})
        if not isinstance(body.get("timeout_ms", 1000), int) or not 1 <= body.get("timeout_ms", 1000) <= 1500:
            raise ActivationError("commit check timeout is out of range")
        checks[name] = CommitCheck(name, body.get("timeout_ms", 1000), body.get("env"))
    if len(checks) > 4:
        raise ActivationError("too many commit checks")
    return Policies(hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16], by, checks)


def load_yaml(text: str) -> dict:
    """Read a YAML document where PyYAML is installed; JSON is always read."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
