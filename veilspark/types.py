"""Logical types, value contracts and the trusted session."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date, datetime
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.errors import ActivationError, Kind, reject


class Logical(Enum):
    STRING = "string"
    INTEGER = "integer"
    INT64 = "int64"
    NUMBER = "number"
    BOOLEAN = "boolean"
    BYTES = "bytes"
    DATE = "date"
    DATETIME = "datetime"
    INSTANT = "instant"
    JSON = "json"


#: Spark types that a logical type may be stored in; the first is used for new data.
STORED = {
    Logical.STRING: (T.StringType,),
    Logical.INTEGER: (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    Logical.INT64: (T.LongType,),
    Logical.NUMBER: (T.DoubleType, T.FloatType, T.IntegerType, T.LongType),
    Logical.BOOLEAN: (T.BooleanType,),
    Logical.BYTES: (T.BinaryType,),
    Logical.DATE: (T.DateType, T.StringType),
    Logical.DATETIME: (T.TimestampNTZType, T.StringType),
    Logical.INSTANT: (T.TimestampType, T.StringType),
    Logical.JSON: (T.StringType,),
}
#: How a stored column without a declared type is read; other types are not exposable.
DERIVED = {
    T.LongType: Logical.INT64, T.IntegerType: Logical.INTEGER, T.DoubleType: Logical.NUMBER, T.FloatType: Logical.NUMBER, T.StringType: Logical.STRING, T.BooleanType: Logical.BOOLEAN,
    T.BinaryType: Logical.BYTES, T.DateType: Logical.DATE, T.TimestampNTZType: Logical.DATETIME, T.TimestampType: Logical.INSTANT,
}

SAFE_INTEGER = (1 << 53) - 1
_KEY = re.compile(r"[a-z][a-z0-9_]*\Z")
#: Names that belong to the server; clients may use neither as parameter nor as result name.
RESERVED = "veil_"
_FORMATS = {
    "uuid": re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"),
    "email": re.compile(r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+\Z"),
    "iso-date": re.compile(r"\d{4}-\d\d-\d\d\Z"),
    "sqlite-datetime": re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?\Z"),
    "rfc3339": re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)\Z"),
}
MANDATORY = {Logical.DATE: "iso-date", Logical.DATETIME: "sqlite-datetime", Logical.INSTANT: "rfc3339"}


def good_name(name: str) -> bool:
    return isinstance(name, str) and bool(_KEY.match(name))


def has_format(value: str, kind: str) -> bool:
    if not _FORMATS[kind].match(value):
        return False
    try:
        if kind == "iso-date":
            date.fromisoformat(value)
        elif kind == "sqlite-datetime":
            datetime.fromisoformat(value[:19])
        elif kind == "rfc3339":
            datetime.fromisoformat(re.sub(r"\.\d+", "", value).replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class Contract:
    """What a column's values may be."""

    logical: Logical
    nullable: bool = False
    format: str | None = None
    enum: tuple | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    json_schema: dict | None = field(default=None, hash=False)

    def accepts(self, value: Any) -> bool:
        """Constraints only; the type is checked by typed()."""
        if self.enum is not None and value not in self.enum:
            return False
        if isinstance(value, (int, float)) and not isinstance(value, bool) and ((self.minimum is not None and value < self.minimum) or (self.maximum is not None and value > self.maximum)):
            return False
        if isinstance(value, str):
            if (self.min_length is not None and len(value) < self.min_length) or (self.max_length is not None and len(value) > self.max_length):
                return False
            if self.pattern is not None and not re.search(self.pattern, value):
                return False
            if self.format and not has_format(value, self.format):
                return False
        return True

    def holds(self, column: Column) -> Column:
        """The same as a predicate over stored values; TRUE for null where the column may be null."""
        parts = []
        if self.enum is not None:
            parts.append(column.isin(list(self.enum)))
        if self.minimum is not None:
            parts.append(column >= self.minimum)
        if self.maximum is not None:
            parts.append(column <= self.maximum)
        if self.min_length is not None:
            parts.append(F.length(column) >= self.min_length)
        if self.max_length is not None:
            parts.append(F.length(column) <= self.max_length)
        if self.pattern is not None:
            parts.append(column.rlike(self.pattern))
        if self.format and self.logical is Logical.STRING:
            # values of dates and instants have a stored type of their own, which holds nothing else
            parts.append(column.rlike(rf"\A(?:{_FORMATS[self.format].pattern})".replace(r"\Z", r"\z")))
        ok = F.lit(True)
        for p in parts:
            ok = ok & p
        return F.coalesce(ok, F.lit(self.nullable)) if self.nullable else column.isNotNull() & F.coalesce(ok, F.lit(False))


def contract_from(spec: dict, stored: T.DataType | None = None) -> Contract:
    """Activate a manifest's column entry against the stored type."""
    known = {"type", "representation", "nullable", "format", "constraints", "jsonSchema", "storage"}
    if set(spec) - known:
        raise ActivationError("unknown column key")
    logical = DERIVED.get(type(stored)) if "type" not in spec else next((x for x in Logical if x.value == spec["type"]), None)
    if logical is None:
        raise ActivationError("column type is unknown or not exposable")
    if stored is not None and not isinstance(stored, STORED[logical]):
        raise ActivationError("declared type does not agree with storage")
    c = spec.get("constraints") or {}
    if set(c) - {"enum", "minimum", "maximum", "minLength", "maxLength", "pattern"}:
        raise ActivationError("unknown constraint")
    if c.get("pattern") is not None:
        if len(c["pattern"]) > 256:
            raise ActivationError("pattern is too long")
        re.compile(c["pattern"])
    if ({"minLength", "maxLength", "pattern"} & set(c) and logical is not Logical.STRING) or ({"minimum", "maximum"} & set(c) and logical not in (Logical.INTEGER, Logical.INT64, Logical.NUMBER)):
        raise ActivationError("constraint does not fit the type")
    if "enum" in c and not c["enum"]:
        raise ActivationError("enum is empty")
    fmt = spec.get("format") or MANDATORY.get(logical)
    if fmt and (fmt not in _FORMATS and fmt not in ("int64", "base64") or (logical in MANDATORY and fmt != MANDATORY[logical])):
        raise ActivationError("format does not fit the type")
    schema = spec.get("jsonSchema")
    if schema is not None:
        if logical is not Logical.JSON:
            raise ActivationError("jsonSchema needs a json column")
        check_json_schema(schema)
    return Contract(
        logical, bool(spec.get("nullable", False)), fmt if fmt in _FORMATS else None, tuple(c["enum"]) if "enum" in c else None, c.get("minimum"), c.get("maximum"), c.get("minLength"), c.get("maxLength"), c.get("pattern"), schema
    )


def check_json_schema(schema: Any, depth: int = 0) -> None:
    if not isinstance(schema, dict) or depth > 32:
        raise ActivationError("json schema is not valid")
    if set(schema) - {"type", "properties", "items", "required", "additionalProperties", "anyOf"}:
        raise ActivationError("json schema key is unknown")
    if "anyOf" in schema:
        if len(schema["anyOf"]) < 2:
            raise ActivationError("anyOf needs two schemas")
        for s in schema["anyOf"]:
            check_json_schema(s, depth + 1)
        return
    if schema.get("type") not in ("object", "array", "string", "integer", "number", "boolean", "null"):
        raise ActivationError("json schema type is unknown")
    for s in (schema.get("properties") or {}).values():
        check_json_schema(s, depth + 1)
    if "items" in schema:
        check_json_schema(schema["items"], depth + 1)


def typed(value: Any, logical: Logical) -> Any:
    """A client's parameter as a value of the type, or a rejection. Null is never accepted."""
    bad = reject(Kind.INVALID_PARAMETER, "value does not have the parameter's type")
    if logical in (Logical.INTEGER, Logical.INT64):
        if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63 or (logical is Logical.INTEGER and abs(value) > SAFE_INTEGER):
            raise bad
    elif logical is Logical.NUMBER:
        if not isinstance(value, float) or not math.isfinite(value):
            raise bad
    elif logical is Logical.BOOLEAN:
        if not isinstance(value, bool):
            raise bad
    elif logical is Logical.JSON:
        if not isinstance(value, (dict, list)):
            raise bad
    elif logical is Logical.BYTES or not isinstance(value, str) or (logical in MANDATORY and not has_format(value, MANDATORY[logical])):
        raise bad
    return value


@dataclass(frozen=True)
class Session:
    """Who asks: set by the server, never by the client. Values are strings."""

    role: str
    values: dict[str, str]
    permissions: frozenset[str] = frozenset(("execute", "explain", "catalog"))

    @staticmethod
    def of(role: str, subject_id: str, permissions: tuple[str, ...] = ("execute", "explain", "catalog"), **values: str) -> Session:
        if not good_name(role) or {"role", "subject_id"} & set(values) or not all(good_name(k) and isinstance(v, str) for k, v in values.items()):
            raise ActivationError("session is not valid")
        return Session(role, {**values, "role": role, "subject_id": subject_id}, frozenset(permissions))
