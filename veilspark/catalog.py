"""The catalog: resources with logical columns over stored tables. Fixed for a request."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import types as T

from veilspark.errors import ActivationError
from veilspark.types import Contract, contract_from


@dataclass(frozen=True)
class ColumnInfo:
    resource: str
    ordinal: int
    name: str
    contract: Contract
    stored: T.DataType


@dataclass(frozen=True)
class Resource:
    name: str
    source: str
    columns: tuple[ColumnInfo, ...]

    def column(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Catalog:
    version: str
    resources: dict[str, Resource]

    def resource(self, name: str) -> Resource | None:
        return self.resources.get(name.lower())


def activate_catalog(manifest: dict, schemas: dict[str, T.StructType]) -> Catalog:
    """schemas: of the stored tables, by source name. Names are unique without regard to ASCII case."""
    if set(manifest) - {"version", "resources"} or manifest.get("version") != 1 or not manifest.get("resources"):
        raise ActivationError("catalog manifest is not valid")
    out: dict[str, Resource] = {}
    for name, spec in manifest["resources"].items():
        if not name or name.lower() in out or set(spec) - {"source", "columns"} or set(spec.get("source") or {}) - {"table"}:
            raise ActivationError("resource is not valid")
        source = (spec.get("source") or {}).get("table", name)
        if source not in schemas:
            raise ActivationError("stored table is missing")
        stored = {f.name.lower(): f for f in schemas[source].fields}
        columns = []
        for i, (column, entry) in enumerate(sorted((spec.get("columns") or {}).items())):
            if not column or column.lower() in (c.name.lower() for c in columns) or column.lower() not in stored:
                raise ActivationError("column is not valid")
            kind = stored[column.lower()].dataType
            columns.append(ColumnInfo(name, i, column, contract_from(entry or {}, kind), kind))
        if not columns:
            raise ActivationError("resource has no columns")
        out[name.lower()] = Resource(name, source, tuple(columns))
    version = hashlib.sha256(json.dumps(manifest, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return Catalog(version, out)


def manifest_of(schemas: dict[str, T.StructType], overlay: dict[str, dict[str, dict]] | None = None) -> dict:
    """A manifest of all columns that can be exposed, with overlaid entries for some."""
    from veilspark.types import DERIVED

    resources = {}
    for table, schema in schemas.items():
        more = (overlay or {}).get(table, {})
        columns = {f.name: more.get(f.name, {}) for f in schema.fields if f.name in more or type(f.dataType) in DERIVED}
        resources[table] = {"source": {"table": table}, "columns": columns}
    return {"version": 1, "resources": resources}
