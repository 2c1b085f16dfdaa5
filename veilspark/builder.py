"""A query builder over the same front end: it makes the statement and its numbered parameters, never quoted values."""

from __future__ import annotations

from typing import Any


def _quoted(name: str) -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


class Query:
    """Query("orders").select("o_orderkey").where("o_custkey", "=", 7).order_by("o_orderkey").limit(5).compile()"""

    def __init__(self, resource: str, alias: str | None = None) -> None:
        self._from = _quoted(resource) + (f" AS {_quoted(alias)}" if alias else "")
        self._columns: list[str] = []
        self._joins: list[str] = []
        self._where: list[str] = []
        self._group: list[str] = []
        self._order: list[str] = []
        self._tail: list[str] = []
        self.params: dict[str, Any] = {}

    def _param(self, value: Any) -> str:
        name = f"p{len(self.params) + 1}"
        self.params[name] = value
        return f":{name}"

    def select(self, *columns: str, **renamed: str) -> Query:
        self._columns += [_quoted(c) for c in columns] + [f"{_quoted(c)} AS {_quoted(a)}" for a, c in renamed.items()]
        return self

    def count(self, alias: str = "count") -> Query:
        self._columns.append(f"COUNT(*) AS {_quoted(alias)}")
        return self

    def join(self, resource: str, left: str, right: str, alias: str | None = None, kind: str = "inner") -> Query:
        word = {"inner": "JOIN", "left": "LEFT JOIN"}[kind]
        self._joins.append(f"{word} {_quoted(resource)}{f' AS {_quoted(alias)}' if alias else ''} ON {_quoted(left)} = {_quoted(right)}")
        return self

    def where(self, column: str, op: str, value: Any = None) -> Query:
        known = {"=", "<>", "<", "<=", ">", ">=", "LIKE", "NOT LIKE", "GLOB", "NOT GLOB", "IN", "NOT IN", "IS NULL", "IS NOT NULL"}
        if op.upper() not in known:
            raise ValueError("operator")
        op = op.upper()
        if op.startswith("IS"):
            self._where.append(f"{_quoted(column)} {op}")
        elif op.endswith("IN"):
            self._where.append(f"{_quoted(column)} {op} ({', '.join(self._param(v) for v in value)})")
        else:
            self._where.append(f"{_quoted(column)} {op} {self._param(value)}")
        return self

    def group_by(self, *columns: str) -> Query:
        self._group += [_quoted(c) for c in columns]
        return self

    def order_by(self, column: str, descending: bool = False) -> Query:
        self._order.append(f"{_quoted(column)} DESC" if descending else _quoted(column))
        return self

    def limit(self, n: int, offset: int | None = None) -> Query:
        self._tail = [f"LIMIT {self._param(n)}"] + ([f"OFFSET {self._param(offset)}"] if offset is not None else [])
        return self

    def compile(self) -> tuple[str, dict[str, Any]]:
        parts = [f"SELECT {', '.join(self._columns)} FROM {self._from}", *self._joins]
        for word, items, glue in (("WHERE", self._where, " AND "), ("GROUP BY", self._group, ", "), ("ORDER BY", self._order, ", ")):
            if items:
                parts.append(f"{word} {glue.join(items)}")
        return " ".join(parts + self._tail), dict(self.params)
