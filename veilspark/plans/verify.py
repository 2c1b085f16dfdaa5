"""A second look at the analysed plan, independent of how it was built.

Every leaf must be a table of this request and lie below one of its protected scans; the output must be exactly the
columns promised.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from veilspark.errors import EngineError


class InvariantViolation(EngineError):
    code = "VEIL_INTERNAL"


def _plan(df: DataFrame) -> Any:
    return df._jdf.queryExecution().analyzed()


def _children(node: Any) -> list[Any]:
    found = []
    seq = node.children()
    for i in range(seq.size()):
        found.append(seq.apply(i))
    inner = node.subqueries()
    for i in range(inner.size()):
        found.append(inner.apply(i))
    return found


def verify(frame: DataFrame, scans: list[DataFrame], names: list[str]) -> None:
    if frame.columns != names:
        raise InvariantViolation("output differs")
    protected = {_plan(s).semanticHash() for s in scans}
    stack = [(_plan(frame), False)]
    while stack:
        node, safe = stack.pop()
        safe = safe or node.semanticHash() in protected
        children = _children(node)
        if not children and not safe and (scans or node.nodeName() not in ("Range", "OneRowRelation")):
            raise InvariantViolation("unprotected relation")
        stack += [(c, safe) for c in children]
