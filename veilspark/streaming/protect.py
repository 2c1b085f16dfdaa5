"""An extension of ours: the row filter, column grants and redaction of a select policy over a stream.

They are expressions of one row, so they hold for unbounded tables in append mode as they do for tables; limits,
aggregates and windows of the policy don't apply to a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import Catalog
from veilspark.policy import Policies, to_column
from veilspark.types import Session


def protect(stream: DataFrame, resource: str, catalog: Catalog, policies: Policies, session: Session) -> DataFrame:
    """The rows and columns that the session's role may read; conditional columns are null where they are hidden."""
    found = catalog.resource(resource)
    if found is None:
        raise ValueError("resource")
    policy = policies.get(found, session, "select")
    rows = stream.filter(to_column(policy.filter, session, F.col))
    out = [F.col(c.name) if c.name in policy.columns else F.when(to_column(policy.conditional[c.name], session, F.col), F.col(c.name)).alias(c.name) for c in found.columns if c.name in policy.columns or c.name in policy.conditional]
    return rows.select(*out)
