"""What is refused, by a closed set of kinds. Messages never name hidden columns or resources."""

from __future__ import annotations

from enum import Enum


class Kind(Enum):
    INVALID_REQUEST = "INVALID_REQUEST"
    INVALID_SQL = "INVALID_SQL"
    MULTIPLE_STATEMENTS = "MULTIPLE_STATEMENTS"
    UNSUPPORTED_SQL = "UNSUPPORTED_SQL"
    MISSING_POLICY = "MISSING_POLICY"
    FORBIDDEN_OPERATION = "FORBIDDEN_OPERATION"
    FORBIDDEN_COLUMN = "FORBIDDEN_COLUMN"
    FORBIDDEN_COLUMN_CONTEXT = "FORBIDDEN_COLUMN_CONTEXT"
    DUPLICATE_RESULT_COLUMN = "DUPLICATE_RESULT_COLUMN"
    INVALID_PARAMETER = "INVALID_PARAMETER"
    AMBIGUOUS_PARAMETER_TYPE = "AMBIGUOUS_PARAMETER_TYPE"
    RESERVED_PARAMETER = "RESERVED_PARAMETER"
    PRESET_COLUMN = "PRESET_COLUMN"
    LIMIT_EXCEEDED = "LIMIT_EXCEEDED"
    EXPECTATION_FAILED = "EXPECTATION_FAILED"


class EngineError(Exception):
    """code is public and stable; the message says no more than the code."""

    code = "VEIL_INTERNAL"

    def public(self) -> dict:
        return {"code": self.code, "message": str(self)}


class Rejected(EngineError):
    def __init__(self, kind: Kind, detail: str = "") -> None:
        super().__init__("statement was rejected")
        self.kind, self.detail, self.index = kind, detail, None
        self.code = f"VEIL_{kind.value}"

    def public(self) -> dict:
        return super().public() | ({} if self.index is None else {"path": f"/statements/{self.index}"})


class AccessDenied(EngineError):
    code = "VEIL_FORBIDDEN_ACCESS"


class SnapshotMismatch(EngineError):
    code = "VEIL_SCHEMA_MISMATCH"


class StaleOperation(EngineError):
    code = "VEIL_STALE_OPERATION"


class ExecutionFailed(EngineError):
    code = "VEIL_DATABASE_UNAVAILABLE"


class UsageExceeded(EngineError):
    code = "VEIL_USAGE_BUDGET_EXCEEDED"


class ActivationError(ValueError):
    """A catalog or policy that can't be used; raised to its operator, never to a client."""


def reject(kind: Kind, detail: str = "") -> Rejected:
    return Rejected(kind, detail)
