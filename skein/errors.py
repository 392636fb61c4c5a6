"""Errors with a code, a cause and a hint."""

from __future__ import annotations


class RaggedError(Exception):
    """Base of all errors of this library."""

    code = "Error"

    def __init__(self, summary: str, cause: str = "", fix: str = "", **details):
        self.summary, self.cause, self.fix, self.details = summary, cause, fix, details
        lines = [f"{self.code}: {summary}"]
        lines += [f"  cause: {cause}"] if cause else []
        lines += [f"  {k}: {v}" for k, v in details.items()]
        lines += [f"  fix: {fix}"] if fix else []
        super().__init__("\n".join(lines))


def _kind(name: str, base: type) -> type:
    return type(name, (RaggedError, base), {"code": name, "__module__": __name__})


CastFailed = _kind("CastFailed", ValueError)
DTypeUnsupported = _kind("DTypeUnsupported", TypeError)
DTypeInferenceFailed = _kind("DTypeInferenceFailed", TypeError)
BroadcastFailed = _kind("BroadcastFailed", ValueError)
LayoutUnsupported = _kind("LayoutUnsupported", ValueError)
AxisInvalid = _kind("AxisInvalid", ValueError)
IndexOutOfBounds = _kind("IndexOutOfBounds", IndexError)
IndexInvalid = _kind("IndexInvalid", IndexError)
ReduceEmpty = _kind("ReduceEmpty", ValueError)
ArgumentInvalid = _kind("ArgumentInvalid", ValueError)
ColumnMissing = _kind("ColumnMissing", KeyError)
SchemaMismatch = _kind("SchemaMismatch", ValueError)
ShapeMismatch = _kind("ShapeMismatch", ValueError)
IoFailed = _kind("IoFailed", ValueError)
CompileFailed = _kind("CompileFailed", ValueError)
