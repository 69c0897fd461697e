"""What can go wrong: exceptions when a plan is built or a source is opened, status codes on rows."""

from __future__ import annotations


class QuernError(Exception):
    """Of all errors of this package."""


class InvalidPath(QuernError, ValueError):
    def __init__(self, path: str, why: str):
        super().__init__(f"invalid path {path!r}: {why}")
        self.path = path


class InvalidSpec(QuernError, ValueError):
    """A contract that can't be compiled: two fields from one key, two overflow fields."""


class ShapingFailed(QuernError):
    """Rows that a strict run rejects."""


class HandlerError(QuernError):
    """A tool handler that is missing, needs an event loop, or failed."""


class SourceError(QuernError):
    """A source that can't be read."""


class ConnectionFailed(SourceError):
    pass


class QueryFailed(SourceError):
    pass


#: Status of a row's walk along a path.
OK, NOT_FOUND, TYPE_MISMATCH, OUT_OF_BOUNDS = "ok", "path_not_found", "type_mismatch", "index_out_of_bounds"
#: Status of a coercion that gave no value of its type.
FAILED = "coercion_failed"
