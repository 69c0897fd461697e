"""Paths: names and indexes parsed once on the driver."""

from __future__ import annotations

from quern.errors import InvalidPath

Segment = str | int


def parse_path(path: str) -> tuple[Segment, ...]:
    """`a.b[0]["x-y"]` -> ("a", "b", 0, "x-y"); the empty path is the root.

    Quotes know no escapes; indexes are digits only. A dot at the end is an error after a name and allowed after a bracket.
    """
    out: list[Segment] = []
    at, n = 0, len(path)
    while at < n:
        c = path[at]
        if c == "[":
            at += 1
            if at >= n:
                raise InvalidPath(path, "unterminated bracket")
            if path[at] == '"':
                end = path.find('"', at + 1)
                if end < 0:
                    raise InvalidPath(path, "unterminated quote")
                out.append(path[at + 1 : end])
                at = end + 1
                if at >= n or path[at] != "]":
                    raise InvalidPath(path, "expected ] after the quote")
                at += 1
            else:
                end = path.find("]", at)
                if end < 0:
                    raise InvalidPath(path, "unterminated bracket")
                digits = path[at:end]
                if not (digits.isascii() and digits.isdigit()):
                    raise InvalidPath(path, f"{digits!r} isn't an index")
                out.append(int(digits))
                at = end + 1
            if at < n and path[at] == ".":
                at += 1
        else:
            end = at
            while end < n and path[end] not in ".[":
                end += 1
            if end == at:
                raise InvalidPath(path, "empty segment")
            out.append(path[at:end])
            at = end
            if at < n and path[at] == ".":
                at += 1
                if at == n:
                    raise InvalidPath(path, "trailing dot")
    return tuple(out)


def display(segments: tuple[Segment, ...]) -> str:
    """The text of a path, `(root)` for the empty one."""
    out = ""
    for s in segments:
        out += f"[{s}]" if isinstance(s, int) else (f".{s}" if out else s)
    return out or "(root)"
