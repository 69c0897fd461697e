"""Tool handlers: Python functions by name, run for the tool uses of responses."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import HandlerError
from quern.functions import providers
from quern.functions.merge import dumps
from quern.session import ship

RESULT = "id string, name string, result string, error string"


class HandlerRegistry:
    """Sync and async handlers; each gets the parsed input and returns what JSON can hold."""

    def __init__(self) -> None:
        self.sync: dict[str, Callable[[Any], Any]] = {}
        self.awaited: dict[str, Callable[[Any], Any]] = {}

    def register(self, name: str, handler: Callable, shape: Callable[[Any], Any] | None = None) -> None:
        """An async handler; `shape` turns the input into its argument."""

        async def run(value: Any) -> Any:
            return await handler(shape(value) if shape else value)

        self.awaited[name] = run

    def register_raw(self, name: str, handler: Callable) -> None:
        self.awaited[name] = handler

    def register_sync(self, name: str, handler: Callable) -> None:
        self.sync[name] = handler

    def has(self, name: str) -> bool:
        return name in self.sync or name in self.awaited

    def names(self) -> list[str]:
        return sorted({*self.sync, *self.awaited})

    def __len__(self) -> int:
        return len(self.names())

    def is_empty(self) -> bool:
        return not len(self)

    def dispatch_sync(self, name: str, value: Any) -> Any:
        """The sync handler's result; None for an unknown name; an error for a handler that must be awaited."""
        if name in self.sync:
            return self.sync[name](value)
        if name in self.awaited:
            raise HandlerError(f"{name} is async")
        return None

    async def dispatch(self, name: str, value: Any) -> Any:
        """The async handler's result, None if there is none."""
        return await self.awaited[name](value) if name in self.awaited else None

    async def dispatch_all(self, uses: list[tuple[str, Any]]) -> list[Any]:
        """One after the other; the first error ends it."""
        return [await self.dispatch(name, value) for name, value in uses]

    def dispatch_all_sync(self, uses: list[tuple[str, Any]]) -> list[Any]:
        return [self.dispatch_sync(name, value) for name, value in uses]

    def apply(self, df: DataFrame, response: str, key: str, wait: bool = False) -> DataFrame:
        """key, pos, id, name, result, error of every tool use of a response column, handlers run where the rows are.

        Async handlers are run if `wait`, in the order of a response's blocks. Unknown names have NULL results; a failing handler has
        its error's text.
        """
        ship(df.sparkSession)
        uses = df.select(key, F.posexplode(providers.tool_uses(F.col(response))).alias("pos", "u")).select(key, "pos", "u.id", "u.name", "u.input")
        kind = uses.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loop = asyncio.new_event_loop() if wait else None
            for batch in batches:
                results, errors = [], []
                for name, text in zip(batch.column("name").to_pylist(), batch.column("input").to_pylist(), strict=True):
                    try:
                        value = json.loads(text) if text is not None else None
                        found = loop.run_until_complete(self.dispatch(name, value)) if wait and name in self.awaited else self.dispatch_sync(name, value)
                        results.append(dumps(found) if self.has(name) else None)
                        errors.append(None)
                    except Exception as e:  # a handler may fail in any way; the row says how
                        results.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                kept = [batch.column(c) for c in (key, "pos", "id", "name")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[key, "pos", "id", "name", "result", "error"])

        return uses.mapInArrow(run, f"`{key}` {kind}, pos int, {RESULT}")
