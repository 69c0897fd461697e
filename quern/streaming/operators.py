"""Provider streams as DataFrames: batches by stream, and Structured Streaming with keyed state.

Input rows: stream_id, seq, provider, chunk. A stream's chunks are taken in order of seq; a null chunk counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import ship
from quern.streaming.sse import EVENT, Decoder

EVENTS = f"stream_id string, n int, {EVENT}"
MESSAGES = "stream_id string, text string, tool_calls array<struct<id:string,name:string,input:string>>, stop_reason string, done boolean"
COLUMNS = ["stream_id", "seq", "provider", "chunk"]
#: Rows that a batch holds on its way back from Python.
ROWS = 2000


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("index", "n"):
        if c in out:
            out[c] = out[c].astype("Int32")
    return out


def _whole(batches: Iterator[pa.RecordBatch], parity: bool) -> Iterator[tuple[str | None, Decoder, list[dict]]]:
    """Each stream of sorted chunks with its decoder and events. A stream may go over several batches; one is held at a time."""
    decoder, now = None, None
    for batch in batches:
        for key, provider, chunk in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "provider", "chunk")), strict=True):
            if decoder is None or key != now:
                if decoder is not None:
                    yield now, decoder, decoder.feed("".join(parts)) + decoder.finish()
                decoder, now, parts = Decoder(provider=provider, parity=parity), key, []
            if chunk:
                parts.append(chunk)
    if decoder is not None:
        yield now, decoder, decoder.feed("".join(parts)) + decoder.finish()


def _by_stream(df: DataFrame, rows: Callable[[str | None, Decoder, list[dict]], list[dict]], schema: str, parity: bool) -> DataFrame:
    """`rows` of each whole stream. Streams are sorted and go to Python in batches: a data frame for each would cost far more than its decoding."""
    ship(df.sparkSession)
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for key, decoder, events in _whole(batches, parity):
            held += rows(key, decoder, events)
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held, kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)

    chunks = df.select(F.col("stream_id").cast("string"), *COLUMNS[1:]).repartition("stream_id")
    return chunks.sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last()).mapInArrow(run, schema)


def sse_events(df: DataFrame, parity: bool = False) -> DataFrame:
    """The events of whole streams, numbered from 0 in each. One stream, which is one connection, is one task's."""
    return _by_stream(df, lambda key, _, events: [{"stream_id": key, "n": i} | e for i, e in enumerate(events)], EVENTS, parity)


def messages(df: DataFrame, parity: bool = False) -> DataFrame:
    """The message that each whole stream adds up to."""
    return _by_stream(df, lambda key, decoder, _: [{"stream_id": key} | decoder.message], MESSAGES, parity)


def stream_events(df: DataFrame, parity: bool = False, timeout_ms: int | None = None) -> DataFrame:
    """The events of a streaming DataFrame, in append mode.

    The state of a stream is its decoder and the chunks that came too early: a chunk waits until all before it (seq from 0)
    are there. `timeout_ms` ends and forgets streams that are silent for so long.
    """
    ship(df.sparkSession)
    names = [x.split()[0] for x in EVENTS.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoded, provider, expected, n, seqs, chunks = state.get if state.exists else (None, None, 0, 0, [], [])
        if state.hasTimedOut:
            decoder = Decoder.load(decoded, provider=provider, parity=parity) if decoded else Decoder()
            state.remove()
            rows = decoder.finish()
            yield _frame([{"stream_id": key[0], "n": n + i} | e for i, e in enumerate(rows)], names)
            return
        waiting = dict(zip(seqs, chunks, strict=True))
        for pdf in frames:
            provider = provider or pdf["provider"].iloc[0]
            waiting |= {int(s): c or "" for s, c in zip(pdf["seq"], pdf["chunk"], strict=True) if s >= expected}
        decoder = Decoder.load(decoded, provider=provider, parity=parity) if decoded else Decoder(provider=provider, parity=parity)
        rows = []
        while expected in waiting:
            rows += decoder.feed(waiting.pop(expected))
            expected += 1
        state.update((decoder.dump(), provider, expected, n + len(rows), list(waiting), list(waiting.values())))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield _frame([{"stream_id": key[0], "n": n + i} | e for i, e in enumerate(rows)], names)

    state = "decoder string, provider string, expected long, n long, seqs array<long>, chunks array<string>"
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.select(F.col("stream_id").cast("string"), *COLUMNS[1:]).groupBy("stream_id").applyInPandasWithState(run, EVENTS, state, "append", kind)
