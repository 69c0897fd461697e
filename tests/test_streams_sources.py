from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.errors import ConnectionFailed, HandlerError, QueryFailed
from quern.functions import merge, providers
from quern.functions import variants as V
from quern.operators.registry import HandlerRegistry
from quern.sources.databases import SparkSource, SqliteSource
from quern.sources.files import read_json_rows, read_jsonl, rows_of, write_json
from quern.streaming import operators as streams
from quern.streaming.sse import Decoder, SseParser

ANTHROPIC = "".join(
    f"event: {kind}\ndata: {json.dumps(body)}\n\n"
    for kind, body in [
        ("message_start", {"message": {"id": "m"}}),
        ("content_block_start", {"index": 0, "content_block": {"type": "text"}}),
        ("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": "Grüß "}}),
        ("content_block_start", {"index": 1, "content_block": {"type": "tool_use", "id": "t1", "name": "look"}}),
        ("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a"'}}),
        ("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": "dich"}}),
        ("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": ":1}"}}),
        ("content_block_stop", {"index": 1}),
        ("ping", {}),
        ("message_delta", {"delta": {"stop_reason": "tool_use"}, "usage": {"output_tokens": 3}}),
        ("message_stop", {}),
        ("novelty", {"x": 1}),
    ]
)
OPENAI = "".join(
    f"data: {x if isinstance(x, str) else json.dumps(x)}\r\n\r\n"
    for x in [
        {"choices": [{"delta": {"content": "Hi"}}]},
        {"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "c1", "function": {"name": "look", "arguments": '{"a"'}}]}}]},
        {"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": ":2}"}}]}}]},
        {"choices": [{"delta": {}, "finish_reason": "tool_calls"}]},
        {"choices": [], "usage": {"prompt_tokens": 1}},
        "{broken",
        "[DONE]",
    ]
)


def test_lines():
    parser = SseParser()
    assert parser.feed(": note\nevent:a\ndata: x\ndata:  y\nid: 1\n\nevent: b\n\ndata: z") == [("a", "x\n y")]
    assert parser.finish() == [(None, "z")]


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
@pytest.mark.parametrize("provider", ["anthropic", "openai"])
def test_chunks_do_not_matter(provider, size):
    text = ANTHROPIC if provider == "anthropic" else OPENAI
    whole, cut = Decoder(provider), Decoder(provider)
    expected = whole.feed(text) + whole.finish()
    found = []
    for i in range(0, len(text), size):
        cut = Decoder.load(cut.dump(), provider=provider)
        found += cut.feed(text[i : i + size])
    assert found + cut.finish() == expected
    m = whole.message
    assert m["tool_calls"] == [{"id": "t1" if provider == "anthropic" else "c1", "name": "look", "input": '{"a":1}' if provider == "anthropic" else '{"a":2}'}]
    assert (m["stop_reason"], m["done"], m["text"]) == ("tool_use", True, "Grüß dich" if provider == "anthropic" else "Hi")


def test_parity_leaves_blocks_open():
    d = Decoder("openai", parity=True)
    d.feed(OPENAI)
    assert (d.message["tool_calls"], d.message["stop_reason"]) == ([], "end_turn")


def test_batch_equals_stream(spark, tmp_path):
    rows = [(s, i, p, t[i * 40 : i * 40 + 40]) for s, p, t in (("a", "anthropic", ANTHROPIC), ("b", "openai", OPENAI)) for i in range(len(t) // 40 + 1)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, provider string, chunk string")
    order = ["stream_id", "n"]
    batch = [tuple(r) for r in streams.sse_events(df).orderBy(*order).collect()]
    for name, part in (("1", df.where("seq % 2 = 0")), ("2", df.where("seq % 2 = 1"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = streams.stream_events(read).writeStream.format("memory").queryName("events_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = [tuple(r) for r in spark.table("events_out").orderBy(*order).collect()]
    assert found == batch
    assert streams.messages(df).where("done").count() == 2


def test_providers_round_trip(spark):
    body = {
        "id": "m", "model": "x", "content": [{"type": "text", "text": "Hi"}, {"type": "tool_use", "id": "t", "name": "look", "input": {"a": 1}}, {"type": "image", "z": 1}],
        "stop_reason": "end_turn", "usage": {"input_tokens": "5", "output_tokens": 2, "cache_read_input_tokens": 1},
    }
    df = spark.createDataFrame([(json.dumps(body),), ('{"id":"m"}',)], "t string").select(providers.parse_anthropic(V.from_json(F.col("t"))).alias("r"))
    good, bad = df.collect()
    assert [b.kind for b in good.r.content] == ["text", "tool_use", "unknown"]
    assert (good.r.usage.input_tokens, good.r.usage.cache_read, good.r.usage.cache_creation, good.r.error) == (5, 1, None, None)
    assert (bad.r.error, bad.r.stop_reason) == ("model", "unknown:missing")
    for name, parse in (("openai", providers.parse_openai), ("ollama", providers.parse_ollama)):
        text = df.limit(1).select(providers.PROVIDERS[name].emit(F.col("r")).alias("t"))
        r = text.select(parse(V.from_json(F.col("t"))).alias("r")).first().r
        assert [b.kind for b in r.content] == ["text", "tool_use"] and r.content[1].input == '{"a":1}' and r.stop_reason == "end_turn"


def test_registry(spark):
    registry = HandlerRegistry()
    registry.register_sync("double", lambda v: v["n"] * 2)
    registry.register_sync("fail", lambda v: 1 / 0)

    async def later(v):
        return {"got": v}

    registry.register("later", later)
    assert registry.names() == ["double", "fail", "later"] and registry.has("later") and len(registry) == 3
    with pytest.raises(HandlerError):
        registry.dispatch_sync("later", {})
    body = {"id": "m", "model": "x", "content": [{"type": "tool_use", "id": n, "name": n, "input": {"n": 4}} for n in ("double", "fail", "later", "nobody")]}
    df = spark.createDataFrame([(1, json.dumps(body))], "k long, t string").select("k", providers.parse_anthropic(V.from_json(F.col("t"))).alias("r"))
    found = registry.apply(df, "r", "k", wait=True).orderBy("pos").collect()
    assert [r.result for r in found] == ["8", None, '{"got":{"n":4}}', None]
    assert found[1].error.startswith("ZeroDivisionError") and found[3].error is None


def test_merge_functions():
    assert merge.merged({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": None}) == {"a": {"b": 1, "d": 2}, "c": None}
    kinds = [(d[0], d[1], d[4]) for d in merge.differences({"a": [1], "b": 1, "c": 1}, {"a": 5, "b": 1, "c": 2, "z": 0})]
    assert kinds == [("a", "overridden", 1), ("c", "overridden", 0), ("z", "preserved", 0)]
    assert merge.assigned({"a": 1}, ("a", "b"), 5) == {"a": 1}
    assert merge.assigned(None, ("x", 2, "y"), 5) == {"x": [None, None, {"y": 5}]}


def test_files(spark, tmp_path):
    lines = tmp_path / "rows.jsonl"
    lines.write_text('{"a":1}\n\n  \n{"a":2}\n[3]\n')
    assert [(r.row_idx, r.j) for r in read_jsonl(spark, str(lines)).select("row_idx", F.to_json("doc").alias("j")).orderBy("row_idx").collect()] == [(0, '{"a":1}'), (1, '{"a":2}'), (2, "[3]")]
    lines.write_text('{"a":1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_jsonl(spark, str(lines)).collect()
    assert [r.doc is None for r in read_jsonl(spark, str(lines), strict=False).orderBy("row_idx").collect()] == [False, True]
    whole = tmp_path / "rows.json"
    whole.write_text('[{"a":1},{"a":"x"}]')
    assert read_json_rows(spark, str(whole)).count() == 2
    whole.write_text('{"a":1}')
    assert read_json_rows(spark, str(whole), single=True).count() == 1
    with pytest.raises(Exception, match="expected an array"):
        read_json_rows(spark, str(whole)).collect()
    df = rows_of(spark.range(3).withColumnRenamed("id", "n"))
    write_json(df, "doc", f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"n":0}', '{"n":1}', '{"n":2}']


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, price REAL, name TEXT, extra TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, i / 2, f"n{i}", '{"k":%d}' % i if i % 2 else "[oops") for i in range(2500)])
    source = SqliteSource(spark, path)
    assert source.columns("SELECT id, name FROM t") == ["id", "name"] and source.count("SELECT * FROM t") == 2500
    rows = source.query_with("SELECT * FROM t WHERE id < ? ORDER BY id", [3])
    assert [r[0] for r in rows.select(F.to_json("doc")).collect()][1] == '{"extra":{"k":1},"id":1,"name":"n1","price":0.5}'
    assert source.query("SELECT * FROM t").count() == 2500
    with pytest.raises(QueryFailed):
        source.query("SELECT nothing FROM t")
    with pytest.raises(ConnectionFailed):
        SqliteSource(spark, str(tmp_path / "none.db"))


def test_spark_source(spark):
    spark.range(5).createOrReplaceTempView("five")
    source = SparkSource(spark)
    assert source.count("SELECT * FROM five") == 5
    assert source.query_with("SELECT id FROM five WHERE id > ?", [2]).count() == 2


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "rows.json"
    path.write_text('[{"a":1,"b":"x"},{"a":"2"}]')
    assert "a " in cli.infer(spark, str(path), 1.0, "table")
    assert json.loads(cli.infer(spark, str(path), 1.0, "json"))["total_records"] == 2
    schema = tmp_path / "schema.json"
    schema.write_text('{"fields":{"b":{"type":"string","required":true}}}')
    assert "MissingRequired" in cli.audit(spark, str(path), str(schema), 1.0, True)
    assert cli.inspect(spark, str(path), "[1].a", "int") == "2"
    assert cli.inspect(spark, str(path), "[0].b", None) == '"x"'


def test_streams_go_to_python_in_batches(spark):
    """A stream over several batches is one message; null keys, chunks and orders have their places; no data frame is made for a stream."""
    line = 'data: {"choices":[{"delta":{"content":"%s"}}]}\n\n'
    rows = [(k, s, "openai", line % f"{k}{s}") for k in ("a", "b", None) for s in (2, 0, 1)] + [("a", None, "openai", line % "z"), ("b", 3, "openai", None), ("e", 0, "openai", "")]
    df = spark.createDataFrame(rows, "stream_id string, seq long, provider string, chunk string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = streams.messages(df)
        assert {(r["stream_id"], r["text"], r["done"]) for r in found.collect()} == {("a", "a0a1a2z", False), ("b", "b0b1b2", False), (None, "None0None1None2", False), ("e", "", False)}
        numbered = {(r["stream_id"], r["n"], r["text"]) for r in streams.sse_events(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert ("a", 3, "z") in numbered and len(numbered) == 10
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
