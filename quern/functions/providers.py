"""Responses of model providers in one shape, and back.

Parsed: STRUCT<id, model, content, stop_reason, usage, raw, error>. A block of `content` is STRUCT<kind, text, id, name, input,
block_type, data>, kind one of text, tool_use, unknown; input, data and raw are JSON texts. A body without a part that its
provider always sends has NULLs and the part's path in `error`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import variants as V
from quern.functions.coerce import coerce
from quern.functions.lookup import lookup
from quern.functions.text import let

BLOCK = "struct<kind:string,text:string,id:string,name:string,input:string,block_type:string,data:string>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read:bigint,cache_creation:bigint>"
#: Reasons to stop by provider.
ANTHROPIC_STOPS = {"end_turn": "end_turn", "tool_use": "tool_use", "max_tokens": "max_tokens", "stop_sequence": "stop_sequence"}
OPENAI_STOPS = {"stop": "end_turn", "tool_calls": "tool_use", "length": "max_tokens", "stop_sequence": "stop_sequence"}
OLLAMA_STOPS = {"stop": "end_turn", "length": "max_tokens"}


def _text_of(v: Column) -> Column:
    """A value as text, as coercion at its loosest has it."""

    def other(k: Column) -> Column:
        return F.when(k == "float", V.number_text(v)).when(k == "null", F.lit("")).when(k.isNotNull(), F.to_json(v))

    return F.coalesce(V.string(v), let(V.kind(v), other))


def _parts(v: Column, *names: str) -> Column:
    """An object's fields, each a value or NULL, read in one go; a text that holds an object is parsed."""
    kind = "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">"
    return F.coalesce(F.try_variant_get(v, "$", kind), F.try_variant_get(V.parsed(v), "$", kind))


def _counts(*values: Column) -> Column:
    """Numbers, coerced by one expression."""
    return F.transform(F.array(*values), lambda v: F.when(v.isNotNull(), coerce(v, "u64")["value"].cast("bigint")))


def _block(kind: str, **parts: Column) -> Column:
    names = ("text", "id", "name", "input", "block_type", "data")
    return F.struct(F.lit(kind).alias("kind"), *(parts.get(n, F.lit(None)).cast("string").alias(n) for n in names)).cast(BLOCK)


def _stop(value: Column, names: dict[str, str], missing: str, null: str) -> Column:
    """A provider's reason in ours; `unknown:` and the text, or why there is none."""
    known = lambda t: F.coalesce(lookup(names, t), F.concat(F.lit("unknown:"), t))
    return F.when(value.isNull(), F.lit(f"unknown:{missing}")).when(F.is_variant_null(value), F.lit(f"unknown:{null}")).otherwise(let(_text_of(value), known))


def _response(id_: Column, model: Column, content: Column, stop: Column, usage: Column, raw: Column, message: Column | None = None) -> Column:
    """The struct; `message` is a part that must be there besides the identifier and the model."""
    required = F.struct(id_.alias("id"), model.alias("model"), (F.lit(True) if message is None else message.isNotNull()).alias("message"))

    def one(x: Column) -> Column:
        n = lambda i: F.get(x["usage"], F.lit(i))
        zero = F.lit(0).cast("bigint")
        counts = F.struct(F.coalesce(n(0), zero).alias("input_tokens"), F.coalesce(n(1), zero).alias("output_tokens"), n(2).alias("cache_read"), n(3).alias("cache_creation"))
        error = F.when(x["r"]["id"].isNull(), "id").when(x["r"]["model"].isNull(), "model").when(~x["r"]["message"], "choices[0].message")
        return F.struct(
            x["r"]["id"].alias("id"), x["r"]["model"].alias("model"), F.filter(x["content"], lambda b: b.isNotNull()).alias("content"), x["stop"].alias("stop_reason"),
            counts.alias("usage"), x["raw"].alias("raw"), error.alias("error"),
        )

    return let(F.struct(required.alias("r"), content.alias("content"), stop.alias("stop"), usage.alias("usage"), F.to_json(raw).alias("raw")), one)


def parse_anthropic(body: Column) -> Column:
    def block(b: Column) -> Column:
        read = lambda p: let(F.struct(p.alias("p"), _text_of(p["type"]).alias("kind")), lambda x: one(b, x["p"], x["kind"]))
        return let(_parts(b, "type", "text", "id", "name", "input"), read)

    def one(b: Column, p: Column, kind: Column) -> Column:
        return (
            F.when(kind == "text", _block("text", text=_text_of(p["text"])))
            .when(kind == "tool_use", _block("tool_use", id=_text_of(p["id"]), name=_text_of(p["name"]), input=F.to_json(p["input"])))
            .otherwise(_block("unknown", block_type=kind, data=F.to_json(b)))
        )

    def whole(x: Column) -> Column:
        r, u = x["r"], x["u"]
        usage = _counts(*(u[k] for k in counted))
        return _response(_text_of(r["id"]), _text_of(r["model"]), F.transform(V.elements(r["content"]), block), _stop(r["stop_reason"], ANTHROPIC_STOPS, "missing", "null"), usage, body)

    counted = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    root = _parts(body, "id", "model", "content", "stop_reason", "usage")
    return let(root, lambda r: let(F.struct(r.alias("r"), _parts(r["usage"], *counted).alias("u")), whole))


def _arguments(value: Column) -> Column:
    """Arguments sent as text are parsed; text that isn't JSON is kept."""
    return F.to_json(F.coalesce(V.from_json(V.string(value)), value))


def _text_block(text: Column) -> Column:
    return F.when(text != "", _block("text", text=text))


def parse_openai(body: Column) -> Column:
    def call(c: Column) -> Column:
        made = lambda x: _block("tool_use", id=_text_of(x["id"]), name=_text_of(x["f"]["name"]), input=_arguments(x["f"]["arguments"]))
        return let(_parts(c, "id", "function"), lambda p: let(F.struct(p["id"].alias("id"), _parts(p["function"], "name", "arguments").alias("f")), made))

    def whole(x: Column) -> Column:
        r, u, c, m = x["r"], x["u"], x["c"], x["m"]
        content = F.concat(F.array(let(_text_of(m["content"]), _text_block)), F.transform(V.elements(m["tool_calls"]), call))
        usage = _counts(u["prompt_tokens"], u["completion_tokens"])
        return _response(_text_of(r["id"]), _text_of(r["model"]), content, _stop(c["finish_reason"], OPENAI_STOPS, "missing", "null"), usage, body, c["message"])

    def message(x: Column) -> Column:
        return let(F.struct(x["r"].alias("r"), x["u"].alias("u"), x["c"].alias("c"), _parts(x["c"]["message"], "content", "tool_calls").alias("m")), whole)

    def choice(r: Column) -> Column:
        first = _parts(F.get(V.elements(r["choices"]), F.lit(0)), "message", "finish_reason")
        return let(F.struct(r.alias("r"), _parts(r["usage"], "prompt_tokens", "completion_tokens").alias("u"), first.alias("c")), message)

    return let(_parts(body, "id", "model", "choices", "usage"), choice)


def parse_ollama(body: Column) -> Column:
    def call(c: Column) -> Column:
        made = lambda x: _block("tool_use", id=F.concat(F.lit("ollama_"), x["n"]), name=x["n"], input=F.coalesce(F.to_json(x["a"]), F.lit("{}")))
        return let(_parts(V.at(c, "function"), "name", "arguments"), lambda f: let(F.struct(_text_of(f["name"]).alias("n"), f["arguments"].alias("a")), made))

    def whole(x: Column) -> Column:
        r, m = x["r"], x["m"]
        content = F.concat(F.array(let(_text_of(m["content"]), _text_block)), F.transform(V.elements(m["tool_calls"]), call))
        made = F.when(~F.is_variant_null(r["created_at"]), _text_of(r["created_at"]))
        stop = _stop(r["done_reason"], OLLAMA_STOPS, "unknown", "unknown")
        return _response(F.coalesce(made, F.lit("ollama")), _text_of(r["model"]), content, stop, _counts(r["prompt_eval_count"], r["eval_count"]), body)

    root = _parts(body, "model", "created_at", "message", "done_reason", "prompt_eval_count", "eval_count")
    return let(root, lambda r: let(F.struct(r.alias("r"), _parts(r["message"], "content", "tool_calls").alias("m")), whole))


def text(response: Column) -> Column:
    """All text of a response, in order."""
    blocks = F.filter(response["content"], lambda b: b["kind"] == "text")
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "")


def tool_uses(response: Column) -> Column:
    return F.filter(response["content"], lambda b: b["kind"] == "tool_use")


def has_tool_use(response: Column) -> Column:
    return F.exists(response["content"], lambda b: b["kind"] == "tool_use")


def _reason(response: Column, names: dict[str, str], other: str | None = None) -> Column:
    back = {ours: theirs for theirs, ours in names.items()}
    rest = F.lit(other) if other else F.regexp_replace(response["stop_reason"], "^unknown:", "")
    return F.coalesce(lookup(back, response["stop_reason"]), rest)


def _json(c: Column) -> Column:
    """A JSON text as a value inside another."""
    return F.try_parse_json(c)


def emit_anthropic(response: Column) -> Column:
    """The provider's JSON text."""

    def block(b: Column) -> Column:
        made = (
            F.when(b["kind"] == "text", F.to_json(F.struct(F.lit("text").alias("type"), b["text"].alias("text"))))
            .when(b["kind"] == "tool_use", F.to_json(F.struct(F.lit("tool_use").alias("type"), b["id"].alias("id"), b["name"].alias("name"), _json(b["input"]).alias("input"))))
            .otherwise(F.to_json(F.struct(b["block_type"].alias("type"), _json(b["data"]).alias("data"))))
        )
        return _json(made)

    u = response["usage"]
    usage = F.struct(u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"), u["cache_read"].alias("cache_read_input_tokens"), u["cache_creation"].alias("cache_creation_input_tokens"))
    return F.to_json(F.struct(
        response["id"].alias("id"), F.lit("message").alias("type"), response["model"].alias("model"), F.transform(response["content"], block).alias("content"),
        _reason(response, ANTHROPIC_STOPS).alias("stop_reason"), usage.alias("usage"),
    ))


def emit_openai(response: Column) -> Column:
    def call(b: Column) -> Column:
        value = _json(b["input"])
        arguments = F.when(V.is_string(value), V.string(value)).otherwise(b["input"])
        return F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), arguments.alias("arguments")).alias("function"))

    calls = F.transform(tool_uses(response), call)
    content = F.when(text(response) != "", F.to_variant_object(F.array(text(response)))).otherwise(F.lit(None))
    message = F.struct(
        F.lit("assistant").alias("role"),
        F.coalesce(F.try_variant_get(content, "$[0]", "variant"), F.parse_json(F.lit("null"))).alias("content"),
        F.when(F.size(calls) > 0, calls).alias("tool_calls"),
    )
    u = response["usage"]
    usage = F.struct(u["input_tokens"].alias("prompt_tokens"), u["output_tokens"].alias("completion_tokens"), (u["input_tokens"] + u["output_tokens"]).alias("total_tokens"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), _reason(response, OPENAI_STOPS).alias("finish_reason"))
    return F.to_json(F.struct(response["id"].alias("id"), F.lit("chat.completion").alias("object"), response["model"].alias("model"), F.array(choice).alias("choices"), usage.alias("usage")))


def emit_ollama(response: Column) -> Column:
    calls = F.transform(tool_uses(response), lambda b: F.struct(F.struct(b["name"].alias("name"), _json(b["input"]).alias("arguments")).alias("function")))
    message = F.struct(F.lit("assistant").alias("role"), text(response).alias("content"), F.when(F.size(calls) > 0, calls).alias("tool_calls"))
    u = response["usage"]
    reason = F.when(response["stop_reason"] == "max_tokens", "length").otherwise("stop")
    return F.to_json(F.struct(
        response["model"].alias("model"), message.alias("message"), F.lit(True).alias("done"), reason.alias("done_reason"),
        u["input_tokens"].alias("prompt_eval_count"), u["output_tokens"].alias("eval_count"),
    ))


@dataclass(frozen=True)
class Provider:
    """A provider's two directions; streams are decoded by its name."""

    name: str
    parse: Callable[[Column], Column]
    emit: Callable[[Column], Column]


PROVIDERS = {p.name: p for p in (Provider("anthropic", parse_anthropic, emit_anthropic), Provider("openai", parse_openai, emit_openai), Provider("ollama", parse_ollama, emit_ollama))}
