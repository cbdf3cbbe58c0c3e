"""Conversations with tool calls: pairing, repair, token budgets, calls written as markup."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_id(conv: Column, turn: Column, pos: Column) -> Column:
    """Deterministic id of a tool call that came without one."""
    return F.concat(F.lit("call_"), F.left(F.sha2(F.concat_ws(":", conv, turn, pos), 256), F.lit(16)))


def calls(messages: DataFrame) -> DataFrame:
    """Tool calls of messages (conv_id, turn, tool_calls array<struct<id,name>>): one row each.

    ``conv_id``, ``turn``, ``pos``, ``id`` (made up where empty), ``name``.
    """
    flat = messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("pos", "call"))
    made = call_id(F.col("conv_id"), F.col("turn"), F.col("pos"))
    return flat.select(
        "conv_id", "turn", "pos", F.coalesce(F.when(F.col("call.id") != "", F.col("call.id")), made).alias("id"), F.col("call.name").alias("name")
    )


def replies(messages: DataFrame) -> DataFrame:
    """Tool messages with the call they answer: ``conv_id``, ``turn``, ``tool_call_id``, ``name``.

    A message with an id answers that call; one without takes the calls of the last
    assistant message before it in their order, first in first out.  Messages with
    an unknown id, and more of them than calls, are orphans named ``tool``.
    """
    asked = calls(messages)
    ordered = Window.partitionBy("conv_id").orderBy("turn")
    tools = messages.withColumn(
        "_last", F.last(F.when(F.size(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string>>"))) > 0, F.col("turn")), ignorenulls=True).over(ordered)
    ).where("role = 'tool'")
    known = asked.select(
        F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), F.col("name").alias("_name")
    ).dropDuplicates(["_conv", "_id"])
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("tool_call_id") == F.col("_id"))
    named = tools.join(known, same, "left").drop("_conv")
    nameless = F.coalesce("tool_call_id", F.lit("")) == ""
    direct = named.where(~nameless)
    orphans = named.where(nameless).drop("_id", "_name")
    nth_call = Window.partitionBy("conv_id", "turn").orderBy("pos")
    nth_orphan = Window.partitionBy("conv_id", "_last").orderBy("turn")
    queue = asked.withColumn("_n", F.row_number().over(nth_call)).select(
        "conv_id", F.col("turn").alias("_last"), "_n", F.col("id").alias("_id"), F.col("name").alias("_name")
    )
    matched = orphans.withColumn("_n", F.row_number().over(nth_orphan)).join(queue, ["conv_id", "_last", "_n"], "left")
    columns = ("conv_id", "turn", F.coalesce("_id", "tool_call_id").alias("tool_call_id"), F.coalesce("_name", F.lit("tool")).alias("name"))
    return direct.select(*columns).unionByName(matched.select(*columns))


def reports(rows: DataFrame, *group: str, order: str, text: str, most: int | None = None) -> DataFrame:
    """Texts of each group in order, joined by blank lines: ``report``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")
    return rows.groupBy(*group).agg((joined if most is None else F.substring(joined, 1, most)).alias("report"))


def budget(steps: DataFrame, conv: str, order: str, tokens: str, most: int) -> DataFrame:
    """Steps with the tokens used before them and whether they may still run (0: no limit)."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    return steps.withColumn("used_before", used.cast("long")).withColumn("allowed", F.lit(most == 0) | (F.col("used_before") < most))


def usage(messages: DataFrame, conv: str, tokens: str, total: str) -> DataFrame:
    """Tokens of each conversation: the sum over messages or, if that is 0, the stated total."""
    own = F.sum(F.coalesce(tokens, F.lit(0)))
    return messages.groupBy(conv).agg(F.when(own > 0, own).otherwise(F.coalesce(F.max(total), F.lit(0))).cast("long").alias("tokens"))


#: What begins and ends a block of calls, in its clean and its corrupted form.
_OPEN = re.compile(r"<minimax:tool_call>|\]<\]minimax\[>\[", re.I)
_CLOSE = re.compile(r"</minimax:tool_call>|\]<\]/minimax\[>\[", re.I)
_TAGS = re.compile(r"<(invoke|parameter)\s+name=\"([^\"]+)\"\s*>|</(invoke|parameter)>", re.I)
_DIRECT = re.compile(r"<(\w+)>")
_THOUGHT = re.compile(r"</?mm:think>", re.I)
_CALL = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType()))])
)


def _blocks(text: str) -> list[tuple[int, int, str]]:
    """Blocks of calls: where each begins and ends, and what is in it; one without an end goes to the end."""
    out, at = [], 0
    while opening := _OPEN.search(text, at):
        closing = _CLOSE.search(text, opening.end())
        at = closing.end() if closing else len(text)
        out.append((opening.start(), at, text[opening.end() : closing.start() if closing else at]))
    return out


def _value(raw: str) -> str:
    """An argument as text; JSON that is no string stays JSON.  A closing tag that was cut off goes."""
    raw = re.sub(r"</\w*$", "", raw).strip()
    try:
        decoded = json.loads(raw)
    except ValueError:
        return raw
    return decoded if isinstance(decoded, str) else json.dumps(decoded, ensure_ascii=False)


def _direct(body: str) -> dict[str, str]:
    """Arguments written as tags of their own; one without its end goes on to the end."""
    args: dict[str, str] = {}
    at = 0
    while opening := _DIRECT.search(body, at):
        ending = f"</{opening[1]}>"
        end = body.find(ending, opening.end())
        args[opening[1]] = _value(body[opening.end() : end if end >= 0 else len(body)])
        if end < 0:
            break
        at = end + len(ending)
    return args


def markup_calls(text: str | None) -> list[dict]:
    """Tool calls in the blocks of a text, tolerant of missing ends; values stay text or JSON.

    Calls outside a block are prose.  The tags of a block are read in order: one that
    opens ends what is open on its level.
    """
    out: list[dict] = []
    for _, _, block in _blocks(text or ""):
        call = name = None
        plain = start = 0  # where the call's body and the open argument begin

        def finish(end: int, call=None, name=None, start=0, plain=0) -> None:
            if call is None:
                return
            if name is not None:
                call["args"][name] = _value(block[start:end])
            elif not call["args"]:
                call["args"] = _direct(block[plain:end])

        for tag in _TAGS.finditer(block):
            kind = (tag[1] or tag[3]).lower()
            if kind == "invoke":
                finish(tag.start(), call, name, start, plain)
                call = name = None
                if tag[1]:
                    call, plain = {"name": tag[2], "args": {}}, tag.end()
                    out.append(call)
            elif call is not None:
                if name is not None:
                    call["args"][name] = _value(block[start : tag.start()])
                name, start = (tag[2], tag.end()) if tag[1] else (None, 0)
        finish(len(block), call, name, start, plain)
    return out


def without_calls(text: str) -> str:
    """A text without its blocks of calls and, if it had one, without marks of thought."""
    found = _blocks(text)
    if not found:
        return text
    for begin, end, _ in reversed(found):
        text = text[:begin] + text[end:]
    return _THOUGHT.sub("", text).strip()


@F.arrow_udf(_CALL)
def parsed_calls(texts: pa.Array) -> pa.Array:
    """Column of the tool calls in a text (see :func:`markup_calls`)."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("args", pa.map_(pa.string(), pa.string()))]))
    return pa.array([[{"name": c["name"], "args": list(c["args"].items())} for c in markup_calls(t)] for t in texts.to_pylist()], kind)


#: Kinds of content blocks that a model of text can't read.
BINARY_KINDS = ("file", "image", "image_url", "input_file", "document", "media", "audio")
HINT = "[binary content removed; read the file's text instead]"


def text_blocks(blocks: Column | str) -> Column:
    """Content blocks (array of struct with type and text) without binary ones.

    If something was removed and no text is left, a hint takes its place.
    """
    blocks = F.col(blocks) if isinstance(blocks, str) else blocks
    kept = F.filter(blocks, lambda b: ~b["type"].isin(*BINARY_KINDS))
    hint = F.array(F.struct(F.lit("text").alias("type"), F.lit(HINT).alias("text")))
    bare = (F.size(kept) < F.size(blocks)) & ~F.exists(kept, lambda b: b["type"] == "text")
    return F.when(bare, F.concat(kept, hint)).otherwise(kept)


def trace(messages: DataFrame, most: int = 6000) -> DataFrame:
    """One line for each tool step of a conversation, in order: ``conv_id``, ``trace``.

    ``messages`` needs ``content``; calls without a reply have an empty output.
    """
    asked = calls(messages).select("conv_id", "turn", "pos", "id", "name")
    answers = replies(messages).join(messages.select("conv_id", "turn", "content"), ["conv_id", "turn"])
    outputs = answers.groupBy("conv_id", F.col("tool_call_id").alias("id")).agg(F.min_by("content", "turn").alias("_out"))
    known = asked.join(outputs, ["conv_id", "id"], "left").select("conv_id", "turn", "pos", "name", "_out")
    orphans = answers.where("name = 'tool'").select("conv_id", "turn", F.lit(0).alias("pos"), "name", F.col("content").alias("_out"))
    steps = known.unionByName(orphans)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    shown = F.regexp_replace(F.substring(F.coalesce("_out", F.lit("")), 1, 120), "\n", " ")
    lines = steps.select("conv_id", nth.alias("_n"), F.concat(F.lit("["), nth, F.lit("] "), "name", F.lit(" → "), shown).alias("_l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)
    return lines.groupBy("conv_id").agg(cut.alias("trace"))


class BudgetExceeded(RuntimeError):
    """No tokens are left for another call of the model."""


class GuardedModel:
    """A model of text behind the steps that each call takes, in this order: the budget is
    checked, binary blocks go, ids are filled in, the model is called (once more after an error
    about a call's id), tokens are counted, and calls written as markup are read.

    Messages are dicts with ``role``, ``content`` (text or blocks), ``tool_calls`` (dicts with ``id``, ``name``,
    ``args``) and ``tool_call_id``; ``model(messages)`` gives one more, with ``tokens`` if known.
    ``budget`` 0 sets no limit.
    """

    def __init__(self, model: Callable[[list[dict]], dict], budget: int = 0, conv: str = ""):
        self.model, self.budget, self.conv, self.used, self.turn = model, budget, conv, 0, 0

    def __call__(self, messages: list[dict]) -> dict:
        if self.budget and self.used >= self.budget:
            raise BudgetExceeded(f"{self.used} of {self.budget} tokens used")
        sent = self.filled([self.readable(m) for m in messages])
        try:
            answer = self.model(sent)
        except ValueError as e:
            if "tool call id" not in str(e).lower():
                raise
            answer = self.model(self.filled(sent))
        self.turn += 1
        self.used += int(answer.get("tokens") or 0)
        answer = dict(answer)
        content = answer.get("content")
        if isinstance(content, str):
            answer["tool_calls"] = [*(answer.get("tool_calls") or []), *markup_calls(content)]
            answer["content"] = without_calls(content)
        return self.filled([answer])[0]

    @staticmethod
    def readable(message: dict) -> dict:
        """A message without binary blocks; a hint stands for them if no text is left."""
        blocks = message.get("content")
        if not isinstance(blocks, list):
            return message
        binary = lambda b: isinstance(b, dict) and (b.get("type") in BINARY_KINDS or {"base64", "file_data", "image_url"} & b.keys())
        kept = [b for b in blocks if not binary(b)]
        if len(kept) < len(blocks) and not any(isinstance(b, dict) and b.get("type") == "text" for b in kept):
            kept.append({"type": "text", "text": HINT})
        return message | {"content": kept}

    def filled(self, messages: list[dict]) -> list[dict]:
        """Messages with ids: calls without one get one, answers without one take the last calls' in turn."""
        out, waiting = [], []
        for n, message in enumerate(messages):
            if message.get("tool_calls"):
                calls = [c | {"id": c.get("id") or self.new_id(n, k)} for k, c in enumerate(message["tool_calls"])]
                message, waiting = message | {"tool_calls": calls}, [c["id"] for c in calls]
            elif message.get("role") == "tool" and not message.get("tool_call_id") and waiting:
                message = message | {"tool_call_id": waiting.pop(0)}
            out.append(message)
        return out

    def new_id(self, message: int, pos: int) -> str:
        mark = f"{self.conv}:{self.turn}:{message}:{pos}"
        return "call_" + hashlib.sha256(mark.encode()).hexdigest()[:16]
