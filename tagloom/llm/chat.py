"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Column expressions, joins and aggregates only.  Calls and results meet in a hash join on the call's identifier.  A call
may name another one that it comes after; its level is one more than that call's, found by doubling: each round replaces
a pointer by the pointer's pointer and adds up the steps, so chains take a logarithmic number of rounds.  Calls on a cycle
never reach an end; they are marked and come last.  The order within a conversation is by level, then turn, taken from a
global range sort, so a conversation of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordinal import row_index
from ..runtime import materialise

#: Tools by name: for each argument its type (string or integer), whether it must be there, and the largest length or value.
SCHEMAS: dict[str, dict[str, tuple[str, bool, int]]] = {
    "lookup": {"query": ("string", True, 64), "first": ("integer", False, 1000)},
    "measure": {"chars": ("integer", True, 1500), "words": ("integer", True, 250), "text": ("string", False, 2000)},
    "quote": {"text": ("string", True, 2000)},
}


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``calls(conv_id, turn, call_id, after, name, arguments)`` and ``results(conv_id, turn, call_id, content)``.

    The conversations hold no tool traffic of their own.  Every user turn is read as a call, the assistant turn after it
    as the result.  The tool depends on the length of the text, which its arguments hold whole; a call comes after the one
at half its turn.  Turns of other roles are in ``context_messages``.
    """
    text = F.coalesce("text", F.lit(""))
    chars = F.length(text)
    identify = lambda turn: F.md5(F.concat_ws(":", F.col("conv_id"), turn))
    words = F.size(F.filter(F.split(text, "[ \n]"), lambda w: w != ""))
    name = F.element_at(F.array(*map(F.lit, SCHEMAS)), (chars % 3 + 1).cast("int"))
    arguments = F.when(chars % 3 == 0, F.to_json(F.struct(text.alias("query"), chars.alias("first")))).when(
        chars % 3 == 1, F.to_json(F.struct(chars.alias("chars"), words.alias("words"), text.alias("text")))).otherwise(F.to_json(F.struct(text.alias("text"))))
    half = F.col("turn") - 2 * F.ceil(F.col("turn") / 4)
    kept = conversations.filter("conv_id is not null and turn is not null")
    calls = kept.filter("role = 'user'").select("conv_id", "turn", identify(F.col("turn")).alias("call_id"), F.when(F.col("turn") >= 2, identify(half)).alias("after"), name.alias("name"), arguments.alias("arguments"))
    results = kept.filter("role = 'assistant'").select("conv_id", "turn", identify(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results


def context_messages(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, call_id, role, content)`` of the turns that are neither calls nor results, such as system turns.

    Exact copies of a turn share an identifier.
    """
    text = F.coalesce("text", F.lit(""))
    others = conversations.filter("conv_id is not null and turn is not null and coalesce(role, '') not in ('user', 'assistant')")
    identity = F.md5(F.concat_ws(":", "conv_id", "turn", F.coalesce("role", F.lit("")), text))
    return others.select("conv_id", "turn", identity.alias("call_id"), "role", text.alias("content"))


def levels(calls: DataFrame) -> DataFrame:
    """``(call_id, level)``: 0 for calls that come after nothing known, null for calls on or behind a cycle."""
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("known"))
    pointed = calls.select("call_id", "after").join(known, "after", "left")
    first = F.when(F.col("known"), F.col("after"))
    state = materialise(pointed.select("call_id", first.alias("after"), F.when(first.isNotNull(), 1).otherwise(0).cast("long").alias("level")), "levels")
    for _ in range(calls.count().bit_length() + 1):  # what still points somewhere then is on a cycle or behind one
        if not state.filter("after is not null").limit(1).count():
            break
        ahead = state.select(F.col("call_id").alias("after"), F.col("after").alias("next"), F.col("level").alias("more"))
        joined = state.join(ahead, "after", "left")
        state = materialise(joined.select("call_id", F.col("next").alias("after"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return state.select("call_id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def _faults(name: Column, parsed: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool, int]]]) -> Column:
    """Sorted list of what is wrong with a call's arguments."""
    kind_of = lambda v: F.schema_of_variant(v)
    is_object = F.coalesce(kind_of(parsed).startswith("OBJECT"), F.lit(False))
    object_ = F.when(is_object, parsed)
    checks = [F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")), F.when(~is_object, F.lit("no object"))]
    for tool, fields in schemas.items():
        here = is_object & (name == tool)
        for field, (kind, required, most) in sorted(fields.items()):
            value = F.try_variant_get(object_, f"$.{field}", "variant")
            there = value.isNotNull() & (kind_of(value) != "VOID")
            if required:
                checks.append(F.when(here & ~F.coalesce(there, F.lit(False)), F.lit(f"{field} missing")))
            if kind == "integer":
                right = kind_of(value) == "BIGINT"
                over = F.try_variant_get(object_, f"$.{field}", "long") > most
                checks.append(F.when(here & there & ~right, F.lit(f"{field} no integer")))
                checks.append(F.when(here & there & right & over, F.lit(f"{field} too large")))
            else:
                right = kind_of(value) == "STRING"
                over = F.length(F.try_variant_get(object_, f"$.{field}", "string")) > most
                checks.append(F.when(here & there & ~right, F.lit(f"{field} no string")))
                checks.append(F.when(here & there & right & over, F.lit(f"{field} too long")))
        keys = F.map_keys(F.try_variant_get(object_, "$", "map<string,variant>"))
        checks.append(F.when(here & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0), F.lit("unknown argument")))
    return F.array_sort(F.array_compact(F.array(*checks)))


def format_tool_chat(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool, int]]] = SCHEMAS, context: DataFrame | None = None) -> DataFrame:
    """``(conv_id, turn, call_id, level, position, linked, valid, faults, message)`` of every call and context message.

    A call with several results takes the one of the first turn, then the smallest text; a repeated call the smallest
    turn, then name and arguments.  A call without result is not linked and its result is null; results of no call are
    left out.  Calls on a cycle have no level and come last.  Null or malformed arguments are no object; a variant's JSON has its keys sorted and no white space.  Calls without conversation
    or id are left out.  Context messages have level 0, are not linked and have no faults; of copies with the same id one
stays.  Empty tables give no rows.  Other columns are ignored.
    """
    asked = calls.filter("call_id is not null and conv_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "conv_id", "name", "arguments", "after")).alias("c")).select("call_id", "c.*")
    asked = materialise(asked, "calls")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r")).select("call_id", F.col("r.content").alias("content"), F.lit(True).alias("linked"))
    placed = asked.join(levels(asked), "call_id", "left").join(answers, "call_id", "left")
    placed = placed.withColumn("parsed", F.try_parse_json("arguments"))
    faults = _faults(F.col("name"), F.col("parsed"), schemas)
    body = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    message = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")), F.lit(","), F.substring(body, 2, 2147483647))
    built = placed.select("conv_id", "turn", "call_id", "level", F.coalesce("linked", F.lit(False)).alias("linked"), F.array_join(faults, "; ").alias("faults"), message.alias("message"))
    if context is not None:
        said = F.to_json(F.struct("content", F.col("call_id").alias("id"), "role"), {"ignoreNullFields": "false"})
        built = built.unionByName(context.dropDuplicates(["call_id"]).select(
            "conv_id", "turn", "call_id", F.lit(0).cast("long").alias("level"), F.lit(False).alias("linked"), F.lit("").alias("faults"), said.alias("message")))
    built = materialise(built, "messages")
    index = row_index(built.select("call_id", "conv_id", "level", "turn"), ["conv_id", F.col("level").asc_nulls_last(), "turn", "call_id"], key="call_id")
    numbered = built.join(index.select("call_id", "row_index"), "call_id")
    first = numbered.groupBy("conv_id").agg(F.min("row_index").alias("first"))
    return numbered.join(first, "conv_id").select(
        "conv_id", "turn", "call_id", "level", (F.col("row_index") - F.col("first")).alias("position"), "linked", (F.col("faults") == "").alias("valid"), "faults", "message")
