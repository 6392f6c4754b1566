"""Chat formatting with tool-call linking.

A turn's text is plain, or JSON: an object with `tool_calls` (a list of id, name, arguments) makes calls, one with
`tool_call_id` is a result. Results are joined with calls by (conversation, identifier). Parts are ordered topologically:
a result follows its call, and a call whose arguments hold {"$ref": id} follows that call's result. Arguments are validated
against a JSON schema for each tool. Every part becomes one line of canonical JSON (sorted keys, no blanks, no NaN).

One row for each part comes back, with its place as sort columns; a conversation is never gathered in one task, so one
conversation may hold any share of the rows. Calls are peeled: a call whose references are all placed is placed behind them.
Only calls that refer or are referred to take part, as numbers. Conversations with up to GROUP of these are peeled in one task
each; larger ones by joins, a step for each link of the longest chain. What can never be peeled is on or behind a cycle.

Nulls and edges: a null or empty text is a plain part with empty content; a null role is `user`. Broken JSON, JSON of another
form, and JSON with numbers that JSON doesn't know or nesting beyond DEPTH are plain. Lone surrogates become U+FFFD. Null
conversation ids and identifiers link to nothing. Of calls that repeat an identifier the first by turn, part and content
counts, others are `duplicate`; a result without call is `orphan`, a call without result `unanswered`, a call that fails its
schema or whose tool has none `invalid`, and calls on or behind a cycle of references, with their results, `cycle`. A
reference to no call of the conversation holds nothing up. Repeated rows and ties come back each. Very long texts are one
part. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, written

PARTS = (
    "conv_id long, turn long, part int, role string, kind string, call_id string, name string, error string, refs array<string>, "
    "body string"
)
#: Deeper JSON is plain text.
DEPTH = 200
#: Calls and references (some 100 bytes each in Python) of a conversation that one task peels.
GROUP = 200_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _refuse(text: str):
    raise ValueError(f"{text} isn't JSON")


def loaded(text: str):
    """The value of a JSON text. ValueError: broken, deeper than DEPTH, or with numbers that JSON cannot hold."""
    depth = deepest = 0
    quoted = escaped = False
    for c in text if text.count("[") + text.count("{") > DEPTH else "":
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    if deepest > DEPTH:
        raise ValueError("too deep")

    def finite(number: str) -> float:
        value = float(number)
        return value if math.isfinite(value) else _refuse(number)

    return json.loads(text, parse_constant=_refuse, parse_float=finite)  # int() itself refuses integers of thousands of digits


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return clean(text)


def clean(text: str) -> str:
    """Lone surrogates cannot be written as UTF-8."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def same(a, b) -> bool:
    """Equal as JSON: true isn't 1."""
    return canonical(a) == canonical(b)


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def violation(value, schema: dict, where: str = "$") -> str | None:
    """The first way in which the value fails the schema: type, enum, required, properties, additionalProperties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{where}: not {'/'.join(kinds)}"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"{where}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{where}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if found := violation(value[k], known[k], f"{where}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{where}.{k}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            if found := violation(v, schema["items"], f"{where}[{k}]"):
                return found
    return None


def references(value) -> set[str]:
    if isinstance(value, dict):
        own = {clean(value["$ref"])} if isinstance(value.get("$ref"), str) else set()
        return own.union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _text_or_none(value) -> str | None:
    return clean(value) if isinstance(value, str) else None


def read_turn(role: str | None, text: str | None, schemas: dict[str, dict] | None) -> list[tuple]:
    """(role, kind, call_id, name, error, refs, body) of each part; body is canonical JSON. schemas None: nothing is validated."""
    role, text = clean(role or "user"), text or ""
    value = None
    if text.lstrip()[:1] == "{":
        try:
            value = loaded(text)
        except (ValueError, RecursionError):
            value = None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list) and all(isinstance(c, dict) for c in value["tool_calls"]):
        parts = []
        if isinstance(value.get("content"), str) and value["content"]:
            parts.append((role, "message", None, None, None, [], canonical({"content": value["content"], "role": role})))
        for call in value["tool_calls"]:
            call = call | call["function"] if isinstance(call.get("function"), dict) else call
            name, args, error = _text_or_none(call.get("name")), call.get("arguments", {}), None
            if isinstance(args, str):
                try:
                    args = loaded(args)
                except (ValueError, RecursionError):
                    error = "$: not JSON"
            if error is None and schemas is not None:
                error = violation(args, schemas[name]) if name in schemas else "unknown tool"
            own = _text_or_none(call.get("id"))
            body = canonical({"role": role, "tool_call": {"arguments": args, "id": own, "name": name}})
            parts.append((role, "call", own, name, error and clean(error), sorted(references(args)), body))
        return parts or [(role, "message", None, None, None, [], canonical({"content": "", "role": role}))]
    if isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        own = clean(value["tool_call_id"])
        return [("tool", "result", own, None, None, [], canonical({"content": value.get("content"), "role": "tool", "tool_call_id": own}))]
    return [(role, "message", None, None, None, [], canonical({"content": text, "role": role}))]


def parts(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    names = [c.split()[0] for c in PARTS.split(", ")]

    def read(batches):
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in batch), strict=True):
                for k, part in enumerate(read_turn(role, text, schemas)):
                    out.append((conv, turn, k, *part))
            yield pd.DataFrame(out, columns=names)

    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return conversations.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).mapInPandas(read, PARTS)


def peeled(turns: list[int], results: list[int | None], wants: list[list[int]]) -> list[tuple[int, int] | None]:
    """(place, depth) of each call, None on or behind a cycle. wants: the numbers of the calls that each refers to.

    A result stands at the later of its own turn and its call's place, and whoever refers to the call behind that.
    """
    users: list[list[int]] = [[] for _ in turns]
    for k, refs in enumerate(wants):
        for r in refs:
            users[r].append(k)
    left, placed = [len(refs) for refs in wants], [None] * len(turns)
    ready = [k for k, n in enumerate(left) if not n]
    while ready:
        k = ready.pop()
        at, depth = turns[k], 0
        for r in wants[k]:
            before, deep = placed[r]
            at, depth = max(at, before, before if results[r] is None else results[r]), max(depth, deep + 2)
        placed[k] = (at, depth)
        for user in users[k]:
            left[user] -= 1
            if not left[user]:
                ready.append(user)
    return placed


PLACES = "conv_id long, h long, at long, depth long"


def _peel_each(batches):
    """Peels rows (conv_id, h, call_turn, result_turn, refs) that come conversation by conversation, one held at a time."""
    held: list[tuple] = []

    def told():
        number = {row[1]: k for k, row in enumerate(held)}
        wants = [[number[r] for r in row[4] or ()] for row in held]
        placed = [p or (None, None) for p in peeled([row[2] for row in held], [row[3] for row in held], wants)]
        out.extend((row[0], row[1], *p) for row, p in zip(held, placed, strict=True))
        held.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in PLACES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4, names)

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                told()
            held.append(row)
        yield batch_of(out)
    out = []
    told()
    yield batch_of(out)


def _peel_steps(calls: DataFrame) -> DataFrame:
    """The same by joins, for conversations of any size."""
    spark, key = calls.sparkSession, ["conv_id", "h"]
    wait = written(calls.select(*key, F.explode("refs").alias("ref")))
    # for calls that wait: the latest end and greatest depth of what was placed before them
    seen = spark.createDataFrame([], "conv_id long, h long, end long, deep long")
    new = written(calls.where("refs IS NULL").select(*key, "result_turn", F.col("call_turn").alias("at"), F.lit(0).cast("long").alias("depth")))
    out = spark.createDataFrame([], "conv_id long, h long, at long, depth long")
    while not new.isEmpty():
        out = out.union(new.select(*key, "at", "depth"))
        ends = new.select("conv_id", F.col("h").alias("ref"), F.greatest("at", F.coalesce("result_turn", "at")).alias("end"), (F.col("depth") + 2).alias("deep"))
        hit = wait.join(ends, ["conv_id", "ref"]).select(*key, "end", "deep")
        reached = written(seen.union(hit).groupBy(*key).agg(F.max("end").alias("end"), F.max("deep").alias("deep")), replaces=seen)
        wait = written(wait.join(ends, ["conv_id", "ref"], "left_anti").select(*key, "ref"), replaces=wait)
        free = reached.join(wait.select(*key).distinct(), key, "left_anti").join(calls, key)
        new = written(free.select(*key, "result_turn", F.greatest("call_turn", "end").alias("at"), F.col("deep").alias("depth")))
        seen = written(reached.join(new.select(*key), key, "left_anti"), replaces=reached)
    return checkpointed(out)


def _placed(calls: DataFrame, group: int) -> DataFrame:
    """conv_id, h, at, depth of calls that refer or are referred to; at is null on or behind a cycle. calls: with refs."""
    key = ["conv_id", "h"]
    wants = calls.select(*key, F.explode(F.array_distinct(F.transform("refs", lambda r: F.xxhash64(r)))).alias("ref"))
    # references to no call of the conversation hold nothing up
    wants = checkpointed(wants.join(calls.select("conv_id", F.col("h").alias("ref")), ["conv_id", "ref"]).select(*key, "ref"))
    grouped = wants.groupBy(*key).agg(F.collect_list("ref").alias("refs"))  # as many as one text holds
    users = wants.select("conv_id", F.col("ref").alias("h")).distinct().withColumn("used", F.lit(True))
    tangled = calls.drop("refs").join(grouped, key, "left").join(users, key, "left").where("refs IS NOT NULL OR used")
    tangled = checkpointed(tangled.select(*key, "call_turn", "result_turn", "refs"))
    sizes = tangled.groupBy("conv_id").agg(F.sum(1 + F.coalesce(F.size("refs"), F.lit(0))).alias("size"))
    large = checkpointed(sizes.where(F.col("size") > group).select("conv_id"))
    small = tangled.join(large, "conv_id", "left_anti")
    out = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_peel_each, PLACES)
    if large.isEmpty():
        return out
    steps = checkpointed(tangled.join(large, "conv_id", "left_semi"))
    return out.union(steps.select(*key).join(_peel_steps(steps), key, "left"))


def link(found: DataFrame, group: int = GROUP) -> DataFrame:
    """Adds status, at_turn and depth; (conv_id, at_turn, depth, turn, part) orders the parts topologically."""
    key = ["conv_id", "h"]
    found = found.withColumn("h", F.when(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), F.xxhash64("call_id")))
    own = F.coalesce("turn", F.lit(0).cast("long"))
    first = F.min(F.struct("turn", "part", "body", "error", "refs"))
    calls = found.where("kind = 'call' AND h IS NOT NULL").groupBy(*key).agg(first.alias("c"))
    calls = calls.select(*key, F.coalesce("c.turn", F.lit(0).cast("long")).alias("call_turn"), F.col("c.turn").alias("first_turn"), F.col("c.part").alias("first_part"), F.xxhash64("c.body").alias("first_b"), "c.refs")
    results = found.where("kind = 'result' AND h IS NOT NULL").groupBy(*key).agg(F.min(own).alias("result_turn"))
    calls = checkpointed(calls.join(results, key, "left"))
    placed = _placed(calls, group).withColumn("tangled", F.lit(True))
    calls = calls.drop("refs").join(placed, key, "left").withColumn("cycle", F.coalesce("tangled", F.lit(False)) & F.col("at").isNull())
    calls = calls.withColumns({"at": F.coalesce("at", "call_turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))}).drop("tangled")

    # read anew, so that the join has a shuffle on either side and a hot key can be split
    joined = found.drop("refs").join(checkpointed(calls), key, "left")
    is_first = F.col("first_turn").eqNullSafe(F.col("turn")) & F.col("first_part").eqNullSafe(F.col("part")) & (F.col("first_b") == F.xxhash64("body"))
    call, failed, known = F.col("kind") == "call", F.col("error").isNotNull(), F.col("at").isNotNull()
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when((F.col("kind") == "result") & ~known, "orphan")
        .when(call & known & ~is_first, "duplicate")
        .when(F.coalesce("cycle", F.lit(False)), "cycle")
        .when(failed, "invalid")
        .when(call & F.col("result_turn").isNull(), "unanswered")
        .otherwise("linked")
    )
    linked = known & (F.col("kind") != "message")
    depth = F.when(linked & call, F.col("depth")).when(linked, F.col("depth") + 1).otherwise(0)
    return joined.select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "name", "error", status.alias("status"),
        F.when(linked, F.greatest(own, "at")).otherwise(own).alias("at_turn"), depth.cast("int").alias("depth"), "body",
    )


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None, group: int = GROUP) -> DataFrame:
    """schemas: a JSON schema for each tool; None validates nothing, calls of tools without a schema are invalid."""
    return link(parts(conversations, schemas), group)
