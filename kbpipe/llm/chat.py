"""Chat formatting: tool calls linked with their results.

Messages carry JSON: an assistant message ``{"tool_calls": [{"id", "name",
"arguments"}, ...]}``, a tool message ``{"tool_call_id", "content"}``. An
argument ``{"$ref": id}`` stands for the result of another call. The calls of
one message are ordered topologically (one message, one row: a bounded
group); across messages the turns order them, and a reference to a later
turn can't be served. Calls and results meet in a hash join on
(conversation, identifier), so a conversation with a third of all rows is
spread over its identifiers.
"""

from __future__ import annotations

import json
import math
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map, texts


def _reject(name: str):
    raise ValueError(f"not JSON: {name}")


def parse(raw: bytes):
    """Strict JSON value, or ValueError (also for one nested too deep)."""
    try:
        return json.loads(raw, parse_constant=_reject)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, integral floats as integers,
    all characters as themselves. ValueError for what no UTF-8 text can hold:
    numbers out of range and lone surrogates."""
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def _unicode(v) -> bool:
    """Whether ``v`` is a string without lone surrogates."""
    return isinstance(v, str) and not any("\ud800" <= c <= "\udfff" for c in v)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _plain(v):
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("number out of range")
        return int(v) if v == int(v) and abs(v) < 2 ** 53 else v
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: _number(v) and math.isfinite(v) and v == int(v),
    "number": _number,
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def _is_ref(v) -> bool:
    return isinstance(v, dict) and set(v) == {"$ref"} and isinstance(v["$ref"], str)


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema`` (type, enum, required, properties,
    additionalProperties, items, minimum, maximum); a reference to another
    call's result fits anything."""
    if _is_ref(value):
        return []
    if "type" in schema and not _TYPES[schema["type"]](value):
        return [f"{path}: not {schema['type']}"]
    out = []
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "minimum" in schema and _number(value) and value < schema["minimum"]:
        out.append(f"{path}: below minimum")
    if "maximum" in schema and _number(value) and value > schema["maximum"]:
        out.append(f"{path}: above maximum")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in props:
                out += violations(value[k], props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{path}[{i}]")
    return out


def _same(a, b) -> bool:
    """JSON equality: 1 and 1.0 are equal, 1 and true are not."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def references(value) -> list[str]:
    """Identifiers that arguments refer to, in order of appearance."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if _is_ref(v):
            out.append(v["$ref"])
        elif isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
    return list(dict.fromkeys(out))


def topological(ids: list[str], needs: list[list[str]]) -> tuple[list[int], set[int]]:
    """(order, cyclic): positions so that each comes after what it needs,
    ties by position; those on or behind a cycle follow at the end."""
    where: dict[str, int] = {}
    for i, x in enumerate(ids):
        where.setdefault(x, i)
    after: list[list[int]] = [[] for _ in ids]
    open_ = [0] * len(ids)
    for i, refs in enumerate(needs):
        for r in refs:
            if r in where:
                after[where[r]].append(i)
                open_[i] += 1
    ready = [i for i, n in enumerate(open_) if not n]
    heapify(ready)
    order = []
    while ready:
        i = heappop(ready)
        order.append(i)
        for j in after[i]:
            open_[j] -= 1
            if not open_[j]:
                heappush(ready, j)
    cyclic = set(range(len(ids))) - set(order)
    return order + sorted(cyclic), cyclic


def calls_of(raw: bytes, schemas: dict[str, dict]) -> list[dict]:
    """Calls of one assistant message in topological order."""
    try:
        message = parse(raw)
    except ValueError:
        return []
    found = message.get("tool_calls") if isinstance(message, dict) else None
    rows = []
    for c in found if isinstance(found, list) else ():
        c = c if isinstance(c, dict) else {}
        call_id, name, args = c.get("id"), c.get("name"), c.get("arguments")
        problems = [f"{what}: not Unicode" for what, v in (("id", call_id), ("name", name))
                    if isinstance(v, str) and not _unicode(v)]
        call_id = call_id if _unicode(call_id) else None
        name = name if _unicode(name) else None
        if isinstance(args, str):       # arguments are often a JSON string themselves
            try:
                args = parse(args.encode())      # a lone surrogate is a ValueError here too
            except ValueError:
                problems.append("$: not JSON")
                args = None
        if call_id is None:
            problems.append("id: missing")
        if name not in schemas:
            problems.append("name: unknown tool")
        elif not problems:
            problems += violations(args, schemas[name])
        try:
            text = canonical(args)
        except (ValueError, RecursionError):
            text, args = None, None
            problems.append("$: not serialisable")
        rows.append({"call_id": call_id, "name": name, "arguments": text, "refs": references(args),
                     "problems": [p.encode(errors="replace").decode() for p in problems]})
    order, cyclic = topological([r["call_id"] or "" for r in rows],
                                [[x for x in r["refs"] if x] for r in rows])
    for i in cyclic:
        rows[i]["problems"].append("refs: cycle")
    return [rows[i] | {"pos": n} for n, i in enumerate(order)]


CALLS = ("conv_id bigint, turn bigint, pos int, call_id string, name string, arguments string, "
         "refs array<string>, problems array<string>")
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def extract_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k.strip().split(" ")[0]: [] for k in CALLS.split(", ")}
        for conv, turn, raw in zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(),
                                   texts(batch, "text")):
            for c in calls_of(raw, schemas):
                for k, v in (c | {"conv_id": conv, "turn": turn}).items():
                    out[k].append(v)
        return out

    return arrow_map(messages.where(F.col("role") == "assistant").select("conv_id", "turn", "text"), run, CALLS)


def extract_results(messages: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {"conv_id": [], "turn": [], "call_id": [], "content": []}
        for conv, turn, raw in zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(),
                                   texts(batch, "text")):
            try:
                m = parse(raw)
                if isinstance(m, dict) and _unicode(m.get("tool_call_id")):
                    content = canonical(m.get("content"))
                    for k, v in zip(out, (conv, turn, m["tool_call_id"], content)):
                        out[k].append(v)
            except (ValueError, RecursionError):
                pass
        return out

    return arrow_map(messages.where(F.col("role") == "tool").select("conv_id", "turn", "text"), run, RESULTS)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call: ``conv_id, turn, pos,
    call_id, name, status, problems, result_turn, line, more_results``.

    ``turn, pos`` order the calls of a conversation so that each follows what
    it refers to. ``status``: ``ok``; ``invalid`` (``problems`` says why: a
    missing id, an unknown tool, arguments against the schema, a cycle);
    ``duplicate`` (the identifier is used before in the turn, or in the
    conversation and no result follows this use);
    ``unresolved`` (a reference without an earlier result); ``unanswered``
    (no result at or after the call); ``orphan`` (a result without a call).
    ``line`` is the canonical JSON of the linked pair.

    Defined cases: text that isn't JSON, NULL and empty texts hold nothing,
    nor does a result whose id or content isn't Unicode text or holds a number
    out of range; a message of any length is one row, parsed whole;
    NULL conversations and turns link like values (a NULL turn comes first);
    a result belongs to the latest turn at or before it that uses its
    identifier; of several results of one call, the earliest counts (ties: the
    smallest content) and ``more_results`` (turn, content) holds the others in
    the same order; a reference is served by any earlier result of its
    identifier; repeated rows are duplicates; other columns are
    ignored; empty tables give empty tables.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    calls = scratch.write(extract_calls(messages, schemas).select(
        "*", key.alias("ck"), at.alias("ct"), F.monotonically_increasing_id().alias("uid")))
    results = scratch.write(extract_results(messages).select("*", key.alias("ck"), at.alias("rt")))
    # the first call of a turn that uses an identifier owns the results from
    # there until a later turn uses it again
    owners = calls.where("call_id is not null").groupBy("ck", "call_id", "ct").agg(
        F.min(F.struct("pos", "uid"))["uid"].alias("own_uid"))
    events = owners.select("ck", "call_id", F.col("ct").alias("at"), "own_uid", F.lit(False).alias("is_result")) \
        .unionByName(results.select("ck", "call_id", F.col("rt").alias("at"), F.lit(True).alias("is_result"), "conv_id",
                                    "turn", "content"), allowMissingColumns=True)
    w = Window.partitionBy("ck", "call_id").orderBy("at", "is_result")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = events.withColumns({
        "owner": F.last("own_uid", ignorenulls=True).over(so_far),
        "own_ct": F.last(F.when(~F.col("is_result"), F.col("at")), ignorenulls=True).over(so_far),
        "first_ct": F.first(F.when(~F.col("is_result"), F.col("at")), ignorenulls=True).over(so_far)})
    # results before any use have no owner
    answers = tagged.groupBy("ck", "call_id", "owner", "own_ct", "first_ct").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_result"), F.struct(
            F.col("at").alias("rt"), "content", "turn")))).alias("answers"), F.max("conv_id").alias("conv_id"))
    answers = scratch.write(answers.select(
        "conv_id", "ck", "call_id", F.col("owner").alias("own_uid"), "own_ct",
        (F.col("own_ct") == F.col("first_ct")).alias("first"), F.get("answers", F.lit(0)).alias("ans"),
        F.transform(F.expr("slice(answers, 2, size(answers))"),
                    lambda a: F.struct(a["turn"], a["content"])).alias("more")))
    # a reference is served by a result of an earlier turn, or by a call of the
    # same message that has a result
    answered = answers.where("own_uid is not null and ans is not null").select(
        "ck", F.col("call_id").alias("ref"), "own_ct", "ans.rt")
    refs = calls.select("uid", "ck", "ct", F.explode("refs").alias("ref"))
    served = refs.join(answered.groupBy("ck", "ref").agg(F.min("rt").alias("rt")), ["ck", "ref"], "left").join(
        answered.select("ck", "ref", F.col("own_ct").alias("ct"), F.lit(True).alias("here")), ["ck", "ref", "ct"], "left")
    unresolved = served.groupBy("uid").agg(F.max(~(
        F.coalesce(F.col("rt") <= F.col("ct"), F.lit(False)) | F.coalesce("here", F.lit(False)))).alias("open"))
    linked = (calls.join(answers.select(F.col("own_uid").alias("uid"), "first", "ans", "more"), "uid", "left")
              .join(unresolved, "uid", "left"))
    unused = F.col("first").isNull() | (~F.col("first") & F.col("ans").isNull())
    status = (F.when(F.size("problems") > 0, "invalid").when(unused, "duplicate")
              .when(F.coalesce("open", F.lit(False)), "unresolved")
              .when(F.col("ans").isNull(), "unanswered").otherwise("ok"))
    none = F.expr("cast(array() as array<struct<turn: bigint, content: string>>)")
    rows = linked.select(
        "conv_id", "turn", "pos", "call_id", "name", status.alias("status"), "problems",
        F.col("ans.turn").alias("result_turn"), "arguments", F.col("ans.content").alias("content"),
        F.coalesce("more", none).alias("more_results"))
    orphans = answers.where("own_uid is null").select("conv_id", "call_id", F.explode(F.concat(
        F.array(F.struct("ans.turn", "ans.content")), "more")).alias("ans")).select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("int").alias("pos"), "call_id",
        F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"),
        F.expr("cast(array() as array<string>)").alias("problems"), F.col("ans.turn").alias("result_turn"),
        F.lit(None).cast("string").alias("arguments"), F.col("ans.content").alias("content"),
        none.alias("more_results"))
    both = rows.unionByName(orphans)
    # keys in alphabetical order; the parts are canonical JSON already
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")),
        F.lit(',"id":'), _json_string("call_id"), F.lit(',"name":'), _json_string("name"),
        F.lit(',"result":'), F.coalesce("content", F.lit("null")), F.lit("}"))
    return both.select("conv_id", "turn", "pos", "call_id", "name", "status", "problems", "result_turn",
                       line.alias("line"), "more_results")


def _json_string(col: str):
    """A JSON string literal of a column (null where it is NULL)."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(col).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(F.col(col).isNull(), "null").otherwise(quoted)
