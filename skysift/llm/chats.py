"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join by identifier. Calls are put into topological order by rounds of joins:
a call is one level above the deepest call it depends on, whatever the size of its conversation. Arguments are
checked against the JSON schema of the tool, and each call is written as JSON with sorted keys.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import Kept, in_batches, keep

#: The rows of ``link`` and ``messages``.
LINKED = "conv_id string, call_id string, position long, level int, status string, copies long, n_results long, errors array<string>, json string"
TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key occurs twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def parse(text: str) -> object:
    """A JSON value; repeated keys, NaN and infinities are errors."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def _number(value: float) -> str:
    """The shortest digits that give the number back: plain from 10^-6 to below 10^21, else with an exponent."""
    if not math.isfinite(value):
        raise ValueError("a number is too large")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    shown, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 0:
        text = "0." + "0" * -point + shown
    elif 0 < point < len(shown):
        text = f"{shown[:point]}.{shown[point:]}"
    else:
        text = f"{shown[0]}{'.' * (len(shown) > 1)}{shown[1:]}e{point - 1:+d}"
    return "-" * sign + text


def canonical(value: object) -> str:
    """JSON without white space, keys sorted by UTF-16 units, numbers with a point or exponent as ``_number`` writes them.

    Integers keep all their digits.
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool) and kind != "boolean":
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES.get(kind, object))


#: What the value of a keyword must be; one of another kind is an error of the schema and checks nothing.
KEYWORDS = {
    "type": lambda x: isinstance(x, str) or isinstance(x, list) and all(isinstance(k, str) for k in x),
    "enum": lambda x: isinstance(x, list),
    "required": lambda x: isinstance(x, list) and all(isinstance(k, str) for k in x),
    "properties": lambda x: isinstance(x, dict),
    "additionalProperties": lambda x: isinstance(x, (bool, dict)),
    "items": lambda x: isinstance(x, (bool, dict)),
    **{k: lambda x: _is(x, "number") for k in ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems")},
}


def violations(value: object, schema: object, at: str = "$") -> list[str]:
    """What speaks against a value: its place and the keyword of the schema, in the order of the schema's rules.

    Known keywords: type, enum, const, minimum, maximum, minLength, maxLength, required, properties,
    additionalProperties, items, minItems, maxItems. Others are ignored. The schema ``true`` allows every value and
    ``false`` none; what is neither that nor an object, or a keyword of a wrong kind, is reported as ``bad schema``
    or ``bad <keyword>`` and nothing is checked by it.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    if not isinstance(schema, dict):
        return [f"{at}: bad schema"]
    bad = [k for k, fits in KEYWORDS.items() if k in schema and not fits(schema[k])]
    schema = {k: v for k, v in schema.items() if k not in bad}
    found = [f"{at}: bad {k}" for k in bad]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*found, f"{at}: type"]
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        found.append(f"{at}: enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: const")
    size = (
        ("Length", len(value)) if isinstance(value, str)
        else ("Items", len(value)) if isinstance(value, list)
        else ("imum", value) if isinstance(value, (int, float)) and not isinstance(value, bool)
        else None
    )
    if size:
        least, most = f"min{size[0]}", f"max{size[0]}"
        if least in schema and size[1] < schema[least]:
            found.append(f"{at}: {least}")
        if most in schema and size[1] > schema[most]:
            found.append(f"{at}: {most}")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for key in sorted(value):
            if key in known:
                found += violations(value[key], known[key], f"{at}.{key}")
            elif others is False:
                found.append(f"{at}.{key}: additionalProperties")
            elif others is not True:
                found += violations(value[key], others, f"{at}.{key}")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            found += violations(item, schema["items"], f"{at}[{k}]")
    return found


def _read(text: str) -> tuple[object, str | None]:
    """A JSON value whose canonical form can be written, or what is wrong with it.

    A half of a surrogate pair has no UTF-8, so a text that holds one is no JSON here.
    """
    try:
        value = parse(text)
        canonical(value).encode()
    except (ValueError, RecursionError) as problem:
        return None, f"not JSON ({type(problem).__name__})"
    return value, None


@lru_cache(maxsize=1000)
def _schema(text: str) -> tuple[object, str | None]:
    return _read(text)


def check(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """The parsed arguments and what speaks against them; a call without arguments has an empty object.

    Null arguments with one entry in the list were no JSON (the arguments ``null`` never have that entry). A schema
    that is no JSON is reported as ``$: schema not JSON`` and checks nothing.
    """
    value, problem = _read(arguments) if arguments is not None else ({}, None)
    if problem:
        return None, [f"$: {problem}"]
    if schema is None:
        return value, ["$: unknown tool"]
    rules, problem = _schema(schema)
    try:
        return value, [f"$: schema {problem}"] if problem else violations(value, rules)
    except RecursionError:
        return value, ["$: schema too deep"]


def _chains(single: DataFrame, longest: int) -> DataFrame:
    """(conv_id, call_id, at, steps): the first call before a chain of calls with one dependency each.

    ``single`` has (conv_id, call_id, needs). Pointers are doubled, so the number of rounds is the logarithm of the
    longest chain; it is at most that of ``longest``, the number of calls of a conversation, and what points into
    the chain then still is on a cycle or behind one, and has no row.
    """
    now = keep(single.select("conv_id", "call_id", F.col("needs").alias("at"), F.lit(1).cast("long").alias("steps")), "chains")
    reach = 1
    while True:
        ahead = now.df.select(
            F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("at").alias("next"), F.col("steps").alias("more")
        )
        met = now.df.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("i")), "left")
        after = keep(
            met.select("conv_id", "call_id", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("i").isNotNull().alias("moved")),
            "chains",
        )
        now.drop()
        if reach > longest or not after.df.where("moved").head(1):
            return after.df.where("not moved").drop("moved")
        now, reach = Kept(after.df.drop("moved"), after.path), 2 * reach


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that depend on no other known call, else one above the deepest.

    ``calls`` has (conv_id, call_id, depends_on); a pair names one call. Calls on a cycle, and those that
    depend on one, have no row. Chains of calls with one dependency are followed by doubling; calls with
    several get their level in rounds, one for each level of such calls. Every round handles all
    conversations at once, keyed by conversation and call, and is written to the shared folder.
    """
    ids = ["conv_id", "call_id"]
    edges = calls.select(*ids, F.explode("depends_on").alias("needs")).distinct()
    target = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    edges = edges.join(target, (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("i")), "left_semi")
    degrees = edges.groupBy(*ids).agg(F.count("*").alias("n"))
    edges = keep(edges.join(degrees, ids), "edges").df
    longest = edges.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    single, several = edges.where("n = 1").drop("n"), edges.where("n > 1").drop("n")
    chains = _chains(single, longest)
    leveled = calls.select(*ids).join(edges.select(*ids), ids, "left_anti").withColumn("level", F.lit(0).cast("long"))
    # A dependency in a chain stands for the call before the chain, so many steps above it; on a cycle for none.
    ahead = chains.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "at", "steps")
    cyclic = single.join(chains, ids, "left_anti").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    met = (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("i"))
    stuck = several.join(cyclic, met, "left_semi").select(*ids).distinct()
    left = several.join(ahead, met, "left").select(*ids, F.coalesce("at", "needs").alias("at"), F.coalesce("steps", F.lit(0)).alias("steps"))
    left = keep(left.join(stuck, ids, "left_anti"), "edges").df
    while left.head(1):
        known = leveled.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "level")
        weighed = left.join(known, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("i")), "left").groupBy(*ids)
        ready = weighed.agg(
            (F.max(F.col("level") + F.col("steps")) + 1).alias("level"), F.count("*").alias("n"), F.count("level").alias("found")
        )
        ready = keep(ready.where("n = found").select(*ids, "level"), "levels").df
        if not ready.head(1):
            break
        leveled = leveled.union(ready)
        left = keep(left.join(ready.select(*ids), ids, "left_anti"), "edges").df
    leveled = keep(leveled, "levels").df
    above = leveled.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "level")
    inside = chains.join(above, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("i")))
    return leveled.union(inside.select(*ids, (F.col("level") + F.col("steps")).alias("level")))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: identifier, order, status, violations and canonical JSON.

    ``calls``: conv_id, call_id, position, name, arguments (JSON), depends_on (identifiers of calls of the same
    conversation); ``results``: conv_id, call_id, position, content; ``tools``: name, schema (JSON).

    * Of calls, and of results, with one identifier the first by position counts; ``copies`` and ``n_results``
      tell how many there are. Rows without conversation or identifier are never linked; each is kept by itself.
    * status: ``linked``, ``unanswered``, ``orphan`` (a result without a call), ``cycle`` (no order exists),
      ``unidentified``.
    * The order within a conversation is (level, position); level is null for cycles, orphans and unidentified rows.
    * errors: what speaks against the arguments, and ``depends_on: unknown`` for identifiers of no call.
    * json: the call with its result, null if its arguments are not JSON. Empty tables give no rows.
    * Arguments or schemas that are no JSON, hold half a surrogate pair, are nested too deeply or break the rules of
      schemas give entries of ``errors``, as ``check`` and ``violations`` say; no row ends the job.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("position", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    ids = ["conv_id", "call_id"]
    asked = calls.where(named).groupBy(*ids).agg(F.min(body).alias("call"), F.count("*").alias("copies"))
    asked = keep(asked.select(*ids, "call.*", "copies"), "calls").df
    given = results.where(named).groupBy(*ids).agg(
        F.min(F.struct(F.col("position").alias("result_position"), "content")).alias("result"), F.count("*").alias("n_results")
    )
    given = given.select(*ids, F.col("result.content").alias("content"), "result.result_position", "n_results")
    order = keep(levels(asked).withColumnRenamed("level", "depth"), "levels").df
    target = asked.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    unknown = (
        asked.select(*ids, F.explode("depends_on").alias("needs"))
        .join(target, (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("i")), "left_anti")
        .groupBy(*ids)
        .agg(F.count("*").alias("unknown"))
    )
    linked = asked.join(given, ids, "full_outer").join(order, ids, "left").join(unknown, ids, "left")
    status = (
        F.when(F.col("copies").isNull(), "orphan")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
    )
    linked = linked.select(
        *ids, F.coalesce("position", "result_position").alias("position"), F.col("depth").alias("level"), "name", "arguments",
        "depends_on", "content", F.coalesce("unknown", F.lit(0)).alias("unknown"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"),
    )
    none: Column = F.lit(None)
    lone_calls = calls.where(~named).select(
        *ids, "position", none.cast("int"), "name", "arguments", "depends_on", none.cast("string"), F.lit(0).cast("long"),
        F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit("unidentified"),
    )
    lone_results = results.where(~named).select(
        *ids, "position", none.cast("int"), none.cast("string"), none.cast("string"), none.cast("array<string>"), "content",
        F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit("unidentified"),
    )
    every = linked.union(lone_calls).union(lone_results)
    schemas = tools.groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("schema"))
    every = every.join(schemas, F.col("name") == F.col("tool"), "left")
    names = ["conv_id", "call_id", "position", "level", "status", "copies", "n_results"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for r in batch.select(["call_id", "name", "arguments", "depends_on", "content", "unknown", "copies", "schema"]).to_pylist():
                called = r["copies"] > 0
                value, found = check(r["arguments"], r["schema"]) if called else ({}, [])
                errors.append(found + ["depends_on: unknown"] * (r["unknown"] > 0))
                whole = {"id": r["call_id"], "result": r["content"]}
                if called:
                    whole |= {"name": r["name"], "arguments": value, "depends_on": r["depends_on"] or []}
                try:
                    text = None if any(e.startswith("$: not JSON") for e in found) else canonical(whole)
                except RecursionError:
                    text = None
                    errors[-1].insert(0, "$: not JSON (RecursionError)")
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                [*names, "errors", "json"],
            )

    given = every.select(
        F.col("conv_id").cast("string").alias("conv_id"), "call_id", F.col("position").cast("long").alias("position"),
        F.col("level").cast("int").alias("level"), "status", F.col("copies").cast("long").alias("copies"),
        F.col("n_results").cast("long").alias("n_results"), "name", "arguments", "depends_on", "content", "unknown", "schema",
    )
    return in_batches(given, run, LINKED)


#: Schemas of the calls that ``from_turns`` makes.
TURN_TOOLS = (
    ("open", {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
              "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000},
                             "turn": {"type": "integer", "minimum": 0, "maximum": 1}}}),
    ("follow", {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
                "properties": {"text": {"type": "string", "minLength": 20, "maxLength": 300},
                               "turn": {"type": "integer", "minimum": 2}}}),
)


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools of a table of plain turns (conv_id, turn, role, text).

    A user's turn calls ``open`` (turns 0 and 1) or ``follow``, which depends on the user's turn two before; an
    assistant's turn is the result of the call made by the turn before it. Identifiers hold the turn's number.
    Turns of other roles, or of none, are neither; ``messages`` keeps them.
    """
    spark = turns.sparkSession
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    turn = F.col("turn")
    calls = turns.where("role = 'user'").select(
        "conv_id", name(turn).alias("call_id"), turn.alias("position"),
        F.when(turn < 2, "open").otherwise("follow").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    tools = spark.createDataFrame([(n, json.dumps(s)) for n, s in TURN_TOOLS], "name string, schema string")
    return calls, results, tools


def messages(turns: DataFrame) -> DataFrame:
    """A row, like those of ``link``, for each turn that is neither a user's nor an assistant's.

    status: ``message`` for turns of the system and of any other role, ``unidentified`` for those without a role.
    They are no calls: call_id and level are null, copies and n_results 0. json holds role, text and turn.
    """
    rest = turns.where("role is null or role not in ('user', 'assistant')")
    names = ["conv_id", "call_id", "position", "level", "status", "copies", "n_results"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [canonical(r) for r in batch.select(["role", "text", "turn"]).to_pylist()]
            errors = pa.array([[]] * len(texts), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), errors, pa.array(texts, pa.string())], [*names, "errors", "json"])

    given = rest.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.lit(None).cast("string").alias("call_id"), F.col("turn").cast("long").alias("position"),
        F.lit(None).cast("int").alias("level"), F.when(F.col("role").isNull(), "unidentified").otherwise("message").alias("status"),
        F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_results"), "role", "text", "turn",
    )
    return in_batches(given, run, LINKED)


def linked_turns(turns: DataFrame) -> DataFrame:
    """Every turn: calls with their results as in ``link``, and the turns of other roles as in ``messages``.

    Each turn is counted once: in ``copies``, in ``n_results``, or as a row in which both are 0.
    """
    return link(*from_turns(turns)).union(messages(turns))
