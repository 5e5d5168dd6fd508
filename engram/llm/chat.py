"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON, natively."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import discard, materialise

#: JSON Schema type -> what schema_of_variant says of such a value.
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical_json(text: Column) -> Column:
    """JSON with keys in order and no blanks outside strings; null if text is null or isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(arguments: Column, schema: Mapping) -> Column:
    """Array of errors of a JSON object against {"properties": {name: {"type": t}}, "required": [..], "additionalProperties": bool}."""
    value = F.try_parse_json(arguments)
    of = lambda k: F.schema_of_variant(F.try_variant_get(value, "$['" + k.replace("'", "\\'") + "']", "variant"))
    checks = [F.when(F.coalesce(of(k), F.lit("VOID")) == "VOID", F.lit(f"missing {k}")) for k in schema.get("required", [])]
    for k, p in schema.get("properties", {}).items():
        checks.append(F.when((of(k) != "VOID") & ~of(k).rlike(f"^{VARIANT_TYPES[p['type']]}$"), F.lit(f"type of {k}")))
    if not schema.get("additionalProperties", True):
        names = F.map_keys(F.from_json(arguments, "map<string,string>"))
        extra = F.array_sort(F.array_except(names, F.array(*[F.lit(k) for k in schema.get("properties", {})])))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(extra, ","))))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("not an object"))).otherwise(F.filter(F.array(*checks, F.lit(None).cast("string")), lambda x: x.isNotNull()))


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Messages (conv_id, turn, role, content, call_id, call_name, call_args, result_of, needs), one row each, linked.

    call_id, call_name, call_args: the tool call that a message makes, if any. result_of: the id of the call that it
    answers. needs: ids of calls of whose results this call makes use, also of calls that aren't there (array, may be null; the column may be absent).

    Returns conv_id, turn, role and
    - link: "answered" or "unanswered" of calls, "linked" or "orphan" of results, else "none". Calls and results meet in
      a hash join on conversation and identifier. If an identifier is repeated, the call with the smallest turn counts.
    - depth: the longest chain of calls and results before it; (depth, turn) is a topological order of a conversation.
      Messages of a cycle, or after one, get null.
    - valid, errors: whether a call's arguments fit the schema of its name; a name without a schema is an error. null for others.
    - message_json: canonical JSON of the message: keys in order, arguments canonical, null parts left out.

    Null conversation, turn or identifier links with nothing. Repeated rows stay rows. Empty table: empty. No group of
    messages is gathered, and only messages with an identifier are joined: a conversation of any length stays spread over tasks.
    Chains of any length are followed. Other columns are left out.
    """
    if "needs" not in messages.columns:
        messages = messages.withColumn("needs", F.lit(None).cast("array<string>"))
    messages = messages.select("conv_id", "turn", "role", "content", "call_id", "call_name", "call_args", "result_of", "needs")
    calls = messages.where("call_id IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    answers = messages.where("result_of IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", F.col("result_of").alias("call_id")).agg(F.min("turn").alias("result_turn"))
    tools = messages.where("call_id IS NOT NULL OR result_of IS NOT NULL")
    linked = tools.where("result_of IS NULL").withColumn("call_turn", F.lit(None).cast(messages.schema["turn"].dataType))
    linked = linked.unionByName(tools.where("result_of IS NOT NULL").join(calls.withColumnRenamed("call_id", "result_of"), ["conv_id", "result_of"], "left"))
    unasked = linked.where("call_id IS NULL").withColumn("result_turn", F.lit(None).cast(messages.schema["turn"].dataType))
    linked = unasked.unionByName(linked.where("call_id IS NOT NULL").join(answers, ["conv_id", "call_id"], "left"))
    depths = _depths(_edges(tools, calls, answers))
    linked = linked.join(depths, ["conv_id", "turn"], "left").withColumn("depth", F.when(F.col("known").isNull(), 0).otherwise(F.col("depth"))).drop("known")
    plain = messages.where("call_id IS NULL AND result_of IS NULL").withColumns({"call_turn": F.lit(None).cast("long"), "result_turn": F.lit(None).cast("long"), "depth": F.lit(0).cast("long")})
    return _formatted(linked.unionByName(plain), schemas)


def _formatted(linked: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    link = (
        F.when(F.col("result_of").isNotNull(), F.when(F.col("call_turn").isNotNull(), "linked").otherwise("orphan"))
        .when(F.col("call_id").isNotNull(), F.when(F.col("result_turn").isNotNull(), "answered").otherwise("unanswered"))
        .otherwise("none")
    )
    errors = F.lit(None).cast("array<string>")
    for name, schema in schemas.items():
        errors = F.when(F.col("call_name") == name, argument_errors(F.col("call_args"), schema)).otherwise(errors)
    errors = F.when(F.col("call_id").isNotNull(), F.coalesce(errors, F.array(F.concat(F.lit("no schema of "), F.coalesce("call_name", F.lit("null"))))))
    call = F.when(F.col("call_id").isNotNull(), F.struct(F.coalesce(canonical_json(F.col("call_args")), F.lit("null")).alias("arguments"), F.col("call_id").alias("id"), F.col("call_name").alias("name")))
    linked = linked.withColumn("link", link).withColumn("errors", errors)
    linked = linked.withColumn("valid", F.when(F.col("errors").isNotNull(), F.size("errors") == 0))
    linked = linked.withColumn("message_json", F.to_json(F.struct("content", "role", call.alias("tool_call"), F.col("result_of").alias("tool_call_id"))))
    return linked.select("conv_id", "turn", "role", "link", "depth", "valid", "errors", "message_json")


def _edges(tools: DataFrame, calls: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, before, after): a call comes before its results, and a result before the calls that need it."""
    to_results = tools.where("result_of IS NOT NULL").join(calls.withColumnRenamed("call_id", "result_of"), ["conv_id", "result_of"]).select("conv_id", F.col("call_turn").alias("before"), F.col("turn").alias("after"))
    needed = tools.where("call_id IS NOT NULL").select("conv_id", F.col("turn").alias("after"), F.explode("needs").alias("call_id"))
    to_calls = needed.join(answers, ["conv_id", "call_id"]).select("conv_id", F.col("result_turn").alias("before"), "after")
    return materialise(to_results.unionByName(to_calls).where("before IS NOT NULL AND after IS NOT NULL").distinct(), "tool-edges")


def _depths(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, known): the longest chain before each message that has an edge; null in or after a cycle.

    Messages with one predecessor point to it, and pointers double until each points to a start or to a message with several
    predecessors, with the length of the way: as many rounds as the logarithm of the longest such way. Then those few that
    have several predecessors take their depths round by round, once all they wait for have one, until a round gives nothing new.
    """
    key = ["conv_id", "turn"]
    nodes = edges.select("conv_id", F.explode(F.array("before", "after")).alias("turn")).distinct()
    indegree = edges.groupBy("conv_id", F.col("after").alias("turn")).agg(F.count("*").alias("n"), F.min("before").alias("to"))
    pointers = materialise(nodes.join(indegree, key, "left").select(*key, F.when(F.col("n") == 1, F.col("to")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("way"), (F.coalesce("n", F.lit(0)) > 1).alias("joins")), "tool-pointers")
    # a pointer that has come to a message that points nowhere stays
    open_ = -1
    while True:
        ahead = pointers.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("way").alias("more"))
        moved = pointers.where("to IS NULL").unionByName(
            pointers.where("to IS NOT NULL").join(ahead, ["conv_id", "to"]).select(*key, F.coalesce("next", "to").alias("to"), (F.col("way") + F.coalesce(F.when(F.col("next").isNotNull(), F.col("more")), F.lit(0))).alias("way"), "joins")
        )
        moved = materialise(moved, "tool-pointers")
        ends = moved.where("to IS NULL").select("conv_id", F.col("turn").alias("to"))
        still = moved.where("to IS NOT NULL").join(ends, ["conv_id", "to"], "left_anti").count()
        discard(pointers)
        pointers = moved
        if still in (0, open_):
            break
        open_ = still
    ends = pointers.where("to IS NULL").select("conv_id", F.col("turn").alias("to"))
    # each message with its end and the way from there; those of a cycle have none
    placed = pointers.where("to IS NULL").select(*key, F.col("turn").alias("end"), F.lit(0).cast("long").alias("way"))
    placed = materialise(placed.unionByName(pointers.where("to IS NOT NULL").join(ends, ["conv_id", "to"]).select(*key, F.col("to").alias("end"), "way")), "tool-places")
    done = materialise(pointers.where("to IS NULL AND NOT joins").select("conv_id", F.col("turn").alias("end"), F.lit(0).cast("long").alias("depth")), "tool-depths")
    several = pointers.where("joins").select(*key)
    waits = edges.join(several.withColumnRenamed("turn", "after"), ["conv_id", "after"]).join(placed.select("conv_id", F.col("turn").alias("before"), "end", "way"), ["conv_id", "before"], "left")
    waits = materialise(waits.select("conv_id", "after", "end", "way"), "tool-waits")
    while not waits.isEmpty():
        reached = waits.join(done, ["conv_id", "end"], "left").groupBy("conv_id", "after").agg((F.max(F.col("depth") + F.col("way")) + 1).alias("depth"), F.count(F.when(F.col("depth").isNull(), 1)).alias("open"))
        new = materialise(reached.where("open = 0").select("conv_id", F.col("after").alias("end"), "depth"), "tool-depths")
        if new.isEmpty():
            break
        rest = materialise(waits.join(new.select("conv_id", F.col("end").alias("after")), ["conv_id", "after"], "left_anti"), "tool-waits")
        both = materialise(done.unionByName(new), "tool-depths")
        discard(waits, done, new)
        waits, done = rest, both
    depths = placed.join(done, ["conv_id", "end"]).select(*key, (F.col("depth") + F.col("way")).alias("depth"))
    return nodes.join(depths, key, "left").withColumn("known", F.lit(True))
