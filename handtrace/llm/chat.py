"""Chat formatting: link tool calls and results, order them, check arguments, write canonical JSON.

Calls and results are joined by hash on (conversation, call id), where the calls are one row for an
id. A call may name an earlier call in ``after``; as a call has one such parent, its depth in the
tree is found by pointer doubling: in every round each open call takes over the pointer of the call
it points to, so chains of any length need a logarithmic number of joins. Ranks are topological:
a call has twice its depth, its results one more, plain messages -1. Calls that still point
somewhere when a round settles nothing are on or behind a cycle.

Arguments are parsed as VARIANT values and compared with the schema of their tool, field by field.
The canonical JSON of a message has sorted keys, no spaces and no null fields.

Status of a call: linked (a result came), unanswered, cycle; of a result: linked, orphan (no call).
Problems of a call, sorted: ``tool`` (unknown), ``json`` (not an object, broken, or a key twice; the
arguments are then an empty object), ``missing:f``, ``unknown:f``, ``type:f``, ``range:f``.

Cases: repeated rows are one message; different calls with one id are a message each, answered by the
id's results, and the least (turn, name, arguments, after) is the one that other messages refer to;
null ids match nothing, so that such calls are unanswered; an ``after`` that is not a call of the conversation is
ignored; a null text is a message without content; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KEY = ["conv_id", "call_id"]
MESSAGE = ["conv_id", "turn", "role", "content", "call_id", "after", "name", "arguments"]


def argument_problems(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(message, arguments: variant object, problems) of calls; ``message`` numbers them.

    ``tools``: (name, field, kind, required, least, most); kind is string, integer, number, boolean,
    object or array; the bounds hold for numbers and for the length of strings.
    """
    parsed = calls.select("message", "name", F.try_parse_json("arguments").alias("arguments"))
    whole = F.schema_of_variant("arguments").startswith("OBJECT")
    parsed = parsed.withColumn("whole", F.coalesce(whole, F.lit(False)))
    empty = F.parse_json(F.lit("{}"))
    parsed = parsed.withColumn("arguments", F.when(F.col("whole"), F.col("arguments")).otherwise(empty))
    spark = calls.sparkSession
    fields = spark.sql(
        """SELECT message, name, key AS field, schema_of_variant(value) AS kind_found,
                  try_cast(value AS double) AS number, try_cast(value AS string) AS string
           FROM {parsed}, LATERAL variant_explode(arguments)""", parsed=parsed)
    known = tools.select("name").distinct().withColumn("known", F.lit(True))
    fields = fields.join(known, "name").join(tools, ["name", "field"], "left")
    kind = F.expr("""CASE WHEN kind_found = 'BIGINT' THEN 'integer' WHEN kind_found = 'BOOLEAN' THEN 'boolean'
        WHEN kind_found = 'STRING' THEN 'string' WHEN kind_found LIKE 'ARRAY%' THEN 'array'
        WHEN kind_found LIKE 'OBJECT%' THEN 'object' WHEN kind_found = 'VOID' THEN 'null' ELSE 'number' END""")
    right = (kind == F.col("kind")) | ((kind == "integer") & (F.col("kind") == "number"))
    size = F.when(kind.isin("integer", "number"), F.col("number")).when(kind == "string", F.length("string"))
    outside = (size < F.col("least")) | (size > F.col("most"))
    code = F.when(F.col("kind").isNull(), "unknown").when(~right, "type").when(F.coalesce(outside, F.lit(False)), "range")
    found = fields.groupBy("message").agg(
        F.collect_set(F.when(code.isNotNull(), F.concat(code, F.lit(":"), "field"))).alias("wrong"),
        F.collect_set(F.when(F.col("required"), F.col("field"))).alias("given"))
    needed = tools.groupBy("name").agg(F.collect_set(F.when(F.col("required"), F.col("field"))).alias("needed"))
    rows = parsed.join(needed, "name", "left").join(found, "message", "left")
    none = F.array().cast("array<string>")
    missing = F.transform(F.array_except("needed", F.coalesce("given", none)), lambda f: F.concat(F.lit("missing:"), f))
    problems = F.concat(
        F.when(F.col("needed").isNull(), F.array(F.lit("tool"))).otherwise(none),
        F.when(~F.col("whole"), F.array(F.lit("json"))).otherwise(none),
        F.coalesce(missing, none), F.coalesce("wrong", none))
    return rows.select("message", "arguments", F.array_sort(problems).alias("problems"))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls with ``after``; a null depth marks a cycle."""
    ids = calls.select(*KEY)
    up = ids.withColumnsRenamed({"call_id": "up"}).distinct()
    state = calls.select("conv_id", "call_id", F.col("after").alias("up")).join(
        up.withColumn("there", F.lit(1)), ["conv_id", "up"], "left")
    state = state.select(*KEY, F.when(F.col("there") == 1, F.col("up")).alias("up"))
    state = written(state.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)), "depths")
    waiting = state.where("up is not null").count()
    while waiting:
        target = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.join(target, ["conv_id", "up"], "left").select(
            *KEY, F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = written(moved, "depths")
        left = state.where("up is not null").count()
        if left == waiting:
            break
        waiting = left
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def format_messages(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, call_id, rank, status, problems, json.

    ``messages`` has the columns of MESSAGE; role ``call`` is a tool call of the assistant, ``tool`` a
    result; any other role is a plain message.
    """
    rows = messages.select(*MESSAGE).distinct()
    calls = rows.where("role = 'call'").select(*KEY, "turn", "name", "arguments", "after")
    calls = written(calls.withColumn("message", F.monotonically_increasing_id()), "calls")
    targets = calls.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select(*KEY, "c.*")
    targets = written(targets, "targets")
    placed = written(depths(targets).withColumn("called", F.lit(True)), "placed")
    results = rows.where("role = 'tool'").select("conv_id", "turn", "call_id", "content")
    answered = results.groupBy(*KEY).agg(F.count("*").alias("answers"))
    checked = argument_problems(calls, tools)
    parent = placed.select("conv_id", F.col("call_id").alias("after"), F.col("depth").alias("above"), "called")
    known = calls.drop("arguments").join(checked.withColumnRenamed("arguments", "parsed"), "message")
    known = known.join(parent, ["conv_id", "after"], "left").withColumn(
        "depth", F.when(F.col("called"), F.col("above") + 1).otherwise(0))
    known = known.join(answered, KEY, "left")
    status = F.when(F.col("depth").isNull(), "cycle").when(F.col("answers").isNull(), "unanswered").otherwise("linked")
    out_calls = known.select(
        "conv_id", "turn", F.lit("call").alias("role"), "call_id", (2 * F.col("depth")).alias("rank"), status.alias("status"),
        F.array_join("problems", ",").alias("problems"),
        F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", "name", F.lit("assistant").alias("role"))).alias("json"))
    names = targets.select(*KEY, "name").join(placed, KEY)
    out_results = results.join(names.hint("shuffle_hash"), KEY, "left").select(
        "conv_id", "turn", F.lit("tool").alias("role"), "call_id", (2 * F.col("depth") + 1).alias("rank"),
        F.when(F.col("called"), F.when(F.col("depth").isNull(), "cycle").otherwise("linked")).otherwise("orphan").alias("status"),
        F.lit("").alias("problems"),
        F.to_json(F.struct("call_id", "content", "name", F.lit("tool").alias("role"))).alias("json"))
    plain = F.col("role").isNull() | ~F.col("role").isin("call", "tool")
    out_plain = rows.where(plain).select(
        "conv_id", "turn", "role", F.lit(None).cast("string").alias("call_id"), F.lit(-1).alias("rank"),
        F.lit("message").alias("status"), F.lit("").alias("problems"),
        F.to_json(F.struct("content", "role")).alias("json"))
    return out_calls.unionByName(out_results).unionByName(out_plain)
