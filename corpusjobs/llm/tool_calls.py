"""Tool calls in chats: linked to results by identifier, ordered, checked against schemas, written as canonical JSON.

Works on DataFrame operations only. `calls` has (conv_id, turn, call_id, tool, arguments, after): the
arguments as JSON text, after as the ids of calls that must come before. `results` has (conv_id, turn,
call_id, content). `schemas` has (tool, name, type, required), a row for each parameter, its type one of
string, integer, number, boolean, array, object.

Calls and results meet in a hash join on (conv_id, call_id). A call's level is 0 if it waits for no known
call, else one more than the highest level it waits for; calls in a circle have none (null). In
conversations where each call waits for one other at most, levels come from doubled pointers; in others from passes
over blocks of calls within a row, whichever turns they wait for. Only where such a conversation has more than BLOCK
calls are there further rounds, one each time that a chain of calls goes on in another block. Arguments
that aren't a JSON object, lack a required parameter, have one of another type or one that the schema
doesn't name, and calls of unknown tools, are invalid, with the reasons. Canonical JSON has its keys in
order at every depth and no white space.

Nulls: a call or result without conversation or identifier is linked with nothing and has level 0.
Repeated rows give repeated results; an id that several calls have links all of them to the results of
this id. Every call and every result gives one row; empty tables give none.

Very long arguments are parsed whole; columns other than those named aren't read, whatever their names.

linked_conversations() has the turns of users and assistants; whole_conversations() adds each other turn
(role system, null or any other) as a row of kind turn: level 0, not linked, not valid, with the reason
'no call or result'. The query has all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, let, small
from corpusjobs.operators import ordered

KEY = ["conv_id", "call_id"]
#: Calls of a conversation that are ordered within one row at most; it bounds a row, longer conversations have several.
BLOCK = 1_000
#: For each type of a schema, what a JSON value of it is called.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def canonical(json: Column) -> Column:
    """JSON text with ordered keys and without white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of each identified call: of conv_id, call_id, after and, where there is one, turn."""
    turn = F.col("turn") if "turn" in calls.columns else F.lit(0)
    known = calls.where("conv_id is not null and call_id is not null")
    ids = checkpointed(known.groupBy(*KEY).agg(F.min(turn).alias("turn")))
    edges = known.select(*KEY, F.explode("after").alias("parent")).distinct().join(ids.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi")
    edges = checkpointed(edges)
    waits = edges.groupBy(*KEY).agg(F.count("*").alias("waits"), F.min("parent").alias("up"))
    nodes = ids.join(waits, KEY, "left")
    kinds = nodes.groupBy("conv_id").agg(F.coalesce(F.max("waits"), F.lit(0)).alias("most"), F.count("*").alias("calls"))
    nodes = checkpointed(nodes.join(kinds, "conv_id"))
    found = chain_levels(nodes.where("most <= 1").select(*KEY, "up"))
    several = nodes.where("most > 1")
    if not several.limit(1).count():
        return found
    return found.unionByName(block_levels(several.select(*KEY, "turn"), edges))


def relaxed(calls: Column) -> Column:
    """Levels of the calls of a block, in their order: of (call_id, parents in the block, highest level of parents elsewhere, whether one of these is open).

    A call gets its level once all its parents have theirs; passes over the block go on until one changes nothing. What is then null
    waits for a circle, or for a call elsewhere that is open. A pass goes through the calls forwards and then backwards.
    """
    names = F.transform(calls, lambda c: c["call_id"])
    waits = let(names, lambda n: F.transform(calls, lambda c: F.struct(F.transform(c["parents"], lambda p: F.array_position(n, p).cast("int") - 1).alias("at"), c["high"].alias("high"), c["open"].alias("open"))))

    def passed(w: Column, level: Column, last: Column | None) -> Column:
        """One pass, in the order of the calls, or from the last one backwards; it sees what it has found on its way."""

        def one(found: Column, k: Column) -> Column:
            x = F.get(w, k)
            mine = lambda p: F.get(found, p if last is None else last - p)
            above = F.transform(x["at"], lambda p: F.coalesce(mine(p), F.get(level, p)))
            ready = ~x["open"] & ~F.exists(above, lambda v: v.isNull())
            return F.coalesce(F.get(level, k), F.when(ready, F.coalesce(F.greatest(F.array_max(above), x["high"]) + 1, F.lit(0))))

        places = F.sequence(F.lit(0), F.size(w) - 1) if last is None else F.sequence(last, F.lit(0), F.lit(-1))
        found = F.aggregate(places, F.array().cast("array<int>"), lambda f, k: F.concat(f, F.array(one(f, k))))
        return found if last is None else F.reverse(found)

    def step(w: Column) -> Column:
        start = F.struct(F.transform(w, lambda _: F.lit(None).cast("int")).alias("level"), F.lit(True).alias("moved"))

        def again(a: Column, _: Column) -> Column:
            def told(new: Column) -> Column:
                left = lambda x: F.size(F.filter(x, lambda v: v.isNull()))
                return F.struct(new.alias("level"), (left(new) < left(a["level"])).alias("moved"))

            both = let(passed(w, a["level"], None), lambda up: passed(w, up, F.size(w) - 1))
            return F.when(a["moved"], let(both, told)).otherwise(a)

        return F.aggregate(F.sequence(F.lit(0), F.size(w)), start, again, lambda a: a["level"])

    return let(waits, step)


def block_levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels where calls wait for several others: each block of up to BLOCK calls of a conversation, by turn, is ordered within one row.

    Calls of other blocks are asked in rounds; there is one round if no conversation has more than one block, and else as many as chains of calls go from block to block.
    """
    placed = ordered.running(ids, ["conv_id"], ["turn", "call_id"], {"place": F.lit(1)}).select(*KEY, F.floor((F.col("place") - 1) / BLOCK).alias("block"))
    placed = checkpointed(placed)
    of = placed.select("conv_id", F.col("call_id").alias("parent"), F.col("block").alias("block of"))
    joined = edges.join(placed, KEY).join(of, ["conv_id", "parent"])
    inner = joined.where("block = `block of`").groupBy(*KEY).agg(F.collect_list("parent").alias("parents"))
    outer = checkpointed(joined.where("block != `block of`").select(*KEY, "parent"))
    nodes = checkpointed(placed.join(inner, KEY, "left").select(*KEY, "block", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")))
    several, state, left = not outer.isEmpty(), None, -1
    while True:
        if state is None:
            beyond = outer.select(*KEY).distinct().select(*KEY, F.lit(None).cast("int").alias("high"), F.lit(True).alias("open"))
        else:
            above = state.select("conv_id", F.col("call_id").alias("parent"), "level")
            beyond = outer.join(above, ["conv_id", "parent"]).groupBy(*KEY).agg(F.max("level").alias("high"), (F.count_if(F.col("level").isNull()) > 0).alias("open"))
        call = F.struct("call_id", "parents", "high", F.coalesce("open", F.lit(False)).alias("open"))
        blocks = nodes.join(beyond, KEY, "left").groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(call)).alias("calls"))
        told = blocks.select("conv_id", F.explode(F.arrays_zip(F.transform("calls", lambda c: c["call_id"]).alias("call_id"), relaxed(F.col("calls")).alias("level"))).alias("of"))
        state = checkpointed(told.select("conv_id", "of.call_id", "of.level"))
        before, left = left, state.where("level is null").count() if several else 0
        if not left or left == before:
            return state


def chain_levels(ids: DataFrame) -> DataFrame:
    """Levels where each call waits for one other at most: pointers are doubled, so that a chain of n calls takes log2(n) rounds."""
    state = checkpointed(ids.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1)))
    for _ in range(state.count().bit_length() + 1):
        moving = state.where("up is not null")
        if not moving.limit(1).count():
            break
        beyond = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = moving.join(beyond, ["conv_id", "up"]).select(*KEY, F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = checkpointed(moved.unionByName(state.where("up is null").select(*KEY, "up", "level")))
    # What still points somewhere is in a circle, or waits for one.
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def problems(tool: Column, arguments: Column, params: Column) -> Column:
    """Why a call is invalid, in order; params: the schema's parameters (name, type, required), null for an unknown tool."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    given = F.when(is_object, F.from_json(arguments, "map<string,variant>"))
    kinds = F.transform_values(given, lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    patterns = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(f"^({v})$"))])

    def judged(x: Column) -> Column:
        def of_param(p: Column) -> Column:
            kind = x["kinds"][p["name"]]
            return F.when(kind.isNull(), F.when(p["required"], F.concat(F.lit("missing "), p["name"]))).when(~F.coalesce(F.regexp_like(kind, patterns[p["type"]]), F.lit(False)), F.concat(F.lit("type of "), p["name"]))

        unknown = F.transform(F.array_sort(F.array_except(F.map_keys(x["kinds"]), F.transform(x["params"], lambda p: p["name"]))), lambda k: F.concat(F.lit("unknown "), k))
        found = F.filter(F.concat(F.transform(x["params"], of_param), unknown), lambda y: y.isNotNull())
        return F.when(x["params"].isNull(), F.array(F.lit("unknown tool"))).when(x["kinds"].isNull(), F.array(F.lit("not an object"))).otherwise(found)

    # Bound once, so that the arguments aren't parsed again for each parameter.
    return let(F.struct(kinds.alias("kinds"), params.alias("params")), judged)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call and each result: conv_id, turn, kind, call_id, level, linked, valid, problems, message (canonical JSON)."""
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = results.select("conv_id", "turn", "call_id", "content")
    answered = results.where("conv_id is not null and call_id is not null").select(*KEY).distinct().withColumn("answered", F.lit(True))
    ranked = checkpointed(levels(calls).withColumn("called", F.lit(True)))
    params = schemas.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("name", "type", "required"))).alias("params"))  # as many as a schema has
    made = calls.join(ranked.hint("shuffle_hash"), KEY, "left").join(answered.hint("shuffle_hash"), KEY, "left").join(small(params), "tool", "left")
    made = made.withColumn("wrong", F.array_join(problems(F.col("tool"), F.col("arguments"), F.col("params")), ", "))
    wrong = F.col("wrong")
    level = F.when(F.col("called"), F.col("level")).otherwise(0)
    written = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name")), {"ignoreNullFields": "false"})
    calls_out = made.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", level.alias("level"), F.coalesce("answered", F.lit(False)).alias("linked"), (wrong == "").alias("valid"), wrong.alias("problems"), canonical(written).alias("message")
    )
    told = F.to_json(F.struct("call_id", "content"), {"ignoreNullFields": "false"})
    results_out = results.join(ranked.hint("shuffle_hash"), KEY, "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", level.alias("level"), F.coalesce("called", F.lit(False)).alias("linked"), F.coalesce("called", F.lit(False)).alias("valid"),
        F.when(F.col("called"), "").otherwise("no call").alias("problems"), canonical(told).alias("message"),
    )
    return calls_out.unionByName(results_out)


def conversation_exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as a chat without tools has them: a user's turn asks, the assistant's next turn answers.

    A call's id is the conversation and its turn; it waits for the call two turns before.
    """

    def name(turn: Column) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    identified = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.when(identified, name(F.col("turn"))).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(identified, F.array(name(F.col("turn") - 2))).alias("after"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.when(identified, name(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = conversation_exchanges(conversations)
    schemas = conversations.sparkSession.createDataFrame([("reply", "prompt", "string", True), ("reply", "turn", "integer", True)], "tool string, name string, type string, required boolean")
    return link(calls, results, schemas)


def whole_conversations(conversations: DataFrame) -> DataFrame:
    """linked_conversations() and a row for each turn that is neither call nor result."""
    told = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    rest = conversations.where("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"),
        F.lit("no call or result").alias("problems"), canonical(told).alias("message"),
    )
    return linked_conversations(conversations).unionByName(rest)


SQL = """
WITH calls AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), ranked AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn - 2 * n ORDER BY turn) - 1 AS level
  FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM calls))
)
SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, CAST(k.level AS INTEGER) AS level,
  EXISTS (SELECT 1 FROM results r WHERE r.call_id = c.call_id) AS linked,
  c.text IS NOT NULL AS valid, CASE WHEN c.text IS NULL THEN 'type of prompt' ELSE '' END AS problems,
  '{"arguments":{"prompt":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"reply"}' AS message
FROM calls c JOIN ranked k ON k.conv_id = c.conv_id AND k.turn = c.turn
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, CAST(coalesce(k.level, 0) AS INTEGER), k.level IS NOT NULL, k.level IS NOT NULL,
  CASE WHEN k.level IS NULL THEN 'no call' ELSE '' END,
  '{"call_id":"' || r.call_id || '","content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}'
FROM results r LEFT JOIN ranked k ON k.conv_id = r.conv_id AND k.turn = r.turn - 1
UNION ALL
SELECT conv_id, turn, 'turn', NULL, 0, false, false, 'no call or result',
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
