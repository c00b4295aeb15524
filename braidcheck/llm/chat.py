"""Tool-call linking and canonical chat records, in built-in column expressions.

Calls and results meet in a hash join on their identifier; an order of each conversation
follows from the turns and, within a turn, from the levels of the dependency graph;
arguments are checked against schemas; and each message becomes one line of canonical JSON (keys in
order, no white space). Nothing gathers a conversation in one row, so one that holds a third
of all messages costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared_dir, table, written

#: Turns of a conversation that are ordered in one task.
BLOCK = 512
#: function name -> argument name -> (type, required). Types: string, integer, number, boolean, array, object.
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "(OBJECT|STRUCT).*"}


def canonical(json: Column) -> Column:
    """A JSON text with its keys in order and without white space; null where it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def argument_faults(name: Column, arguments: Column, schemas=None) -> Column:
    """What is wrong with a call's arguments (a JSON text): an array of texts in order, empty if nothing is."""
    schemas = SCHEMAS if schemas is None else schemas
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    checks = []
    for fn, fields in sorted(schemas.items()):
        for field, (want, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            absent = got.isNull() | (got == "VOID")
            wrong = F.when(absent, F.lit(f"missing {field}") if required else F.lit(None)).when(~got.rlike(f"\\A{_TYPES[want]}\\z"), F.lit(f"{field} is not {want}"))
            checks.append(F.when(name == fn, wrong))
    no_name = F.when(name.isNull() | ~name.isin(list(schemas)), F.lit("unknown function"))
    no_json = F.when(value.isNull() | ~kind.rlike("\\A(OBJECT|STRUCT)"), F.lit("arguments are no object"))
    return F.when(no_name.isNotNull(), F.array(no_name)).when(no_json.isNotNull(), F.array(no_json)).otherwise(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, call_id, turn, ...) with result_turn and n_results; results (conv_id, call_id, turn, ...) with call_turn and answers.

    The first later result by turn answers a call; others, and results before their call or
    without one, do not (`answers` is false). Null identifiers link with nothing. Of
    calls that share an identifier the first by turn is answered. Results are counted before the join, so
    a call with very many results does not swell it.
    """
    key = ["conv_id", "call_id"]
    first = calls.where("call_id is not null").groupBy(*key).agg(F.min("turn").alias("call_turn"))
    met = results.join(first, key, "left")
    answer = met.where("turn > call_turn").groupBy(*key).agg(F.min("turn").alias("result_turn"), F.count(F.lit(1)).alias("n_results"))
    linked = calls.join(first, key, "left").join(answer, key, "left").withColumns({"result_turn": F.when(F.col("turn") == F.col("call_turn"), F.col("result_turn")), "n_results": F.when(F.col("turn") == F.col("call_turn"), F.coalesce("n_results", F.lit(0))).otherwise(F.lit(0)).cast("long")})
    told = met.join(answer.drop("n_results"), key, "left").withColumn("answers", F.coalesce(F.col("turn") == F.col("result_turn"), F.lit(False)))
    return linked.drop("call_turn"), told.drop("result_turn")


def topological_levels(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(id, level) of nodes (id) under edges (before, after): the longest way from a node without any before it; null on and after a cycle.

    A round per level: nodes whose befores are all done get the next level. Edges to
    unknown nodes are ignored.
    """
    spark = nodes.sparkSession
    known = nodes.select("id").distinct()
    edges = edges.select("before", "after").distinct().join(known.withColumnRenamed("id", "before"), "before", "left_semi").join(known.withColumnRenamed("id", "after"), "after", "left_semi")
    left = written(known, folder, "left0")
    edges = written(edges, folder, "edges0")
    done, level = None, 0
    while True:
        ready = left.join(edges.select(F.col("after").alias("id")), "id", "left_anti")
        ready = written(ready.withColumn("level", F.lit(level)), folder, f"level{level}")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        rest = written(left.join(ready.select("id"), "id", "left_anti"), folder, f"left{level + 1}")
        pending = written(edges.join(ready.select(F.col("id").alias("before")), "before", "left_anti"), folder, f"edges{level + 1}")
        discard(spark, f"{folder}/left{level}")
        discard(spark, f"{folder}/edges{level}")
        left, edges, level = rest, pending, level + 1
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.union(stuck)


def with_running(messages: DataFrame, value: Column, name: str) -> DataFrame:
    """The last value that is not null at or before each row, in the turns of its conversation; of rows with one turn the greatest value counts.

    Turns are dealt to blocks; a block takes over what the blocks before it end with, found from a row
    a block.
    """
    dealt = messages.withColumns({"_block": F.floor(F.coalesce("turn", F.lit(0)) / BLOCK), "_value": value})
    here = Window.partitionBy("conv_id", "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.groupBy("conv_id", "_block").agg(F.max("_value").alias("_end"))
    line = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "_block", F.max("_end").over(line).alias("_carried"))
    return dealt.withColumn("_own", F.max("_value").over(here)).join(ends, ["conv_id", "_block"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_block", "_value", "_own", "_carried")


def message_levels(rows: DataFrame, folder: str) -> DataFrame:
    """(call_id, role, level) of the calls and results in rows (call_id, role, depends_on), by the longest way in their dependency graph.

    A result comes after its call, and a call after the results of the calls that its depends_on names.
    Results of one call depend on the same and are one node, so a call with very many costs no more.
    """
    linked = rows.where("call_id is not null")
    node = lambda role, call_id: F.concat_ws(":", role, call_id)
    nodes = linked.select(node(F.col("role"), F.col("call_id")).alias("id")).distinct()
    asked = linked.where("role = 'user'")
    user, assistant = F.lit("user"), F.lit("assistant")
    edges = asked.select(node(user, F.col("call_id")).alias("before"), node(assistant, F.col("call_id")).alias("after"))
    needs = asked.select("call_id", F.explode("depends_on").alias("needed")).where("needed is not null")
    edges = edges.union(needs.select(node(assistant, F.col("needed")), node(user, F.col("call_id"))))
    parts = F.split("id", ":", 2)
    return topological_levels(nodes, edges, folder).select(parts[1].alias("call_id"), parts[0].alias("role"), "level")


def chat_records(conversations: DataFrame, schemas=None) -> DataFrame:
    """One row per message of conversations (conv_id, turn, role, text), in canonical JSON, with calls and results linked.

    A user's message is a call and an assistant's a result. Optional columns tell more of them: call_id, the identifier by which a
    call and its results meet; name, the function called; arguments, a JSON text; depends_on (array of call_ids), the calls whose results
    a call needs. Where there is no call_id column, a user's message is a call of `reply` with the text and the turn as its
    arguments, and the messages of the assistant after it are its results.

    Columns: conv_id, turn, role, call_id, link_turn (of a call its answer's turn, of a result its call's), level (of the
    dependency graph; null on and after a cycle), valid (false if the arguments of a call are no JSON or do not fit the schema of its
    function, or a result answers nothing), json. Order a conversation by turn and level. Of calls that share an identifier the first by
    turn is answered, by the first later result. Null texts and roles are JSON nulls; a call whose required argument is null is not valid;
    arguments that are no JSON are written as a JSON text. A repeated row comes back as often. Rows without conv_id or turn
    link with nothing. Identifiers hold within a conversation. A result that has no call comes after one that is not there, at
    level 1; messages that are neither are at level 0. An empty table gives no rows; other columns are not read.
    """
    folder = shared_dir(conversations.sparkSession)
    own = "call_id" in conversations.columns
    given = lambda name, kind: (F.col(name) if name in conversations.columns else F.lit(None)).cast(kind).alias(name)
    rows = conversations.select(
        *[F.col(c).cast(kind).alias(c) for c, kind in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))],
        given("call_id", "string"), given("name", "string"), given("arguments", "string"), given("depends_on", "array<string>"),
    )
    whole, odd = rows.where("conv_id is not null and turn is not null"), rows.where("conv_id is null or turn is null").withColumn("call_id", F.lit(None).cast("string"))
    linked = F.col("role").isin("user", "assistant")
    keep = {"ignoreNullFields": "false"}
    if own:
        whole = whole.withColumn("call_id", F.when(linked, F.col("call_id")))
        # An identifier holds within its conversation; others' results may have the same.
        key = lambda x: F.concat_ws("-", "conv_id", x)
        rows = whole.withColumns({"node": F.when(F.col("call_id").isNotNull(), key(F.col("call_id"))), "depends_on": F.transform("depends_on", lambda x: F.when(x.isNotNull(), key(x)))})
    else:
        whole = with_running(whole, F.when(F.col("role") == "user", F.col("turn")), "asked")
        whole = whole.withColumn("call_id", F.when(linked & F.col("asked").isNotNull(), F.concat_ws("-", "conv_id", "asked"))).drop("asked")
        rows = whole.withColumn("node", F.col("call_id"))
    rows = rows.unionByName(odd.withColumn("node", F.lit(None).cast("string")))
    if not own:
        made = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), keep)
        rows = rows.withColumns({"name": F.when(F.col("role") == "user", F.lit("reply")), "arguments": F.when(F.col("role") == "user", made)})
    rows = written(rows, folder, "rows")
    levels = message_levels(rows.select(F.col("node").alias("call_id"), "role", "depends_on"), folder).select(F.col("call_id").alias("node"), "role", F.col("level").alias("found"))
    alone = F.when(F.col("role") == "assistant", 1).otherwise(0)
    rows = rows.drop("depends_on").join(levels, ["node", "role"], "left").withColumn("level", F.when(F.col("node").isNull(), alone).otherwise(F.col("found"))).drop("found", "node")

    calls = rows.where("role = 'user'")
    results = rows.where("role = 'assistant'")
    others = rows.where("role is null or role not in ('user', 'assistant')")
    calls, results = link(calls, results)

    told = F.coalesce(canonical(F.col("arguments")), F.substring(F.to_json(F.struct(F.col("arguments").alias("a")), keep), F.lit(6), F.length(F.to_json(F.struct(F.col("arguments").alias("a")), keep)) - 6))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", "role"), keep)
    calls = calls.withColumn("faults", argument_faults(F.col("name"), F.col("arguments"), schemas)).select(
        "conv_id", "turn", "role", "call_id", F.col("result_turn").alias("link_turn"), "level", (F.size("faults") == 0).alias("valid"),
        F.concat(F.lit('{"arguments":'), told, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("json"),
    )
    results = results.select(
        "conv_id", "turn", "role", "call_id", F.col("call_turn").alias("link_turn"), "level", F.col("answers").alias("valid"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("call_id").alias("id"), F.col("role").alias("role")), keep).alias("json"),
    )
    others = others.select(
        "conv_id", "turn", "role", "call_id", F.lit(None).cast("long").alias("link_turn"), "level", F.lit(True).alias("valid"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), keep).alias("json"),
    )
    return calls.unionByName(results).unionByName(others)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of conversations, see chat_records: nulls, repeats, ties and empty tables are as told there; texts of any length are whole."""
    return chat_records(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text,
         max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked
  FROM conversations),
k AS (
  SELECT *, CASE WHEN role IN ('user', 'assistant') AND asked IS NOT NULL THEN concat(conv_id, '-', asked) END AS call_id FROM m),
a AS (
  SELECT conv_id, asked, min(turn) AS result_turn FROM k WHERE role = 'assistant' AND asked IS NOT NULL AND turn > asked GROUP BY ALL)
SELECT k.conv_id, k.turn, k.role, k.call_id,
       CASE k.role WHEN 'user' THEN a.result_turn WHEN 'assistant' THEN k.asked END AS link_turn,
       CASE WHEN k.role = 'assistant' THEN 1 ELSE 0 END AS level,
       CASE k.role WHEN 'user' THEN k.text IS NOT NULL WHEN 'assistant' THEN coalesce(k.turn = a.result_turn, false) ELSE true END AS valid,
       CASE k.role
         WHEN 'user' THEN concat('{"arguments":{"prompt":', CAST(to_json(k.text) AS VARCHAR), ',"turn":', k.turn, '},"id":"', k.call_id, '","name":"reply","role":"user"}')
         WHEN 'assistant' THEN concat('{"content":', CAST(to_json(k.text) AS VARCHAR), ',"id":', CASE WHEN k.call_id IS NULL THEN 'null' ELSE concat('"', k.call_id, '"') END, ',"role":"assistant"}')
         ELSE concat('{"content":', CAST(to_json(k.text) AS VARCHAR), ',"role":', CAST(to_json(k.role) AS VARCHAR), '}') END AS json
FROM k LEFT JOIN a ON k.conv_id = a.conv_id AND k.asked = a.asked
"""
