"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Input: messages with a conversation, a turn, a kind (``call``, ``result`` or ``text``), a call id, a parent call id, a tool
name, arguments (JSON text) and a content.

1. **Link.** Calls and results meet in a hash join on (conversation, call id). Of several calls or results with one id
   the first by turn (then by content) is linked; the others are marked ``duplicate``.
2. **Order.** A call may name a parent call whose result it needs. The depth of each call in this forest is found by
   pointer doubling: each round a call takes over its ancestor's ancestor, so the rounds grow with the logarithm of the
   depth. (depth, turn) is a topological order: parents come before their children, results with their calls.
   Calls on a cycle have no depth.
3. **Validate.** Arguments are parsed (``try_parse_json``) and compared to the tool's schema: required and unknown
   names, and types.
4. **Serialise.** Canonical JSON: keys sorted, no white space.

Each message gives one row, so a conversation that holds a third of all rows isn't gathered in one task.

Cases: NULL or empty arguments are invalid JSON; a call without result is ``pending``, a result without call ``orphan``; a NULL
call id links nothing; without a conversation id calls and results link, but a parent counts as missing; an unknown tool, a
missing parent or a cycle is an error in ``errors``; rows equal in all columns share their status; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

COLUMNS = ("conv_id", "turn", "kind", "call_id", "parent_id", "name", "arguments", "content")


def schema_errors(name: Column, parsed: Column, raw: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Error texts of a call's arguments; ``tools`` maps name -> argument -> (JSON type, required)."""
    types = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
    keys = F.map_keys(F.from_json(raw, "map<string,string>"))
    errors = F.when(~name.isin(*tools) | name.isNull(), F.array(F.lit("unknown tool")))
    for tool, arguments in tools.items():
        found = [F.when(F.size(F.array_except(keys, F.array(*[F.lit(a) for a in arguments]))) > 0,
                        F.lit("unknown argument"))]
        for argument, (kind, required) in arguments.items():
            value = F.variant_get(parsed, f"$.{argument}", "variant")
            shape = F.schema_of_variant(value)
            if required:
                found.append(F.when(value.isNull() | (shape == "VOID"), F.lit(f"{argument}: missing")))
            fits = shape.startswith(types[kind]) if kind in ("object", "array") else shape == types[kind]
            found.append(F.when(value.isNotNull() & (shape != "VOID") & ~fits, F.lit(f"{argument}: not {kind}")))
        errors = errors.when(name == tool, F.array_compact(F.array(*found)))
    return F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)),
                  F.array(F.lit("arguments: not a JSON object"))).otherwise(errors)


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, lost): depth by pointer doubling; NULL on cycles; ``lost`` without its parent."""
    ids = calls.select("conv_id", "call_id", "parent_id")
    known = ids.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("found"))
    now = staged(ids.join(known, ["conv_id", "parent_id"], "left").select(
        "conv_id", "call_id", F.when(F.col("found"), F.col("parent_id")).alias("up"),
        F.when(F.col("found"), 1).otherwise(0).cast("long").alias("depth"),
        (F.col("parent_id").isNotNull() & F.col("found").isNull()).alias("lost")), "chat-depth")
    total, reach = now.count(), 1
    while reach <= total and now.where("up IS NOT NULL").limit(1).count():
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        now = staged(now.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            "lost"), "chat-depth")
        reach *= 2
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), "lost")


def link(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """A row per message: conv_id, turn, kind, call_id, status, depth, errors, json.

    A linked call carries its result in ``json``; the result's own row has the status ``linked`` and the call's depth.
    """
    m = messages.select(*COLUMNS).withColumn("copy", F.xxhash64(*[c for c in COLUMNS if c not in ("conv_id", "call_id")]))
    heads = (m.where("kind IN ('call', 'result') AND call_id IS NOT NULL")
             .groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct("turn", "copy")).alias("head"),
                                                        F.count("*").alias("n")))
    keyed = m.join(heads, (m.conv_id.eqNullSafe(heads.conv_id)) & (m.call_id == heads.call_id) & (m.kind == heads.kind),
                   "left").select(m["*"], F.coalesce((m.turn.eqNullSafe(F.col("head.turn")))
                                                     & (m.copy == F.col("head.copy")), F.lit(False)).alias("is_head"))
    keyed = staged(keyed, "chat-messages")
    calls = keyed.where("kind = 'call' AND is_head").dropDuplicates(["conv_id", "call_id"])
    results = (keyed.where("kind = 'result' AND is_head").dropDuplicates(["conv_id", "call_id"])
               .select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("content").alias("result"),
                       F.lit(True).alias("answered")))
    depths = _depths(calls).select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"), "depth", "lost")
    facts = keyed.join(results.hint("shuffle_hash"), keyed.conv_id.eqNullSafe(F.col("r_conv"))
                       & (keyed.call_id == F.col("r_call")), "left")
    facts = facts.join(depths.hint("shuffle_hash"), keyed.conv_id.eqNullSafe(F.col("d_conv"))
                       & (keyed.call_id == F.col("d_call")), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    called = F.col("d_call").isNotNull()
    status = (F.when(F.col("kind") == "text", "text").when(~F.coalesce(call | result, F.lit(False)), "unknown kind")
              .when(F.col("call_id").isNull(), "no id")
              .when(~F.col("is_head"), "duplicate")
              .when(call, F.when(F.col("answered"), "linked").otherwise("pending"))
              .otherwise(F.when(called, "linked").otherwise("orphan")))
    parsed = F.try_parse_json("arguments")
    order_errors = F.array_compact(F.array(F.when(F.col("lost"), F.lit("parent: missing")), F.when(
        called & F.col("depth").isNull(), F.lit("parent: cycle"))))
    errors = F.when(call, F.concat(schema_errors(F.col("name"), parsed, F.col("arguments"), tools),
                                   F.coalesce(order_errors, F.array().cast("array<string>")))).otherwise(
        F.array().cast("array<string>"))
    # the fields of each kind in the order of their names
    as_call = F.to_json(F.struct(parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
                                 F.col("parent_id").alias("parent"), F.col("result"), F.lit("call").alias("type")))
    as_result = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")))
    as_text = F.to_json(F.struct(F.col("content"), F.col("name"), F.lit("text").alias("type")))
    return facts.select("conv_id", "turn", "kind", "call_id", status.alias("status"),
                        F.when(call | result, F.col("depth")).alias("depth"),
                        errors.alias("errors"), F.when(call, as_call).when(result, as_result).otherwise(as_text).alias("json"))


#: Schemas of the query's tools.
TOOLS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)},
         "search": {"query": ("string", True), "limit": ("integer", False)}}


def messages_of(conversations: DataFrame) -> DataFrame:
    """Conversation turns as tool messages: a user turn is a call, the assistant turn after it its result.

    A call needs the call before it in its conversation, over its whole length. The hexadecimal digits of the MD5 of the
    turn's text say, one after the other, which tool is called (``f``: one without a schema), what is wrong with its
    arguments (``0``: a number as text, ``1``: one too many, ``2``: a list), whether the call repeats the identifier of the
    call before it (``0``), and whether it needs the call after it instead (``0``: a cycle, if that one needs it in turn).
    """
    ident = lambda k: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + k).cast("string"))
    user, assistant, later = F.col("role") == "user", F.col("role") == "assistant", F.col("turn") >= 2
    tool, fault, repeats, ahead = (F.substring(F.md5(F.coalesce("text", F.lit(""))), k, 1) for k in (1, 2, 3, 4))
    name = F.when(tool == "f", "browse").when(tool < "4", "search").otherwise("reply")

    def as_json(number, note=None):
        notes = [] if note is None else [F.lit(note).alias("note")]
        search = F.to_json(F.struct(number.alias("limit"), F.col("text").alias("query"), *notes))
        return F.when(name == "search", search).otherwise(F.to_json(F.struct(number.alias("turn"), F.col("text").alias("prompt"), *notes)))

    turn = F.col("turn")
    arguments = (F.when(fault == "0", as_json(turn.cast("string"))).when(fault == "1", as_json(turn, "derived"))
                 .when(fault == "2", F.to_json(F.array(turn))).otherwise(as_json(turn)))
    return conversations.select(
        "conv_id", "turn", F.when(user, "call").when(assistant, "result").otherwise("text").alias("kind"),
        F.when(user, F.when((repeats == "0") & later, ident(-2)).otherwise(ident(0))).when(assistant, ident(-1)).alias("call_id"),
        F.when(user, F.when(ahead == "0", ident(2)).when(later, ident(-2))).alias("parent_id"),
        F.when(user, name).otherwise(F.col("role")).alias("name"), F.when(user, arguments).alias("arguments"),
        F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"))


def op5_chat_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a linked, ordered and validated message; a depth of -1 stands for none."""
    found = link(messages_of(table(spark, sf_dir, "conversations")), TOOLS)
    return found.withColumn("errors", F.array_join("errors", ",")).withColumn("depth", F.coalesce("depth", F.lit(-1)).cast("long"))


#: Depths by recursion instead of doubling; conversations hold a turn once.
OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, md5(coalesce(text, '')) AS h, conv_id || ':' || turn AS id,
    conv_id || ':' || (turn - 1) AS before, conv_id || ':' || (turn - 2) AS back, conv_id || ':' || (turn + 2) AS ahead FROM conversations),
u AS (SELECT conv_id, turn, text, substr(h, 2, 1) AS fault,
    CASE WHEN substr(h, 1, 1) = 'f' THEN 'browse' WHEN substr(h, 1, 1) < '4' THEN 'search' ELSE 'reply' END AS name,
    CASE WHEN substr(h, 3, 1) = '0' AND turn >= 2 THEN back ELSE id END AS id,
    CASE WHEN substr(h, 4, 1) = '0' THEN ahead WHEN turn >= 2 THEN back END AS parent FROM m WHERE role = 'user'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) = 1 AS head,
    CASE WHEN fault = '0' THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END AS num,
    CASE WHEN fault = '1' THEN '"note":"derived"' END AS note FROM u),
a AS (SELECT * FROM m WHERE role = 'assistant'),
e AS (SELECT c.id, p.id AS up, c.parent IS NOT NULL AND p.id IS NULL AS lost
    FROM c LEFT JOIN c p ON p.head AND p.conv_id = c.conv_id AND p.id = c.parent WHERE c.head),
deep(id, depth) AS (SELECT id, 0 FROM e WHERE up IS NULL UNION ALL SELECT e.id, depth + 1 FROM e JOIN deep ON e.up = deep.id)
SELECT c.conv_id, c.turn, 'call' AS kind, c.id AS call_id,
    CASE WHEN NOT head THEN 'duplicate' WHEN a.id IS NULL THEN 'pending' ELSE 'linked' END AS status,
    CAST(coalesce(depth, -1) AS BIGINT) AS depth,
    concat_ws(',', CASE WHEN fault = '2' THEN 'arguments: not a JSON object' WHEN name = 'browse' THEN 'unknown tool' END,
        CASE WHEN fault = '1' AND name <> 'browse' THEN 'unknown argument' END,
        CASE WHEN c.text IS NULL AND fault <> '2' AND name <> 'browse' THEN if(name = 'search', 'query', 'prompt') || ': missing' END,
        CASE WHEN fault = '0' AND name <> 'browse' THEN if(name = 'search', 'limit', 'turn') || ': not integer' END,
        CASE WHEN e.lost THEN 'parent: missing' END, CASE WHEN depth IS NULL THEN 'parent: cycle' END) AS errors,
    '{"arguments":' || CASE WHEN fault = '2' THEN '[' || c.turn || ']'
            WHEN name = 'search' THEN '{' || concat_ws(',', '"limit":' || num, note, '"query":' || to_json(c.text)) || '}'
            ELSE '{' || concat_ws(',', note, '"prompt":' || to_json(c.text), '"turn":' || num) || '}' END
        || ',"id":' || to_json(c.id) || ',"name":' || to_json(name) || coalesce(',"parent":' || to_json(c.parent), '')
        || coalesce(',"result":' || to_json(a.text), '') || ',"type":"call"}' AS json
FROM c JOIN e ON e.id = c.id LEFT JOIN deep ON deep.id = c.id LEFT JOIN a ON a.before = c.id
UNION ALL
SELECT a.conv_id, a.turn, 'result', a.before, CASE WHEN e.id IS NULL THEN 'orphan' ELSE 'linked' END, CAST(coalesce(depth, -1) AS BIGINT), '',
    '{' || coalesce('"content":' || to_json(a.text) || ',', '') || '"id":' || to_json(a.before) || ',"type":"result"}'
FROM a LEFT JOIN e ON e.id = a.before LEFT JOIN deep ON deep.id = a.before
UNION ALL
SELECT conv_id, turn, 'text', NULL, 'text', CAST(-1 AS BIGINT), '',
    '{' || coalesce('"content":' || to_json(text) || ',', '') || coalesce('"name":' || to_json(role) || ',', '') || '"type":"text"}'
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
