"""Chat formatting with tool-call linking, in built-in expressions only.

Input: one row per message (conv_id, turn, role, text). An assistant's text may be a JSON object with
``content`` and ``tool_calls`` (each with ``id``, ``name`` and ``arguments``, or these two under
``function``; ``arguments`` an object or its text; ``depends_on``: ids whose results it needs). A tool's
text may be an object with ``tool_call_id`` and ``content``. Any other text is content as it stands.

Calls and results are hash-joined by conversation and identifier. Messages are ordered
topologically: a result follows its call, a call follows the calls it depends on and their results, and else
turns decide, then role and text: calls that wait for the same later call come behind it by the number of steps to it. Arguments are checked against the tools' schemas. Each message
becomes canonical JSON: sorted keys, no spaces, absent fields left out.

Defined cases: if an id is used twice in a conversation, the first call by turn owns it and the
first result by turn is linked; other results, and results without a call, keep their own turn and
count as orphans. A cycle of dependencies is broken at its last call by turn: it keeps its own turn,
comes before what it waits for, and counts as cyclic. Every row
without conv_id is a conversation of its own, rows that repeat included; a null turn sorts first, as turn -1; null text is empty content; a
null role is the role ``unknown``. Rows that repeat are messages of their own; messages with equal places go by turn, role and then JSON text, so
that ties need no rule. A tool without schema accepts any object. An empty table gives no rows. Extra columns are not read, whatever their names.

Messages come out as rows, each with its position in its conversation, whatever the conversation's size: rows are sorted by ranges of
conversation and place over all tasks, and a position is what earlier tasks hold of the conversation and what comes before in its own. The array of a whole
conversation is a view of these rows (``chat_arrays``), for conversations that fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import discard, table, written

#: Tool, argument, JSON type and whether it is required. Callers pass their own.
SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "city", "string", True),
    ("weather", "days", "integer", False),
)
CALL = "struct<id:string,name:string,arguments:variant,deps:array<string>,idx:int>"


def own_conversations(df: DataFrame) -> DataFrame:
    """conv_id, own, turn, role and text, with an ``own`` above 0 for every row without conv_id. Those rows are written, so that it stays."""
    rows = df.select(df["conv_id"], df["turn"].cast("long").alias("turn"), df["role"], df["text"])
    alone = written(rows.where(F.col("conv_id").isNull()).withColumn("own", F.monotonically_increasing_id() + 1), "chat-alone")
    return rows.where(F.col("conv_id").isNotNull()).withColumn("own", F.lit(0).cast("long")).unionByName(alone)


def parsed(df: DataFrame) -> DataFrame:
    """One row per message with content, calls and the id that a result answers."""
    text = F.coalesce(df["text"], F.lit(""))
    role = F.coalesce(df["role"], F.lit("unknown"))
    rows = df.select("conv_id", "own", "turn", role.alias("role"), text.alias("text"))
    may = F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{")
    rows = rows.withColumn("v", F.when(may, F.try_parse_json("text")))
    rows = rows.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    raw = F.coalesce(get("v", "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))

    def call(c: Column, i: Column) -> Column:
        given = F.coalesce(get(c, "$.function.arguments", "variant"), get(c, "$.arguments", "variant"))
        args = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(get(given, "$", "string"))).otherwise(given)
        return F.struct(
            get(c, "$.id").alias("id"),
            F.coalesce(get(c, "$.function.name"), get(c, "$.name")).alias("name"),
            args.alias("arguments"),
            F.coalesce(get(c, "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("deps"),
            i.cast("int").alias("idx"),
        )

    calls = F.when(F.col("role") == "assistant", F.transform(raw, call)).otherwise(F.array().cast(f"array<{CALL}>"))
    answers = F.when(F.col("role") == "tool", get("v", "$.tool_call_id"))
    whole = F.col("v").isNull() | (F.size("calls") == 0) & F.col("answers").isNull()
    rows = rows.withColumn("calls", calls).withColumn("answers", answers)
    content = F.when(whole, F.col("text")).otherwise(F.coalesce(get("v", "$.content"), F.to_json(get("v", "$.content", "variant"))))
    return rows.select("conv_id", "own", F.coalesce("turn", F.lit(-1)).alias("turn"), "role", content.alias("content"), "calls", "answers")


def valid(call: Column, schemas: tuple[tuple[str, str, str, bool], ...]) -> Column:
    """Whether a call's arguments are an object with every required field and no field of a wrong type."""
    rule = "array<struct<tool:string,field:string,type:string,required:boolean>>"
    known = F.array(*(F.struct(*(F.lit(x) for x in s)) for s in schemas)).cast(rule) if schemas else F.array().cast(rule)
    fields = F.try_variant_get(call.arguments, "$", "map<string,variant>")

    def broken(s: Column) -> Column:
        kind = F.schema_of_variant(F.get(F.map_values(F.map_filter(fields, lambda k, _: k == s.field)), F.lit(0)))
        right = (
            F.when(s.type == "string", kind == "STRING")
            .when(s.type == "integer", kind == "BIGINT")
            .when(s.type == "number", kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
            .when(s.type == "boolean", kind == "BOOLEAN")
            .when(s.type == "array", kind.startswith("ARRAY"))
            .when(s.type == "object", kind.startswith("OBJECT"))
            .otherwise(True)
        )
        return F.when(kind.isNull(), s.required).otherwise(~right)

    wrong = F.exists(F.filter(known, lambda s: s.tool == call["name"]), broken)
    return F.coalesce(F.schema_of_variant(call.arguments).startswith("OBJECT") & ~wrong, F.lit(False))


ME = ["conv", "own", "id"]
NO_KEY = "struct<turn:bigint,idx:int,id:string>"


def call_key() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.col("idx").cast("int").alias("idx"), F.col("id").alias("id"))


def place(anchor: Column, level: Column, key: Column, after: int = 0) -> Column:
    """Where a message stands: its anchor (what it waits for longest), its distance to it, its own call; a result comes after that."""
    return F.struct(anchor.alias("anchor"), level.cast("int").alias("level"), key.alias("key"), F.lit(after).alias("after"))


def own_place(turn: Column) -> Column:
    key = F.struct(turn.alias("turn"), F.lit(0).alias("idx"), F.lit("").alias("id")).cast(NO_KEY)
    return place(key, F.lit(0), key)


def along_parents(parents: DataFrame, limit: int) -> DataFrame:
    """conv, own, id, key, parent, up, best; parents: conv, own, id, key, parent (or null). Written.

    best: of all calls from this one up its parents, itself included, the one with the greatest key, and its distance. The way is doubled in each
    round. ``up`` is left where the way does not end, so that it leads into a circle: after more than ``limit`` calls, the most that a conversation has.
    """
    t = written(parents.select(*ME, "key", "parent", F.col("parent").alias("up"), F.struct(F.col("key").alias("key"), F.lit(0).alias("dist")).alias("best")), "chat-ways")
    step = 1
    while step <= limit and not t.where("up IS NOT NULL").isEmpty():
        u = t.select("conv", "own", F.col("id").alias("up"), F.col("up").alias("further"), F.col("best").alias("above"))
        higher = F.col("above.key") > F.col("best.key")
        best = F.when(higher, F.struct(F.col("above.key").alias("key"), (F.col("above.dist") + step).alias("dist"))).otherwise(F.col("best"))
        after = written(t.join(u, ["conv", "own", "up"], "left").select(*ME, "key", "parent", F.col("further").alias("up"), best.alias("best")), "chat-ways")
        discard(t)
        t, step = after, 2 * step
    return t


def placed_calls(calls: DataFrame) -> DataFrame:
    """Each call with its place, which comes behind the places of all that it depends on, and whether it was a cycle's last one.

    The anchor is the last call, by turn, of all that a call depends on over any number of steps, or the call itself if none of them is later. Calls of one
    anchor go by their level, the longest way to it. Each call follows one parent, the dependency with the last anchor and the highest level;
    a chain of parents is resolved by doubling, in as many jobs as the logarithm of its length, and parents are chosen again until they stay.
    Where calls depend on themselves in a cycle, the last of them by turn depends on nothing.
    """
    calls = calls.withColumn("conv", F.coalesce("conv_id", F.lit(0)))
    key = call_key()
    unmoved = calls.withColumn("place", place(key, F.lit(0), key)).withColumn("cyclic", F.lit(False))
    if calls.where(F.size("deps") > 0).isEmpty():
        return unmoved.drop("conv")
    held = written(calls, "chat-calls")
    known = held.select("conv", "own", F.col("id").alias("need"))
    needs = held.select(*ME, F.explode(F.array_distinct("deps")).alias("need")).join(known, ["conv", "own", "need"])
    needs = written(needs, "chat-needs")
    limit = held.groupBy("conv", "own").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    now = written(held.select(*ME, key.alias("key"), key.alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("cyclic")), "chat-anchors")
    while True:
        bound = needs.join(now.where("NOT cyclic").select(*ME, "key"), ME)
        d = now.select("conv", "own", F.col("id").alias("need"), F.struct("anchor", "level", F.col("id").alias("parent")).alias("behind"))
        last = bound.join(d, ["conv", "own", "need"]).groupBy(*ME).agg(F.max("behind").alias("behind"), F.bool_or(F.col("behind.anchor") == F.col("key")).alias("closes"))
        x = now.join(last, ME, "left").withColumn("closes", F.coalesce("closes", F.lit(False)))
        waits = F.coalesce((F.col("behind.anchor") > F.col("key")) & ~F.col("closes"), F.lit(False))
        anchor, level = F.when(waits, F.col("behind.anchor")).otherwise(F.col("key")), F.when(waits, F.col("behind.level") + 1).otherwise(0)
        moved = F.col("closes") | (anchor != F.col("anchor")) | (level != F.col("level"))
        x = written(x.select(*ME, "key", (F.col("cyclic") | F.col("closes")).alias("cyclic"), moved.alias("moved"), F.when(~F.col("closes"), F.col("behind.parent")).alias("parent")), "chat-parents")
        if x.where("moved").isEmpty():
            discard(x)
            break
        t = along_parents(x, limit)
        up = t.select("conv", "own", F.col("id").alias("parent"), F.col("best.key").alias("round"))
        circle = F.col("up").isNotNull() & (F.col("round") == F.col("key"))  # the last call of a circle meets itself
        y = t.join(up, ["conv", "own", "parent"], "left").select(*ME, "key", "best", F.coalesce(circle, F.lit(False)).alias("circle"))
        after = y.join(x.select(*ME, "cyclic"), ME).select(*ME, "key", F.col("best.key").alias("anchor"), F.col("best.dist").alias("level"), (F.col("cyclic") | F.col("circle")).alias("cyclic"))
        after = written(after, "chat-anchors")
        discard(now, x, t)
        now = after
    out = held.join(now.select(*ME, "key", "anchor", "level", "cyclic"), ME)
    out = written(out.withColumn("place", place(F.col("anchor"), F.col("level"), F.col("key"))).drop("conv", "key", "anchor", "level"), "chat-places")
    discard(held, needs, now)
    return out


KEYS = ("conv_id", "own")
FIELDS = ("turn", "role", "message", "n_calls", "n_invalid", "linked", "orphan", "cyclic")


def alike(a: str, b: str, *more: str) -> Column:
    """Whether rows of two aliases belong to one conversation, and agree in more columns."""
    on = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.own") == F.col(f"{b}.own"))
    for c in more:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def numbered(rows: DataFrame) -> DataFrame:
    """Messages with ``position``, from 0, by place, turn, role and text within their conversation; written.

    Messages that are alike in everything are counted first and dealt out again at the end. A task adds up its rows of each
    conversation; what tasks before it hold is a running sum of these, few rows for each conversation.
    """
    order = [*KEYS, "place", *FIELDS]
    x = rows.groupBy(*order).agg(F.count("*").alias("n"))
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    x = written(x.withColumn("task", F.shiftright("at", 33)), "chat-sorted")
    own = Window.partitionBy(*KEYS, "task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*KEYS).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*KEYS, "task").agg(F.sum("n").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    x = x.withColumn("within", F.coalesce(F.sum("n").over(own), F.lit(0)))
    x = x.alias("x").join(sums.alias("s"), alike("x", "s", "task")).select("x.*", "s.before")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return x.select(*KEYS, (F.col("before") + F.col("within")).alias("first"), *FIELDS, copies.alias("copy")).select(*KEYS, (F.col("first") + F.col("copy")).alias("position"), *FIELDS)


def format_messages(df: DataFrame, schemas: tuple[tuple[str, str, str, bool], ...] = SCHEMAS) -> DataFrame:
    """One row per message: conv_id, own, position, turn, role, its canonical JSON, and what its calls and links are."""
    rows = parsed(own_conversations(df))
    calls = rows.where(F.size("calls") > 0).select("conv_id", "own", "turn", F.explode("calls").alias("c"))
    calls = calls.select("conv_id", "own", "turn", "c.id", "c.idx", "c.deps").where(F.col("id").isNotNull())
    first = calls.groupBy("conv_id", "own", "id").agg(F.min(F.struct("turn", "idx", "deps")).alias("f")).select("conv_id", "own", "id", "f.*")
    results = rows.where(F.col("answers").isNotNull()).groupBy("conv_id", "own", F.col("answers").alias("id")).agg(F.min("turn").alias("answered"))
    c, r = first.alias("c"), results.alias("r")
    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.own") == F.col("r.own")) & (F.col("c.id") == F.col("r.id"))
    links = placed_calls(c.join(r.hint("shuffle_hash"), same, "left").select("c.*", "answered"))
    # what moves a message: a linked result goes behind its call, a call behind its dependencies
    moves = links.where(F.col("answered").isNotNull()).select("conv_id", "own", F.col("answered").alias("turn"), F.col("id").alias("answers"), F.col("place").alias("behind"))
    moves = moves.unionByName(
        links.groupBy("conv_id", "own", "turn").agg(F.max("place").alias("behind"), F.max("cyclic").alias("cyclic")).withColumn("answers", F.lit(None).cast("string")),
        allowMissingColumns=True,
    )
    m, v = rows.alias("m"), moves.alias("v")
    on = F.col("m.conv_id").eqNullSafe(F.col("v.conv_id")) & (F.col("m.own") == F.col("v.own")) & (F.col("m.turn") == F.col("v.turn"))
    on = on & F.col("m.answers").eqNullSafe(F.col("v.answers")) & (F.col("m.answers").isNotNull() | (F.size("m.calls") > 0))
    x = m.join(v, on, "left").select("m.*", "behind", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    linked = F.col("answers").isNotNull() & F.col("behind").isNotNull()
    after = F.when(linked, F.col("behind").withField("after", F.lit(1))).when(F.col("behind").isNotNull(), F.col("behind")).otherwise(own_place(F.col("turn")))
    calls_out = F.transform("calls", lambda k: F.struct(k.arguments.alias("arguments"), k.id.alias("id"), k["name"].alias("name")))
    message = F.to_json(
        F.struct("content", "role", F.col("answers").alias("tool_call_id"), F.when(F.size("calls") > 0, calls_out).alias("tool_calls")),
    )
    x = x.select(
        *KEYS, after.alias("place"), "turn", "role", message.alias("message"), F.size("calls").cast("long").alias("n_calls"),
        F.size(F.filter("calls", lambda k: ~valid(k, schemas))).cast("long").alias("n_invalid"), linked.alias("linked"), (F.col("answers").isNotNull() & ~linked).alias("orphan"), "cyclic",
    )
    return numbered(x)


def chat_arrays(messages: DataFrame) -> DataFrame:
    """One row per conversation that fits one: counts, and ``chat``, the canonical JSON array of its messages."""
    out = messages.groupBy(*KEYS).agg(
        F.count("*").alias("n_messages"),
        F.sum("n_calls").alias("n_calls"),
        *(F.count_if(k).alias(f"n_{name}") for k, name in (("linked", "linked"), ("orphan", "orphans"), ("cyclic", "cyclic"))),
        F.sum("n_invalid").alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("position", "message"))).alias("entries"),
    )
    chat = F.concat(F.lit("["), F.array_join(F.transform("entries", lambda e: e.message), ","), F.lit("]"))
    return out.select("conv_id", "n_messages", "n_calls", "n_linked", "n_orphans", "n_invalid", "n_cyclic", chat.alias("chat"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation, with its position and canonical JSON."""
    return format_messages(table(spark, sf_dir, "conversations")).drop("own")


def with_calls(df: DataFrame) -> DataFrame:
    """Conversations in which five of six messages are replaced by tool calls and results, by their numbers.

    They hold valid and invalid arguments, linked results and orphans, dependencies on the call of the turn after (which move a call) and of
    the turn before, and cycles of the two.
    """
    kind = kind_of(F.col("conv_id"), F.col("turn"))
    turn, before, after = (F.concat(F.lit("i"), (F.col("turn") + d).cast("string")) for d in (0, -1, 1))
    call = lambda arguments, *deps: F.concat(
        F.lit('{"tool_calls": [{"id": "'), turn, F.lit('", "name": "search", "arguments": '), arguments, *(p for d in deps for p in (F.lit(', "depends_on": ["'), d, F.lit('"]'))), F.lit("}]}")
    )
    asks = F.concat(F.lit('{"query": "'), turn, F.lit('"}'))
    result = F.concat(F.lit('{"content": "r", "tool_call_id": "'), before, F.lit('"}'))
    text = F.when(kind == 0, F.col("text")).when(kind == 1, call(asks)).when(kind == 2, result).when(kind == 3, call(F.lit('{"limit": "x"}'))).when(kind == 4, call(asks, after)).otherwise(call(asks, before))
    role = F.when(kind == 0, F.col("role")).when(kind == 2, F.lit("tool")).otherwise(F.lit("assistant"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def kind_of(conv: Column, turn: Column) -> Column:
    """0: as it is, 1: a call, 2: a result, 3: a call with invalid arguments, 4: a call that needs the next one, 5: a call that needs the one before."""
    return (conv * 31 + turn * 17 + (conv + turn * turn) % 7) % 6


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the conversations with calls and results in place of messages."""
    return format_messages(with_calls(table(spark, sf_dir, "conversations"))).drop("own")


_PLAIN = """'{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, 'unknown'))::VARCHAR || '}'"""
OP10_SQL = f"""
WITH m AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, {_PLAIN} AS message FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn, role, message) - 1 AS position, turn, role, message,
  0::BIGINT AS n_calls, 0::BIGINT AS n_invalid, false AS linked, false AS orphan, false AS cyclic FROM m
"""
#: A run of calls that each need the next one comes out behind the call that ends it (and its result), last call first.
LINKS_SQL = f"""
WITH k AS (SELECT *, (conv_id * 31 + turn * 17 + (conv_id + turn * turn) % 7) % 6 AS kind FROM conversations),
n AS (SELECT a.*, coalesce(b.kind, 0) AS last, coalesce(c.kind, 0) AS next FROM k a LEFT JOIN k b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN k c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1),
p AS (SELECT *, kind = 2 AND last IN (1, 3, 4, 5) AS linked, kind = 4 AND next IN (1, 3, 4, 5) AS waits FROM n),
q AS (SELECT *, CASE WHEN linked THEN turn - 1 ELSE min(CASE WHEN NOT waits THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS e,
  CASE WHEN kind = 0 THEN {_PLAIN}
    WHEN kind = 2 THEN '{{"content":"r","role":"tool","tool_call_id":"i' || (turn - 1) || '"}}'
    ELSE '{{"role":"assistant","tool_calls":[{{"arguments":' || CASE WHEN kind = 3 THEN '{{"limit":"x"}}' ELSE '{{"query":"i' || turn || '"}}' END || ',"id":"i' || turn || '","name":"search"}}]}}' END AS message FROM p)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY e, CASE WHEN linked THEN 1 WHEN e = turn THEN 0 ELSE 1 + e - turn END) - 1 AS position, turn,
  CASE WHEN kind = 0 THEN role WHEN kind = 2 THEN 'tool' ELSE 'assistant' END AS role, message, (kind IN (1, 3, 4, 5))::BIGINT AS n_calls, (kind = 3)::BIGINT AS n_invalid,
  linked, kind = 2 AND NOT linked AS orphan, kind = 5 AND last = 4 AS cyclic FROM q
"""
