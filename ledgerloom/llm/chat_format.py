"""Conversations from reply trees: root-to-leaf paths by self-joins, ranked by score, each formatted as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Fixed values of the template: role, what stands before a turn's text, what stands behind it.  Turns of other roles are
#: ANY[0] role ANY[1] text ANY[2].
TURNS = [("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"), ("system", "<<SYS>> ", " <</SYS>>")]
ANY = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: What a control string is without its first character.  Inside texts the mark stands between the two once more than
#: the text itself has it there, so texts never hold a control string and get back exactly.
TAILS = r"/?INST\]|/?ROLE\]|TEXT\]|/?s>|<SYS>>|</SYS>>"
MARK = "⁠"
ONE_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE\].*?\[/ROLE\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])({MARK}*)({TAILS})", rf"$1$2{MARK}$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<]){MARK}({MARK}*)({TAILS})", "$1$2$3")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(ANY[0]), escaped(role), F.lit(ANY[1]))
    for name, before, _ in TURNS:
        out = F.when(role == name, F.lit(before)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(ANY[2])
    for name, _, behind in TURNS:
        out = F.when(role == name, F.lit(behind)).otherwise(out)
    return out


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, depth, node: the messages of the ``branches`` best root-to-leaf paths of every tree (None: of all).

    ``messages(tree, node, parent, score)``, one row a (tree, node).  A message whose parent is not there is a root; what
    hangs on a cycle has no root and is in no path.  A path's score is the mean of its messages' (null: 0), equal ones rank
    by leaf.

    Round k joins the ancestor 2^k above of every message that has one with that one's own, which gives depths, sums of scores and a table
    of jumps; the chosen leaves then go down the tables, and each round adds the messages 2^k above those it has.  So
    rounds are the logarithm of the longest path, ids alone are shuffled, and only chosen paths are written out.
    """
    known = messages.select("tree", F.col("node").alias("parent"))
    links = cut(messages.join(known.withColumn("_there", F.lit(True)), ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps: list[DataFrame] = []
    # steps and total: how many messages lie from the node to below "up" (or to its root), and the sum of their scores
    now = links.withColumn("steps", F.lit(1).cast("long")).withColumnRenamed("score", "total")
    open_ = now.where("up is not null")
    while largest >> len(jumps) and not open_.isEmpty():
        jumps.append(open_.select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        higher = open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        now = cut(higher.unionByName(now.where("up is null")))
        open_ = now.where("up is not null")
    ends = now.where("up is null").join(links.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), "node")
    chosen = ends.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    found = cut(chosen.select("tree", F.col("node").alias("leaf"), "rank", (F.col("steps") - 1).alias("depth"), "node"))
    for k in range(len(jumps) - 1, -1, -1):
        higher = found.join(jumps[k], ["tree", "node"]).select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        found = cut(found.unionByName(higher))  # else each round would plan the one before twice
    return found


def chat_format(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree_id, rank, formatted, loss_spans: a row for each chosen root-to-leaf path of ``messages(tree_id, message_id,
    parent_id, role, text, score)``.

    loss_spans lists (start from 1, length) in code points of the assistant's texts in ``formatted``.  Null role and text
    are ''; null ids are values like others; of rows with one (tree_id, message_id) the least by parent, role and text
    counts; messages on or behind a cycle are in no path.  Texts are formatted whole.  No messages, no rows.  Extra
    columns are ignored.  A path is one row, so it meets in one task, as its text has to.
    """
    rows = messages.select(
        F.coalesce(F.col("tree_id").cast("string"), F.lit("null")).alias("tree"), F.coalesce(F.col("message_id").cast("string"), F.lit("null")).alias("node"),
        F.struct(F.col("parent_id").cast("string").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score").alias("m"),
        F.col("tree_id"))
    rows = cut(rows.groupBy("tree", "node").agg(F.min("m").alias("m"), F.first("tree_id").alias("tree_id")).select("tree", "node", "tree_id", "m.*"))
    return formatted(paths(rows.select("tree", "node", "parent", "score"), branches).join(rows.select("tree", "node", "tree_id", "role", "text"), ["tree", "node"]))


def formatted(turns: DataFrame) -> DataFrame:
    """tree_id, rank, formatted, loss_spans of ``turns(tree, leaf, rank, depth, tree_id, role, text)``."""
    role = F.col("role")
    turns = turns.withColumn("before", opening(role)).withColumn("inside", escaped(F.col("text"))).withColumn("behind", closing(role))
    turn = F.struct("depth", (F.col("role") == "assistant").alias("loss"), "before", "inside", "behind")
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.first("tree_id").alias("tree_id"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda done, t: F.struct(
            (done.at + F.char_length(t.before) + F.char_length(t.inside) + F.char_length(t.behind)).cast("long").alias("at"),
            F.when(t.loss, F.concat(done.spans, F.array(F.struct((done.at + F.char_length(t.before)).cast("long").alias("start"), F.char_length(t.inside).cast("long").alias("length")))))
            .otherwise(done.spans).alias("spans")),
        lambda done: done.spans)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.before, t.inside, t.behind)), "")
    return whole.select("tree_id", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (role, text) as its formatted text says, and learned, the text under its loss spans."""

    def parsed(turn):
        role, text = F.substring_index(F.substr(turn, F.lit(len(ANY[0]) + 1)), ANY[1], 1), None
        head = F.lit(len(ANY[0]) + len(ANY[1])) + F.char_length(role)
        text = F.substr(turn, head + 1, F.char_length(turn) - head - len(ANY[2]))
        out = F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
        for name, before, behind in TURNS:
            text = F.substr(turn, F.lit(len(before) + 1), F.char_length(turn) - len(before) - len(behind))
            out = F.when(turn.startswith(before), F.struct(F.lit(name).alias("role"), unescaped(text).alias("text"))).otherwise(out)
        return out

    learned = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s.start.cast("int"), s.length.cast("int"))))
    turns = F.transform(F.regexp_extract_all("formatted", F.lit(ONE_TURN), F.lit(0)), parsed)
    return chats.withColumn("turns", turns).withColumn("learned", F.array_join(learned, ""))


def chains(conversations: DataFrame) -> DataFrame:
    """Reply trees of ``conversations(conv_id, turn, role, text)``: each row answers the one before it, by turn, role, text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("message_id", at.cast("long"))
    return rows.select(F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op13(spark, sf_dir):
    """Every conversation, and conversation -1, which says nothing but control strings; digests of what is read back."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    back = read_back(chat_format(chains(rows)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SHAPES = " ".join(f"when '{role}' then {len(before) + len(behind)}" for role, before, behind in TURNS)
_ESCAPED = rf"regexp_replace(%s, '([\[<])({MARK}*)({TAILS})', '\1\2{MARK}\3', 'g')"
OP13_SQL = rf"""
with said as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from said),
sized as (
  select *, length({_ESCAPED % "text"})
    + case role {_SHAPES} else {sum(map(len, ANY))} + length({_ESCAPED % "role"}) end as chars from rows
),
joined as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as told,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as learned, sum(chars)::bigint as formatted_chars
  from sized group by conv_id
)
select conv_id, n_turns, sha256(told) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars from joined
"""
