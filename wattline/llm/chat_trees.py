"""Chat formatting of reply trees with DataFrame operations only.

Messages point at their parents. Iterative self-joins double the pointers of every message (1, 2, 4, ... steps up), which
gives its root, depth and summed score in as many rounds as the depth has bits; leaves are ranked by score and the same
pointers, taken from the longest to the shortest, gather all ancestors of each chosen leaf. Every round deals rows by
message, holds no path as an array and is written to the shared folder.

The template marks a turn as `<|role|>text</s>`. Inside texts and roles a backslash becomes `\\e`, and the first character of
`<|`, `<s>`, `</s>`, `[INST]` and `[/INST]` becomes `\\l` or `\\b` (roles also hide `|` as `\\p`), so no text can hold a control
string and undoing `\\l`, `\\b`, `\\p`, `\\e` in this order gives back the text.

Edge cases: null texts and roles count as empty; a parent that doesn't exist makes its message a root; messages on a
cycle have no root and belong to no path; turns that repeat a number are ordered by role and text, and repeated rows are
turns of their own; a tree without messages gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialise, read_table

END = "</s>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\e")
    text = F.regexp_replace(text, r"<(?=\||/?s>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\b")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\|", r"\\p")


def unescape(text: Column) -> Column:
    for code, char in ((r"\l", "<"), (r"\b", "["), (r"\p", "|"), (r"\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def pointer_tables(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, depth, total) of every message that has a root, and the tables (node, up) of 1, 2, 4, ... steps."""
    known = messages.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    state = messages.join(known, "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"), F.col("score").alias("total"), F.col("node").alias("root"))
    # depth: steps from the message to `up`, or to the root where nothing is above; total: scores of the messages passed.
    # Only messages that haven't reached their root take part in a round; the others are looked up.
    state, tables, reached, open_before = materialise(state, "tree"), [], [], -1
    while (open_now := state.where("up is not null").count()) not in (0, open_before):  # what doesn't shrink hangs on a cycle
        open_before = open_now
        moving = state.where("up is not null")
        tables.append(moving.select("node", "up"))
        reached.append(state.where("up is null"))
        above = reduce(DataFrame.unionByName, reached, moving)
        above = above.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"), F.col("root").alias("root2"))
        joined = moving.join(above, "up")
        state = materialise(joined.select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"), F.col("root2").alias("root")), "tree")
    return reduce(DataFrame.unionByName, reached, state.where("up is null")).select("node", "root", "depth", "total"), tables


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages: tree, node, up, role, text, score. Rows (tree, rank, depth, role, text) of each tree's `best` paths from root
    to leaf by mean score, then depth, then leaf."""
    bones = materialise(messages.select("tree", "node", "up", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "bones")
    placed, tables = pointer_tables(bones.select("node", "up", "score"))
    placed = placed.join(bones.select("tree", "node"), "node")
    leaves = placed.join(bones.select(F.col("up").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    on_path = leaves.select("tree", "rank", "node")
    for table in reversed(tables):
        on_path = on_path.unionByName(on_path.join(table, "node").select("tree", "rank", F.col("up").alias("node")))
        on_path = materialise(on_path, "path")
    return on_path.join(placed.select("node", "depth"), "node").join(messages.select("node", "role", "text"), "node").select("tree", "rank", "depth", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row (tree, rank, formatted, mask) for each path; mask: the code point spans [start, start + length) to train on."""
    turn = F.struct("depth", F.concat(F.lit("<|"), escape_role("role"), F.lit("|>")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    turns = paths.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        span = F.array(F.struct(start.alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((start + F.length(t["body"]) + len(END)).alias("at"), F.when(t["trained"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return turns.select("tree", "rank", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), F.aggregate("turns", begin, add, lambda acc: acc["mask"]).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, taken from the strings and masks alone."""
    pieces = F.filter(F.split("formatted", END, -1), lambda x, i: x != "")
    parsed = F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(3)), "|>", 1)).alias("role"), unescape(F.substr(x, F.instr(x, F.lit("|>")) + 2)).alias("text")))
    trained = F.array_join(F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("parsed", parsed).withColumn("trained", trained)
    return out.select(
        "tree", "rank", F.size("parsed").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Each conversation as a tree with one branch: a turn replies to the turn before; a trained turn scores 1."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order)
    node = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("seq"))
    up = F.when(F.col("seq") > 1, F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("seq") - 1))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", seq)
    return rows.select(F.col("conv_id").alias("tree"), node.alias("node"), up.alias("up"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == TRAINED_ROLE, 1.0).otherwise(0.0).alias("score"))


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"), F.lit(said).alias("text"))
    trees = conversations_as_trees(conversations.unionByName(own))
    out = read_back(format_paths(chosen_paths(trees)))
    return out.withColumnRenamed("tree", "conv_id").drop("rank")
