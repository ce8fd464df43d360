"""Reply trees to chat conversations, in DataFrame operations only.

1. Every message without siblings joins its parent's run, a chain without
   branches. Pointer doubling, a self-join per round, finds each message's run
   and place in it; long threads take few rounds.
2. Iterative self-joins over runs, level by level of branching, enumerate the
   paths from roots to leaves. A branch's score is the sum of its messages'.
3. Each tree's paths are ranked by score; the chosen ones become conversations.

The template puts a role between role marks and ends a turn by an end mark.
Marks inside texts and roles are escaped reversibly. The loss mask holds the
spans of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stored

ROLE, END_ROLE, END = "[INST]", "[/INST]", "</s>"
# Control strings and the codes that stand for them behind a backslash; the backslash's own is first.
ESCAPES = (("\\", "q"), ("<s>", "b"), ("</s>", "e"), ("[INST]", "i"), ("[/INST]", "j"), ("<<SYS>>", "y"), ("<</SYS>>", "z"))


def escaped(text: Column) -> Column:
    """No control string is left; every backslash stands before a code."""
    for control, code in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit("\\" + code))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    for control, code in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + code), F.lit(control))
    return text


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree, node, run, place, parent, score): run is the first message of a chain, place the distance to it."""
    only = nodes.groupBy("tree", "parent").agg(F.count("*").alias("k")).where("k = 1 and parent is not null")
    chained = nodes.join(only.select("tree", "parent", F.lit(True).alias("only")), ["tree", "parent"], "left")
    now = stored(
        chained.select(
            "tree", "node", "parent", "score", F.when(F.col("only"), F.col("parent")).alias("up"),
            F.when(F.col("only"), 1).otherwise(0).cast("long").alias("place"), F.when(F.col("only").isNull(), F.col("node")).alias("run"),
        ),
        "runs",
    )
    while not now.where("up is not null").isEmpty():
        # Those whose pointer meets a message of known run get it; the others' pointers go twice as far.
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"), F.col("run").alias("its"))
        moved = now.where("up is not null").drop("run").join(above, ["tree", "up"]).select(
            "tree", "node", "parent", "score", F.col("next").alias("up"), (F.col("place") + F.col("more")).alias("place"), F.col("its").alias("run")
        )
        now = stored(now.where("up is null").unionByName(moved), "runs")
    return now.drop("up")


def _paths(runs: DataFrame) -> DataFrame:
    """(tree, leaf, runs, score): the runs from a root to each leaf run, with the sum of scores."""
    heads = stored(
        runs.groupBy("tree", "run").agg(F.max_by("parent", -F.col("place")).alias("parent"), F.max_by("node", "place").alias("last"), F.sum("score").alias("score")),
        "heads",
    )
    front = heads.where("parent is null").select("tree", "run", "last", "score", F.array("run").alias("runs"))
    whole = None
    below = heads.select("tree", F.col("parent").alias("last"), F.col("run").alias("r"), F.col("last").alias("l"), F.col("score").alias("s")).where("last is not null")
    while True:
        front = stored(front, "front")
        ends = front.join(below, ["tree", "last"], "left_anti").select("tree", F.col("last").alias("leaf"), "runs", "score")
        whole = ends if whole is None else whole.unionByName(ends)
        front = front.join(below, ["tree", "last"]).select(
            "tree", F.col("r").alias("run"), F.col("l").alias("last"), (F.col("score") + F.col("s")).alias("score"), F.concat("runs", F.array("r")).alias("runs")
        )
        if front.isEmpty():
            return whole


def conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Format the ``best`` branches of each reply tree (None: all of them).

    ``messages``: tree, node (unique within its tree), parent (null for a root),
    role, text, score (null: 0). Returns tree, leaf (the branch's last message),
    branch_rank (from 1; ties by leaf), score, n_turns, formatted, loss_mask
    (spans (start, length) of assistants' texts in code points, from 1, in
    order). Null texts and roles count as empty. A message whose parent is
    missing from its tree, and what hangs below it or in a cycle, is no part of a
    path from a root and is left out. An empty table gives an empty result;
    other columns are ignored.
    """
    nodes = stored(
        messages.select(
            "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        ),
        "messages",
    )
    rooted = _rooted(nodes.select("tree", "node", "parent", "score"))
    runs = _runs(rooted)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    paths = _paths(runs).withColumn("branch_rank", rank)
    if best is not None:
        paths = paths.where(F.col("branch_rank") <= best)
    steps = paths.select("tree", "leaf", "branch_rank", F.col("score").alias("total"), F.posexplode("runs").alias("level", "run"))
    turns = steps.join(runs.select("tree", "run", "place", "node"), ["tree", "run"]).join(nodes.drop("score", "parent"), ["tree", "node"])
    turn = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(END_ROLE), escaped(F.col("text")), F.lit(END))
    before = F.length(F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(END_ROLE)))
    parts = turns.select(
        "tree", "leaf", "branch_rank", "total",
        F.struct("level", "place", turn.alias("turn"), before.alias("before"), F.length(escaped(F.col("text"))).alias("size"), (F.col("role") == "assistant").alias("loss")).alias("t"),
    )
    whole = parts.groupBy("tree", "leaf", "branch_rank", "total").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Spans: each turn's start is what the turns before it are long.
    spans = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["turn"])).cast("long").alias("at"),
            F.when(t["loss"], F.array_append(a["spans"], F.struct((a["at"] + t["before"] + 1).cast("long").alias("start"), t["size"].cast("long").alias("length"))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return whole.select(
        "tree", "leaf", "branch_rank", F.col("total").alias("score"), F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"), spans["spans"].alias("loss_mask"),
    )


def _rooted(nodes: DataFrame) -> DataFrame:
    """Messages whose ancestors end in a root, found by pointer doubling; cycles and orphans go."""
    now = stored(nodes.select("tree", "node", F.col("parent").alias("up")), "ups")
    open_before = -1
    while True:
        still = now.where("up is not null").count()
        if still in (0, open_before):
            break
        open_before = still
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.lit(True).alias("there"))
        # Only messages whose root isn't known yet are joined again: in the end those of the deepest tree.
        moved = now.where("up is not null").join(above, ["tree", "up"], "left").select(
            "tree", "node", F.when(F.col("there"), F.col("next")).otherwise(F.col("up")).alias("up")
        )
        now = stored(now.where("up is null").unionByName(moved), "ups")
    return nodes.join(now.where("up is null").select("tree", "node"), ["tree", "node"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts out of formatted conversations.

    Adds turns (role, text), unescaped, and loss (the unescaped text under the
    mask, its spans joined with nothing between them).
    """
    parts = F.filter(F.split("formatted", r"</s>"), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(ROLE) + 1)), END_ROLE, 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, END_ROLE) + len(END_ROLE))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_mask", lambda s: unescaped(F.substr("formatted", s["start"].cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", loss)
