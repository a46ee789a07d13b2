"""Chat formatting of reply trees.

Messages form trees by parent. Paths from root to leaf are enumerated by iterative self-joins that double their reach:
after k joins every leaf knows its nearest 2**k ancestors, so a chain of n turns takes log2(n) joins. Each path scores
the mean of its messages' scores; the best `top` of a conversation are formatted, each as one conversation with a mask
over its assistant texts. Everything is DataFrame functions.

Template, for each turn: <|im_start|>role, newline, text, <|im_end|>, newline. In texts and roles each control string
gets a backslash after its first character (one more, if it has some), which unescape() takes away again; in roles,
newlines and backslashes are written as \\n and \\s.

Null texts and roles are empty. Rows that repeat a turn of a conversation all stay, ordered by role and text. Null
conv_ids are one conversation; null turns come first. A parent that isn't there makes its message a root. Messages
on a cycle, or below one, have no root and belong to no path. Of rows that repeat a node, the one with the smallest
parent, role and text stays. Branches of equal score rank by leaf. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm import shared

#: Strings that a text must not bring into the output (fixed values).
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # an escaped role has no backslash but before s or n
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def paths(messages: DataFrame) -> DataFrame:
    """leaf, node and dist (0 at the leaf) of all root-to-leaf paths of messages(node, parent)."""
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent")).distinct()
    # a parent that isn't there counts as none
    reach = [shared.materialise(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up")), "reach")]
    leaves = nodes.join(reach[0].select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    total = nodes.count()
    # reach[k] holds who stands 2**k above whom: at most a row for each node, and none above a root
    while not reach[-1].isEmpty() and 2 ** (len(reach) - 1) <= total:
        far = reach[-1].select(F.col("node").alias("up"), F.col("up").alias("top"))
        reach.append(shared.materialise(reach[-1].join(far, "up").select("node", F.col("top").alias("up")), "reach"))
    # who still has someone above after as many steps as there are nodes hangs on a cycle
    found = leaves.join(reach.pop(), "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).alias("dist"))
    for k, up in enumerate(reach):
        more = found.join(up, "node").select("leaf", F.col("up").alias("node"), (F.col("dist") + 2**k).alias("dist"))
        found = shared.materialise(found.unionByName(more), "paths")
    return found


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """conv_id, leaf, score, n_turns, formatted and loss (spans of assistant texts, in code points of formatted).

    messages: conv_id, node, parent (null at a root), role, text, score. A branch scores the mean of its messages'
    scores (null ones left out). top: how many branches of each conversation are formatted, best first.
    """
    first = F.min(F.struct("parent", "role", "text", "conv_id", "score")).alias("m")
    messages = shared.materialise(messages.groupBy("node").agg(first).select("node", "m.*"), "messages")
    on_path = paths(messages)
    said = messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    turn = F.struct((-F.col("dist")).alias("at"), "role", "text")
    whole = on_path.join(said, "node").groupBy("leaf").agg(F.first("conv_id").alias("conv_id"), F.avg("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    if top is not None:
        best = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
        whole = whole.withColumn("_rank", best).filter(F.col("_rank") <= top).drop("_rank")
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    whole = whole.withColumn("_parts", parts)
    walk = F.aggregate(
        "_parts",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE)).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("lo"), (a["at"] + F.length(p["head"]) + F.length(p["text"])).alias("hi"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "")
    return whole.select("conv_id", "leaf", "score", F.size("turns").cast("bigint").alias("n_turns"), formatted.alias("formatted"), walk["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(OPEN)))
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))


def chain(turns: DataFrame) -> DataFrame:
    """Messages from rows (conv_id, turn, role, text): each answers the one before it in its conversation, and scores its length."""
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.withColumn("at", F.row_number().over(at))
    node = lambda n: F.struct("conv_id", n.alias("at"))
    return numbered.select("conv_id", node(F.col("at")).alias("node"), F.when(F.col("at") > 1, node(F.col("at") - 1)).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    told = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = told.union(spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string"))
    done = shared.materialise(format_trees(chain(told), top=1), "chats")
    read = done.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")})
    digest = F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), digest.alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
