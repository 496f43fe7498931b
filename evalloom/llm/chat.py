"""Reply trees to conversations: root-to-leaf paths, branch ranks and a reversible chat template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, table

#: The template's own marks.
OPEN, MID, CLOSE = "<|turn|>", "<|says|>", "<|over|>"
#: Control strings that a text must not carry as they are: those above and other templates' (after the first character).
_REST = r"\||/?s>|/?INST\]|</?SYS>>"


def escape(s: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), rf"([<\[])({_REST})", r"$1\\$2")


def unescape(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, rf"([<\[])\\({_REST})", "$1$2"), r"\\\\", r"\\")


def paths(nodes: DataFrame, scratch: Scratch, top_k: int = 1) -> DataFrame:
    """(tree, leaf, node, at): the nodes of the ``top_k`` best root-to-leaf paths of every tree, root at 1.

    ``nodes`` is (tree, node, parent, score). Self-joins double every node's jump towards its root, so a
    path of d replies takes log2(d) joins, and carry the scores' sum and the depth along. Branches rank by
    mean score, then by the smaller leaf. A chosen leaf's ancestors are listed by the same jumps. Only
    ids and scores travel. A row whose parent is missing is a root; replies in a circle are an error.
    """
    named = nodes.select(F.col("tree"), F.col("node").alias("_up"))
    up = nodes.select("tree", "node", F.col("parent").alias("_up"), F.coalesce(F.col("score"), F.lit(0.0)).alias("sum")).join(named.withColumn("_is", F.lit(True)), ["tree", "_up"], "left")
    up = scratch.pin(up.select("tree", "node", F.when(F.col("_is"), F.col("_up")).alias("up"), "sum", F.lit(1).cast("long").alias("depth")))
    parents = up.select("tree", F.col("up").alias("node")).where(F.col("node").isNotNull()).distinct()
    jumps, ended = [], None
    while True:
        root = up.where(F.col("up").isNull())
        ended = root if ended is None else ended.unionByName(root)
        going = up.where(F.col("up").isNotNull())
        if going.isEmpty():
            break
        jumps.append(going.select("tree", "node", "up"))
        if len(jumps) > 40:
            raise ValueError("replies in a circle")
        far = ended.unionByName(going).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        # only nodes still short of their root take part
        up = scratch.pin(going.join(far, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("depth") + F.col("_depth")).alias("depth")))
    up = ended
    leaves = up.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "depth", (F.col("sum") / F.col("depth")).alias("score"))
    if top_k == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("score")).alias("s"), "leaf", "depth")).alias("b")).select("tree", "b.leaf", "b.depth")
    else:
        rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
        best = leaves.withColumn("_r", rank).where(F.col("_r") <= top_k).select("tree", "leaf", "depth")
    on = scratch.pin(best.select("tree", "leaf", F.col("leaf").alias("node"), F.col("depth").alias("at")))
    for k, jump in enumerate(jumps):
        above = on.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))
        on = scratch.pin(on.unionByName(above))
    return on


def render(turns: Column) -> Column:
    """One string from an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID), escape(t["text"]), F.lit(CLOSE))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, length) in code points of each ``role`` text in the rendered string, without its marks."""
    head, body = len(OPEN) + len(MID), len(CLOSE)
    sized = F.transform(turns, lambda t: F.struct((F.length(escape(t["role"])) + head).alias("h"), F.length(escape(t["text"])).alias("n"), (t["role"] == role).alias("on")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("got"))
    step = lambda a, x: F.struct(
        (a["at"] + x["h"] + x["n"] + body).alias("at"),
        F.when(x["on"], F.concat(a["got"], F.array(F.struct((a["at"] + x["h"]).alias("start"), x["n"].alias("n"))))).otherwise(a["got"]).alias("got"),
    )
    return F.aggregate(sized, zero, step)["got"]


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that ``render`` was given."""
    parts = F.filter(F.split(formatted, r"<\|over\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MID, 1)).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)^<\|turn\|>.*?<\|says\|>", "")).alias("text"),
    ))


def conversations_to_chats(rows: DataFrame, top_k: int = 1) -> DataFrame:
    """``conv_id, formatted, loss`` of each chosen path of rows (conv_id, turn, role, text).

    A row replies to the one before it by turn (null turns first, then by role and text), so repeated
    turns follow each other. Null role or text is empty; a null conv_id is one conversation.
    """
    scratch = Scratch(rows.sparkSession, "chat")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    r = r.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = scratch.pin(r)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    chosen = paths(r.select("tree", "node", parent.alias("parent"), F.lit(0.0).alias("score")), scratch, top_k)
    turns = chosen.join(r, ["tree", "node"]).groupBy("conv_id", "tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    return turns.select("conv_id", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted chats alone."""
    d = chats.withColumns({
        "_t": read_back(F.col("formatted")),
        "_loss": F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["n"]))), ""),
    })
    return d.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat(spark, sf_dir):
    """All conversations and conversation -1, whose turns both hold another template's control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", say), (-1, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    return digest(conversations_to_chats(rows.unionByName(extra)))


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS rl, coalesce("text", '') AS tx FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(rl) + length(tx) + 24 + (length(rl || tx) - length(replace(rl || tx, '\', ''))) + len(regexp_extract_all(tx, '[<\[](\||/?s>|/?INST\]|</?SYS>>)')) + len(regexp_extract_all(rl, '[<\[](\||/?s>|/?INST\]|</?SYS>>)')) AS n FROM r),
l AS (SELECT conv_id, string_agg(rl || chr(10) || tx || chr(10), '' ORDER BY turn, rl, tx) t, coalesce(string_agg(CASE WHEN rl = 'assistant' THEN tx END, '' ORDER BY turn, rl, tx), '') a, count(*) k, sum(n) n FROM e GROUP BY conv_id)
SELECT conv_id, k AS n_turns, sha256(t) AS turns_sha256, length(a) AS loss_chars, sha256(a) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM l
"""
