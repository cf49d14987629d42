"""Chat formatting over reply trees, by DataFrame functions only (operator 8).

A tree is a set of nodes (id, parent id, role, text, score). Root-to-leaf paths
come from iterative self-joins that double the known stretch above each node: a
node keeps its ancestor 2^k steps up, and the number and score of the nodes
between, so that a tree of depth n takes about log2(n) joins of one row a node.
The leaves of a tree are ranked by the mean score of their paths (ties: smaller
leaf id); only the paths of the first ``keep`` are written out, by the same jumps
from the longest to the shortest. Only ids and scores are joined, texts come in at
the end.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. A control string in a
role or text gets a backslash after its first character (and one more for each
level it already has), which unescaping takes away again; so no control string of
a text is left in the output and every text can be read back. The loss mask holds
the character spans of the assistant texts.

Defined results: null roles and texts are empty; a null tree is a tree like any
other; a node whose parent is missing is a root; nodes on a cycle have no root and
are on no path, nor are nodes below them; nodes without an id are left out; rows
that share tree and node are one node, the first by (parent, score, role, text),
nulls first; null scores count as 0; an empty table gives no rows; further columns
are ignored. In a plain conversation each row is a turn, equal rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import cut
from turnwise.session import table

# The template and the control strings that texts must not hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAIL = r"(\|(?:turn|text|end)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


_FIRST = "_first"


def _nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node: tree, node, parent, score, role, text."""
    one = nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias(_FIRST))
    return one.select("tree", "node", f"{_FIRST}.*")


def _jump(rows: DataFrame, table_: DataFrame, on: str, how: str = "inner", **names: str) -> DataFrame:
    """``rows`` joined with the node ``on`` of their tree in ``table_``, whose columns get the given names."""
    side = table_.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), *[F.col(c).alias(n) for c, n in names.items()])
    return rows.join(side, rows["tree"].eqNullSafe(side["_tree"]) & (rows[on] == side["_node"]), how).drop("_tree", "_node")


def paths(nodes: DataFrame, *, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, score, node, up (steps above the leaf) of the best ``keep`` paths, for (tree, node, parent, score)."""
    plain = cut(nodes.select("tree", "node", "parent", "score"), "nodes")
    some = _jump(plain, plain, "parent", "left", node="top")
    jumps = [cut(some.select("tree", "node", "top", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "jump")]
    most = plain.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(jumps) < 2 * most and not jumps[-1].where("top IS NOT NULL").isEmpty():  # what is open then hangs on a cycle
        last = jumps[-1]
        far = _jump(last.where("top IS NOT NULL"), last, "top", top="far", steps="more", total="add")  # only what is open moves
        far = far.select("tree", "node", F.col("far").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("add")).alias("total"))
        jumps.append(cut(last.where("top IS NULL").unionByName(far), "jump"))
    parents = plain.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = _jump(jumps[-1].where("top IS NULL"), parents, "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("score")).withColumn("rank", F.row_number().over(order))
    found = cut(ranked.where(F.col("rank") <= keep).select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "branches")
    for k in range(len(jumps) - 1, -1, -1):  # each ancestor once: its distance is a sum of distinct powers of two
        upper = _jump(found, jumps[k].where("top IS NOT NULL"), "node", top="above")
        found = found.unionByName(upper.select("tree", "leaf", "rank", "score", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up")))
        if k % 4 == 0:
            found = cut(found, "steps")
    return found


def formatted(nodes: DataFrame, *, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, score, n_turns, text, mask (from, length of assistant texts) of the best ``keep`` branches.

    ``nodes``: tree, node, parent, role, text, score.
    """
    own = cut(_nodes(nodes), "rows")
    full = _jump(paths(own, keep=keep), own, "node", role="role", text="text").withColumns({"er": escape(F.col("role")), "et": escape(F.col("text"))})
    turns = full.groupBy("tree", "leaf", "rank", "score").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("pos"), "er", "et", (F.col("role") == "assistant").alias("loss")))).alias("t")
    )
    fixed = len(TURN) + len(TEXT)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + fixed + F.length(x["er"])
        span = F.array(F.struct(begin.alias("from"), F.length(x["et"]).alias("length")))
        return F.struct((begin + F.length(x["et"]) + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return turns.select(
        "tree", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(F.lit(TURN), x["er"], F.lit(TEXT), x["et"], F.lit(END))), "").alias("text"),
        F.aggregate("t", start, step)["spans"].alias("mask"),
    )


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(text, r"<\|end\|>"), lambda x: x != "")

    def one(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        body = F.substr(x, F.length(role) + F.lit(len(TEXT) + 1))
        return F.struct(unescape(F.substr(role, F.lit(len(TURN) + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Plain conversations as trees of one branch: each turn answers the one before."""
    own = rows.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return own.withColumn("node", F.row_number().over(order)).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest, read back from the formatted conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
                                                    F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("r")).select("r.*")
    out = formatted(conversation_nodes(rows.unionByName(extra)))
    turns = F.transform(read_back(F.col("text")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("text"), m["from"] + 1, m["length"]))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size(read_back(F.col("text"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


_ESC = r"""regexp_replace(%s, '([<\[])(\\*)(\|(?:turn|text|end)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')"""
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{TURN}{TEXT}{END}') + length({_ESC % "role"}) + length({_ESC % "text"}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
