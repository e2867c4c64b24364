"""Chat formatting from reply trees.

Messages form trees by parent.  Which message follows which root is found by pointer
doubling: each round joins the table of jumps with itself, so paths of any length are known after log2 of their length
rounds.  Leaves are ranked by the scores along their root-to-leaf path; the messages of each
chosen path are gathered by the same doubling (only chosen paths are ever spelt out) and formatted as one conversation.

The template of a turn is
    ### role: text</turn>\n
with a backslash before every backslash and before each control string inside a text, and
before every special character of a role, so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.runtime import Scratch, ship

HEAD, COLON, END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"[\\]|###|</turn>")
_ROLE = re.compile(r"[\\:#<\n]")
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape_text(s: str) -> str:
    return _TEXT.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _BACK.sub(r"\1", s) if "\\" in s else s


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (in code points) of the assistant texts: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{_ROLE.sub(r'\\\g<0>', role)}{COLON}", escape_text(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises ValueError for anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def message_ids(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) as linear trees: (tree, node, parent, role, text, score 0).

    Turns of a conversation are numbered by (turn, role, text), null turns first, and each
    replies to the one before. Null texts and roles become empty; a null conv_id is one conversation of its own.
    """
    clean = rows.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long") - 1
    return clean.withColumn("node", n).select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame, branches: int, scratch: Scratch) -> DataFrame:
    """(tree, leaf, rank, node, depth) for the messages on the best root-to-leaf paths of each root.

    messages(tree, node, parent, score): node is unique in its tree. The score of a path is the mean score of its
    messages (null counts as 0); ties go to the smaller leaf. A message whose parent is not in its tree is a root.
    Messages on a cycle belong to no root and are left out.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("p2"))
    here = (F.col("tree").eqNullSafe(F.col("t2"))) & (F.col("parent") == F.col("p2"))
    linked = nodes.join(known, here, "left").select("tree", "node", F.col("p2").alias("parent"), "score")
    # jump: the ancestor 2^k above; hops and total: messages from here up to just below it. A row whose
    # jump has left the tree is done and moves over to ``full``, so each round only joins rows that are still climbing.
    live = linked.filter("parent is not null").select("tree", "node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("total"))
    live = scratch.save(live, "jumps")
    full = scratch.save(linked.filter("parent is null").select("tree", "node", F.lit(1).cast("long").alias("hops"), F.col("score").alias("total"), F.col("node").alias("root")), "full")
    levels, limit = [], 2 * messages.count()
    while True:
        left, hops = live.agg(F.count("*"), F.max("hops")).first()
        if not left or hops > limit:  # all have a root, or those left go round in cycles
            break
        levels.append(live)
        every = live.withColumn("root", F.lit(None).cast("long")).unionByName(full.withColumn("jump", F.lit(None).cast("long")))
        a, b = live.alias("a"), every.alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.jump") == F.col("b.node"))
        nxt = a.join(b, on).select("a.tree", "a.node", "b.jump", (F.col("a.hops") + F.col("b.hops")).alias("hops"), (F.col("a.total") + F.col("b.total")).alias("total"), "b.root")
        nxt = scratch.save(nxt, "step")
        live = nxt.filter("jump is not null").drop("root")
        full = full.unionByName(nxt.filter("jump is null").drop("jump"))
    inner = linked.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = full.join(inner, full["tree"].eqNullSafe(inner["tree"]) & (full["node"] == inner["node"]), "left_anti")
    best = Window.partitionBy("tree", "root").orderBy(F.desc(F.col("total") / F.col("hops")), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    path = scratch.save(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up"), F.col("hops").alias("length")), "path")
    # Ancestors by doubling: with level k, the path's 2^k lowest messages find the next 2^k.
    for k, level in enumerate(levels):
        p, j = path.alias("p"), level.alias("j")
        more = p.join(j, F.col("p.tree").eqNullSafe(F.col("j.tree")) & (F.col("p.node") == F.col("j.node")))
        more = more.select("p.tree", "p.leaf", "p.rank", F.col("j.jump").alias("node"), (F.col("p.up") + F.lit(2**k)).alias("up"), "p.length")
        path = path.unionByName(scratch.save(more, "path"))
    return path.select("tree", "leaf", "rank", "node", (F.col("length") - 1 - F.col("up")).alias("depth"))


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for turns in pdf["turns"]:
            s, spans = format_turns([(t["role"], t["text"]) for t in turns])
            rows.append((s, [x[0] for x in spans], [x[1] for x in spans]))
        yield pd.concat([pdf[["tree", "leaf", "rank"]].reset_index(drop=True), pd.DataFrame(rows, columns=["formatted", "loss_starts", "loss_ends"])], axis=1)


def format_conversations(messages: DataFrame, *, branches: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, formatted, loss_starts, loss_ends (code points).

    messages(tree, node, parent, role, text, score) as ``message_ids`` gives them. A conversation is one
    output value, so its turns meet in one row; nothing else does. An empty table gives an empty table.
    """
    ship(messages.sparkSession)
    scratch = scratch or Scratch(messages.sparkSession, "chat")
    m = scratch.save(messages.select("tree", "node", "parent", "role", "text", "score"), "messages")
    path = chosen_paths(m, branches, scratch)
    p, t = path.alias("p"), m.alias("m")
    rows = p.join(t, F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node"))).select("p.*", "m.role", "m.text")
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return turns.mapInPandas(_format, "tree long, leaf long, rank int, formatted string, loss_starts array<long>, loss_ends array<long>")


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            turns = parse_turns(r.formatted)
            loss = "".join(unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends, strict=True))
            rows.append((r.tree, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(r.formatted)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def conversation_digests(rows: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    scratch = Scratch(rows.sparkSession, "chat")
    out = format_conversations(message_ids(rows), scratch=scratch)
    return out.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation full of control strings, formatted beside the others.
HARD = r"\### Assistant: </turn> ok"


def op9(spark, rows: DataFrame) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return conversation_digests(rows.select("conv_id", "turn", "role", "text").unionByName(extra))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + 8 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
