"""Dropping lines whose template recurs across documents.

Lines are parsed by a log-template tree (after He et al., "Drain", 2017): the first level is the number of tokens, the next
DEPTH levels are the leading tokens, with tokens that hold digits generalised.  A leaf may hold several templates.  A template keeps a
token at a position where most lines of its group have it; other positions are variable fields.  A line belongs to the
template if enough of its tokens agree with it; lines that do not go on to smaller groups by a
token that they share (``templates_of``).  Everything is counted over all documents by grouped sums and does not
depend on the order of lines, so no leaf is ever gathered into one task.

Most lines are alone in their leaf or equal to all others there, so that the line is the template: tokens are looked at again only for the
distinct lines of the other leaves.

Of a template that occurs in several documents the first line (smallest doc_id, then
line number) stays and all other occurrences go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.runtime import Scratch, free_name, ship

DEPTH = 4  # leading tokens that choose the leaf
MIN_DOCS = 2  # documents that make a template recurrent
SIMILAR = 0.7  # share of a line's tokens that agree with its group's template
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """Tokens between runs of ASCII white space, those with digits generalised."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes_of(tokens: list[bytes]) -> tuple[int, int]:
    """Leaf and whole line."""
    head = b" ".join([b"%d" % len(tokens), *tokens[:DEPTH]])
    return _signed(xxhash.xxh64_intdigest(head, 1)), _signed(xxhash.xxh64_intdigest(b" ".join(tokens), 2))


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the lines that hold a token; all tokens of a short line are its leaf."""
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                tokens = tokens_of(line)
                if tokens:
                    rows.append((doc_id, k, *hashes_of(tokens)))
        yield pd.DataFrame(rows, columns=["doc_id", "line_no", "leaf", "line"])


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token hashes of the wanted lines of each text."""
    for pdf in batches:
        rows = []
        for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            for w in wanted:
                tokens = tokens_of(lines[w["line_no"]]) if w["line_no"] < len(lines) else []
                if hashes_of(tokens) == (w["leaf"], w["line"]):  # else it is a line of another row with this doc_id
                    rows.append((w["leaf"], w["line"], [_signed(xxhash.xxh64_intdigest(t)) for t in tokens]))
        yield pd.DataFrame(rows, columns=["leaf", "line", "tokens"])


def templates_of(found: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """(leaf, line, template) of the lines that agree with a majority of their group; others are templates by themselves.

    ``found`` has (leaf, line, n, lo, hi, tokens): a line, its occurrences, its first and last document. Groups are the leaves at
    first. Lines that agree with their group's majority have found their template. Every other line goes on to the group of those
    that share its anchor: of its tokens that not all of the group have, the one that most have (ties: the first position).
    A group is smaller than the one before it, so this ends; a line leaves when no other line has its anchor or
    its group lies within one document.
    """
    rest, done, last, line = found.withColumn("group", F.col("leaf")), [], None, ["leaf", "line"]
    while True:
        groups = rest.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("lo").alias("first"), F.max("hi").alias("top"))
        groups = groups.filter("kinds > 1 and first < top").select("group", "total", F.xxhash64("group").alias("h"))
        live = scratch.save(rest.withColumn("h", F.xxhash64("group")).join(groups, ["group", "h"]).drop("h"), "live")
        if last is not None:
            scratch.drop(last)
        if live.isEmpty():
            break
        words = live.select("group", *line, "n", "total", F.posexplode("tokens").alias("at", "token"))
        have = words.groupBy("group", "at", "token", "total").agg(F.sum("n").alias("have"), F.count("*").alias("kinds"))
        # A token of a single line is no anchor, and counts only if it is the majority.
        have = have.filter((F.col("kinds") > 1) | (2 * F.col("have") > F.col("total"))).withColumn("h", F.xxhash64("group")).drop("total")
        seen = words.withColumn("h", F.xxhash64("group")).join(have, ["group", "at", "token", "h"])
        anchor = F.when((F.col("have") < F.col("total")) & (F.col("kinds") > 1), F.struct("have", (-F.col("at")).alias("minus"), "token"))
        seen = seen.groupBy(*line).agg(F.count_if(2 * F.col("have") > F.col("total")).alias("agree"), F.max(anchor).alias("anchor"))
        main = F.coalesce("agree", F.lit(0)) >= F.lit(similar) * F.size("tokens")
        last = scratch.save(live.drop("total").join(seen, line, "left").withColumn("main", main).drop("agree"), "marked")
        scratch.drop(live)
        done.append(scratch.save(last.filter("main").select(*line, F.xxhash64("group", F.lit("group")).alias("template")), "groups"))
        rest = last.filter("not main and anchor is not null").withColumn("group", F.xxhash64("group", "anchor.minus", "anchor.token")).drop("anchor", "main")
    out = found.select(*line, F.lit(None).cast("long").alias("template")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def line_templates(docs: DataFrame, scratch: Scratch, *, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, line_no, template, n_docs, first_doc, first_line) for the occurrences of recurrent templates; lines without a token have none."""
    ship(docs.sparkSession)
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.save(rows.mapInPandas(_lines, "doc_id long, line_no int, leaf long, line long"), "lines")
    # A leaf within one document can hold no recurrent template; most lines go here. The second key lets adaptive execution split a hot leaf.
    leaves = lines.groupBy("leaf").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("leaf", F.xxhash64("leaf").alias("h"))
    shared = scratch.save(lines.withColumn("h", F.xxhash64("leaf")).join(leaves, ["leaf", "h"], "left_semi").drop("h"), "shared")
    scratch.drop(lines)
    # Equal lines become one row; hot lines shrink before the shuffle.
    distinct = scratch.save(shared.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"), F.max("doc_id").alias("hi")), "distinct")
    mixed = distinct.groupBy("leaf").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("leaf", F.xxhash64("leaf").alias("h"))
    mixed = scratch.save(distinct.withColumn("h", F.xxhash64("leaf")).join(mixed, ["leaf", "h"], "left_semi").drop("h"), "mixed")
    wanted = mixed.select(F.col("first.doc_id").alias("id"), F.struct("first.line_no", "leaf", "line").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    # Both joins with whole texts are merge joins at every size, never a broadcast of ids.
    found = rows.join(wanted.hint("merge"), F.col("doc_id") == F.col("id")).select("text", "wanted").mapInPandas(_words, "leaf long, line long, tokens array<long>")
    found = scratch.save(found, "tokens")
    scratch.release()
    found = found.dropDuplicates(["leaf", "line"]).join(mixed.select("leaf", "line", "n", F.col("first.doc_id").alias("lo"), "hi"), ["leaf", "line"])
    own = templates_of(scratch.save(found, "found"), scratch, similar)
    named = distinct.join(own, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("template", F.xxhash64("leaf", "line")).alias("template"), F.xxhash64("line").alias("h"))
    placed = scratch.save(shared.withColumn("h", F.xxhash64("line")).join(named, ["leaf", "line", "h"]).select("template", "doc_id", "line_no"), "placed")
    scratch.drop(shared, distinct, mixed)
    # Documents are counted exactly but in two grouped steps: (template, document) first, so a hot template is spread.
    by_doc = placed.groupBy("template", "doc_id").agg(F.min("line_no").alias("line_no"))
    known = by_doc.groupBy("template").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "line_no")).alias("first")).filter(F.col("n_docs") >= min_docs)
    known = known.select("template", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), F.xxhash64("template").alias("h"))
    return placed.withColumn("h", F.xxhash64("template")).join(known, ["template", "h"]).select("doc_id", "line_no", "template", "n_docs", "first_doc", "first_line")


def dedup_lines(docs: DataFrame, *, n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """docs with their columns and, in text, only the lines that stay; then n_lines and n_dropped.

    Lines of every length count, a single word too. Null texts stay null, with 0 lines; an empty text is one empty line; lines
    without a token, and all lines of documents without a doc_id, are left alone. Rows of one doc_id count as one document, and repeated
    rows lose the same lines. An empty table stays empty; columns named like the two counts are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    marked = line_templates(docs, scratch, **options)
    missing = marked.filter((F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line")))
    id_, gone = free_name(docs, "id"), free_name(docs, "gone")
    drops = missing.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone))
    scratch.release()
    out = docs.drop(n_lines, n_dropped).join(drops.hint("merge"), F.col("doc_id").cast("long") == F.col(id_), "left")
    # Bound to a lambda's variable, the lines are split once, not once for every line that stays.
    parts = F.struct(F.split("text", "\n").alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), F.col(gone)).alias("stay"))
    left = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(p["stay"], lambda i: F.get(p["lines"], i)), "\n")), 0)
    counted = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    out = out.withColumns({n_lines: F.coalesce(counted, F.lit(0)).cast("long"), n_dropped: F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(gone), F.lit(0))).cast("long")})
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).drop(gone, id_)


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE_SQL = rf"""
WITH RECURSIVE split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
raw AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM split),
tok AS (
  SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM raw),
placed AS (SELECT doc_id, line_no, t FROM tok WHERE len(t) > 0),
kinds AS (SELECT t, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM placed GROUP BY t),
-- One row per distinct line and step: its group, until it has found its template.
steps(t, n, lo, hi, grp, found) AS (
  SELECT t, n, lo, hi, md5(concat_ws(' ', len(t), array_to_string(t[1:{DEPTH}], ' '))), false FROM kinds
  UNION ALL
  SELECT t, n, lo, hi, CASE WHEN main THEN grp ELSE md5(concat_ws(' ', grp, anchor.pos, anchor.token)) END, main FROM (
    SELECT l.t, any_value(l.n) AS n, any_value(l.lo) AS lo, any_value(l.hi) AS hi, any_value(l.grp) AS grp,
      count(*) FILTER (2 * v.have > l.total) >= {SIMILAR}::DOUBLE * len(l.t) AS main,
      arg_max({{'pos': l.pos, 'token': l.token}}, [v.have, -l.pos]) FILTER (v.have < l.total AND v.lines > 1) AS anchor
    FROM (
      SELECT t, n, lo, hi, grp, total, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM (
        SELECT *, sum(n) OVER w AS total, count(*) OVER w AS lines, min(lo) OVER w AS first, max(hi) OVER w AS top
        FROM steps WHERE NOT found WINDOW w AS (PARTITION BY grp)) WHERE lines > 1 AND first < top) l
    JOIN (
      SELECT grp, pos, token, sum(n) AS have, count(*) AS lines FROM (
        SELECT grp, n, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM steps WHERE NOT found) GROUP BY ALL) v USING (grp, pos, token)
    GROUP BY l.t)
  WHERE main OR anchor IS NOT NULL),
named AS (SELECT p.doc_id, p.line_no, s.grp, CASE WHEN s.grp IS NULL THEN p.t END AS own FROM placed p LEFT JOIN (SELECT t, grp FROM steps WHERE found) s ON s.t = p.t),
first_ AS (SELECT grp, own, min((doc_id, line_no)) AS head FROM named GROUP BY grp, own HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT n.doc_id, list(n.line_no) AS lines FROM named n JOIN first_ f ON f.grp IS NOT DISTINCT FROM n.grp AND f.own IS NOT DISTINCT FROM n.own WHERE (n.doc_id, n.line_no) <> f.head GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(len(s.lines), 0) AS n_lines, coalesce(len(g.lines), 0) AS n_dropped,
  CASE WHEN g.lines IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(s.lines)), lambda i: NOT list_contains(g.lines, i)), lambda i: s.lines[i + 1]), chr(10)) END AS text
FROM documents d LEFT JOIN split s USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""
