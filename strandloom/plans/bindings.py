"""The driver's tables read as sequences, distances, intervals and block graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import blockgraph, distances
from strandloom.runtime import Scratch, table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26]


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """documents as (doc_id, seq): other than a-z becomes N, letters become bases."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "N"), LETTERS, BASES)
    return table(spark, d, "documents").select("doc_id", seq.alias("seq"))


SEQUENCES = f"(SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)"


def document_pairs(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    docs = table(spark, d, "documents")
    about = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4  # a word and its space
    return distances.shared_grams(distances.shingles(docs, k), Scratch(spark, "pairs"), about)


def similar_documents(spark: SparkSession, d: str, k: int = 5, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of documents of equal shingles that share more than ``least``, and the classes' members."""
    docs = table(spark, d, "documents")
    about = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4  # a word and its space
    return distances.similar_sets(distances.shingles(docs, k), least, Scratch(spark, "similar"), about)


PAIRS = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM words WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
pairs AS (
  SELECT a.id AS i, b.id AS j, x.n AS len_i, y.n AS len_j, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id
  JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id GROUP BY ALL),
dist AS (
  SELECT i, j, p, -0.75::DOUBLE * ln(1.0::DOUBLE - (4.0::DOUBLE / 3.0::DOUBLE) * (1.0::DOUBLE - p)) AS d
  FROM (SELECT i, j, 2.0::DOUBLE * m / (len_i + len_j)::DOUBLE AS p FROM pairs) WHERE p > 0.25)"""


def supply_pairs(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as alignments of suppliers with parts modulo 100: shared content can exceed the lengths."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), "l_quantity")
    pairs = distances.unordered_pairs(rows, "a", "b", "l_quantity")
    return pairs.select("i", "j", F.col("m").cast("long").alias("m"), (F.lit(600) + F.col("i")).alias("len_i"), (F.lit(600) + F.col("j")).alias("len_j"))


SUPPLY = """
pairs AS (
  SELECT i, j, CAST(sum(q) AS BIGINT) AS m, 600 + i AS len_i, 600 + j AS len_j
  FROM (SELECT least(l_suppkey, l_partkey % 100) AS i, greatest(l_suppkey, l_partkey % 100) AS j, l_quantity AS q FROM lineitem WHERE l_suppkey <> l_partkey % 100) GROUP BY i, j),
dist AS (
  SELECT i, j, p, -0.75::DOUBLE * ln(1.0::DOUBLE - (4.0::DOUBLE / 3.0::DOUBLE) * (1.0::DOUBLE - p)) AS d
  FROM (SELECT i, j, 2.0::DOUBLE * m / (len_i + len_j)::DOUBLE AS p FROM pairs) WHERE p > 0.25)"""


def intervals(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """events of one type as (id, s, e, chrom, family)."""
    s = F.timestampdiff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts")) if hasattr(F, "timestampdiff") else F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, d, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias("id"), s.alias("s"), "user_id")
    return rows.select("id", "s", (F.col("s") + 20000 + (F.col("id") * 7919) % 40000).alias("e"), F.col("user_id").alias("chrom"), (F.col("user_id") % 7).alias("family"))


INTERVALS = """
iv AS (
  SELECT event_id AS id, s, s + 20000 + (event_id * 7919) % 40000 AS e, user_id AS chrom, user_id % 7 AS family, event_type
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)),
q AS (SELECT * FROM iv WHERE event_type = 'click'),
r AS (SELECT * FROM iv WHERE event_type = 'view'),
overlap AS (
  SELECT q.id AS left_id, r.id AS right_id, q.chrom AS lc, r.chrom AS rc,
    (least(q.e, r.e) - greatest(q.s, r.s) + 1) / (q.e - q.s)::DOUBLE AS f_left, (least(q.e, r.e) - greatest(q.s, r.s) + 1) / (r.e - r.s)::DOUBLE AS f_right
  FROM q JOIN r ON q.s <= r.e AND r.s <= q.e)"""

GREEDY = (
    "RECURSIVE "
    + INTERVALS.strip()
    + """,
qn AS (SELECT *, row_number() OVER (ORDER BY s, e, id) - 1 AS n FROM q),
rn AS (SELECT *, row_number() OVER (ORDER BY s, e, id) - 1 AS n FROM r),
steps AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS j, NULL::BIGINT AS query_id, NULL::BIGINT AS ref_id
  UNION ALL
  SELECT CASE WHEN hit OR NOT (rs < qs) THEN i + 1 ELSE i END, CASE WHEN hit OR rs < qs THEN j + 1 ELSE j END, CASE WHEN hit THEN qid END, CASE WHEN hit THEN rid END
  FROM (
    SELECT t.i, t.j, qn.id AS qid, rn.id AS rid, qn.s AS qs, rn.s AS rs,
      qn.s <= rn.e AND rn.s <= qn.e AND (least(qn.e, rn.e) - greatest(qn.s, rn.s) + 1) / (rn.e - rn.s)::DOUBLE > 0.8::DOUBLE AND (least(qn.e, rn.e) - greatest(qn.s, rn.s) + 1) / (qn.e - qn.s)::DOUBLE > 0.8::DOUBLE AS hit
    FROM steps t JOIN qn ON qn.n = t.i JOIN rn ON rn.n = t.j)),
matches AS (SELECT query_id, ref_id FROM steps WHERE query_id IS NOT NULL)"""
)


def block_segments(spark: SparkSession, d: str) -> DataFrame:
    """events as segments (thread, start, length, block_id): users are threads, a day's event type is a block, its first event is the segment."""
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    rows = table(spark, d, "events").select(F.col("user_id").alias("thread"), F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("start"), "ts", "event_id", code.alias("code"))
    rows = rows.withColumn("block_id", (F.floor(F.col("start") / 86400) * 5 + F.col("code")).cast("long"))
    first = rows.groupBy("thread", "block_id").agg(F.min(F.struct("ts", "event_id", "start")).alias("x"))
    return first.select("thread", F.col("x.start").alias("start"), F.lit(60).cast("long").alias("length"), "block_id")


def block_edges(segments: DataFrame) -> DataFrame:
    """(b1, b2, shared, min_adj), with gaps in whole hours."""
    adj = blockgraph.next_blocks(segments).withColumn("adj_len", F.floor(F.col("adj_len") / F.lit(3600.0)).cast("long"))
    low = blockgraph.min_adjacency(adj)
    return low.join(blockgraph.shared_threads(low, segments), ["b1", "b2"])


def block_order(segments: DataFrame) -> DataFrame:
    """(block_id, pos): blocks by id. Blocks are days times event types, so few beside the events."""
    from strandloom.operators.candidates import number

    return number(segments.select("block_id").distinct(), [], ["block_id"], "pos")


BLOCKS = """
ev AS (
  SELECT user_id AS thread, event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS start,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS code FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY thread, block_id ORDER BY ts, event_id) AS n
  FROM (SELECT *, CAST(floor(start / 86400.0::DOUBLE) AS BIGINT) * 5 + code AS block_id FROM ev)),
seg AS (SELECT thread, start, 60::BIGINT AS length, block_id FROM ranked WHERE n = 1),
adj AS (
  SELECT thread, block_id AS b1, b2, start + length AS adj_start, next_start - (start + length) AS adj_len
  FROM (SELECT *, lead(block_id) OVER w AS b2, lead(start) OVER w AS next_start FROM seg WINDOW w AS (PARTITION BY thread ORDER BY start, block_id)) WHERE b2 IS NOT NULL),
low AS (SELECT b1, b2, min(CAST(floor(adj_len / 3600.0::DOUBLE) AS BIGINT)) AS min_adj FROM adj GROUP BY b1, b2),
common AS (SELECT low.b1, low.b2, count(*) AS shared FROM low JOIN seg x ON x.block_id = low.b1 JOIN seg y ON y.block_id = low.b2 AND y.thread = x.thread GROUP BY ALL),
ordering AS (SELECT block_id, row_number() OVER (ORDER BY block_id) - 1 AS pos FROM (SELECT DISTINCT block_id FROM seg)),
edges AS (
  SELECT x.pos AS left_pos, y.pos AS right_pos, low.b1 AS left_block, low.b2 AS right_block, shared - min_adj AS score
  FROM low JOIN common USING (b1, b2) JOIN ordering x ON x.block_id = low.b1 JOIN ordering y ON y.block_id = low.b2 WHERE x.pos < y.pos),
best AS (SELECT right_pos AS pos, left_pos AS prev, score AS edge_score FROM (SELECT *, row_number() OVER (PARTITION BY right_pos ORDER BY score DESC, left_pos) AS n FROM edges) WHERE n = 1)"""

SCORES = (
    "RECURSIVE "
    + BLOCKS.strip()
    + """,
chase AS (
  SELECT ordering.pos, best.prev, coalesce(best.edge_score, 0) AS score FROM ordering LEFT JOIN best USING (pos)
  UNION ALL
  SELECT chase.pos, best.prev, chase.score + best.edge_score FROM chase JOIN best ON best.pos = chase.prev),
scores AS (SELECT pos, best.prev, CAST(score AS BIGINT) AS score FROM (SELECT pos, max_by(score, -coalesce(prev, -1)) AS score FROM chase GROUP BY pos) LEFT JOIN best USING (pos))"""
)
