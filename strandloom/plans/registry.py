"""All queries of the library proper, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions import sequence as fn
from strandloom.operators import aligning, blockgraph, candidates, distances, intervals, pinch, tree
from strandloom.plans import bindings as b
from strandloom.plans.pipeline import library_plan
from strandloom.runtime import Scratch, table
from strandloom.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- sequences ----------------------------------------------------------------------------------


@query("seq_revcomp", f"SELECT doc_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM {b.SEQUENCES}")
def seq_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return b.sequences(spark, d).select("doc_id", fn.reverse_complement("seq").alias("rc"))


N_SHARE = "(length(seq) - length(replace(seq, 'N', '')))::DOUBLE / nullif(length(seq), 0)"


@query("seq_n_filter", f"SELECT doc_id, {N_SHARE} AS n_fraction FROM {b.SEQUENCES} WHERE {N_SHARE} < 0.2::DOUBLE")
def seq_n_filter(spark, d):
    return candidates.filter_n(b.sequences(spark, d)).select("doc_id", fn.n_fraction("seq").alias("n_fraction"))


@query("seq_length_range", f"SELECT doc_id, length(seq)::BIGINT AS length FROM {b.SEQUENCES} WHERE length(seq) BETWEEN 100 AND 10000")
def seq_length_range(spark, d):
    return b.sequences(spark, d).select("doc_id", F.length("seq").cast("long").alias("length")).filter(F.col("length").between(100, 10000))


def _segments(spark, d) -> DataFrame:
    """Documents as segments of one genome per language; those of sources with an even number have a parent."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("genome"), F.col("doc_id").alias("seg_index"), F.col("source").alias("sequence"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("length"), (F.col("doc_id") % 2 == 0).alias("has_parent"))


SEGMENTS = "(SELECT lang AS genome, doc_id AS seg_index, length(text)::BIGINT AS length, doc_id % 2 = 0 AS has_parent FROM documents)"
INSERTIONS = f"(SELECT * FROM {SEGMENTS} s JOIN (SELECT lang AS genome, max(doc_id) AS last FROM documents GROUP BY lang) USING (genome) WHERE seg_index < last AND NOT has_parent AND length BETWEEN 100 AND 10000)"


@query("seq_last_excluded", f"SELECT genome, seg_index, length, row_number() OVER (PARTITION BY genome ORDER BY seg_index) - 1 AS i FROM {INSERTIONS}")
def seq_last_excluded(spark, d):
    return candidates.candidate_segments(_segments(spark, d)).select("genome", "seg_index", "length", "i")


@query("seq_first_n", f"SELECT genome, seg_index, length, row_number() OVER (ORDER BY seg_index) - 1 AS i FROM (SELECT * FROM {INSERTIONS} WHERE genome = 'en' ORDER BY seg_index LIMIT 50)")
def seq_first_n(spark, d):
    return candidates.candidate_segments(_segments(spark, d).filter("genome = 'en'"), max_sequences=50).select("genome", "seg_index", "length", "i")


@query(
    "seq_both_strands",
    f"SELECT doc_id::VARCHAR AS name, '+' AS strand, seq FROM {b.SEQUENCES} UNION ALL SELECT doc_id::VARCHAR || '_comp', '-', reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM {b.SEQUENCES}",
)
def seq_both_strands(spark, d):
    return candidates.both_strands(b.sequences(spark, d).withColumnRenamed("doc_id", "name")).select("name", "strand", "seq")


@query("seq_substring", f"SELECT doc_id, substring(seq, 11, 50) AS bases FROM {b.SEQUENCES}")
def seq_substring(spark, d):
    return b.sequences(spark, d).select("doc_id", fn.subsequence("seq", F.lit(10), F.lit(50)).alias("bases"))


@query("header_int_prefix", r"SELECT event_id, TRY_CAST(nullif(regexp_extract(h, '^\s*([+-]?\d+)', 1), '') AS BIGINT) AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id || '_comp' END AS h FROM events)")
def header_int_prefix(spark, d):
    h = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("_comp")))
    return table(spark, d, "events").select("event_id", fn.header_number(h).alias("n"))


# --- formats ------------------------------------------------------------------------------------

PART_LINE = "concat_ws(' ', p_partkey, p_brand, p_size, p_type, 'chr' || p_size, p_partkey, p_partkey + p_size, '+', 'x', p_brand, 1, 2, 3, 4, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END)"


def _part_lines(spark, d) -> DataFrame:
    c = lambda name: F.col(name).cast("string")
    parts = [c("p_partkey"), c("p_brand"), c("p_size"), c("p_type"), F.concat(F.lit("chr"), c("p_size")), c("p_partkey"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("+"), F.lit("x"), c("p_brand"), *map(F.lit, "1234"), F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))]
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", *parts).alias("value"))


@query("tokenize_fields", rf"SELECT len(f)::BIGINT AS n_fields, count(*) AS lines FROM (SELECT string_split_regex(trim({PART_LINE}), '\s+') AS f FROM part) GROUP BY 1")
def tokenize_fields(spark, d):
    return _part_lines(spark, d).select(F.size(fn.fields("value")).cast("long").alias("n_fields")).groupBy("n_fields").agg(F.count("*").alias("lines"))


@query(
    "annotation_fields",
    rf"SELECT f[5] AS chrom, f[6]::BIGINT AS start, f[7]::BIGINT AS end_, f[15] AS name, f[10] AS family FROM (SELECT string_split_regex(trim({PART_LINE}), '\s+') AS f FROM part) WHERE len(f) = 15 AND TRY_CAST(f[6] AS BIGINT) IS NOT NULL",
)
def annotation_fields(spark, d):
    lines = _part_lines(spark, d)
    return formats.parse_annotations(lines.filter(F.get(fn.fields("value"), F.lit(5)).try_cast("bigint").isNotNull())).withColumnRenamed("end", "end_")


GFF = "(SELECT 'user' || user_id AS seqid, event_id AS start, event_id + 500 AS end_, event_type AS name, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 'f' || event_id % 7 AS family FROM events)"


@query("gff_roundtrip", f"SELECT seqid, name AS type, start, end_, 0.0::DOUBLE AS score, strand, family AS attributes, concat_ws(chr(9), seqid, 'candidate_transposon', name, start, end_, 0, strand, '.', family) AS line FROM {GFF}")
def gff_roundtrip(spark, d):
    e = table(spark, d, "events")
    line = formats.gff_line(F.concat(F.lit("user"), F.col("user_id").cast("string")), F.lit("candidate_transposon"), F.col("event_type"), F.col("event_id"), F.col("event_id") + 500, F.lit(0), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")))
    parsed = formats.parse_gff(e.select(line.alias("value")))
    back = formats.gff_line(F.col("seqid"), F.col("source"), F.col("type"), F.col("start"), F.col("end"), F.col("score").cast("int"), F.col("strand"), F.col("phase"), F.col("attributes"))
    return parsed.select("seqid", "type", "start", F.col("end").alias("end_"), "score", "strand", "attributes", back.alias("line"))


@query("fasta_roundtrip", f"SELECT doc_id::VARCHAR AS name, seq, '>' || doc_id || chr(10) || seq AS record FROM {b.SEQUENCES} WHERE length(seq) > 0")
def fasta_roundtrip(spark, d):
    seqs = b.sequences(spark, d).filter(F.length("seq") > 0)
    parsed = formats.parse_fasta(seqs.select(formats.fasta_record(F.col("doc_id").cast("string"), F.col("seq")).alias("value")))
    return parsed.withColumn("record", formats.fasta_record(F.col("name"), F.col("seq")))


@query("bed_project", f"SELECT 'chr' || p_size || chr(9) || p_partkey || chr(9) || p_partkey + p_size AS line FROM part WHERE TRY_CAST(string_split_regex(trim({PART_LINE}), '\\s+')[6] AS BIGINT) IS NOT NULL AND TRUE AND string_split_regex(trim({PART_LINE}), '\\s+')[5] = 'chr' || p_size")
def bed_project(spark, d):
    lines = _part_lines(spark, d).filter(F.get(fn.fields("value"), F.lit(5)).try_cast("bigint").isNotNull())
    rows = formats.parse_annotations(lines, strict=False)
    return rows.filter(F.col("chrom").startswith("chr")).select(formats.bed_line(F.col("chrom"), F.col("start"), F.col("end")).alias("line"))


@query("cigar_match_sum", "SELECT l_orderkey AS line, l_suppkey::VARCHAR AS q, l_partkey::VARCHAR AS t, CAST(l_quantity AS BIGINT) + l_linenumber AS matches, CAST(l_extendedprice AS BIGINT) AS score FROM lineitem")
def cigar_match_sum(spark, d):
    c = lambda x: x.cast("string")
    n = F.rint("l_quantity").cast("long")
    parts = ["cigar:", F.col("l_suppkey"), 0, n, "+", F.col("l_partkey"), 0, n, "+", F.rint("l_extendedprice").cast("long"), "M", n, "I", 3, "M", F.col("l_linenumber"), "K", F.col("l_orderkey")]
    line = F.concat_ws(" ", *(c(x) if not isinstance(x, (str, int)) else F.lit(str(x)) for x in parts))
    parsed = formats.parse_cigar(table(spark, d, "lineitem").select(line.alias("value")))
    # The order key travels as a last operation of its own kind, which no match sum counts.
    return parsed.select(F.element_at("ops", -1)["len"].alias("line"), "q", "t", distances.alignment_matches(parsed).alias("matches"), "score")


# --- distances and clusters -----------------------------------------------------------------------


@query("pair_shared", f"WITH {b.PAIRS.strip()} SELECT i, j, m, len_i, len_j FROM pairs")
def pair_shared(spark, d):
    return b.document_pairs(spark, d).select("i", "j", "m", F.col("len_i").cast("long").alias("len_i"), F.col("len_j").cast("long").alias("len_j"))


@query("pair_p", f"WITH {b.PAIRS.strip()} SELECT i, j, 2.0::DOUBLE * m / (len_i + len_j)::DOUBLE AS p FROM pairs")
def pair_p(spark, d):
    return b.document_pairs(spark, d).select("i", "j", fn.proportion_shared("m", "len_i", "len_j").alias("p"))


def _document_distances(spark, d) -> DataFrame:
    return distances.distances(distances.member_pairs(*b.similar_documents(spark, d)))


@query("jc_distance", f"WITH {b.PAIRS.strip()} SELECT i, j, p, round(d, 9) + 0.0::DOUBLE AS d FROM dist")
def jc_distance(spark, d):
    return _document_distances(spark, d).withColumn("d", F.round("d", 9) + F.lit(0.0))


@query("jc_distance_negative", f"WITH {b.SUPPLY.strip()} SELECT i, j, m, p, round(d, 9) + 0.0::DOUBLE AS d FROM dist JOIN pairs USING (i, j)")
def jc_distance_negative(spark, d):
    pairs = b.supply_pairs(spark, d)
    return distances.distances(pairs).join(pairs.select("i", "j", "m"), ["i", "j"]).select("i", "j", "m", "p", (F.round("d", 9) + F.lit(0.0)).alias("d"))


@query("distance_lines", f"WITH {b.SUPPLY.strip()} SELECT i || ' ' || j || ' ' || printf('%.6f', d) AS line FROM dist")
def distance_lines(spark, d):
    return formats.distance_rows(distances.distances(b.supply_pairs(spark, d)))


@query("distance_edges", f"WITH {b.PAIRS.strip()} SELECT i, j FROM dist WHERE abs(d) < 0.1::DOUBLE")
def distance_edges(spark, d):
    return distances.close_edges(_document_distances(spark, d)).select("i", "j")


PARTS = (
    "WITH RECURSIVE "
    + b.PAIRS.strip()
    + """,
edge AS (SELECT i AS a, j AS b FROM dist WHERE abs(d) < 0.1::DOUBLE UNION SELECT j, i FROM dist WHERE abs(d) < 0.1::DOUBLE),
names AS (SELECT DISTINCT unnest([i, j]) AS name FROM dist),
reach AS (SELECT name, name AS other FROM names UNION SELECT reach.name, edge.b FROM reach JOIN edge ON edge.a = reach.other),
members AS (SELECT name, min(other) AS cluster_id FROM reach GROUP BY name)"""
)


def _clusters(spark, d, **options) -> DataFrame:
    return distances.clusters(distances.distances(distances.class_links(*b.similar_documents(spark, d))), **options)


@query("clusters_all", f"{PARTS} SELECT cluster_id, count(*) AS n, string_agg(name::VARCHAR, ' ' ORDER BY name) AS members FROM members GROUP BY cluster_id")
def clusters_all(spark, d):
    rows = _clusters(spark, d)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_set("name")), lambda x: x.cast("string")), " ")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), ordered.alias("members"))


@query("clusters_min2", f"{PARTS}, sizes2 AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id HAVING count(*) >= 2) SELECT cluster_id, n FROM sizes2")
def clusters_min2(spark, d):
    return _clusters(spark, d, least_size=2).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("cluster_lines", f"{PARTS} SELECT cluster_id, count(*) AS n, string_agg(name::VARCHAR, ' ' ORDER BY name) AS members FROM members GROUP BY cluster_id HAVING count(*) >= 2")
def cluster_lines(spark, d):
    return formats.cluster_lines(_clusters(spark, d, least_size=2), 2)


@query("cluster_members", f"{PARTS} SELECT name, cluster_id FROM members")
def cluster_members(spark, d):
    return _clusters(spark, d).select("name", "cluster_id")


# --- intervals ------------------------------------------------------------------------------------

BIN = 60000


def _sides(spark, d):
    return b.intervals(spark, d, "click"), b.intervals(spark, d, "view")


@query("overlap_pairs", f"WITH {b.INTERVALS.strip()} SELECT left_id, right_id, f_left, f_right FROM overlap WHERE f_left > 0.8::DOUBLE AND f_right > 0.8::DOUBLE")
def overlap_pairs(spark, d):
    return intervals.overlap_pairs(*_sides(spark, d), BIN)


@query("overlap_pairs_by_chrom", f"WITH {b.INTERVALS.strip()} SELECT left_id, right_id, f_left, f_right FROM overlap WHERE f_left > 0.8::DOUBLE AND f_right > 0.8::DOUBLE AND lc = rc")
def overlap_pairs_by_chrom(spark, d):
    return intervals.overlap_pairs(*_sides(spark, d), BIN, by_chrom=True)


@query("interval_order", f"WITH {b.INTERVALS.strip()} SELECT id, s, e, row_number() OVER (ORDER BY s, e, id) - 1 AS n FROM q")
def interval_order(spark, d):
    return candidates.number(intervals.checked(b.intervals(spark, d, "click")), [], ["s", "e", "id"], "n").select("id", "s", "e", "n")


@query("greedy_match", f"WITH {b.GREEDY} SELECT query_id, ref_id FROM matches")
def greedy_match(spark, d):
    return intervals.greedy_match(*_sides(spark, d))


@query("match_flag", f"WITH {b.GREEDY} SELECT id, family, id IN (SELECT ref_id FROM matches) AS matched FROM r")
def match_flag(spark, d):
    q, r = _sides(spark, d)
    return intervals.match_flags(r, intervals.greedy_match(q, r), "ref_id").select("id", "family", "matched")


def _numbered_matches(spark, d) -> DataFrame:
    q, r = _sides(spark, d)
    m = Scratch(spark, "matches").save(intervals.greedy_match(q, r), "matches")
    rows = m.join(q.select(F.col("id").alias("query_id"), "s", "e", F.col("family").alias("qf")), "query_id").join(r.select(F.col("id").alias("ref_id"), F.col("family").alias("rf")), "ref_id")
    return rows.select("s", "e", F.col("query_id").alias("id"), "qf", "rf")


CONCORDANCE = """,
m AS (SELECT row_number() OVER (ORDER BY q.s, q.e, q.id) - 1 AS idx, q.family AS qf, r.family AS rf FROM matches JOIN q ON q.id = query_id JOIN r ON r.id = ref_id)
SELECT CAST(coalesce(sum(CASE WHEN (a.qf = b.qf) = (a.rf = b.rf) THEN 1 ELSE 0 END), 0) AS BIGINT) AS concordant, count(*) AS total,
  sum(CASE WHEN (a.qf = b.qf) = (a.rf = b.rf) THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0)::DOUBLE AS concordance
FROM m a JOIN m b ON b.idx < a.idx WHERE a.idx % 50 = 0"""


@query("concordance", f"WITH {b.GREEDY}{CONCORDANCE}")
def concordance(spark, d):
    return intervals.concordance(_numbered_matches(spark, d))


FAMILIES = """,
flagged AS (SELECT *, id IN (SELECT ref_id FROM matches) AS matched FROM r),
cover AS (
  SELECT family, count(*) AS copies, count(*) FILTER (matched) AS covered, (count(*) FILTER (matched))::DOUBLE / count(*) AS coverage, sum(e - s)::DOUBLE / count(*) AS avg_length, min((s, e, id)) AS seen
  FROM flagged GROUP BY family)"""


def _coverage(spark, d) -> DataFrame:
    q, r = _sides(spark, d)
    return intervals.family_coverage(intervals.match_flags(r, intervals.greedy_match(q, r), "ref_id"))


@query("family_coverage", f"WITH {b.GREEDY}{FAMILIES} SELECT family, copies, covered, coverage, avg_length FROM cover")
def family_coverage(spark, d):
    return _coverage(spark, d).drop("first_seen")


@query("family_lines", f"WITH {b.GREEDY}{FAMILIES} SELECT concat_ws(chr(9), family, copies, covered, printf('%.6f', coverage), printf('%.6f', avg_length)) AS line FROM cover ORDER BY copies DESC, seen")
def family_lines(spark, d):
    """The coverage table's lines, most copies first."""
    rows = _coverage(spark, d).orderBy(F.desc("copies"), "first_seen")
    return rows.select(formats.coverage_line(*(F.col(c) for c in ("family", "copies", "covered", "coverage", "avg_length"))).alias("line"))


@query("family_top20", f"WITH {b.GREEDY}{FAMILIES} SELECT family, copies FROM cover ORDER BY copies DESC, seen LIMIT 20")
def family_top20(spark, d):
    return intervals.top_families(_coverage(spark, d)).select("family", "copies")


@query("sort_alignments", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS place FROM orders")
def sort_alignments(spark, d):
    """Orders as alignments by score descending, ties by the later line, each with its place in that order."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("score"), (-F.col("o_orderkey")).alias("line"))
    return candidates.number(rows, [], ["score", "line"], "place").select("o_orderkey", "o_totalprice", "place")


@query("depth_cap", "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2")
def depth_cap(spark, d):
    return aligning.depth_cap(table(spark, d, "part"), ["p_size"], [F.desc("p_retailprice"), F.asc("p_partkey")], 2).select("p_partkey", "p_size")


# --- block graphs ---------------------------------------------------------------------------------

BLOCKS = f"WITH {b.BLOCKS.strip()}"


def _segs(spark, d) -> DataFrame:
    return b.block_segments(spark, d)


@query("block_degree_weight", f"{BLOCKS} SELECT block_id, count(*) AS degree, max(length) AS length, count(*) * max(length) AS weight FROM seg GROUP BY block_id")
def block_degree_weight(spark, d):
    return blockgraph.block_stats(_segs(spark, d))


@query("heaviest_block", f"{BLOCKS} SELECT block_id, count(*) * max(length) AS weight FROM seg GROUP BY block_id ORDER BY weight DESC, block_id LIMIT 1")
def heaviest_block(spark, d):
    return blockgraph.heaviest_block(blockgraph.block_stats(_segs(spark, d)))


@query("block_threads", f"{BLOCKS} SELECT block_id, string_agg(DISTINCT thread::VARCHAR, ' ' ORDER BY thread::VARCHAR) AS threads FROM seg GROUP BY block_id")
def block_threads(spark, d):
    rows = blockgraph.block_threads(_segs(spark, d))
    return rows.select("block_id", F.array_join(F.array_sort(F.transform("threads", lambda t: t.cast("string"))), " ").alias("threads"))


@query("next_block", f"{BLOCKS} SELECT thread, b1, b2, adj_start, adj_len FROM adj")
def next_block(spark, d):
    return blockgraph.next_blocks(_segs(spark, d))


@query("min_adjacency", f"{BLOCKS} SELECT b1, b2, min(adj_len) AS min_adj FROM adj GROUP BY b1, b2")
def min_adjacency(spark, d):
    return blockgraph.min_adjacency(blockgraph.next_blocks(_segs(spark, d)))


@query("argmin_adjacency", f"{BLOCKS} SELECT b1, b2, thread, adj_start, adj_len FROM (SELECT *, row_number() OVER (PARTITION BY b1, b2 ORDER BY adj_len, thread, adj_start) AS n FROM adj) WHERE n = 1")
def argmin_adjacency(spark, d):
    return blockgraph.shortest_adjacency(blockgraph.next_blocks(_segs(spark, d)))


@query("shared_threads", f"{BLOCKS} SELECT b1, b2, shared FROM common")
def shared_threads(spark, d):
    segs = _segs(spark, d)
    return blockgraph.shared_threads(blockgraph.next_blocks(segs), segs)


def _scored_edges(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    segs = Scratch(spark, "blocks").save(_segs(spark, d), "segments")
    order = b.block_order(segs)
    return segs, order, blockgraph.edge_scores(b.block_edges(segs), order)


@query("edge_scores", f"{BLOCKS} SELECT left_pos, right_pos, left_block, right_block, score FROM edges")
def edge_scores(spark, d):
    return _scored_edges(spark, d)[2]


#: Segments that lie in their block either way, and blocks that the ordering enters by their right end.
SIDES = """,
sided AS (SELECT *, (thread * 7 + block_id) % 5 <> 0 AS strand FROM seg),
touch AS (
  SELECT block_id AS b1, strand AS right1, b2, NOT after AS right2, CAST(floor((next_start - (start + length)) / 3600.0::DOUBLE) AS BIGINT) AS gap
  FROM (SELECT *, lead(block_id) OVER w AS b2, lead(start) OVER w AS next_start, lead(strand) OVER w AS after FROM sided WINDOW w AS (PARTITION BY thread ORDER BY start, block_id)) WHERE b2 IS NOT NULL),
ways AS (SELECT b1, right1, b2, right2, gap FROM touch UNION ALL SELECT b2, right2, b1, right1, gap FROM touch),
nearest AS (SELECT b1, right1, b2, right2, min(gap) AS min_adj FROM ways GROUP BY ALL),
both_have AS (SELECT n.b1, n.b2, count(*) AS shared FROM (SELECT DISTINCT b1, b2 FROM nearest) n JOIN seg x ON x.block_id = n.b1 JOIN seg y ON y.block_id = n.b2 AND y.thread = x.thread GROUP BY ALL)"""


def _sided(spark, d) -> DataFrame:
    return _segs(spark, d).withColumn("strand", (F.col("thread") * 7 + F.col("block_id")) % 5 != 0)


@query(
    "oriented_edges",
    f"""{BLOCKS}{SIDES}
SELECT x.pos AS left_pos, y.pos AS right_pos, b1 AS left_block, b2 AS right_block, shared - min_adj AS score FROM nearest JOIN both_have USING (b1, b2)
JOIN ordering x ON x.block_id = b1 JOIN ordering y ON y.block_id = b2 WHERE x.pos < y.pos AND right2 = (b2 % 4 = 0) AND right1 <> (b1 % 4 = 0)""",
)
def oriented_edges(spark, d):
    """Edges along the direction in which the ordering passes through their blocks."""
    segs = _sided(spark, d)
    adj = blockgraph.next_blocks(segs).withColumn("adj_len", F.floor(F.col("adj_len") / F.lit(3600.0)).cast("long"))
    low = blockgraph.min_adjacency(blockgraph.both_ways(adj))
    order = b.block_order(segs).withColumn("right", F.col("block_id") % 4 == 0)
    return blockgraph.edge_scores(low.join(blockgraph.shared_threads(low, segs), ["b1", "b2"]), order)


@query("oriented_dot", f"""{BLOCKS}{SIDES},
ends AS (SELECT b1 || CASE WHEN right1 THEN 'r' ELSE 'l' END AS x, b2 || CASE WHEN right2 THEN 'r' ELSE 'l' END AS y FROM touch)
SELECT block_id || side AS line FROM (SELECT DISTINCT block_id FROM seg), (VALUES ('l'), ('r')) t(side) UNION ALL SELECT DISTINCT block_id || 'l -- ' || block_id || 'r' FROM seg UNION ALL SELECT DISTINCT least(x, y) || ' -- ' || greatest(x, y) FROM ends""")
def oriented_dot(spark, d):
    segs = _sided(spark, d)
    return blockgraph.graph_dot(segs, blockgraph.next_blocks(segs))


@query("graph_totals", f"{BLOCKS} SELECT (SELECT count(DISTINCT block_id) FROM seg) AS blocks, (SELECT count(*) FROM seg) AS segments, (SELECT count(*) FROM adj) AS adjacencies")
def graph_totals(spark, d):
    """What the graph tools report of a graph, as one row."""
    segs = Scratch(spark, "totals").save(_segs(spark, d), "segments")
    counts = blockgraph.block_stats(segs).agg(F.count("*").alias("blocks"), F.sum("degree").alias("segments"))
    return counts.crossJoin(F.broadcast(blockgraph.next_blocks(segs).agg(F.count("*").alias("adjacencies"))))  # one row each


@query("best_predecessor", f"{BLOCKS} SELECT pos, prev, edge_score FROM best")
def best_predecessor(spark, d):
    return blockgraph.best_predecessor(_scored_edges(spark, d)[2])


SCORES = f"WITH {b.SCORES}"


@query("path_scores", f"{SCORES} SELECT pos, prev, score FROM scores")
def path_scores(spark, d):
    _, order, edges = _scored_edges(spark, d)
    return blockgraph.path_scores(order, blockgraph.best_predecessor(edges), Scratch(spark, "paths"))


TRACE = """,
top AS (SELECT pos, score FROM scores WHERE score > 0 ORDER BY score DESC, pos LIMIT 1),
walk AS (SELECT 0::BIGINT AS up, top.pos, scores.prev, scores.score FROM top JOIN scores USING (pos) UNION ALL SELECT up + 1, scores.pos, scores.prev, scores.score FROM walk JOIN scores ON scores.pos = walk.prev WHERE scores.score > 0),
begin_ AS (SELECT thread FROM seg JOIN ordering USING (block_id) JOIN top USING (pos)),
walked AS (
  SELECT up, pos, block_id, score, CASE WHEN (SELECT count(*) FROM seg JOIN begin_ USING (thread) WHERE seg.block_id = o.block_id) < 0.5::DOUBLE * (SELECT count(*) FROM begin_) THEN 1 ELSE 0 END AS bad
  FROM walk JOIN ordering o USING (pos)),
stops AS (SELECT min(up) AS stop FROM (SELECT up, sum(bad) OVER (ORDER BY up ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS run FROM walked) WHERE run = 6),
kept AS (SELECT * FROM walked, stops WHERE stop IS NULL OR up < greatest(0, stop - 5))"""


def _trace(spark, d):
    segs, order, edges = _scored_edges(spark, d)
    scratch = Scratch(spark, "trace")
    order = scratch.save(order, "order")
    scored = scratch.save(blockgraph.path_scores(order, blockgraph.best_predecessor(edges), scratch), "scores")
    return segs, *blockgraph.trace_path(scored, order, segs, scratch)


@query("path_trace", f"{SCORES}{TRACE} SELECT (SELECT count(*) FROM kept) - 1 - up AS rank, pos, block_id, (SELECT top.score - w.score FROM top, (SELECT score FROM walked, stops WHERE stop IS NULL OR up < stop ORDER BY up DESC LIMIT 1) w) AS path_score FROM kept")
def path_trace(spark, d):
    _, path, score = _trace(spark, d)
    return path.crossJoin(F.broadcast(score)).select("rank", "pos", "block_id", "path_score")  # score is one row


@query("chain_length", f"{SCORES}{TRACE} SELECT CAST(coalesce(sum(length), 0) AS BIGINT) AS chain_length FROM kept JOIN (SELECT block_id, max(length) AS length FROM seg GROUP BY block_id) USING (block_id)")
def chain_length(spark, d):
    segs, path, _ = _trace(spark, d)
    return blockgraph.chain_length(path, blockgraph.block_stats(segs))


@query("graph_dot", f"{BLOCKS} SELECT block_id || side AS line FROM (SELECT DISTINCT block_id FROM seg), (VALUES ('l'), ('r')) t(side) UNION ALL SELECT DISTINCT block_id || 'l -- ' || block_id || 'r' FROM seg UNION ALL SELECT DISTINCT b1 || 'r -- ' || b2 || 'l' FROM adj")
def graph_dot(spark, d):
    segs = _segs(spark, d)
    return blockgraph.graph_dot(segs, blockgraph.next_blocks(segs))


# --- pairs, trees, consensus ------------------------------------------------------------------------

#: A segment's bases: 60 of the document that its thread and block choose, from where its start falls.
ALIGNED = f"(SELECT block_id, thread, rpad(substring(seq, CAST(1 + start % greatest(length(seq) - 59, 1) AS BIGINT), 60), 60, 'N') AS bases FROM seg JOIN {b.SEQUENCES} q ON q.doc_id = (thread * 31 + block_id) % (SELECT count(*) FROM documents))"


def _aligned(spark, d) -> DataFrame:
    segs, seqs = _segs(spark, d), b.sequences(spark, d)
    at = (F.lit(1) + F.pmod("start", F.greatest(F.length("seq") - 59, F.lit(1)))).cast("int")
    rows = segs.join(seqs, F.pmod(F.col("thread") * 31 + F.col("block_id"), F.lit(seqs.count())) == F.col("doc_id"))
    return rows.select("block_id", "thread", F.rpad(F.substring("seq", at, F.lit(60)), 60, "N").alias("bases"))


SAME = "len(list_filter(range(1, 61), lambda k: upper(x.bases[k]) = upper(y.bases[k])))"


@query("segment_identity", f"{BLOCKS} SELECT x.block_id, x.thread AS t1, y.thread AS t2, {SAME}::BIGINT AS same FROM {ALIGNED} x JOIN {ALIGNED} y ON x.block_id = y.block_id AND x.thread < y.thread")
def segment_identity(spark, d):
    x = _aligned(spark, d).select("block_id", "thread", F.length("bases").alias("n"), fn.packed_letters("bases").alias("x"))
    a, c = x.alias("a"), x.alias("c")
    pairs = a.join(c, (F.col("a.block_id") == F.col("c.block_id")) & (F.col("a.thread") < F.col("c.thread")))
    return pairs.select("a.block_id", F.col("a.thread").alias("t1"), F.col("c.thread").alias("t2"), (F.col("a.n") - fn.packed_differences("a.x", "c.x")).cast("long").alias("same"))


SNPS = f", snps AS (SELECT x.thread AS t1, y.thread AS t2, CAST(sum({SAME}) AS BIGINT) AS same, CAST(sum(60 - {SAME}) AS BIGINT) AS different FROM {ALIGNED} x JOIN {ALIGNED} y ON x.block_id = y.block_id AND x.thread < y.thread GROUP BY ALL)"
BREAKS = """,
around AS (SELECT thread, block_id, lag(block_id) OVER w AS left_block, lead(block_id) OVER w AS right_block FROM seg WINDOW w AS (PARTITION BY thread ORDER BY start, block_id)),
members AS (SELECT * FROM around),
ids AS (SELECT DISTINCT thread FROM members),
cells AS (
  SELECT i.thread AS t1, j.thread AS t2, k.block_id, a.block_id IS NOT NULL AS one, c.block_id IS NOT NULL AS two, a.left_block AS al, c.left_block AS cl, a.right_block AS ar, c.right_block AS cr
  FROM ids i JOIN ids j ON i.thread < j.thread CROSS JOIN (SELECT DISTINCT block_id FROM members) k
  LEFT JOIN members a ON a.thread = i.thread AND a.block_id = k.block_id LEFT JOIN members c ON c.thread = j.thread AND c.block_id = k.block_id),
breaks AS (
  SELECT t1, t2,
    CAST(sum(CASE WHEN one AND two AND al IS NOT NULL THEN coalesce((al = cl)::INT, 0) + CASE WHEN ar IS NOT NULL THEN coalesce((ar = cr)::INT, 0) ELSE 0 END ELSE 0 END) AS BIGINT) AS same,
    CAST(sum(CASE WHEN one <> two THEN 2 WHEN one AND two AND al IS NOT NULL THEN 1 - coalesce((al = cl)::INT, 0) + CASE WHEN ar IS NULL THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS different
  FROM cells GROUP BY t1, t2)"""


def _around_members(spark, d) -> DataFrame:
    segs = Scratch(spark, "around").save(_segs(spark, d), "segments")
    adj = blockgraph.next_blocks(segs)
    return segs.select("thread", "block_id").join(adj.select("thread", F.col("b1").alias("block_id"), F.col("b2").alias("right_block")), ["thread", "block_id"], "left").join(adj.select("thread", F.col("b2").alias("block_id"), F.col("b1").alias("left_block")), ["thread", "block_id"], "left")


@query("snp_pairs", f"{BLOCKS}{SNPS} SELECT * FROM snps")
def snp_pairs(spark, d):
    return blockgraph.snp_pairs(_aligned(spark, d))


@query("breakpoint_pairs", f"{BLOCKS}{BREAKS} SELECT * FROM breaks")
def breakpoint_pairs(spark, d):
    around = _around_members(spark, d)
    return blockgraph.breakpoint_pairs(around, around)


@query(
    "chain_distance",
    f"""{BLOCKS}{SNPS}{BREAKS},
shares AS (SELECT k.t1, k.t2, coalesce(s.different / nullif(s.same + s.different, 0)::DOUBLE, 0.0) AS sq, coalesce(k.different / nullif(k.same + k.different, 0)::DOUBLE, 0.0) AS bq FROM breaks k LEFT JOIN snps s ON s.t1 = k.t1 AND s.t2 = k.t2)
SELECT t1, t2, round(snp, 9) + 0.0::DOUBLE AS snp, bq AS "breakpoint", round(snp + bq, 9) AS distance FROM (SELECT *, CASE WHEN sq < 0.75 THEN -0.75::DOUBLE * ln(1.0::DOUBLE - (4.0::DOUBLE / 3.0::DOUBLE) * sq) END AS snp FROM shares)""",
)
def chain_distance(spark, d):
    around = _around_members(spark, d)
    rows = blockgraph.chain_pairs(_aligned(spark, d), around, around)
    return rows.select("t1", "t2", (F.round("snp", 9) + F.lit(0.0)).alias("snp"), "breakpoint", F.round("distance", 9).alias("distance"))


def _around(seq, start, length):
    """Bases of a thread that repeats a document's bases over and over: a gap of months is read whole, however short the document."""
    n = F.length(seq)
    begin = F.pmod(start, n.cast("long"))
    return F.substring(F.repeat(seq, F.ceil((begin + length) / n).cast("int")), (begin + 1).cast("int"), length.cast("int"))


READ = "substring(repeat(seq, CAST(ceil(({0} % length(seq) + {1}) / length(seq)::DOUBLE) AS BIGINT)), CAST({0} % length(seq) + 1 AS BIGINT), CAST({1} AS BIGINT))"
CONSENSUS = f""",
bases AS (SELECT DISTINCT thread, q.seq FROM seg JOIN {b.SEQUENCES} q ON seg.thread % (SELECT count(*) FROM documents) = q.doc_id WHERE length(q.seq) > 0),
path AS (SELECT block_id, (SELECT count(*) FROM kept) - 1 - up AS rank FROM kept),
heads AS (SELECT block_id, min((thread, start, length)) AS x FROM seg GROUP BY block_id),
gaps AS (SELECT b1, b2, min((adj_len, thread, adj_start)) AS x FROM adj GROUP BY b1, b2),
pieces AS (
  SELECT rank * 2 AS pos, {READ.format("struct_extract(x, 2)", "struct_extract(x, 3)")} AS piece FROM path JOIN heads USING (block_id) JOIN bases ON bases.thread = struct_extract(x, 1)
  UNION ALL
  SELECT p.rank * 2 + 1, {READ.format("struct_extract(x, 3)", "greatest(struct_extract(x, 1), 0)")} FROM path p JOIN path q ON q.rank = p.rank + 1 JOIN gaps ON b1 = p.block_id AND b2 = q.block_id JOIN bases ON bases.thread = struct_extract(x, 2))"""


@query("consensus_sequence", f"{SCORES}{TRACE}{CONSENSUS} SELECT string_agg(piece, '' ORDER BY pos) AS seq FROM pieces")
def consensus_sequence(spark, d):
    """The consensus of the traced path with its whole gaps."""
    segs, path, _ = _trace(spark, d)
    seqs = b.sequences(spark, d).filter(F.length("seq") > 0).select(F.col("doc_id").alias("k"), "seq")
    names = segs.select("thread").distinct().join(seqs, F.pmod(F.col("thread"), F.lit(table(spark, d, "documents").count())) == F.col("k")).select(F.col("thread").alias("name"), "seq")
    return blockgraph.consensus_sequence(path, segs, blockgraph.next_blocks(segs), names, _around)


@query("nj_tree")
def nj_tree(spark, d):
    """A tree for each cluster of documents of three or more."""
    similar = b.similar_documents(spark, d)
    found = Scratch(spark, "trees").save(distances.distances(distances.member_pairs(*similar)), "distances")
    members = distances.clusters(distances.distances(distances.class_links(*similar)), least_size=3)
    one, two = members.select(F.col("name").alias("i"), "cluster_id"), members.select(F.col("name").alias("j"), F.col("cluster_id").alias("c2"))
    rows = found.join(one, "i").join(two, "j").filter("cluster_id = c2")
    return tree.trees(rows.select("cluster_id", F.lpad(F.col("i").cast("string"), 12, "0").alias("t1"), F.lpad(F.col("j").cast("string"), 12, "0").alias("t2"), F.abs("d").alias("distance")))


def _matches(spark, d) -> tuple[DataFrame, DataFrame]:
    """Order lines as matches between suppliers: each of an order's parts against the first supplier of its order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), (F.col("l_partkey") % 900).alias("at"), F.rint("l_quantity").cast("long").alias("length"), F.col("l_linenumber").cast("long").alias("n"))
    first = rows.groupBy("l_orderkey").agg(F.min(F.struct("n", "name", "at")).alias("x"))
    pairs = rows.join(first, "l_orderkey").filter(F.col("name") != F.col("x.name"))
    matches = pairs.select(F.col("l_orderkey").alias("line"), F.col("x.name").alias("name1"), F.col("name").alias("name2"), F.col("x.at").alias("start1"), F.col("at").alias("start2"), F.col("length"), F.lit(True).alias("strand"), F.col("length").alias("score"))
    return matches, rows.select("name", F.lit(1000).cast("long").alias("length")).distinct()


@query("pinch_blocks")
def pinch_blocks(spark, d):
    return pinch.pinch_blocks(*_matches(spark, d))


@query("block_order")
def block_order(spark, d):
    return pinch.block_places(*_matches(spark, d))


def _dense(spark, d) -> DataFrame:
    """Documents' bases without the N of spaces and signs."""
    return b.sequences(spark, d).select(F.col("doc_id").cast("string").alias("name"), F.replace("seq", F.lit("N"), F.lit("")).alias("seq"))


@query("acyclic")
def acyclic(spark, d):
    return pinch.component_facts(*_matches(spark, d), wanted=("acyclic", "n_blocks")).select("component", "acyclic", "n_blocks")


@query("directed_walk")
def directed_walk(spark, d):
    rows = pinch.component_facts(*_matches(spark, d), wanted=("reached",))
    return rows.select("component", F.explode("reached").alias("thread"))


@query("dense_path")
def dense_path(spark, d):
    rows = pinch.component_facts(*_matches(spark, d), wanted=("dense_path",))
    return rows.select("component", F.posexplode("dense_path").alias("rank", "block"))


@query("seed_align")
def seed_align(spark, d):
    rows = aligning.seed_alignments(_dense(spark, d), k=24)
    return rows.withColumn("cigar", formats.cigar_line(*(F.col(c) for c in ("q", "qs", "qe", "t", "ts", "te", "seeds")), F.col("qe") - F.col("qs")))


@query("library_plan")
def library(spark, d):
    """The plan on documents up to the library: candidates, masking, alignments, families and the consensus sequences of these."""
    return library_plan(spark, _dense(spark, d), until="consensus")["consensus"]


@query("library_families")
def library_families(spark, d):
    return library_plan(spark, _dense(spark, d), until="families")["families"]


@query("library_annotations")
def library_annotations(spark, d):
    """Where the library's consensus sequences lie in the documents."""
    return library_plan(spark, _dense(spark, d), genome=_dense(spark, d))["annotations"]
