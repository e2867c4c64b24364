"""Hand-computed vectors for operators that are not expressed in SQL, and for edge cases of those that are."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as fn
from strandloom.operators import aligning, blockgraph, candidates, distances, intervals, pinch, seeds, tree
from strandloom.operators.components import connected_components
from strandloom.plans.pipeline import aligned_pairs, library_plan
from strandloom.runtime import Scratch
from strandloom.sources import formats


@pytest.mark.parametrize(
    ("shared", "i", "j", "printed"),
    [(25, 100, 100, None), (26, 100, 100, "3.238116"), (50, 100, 100, "0.823959"), (60, 80, 120, "0.571605"), (90, 100, 100, "0.107326"), (100, 100, 100, "-0.000000"), (110, 100, 100, "-0.093872"), (150, 100, 100, "-0.383119")],
)
def test_distance_of_shared_content(spark, shared, i, j, printed):
    rows = distances.distances(spark.createDataFrame([("a", "b", shared, i, j)], "i string, j string, m long, len_i long, len_j long"))
    got = [r.line for r in rows.select(formats.distance_line(F.col("i"), F.col("j"), F.col("d")).alias("line")).collect()]
    assert [x.removeprefix("a b ").replace("-0.000000", "0.000000") for x in got] == ([] if printed is None else [printed.replace("-0.000000", "0.000000")])


def test_overlap_fraction(spark):
    df = spark.createDataFrame([(100, 110, 90, 120), (100, 110, 110, 120), (0, 100, 0, 79), (0, 5, 6, 9)], "s long, e long, s2 long, e2 long")
    assert [r.f for r in df.select(fn.overlap_fraction("s", "e", "s2", "e2").alias("f")).collect()] == [1.1, 0.1, 0.8, 0.0]


CASES = [
    ([(0, 100, 200)], [(0, 100, 200)], {(0, 0)}),
    ([(0, 100, 200), (1, 101, 201)], [(0, 100, 200)], {(0, 0)}),
    ([(0, 100, 500), (1, 110, 210)], [(0, 105, 205), (1, 120, 520)], {(1, 0)}),
    ([(0, 31, 69), (1, 52, 85), (2, 21, 43), (3, 7, 23)], [(0, 6, 25), (1, 25, 44), (2, 31, 64), (3, 24, 39)], {(3, 0), (0, 2)}),
    ([], [(0, 1, 9)], set()),
]


@pytest.mark.parametrize(("query", "reference", "want"), CASES)
def test_greedy_match(spark, query, reference, want):
    side = lambda rows: spark.createDataFrame([(i, s, e, 0) for i, s, e in rows], "id long, s long, e long, chrom long")
    got = intervals.greedy_match(side(query), side(reference), piece=2)
    assert {tuple(r) for r in got.collect()} == want
    every = {tuple(r)[:2] for r in intervals.overlap_pairs(side(query), side(reference), 16).collect()}
    assert want <= every


def test_greedy_match_in_pieces_is_the_global_merge(spark):
    import random

    rng = random.Random(5)
    make = lambda: [(i, s, s + rng.randint(5, 60)) for i in range(120) for s in [rng.randint(0, 4000)]]
    q, r = make(), make()
    one, two = sorted(q, key=lambda x: (x[1], x[2], x[0])), sorted(r, key=lambda x: (x[1], x[2], x[0]))
    i = j = 0
    want = set()
    frac = lambda a, b: 0 if a[1] > b[2] or b[1] > a[2] else (min(a[2], b[2]) - max(a[1], b[1]) + 1) / (a[2] - a[1])
    while i < len(one) and j < len(two):
        if frac(one[i], two[j]) > 0.8 and frac(two[j], one[i]) > 0.8:
            want.add((one[i][0], two[j][0]))
            i, j = i + 1, j + 1
        elif two[j][1] < one[i][1]:
            j += 1
        else:
            i += 1
    side = lambda rows: spark.createDataFrame([(i, s, e, 0) for i, s, e in rows], "id long, s long, e long, chrom long")
    assert {tuple(x) for x in intervals.greedy_match(side(q), side(r), piece=20).collect()} == want


def test_matches_across_pieces_and_chromosomes(spark, monkeypatch):
    import random

    rng = random.Random(8)
    q, r, want = [], [], set()
    frac = lambda a, b: 0 if a[0] > b[1] or b[0] > a[1] else (min(a[1], b[1]) - max(a[0], b[0]) + 1) / (a[1] - a[0])
    for chrom in ("x", None, "y"):
        one = [(s, s + rng.randint(20, 300), len(q) + k) for k in range(150) for s in [rng.randint(0, 900)]]
        two = [(max(0, s + rng.randint(-9, 9)), e + rng.randint(-9, 9), len(r) + k) for k, (s, e, _) in enumerate(one)]
        q, r = q + [(i, s, e, chrom) for s, e, i in one], r + [(i, s, e, chrom) for s, e, i in two]
        one, two, i, j = sorted(one), sorted(two), 0, 0
        while i < len(one) and j < len(two):
            if frac(one[i], two[j]) > 0.8 and frac(two[j], one[i]) > 0.8:
                want.add((one[i][2], two[j][2]))
                i, j = i + 1, j + 1
            elif two[j][0] < one[i][0]:
                j += 1
            else:
                i += 1
    rounds, save = [], intervals.Scratch.save
    monkeypatch.setattr(intervals.Scratch, "save", lambda self, df, name: rounds.append(name) or save(self, df, name))
    side = lambda rows: spark.createDataFrame([*rows, (999, None, 5, "x")], "id long, s long, e long, chrom string")
    got = [tuple(x) for x in intervals.greedy_match(side(q), side(r), by_chrom=True, piece=40).collect()]
    assert set(got) == want and len(got) == len(want)
    assert rounds.count("exits") > 1  # some pointers did cross a start


def test_interval_of_no_length_raises(spark):
    with pytest.raises(Exception, match="must be below"):
        intervals.checked(spark.createDataFrame([(1, 5, 5)], "id long, s long, e long")).collect()


def test_n_filter(spark):
    df = spark.createDataFrame([("a", "ACGTNACGTA"), ("b", "ACGTN"), ("c", "acgtn"), ("d", "")], "name string, seq string")
    assert {r.name for r in candidates.filter_n(df).collect()} == {"a", "c"}


def test_candidates(spark):
    rows = [("g", k, "s", 0, n, p) for k, (n, p) in enumerate([(99, False), (100, False), (500, True), (10000, False), (10001, False), (200, False)])]
    df = spark.createDataFrame(rows, "genome string, seg_index long, sequence string, start long, length long, has_parent boolean")
    got = {(r.i, r.length) for r in candidates.candidate_segments(df).collect()}
    assert got == {(0, 100), (1, 10000)}
    assert {(r.i, r.length) for r in candidates.candidate_segments(df, max_sequences=1).collect()} == {(0, 100)}
    assert {r.length for r in candidates.candidate_segments(df, include_last=True).collect()} == {100, 10000, 200}


def test_clusters_of_distance_lines(spark):
    lines = spark.createDataFrame([("a b 0.05",), ("b c 0.1",), ("",), ("c d -0.5",), ("e f 0.3",)], "value string")
    found = formats.parse_distances(lines)
    groups = lambda **o: {r.members for r in formats.cluster_lines(distances.clusters(found, 0.1, **o)).collect()}
    assert groups() == {"a b", "c", "d", "e", "f"}
    assert groups(absolute=False, least_size=2) == {"a b", "c d"}


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(1001, 1001), (None, 3)]
    df = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1400), 1000)}
    assert connected_components(df.filter("a < -1"), "a", "b", Scratch(spark, "t")).count() == 0


PATHS = [
    ([(0, 1, 3, 0), (1, 2, 3, 1), (2, 3, 3, 0)], [0, 3, 5, 8], [1, 2, 3], 5),
    ([(0, 1, 3, 0), (0, 2, 2, 0), (1, 3, 2, 0), (2, 3, 3, 0)], [0, 3, 2, 5], [2, 3], 3),
    ([(0, 1, 9, 0), (0, 2, 1, 0), (1, 3, 2, 0), (2, 3, 3, 0)], [0, 9, 1, 4], [1], 0),
    ([(0, 1, 3, 5)], [0, -2], [], None),
]


@pytest.mark.parametrize(("edges", "scores", "path", "path_score"), PATHS)
def test_heaviest_path(spark, edges, scores, path, path_score):
    order = spark.createDataFrame([(k, k) for k in range(len(scores))], "block_id long, pos long")
    df = spark.createDataFrame(edges, "b1 long, b2 long, shared long, min_adj long")
    scored = blockgraph.path_scores(order, blockgraph.best_predecessor(blockgraph.edge_scores(df, order)), Scratch(spark, "t"))
    assert [r.score for r in scored.orderBy("pos").collect()] == scores
    segs = spark.createDataFrame([(t, k * 10, 5, k) for k in range(len(scores)) for t in range(3)], "thread long, start long, length long, block_id long")
    got, total = blockgraph.trace_path(scored, order, segs, Scratch(spark, "t"))
    assert [r.pos for r in got.orderBy("rank").collect()] == path
    assert total.first()[0] == path_score


def test_heaviest_path_stops_after_bad_blocks(spark):
    order = spark.createDataFrame([(k, k) for k in range(9)], "block_id long, pos long")
    df = spark.createDataFrame([(k, k + 1, 2, 0) for k in range(8)], "b1 long, b2 long, shared long, min_adj long")
    scored = blockgraph.path_scores(order, blockgraph.best_predecessor(blockgraph.edge_scores(df, order)), Scratch(spark, "t"))
    segs = spark.createDataFrame([(t, k, 1, k) for k in range(9) for t in ((1, 2) if k > 6 else (9,))], "thread long, start long, length long, block_id long")
    got, total = blockgraph.trace_path(scored, order, segs, Scratch(spark, "t"))
    assert [r.pos for r in got.orderBy("rank").collect()] == [7, 8]
    assert total.first()[0] == 12


def test_consensus_of_two_blocks(spark):
    import random

    seq = "".join(random.Random(3).choice("ACGT") for _ in range(100))
    segs = spark.createDataFrame([(t, s, 10, b) for t in ("1", "2") for s, b in ((20, 0), (50, 1))], "thread string, start long, length long, block_id long")
    path = spark.createDataFrame([(0, 0), (1, 1)], "rank long, block_id long")
    got = blockgraph.consensus_sequence(path, segs, blockgraph.next_blocks(segs, width=16), spark.createDataFrame([("1", seq), ("2", seq)], "name string, seq string")).first().seq
    assert got == seq[20:60]


# --- pinch graphs -----------------------------------------------------------------------------------


def test_acyclic_until_a_reversed_pinch():
    g = pinch.Graph({1: 100, 2: 100})
    g.pinch(1, 2, 10, 10, 10)
    g.pinch(1, 2, 40, 40, 10)
    assert g.acyclic()
    g.pinch(1, 2, 70, 70, 10, False)
    assert not g.acyclic()


def test_connecting_threads():
    g = pinch.Graph({1: 100, 2: 100})
    for s, n in ((50, 10), (70, 10), (90, 5)):
        g.pinch(1, 2, s, s, n)
    blocks = [g.block[(1, s)] for s in (50, 70, 90)]
    assert g.connecting(blocks[0], blocks[1]) == [(1, 60, 10), (2, 60, 10)]
    assert g.connecting(blocks[0], blocks[2]) == []
    assert len(g.ends(blocks[0], True)) == 1
    assert g.first_block(1) == blocks[0]
    assert g.adjacent_end((1, 0), True) == (blocks[0], False)
    assert g.dense_path()[0] == blocks[0]


def test_ordering_of_two_components():
    g = pinch.Graph({1: 100, 2: 100, 3: 100, 4: 100})
    for a, b in ((1, 2), (3, 4)):
        for s in (50, 70):
            g.pinch(a, b, s, s, 10)
    assert len(g.ordering()) == 4
    assert len({b for b, _ in g.ordering()}) == 4


def test_single_copy_and_walks():
    g = pinch.Graph({1: 100, 2: 100, 3: 100})
    g.pinch(1, 2, 10, 10, 10, True, pinch.single_copy)
    g.pinch(1, 2, 30, 12, 5, True, pinch.single_copy)  # block of thread 1 and 2 already
    assert g.segment(1, 31)[0] not in g.block
    g.pinch(2, 3, 10, 50, 10, True, pinch.single_copy)
    assert g.degree((1, 10)) == 3
    assert g.walk_exists((1, 0), g.segment(3, 70)[0], True)
    assert not g.walk_exists(g.segment(1, 30)[0], (2, 0), True)
    assert pinch.acyclic_filter(g, (1, 0), g.segment(3, 70)[0])


def test_overlapping_pinches_cut_blocks_alike():
    g = pinch.Graph({"a": 50, "b": 50, "c": 50})
    g.pinch("a", "b", 0, 0, 40)
    g.pinch("b", "c", 10, 0, 20)
    lengths = sorted((len(s), g.length(s[0])) for s in g.blocks.values())
    assert lengths == [(2, 10), (2, 10), (3, 20)]


def test_pinch_blocks_frame(spark):
    lines = spark.createDataFrame([("cigar: s1 0 30 + s2 5 35 + 90 M 10 I 5 D 5 M 15",), ("cigar: s1 0 10 + s3 0 10 - 50 M 10",)], "value string")
    matches = formats.pinches(formats.parse_cigar(lines))
    assert {(r.start1, r.start2, r.length, r.strand) for r in matches.filter("name2 = 's2'").collect()} == {(0, 5, 10, True), (15, 20, 15, True)}
    out = pinch.pinch_blocks(matches, spark.createDataFrame([("s1", 100), ("s2", 100), ("s3", 100)], "name string, length long"))
    assert {(r.thread, r.start, r.length) for r in out.collect()} == {("s1", 0, 10), ("s2", 5, 10), ("s1", 15, 15), ("s2", 20, 15)}


# --- trees, alignments, formats, plan ------------------------------------------------------------------


def test_neighbour_joining_recovers_an_additive_tree():
    d = {("a", "b"): 5, ("a", "c"): 9, ("a", "d"): 9, ("b", "c"): 10, ("b", "d"): 10, ("c", "d"): 8}
    text = tree.neighbour_join(list("abcd"), d)
    assert "a:2.000000" in text
    assert "b:3.000000" in text
    assert "c:4.000000" in text
    assert tree.neighbour_join(["x"], {}) == "x;"


def test_seed_alignments_and_annotation(spark):
    import random

    rng = random.Random(1)
    core, other = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (120, 300))
    seqs = spark.createDataFrame([("a", "TTT" + core), ("b", core + "GG"), ("c", other)], "name string, seq string")
    got = {(r.q, r.t, r.diagonal) for r in aligning.seed_alignments(seqs, k=13).collect()}
    assert got == {("a", "b", -3), ("b", "a", 3)}
    genome = spark.createDataFrame([("chr", other + core + other[:50])], "name string, seq string")
    places = aligning.annotate(seqs.filter("name = 'b'"), genome).collect()
    assert len(places) == 1
    assert abs(places[0].start - 300) <= 2
    assert places[0].end >= 418


def _seeds_by_hand(rows, k, least=1):
    """(q, t, diagonal): [places of q's shared seeds], pair by pair."""
    at = [(name, p, seq.upper()[p : p + k]) for name, seq in rows for p in range(len(seq) - k + 1) if "N" not in seq.upper()[p : p + k]]
    found = {}
    for q, x, one in at:
        for t, y, two in at:
            if one == two and q != t:
                found.setdefault((q, t, y - x), []).append(x)
    return {key: x for key, x in found.items() if len(x) >= least}


def test_seed_alignments_make_no_row_for_a_shared_seed(spark):
    import random

    rng = random.Random(21)
    dna = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    line = dna(30)
    rows = [(f"s{i}", dna(rng.randrange(9), "acgtN") + (line if i % 3 else line[:14] + "N" + line[13:]) * (1 + i % 2) + dna(rng.randrange(9))) for i in range(24)]
    rows += [("s1", dna(4) + line), ("r", "AC" * 20), ("p", "CA" * 9 + "N" + "A" * 12), ("o", "\u00e9\u00dfACGT\u00e9ACGTA"), ("o2", "\u00c9SSACGT\u00c9ACGTAC")]
    seqs = spark.createDataFrame([*rows, (None, line), ("none", None), ("short", "ACG")], "name string, seq string")
    upper = [(n, s.upper()) for n, s in rows]
    for k in (6, 9):
        scratch = Scratch(spark, "seeds")
        marks = scratch.save(seeds.seed_marks(seqs, k, scratch, size=100), "kept")
        for tile in (5, 100):
            got = {(r.q, r.t, r.diagonal): (r.qs, r.qe, r.ts, r.te, r.seeds) for r in seeds.diagonals(marks, k, scratch, tile=tile).collect()}
            want = _seeds_by_hand(upper, k, 2)
            assert got == {(q, t, d): (min(x), max(x) + k, min(x) + d, max(x) + d + k, len(x)) for (q, t, d), x in want.items()}
        top = {}
        for (q, t, d), x in sorted(want.items(), key=lambda r: (r[0][0], -len(r[1]), r[0][1], r[0][2])):
            top.setdefault(q, []).append((t, d))
        got = aligning.depth_cap(seeds.diagonals(marks, k, scratch, depth=2, tile=5), ["q"], [F.desc("seeds"), F.asc("t"), F.asc("diagonal")], 2).collect()
        assert sorted((r.q, r.t, r.diagonal) for r in got) == sorted((q, *x) for q, xs in top.items() for x in xs[:2])
    # Where all have the line, what is kept of each is its ends, not its 22 seeds.
    same = spark.createDataFrame([(f"s{i}", line) for i in range(50)], "name string, seq string")
    marks = seeds.seed_marks(same, 9, Scratch(spark, "seeds"))
    assert {(len(r["first"]), len(r["last"])) for r in marks.collect()} == {(1, 1)}
    assert {r.seeds for r in aligning.seed_alignments(same, 9, depth=None).collect()} == {22}


def test_bands_of_windows_add_up(spark):
    import collections
    import random

    rng = random.Random(17)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = dna(150), dna(90)
    lib = [("a", a), ("b", b), ("r", "AC" * 40), ("n", a[:70] + "N" + b[:60])]
    gen = [("x", dna(300) + a + dna(77) + b + dna(30) + a[20:120]), ("y", "CA" * 120 + dna(50) + a.lower()), ("w", b)]
    want = collections.defaultdict(set)
    for name, x in lib:
        for chrom, y in gen:
            for i in range(len(x) - 10):
                for j in range(len(y) - 10):
                    if x[i : i + 11] == y.upper()[j : j + 11]:
                        want[name, chrom, (j - i) // 32].add(j)
    want = sorted((*key, min(x), max(x) + 11, len(x)) for key, x in want.items() if len(x) >= 5)
    tables = [spark.createDataFrame([*rows, ("none", None), ("short", "AC")], "name string, seq string") for rows in (lib, gen)]
    for size in (64, 100, 1 << 20):
        assert sorted(map(tuple, seeds.bands(*tables, 11, Scratch(spark, "bands"), least=5, size=size).collect())) == want


def test_diagonals_of_tiles_come_in_blocks():
    rng = np.random.default_rng(3)

    def side(n, far=0):
        g, doc, at, letter = rng.integers(0, 4, n).astype(np.uint64), rng.integers(0, 5, n).astype(np.uint32), rng.permutation(n).astype(np.uint32) + far, rng.integers(0, 4, n).astype(np.uint32)
        order = np.lexsort((letter, g))
        return seeds._Side(g[order], doc[order], at[order], letter[order])

    for far in (0, 1 << 30):
        one, two = side(60, np.uint32(far)), side(80)
        for same in (False, True):
            other = one if same else two
            want = {}
            for i in range(len(one.g)):
                for j in range(len(other.g)):
                    if one.g[i] == other.g[j] and (one.letter[i] != other.letter[j] or one.letter[i] == 0) and (not same or one.doc[i] < other.doc[j]):
                        want.setdefault((int(one.doc[i]), int(other.doc[j]), int(other.at[j]) - int(one.at[i])), []).append(int(one.at[i]))
            for size in (2, 50, 1 << 20):
                blocks = list(seeds._diagonals([one, one], [other, other], 1, same, size))
                got = [tuple(map(int, x)) for b in blocks for x in zip(*b, strict=True)]
                assert got == [(*key, min(x), max(x) + 1, len(x)) for key, x in sorted(want.items())]
            assert len(list(seeds._diagonals([one, one], [other, other], 1, same, 2))) > 5


def test_mask_tandem_repeats(spark):
    df = spark.createDataFrame([("a", "ACGT" + "CA" * 6 + "TTGG"), ("b", "ACGTTGCA")], "name string, seq string")
    got = {r.name: r.seq for r in candidates.mask_tandem_repeats(df).collect()}
    assert got == {"a": "ACGT" + "N" * 12 + "TTGG", "b": "ACGTTGCA"}


def test_fasta_file(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">one\nACG\nTT\n>two words\nGGG\n")
    assert {(r.name, r.seq) for r in formats.read_fasta(spark, str(p)).collect()} == {("one", "ACGTT"), ("two words", "GGG")}


def test_formats_refuse_and_skip(spark, tmp_path):
    lines = spark.createDataFrame([("a b c",)], "value string")
    with pytest.raises(Exception, match="not 9 fields"):
        formats.parse_gff(lines).collect()
    ann = spark.createDataFrame([(" ".join(map(str, range(15))),), ("too short",)], "value string")
    assert [tuple(r) for r in formats.parse_annotations(ann).collect()] == [("4", 5, 6, "14", "9")]
    out = str(tmp_path / "out")
    formats.write_lines(lines, "value", out)
    with pytest.raises(Exception, match="(?i)exist"):
        formats.write_lines(lines, "value", out)
    matrix = spark.createDataFrame([("GAP-PENALTIES=12 6 6",), ("A C",), ("A 4 -1",), ("C -1 5",)], "value string")
    assert {tuple(r) for r in formats.parse_matrix(matrix).collect()} == {("A", "A", 4), ("A", "C", -1), ("C", "A", -1), ("C", "C", 5)}


def test_regions_and_features(spark):
    seqs = spark.createDataFrame([("s", "ACGTACGT")], "name string, seq string")
    assert formats.genome_region(seqs, "s", 0, 3).first().seq == "ACG"
    assert formats.genome_region(seqs, "s", 2).first().seq == "GTACGT"
    feats = spark.createDataFrame([("s", 2, 4)], "seqid string, start long, end long")
    assert formats.extract(seqs, feats).first().bases == "GTA"
    assert spark.range(1).select(formats.consensus_record("p", F.lit(0), F.lit("ACG"), F.lit(7)).alias("r")).first().r == ">p_consensus_0 length=3 score=7\nACG"


def test_concordance_needs_pairs(spark):
    one = spark.createDataFrame([(1, 2, 1, 0, 0)], "s long, e long, id long, qf long, rf long")
    assert tuple(intervals.concordance(one).first()) == (0, 0, None)
    rows = [(i, i + 1, i, i % 3, (i // 2) % 3) for i in range(130)]
    got = intervals.concordance(spark.createDataFrame(rows, "s long, e long, id long, qf long, rf long")).first()
    pairs = [((rows[i][3] == rows[j][3]) == (rows[i][4] == rows[j][4])) for i in range(0, 130, 50) for j in range(i)]
    assert (got.concordant, got.total) == (sum(pairs), len(pairs))


def test_plan_stops_and_reuses(spark, tmp_path):
    import random

    rng = random.Random(2)
    core = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = spark.createDataFrame([("a", core), ("b", core), ("c", "".join(rng.choice("ACGT") for _ in range(200)))], "name string, seq string")
    assert list(library_plan(spark, seqs, until="masked")) == ["candidates", "masked"]
    out = library_plan(spark, seqs)
    assert {(r.name, r.cluster_id) for r in out["families"].collect()} == {("a", "a"), ("b", "a")}
    formats.export({"masked": out["masked"], "nested": {"families": out["families"], "none": None}}, str(tmp_path / "run"))
    ready = formats.precomputed(spark, str(tmp_path / "run"))
    assert "masked" in ready


def test_plan_keeps_all_copies_in_a_family(spark):
    import random

    rng = random.Random(4)
    core, other = ("".join(rng.choice("ACGT") for _ in range(200)) for _ in range(2))
    seqs = spark.createDataFrame([(f"c{k}", core) for k in range(7)] + [("x", other), ("y", other)], "name string, seq string")
    out = library_plan(spark, seqs)
    want = {(f"c{k}", "c0") for k in range(7)} | {("x", "x"), ("y", "x")}
    assert {(r.name, r.cluster_id) for r in out["families"].collect()} == want
    assert out["alignments"].groupBy("q").count().filter("count > 2").count() == 0
    # Capped alignments of an earlier run are pairs whichever way they were aligned.
    again = library_plan(spark, seqs, ready={"alignments": out["alignments"]})
    assert {(r.name, r.cluster_id) for r in again["families"].collect()} == want


def test_the_library_keeps_no_row_for_each_alignment(spark, monkeypatch):
    import random

    rng = random.Random(19)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    line, cores = dna(26), [dna(150) for _ in range(4)]
    rows = [(f"s{i:02}", dna(90) + line + dna(90)) for i in range(40)] + [(f"c{i:02}", dna(i % 5) + cores[i % 4] + line + cores[i % 4][:60]) for i in range(16)]
    seqs = spark.createDataFrame(rows, "name string, seq string")
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(save(self, df, name)) or saved[-1])
    out = library_plan(spark, seqs, until="consensus")
    tables = max(t.count() for t in saved if spark._jvm.java.io.File(t._scratch_path.removeprefix("file:")).exists())
    every = out["all_alignments"]
    assert every.count() > 2500 and tables < 1000
    # The same as of all alignments.
    again = library_plan(spark, seqs, until="consensus", ready={"masked": out["masked"], "all_alignments": every})
    for stage in ("alignments", "families", "consensus"):
        one, two = (sorted(map(tuple, x[stage].collect())) for x in (out, again))
        assert one and one == two


def test_aligned_pairs_count_a_place_once(spark):
    rows = [("a", "b", 0, 0, 60, 0, 60), ("b", "a", 0, 0, 60, 0, 60), ("b", "a", 5, 50, 100, 55, 105)]
    got = aligned_pairs(spark.createDataFrame(rows, "q string, t string, diagonal long, qs long, qe long, ts long, te long")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 100)]


def test_snp_pairs_by_tiles(spark):
    import collections
    import random

    from strandloom.operators import blockgraph

    rng = random.Random(4)
    rows = [(block, rng.randrange(25), "".join(rng.choice("ACGTNacgt") for _ in range(3 * block))) for block in range(9) for _ in range(14)]
    want = collections.defaultdict(lambda: [0, 0])
    for b1, t1, x in rows:
        for b2, t2, y in rows:
            if b1 == b2 and t1 < t2:
                same = sum(p == q for p, q in zip(x.upper(), y.upper(), strict=True))
                want[t1, t2][0] += same
                want[t1, t2][1] += len(x) - same
    plain = spark.createDataFrame([*rows, (None, 1, "A"), (1, None, "AAA"), (1, 90, None)], "block_id long, thread long, bases string")
    named = plain.withColumn("thread", F.format_string("t%03d", "thread"))
    for tile, blocks in ((256, 1024), (4, 2)):
        got = {(r.t1, r.t2): [r.same, r.different] for r in blockgraph.snp_pairs(plain, tile, blocks).collect()}
        assert got == want
    got = {(int(r.t1[1:]), int(r.t2[1:])): [r.same, r.different] for r in blockgraph.snp_pairs(named.filter("thread <> 'tnull'"), 4).collect()}
    assert got == want
    assert blockgraph.snp_pairs(plain.filter("thread < 0")).count() == 0


def test_identity_and_jukes_cantor(spark):
    df = spark.createDataFrame([("ACGT", "acga"), ("", "")], "a string, b string")
    assert [r.n for r in df.select(fn.identity_count("a", "b").alias("n")).collect()] == [3, 0]
    x = spark.range(1).select(fn.jukes_cantor_different(F.lit(0.3)).alias("d"), fn.jukes_cantor_different(F.lit(0.8)).alias("none")).first()
    assert math.isclose(x.d, -0.75 * math.log(1 - 4 / 3 * 0.3))
    assert x.none is None


# --- directions, chains, consensus --------------------------------------------------------------


def three_blocks():
    g = pinch.Graph({1: 100, 2: 100, 3: 100})
    for s in (10, 22, 40):
        g.pinch(1, 2, s, s, 10)
        g.pinch(2, 3, s, s, 10)
    return g


def test_path_scores_by_the_hand_vectors():
    g = three_blocks()
    order = g.ordering()
    assert [side for _, side in order] == [False] * 3
    # Gaps 2 and 8, three shared threads: 3 - 2, then 1 + 3 - 8.
    assert g.path_scores(order) == ([0, 1, -4], [-1, 0, 1])
    assert g.path_scores(order, 0) == ([0, 3, 6], [-1, 0, 1])
    assert [(s, [b for b, _ in p]) for s, p in g.chains(0)] == [(3, [order[1][0], order[2][0]])]
    assert g.pieces(g.chains(0)[0][1]) == [(1, 22, 10, True), (1, 32, 8, True), (1, 40, 10, True)]


def test_edges_against_the_direction_do_not_count():
    g = three_blocks()
    order = g.ordering()
    turned = [order[0], (order[1][0], True), order[2]]  # the middle block entered by its right end
    assert g.path_scores(turned, 0) == ([0, 0, 0], [-1, -1, -1])


def test_reversed_threads_are_read_in_the_path_s_direction():
    g = pinch.Graph({1: 100, 2: 100})
    for s, t in ((10, 70), (22, 56), (40, 40)):
        g.pinch(1, 2, s, t, 10, False)
    ((score, path),) = g.chains(0)
    assert score == 2
    # From 32 to 40 thread 1 has 8 bases; thread 2 runs the other way and has 6, from 50 to 56.
    assert g.pieces(path) == [(1, 22, 10, True), (2, 50, 6, False), (1, 40, 10, True)]


def test_edge_scores_of_the_table_follow_the_sides(spark):
    segs = spark.createDataFrame([("a", 0, 10, 0, True), ("a", 20, 10, 1, True), ("a", 40, 10, 2, True), ("b", 0, 10, 2, False), ("b", 13, 10, 1, False)], "thread string, start long, length long, block_id long, strand boolean")
    adj = blockgraph.next_blocks(segs, width=16)
    assert {(r.b1, r.right1, r.b2, r.right2) for r in adj.collect()} == {(0, True, 1, False), (1, True, 2, False), (2, False, 1, True)}
    low = blockgraph.min_adjacency(blockgraph.both_ways(adj))
    edges = low.join(blockgraph.shared_threads(low, segs), ["b1", "b2"])
    score = lambda sides: {tuple(r) for r in blockgraph.edge_scores(edges, spark.createDataFrame([(k, k, s) for k, s in enumerate(sides)], "block_id long, pos long, right boolean")).select("left_pos", "right_pos", "score").collect()}
    assert score([False, False, False]) == {(0, 1, 1 - 10), (1, 2, 2 - 3)}
    assert score([False, True, False]) == set()
    lines = {r.line for r in blockgraph.graph_dot(segs, adj).collect()}
    assert {"0r -- 1l", "1r -- 2l", "2l -- 2r"} <= lines and len(lines) == 6 + 3 + 2


def test_the_library_has_the_copies_consensus(spark):
    import random

    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c = dna(120), dna(120), dna(120)
    # Copies of a-b-c with stretches of their own between, the shortest 5 long.
    rows = [(f"s{k}", a + dna(5 + 3 * k) + b + dna(9) + c) for k in range(4)]
    seqs = spark.createDataFrame(rows, "name string, seq string")
    out = library_plan(spark, seqs, threshold=0.3, gap_penalty=0, genome=seqs)
    made = out["consensus"].collect()
    assert [r.n for r in made] == list(range(len(made))) and made
    best = max(made, key=lambda r: len(r.seq))
    # A base beside a copy that agrees by chance is glued too, so the ends may be a little wider and the mean degree below 4.
    assert b[5:-5] in best.seq and c[5:-5] in best.seq and 2 <= best.degree <= 4
    assert out["records"].first().record.startswith(">library_consensus_0 length=")
    assert out["annotations"].count() > 0
    limits = library_plan(spark, seqs, threshold=0.3, gap_penalty=0, min_consensus_degree=4.5, until="consensus", ready={"masked": out["masked"], "families": out["families"], "all_alignments": out["all_alignments"]}, rule=lambda g, x, y: pinch.single_copy(g, x, y))
    assert limits["consensus"].count() == 0 and limits["families"] is out["families"]
    assert "consensus" not in library_plan(spark, seqs, skip=("consensus",), genome=None)


def test_small_pieces(spark):
    assert fn.file_url("/a/b") == "file:///a/b"
    lines = spark.createDataFrame([(7, "cigar: x 0 9 + y 2 11 + 30 M 9"), (8, "cigar: y 0 4 + z 0 4 + 5 M 4")], "line long, value string")
    al = formats.parse_cigar(lines)
    assert [r.line for r in aligning.sort_alignments(al).collect()] == [7, 8]
    seqs = spark.createDataFrame([("x", 0, 20), ("y", 1, 30)], "name string, seq_idx long, length long")
    assert [tuple(r) for r in distances.alignment_pairs(al, seqs).select("i", "j", "m", "len_i", "len_j").collect()] == [(0, 1, 9, 20, 30)]
    assert formats.concatenate(al, al).count() == 4
    row = al.filter("line = 7").select(formats.cigar_line(*(F.col(x) for x in ("q", "qs", "qe", "t", "ts", "te", "score")), F.lit(9)).alias("v"), fn.block_weight(F.lit(3), F.lit(5)).alias("w")).first()
    assert (row.v, row.w) == ("cigar: x 0 9 + y 2 11 + 30 M 9", 15)
    d = spark.createDataFrame([("b", "c", 0.5), ("a", "c", 0.25), ("a", "b", 1.0)], "i string, j string, d double")
    assert [r.line for r in formats.distance_rows(d).collect()] == ["a b 1.000000", "a c 0.250000", "b c 0.500000"]
    # Reversed and short matches are left out.
    m = pd.DataFrame([("x", "y", 0, 0, 9, True, 5, 1), ("x", "y", 20, 20, 9, False, 4, 2), ("x", "y", 40, 40, 3, True, 3, 3)], columns=["name1", "name2", "start1", "start2", "length", "strand", "score", "line"])
    assert len(pinch.fold(m, {"x": 100, "y": 100}, None, 5).blocks) == 1


def _random_matches(seed, threads=12, size=60, n=400):
    import random

    rng, rows = random.Random(seed), []
    for k in range(n):
        one, two = rng.sample(range(threads), 2)
        rows.append((f"t{one:02}", f"t{two:02}", rng.randrange(size - 9), rng.randrange(size - 9), rng.randint(1, 9), True, rng.randint(1, 5), k // 3))
    return pd.DataFrame(rows, columns=["name1", "name2", "start1", "start2", "length", "strand", "score", "line"]), {f"t{k:02}": size for k in range(threads)}


def test_full_blocks_are_passed_by_without_asking(monkeypatch):
    monkeypatch.setattr(pinch, "MAX_DEGREE", 4)
    matches, threads = _random_matches(1)
    asked, single_copy = {True: 0, False: 0}, pinch.single_copy

    def rule(graph, one, two):
        asked[graph.limit is not None] += 1
        return single_copy(graph, one, two, 4)

    plain = pinch.fold(matches, threads, rule)  # a rule of the caller's own is asked about every piece
    monkeypatch.setattr(pinch, "single_copy", rule)
    quick = pinch.fold(matches, threads, rule)
    assert (quick.blocks, quick.cuts, quick.forward) == (plain.blocks, plain.cuts, plain.forward)
    assert 0 < asked[True] < asked[False] / 2
    assert all(quick.names[b] == {t for t, _ in segs} for b, segs in quick.blocks.items())
    assert max(map(len, quick.blocks.values())) > 4


def test_the_flat_fold_is_that_of_the_graph(monkeypatch):
    """Blocks, their numbers, order and segments, with blocks over the limit, cuts of glued segments, matches within a thread and equal scores."""
    monkeypatch.setattr(pinch, "MAX_DEGREE", 4)
    single_copy = pinch.single_copy
    for seed in range(4):
        matches, threads = _random_matches(seed)
        matches.loc[matches.index % 9 == 0, "strand"] = False
        g = pinch.fold(matches, threads, lambda graph, one, two: single_copy(graph, one, two, 4), 3)
        flat = pinch.Flat(threads, 4).fold(matches, 3)
        assert {b: sorted((flat.threads[t], int(p - flat.base[t])) for p in at for t in [int(np.searchsorted(flat.base, p, "right")) - 1]) for b, at in flat.blocks.items()} == {b: sorted(segs) for b, segs in g.blocks.items()}
        names = {b: k for k, b in enumerate(sorted(g.blocks, key=lambda b: min(g.blocks[b])))}
        place = {b: (k, right) for k, (b, right) in enumerate(g.ordering())}
        want = [(names[b], t, s, g.length((t, s)), *place[b], len(segs)) for b, segs in g.blocks.items() for t, s in segs]
        rows = flat.rows()
        got = list(zip(*(rows[c].tolist() for c in ("block", "thread", "start", "length", "pos", "right", "degree")), strict=True))
        assert sorted(got) == sorted(want) and max(map(len, g.blocks.values())) > 4
    with pytest.raises(IndexError):
        pinch.Flat({t: 5 for t in threads}).fold(matches)


def test_a_row_for_each_block_is_made_with_its_component(spark):
    matches, threads = _random_matches(5)
    frames = spark.createDataFrame(matches), spark.createDataFrame(list(threads.items()), "name string, length long")
    every = pinch.pinch_blocks(*frames)
    want = sorted(every.select("component", "block", "pos", "right").distinct().collect())
    assert sorted(pinch.block_places(*frames).collect()) == want and len(want) < every.count()
    plain = pinch.pinch_blocks(*frames, rule=lambda g, one, two: pinch.single_copy(g, one, two))
    assert sorted(plain.collect()) == sorted(every.collect())
    assert pinch.block_places(frames[0].filter("line < 0"), frames[1]).count() == 0


def test_the_fold_does_not_depend_on_the_order_of_rows():
    matches, threads = _random_matches(2)
    matches["start1"] = matches["line"] % 50  # as of an order's lines: equal scores, lines and starts
    matches["score"] = 1
    graphs = [pinch.fold(m, threads, pinch.single_copy) for m in (matches, matches.iloc[::-1], matches.sample(frac=1, random_state=3))]
    assert graphs[0].ordering() == graphs[1].ordering() == graphs[2].ordering()
    assert graphs[0].blocks == graphs[1].blocks == graphs[2].blocks


def test_only_wanted_facts_are_made(spark, monkeypatch):
    matches, threads = _random_matches(3)
    frames = spark.createDataFrame(matches), spark.createDataFrame(list(threads.items()), "name string, length long")
    every = pinch.component_facts(*frames, min_length=4)
    assert every.columns == ["component", "n_blocks", "acyclic", "dense_path", "reached"]
    few = pinch.component_facts(*frames, min_length=4, wanted=("dense_path",))
    assert few.columns == ["component", "dense_path"]
    assert few.collect() == every.select("component", "dense_path").collect()


def test_one_walk_reaches_what_the_single_walks_reach():
    for seed in range(6):
        matches, threads = _random_matches(seed, n=12)
        g = pinch.fold(matches, threads, pinch.single_copy)
        start = (min(g.cuts), 0)
        every = [(t, s) for t, cuts in g.cuts.items() for s in cuts[:-1]]
        assert g.reached(start) == {seg for seg in every if g.walk_exists(start, seg, True)}
        assert len(g.reached(start)) < len(every)


def test_ends_met_thread_by_thread():
    for seed in range(3):
        matches, threads = _random_matches(seed, n=30)
        g = pinch.fold(matches, threads, None)
        g.pinch("t00", "t01", 3, 20, 7, False)  # what was known of the ends goes with a pinch
        for block, segs in g.blocks.items():
            for right in (False, True):
                out = set()
                for seg in segs:
                    ahead = g.forward[seg] == right
                    other = g.next_block(seg, ahead)
                    if other is not None:
                        out.add((g.block[other], g.forward[other] != ahead))
                assert g.ends(block, right) == sorted(out)
    assert g._touching is not None


def test_similar_sets_find_every_pair_above_the_least(spark):
    import random

    rng, sets = random.Random(4), []
    for _ in range(40):
        base = [rng.randrange(60) if rng.random() < 0.6 else rng.randrange(10**6) for _ in range(rng.randint(1, 24))]
        for _ in range(rng.randint(1, 3)):
            sets.append(sorted({x if rng.random() < 0.8 else rng.randrange(90) for x in base}))
    sets += sets[:9] + sets[:4]
    want = {}
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            m = len(set(x) & set(y))
            if 8 * m > len(x) + len(y):
                want[i, j] = m, len(x), len(y)
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, grams array<long>")
    pairs, members = distances.similar_sets(frame, 0.25, Scratch(spark, "similar"))
    got = distances.member_pairs(pairs, members).collect()
    assert len(got) == len(want) and {(r.i, r.j): (r.m, r.len_i, r.len_j) for r in got} == want
    every = {frozenset((r.id, r.rep)) for r in members.collect() if r.id != r.rep}
    assert len(every) >= 9 and pairs.count() < len(want)  # copies are not listed as pairs
    table = spark.createDataFrame([(i, j, 0.0) for i, j in want], "i long, j long, d double")
    links = distances.class_links(pairs, members).withColumn("d", F.lit(0.0))
    one, two = (sorted(map(tuple, distances.clusters(x).collect())) for x in (table, links))
    assert one == two


def test_grams_of_several_sets_come_back_in_bundles_and_parts(spark):
    """Whole bundles travel as bytes: no row per gram, whatever bundles and parts there are."""
    rows = [(f"d{k}", [(k * 7 + x * x) * 0x9E3779B97F4A7 % (1 << 63) * (-1) ** x for x in range(k % 13 + 1)]) for k in range(60)] + [("alone", [5]), ("none", [])]
    frame = spark.createDataFrame(rows, "id string, grams array<bigint>").withColumn("grams", F.array_distinct("grams"))
    sets = {r.id: set(r.grams) for r in frame.collect()}
    df = {g: sum(g in s for s in sets.values()) for s in sets.values() for g in s}
    want = {i: (len(s), sorted((g for g in s if df[g] > 1), key=lambda g: (df[g], g % (1 << 64)))) for i, s in sets.items() if any(df[g] > 1 for g in s)}
    saved = {}

    class Watched(Scratch):
        def save(self, df, name):
            saved[name] = df.schema.simpleString()
            return super().save(df, name)

    for size, about in ((1 << 20, None), (16, None), (16, 10)):
        scratch = Watched(spark, "grams")
        got = distances.several_grams(frame.repartition(3), scratch, about, size).collect()
        assert {r.id: (r.n, list(r.live)) for r in got} == want and len(got) == len(want)
    assert "g:binary" in saved["several"]


def test_chain_distances_are_made_where_tiles_meet(spark):
    """Both counts in one pass: what the two tables of pairs give when they are joined, without a pair in a shuffle."""
    rows = [(k * 5 % 11, f"t{k % 17:02d}", None if k % 4 == 0 else k % 3, None if k % 5 == 0 else k % 2, "".join("ACGTn"[(k * x + k // 3) % 5] for x in range(9))) for k in range(150)]
    rows += [(40, "lone", 1, None, "ACGTACG"), (None, "t03", 1, 1, "AC"), (3, "none", None, None, None)]
    frame = spark.createDataFrame(rows, "block_id long, thread string, left_block long, right_block long, bases string")
    members, aligned = frame.drop("bases"), frame.select("block_id", "thread", "bases")
    want = blockgraph.chain_distances(blockgraph.snp_pairs(aligned), blockgraph.breakpoint_pairs(members, members))
    for tile in (None, 4):
        out = blockgraph.chain_pairs(aligned, members, members, tile)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    snps = blockgraph.snp_pairs(aligned, 4)
    for df in (out, snps):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan
    with pytest.raises(Exception, match="equally long"):
        blockgraph.snp_pairs(spark.createDataFrame([(1, 1, "AC"), (1, 2, "ACG")], "block_id long, thread long, bases string")).collect()


def test_shared_grams_are_counted_by_tiles(spark):
    """Every pair with its count, whatever the tiles, with grams in most sets and copies; no pair is shuffled or joined by a gram."""
    import random

    rng = random.Random(9)
    sets = [sorted({rng.choice([rng.randrange(12), rng.randrange(300), -rng.randrange(10**9)]) for _ in range(rng.randint(1, 20))}) for _ in range(50)]
    sets += [*sets[:5], [10**12], [-1, -2]]
    want = {(i, j): (m, len(x), len(y)) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if (m := len(set(x) & set(y)))}
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, grams array<long>")
    for tile in (2048, 9):
        out = distances.shared_grams(frame, tile=tile)
        got = out.collect()
        assert {(r.i, r.j): (r.m, r.len_i, r.len_j) for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
    grams, at = np.array([1, 1, 1, 2, 2, 3], np.uint64), np.array([0, 1, 2, 0, 2, 1], np.uint32)
    for step in (1, 4, 1 << 22):
        assert distances._tile_hits((grams, at), (grams, at), (3, 3), step).tolist() == [[2, 1, 2], [1, 2, 1], [2, 1, 2]]


def test_similar_sets_leave_only_what_their_results_read(spark):
    """Classes and candidates go, and what was shuffled for them is let go, before the pairs are used."""
    frame = spark.createDataFrame([(k, [1, 2, 3, 4, 100 + k]) for k in range(6)] + [(k, [1, 2, 3, 4, 5]) for k in (6, 7)], "id long, grams array<long>")
    dropped = []

    class Watched(Scratch):
        def drop(self, *tables):
            dropped.extend(t._scratch_path.rpartition("-")[2] for t in tables)
            super().drop(*tables)

    pairs, members = distances.similar_sets(frame, 0.25, Watched(spark, "left"))
    assert sorted(dropped) == ["classes", "found", "live", "several"]
    assert pairs.filter("m = 4").count() == 21 and members.count() == 8


def test_numbers_travel_in_few_bytes():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    grams = np.sort(rng.integers(0, 1 << 63, 20000).astype(np.uint64) >> np.uint64(7))
    for x, ordered, most in ((grams, True, 6.2), (grams[:0], True, 0), (rng.integers(0, 400, 20000).astype(np.uint16), False, 1.4), (grams[::-1], False, 9)):
        blob = distances._planes(x, ordered)
        (back,) = distances._numbers(pa.chunked_array([pa.array([blob], pa.binary())]), x.dtype.type, ordered)
        assert back.dtype == x.dtype and (back == x).all() and len(blob) <= most * len(x) + 64


def test_breakpoints_are_counted_by_tiles_without_a_join_of_members(spark):
    """Every tile size gives what pairs one by one give, for repeated members, null blocks and threads without blocks too; no pair is shuffled."""
    rows = [(k * 5 % 11, f"t{k % 17:02d}", None if k % 4 == 0 else k % 3, None if k % 5 == 0 else k % 2) for k in range(150)] + [(None, "t03", 1, 1)]
    names = sorted({r[1] for r in rows} | {"alone"})
    n = {t: len({r[0] for r in rows if r[1] == t and r[0] is not None}) for t in names}
    want = {}
    for i, a in enumerate(names):
        for c in names[i + 1 :]:
            both = [(x, y) for x in rows for y in rows if x[1] == a and y[1] == c and x[0] is not None and x[0] == y[0]]
            led = [(x, y) for x, y in both if x[2] is not None]
            same = sum((x[2] == y[2]) + (x[3] is not None and x[3] == y[3]) for x, y in led)
            want[a, c] = (same, sum((x[2] != y[2]) + (x[3] is None) for x, y in led) + 2 * (n[a] + n[c] - 2 * len(both)))
    members = spark.createDataFrame(rows, "block_id long, thread string, left_block long, right_block long")
    threads = spark.createDataFrame([(t,) for t in [*names, None]], "thread string")
    for tile in (4096, 4):
        out = blockgraph.breakpoint_pairs(members, threads, tile)
        got = out.collect()
        assert {(r.t1, r.t2): (r.same, r.different) for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def _as_batches(matches, threads, rows=7):
    """Rows as ``pinch._flat_components`` has them, few at a time, with a match and a thread that are not to count."""
    unknown = matches.iloc[:1].assign(name2="nowhere")
    own = pd.DataFrame({"name1": list(threads), "size": list(threads.values())})
    every = pd.concat([matches, unknown, own, pd.DataFrame({"name1": ["alone"], "size": [9]})]).assign(component=5)
    schema = pa.schema([("component", pa.int64()), *((c, pa.string()) for c in ("name1", "name2")), *((c, pa.int64()) for c in ("start1", "start2", "length", "line", "score", "size")), ("strand", pa.bool_())])
    return iter(pa.Table.from_pandas(every, schema=schema, preserve_index=False).to_batches(rows))


def test_components_are_glued_from_batches_of_rows(spark):
    """No rows of a whole component are objects of Python, and only threads of matches belong to it."""
    for seed in range(3):
        matches, threads = _random_matches(seed)
        g = pinch.fold(matches, threads, pinch.single_copy, 3)
        component, flat = pinch._flat(_as_batches(matches, threads), 3)
        assert component == 5 and flat.threads == sorted({*matches["name1"], *matches["name2"]})
        assert {b: len(segs) for b, segs in g.blocks.items()} == {b: len(at) for b, at in flat.blocks.items()} and flat.acyclic() == g.acyclic()
        assert pinch._flat(_as_batches(matches.iloc[:0], threads), 3) is None
    frames = spark.createDataFrame(matches), spark.createDataFrame(list(threads.items()), "name string, length long")
    facts = pinch.component_facts(*frames, wanted=("acyclic", "n_blocks"))
    assert "FlatMapGroupsInPandas" not in facts._jdf.queryExecution().toString()
    plain = pinch.component_facts(*frames, rule=lambda g, one, two: pinch.single_copy(g, one, two), wanted=("acyclic", "n_blocks"))
    assert facts.collect() == plain.collect() and facts.count() == 1


def test_the_flat_fold_has_the_graph_s_dense_path():
    for seed in range(8):
        matches, threads = _random_matches(seed)
        g, flat = pinch.fold(matches, threads, pinch.single_copy, 3), pinch.Flat(threads).fold(matches, 3)
        names = {b: k for k, b in enumerate(sorted(g.blocks, key=lambda b: min(g.blocks[b])))}
        assert flat.dense_path() == [names[b] for b in g.dense_path()] and len(g.dense_path()) > 1
    assert pinch.Flat({"a": 5}).dense_path() == []


def test_glued_segments_leave_in_batches(spark):
    matches, threads = _random_matches(5)
    frames = spark.createDataFrame(matches), spark.createDataFrame(list(threads.items()), "name string, length long")
    found = pinch.pinch_blocks(*frames)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    plain = pinch.pinch_blocks(*frames, rule=lambda g, one, two: pinch.single_copy(g, one, two))
    assert sorted(found.collect()) == sorted(plain.collect())


def test_blocks_are_ordered_without_rows_of_their_segments():
    matches, threads = _random_matches(6)
    flat = pinch.Flat(threads).fold(matches)
    rows = flat.rows()
    assert sorted(zip(*(x.tolist() for x in flat.order()), strict=True)) == sorted({*zip(rows["block"].tolist(), rows["pos"].tolist(), strict=True)})
    assert len(flat.order()[0]) == len(flat.blocks) < len(rows["block"])


def test_the_flat_fold_reaches_what_the_graph_s_walk_reaches():
    few = 0
    for seed in range(20):
        matches, threads = _random_matches(seed, n=3 + seed)
        g, flat = pinch.fold(matches, threads, pinch.single_copy), pinch.Flat(threads).fold(matches)
        there = g.reached((min(g.cuts), 0))
        assert flat.reached() == [t for t in sorted(g.cuts) if (t, g.cuts[t][-2]) in there]
        few += len(flat.reached()) < len(threads)
    assert few


def test_pairs_of_tiles_travel_without_their_sets(spark, monkeypatch):
    """What is shuffled for two tiles does not grow with the sets in them; ids of any kind come back."""
    frame = spark.createDataFrame([(f"d{k:03}", [k % 7, 100 + k % 3, 1000 + k]) for k in range(40)], "id string, grams array<long>")
    met = []
    plain = type(frame).hint
    monkeypatch.setattr(type(frame), "hint", lambda self, name, *a: met.append(self) or plain(self, name, *a))
    got = {(r.i, r.j): r.m for r in distances.shared_grams(frame, tile=9).collect()}
    assert met and not any(x.dataType.typeName() in ("array", "binary") for df in met for x in df.schema)
    assert got == {(f"d{i:03}", f"d{j:03}"): (i % 7 == j % 7) + (i % 3 == j % 3) for j in range(40) for i in range(j) if i % 7 == j % 7 or i % 3 == j % 3}
