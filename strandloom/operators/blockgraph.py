"""Block graphs: segments of threads grouped in blocks, adjacencies between blocks, heaviest paths.

segments(thread, start, length, block_id) holds aligned segments only; unaligned bases are the gaps between. Where a segment may lie
in its block either way, a column strand says whether it lies forward.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.sequence import edge_score, jukes_cantor_different
from strandloom.runtime import Scratch, ship

WIDTH = 1 << 22  # positions of a thread that one task looks at together


def next_blocks(segments: DataFrame, width: int = WIDTH) -> DataFrame:
    """(thread, b1, b2, adj_start, adj_len): each segment's next one along its thread; with strands also (right1, right2).

    Next is by (start, block_id). Neighbours are found inside ranges of a thread; the last segment of a range takes
    the first one of the thread's next range, so a long thread is not one task's work. right1 and right2 say whether the connection touches the right
    ends of the two blocks: a thread leaves a block by its right end, and enters one by its left end, where it lies forward in it.
    """
    strand = ["strand"] if "strand" in segments.columns else []
    rows = segments.withColumn("__range", F.floor(F.col("start") / width))
    inside = Window.partitionBy("thread", "__range").orderBy("start", "block_id")
    place = F.struct("start", "block_id", *strand)
    rows = rows.withColumn("__next", F.lead(place).over(inside))
    firsts = rows.groupBy("thread", "__range").agg(F.min(place).alias("__first"))
    firsts = firsts.withColumn("__after", F.lead("__first").over(Window.partitionBy("thread").orderBy("__range"))).drop("__first")
    rows = rows.join(firsts, ["thread", "__range"]).withColumn("__next", F.coalesce("__next", "__after")).filter("__next is not null")
    end = F.col("start") + F.col("length")
    sides = [F.col("strand").alias("right1"), (~F.col("__next.strand")).alias("right2")] if strand else []
    return rows.select("thread", F.col("block_id").alias("b1"), F.col("__next.block_id").alias("b2"), end.alias("adj_start"), (F.col("__next.start") - end).alias("adj_len"), *sides)


def both_ways(adjacencies: DataFrame) -> DataFrame:
    """Connections with sides, each read from either end."""
    other = {"b1": "b2", "b2": "b1", "right1": "right2", "right2": "right1"}
    return adjacencies.unionByName(adjacencies.select(*(F.col(other.get(c, c)).alias(c) for c in adjacencies.columns)))


def block_stats(segments: DataFrame) -> DataFrame:
    """(block_id, degree, length, weight)."""
    out = segments.groupBy("block_id").agg(F.count("*").alias("degree"), F.max("length").alias("length"))
    return out.withColumn("weight", F.col("degree") * F.col("length"))


def heaviest_block(stats: DataFrame) -> DataFrame:
    """The block of most weight; the smallest id among equals. No blocks give a row of nulls."""
    return stats.agg(F.max_by("block_id", F.struct("weight", -F.col("block_id"))).alias("block_id"), F.max("weight").alias("weight"))


def block_threads(segments: DataFrame) -> DataFrame:
    """(block_id, threads): the threads of each block, in order. A block's degree bounds the list."""
    return segments.groupBy("block_id").agg(F.array_sort(F.collect_set("thread")).alias("threads"))


def min_adjacency(adjacencies: DataFrame) -> DataFrame:
    """(b1, b2, min_adj), by the ends that touch where there are sides."""
    sides = [c for c in ("right1", "right2") if c in adjacencies.columns]
    return adjacencies.groupBy("b1", "b2", *sides).agg(F.min("adj_len").alias("min_adj"))


def shortest_adjacency(adjacencies: DataFrame) -> DataFrame:
    """(b1, b2, thread, adj_start, adj_len) of the shortest connection; ties go to the smallest thread, then start."""
    best = F.min(F.struct("adj_len", "thread", "adj_start")).alias("x")
    return adjacencies.groupBy("b1", "b2").agg(best).select("b1", "b2", "x.thread", "x.adj_start", "x.adj_len")


def shared_threads(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(b1, b2, shared): threads in both blocks of each edge."""
    t = segments.select("block_id", "thread").distinct()
    a, b = t.select(F.col("block_id").alias("b1"), "thread"), t.select(F.col("block_id").alias("b2"), "thread")
    pairs = edges.select("b1", "b2").distinct()
    return pairs.join(a, "b1").join(b, ["b2", "thread"]).groupBy("b1", "b2").agg(F.count("*").alias("shared"))


def edge_scores(edges: DataFrame, ordering: DataFrame, gap_penalty: int = 1) -> DataFrame:
    """(left_pos, right_pos, left_block, right_block, score) of the edges (b1, b2, shared, min_adj) that go forward in ordering(block_id, pos).

    Where the ordering says by which end a block is entered (right), an edge (with right1, right2) must reach its right block's entered end and
    leave its left block by the other end than the entered one.
    """
    sided = "right" in ordering.columns and "right1" in edges.columns
    side = lambda name: [F.col("right").alias(name)] if sided else []
    left = ordering.select(F.col("block_id").alias("b1"), F.col("pos").alias("left_pos"), *side("enter1"))
    right = ordering.select(F.col("block_id").alias("b2"), F.col("pos").alias("right_pos"), *side("enter2"))
    rows = edges.join(left, "b1").join(right, "b2").filter("left_pos < right_pos")
    if sided:
        rows = rows.filter("right2 = enter2 and right1 <> enter1")
    return rows.select("left_pos", "right_pos", F.col("b1").alias("left_block"), F.col("b2").alias("right_block"), edge_score("shared", gap_penalty, "min_adj").alias("score"))


def best_predecessor(scored: DataFrame) -> DataFrame:
    """(pos, prev, edge_score): for each block the incoming edge of most score, the lowest left position among equals."""
    best = F.max(F.struct(F.col("score"), (-F.col("left_pos")).alias("minus"))).alias("x")
    return scored.groupBy(F.col("right_pos").alias("pos")).agg(best).select("pos", (-F.col("x.minus")).alias("prev"), F.col("x.score").alias("edge_score"))


def path_scores(ordering: DataFrame, best: DataFrame, scratch: Scratch) -> DataFrame:
    """(pos, prev, score): edge scores summed along predecessors down to a root, whose score is 0.

    The predecessor depends on edge scores only, so this is a sum over a forest: pointer doubling takes
    log2(depth) rounds, each of which joins only the rows that have not reached their root.
    """
    prev = scratch.save(ordering.select("pos").join(best, "pos", "left"), "prev")
    done = prev.filter("prev is null").select("pos", F.lit(0).cast("double").alias("score"))
    live = scratch.save(prev.filter("prev is not null").select("pos", F.col("prev").alias("jump"), F.col("edge_score").cast("double").alias("part")), "jumps")
    while not live.isEmpty():
        every = live.select(F.col("pos").alias("at"), F.col("jump").alias("to"), "part").unionByName(done.select(F.col("pos").alias("at"), F.lit(None).cast("long").alias("to"), F.col("score").alias("part")))
        nxt = live.alias("a").join(every.alias("b"), F.col("a.jump") == F.col("b.at")).select("a.pos", F.col("b.to").alias("jump"), (F.col("a.part") + F.col("b.part")).alias("part"))
        nxt = scratch.save(nxt, "jumps")
        done = done.unionByName(nxt.filter("jump is null").select("pos", F.col("part").alias("score")))
        live = nxt.filter("jump is not null")
    return prev.select("pos", "prev").join(done, "pos").select("pos", "prev", F.col("score").cast("long").alias("score"))


def trace_path(scored: DataFrame, ordering: DataFrame, segments: DataFrame, scratch: Scratch, *, max_bad: int = 5, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The heaviest path (rank, pos, block_id; in path order) and its score as a table (path_score).

    From the position of most score (lowest among equals; above 0) back along predecessors while scores stay above 0. A
    block is bad if fewer than ``least`` of the starting block's threads are in it; the walk ends at the
    first block that makes more than max_bad bad ones in a row, and the max_bad blocks before it go too. The score
    is that of the start minus that of the last block walked, blocks that went included.
    """
    spark = scored.sparkSession
    start = scored.filter("score > 0").orderBy(F.desc("score"), "pos").limit(1).collect()
    if not start:
        return spark.createDataFrame([], "rank long, pos long, block_id long"), spark.createDataFrame([(None,)], "path_score long")
    first = start[0]
    jumps = scratch.save(scored.select("pos", F.col("prev").alias("jump")), "walk")
    path = spark.createDataFrame([(first["pos"], 0)], "pos long, up long")
    step = 1
    while True:  # after each round the path holds its 2^k last blocks
        more = scratch.save(path.join(jumps, "pos").filter("jump is not null").select(F.col("jump").alias("pos"), (F.col("up") + step).alias("up")), "path")
        if more.isEmpty():
            break
        path = path.unionByName(more)
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps = scratch.save(a.join(b, F.col("a.jump") == F.col("b.pos")).select("a.pos", "b.jump"), "walk")
        step *= 2
    walk = path.join(scored.select("pos", "score"), "pos").join(ordering.select("pos", "block_id"), "pos")
    stop = walk.filter("score <= 0").agg(F.min("up")).first()[0]
    walk = scratch.save(walk if stop is None else walk.filter(F.col("up") < stop), "walked")
    threads = segments.select("block_id", "thread").distinct()
    begin = threads.join(ordering.filter(F.col("pos") == first["pos"]).select("block_id"), "block_id").select("thread")
    n = begin.count()
    there = threads.join(begin, "thread").groupBy("block_id").agg(F.count("*").alias("there"))
    bad = walk.join(there, "block_id", "left").filter(F.coalesce("there", F.lit(0)) < F.lit(least) * n)
    runs = bad.select(F.explode(F.sequence(F.col("up"), F.col("up") + max_bad)).alias("up")).groupBy("up").agg(F.count("*").alias("n")).filter(F.col("n") > max_bad)
    end = runs.join(bad.select("up"), "up").agg(F.min("up")).first()[0]
    kept = walk if end is None else walk.filter(F.col("up") < max(0, end - max_bad))
    last = walk.filter(F.lit(True) if end is None else F.col("up") < end).agg(F.max("up")).first()[0]
    score = walk.filter(F.col("up") == last).select((F.lit(first["score"]) - F.col("score")).cast("long").alias("path_score"))
    length = kept.count()
    return kept.select((F.lit(length - 1) - F.col("up")).cast("long").alias("rank"), "pos", "block_id"), score


def chain_length(path: DataFrame, stats: DataFrame) -> DataFrame:
    return path.join(stats, "block_id").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("chain_length"))


def consensus_sequence(path: DataFrame, segments: DataFrame, adjacencies: DataFrame, sequences: DataFrame, read=None) -> DataFrame:
    """(seq): the first segment's bases of every block of path(rank, block_id), joined by the shortest connections' bases.

    The first segment is the one of the smallest (thread, start). A consensus is one output value, so its pieces meet in one row.
    ``read`` gives the bases (sequence, start, length) as Columns where a stored sequence stands for a longer thread.
    """
    read = read or (lambda seq, start, length: F.substring(seq, start + 1, length))
    seqs = sequences.select(F.col("name").alias("thread"), "seq")
    firsts = segments.groupBy("block_id").agg(F.min(F.struct("thread", "start", "length")).alias("x")).select("block_id", "x.*")
    bases = path.join(firsts, "block_id").join(seqs, "thread").select((F.col("rank") * 2).alias("at"), read(F.col("seq"), F.col("start"), F.col("length")).alias("bases"))
    a, b = path.alias("a"), path.alias("b")
    steps = a.join(b, F.col("b.rank") == F.col("a.rank") + 1).select((F.col("a.rank") * 2 + 1).alias("at"), F.col("a.block_id").alias("b1"), F.col("b.block_id").alias("b2"))
    gaps = steps.join(shortest_adjacency(adjacencies), ["b1", "b2"]).join(seqs, "thread").select("at", read(F.col("seq"), F.col("adj_start"), F.greatest("adj_len", F.lit(0))).alias("bases"))
    return bases.unionByName(gaps).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bases"))), lambda x: x["bases"]), "").alias("seq"))


def graph_dot(segments: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """(line) of a strict graph: two nodes and one edge per block, and an edge per adjacent pair of ends (the ends that strands say, where there are any). Nodes are named by block and side."""
    blocks = segments.select("block_id").distinct()
    side = lambda c, s: F.concat(F.col(c).cast("string"), F.lit(s))
    nodes = blocks.select(F.explode(F.array(side("block_id", "l"), side("block_id", "r"))).alias("line"))
    own = blocks.select(F.concat(side("block_id", "l"), F.lit(" -- "), side("block_id", "r")).alias("line"))
    if "right1" in adjacencies.columns:
        end = lambda c, right: F.concat(F.col(c).cast("string"), F.when(F.col(right), "r").otherwise("l"))
        ends = adjacencies.select(end("b1", "right1").alias("x"), end("b2", "right2").alias("y"))
        edges = ends.select(F.concat(F.least("x", "y"), F.lit(" -- "), F.greatest("x", "y")).alias("line")).distinct()
    else:
        edges = adjacencies.select("b1", "b2").distinct().select(F.concat(side("b1", "r"), F.lit(" -- "), side("b2", "l")).alias("line"))
    return nodes.unionByName(own).unionByName(edges)


# --- pairs of threads over the blocks of a chain ------------------------------------------------


def _shut(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _open(blob: pa.Buffer, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8].to_pybytes(), "little"), codec="zstd"), kind)


BASES = {"at": np.uint32, "block": np.int64, "width": np.int32, "letters": np.uint8}


def _packed_bases(group: pa.Table) -> pa.Table:
    """A tile's bases as one row: its threads in order, and by block each segment's thread's place, block, length and letters, as compressed bytes."""
    threads = group["thread"].combine_chunks()
    keys = threads.unique()
    keys = keys.take(pc.sort_indices(keys))
    here = np.flatnonzero(np.asarray(pc.is_valid(group["bases"])))
    at, block = np.asarray(pc.index_in(threads, keys)).astype(np.uint32)[here], np.asarray(pc.fill_null(group["block_id"], 0)).astype(np.int64)[here]
    order = np.lexsort((at, block))
    bases = group["bases"].combine_chunks().take(pa.array(here[order]))
    columns = {"at": at[order], "block": block[order], "width": np.asarray(pc.binary_length(bases)).astype(np.int32), "letters": np.frombuffer(b"".join(bases.to_pylist()), np.uint8)}
    one = {c: pa.array([_shut(x)], pa.binary()) for c, x in columns.items()}
    return pa.table({"tile": group["tile"].combine_chunks().slice(0, 1), "threads": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), **one})


def _by_block(side: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and letters (a row each) of the segments of each block."""
    blocks, first = np.unique(side["block"], return_index=True)
    ends = np.concatenate([[0], np.cumsum(side["width"], dtype=np.int64)])
    out = {}
    for b, low, high in zip(blocks.tolist(), first.tolist(), [*first[1:].tolist(), len(side["block"])], strict=True):
        width = side["width"][low:high]
        if (width != width[0]).any():
            raise ValueError("bases of a block must be equally long")
        out[b] = side["at"][low:high].astype(np.int64), side["letters"][ends[low] : ends[high]].reshape(high - low, -1)
    return out


def _one_hot(at: np.ndarray, letters: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, how many segments each has, and their letters as counts: a column for each position and letter. A thread's segments in one block are added up."""
    x = (letters[:, :, None] == alphabet).reshape(len(at), -1)
    places, first, n = np.unique(at, return_index=True, return_counts=True)
    return places, n, x.astype(np.float32) if len(places) == len(at) else np.add.reduceat(x, first, axis=0, dtype=np.float32)


def _letter_counts(one: dict, two: dict, shape: tuple[int, int], strip: int = 1024):
    """(start, same, length, joint) of the threads of one tile from ``start`` on with all of another: agreeing and all letters of the blocks that both have, and whether they have any."""
    first, second = _by_block(one), _by_block(two)
    blocks = [b for b in first if b in second]
    for b in blocks:
        if first[b][1].shape[1] != second[b][1].shape[1]:
            raise ValueError("bases of a block must be equally long")
    for start in range(0, shape[0], strip):
        size = min(strip, shape[0] - start), shape[1]
        same, length, joint = np.zeros(size), np.zeros(size), np.zeros(size, bool)
        for b in blocks:
            (at, x), (to, y) = first[b], second[b]
            low, high = np.searchsorted(at, (start, start + strip))
            if low == high:
                continue
            x = x[low:high]
            alphabet = np.intersect1d(x, y)
            (p, n, x), (q, m, z) = _one_hot(at[low:high] - start, x, alphabet), _one_hot(to, y, alphabet)
            here = np.ix_(p, q)
            joint[here] = True
            length[here] += y.shape[1] if n.max() == m.max() == 1 else np.outer(n, m) * y.shape[1]
            same[here] += x @ z.T  # products of small counts are exact
        yield start, same, length, joint


def _dealt(threads: DataFrame, tile: int | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """Threads cut in their order into tiles: of 256 while there are few, so that there are tasks for all, and of 4096 at most."""
    ids = scratch.save(threads.select("thread").filter("thread is not null").distinct(), "threads")
    n = ids.count()
    tiles = max(1, -(-n // (tile or min(4096, max(256, n // 8)))))
    return scratch.save(ids.repartitionByRange(tiles, "thread").withColumn("tile", F.spark_partition_id()), "dealt"), tiles


def _units(packed: DataFrame, tiles: int) -> DataFrame:
    """Each pair of tiles as a row with the columns of both; a tile is shuffled once for each other one."""
    side = lambda s: packed.select(*(F.col(c).alias(f"{c}{s}") for c in packed.columns))
    one = side(1).withColumn("tile2", F.explode(F.sequence(F.col("tile1"), F.lit(tiles - 1))))
    two = side(2).withColumn("tile1", F.explode(F.sequence(F.lit(0), F.col("tile2"))))
    one, two = (x.repartition(max(2, tiles * (tiles + 1) // 2), "tile1", "tile2") for x in (one, two))
    return one.hint("shuffle_merge").join(two, ["tile1", "tile2"])


def _written(first, second, diagonal: bool, start: int, counts: list[np.ndarray], wanted: np.ndarray, names: list[str]):
    """Rows of the pairs (a thread of one tile from ``start`` on, one of the other) that are wanted, some at a time."""
    for k in range(0, len(wanted), step := max(1, (1 << 18) // max(1, len(second)))):
        part = np.s_[k : k + step]
        i, j = np.nonzero(wanted[part])
        if diagonal:
            i, j = i[keep := i + start + k < j], j[keep]
        yield pa.RecordBatch.from_arrays([first.take(pa.array(i + start + k)), second.take(pa.array(j)), *(pa.array(m[part][i, j].astype(np.int64)) for m in counts)], names=["t1", "t2", *names])


def _sides(x: dict, kinds: dict, prefix: str = "", read=_open) -> list[dict]:
    return [{c: read(x[f"{prefix}{c}{s}"].as_buffer(), kind) for c, kind in kinds.items()} for s in (1, 2)]


def _snp_rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            x = {c: batch[c][k] for c in batch.schema.names}
            first, second = x["threads1"].values, x["threads2"].values
            for start, same, length, joint in _letter_counts(*_sides(x, BASES), (len(first), len(second))):
                yield from _written(first, second, x["tile1"] == x["tile2"], start, [same, length - same], joint, ["same", "different"])


def _plain_bases(aligned: DataFrame) -> DataFrame:
    bases = F.col("bases")
    plain = F.when(F.octet_length(bases) == F.length(bases), F.upper(bases).cast("binary")).otherwise(F.raise_error(F.lit("sequences are ASCII")).cast("binary"))
    return aligned.filter("block_id is not null and thread is not null and bases is not null").select("thread", "block_id", plain.alias("bases"))


def _packed_tiles(dealt: DataFrame, rows: DataFrame, pack, kinds: dict) -> DataFrame:
    kind = dealt.schema["thread"].dataType.simpleString()
    return dealt.join(rows, "thread", "left").groupBy("tile").applyInArrow(pack, f"tile int, threads array<{kind}>, " + ", ".join(f"{c} binary" for c in kinds))


def snp_pairs(aligned: DataFrame, tile: int | None = None, blocks: int | None = None) -> DataFrame:
    """(t1, t2, same, different) summed over blocks of aligned(block_id, thread, bases) with equally long bases in a block.

    Letters agree whatever their case; sequences are ASCII, others raise. Rows without block, thread or bases take no part.
    Threads are cut in their order into tiles of about ``tile``; two tiles meet in one row that holds the bases of both, and all their pairs of threads are
    counted there, block by block, by products of one-hot matrices. So each tile is shuffled once for each other one, and pairs are only written. ``blocks`` is no longer read.
    """
    spark = aligned.sparkSession
    ship(spark)
    scratch = Scratch(spark, "snps")
    rows = scratch.save(_plain_bases(aligned), "aligned")
    dealt, tiles = _dealt(rows, tile, scratch)
    packed = scratch.save(_packed_tiles(dealt, rows, _packed_bases, BASES), "packed")
    scratch.drop(rows)
    kind = aligned.schema["thread"].dataType.simpleString()
    return _units(packed, tiles).mapInArrow(_snp_rows, f"t1 {kind}, t2 {kind}, same long, different long")


def _packed(group: pa.Table) -> pa.Table:
    """A tile's members as one row: its threads in order, and for each member its thread's place, its block and neighbours, as bytes."""
    threads = group["thread"].combine_chunks()
    keys = threads.unique()
    keys = keys.take(pc.sort_indices(keys))
    here = np.asarray(pc.is_valid(group["block_id"]))
    at = np.asarray(pc.index_in(threads, keys)).astype(np.uint32)[here]
    number = lambda c: np.asarray(pc.fill_null(group[c], 0)).astype(np.int64)[here]
    sides = sum(np.asarray(pc.is_valid(group[c])).astype(np.uint8)[here] << bit for bit, c in enumerate(("left_block", "right_block")))
    columns = {"at": at, "block": number("block_id"), "left": number("left_block"), "right": number("right_block"), "sides": sides}
    one = {c: pa.array([x.tobytes()], pa.binary()) for c, x in columns.items()}
    return pa.table({"tile": group["tile"].combine_chunks().slice(0, 1), "threads": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), **one})


MEMBER = {"at": np.uint32, "block": np.int64, "left": np.int64, "right": np.int64, "sides": np.uint8}


def _products(total: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Add to total[p, q] how many pairs of members, p's of one side and q's of the other, have equal codes. sides: (places, codes)."""
    runs = []
    for at, code in sides:
        order = np.argsort(code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        runs.append((codes, np.split(at[order], first[1:])))
    common, i, j = np.intersect1d(runs[0][0], runs[1][0], assume_unique=True, return_indices=True)
    for k in range(len(common)):
        (p, n), (q, m) = (np.unique(x, return_counts=True) for x in (runs[0][1][i[k]], runs[1][1][j[k]]))
        total[np.ix_(p, q)] += 1 if n.max() == m.max() == 1 else np.outer(n, m).astype(total.dtype)


def _codes(sides: list[dict], neighbour: str) -> list[np.ndarray]:
    """Numbers for (block, neighbour) that are equal on both sides if and only if these are."""
    numbered = []
    for c in ("block", neighbour):
        values, inverse = np.unique(np.concatenate([s[c] for s in sides]), return_inverse=True)
        numbered.append((len(values), inverse.astype(np.int64)))
    code = numbered[0][1] * numbered[1][0] + numbered[1][1]
    return np.split(code, [len(sides[0]["block"])])


def _breaks_of(one: dict, two: dict, shape: tuple[int, int], width: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(same, different) of all threads of one tile with all of another; those of ``one`` are the first ones of their pairs."""
    sides = [one, two]
    joint, missed, same = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.int32)
    left, right = [s["sides"] & 1 > 0 for s in sides], [s["sides"] & 2 > 0 for s in sides]
    blocks = np.intersect1d(one["block"], two["block"])
    for start in range(0, len(blocks), width):  # products of small counts are exact
        some, dense = blocks[start : start + width], []
        for s, weight in ((one, None), (one, left[0] * (1 + ~right[0])), (two, None)):
            k = np.flatnonzero(np.isin(s["block"], some))
            rows = np.unique(s["at"][k])
            x = np.zeros((len(rows), len(some)), np.float32)
            np.add.at(x, (np.searchsorted(rows, s["at"][k]), np.searchsorted(some, s["block"][k])), 1 if weight is None else weight[k])
            dense.append((rows, x))
        here = np.ix_(dense[0][0], dense[2][0])
        joint[here] += dense[0][1] @ dense[2][1].T
        missed[here] += dense[1][1] @ dense[2][1].T
    codes = _codes(sides, "left")
    _products(same, [(s["at"][k], c[k]) for s, c, k in zip(sides, codes, left, strict=True)])
    missed -= same  # what has a left neighbour that is not equal, or no right one
    codes = _codes(sides, "right")
    _products(same, [(s["at"][k], c[k]) for s, c, k in zip(sides, codes, (left[0] & right[0], right[1]), strict=True)])
    n1, n2 = (np.bincount(np.unique(np.stack([s["at"].astype(np.int64), _codes([s, s], "block")[0]]), axis=1)[0], minlength=n) for s, n in zip(sides, shape, strict=True))
    different = missed.astype(np.int32) - 4 * joint.astype(np.int32)
    different += 2 * (n1[:, None] + n2[None, :]).astype(np.int32)
    return same, different


def _pair_rows(batches):
    """Rows (t1, t2, same, different) of pairs of packed tiles, some rows of a tile at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            x = {c: batch[c][k] for c in batch.schema.names}
            one, two = ({c: np.frombuffer(x[f"{c}{s}"].as_buffer(), kind) for c, kind in MEMBER.items()} for s in (1, 2))
            first, second = x["threads1"].values, x["threads2"].values
            same, different = _breaks_of(one, two, (len(first), len(second)))
            for start in range(0, len(first), rows := max(1, (1 << 18) // len(second))):
                part = np.s_[start : start + rows]
                i, j = np.indices(same[part].shape, np.int32, sparse=True)
                there = np.broadcast_to(i + start < j, same[part].shape) if x["tile1"] == x["tile2"] else np.ones(same[part].shape, bool)
                i, j = np.nonzero(there)
                columns = [first.take(pa.array(i + start)), second.take(pa.array(j)), *(pa.array(m[part][there].astype(np.int64)) for m in (same, different))]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "same", "different"])


def breakpoint_pairs(members: DataFrame, threads: DataFrame, tile: int = 4096) -> DataFrame:
    """(t1, t2, same, different) of members(block_id, thread, left_block, right_block) over the blocks of a chain.

    A block that one of two threads lacks counts 2 different. Where both have it and t1 has a left
    neighbour: an equal one counts 1 same, another 1 different; then an equal right neighbour 1 same, a right neighbour that t1
    lacks 1 different, an unequal one nothing. Without a left neighbour nothing counts.

    Threads are cut in their order into tiles of about ``tile``; two tiles meet in one row that holds the members of both, and all their pairs are counted
    there by matrices. So what is shuffled is each tile once for each other one, not the pairs, which are only written.
    """
    spark = members.sparkSession
    ship(spark)
    scratch = Scratch(spark, "breaks")
    ids = scratch.save(threads.select("thread").filter("thread is not null").distinct(), "threads")
    tiles = max(1, -(-ids.count() // tile))
    dealt = scratch.save(ids.repartitionByRange(tiles, "thread").withColumn("tile", F.spark_partition_id()), "dealt")
    kind = members.schema["thread"].dataType.simpleString()
    rows = dealt.join(members.select("thread", *(F.col(c).cast("long").alias(c) for c in ("block_id", "left_block", "right_block"))), "thread", "left")
    packed = scratch.save(rows.groupBy("tile").applyInArrow(_packed, f"tile int, threads array<{kind}>, " + ", ".join(f"{c} binary" for c in MEMBER)), "packed")
    units = spark.range(tiles * tiles).select(F.floor(F.col("id") / tiles).cast("int").alias("tile1"), (F.col("id") % tiles).cast("int").alias("tile2")).filter("tile1 <= tile2")
    side = lambda s: packed.select(*(F.col(c).alias(f"{c}{s}") for c in packed.columns))
    units = units.hint("shuffle_merge").join(side(1), "tile1").hint("shuffle_merge").join(side(2), "tile2").repartition(max(1, tiles * (tiles + 1) // 2), "tile1", "tile2")
    return units.mapInArrow(_pair_rows, f"t1 {kind}, t2 {kind}, same long, different long")


def _shut_members(group: pa.Table) -> pa.Table:
    packed = _packed(group)
    columns = {c: np.frombuffer(packed[c][0].as_buffer(), kind) for c, kind in MEMBER.items()}
    order = np.lexsort((columns["at"], columns["block"]))
    return pa.table({"tile": packed["tile"], "threads": packed["threads"], **{c: pa.array([_shut(x[order])], pa.binary()) for c, x in columns.items()}})


def _chain_rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            x = {c: batch[c][k] for c in batch.schema.names}
            first, second = x["threads1"].values, x["threads2"].values
            shape = len(first), len(second)
            kept, missed = _breaks_of(*_sides(x, MEMBER, "m_"), shape)
            for start, same, length, _ in _letter_counts(*_sides(x, BASES), shape):
                rows = np.s_[start : start + len(same)]
                yield from _written(first, second, x["tile1"] == x["tile2"], start, [same, length - same, kept[rows], missed[rows]], np.ones(same.shape, bool), ["s_same", "s_different", "b_same", "b_different"])


def chain_pairs(aligned: DataFrame, members: DataFrame, threads: DataFrame, tile: int | None = None) -> DataFrame:
    """(t1, t2, snp, breakpoint, distance): ``chain_distances`` of ``snp_pairs`` and ``breakpoint_pairs``, both counted where two tiles meet, so that no pair is shuffled."""
    spark = aligned.sparkSession
    ship(spark)
    scratch = Scratch(spark, "chain")
    dealt, tiles = _dealt(threads, tile, scratch)
    numbers = [F.col(c).cast("long").alias(c) for c in ("block_id", "left_block", "right_block")]
    packed = scratch.save(_packed_tiles(dealt, _plain_bases(aligned), _packed_bases, BASES), "bases")
    other = scratch.save(_packed_tiles(dealt, members.select("thread", *numbers), _shut_members, MEMBER), "members")
    both = packed.join(other.select("tile", *(F.col(c).alias(f"m_{c}") for c in MEMBER)), "tile")
    kind = dealt.schema["thread"].dataType.simpleString()
    rows = _units(both, tiles).mapInArrow(_chain_rows, f"t1 {kind}, t2 {kind}, s_same long, s_different long, b_same long, b_different long")
    share = lambda p: F.coalesce(F.try_divide(F.col(f"{p}_different").cast("double"), (F.col(f"{p}_same") + F.col(f"{p}_different")).cast("double")), F.lit(0.0))
    rows = rows.select("t1", "t2", jukes_cantor_different(share("s")).alias("snp"), share("b").alias("breakpoint"))
    return rows.withColumn("distance", F.col("snp") + F.col("breakpoint"))


def chain_distances(snps: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """(t1, t2, snp, breakpoint, distance): corrected differing share of bases plus differing share of neighbours; a share of nothing is 0."""
    share = lambda p: F.coalesce(F.try_divide(F.col(f"{p}.different").cast("double"), (F.col(f"{p}.same") + F.col(f"{p}.different")).cast("double")), F.lit(0.0))
    s, b = snps.alias("s"), breakpoints.alias("b")
    rows = b.join(s, (F.col("b.t1") == F.col("s.t1")) & (F.col("b.t2") == F.col("s.t2")), "left").select("b.t1", "b.t2", jukes_cantor_different(share("s")).alias("snp"), share("b").alias("breakpoint"))
    return rows.withColumn("distance", F.col("snp") + F.col("breakpoint"))
