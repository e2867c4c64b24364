"""Near-duplicate embeddings by int8 quantised tile products.

Equal vectors first become one class.  Classes are dealt into tiles of bounded size and
quantised once.  Each pair of tiles is one unit of work: the tiles' int8 codes, scales and error lengths are
shipped to it and the codes multiplied in narrow strips.  A vector x is s*q + e with int8 codes q and a known length of e, so
    x.y = sx*sy*(qx.qy) + (sx*qx).ey + ex.y,   |error| <= |sx*qx||ey| + |ex||y|
holds for every pair: pairs whose upper bound is below the threshold are out, pairs whose lower bound
is above it are links, and only those between are recomputed in double precision, from vectors that the
unit reads by range from the tile's file in the shared folder.

A unit returns a link count per vector and a spanning forest of its links, never the links
themselves, so a group of n near copies costs O(n) rows per unit instead of n^2.

Tiles follow the nearest of a few pivot vectors and carry a cap (centre and angle); a pair
of tiles whose caps are too far apart for any link is never shipped.  Pivots decide only how much is skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.blobs import Reader, Writer
from strandloom.operators.components import connected_components
from strandloom.runtime import Scratch, ship

TILE = 8192  # vectors in a tile, about
STRIP = 128  # rows of a tile multiplied at once
PIVOTS = 64  # vectors that steer tiles (a bounded sample; no effect on results)
CHUNK = 8192  # pairs recomputed at once
WAITING = 1 << 16  # undecided pairs that wait to be recomputed, about
GAP = 8  # vectors between two wanted ones that are read along with them
SALTS = 16  # over which pairs of tiles are listed, at least
LISTED = 32  # tiles that one salt has, about, when there are many
SLACK = 1e-9  # for rounding in the bounds themselves
ROUNDING = 1e-5  # for single precision in the first look; its values are at most about 1, so rounding stays below 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows x to int8 codes, their scales and the lengths of the error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Union-find over n places; ``edges`` are the unions that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join every pair; each round at least halves the trees that links reach, so only joins cost a step of Python."""
        root, pick = np.empty(len(self.up), np.int64), np.empty(len(self.up), np.int64)
        while len(i):
            seen = np.zeros(len(self.up), bool)
            seen[i] = seen[j] = True
            places = np.nonzero(seen)[0]
            root[places] = [self.find(p) for p in places.tolist()]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            pick[root[j]] = np.arange(len(j))  # one link of each tree on the second side
            reached = np.zeros(len(self.up), bool)
            reached[root[j]] = True
            some = pick[reached]
            for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                self.join(a, b)


class Tile:
    """A tile's codes; ``rows`` gives its unit vectors, got by ``read(offset, length)`` of its file when first asked for."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, read, kind: str):
        self.ids, self.weights, self.codes, self.scale, self.error = ids, weights, codes, scale, error
        self.length = np.sqrt(np.einsum("ij,ij->i", codes, codes, dtype=np.float64)) * scale  # of s*q
        self.read, self.kind, self.held, self.has = read, np.dtype(kind), None, np.zeros(len(ids), bool)

    def rows(self, at: np.ndarray) -> np.ndarray:
        n, width = self.codes.shape
        if self.held is None:
            self.held = np.empty((n, width))
        missing = np.unique(at[~self.has[at]])
        if len(missing):
            size = width * self.kind.itemsize
            parts = []
            for run in np.split(missing, np.nonzero(np.diff(missing) > GAP)[0] + 1):
                low, many = int(run[0]), int(run[-1] - run[0]) + 1
                parts.append(np.frombuffer(self.read(low * size, many * size), self.kind).reshape(many, width)[run - low])
            self.held[missing], self.has[missing] = unit(np.concatenate(parts).astype(np.float64)), True
        return self.held[at]


def tile_links(one: Tile, two: Tile | None, threshold: float):
    """Links of a tile's vectors with another's (with each other, if there is none): counts by weight, and a spanning forest.

    Places in the forest count the first tile's vectors, then the second's.
    """
    own = two is None
    two = one if own else two
    n, m = len(one.ids), len(two.ids)
    kind = np.float32 if one.codes.shape[1] <= 1040 else np.float64  # sums of int8 products stay below 2^24 for up to 1040 components, so they are exact
    turned = two.codes.astype(kind).T
    cx, cy, forest = np.zeros(n, np.int64), np.zeros(m, np.int64), Forest(n + (0 if own else m))
    shift = 0 if own else n
    open_i: list[np.ndarray] = []
    open_j: list[np.ndarray] = []

    one_scale, two_scale, one_length, two_error = (x.astype(np.float32) for x in (one.scale, two.scale, one.length, two.error))
    one_floor = (threshold - one.error - ROUNDING).astype(np.float32)

    def count(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(cx, i, two.weights[j])
        np.add.at(cx if own else cy, j, one.weights[i])
        forest.join_all(i, j + shift)

    for at in range(0, n, STRIP):
        rows = slice(at, min(at + STRIP, n))
        # First in single precision with room for its rounding, then the bounds of those that pass.
        dots = one.codes[rows].astype(kind) @ turned
        upper = dots * one_scale[rows, None]
        upper *= two_scale
        upper += one_length[rows, None] * two_error
        i, j = np.nonzero(upper >= one_floor[rows, None])
        if own:
            later = j > i + at
            i, j = i[later], j[later]
        near = dots[i, j].astype(np.float64)
        i = i + at
        near *= one.scale[i] * two.scale[j]
        error = one.length[i] * two.error[j] + one.error[i] + SLACK  # a vector of the second has length 1
        some = near + error >= threshold
        i, j, sure = i[some], j[some], (near - error >= threshold)[some]
        count(i[sure], j[sure])
        open_i.append(i[~sure])
        open_j.append(j[~sure])
        if sum(map(len, open_i)) >= WAITING or rows.stop == n:
            i, j = np.concatenate(open_i), np.concatenate(open_j)
            for c in range(0, len(i), CHUNK):
                some = i[c : c + CHUNK], j[c : c + CHUNK]
                links = np.einsum("ij,ij->i", one.rows(some[0]), two.rows(some[1])) >= threshold
                count(some[0][links], some[1][links])
            open_i, open_j = [], []
    return cx, cy, forest.edges


def _pack(root: str, kind: str):
    """Rows (tile, vec_id, n, embedding) of one tile to one row with its codes and cap; the vectors go to a file of their own."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(pdf["embedding"].tolist(), dtype=kind)
        x = unit(raw.astype(np.float64))
        centre = x.sum(axis=0)
        length = np.linalg.norm(centre)
        angle = np.pi if length < 1e-9 else float(np.arccos(np.clip(x @ (centre / length), -1, 1)).max())
        centre = centre / length if length >= 1e-9 else x[0]
        codes, scale, error = quantise(x)
        writer = Writer(root, "tile")
        writer.append(raw.tobytes())
        writer.close()
        return pd.DataFrame({
            "tile": [pdf["tile"].iloc[0]], "width": [x.shape[1]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "weights": [pdf["n"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()], "file": [writer.name], "centre": [centre.tolist()], "angle": [angle],
        })

    return pack


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of each vector, as an Arrow-batched function."""

    def cells(batches):
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            width = pdf["embedding"].map(len).to_numpy()
            for w in np.unique(width):
                at = np.nonzero(width == w)[0]
                if w in pivots:
                    out[at] = (unit(np.array(pdf["embedding"].iloc[at].tolist(), dtype=np.float64)) @ pivots[w].T).argmax(axis=1)
            yield pdf[["vec_id", "n", "embedding"]].assign(width=width.astype(np.int32), cell=out)

    return cells


def _unit_of(root: str, kind: str, threshold: float):
    """Work on one pair of tiles; its group holds one row per tile (one row, if the pair is a tile with itself)."""

    def load(r, reader):
        ids = np.frombuffer(r.ids, np.int64)
        codes = np.frombuffer(r.codes, np.int8).reshape(len(ids), -1)
        return Tile(ids, np.frombuffer(r.weights, np.int64), codes, np.frombuffer(r.scale), np.frombuffer(r.error), lambda offset, length: reader.read(r.file, offset, length), kind)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        reader = Reader(root)
        sides = [load(r, reader) for r in pdf.itertuples()]
        ids = sides[0].ids
        counts, more, edges = tile_links(sides[0], sides[1] if len(sides) > 1 else None, threshold)
        if len(sides) > 1:
            ids, counts = np.concatenate([ids, sides[1].ids]), np.concatenate([counts, more])
        some, ends = np.nonzero(counts)[0], np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "vec_id": np.concatenate([ids[some], ids[ends[:, 0]]]), "n": np.concatenate([counts[some], np.zeros(len(ends), np.int64)]),
            "other": pd.array([None] * len(some) + ids[ends[:, 1]].tolist(), dtype="Int64"),
        })

    return work


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.9, *, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): n_links, component_id, kept.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with
    nothing (n_links 0, their own component), and a row without vec_id has n_links 0, no component and kept false;
    vectors of different widths do not link with each other. Equal vectors link. Repeated rows count as vectors of their own in n_links; different vectors
    of one vec_id share its links.
    An empty table gives an empty table; further columns are not carried.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embeddings")
    root = f"{scratch.root}/tiles"
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    good = rows.filter(usable).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 to 0.0
    # Classes of equal vectors; partial aggregation shrinks a hot vector before the shuffle.
    classes = scratch.save(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "classes")
    count = classes.count()
    # A bounded sample of vectors to steer by: the lowest hashes, whatever the partitioning.
    some = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, max(1, count // tile))).select("embedding").collect()
    steer: dict[int, list] = {}
    for r in some:
        steer.setdefault(len(r.embedding), []).append(r.embedding)
    steer = {w: unit(np.array(v, dtype=np.float64)) for w, v in steer.items()}
    celled = classes.mapInPandas(_cells(steer), "vec_id long, n long, embedding array<double>, width int, cell int")
    celled = scratch.save(celled, "cells")
    sizes = celled.groupBy("width", "cell").count().withColumn("parts", F.ceil(F.col("count") / tile))
    # parts: at most `pivots` rows per width, broadcast for that reason
    tiled = celled.join(F.broadcast(sizes.drop("count")), ["width", "cell"]).withColumn("tile", F.xxhash64("width", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
    packed = tiled.select("tile", "vec_id", "n", "embedding").groupBy("tile").applyInPandas(_pack(root, kind), "tile long, width int, ids binary, weights binary, codes binary, scale binary, error binary, file string, centre array<double>, angle double")
    packed = scratch.save(packed, "tiles")
    scratch.drop(celled)
    # Pairs of tiles, from their summaries only, kept where the caps leave room for a link. One
    # side is salted and the other repeated, with salts in proportion to the tiles, so that no task lists all pairs.
    caps = packed.select("tile", "width", "centre", "angle")
    salts = max(SALTS, caps.count() // LISTED)
    a = caps.withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(salts))).alias("a")
    b = caps.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).alias("b")
    cosine = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    near = (F.col("a.tile") == F.col("b.tile")) | (apart <= F.col("a.angle") + F.col("b.angle") + F.lit(float(np.arccos(threshold)) + 1e-6))
    pairs = a.join(b, (F.col("a.width") == F.col("b.width")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.tile") <= F.col("b.tile")) & near)
    ends = pairs.select(F.col("a.tile").alias("one"), F.col("b.tile").alias("two")).withColumn("tile", F.explode(F.array_distinct(F.array("one", "two"))))
    work = ends.join(packed.select("tile", "ids", "weights", "codes", "scale", "error", "file"), "tile").groupBy("one", "two")
    found = scratch.save(work.applyInPandas(_unit_of(root, kind, threshold), "vec_id long, n long, other long"), "found")
    scratch.drop(packed)
    links = found.filter("other is null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("other is not null"), "vec_id", "other", scratch)
    labels = parts.select(F.col("node").alias("rep"), "component")
    by_class = classes.join(links.withColumnRenamed("n", "more"), "vec_id", "left").join(labels, F.col("vec_id") == F.col("rep"), "left")
    by_class = by_class.select("embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    # Each row finds its class by the vector; rows that are not usable have none.
    member = rows.withColumn("key", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0)))).select("vec_id", "key", F.xxhash64("key").alias("h"))
    out = member.join(by_class.withColumnRenamed("embedding", "key").withColumn("h", F.xxhash64("key")), ["h", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT vec_id, coalesce((SELECT count(*) FROM link WHERE link.a = e.vec_id), 0) AS n_links, (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) AS kept
FROM embeddings e
"""
