"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles of five words.  Its signature has 32 symbols of 16
bits, each of a MinHash of its own, so two signatures differ in a symbol with probability 1 - J.  The symbols are split into 7
chunks: of two signatures that differ in at most 13 symbols, at least one chunk differs in at most one (pigeonhole).  So each
chunk is indexed once for every symbol that may be wrong in it, by its other symbols: 32 keys a
document, and all pairs up to distance 13 share a key (a pair of Jaccard similarity 0.85 is further apart in 9.3 of 100,000 cases, and then lost).

Below 85 percent, down to 80, the symbols are split into 8 chunks of 4, and every pair that shares a key is
confirmed whatever its distance: a pair of Jaccard similarity 0.80 shares no key in 1.1 of 1,000,000 cases.

Documents with equal sets are one class from the start.  A key's members are compared in units of bounded
size (a hot key is split into tiles and pairs of tiles): distances in numpy, each pair only under the
first key that it shares, then every remaining pair on the full sets, which units read by range from files in the shared
folder, in blocks of pairs with a bounded number of set elements.  A unit returns a spanning forest of its links, never pairs, so large groups of copies cost no more rows than they have members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.blobs import Reader, Writer
from strandloom.llm.embeddings import Forest
from strandloom.operators.components import connected_components
from strandloom.runtime import Scratch, ship

WORDS = 5
SYMBOLS = 32
CHUNKS = (5, 5, 5, 5, 4, 4, 4)  # symbols of each; one may be wrong
DISTANCE = 2 * len(CHUNKS) - 1
PERCENT = 85
LOW_CHUNKS = (4,) * 8  # below PERCENT; key-sharing pairs are not dropped by distance there
LOW_PERCENT = 80
TILE = 512  # members of a key that meet others in one unit
UNIT_ROWS = 4096  # rows of small units worked on together, about
GATHER = 1 << 22  # set elements gathered at once; more only where a single pair has more

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(20240607).integers(1, 1 << 62, (WORDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(20240608).integers(1, 1 << 62, (SYMBOLS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hashes: dict[str, int] = {}


def layout(percent: int) -> tuple[tuple[int, ...], int]:
    """Chunks, and the distance up to which pairs that share a key are confirmed."""
    return (CHUNKS, DISTANCE) if percent >= PERCENT else (LOW_CHUNKS, SYMBOLS)


def _starts(chunks: tuple[int, ...]) -> list[int]:
    """The chunks' first symbols, and the end."""
    return np.cumsum([0, *chunks]).tolist()


def _hash(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) >= 200_000:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles; of the word sequence, if it has fewer than five words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    u = np.fromiter(map(_hash, words), np.uint64, n)
    width = min(n, WORDS)
    s = np.full(n - width + 1, width, np.uint64) * _ODD
    for k in range(width):
        s = _mix(s * _STEPS[k] + u[k : n - width + 1 + k])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """32 symbols of 16 bits of a set that is not empty."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        x = s[None, at : at + 4096] * _FACTORS
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def _sets(root: str):
    """A row for each document; its set goes to the task's file, once for equal sets of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, known = None, {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles(text)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                raw = s.tobytes()
                name = xxhash.xxh3_128_digest(raw)
                if name not in known:
                    writer = writer or Writer(root, "sets")
                    if len(known) >= 200_000:
                        known.clear()
                    known[name] = (writer.append(raw), signature(s).tobytes())
                rows.append((doc_id, len(s), name, known[name][1], writer.name, known[name][0]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "name", "sig", "file", "at"]).astype({"doc_id": "Int64", "at": "Int64"})
        if writer:
            writer.close()

    return run


def _index(batches: Iterator[pd.DataFrame], chunks: tuple[int, ...] = CHUNKS) -> Iterator[pd.DataFrame]:
    """(key, doc_id): a chunk with one symbol left out, hashed with its place."""
    starts = _starts(chunks)
    places = [(c, s) for c in range(len(chunks)) for s in range(starts[c], starts[c + 1])]
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        ids = pdf["doc_id"].to_numpy(np.int64)
        for k, (c, wrong) in enumerate(places):
            key = np.full(len(sig), k, np.uint64)
            for s in range(starts[c], starts[c + 1]):
                if s != wrong:
                    key = _mix(key * _ODD + sig[:, s] + np.uint64(1))
            yield pd.DataFrame({"key": key.view(np.int64), "k": np.full(len(ids), k, np.int32), "doc_id": ids})


def _first_keys(eq: np.ndarray, chunks: tuple[int, ...] = CHUNKS) -> np.ndarray:
    """For pairs by symbols that are equal: the number of the first key they share, -1 for none."""
    out, starts = np.full(len(eq), -1), _starts(chunks)
    for c in range(len(chunks)):
        part = ~eq[:, starts[c] : starts[c + 1]]
        wrong = part.sum(axis=1)
        here = (out < 0) & (wrong <= 1)
        out[here] = starts[c] + np.where(wrong[here] == 0, 0, part[here].argmax(axis=1))
    return out


def _blocks(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of the pairs whose distinct sets hold at most ``limit`` elements together, or a single pair."""
    if sizes.sum() <= limit:
        yield slice(0, len(i))
        return
    start, held, total = 0, set(), 0
    for at, pair in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        new = {x for x in pair if x not in held}
        more = int(sum(sizes[x] for x in new))
        if at > start and total + more > limit:
            yield slice(start, at)
            start, held, total = at, set(), 0
            new, more = set(pair), int(sizes[list(pair)].sum())
        held |= new
        total += more
    yield slice(start, len(i))


class Sets:
    """Full sets by doc, read once per group of units as long as they fit; beyond ``GATHER * 2`` elements they are read again."""

    def __init__(self, root: str):
        self.reader, self.known, self.held = Reader(root), {}, 0

    def load(self, rows) -> None:
        if self.held > GATHER * 2:
            self.known.clear()
            self.held = 0
        for r in sorted(rows, key=lambda r: (r.file, r.at)):
            if r.doc_id not in self.known:
                self.known[r.doc_id] = np.frombuffer(self.reader.read(r.file, r.at, 8 * r.n), np.uint64)
                self.held += r.n


def _verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, forest: Forest, percent: int, names: np.ndarray) -> None:
    """Join i and j in the forest where 100 * intersection >= percent * union; i and j are places into ``sets``, whose place in the forest ``names`` has."""
    words, places = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    mark = np.zeros(len(words), bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    bounds = np.nonzero(np.diff(i))[0] + 1
    for a, others in zip(i[np.r_[0, bounds]], np.split(j, bounds), strict=True):
        root = forest.find(int(names[a]))
        others = np.array([b for b in others.tolist() if forest.find(int(names[b])) != root], int)
        mine = places[ends[a] - sizes[a] : ends[a]]
        mark[mine] = True
        step = max(1, GATHER // int(sizes.max()))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            both = np.add.reduceat(mark[np.concatenate([places[ends[b] - sizes[b] : ends[b]] for b in some])].astype(np.int64), np.r_[0, np.cumsum(sizes[some])[:-1]])
            for b in some[100 * both >= percent * (sizes[a] + sizes[some] - both)].tolist():
                forest.join(int(names[a]), int(names[b]))
        mark[mine] = False


def _units(root: str, percent: int):
    """Links within a group of units: rows (unit, k, one, two, part, doc_id, n, sig, file, at)."""
    chunks, distance = layout(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store, edges = Sets(root), []
        pdf = pdf.sort_values(["unit", "part", "doc_id"], ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SYMBOLS)
        ids, n, part, k, unit = (pdf[c].to_numpy() for c in ("doc_id", "n", "part", "k", "unit"))
        own = pdf["one"].to_numpy() == pdf["two"].to_numpy()
        rows = list(pdf[["doc_id", "n", "file", "at"]].itertuples(index=False))
        starts = np.r_[0, np.nonzero(np.diff(unit))[0] + 1, len(unit)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            s, m = sig[lo:hi], n[lo:hi]
            # Symbols of each row against all later rows; in a pair of tiles only rows of different tiles.
            found_i, found_j = [], []
            for a in range(hi - lo - 1):
                eq = s[a + 1 :] == s[a]
                ok = (SYMBOLS - eq.sum(axis=1) <= distance) & (100 * np.minimum(m[a], m[a + 1 :]) >= percent * np.maximum(m[a], m[a + 1 :]))
                if not own[lo]:
                    ok &= part[lo + a + 1 : hi] != part[lo + a]
                at = np.nonzero(ok)[0]
                if len(at):
                    at = at[_first_keys(eq[at], chunks) == k[lo]]
                    found_i.append(np.full(len(at), a))
                    found_j.append(at + a + 1)
            i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_i, found_j))
            if not len(i):
                continue
            used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
            forest = Forest(len(used))
            i, j = places[: len(i)], places[len(i) :]
            for block in _blocks(i, j, m[used], GATHER):
                # Pairs that earlier blocks have put into one tree need no sets.
                some = [(a, b) for a, b in zip(i[block].tolist(), j[block].tolist(), strict=True) if forest.find(a) != forest.find(b)]
                if some:
                    names, at = np.unique(np.array(some), return_inverse=True)
                    at = at.reshape(-1, 2)
                    store.load([rows[lo + used[x]] for x in names])
                    _verify([store.known[rows[lo + used[x]].doc_id] for x in names], at[:, 0], at[:, 1], forest, percent, names)
            edges += [(ids[lo + used[a]], ids[lo + used[b]]) for a, b in forest.edges]
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, *, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Null texts and texts without words have an
    empty set: they link with nothing and are kept. Rows of one doc_id are one document to the
    links; rows without a doc_id have no links, component or place (kept is false, unless their set is empty).
    An empty table gives an empty table; further columns are not carried.
    """
    if not LOW_PERCENT <= percent <= 100:
        raise ValueError(f"the signatures are made for {LOW_PERCENT} to 100 percent, with fewer chunks from {PERCENT} on")
    chunks, _ = layout(percent)
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "minhash")
    root = f"{scratch.root}/sets"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = scratch.save(rows.mapInPandas(_sets(root), "doc_id long, n long, name binary, sig binary, file string, at long"), "meta")
    some = meta.filter("n > 0 and doc_id is not null")
    reps = some.groupBy("name").agg(F.min(F.struct("doc_id", "n", "sig", "file", "at")).alias("r")).select("name", "r.*")
    reps = scratch.save(reps, "reps")
    keys = scratch.save(reps.select("doc_id", "sig").mapInPandas(lambda batches: _index(batches, chunks), "key long, k int, doc_id long"), "keys")
    shared = keys.groupBy("key", "k").agg(F.count("*").alias("members")).filter("members > 1")
    # A second hash as join key keeps this join's shuffles its own, so a hot key's rows can be split.
    members = keys.withColumn("h", F.xxhash64("key")).join(shared.withColumn("h", F.xxhash64("key")), ["key", "k", "h"]).drop("h")
    parts = F.ceil(F.col("members") / tile).cast("int")
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("members")
    members = scratch.save(members, "members")
    scratch.drop(keys)
    # A member of part p meets each part: units (p, q) and (q, p) are one.
    every = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = every.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")}).withColumn("unit", F.xxhash64("key", "k", "one", "two"))
    total = members.agg(F.sum("parts")).first()[0] or 0
    groups = max(1, -(-int(total) // UNIT_ROWS))
    every = every.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups)))
    every = every.select("group", "unit", "k", "one", "two", "part", "doc_id").withColumn("h", F.xxhash64("doc_id"))
    full = every.join(reps.drop("name").withColumn("h", F.xxhash64("doc_id")), ["doc_id", "h"]).drop("h")
    links = scratch.save(full.groupBy("group").applyInPandas(_units(root, percent), "a long, b long"), "links")
    scratch.drop(members)
    parts = connected_components(links, "a", "b", scratch)
    by_set = reps.select("name", F.col("doc_id").alias("rep"))
    by_set = by_set.join(parts, F.col("rep") == F.col("node"), "left").select("name", F.coalesce("component", "rep").alias("component")).withColumn("h", F.xxhash64("name"))
    out = meta.select("doc_id", "n", "name").withColumn("h", F.xxhash64("name")).join(by_set, ["name", "h"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("n") == 0).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, that stay when one document of each group of near copies stays.

    The document of the smallest doc_id stays; of equal rows of one doc_id, one. Rows without a doc_id all stay.
    """
    spark = docs.sparkSession
    work, kept = Scratch(spark, "minhash"), Scratch(spark, "kept")
    found = near_duplicates(docs, percent, scratch=work).filter("doc_id is not null")
    found = kept.save(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).filter("kept").select(F.col("doc_id").alias("__id"), "rows"), "kept")
    work.clear()
    work.release()
    here = F.col("doc_id").cast("long") == F.col("__id")
    once = docs.join(found.filter("rows = 1").hint("merge"), here, "left_semi")
    if found.filter("rows > 1").isEmpty():
        out = once
    else:
        out = once.unionByName(docs.join(found.filter("rows > 1").hint("merge"), here, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.unionByName(docs.filter("doc_id is null"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least_ AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_ USING (doc_id)
"""
