"""Packing documents into sequences: patterns of lengths fitted by non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers) comes to the driver.  There
patterns of up to three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares (an active-set solution, so few patterns are used, each many
times), rounded down to what is there, and what remains is packed best-fit by
descending length, again by counts (Krell et al., "Efficient sequence packing without cross-contamination", 2021).

Placing is distributed: pieces of one length are numbered in two levels, and number r of
length l falls into one interval of a table whose size depends on the capacity alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.sharding import slots
from strandloom.runtime import Scratch, ship

CAPACITY = 1024
EOS = 2
GRID = 1024  # lengths are rounded up to so many steps of the capacity at most when patterns are enumerated
BUCKET_ROWS = 100_000  # pieces of one length that one task numbers, about


# --- tokens -----------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Where the file's merges are in the order of their ids (so ids are ranks), tiktoken gives the
    same ids several times faster. Texts that hold one of the file's added tokens, and any other file, are read by the tokenizers
    library itself, with its default settings: an added token in a text becomes its own id.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranked = (
            (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec.get("normalizer") is None
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
            and all(set(t) <= letters.keys() for t in vocab if t not in special)
        )
        self.path, self.special, self._whole = path, [x for x in special if x], None
        if ranked:
            import tiktoken

            ranks = {bytes(letters[x] for x in t): i for t, i in vocab.items() if t not in special}
            self._ranked = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self._ranked = None

    def encode(self, text: str) -> list[int]:
        if self._ranked and not any(x in text for x in self.special):
            return self._ranked(text)
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, after a shorter first piece if need be."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str | None, name: str, capacity: int, eos: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens(path or public_tokenizers.path(name)).encode
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), eos], "<u4")
                raw = ids.tobytes()
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(part), part if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    return run


# --- patterns, on the driver ------------------------------------------------------------------


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths whose sum is the capacity: rows of three, 0 for none."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.nonzero(have)[0]
    a = a[a < capacity]
    two = a[(a * 2 <= capacity) & have[capacity - a]]
    out.append(np.stack([two, capacity - two, 0 * two], axis=1))
    for x in a[a * 3 <= capacity]:
        y = a[(a >= x) & (a * 2 <= capacity - x)]
        y = y[have[capacity - x - y]]
        out.append(np.stack([0 * y + x, y, capacity - x - y], axis=1))
    return np.concatenate(out)


def fit(pats: np.ndarray, histogram: np.ndarray, rounds: int = 400, batch: int = 64) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by an active-set method.

    As Lawson and Hanson's, but up to ``batch`` patterns enter per round. The matrix
    has at most three entries a column; only the Gram matrix of the active set is dense.
    """
    if not len(pats):
        return np.zeros(0)
    size = len(histogram)
    weight = np.where(np.arange(size) <= size // 128, 0.3, 1.0)  # short pieces fill gaps anyway
    weight[0] = 0.0
    b = histogram * weight
    x, active = np.zeros(len(pats)), np.zeros(0, int)

    def columns(at):
        m = np.zeros((size, len(at)))
        for k in range(3):
            np.add.at(m, (pats[at, k], np.arange(len(at))), weight[pats[at, k]])
        return m

    for _ in range(rounds):
        m = columns(active)
        gap = b - m @ x[active]
        slope = (weight[pats] * gap[pats]).sum(axis=1)
        slope[active] = -1
        best = np.argsort(-slope, kind="stable")[: batch * 8]
        best = best[slope[best] > 1e-7 * max(1.0, np.abs(b).max())]
        used, new = set(), []
        for p in best:  # patterns that share a length would fight over one gap
            if not used & set(pats[p].tolist()) - {0}:
                used |= set(pats[p].tolist())
                new.append(p)
        if not new:
            break
        active = np.concatenate([active, np.array(new[:batch], int)])
        while len(active):
            m = columns(active)
            z = np.linalg.solve(m.T @ m + 1e-9 * np.eye(len(active)), m.T @ b)
            if z.min() > 0:
                x[active] = z
                break
            falling = z <= 0
            old = x[active]
            step = np.min(old[falling] / np.maximum(old[falling] - z[falling], 1e-300))
            old = old + step * (z - old)
            out = falling & (old <= 1e-9 * max(1.0, old.max()))
            x[active] = np.where(out, 0, old)
            active = active[~out]
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of sequences that hold the counts left, best-fit by descending length."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(capacity + 1, bool)

    def put(space: int, lengths: tuple[int, ...], count: int) -> None:
        open_.setdefault(space, []).append((lengths, count))
        room[space] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = length + int(np.argmax(room[length:]))
            if room[at]:
                lengths, count = open_[at].pop()
                if not open_[at]:
                    room[at] = False
                each = at // length
                take = min(count, n // each) if n >= each else 1
                more = each if n >= each else n
                if take < count:
                    put(at, lengths, count - take)
                put(at - more * length, lengths + (length,) * more, take)
                n -= take * more
            else:
                each = capacity // length
                put(capacity, (), max(1, n // each))
    return [g for groups in open_.values() for g in groups if g[0]]


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of sequences that hold exactly histogram[l] pieces of each length l up to the capacity."""
    capacity = len(histogram) - 1
    step = -(-capacity // GRID)
    # A coarse grid for large capacities: round lengths up, and take the shortest pieces of a step first.
    bins = capacity // step
    coarse = np.zeros(bins + 1, np.int64)
    for length in range(1, capacity + 1):
        coarse[min(bins, -(-length // step))] += histogram[length] if -(-length // step) <= bins else 0
    pats = patterns(np.nonzero(coarse)[0], bins)
    counts = np.floor(fit(pats, coarse.astype(float)) + 1e-6).astype(np.int64)
    left, out = histogram.astype(np.int64).copy(), []
    for p in np.argsort(-counts, kind="stable"):
        if counts[p] < 1:
            break
        want = int(counts[p])
        while want:
            lengths = []
            for slot in pats[p][pats[p] > 0]:
                span = np.arange((slot - 1) * step + 1, min(capacity, slot * step) + 1)
                free = span[left[span] > lengths.count(span[0]) if step == 1 else left[span] > 0]
                if not len(free):
                    break
                lengths.append(int(free[-1]))
            need = {x: lengths.count(x) for x in lengths}
            if len(lengths) < np.count_nonzero(pats[p]) or any(left[x] < k for x, k in need.items()):
                break
            n = min(want, *(int(left[x]) // k for x, k in need.items()))
            out.append((tuple(lengths), n))
            for x, k in need.items():
                left[x] -= n * k
            want -= n
    return out + best_fit(left, capacity)


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, which numbers go to which run of sequences: (length, first, sequence, offset), sorted."""
    following: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, count in planned:
        at = 0
        for length in lengths:
            first = following.get(length, 0)
            rows.append((length, first, sequence, at))
            following[length] = first + count
            at += length
        sequence += count
    out = pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def _place(table: pd.DataFrame):
    lengths, first, sequence, offset = (table[c].to_numpy() for c in ("length", "first", "sequence", "offset"))
    starts = np.searchsorted(lengths, np.arange(lengths.max() + 2 if len(lengths) else 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, number = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            at = np.zeros(len(pdf), np.int64)
            for x in np.unique(size):
                here = size == x
                at[here] = starts[x] + np.searchsorted(first[starts[x] : starts[x + 1]], number[here], "right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=sequence[at] + number - first[at], offset=offset[at])

    return run


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, eos: int = EOS, path: str | None = None, name: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, on request).

    A document is its text's ids and the end id (a null text: only that). Longer ones than the
    capacity are cut into pieces of the capacity, the first of which may be shorter. Repeated
    rows are packed each for itself; an empty table gives an empty table; further columns are not carried.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInPandas(_pieces(path, name, capacity, eos, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = scratch.save(pieces if with_ids else pieces.drop("ids"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    table = intervals(plan(histogram))
    buckets = max(16, -(-int(histogram.max()) // BUCKET_ROWS))
    numbered = slots(pieces, "length", ["doc_id", "piece", "ids_crc32"], buckets=buckets, slot="rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    return numbered.select(*names).mapInPandas(_place(table), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, doc_ids, offsets) of pieces packed with_ids; a sequence's capacity bounds what meets in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return out.select("sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
