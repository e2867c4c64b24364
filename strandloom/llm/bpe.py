"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte pieces.  Every pair of neighbours that has a rank is a
position in the bucket of that rank; a three-level bitmap of 64-bit words says which buckets
are not empty, so the lowest rank is three find-first-set steps away however long the
pre-token is.  A merge writes new positions into their buckets and leaves old ones where they are:
an entry whose pair is no longer the one its bucket stands for is skipped when its turn comes.
Each merge costs a constant number of steps (plus a heap step within its bucket), so a pre-token of n bytes takes O(n log n)
at worst, where rescanning all pairs takes O(n^2).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from strandloom.runtime import Scratch, ship

#: Pre-tokens remembered per worker, in each of two generations.
CACHE = 500_000
#: Longer pre-tokens are not remembered.
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position.

    ``low`` has a bit per rank, ``mid`` one per word of low, ``top`` one per word of mid (a Python integer, so any number of
    them). A bucket is a position, or a heap of them once it holds more than one.
    """

    def __init__(self, ranks: int):
        words = ranks // 64 + 1
        self.low = [0] * words
        self.mid = [0] * (words // 64 + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = at
            w = rank >> 6
            x = self.low[w]
            self.low[w] = x | _BITS[rank & 63]
            if not x:
                v = w >> 6
                self.mid[v] |= _BITS[w & 63]
                self.top |= 1 << v
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        v = (top & -top).bit_length() - 1
        m = self.mid[v]
        w = v << 6 | ((m & -m).bit_length() - 1)
        x = self.low[w]
        rank = w << 6 | ((x & -x).bit_length() - 1)
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            at = heappop(bucket)
            if bucket:
                return rank, at
        else:
            at = bucket
        del self.buckets[rank]
        self.low[w] = x = x & (x - 1)
        if not x:
            self.mid[v] = m = m & (m - 1)
            if not m:
                self.top = top & (top - 1)
        return rank, at


_BITS = [1 << k for k in range(64)]


class BytePairCoder:
    """Encodes and decodes by a rank table; all single bytes must have ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for {len(missing)} single bytes")
        self.ranks = ranks
        self.pieces = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.first = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]  # pairs of single bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, first = self.ranks, self.first
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        n = len(token)
        # A piece is named by where it begins; it ends where the next one begins, so the ends are the forward links.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [first[a << 8 | b] for a, b in zip(token, token[1:], strict=False)]  # the rank of the pair that begins here, now
        pair.append(-1)
        queue = self.queue
        push, pop = queue.push, queue.pop
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        get = ranks.get
        while (got := pop()) is not None:
            r, i = got
            if pair[i] != r:
                continue  # stale: one of its pieces has been merged since
            j = end[i]
            k = end[i] = end[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = get(token[i : end[k]], -1)
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = get(token[h:k], -1)
                if r >= 0:
                    push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def _missed(self, token: str) -> bytes:
        """A pre-token's ids as bytes. Two generations bound the memory and keep what is used often."""
        ids = self.old.get(token)
        if ids is None:
            raw = token.encode()
            ids = np.array(self.merge(raw), "<u4").tobytes()
            if len(raw) > CACHE_BYTES:
                return ids
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[token] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get, missed = self.young.get, self._missed
        out = []
        for t in self.find(text):
            ids = get(t)
            if ids is None:
                ids = missed(t)
                get = self.young.get
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One coder per worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = BytePairCoder(load_ranks(path))
    return _coders[path]


def _digests(path: str, from_name: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(public_tokenizers.path(from_name) if from_name else path)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = c.encode_bytes("" if text is None else text)
                back = c.decode_bytes(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), out], axis=1)

    return run


def _ids(path: str, text: str, doc_id: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf[doc_id], "ids": [c.encode("" if t is None else t) for t in pdf[text]]})

    return run


def encode_documents(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row; a null text has no ids. The path must exist on every executor."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text))
    return rows.mapInPandas(_ids(path, text, doc_id), "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, *, path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again).

    Null and empty texts have no tokens (digests of nothing). Repeated rows each give a row; an
    empty table stays empty; further columns are not carried. Without ``path`` the
    public vocabulary ``name`` is looked up on each worker.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(_digests(path, None if path else name), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return Scratch(docs.sparkSession, "bpe").save(out, "digests")  # written at once: small batches bound the workers' memory
