"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A payload is stored as an 8-bit greyscale PNG, 576 samples a line.  Each task appends its
payloads to tar shards of its own, one member per content, named by its SHA-256 digest; rows carry
the digest and the place of the member's bytes.  Which of the shards that hold a content
is read is settled by the smallest (shard, offset), so equal contents lead every row to one object.
Metadata columns (width, height, bit depth) come from range reads of the first 33 bytes only;
reading a payload back is one more range read of the rest.

A task writes under a name that no other attempt uses and only its committed rows name the shard:
an attempt that is lost or repeated leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.blobs import store_of
from strandloom.runtime import Scratch, ship

WIDTH = 576
PAD = b"\xff"
SHARD_BYTES = 256 << 20
EXTENT = 8 << 20  # objects of one such stretch of a shard are read by one task, in order
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk
LEVEL = 6


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with bytes 255 up to a positive multiple of 576, and their number without these."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 in front of each line
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, depth = png_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        (n,), kind, body = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8], data[at + 8 : at + 8 + struct.unpack(">I", data[at : at + 4])[0]]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit lines are written here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean of the samples, and a 64-bit average hash of the picture shrunk to 8 x 8."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    rows = np.linspace(0, len(x), 9).astype(int)
    sums = np.vstack([np.zeros((1, WIDTH)), np.cumsum(x, axis=0)])
    lo, hi = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    cells = ((sums[hi] - sums[lo]) / (hi - lo)[:, None]).reshape(8, 8, WIDTH // 8).mean(axis=2)
    bits = (cells > cells.mean()).ravel()
    return f"{x.mean():.3f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


class TarShard:
    """An append-only tar file on any store that pyarrow reaches; each content once."""

    def __init__(self, root: str, part: str):
        self.name = f"{part}-{uuid.uuid4().hex[:12]}.tar"
        store, path = store_of(f"{root}/{self.name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.at = 0
        self.known: dict[bytes, tuple[int, int, bytes]] = {}

    def put(self, digest: bytes, payload: bytes) -> tuple[int, int, bytes]:
        """Offset and length of the stored form, and its SHA-256."""
        found = self.known.get(digest)
        if found is None:
            data = to_png(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            found = self.known[digest] = (self.at + len(head), len(data), hashlib.sha256(data).digest())
            self.at += len(head) + len(data) + (-len(data) % 512)
        return found

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _store(root: str, limit: int):
    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if shard is None or shard.at >= limit:
                    if shard:
                        shard.close()
                    shard = TarShard(root, "shard")
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                offset, length, stored = shard.put(digest, payload)
                rows.append((doc_id, n, digest, shard.name, offset, length, stored))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length", "media_sha256"])
        if shard:
            shard.close()

    return store


class Reader:
    """Range reads; the last shard stays open."""

    def __init__(self, root: str):
        self.root, self.name, self.file = root, None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            store, path = store_of(f"{self.root}/{shard}")
            self.name, self.file = shard, store.open_input_file(path)
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{shard} ends before {offset + length}")
        return data


def _probe(root: str):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(root)
        for pdf in batches:
            heads = [png_header(r.read(s, o, HEADER_BYTES)) for s, o in zip(pdf["shard"], pdf["offset"], strict=True)]
            yield pdf.assign(**{k: [h[i] for h in heads] for i, k in enumerate(("width", "height", "bit_depth"))})

    return probe


def _features(root: str):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(root)
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                head = r.read(x.shard, x.offset, HEADER_BYTES)
                data = head + r.read(x.shard, x.offset + HEADER_BYTES, x.length - HEADER_BYTES)
                stored = hashlib.sha256(data)
                if stored.digest() != x.media_sha256:
                    raise OSError(f"{x.shard} at {x.offset}: stored bytes differ from their digest")
                p = from_png(data)
                rows.append((x.digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), stored.hexdigest(), feature_of(p), x.shard, x.offset, *png_header(head)))
            yield pd.DataFrame(rows, columns=FEATURES)

    return features


FEATURES = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "media_offset", "width", "height", "bit_depth"]
FEATURE_SCHEMA = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, media_offset long, width long, height long, bit_depth int"


def store_documents(docs: DataFrame, scratch: Scratch, *, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Writes the payloads. Returns the rows (doc_id, n_bytes, digest), the objects (digest, shard,
    offset, length, media_sha256; one per content) and the folder of the shards: the caller's, or one that goes with the driver."""
    ship(docs.sparkSession)
    root = folder.rstrip("/") if folder else f"{scratch.root}/shards"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = rows.mapInPandas(_store(root, shard_bytes), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long, media_sha256 binary")
    index = scratch.save(index, "index")
    objects = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "media_sha256")).alias("o")).select("digest", "o.*")
    return index.select("doc_id", "n_bytes", "digest"), objects, root


def _in_order(objects: DataFrame) -> DataFrame:
    n = max(8, int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return objects.repartition(n, "shard", F.floor(F.col("offset") / EXTENT)).sortWithinPartitions("shard", "offset")


def media_columns(objects: DataFrame, root: str) -> DataFrame:
    """objects with width, height and bit_depth from header-only range reads."""
    return _in_order(objects).mapInPandas(_probe(root), "digest binary, shard string, offset long, length long, media_sha256 binary, width long, height long, bit_depth int")


def document_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, then shard, media_offset, width, height, bit_depth, digest.

    shard is a file in ``folder``, which driver and executors must share and which nothing here deletes; without a folder the shards go with the driver.
    Null texts are stored as empty ones; equal texts share one object. Repeated rows each
    give a row; an empty table gives an empty table; further columns are not carried.
    """
    scratch = Scratch(docs.sparkSession, "media")
    rows, objects, root = store_documents(docs, scratch, folder=folder)
    # One task reads an object's header and then its payload: the objects are dealt out once for both.
    read = scratch.save(_in_order(objects).mapInPandas(_features(root), FEATURE_SCHEMA), "features")
    known = read.withColumn("h", F.xxhash64("digest"))
    out = rows.withColumn("h", F.xxhash64("digest")).join(known, ["h", "digest"])
    return out.select("doc_id", "n_bytes", *(F.lower(F.hex("digest")).alias("digest") if c == "digest" else F.col(c) for c in [*FEATURES[1:], "digest"]))
