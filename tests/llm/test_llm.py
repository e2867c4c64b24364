"""Each operator on a small table of awkward rows, against brute force or an exact round trip."""

import collections
import hashlib
import math
import random
import re
import struct
import tarfile
import textwrap
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import blobs, bpe, chat, embeddings, licenses, linededup, media, minhash, packing, quality, sharding
from strandloom.runtime import Scratch, shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Columns beside doc_id and text have names that the operators use themselves.
SCHEMA = "doc_id long, text string, n long, key string, shard int, component long, h long, size long, kept boolean, line string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    rng = random.Random(11)
    base, long_ = words(rng, 60), words(rng, 20_000)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", " \t\n", "one", base, base, " ".join(near), long_, long_ + " tail", base.upper(), "a b c d e", "A B c d e", "ü" * 300, "x\n\n\ny", "ends with space ", "<|endoftext|> \\ ### </turn>"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, base), (None, None), (-5, "negative id " + base), (2**62, "large id")]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, 5, True, "l") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("doc_id = 12345678")


def bag(values=()):
    return collections.Counter(values)


# --- 1 ------------------------------------------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 24, 70):
        for r in sharding.jump_shards(df, "k", n).collect():
            assert (r.shard, r.grown_shard) == (jump(r.k & (2**64 - 1), n), jump(r.k & (2**64 - 1), n + 1))
            assert r.grown_shard in (r.shard, n)


def test_shards_of_documents(docs, rows, nothing):
    got = sharding.shard_documents(docs, 5).collect()
    raw = [(t or "").encode() for _, t in rows]
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((i, len(x) + 8, zlib.crc32(x)) for (i, _), x in zip(rows, raw, strict=True))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.shard == jump((r.doc_id or 0) & (2**64 - 1), 5) for r in got)
    assert sharding.shard_documents(nothing).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        sharding.jump_shards(docs, "doc_id", 0)


# --- 2 ------------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(int)
    up = {i: i for i, _ in good}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (links[i], find(i) if i in up else i) for i, _ in rows}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * (0.05 + 0.3 * (k % 7))).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[3][1]) for k in range(40)] + [(400, [0.0] * 16), (401, None), (402, [float("nan")] * 16), (403, [1.0, None]), (404, [float("inf"), 1.0]), (405, []), (406, [1.0, 0.0]), (407, [0.95, 0.1]), (408, [1e-30] * 16), (409, [1e30] * 16)]
    want = brute_links(rows, 0.9)
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(4)
    got = embeddings.dedup_embeddings(df, tile=50, pivots=4).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.dedup_embeddings(df.filter("vec_id < 0")).count() == 0


def test_tile_reads_only_the_vectors_of_undecided_pairs():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[200:] = x[:200] + (rng.random((200, 1)) * 0.8 * rng.normal(size=(200, 24))).astype(np.float32)
    u, reads = embeddings.unit(x.astype(np.float64)), []

    def tile(lo, hi):
        raw = x[lo:hi].tobytes()
        return embeddings.Tile(np.arange(lo, hi), np.ones(hi - lo, np.int64), *embeddings.quantise(u[lo:hi]), lambda at, n: reads.append(n) or raw[at : at + n], "f4")

    want = u @ u.T >= 0.9
    np.fill_diagonal(want, False)
    own, _, _ = embeddings.tile_links(tile(0, 400), None, 0.9)
    assert own.tolist() == want.sum(axis=1).tolist()
    assert 0 < sum(reads) < x.nbytes // 4
    one, two, edges = embeddings.tile_links(tile(0, 200), tile(200, 400), 0.9)
    assert one.tolist() == want[:200, 200:].sum(axis=1).tolist() and two.tolist() == want[:200, 200:].sum(axis=0).tolist()
    assert all(want[a, b] for a, b in edges)


def test_all_joins_at_once_give_the_same_trees():
    rng = np.random.default_rng(2)
    for n, m in ((50, 20), (50, 60), (300, 5000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        one, all_ = embeddings.Forest(n), embeddings.Forest(n)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            one.join(a, b)
        all_.join_all(i, j)
        assert [one.find(k) for k in range(n)] == [all_.find(k) for k in range(n)]
        assert len(one.edges) == len(all_.edges)


def test_quantised_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = (embeddings.unit(rng.normal(size=(200, 40))) for _ in range(2))
    (qx, sx, ex), (qy, sy, ey) = embeddings.quantise(x), embeddings.quantise(y)
    nx = np.linalg.norm(qx * sx[:, None], axis=1)
    near = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy[None, :]
    assert (np.abs(near - x @ y.T) <= nx[:, None] * ey[None, :] + ex[:, None] + 1e-12).all()


# --- 3 ------------------------------------------------------------------------------------------------


def test_quality_keeps_good_and_drops_bad(spark):
    rng = random.Random(3)
    vocabulary = words(rng, 300).split()
    good = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 80))) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=40)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (902, good[0], "x"), (902, good[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __FOLD string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(0, 1, 0), (None, 1, 0), (7, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    s = quality.Selection(docs, labels)
    out = {r.doc_id: r.kept for r in quality.select_documents(docs, labels).collect()}
    assert sum(out[i] for i in range(300)) >= 297
    assert sum(out[i] for i in range(300, 360)) <= 3
    kept = s.filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}
    scores = sorted((r.key for r in s.scores.collect()), reverse=True)
    assert s.least == scores[s.k - 1]
    # Without bad labels nothing goes; an empty table stays empty.
    assert quality.select_documents(docs, labels.filter("quality = 1")).filter("not kept").count() == 0
    assert quality.select_documents(docs.filter("doc_id < 0"), labels).count() == 0


def brute_grams(text):
    """Buckets by the published XXH64 and 64-bit integer arithmetic, word by word."""
    mask, mix = 2**64 - 1, 0x9E3779B97F4A7C15
    h = [xxhash.xxh64(w.encode()).intdigest() for w in re.findall(r"\w+|[^\w\s]+", text or "")]
    two = [((((a * mix) & mask) ^ ((b + (a >> 7)) & mask)) * mix) & mask for a, b in zip(h, h[1:], strict=False)]
    return [(x >> 20) % 65536 for x in h + two]


def brute_gumbel(doc_id):
    """Spark's xxhash64 of a long and an int is XXH64 of their bytes, the first one's hash being the second one's seed."""
    h = xxhash.xxh64(struct.pack("<q", doc_id or 0), seed=42).intdigest()
    h = xxhash.xxh64(struct.pack("<i", quality.SEED), seed=h).intdigest()
    return -math.log(-math.log(((h >> 12) + 0.5) / 2**52))


def test_every_weight_key_and_choice_by_brute_force(spark, docs, rows):
    rng = random.Random(8)
    vocabulary = words(rng, 150).split()
    more = [(100 + k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) + (" ! ?? !" * rng.randint(1, 9) if k % 4 == 0 else "")) for k in range(200)]
    every, plain = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*r, "k") for r in more], "doc_id long, text string, key string")), [*rows, *more]
    marks = {100 + k: int(k % 4 > 0) for k in range(0, 200, 3)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    s = quality.Selection(every, labels)
    fold = {r.doc_id: r.fold for r in s.scores.filter("fold is not null").collect()}
    assert set(fold) == set(marks) and set(fold.values()) == {0, 1}
    raw = collections.Counter(b for _, t in plain for b in brute_grams(t))
    total = sum(raw.values())
    ratios = []
    for without in (0, 1, None):
        target = collections.Counter(b for i, t in plain if marks.get(i) == 1 and fold[i] != without for b in brute_grams(t))
        size = sum(target.values())
        rate = {b: (target[b] + 10) / (n / total * size + 10) for b, n in raw.items()}
        norm = sum(raw[b] / total * x for b, x in rate.items())
        ratios.append({b: math.log(x / norm) for b, x in rate.items()})
    want = []
    for i, t in plain:
        r = ratios[fold[i] if i in fold else 2]
        want.append((i, len(brute_grams(t)), sum(r[b] for b in brute_grams(t))))
    keys = sorted((w + brute_gumbel(i) for i, _, w in want), reverse=True)
    for k in (s.k, 30, len(plain) + 5, 0):
        least = keys[min(k, len(keys)) - 1] if k else math.inf
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_ngrams, r.weight, r.key, r.kept) for r in quality.select_documents(every, labels, k=k).collect()), key=lambda r: r[:4])
        expected = sorted(((i is None, i or 0, n, w, w + brute_gumbel(i), w + brute_gumbel(i) >= least - 1e-9) for i, n, w in want), key=lambda r: r[:4])
        for g, e in zip(got, expected, strict=True):
            assert g[:3] == e[:3] and g[3:5] == pytest.approx(e[3:5], abs=1e-8) and g[5] == e[5]
    # The cut itself: no other threshold costs less on the labelled rows.
    held = [(w, marks[i]) for i, _, w in want if i in marks]
    cost = lambda c: sum(20 * (q == 1 and w < c) + (q == 0 and w >= c) for w, q in held)
    cut = quality.cut_weight(s.scores)
    assert cost(cut) <= min(cost(w + e) for w, _ in held for e in (-1e-9, 1e-9)) + 1
    assert s.k == sum(w >= cut for _, _, w in want)


def test_gumbel_sampling_departs_from_the_threshold_as_predicted(spark):
    """A document of weight w is kept with probability 1 - exp(-exp(w - least)): the sample is no threshold set, and differs from it as this says."""
    rng = random.Random(21)
    vocabulary = words(rng, 60).split()
    texts = [" ".join(rng.choices(vocabulary[: 60 - k % 30], k=rng.randint(1, 12))) for k in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 30 > 20), 0) for k in range(0, 4000, 5)], "doc_id long, quality int, toxic int")
    s = quality.Selection(docs, labels, k=1500)
    out = [(r.weight, r.key >= s.least) for r in s.scores.collect()]
    assert sum(kept for _, kept in out) == 1500
    top = sorted((w for w, _ in out), reverse=True)[1499]
    p = [1 - math.exp(-math.exp(w - s.least)) for w, _ in out]
    for side in (True, False):
        chosen = [(kept, q) for (w, kept), q in zip(out, p, strict=True) if (w >= top) == side]
        mean, var = sum(q for _, q in chosen), sum(q * (1 - q) for _, q in chosen)
        assert abs(sum(kept for kept, _ in chosen) - mean) < 5 * math.sqrt(var)
    assert 100 < sum(kept != (w >= top) for w, kept in out)


# --- 4 ------------------------------------------------------------------------------------------------


def decoded_png(data):
    """Width, height and samples of an 8-bit greyscale PNG, with every filter type, written from the format's description."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        chunks.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height = int.from_bytes(chunks[0][1][:4], "big"), int.from_bytes(chunks[0][1][4:8], "big")
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    raw, out, above = zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT")), bytearray(), bytearray(width)
    assert len(raw) == height * (width + 1)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        if kind:
            for x in range(width):
                a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + (a, b, (a + b) // 2, near)[kind - 1]) % 256
        out += line
        above = line
    return width, height, bytes(out)


def brute_feature(samples):
    """Mean to three places, and which of 8 x 8 cells are lighter than their mean, in exact fractions."""
    n = len(samples) // 576
    lines = [samples[576 * y : 576 * (y + 1)] for y in range(n)]
    cells = []
    for r in range(8):
        lo = n * r // 8
        hi = max(n * (r + 1) // 8, lo + 1)
        cells += [Fraction(sum(sum(x[72 * c : 72 * (c + 1)]) for x in lines[lo:hi]), 72 * (hi - lo)) for c in range(8)]
    mean = sum(cells) / 64
    return f"{sum(samples) / len(samples):.3f}:{int(''.join('01'[x > mean] for x in cells), 2):016x}"


def test_media_round_trip(spark, docs, rows, nothing, tmp_path):
    got = media.document_media(docs, f"file://{tmp_path}").collect()
    assert bag(r.doc_id for r in got) == bag(i for i, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = next(x for x in by[i] if x.payload_sha256 == hashlib.sha256(payload).hexdigest())
        # The files are the caller's: they outlive the query, and are read here by plain file access.
        with open(tmp_path / r.shard, "rb") as f:
            f.seek(r.media_offset)
            stored = f.read(r.media_bytes)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert decoded_png(stored) == (576, len(payload) // 576, payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert (r.width, r.height, r.bit_depth) == (576, len(payload) // 576, 8)
        assert r.feature == brute_feature(payload)
    assert media.document_media(nothing).count() == 0


def test_stores_of_hadoop_names(tmp_path):
    assert blobs.store_of(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    for scheme, kind in (("s3a", "S3"), ("s3n", "S3")):
        assert kind in type(blobs.store_of(f"{scheme}://bucket/x?region=us-east-1")[0]).__name__
    with pytest.raises(OSError, match="viewfs"):
        blobs.store_of("viewfs://cluster/x")


def test_tar_shards_are_tar_files_with_each_content_once(spark, docs):
    scratch = Scratch(spark, "test")
    _, objects, root = media.store_documents(docs.coalesce(1), scratch, shard_bytes=4096)
    table = objects.collect()
    names = {r.shard for r in table}
    assert len(names) > 1
    for name in names:
        with tarfile.open(f"{root.removeprefix('file://')}/{name}") as t:
            members = t.getmembers()
            assert len({m.name for m in members}) == len(members)
            for r in table:
                if r.shard == name:
                    m = t.getmember(f"{bytes(r.digest).hex()}.png")
                    assert (m.offset_data, m.size) == (r.offset, r.length)
                    assert hashlib.sha256(media.from_png(t.extractfile(m).read())).digest() == bytes(r.digest)
    heads = media.media_columns(objects, root).collect()
    assert {(r.width, r.bit_depth) for r in heads} == {(576, 8)}


def test_damaged_media_are_refused():
    data = bytearray(media.to_png(media.payload_of("text")[0]))
    data[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(data))


# --- 5 ------------------------------------------------------------------------------------------------


def brute_licenses(text):
    """Best hit of lines, document, and windows at anchors; and the licenses that any window of a template's length, at any place, reaches."""
    hits, lines = [], (text or "").split("\n")
    dice = lambda g, m: 2 * len(g & m) / (len(g) + len(m)) if g else 0
    pairs = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
    every = [(name, licenses.words_of(t)) for name, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    for k, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
        hits += [(-dice(pairs(licenses.words_of(unit)), pairs(w)), k, name) for name, w in every]
    words_ = [(w, k) for k, line in enumerate(lines) for w in licenses.words_of(line)]
    anywhere = collections.defaultdict(float)
    _, anchors = licenses.anchors_of(licenses.TEMPLATES, licenses.THRESHOLD)
    for t, (name, w) in enumerate(every):
        at = [(x, i) for x, of, i in anchors if of == t]
        aligned = {k - i for k, (x, _) in enumerate(words_) for y, i in at if x == y}
        for start in range(-len(w), len(words_)):
            unit = words_[max(start, 0) : start + len(w)]
            if unit:
                d = dice(pairs([x for x, _ in unit]), pairs(w))
                anywhere[name] = max(anywhere[name], d)
                if start in aligned:
                    hits.append((-d, unit[0][1], name))
    hits = sorted(h for h in hits if h[0] <= -licenses.THRESHOLD)
    names = sorted({h[2] for h in hits})
    return (len(names), ",".join(names), *((hits[0][2], -hits[0][0], hits[0][1]) if hits else (None, None, None))), {n for n, d in anywhere.items() if d >= licenses.THRESHOLD}


def wrapped(text, width):
    return "\n".join(" * " + x for x in textwrap.wrap(text, width))


def test_license_scan_against_brute_force(spark, docs, nothing):
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rng = random.Random(8)
    texts = [None, "", "x", "software", *notices, *(words(rng, 30) + "\n" + t.upper() + "\nmore" for t in notices)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.1) for t in notices for _ in range(2)] + [notices[0] + "\n" + notices[0], " ".join(notices)]
    texts += [f"{words(rng, 60)}\n{wrapped(t, 40)}\n{words(rng, 60)}" for t in notices] + [f"{words(rng, 20)} {t} {words(rng, 20)}" for t in notices]
    edited = len(texts)
    for t in notices:
        for _ in range(2):
            w = [rng.choice(["changed", x, x]) if rng.random() < 0.06 else x for x in t.split() if rng.random() > 0.02]
            texts.append(f"{words(rng, 40)}\n{wrapped(' '.join(w), 60)}\n{words(rng, 40)}")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_licenses int").repartition(4)
    want = [brute_licenses(t) for t in texts]
    got = {r.doc_id: (r.n_licenses, r.licenses, r.best_license, r.best_dice, r.best_line) for r in licenses.scan_licenses(df).collect()}
    assert got == {i: w for i, (w, _) in enumerate(want)}
    # Wrapped and embedded notices are all found; of edited ones that some window reaches, nine in ten at least.
    for i in range(edited):
        assert all(got[i][1] and n in got[i][1].split(",") for n, ts in licenses.TEMPLATES.items() if any(" ".join(licenses.words_of(t)) in " ".join(licenses.words_of(texts[i] or "")) for t in ts))
    there = [(i, n) for i in range(edited, len(texts)) for n in want[i][1]]
    assert len(there) > 20
    assert sum(n in got[i][1].split(",") for i, n in there) >= 0.9 * len(there)
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(df, {}).filter("n_licenses > 0").count() == 0


def test_wrapped_notice_in_a_long_file(spark):
    mit = max(licenses.TEMPLATES["MIT"], key=len)
    rng = random.Random(3)
    text = wrapped(mit, 72) + "\n" + "\n".join(words(rng, 9) for _ in range(200))
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.licenses, r.best_dice, r.best_line) == ("MIT", 1.0, 0)


# --- 6 ------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken_and_decodes(docs, rows, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.coder(path)
    rng = random.Random(6)
    hard = ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "\n" * 999, "".join(rng.choice("aeiou 'sté你\U0001f642") for _ in range(5000)), "don't we'll  it's", "\x00퟿"]
    for s in [*hard, *((t or "") for _, t in rows)]:
        assert c.encode(s) == other.encode_ordinary(s)
        assert c.decode_bytes(c.encode(s)) == s.encode()
    got = bpe.digest_documents(docs).collect()
    want = bag()
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert bag(tuple(r) for r in got) == want
    assert bpe.digest_documents(nothing).count() == 0
    assert bpe.encode_documents(docs, path).count() == len(rows)
    with pytest.raises(ValueError, match="single bytes"):
        bpe.BytePairCoder({b"a": 0})


def test_rank_queue_gives_the_lowest_rank_leftmost():
    rng = random.Random(2)
    q, items = bpe.RankQueue(300_000), []
    for _ in range(2000):
        x = (rng.choice([1, 63, 64, 4095, 4096, 262_144, 299_999]), rng.randrange(10**6))
        items.append(x)
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items)
    assert q.pop() is None


# --- 7 ------------------------------------------------------------------------------------------------


def test_packing(docs, rows, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275] == packing.tokens(public_tokenizers.path("byte_bpe_50k.json")).encode("a <|endoftext|> b")
    out = packing.pack_documents(docs, with_ids=True).cache()
    got = out.collect()
    want = bag()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[(i, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])))] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    whole = packing.sequences(out).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in got)
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_length_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1 + rng.geometric([0.02, 0.003, 0.2, 0.001][seed], 3000), 1024)
    h = np.bincount(lengths, minlength=1025)
    planned = packing.plan(h)
    used = np.zeros(1025, int)
    for ls, n in planned:
        assert sum(ls) <= 1024
        for x in ls:
            used[x] += n
    assert (used == h).all()
    assert sum(n for _, n in planned) <= 1.03 * sum(n for _, n in packing.best_fit(h, 1024)) + 1


def test_cut_and_large_capacity():
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    h = np.bincount(np.random.default_rng(0).integers(1, 4097, 500), minlength=4097)
    planned = packing.plan(h)
    assert sum(len(ls) * n for ls, n in planned) == 500
    assert all(sum(ls) <= 4096 for ls, _ in planned)


# --- 8 ------------------------------------------------------------------------------------------------


def brute_near(rows, percent=85):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = minhash._WORD.findall((t or "").translate(minhash._LOWER))
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if i is not None and s:
            sets[i] = s
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sets, {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark, docs, rows, nothing):
    rng = random.Random(9)
    base = words(rng, 150).split()
    group = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        group.append((1000 + k, " ".join(w), 1, "k", 2, 3, 4, 5, True, "l"))
    every = docs.unionByName(spark.createDataFrame(group, SCHEMA))
    plain = [*rows, *((g[0], g[1]) for g in group)]
    sets, want = brute_near(plain)
    got = minhash.near_duplicates(every, tile=16).collect()
    assert len(got) == len(plain)
    for r in got:
        if r.doc_id is not None:
            assert r.n_shingles == len(sets.get(r.doc_id, ()))
            assert r.component_id == want.get(r.doc_id, r.doc_id)
            assert r.kept == (r.component_id == r.doc_id)
        else:
            assert r.component_id is None
    stay = minhash.keep_one(every)
    assert stay.columns == every.columns
    ids = [r.doc_id for r in stay.collect()]
    assert bag(i for i in ids if i is not None) == bag({want.get(i, i) for i, _ in plain if i is not None})
    assert ids.count(None) == 2
    assert minhash.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError, match="85"):
        minhash.near_duplicates(docs, 50)


def test_blocks_of_pairs_hold_bounded_sets():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 90, 60)
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.2], strict=True))
    blocks = list(minhash._blocks(i, j, sizes, 200))
    assert [k for b in blocks for k in range(b.start, b.stop)] == list(range(len(i)))
    assert all(b.stop - b.start == 1 or sizes[np.unique(np.concatenate([i[b], j[b]]))].sum() <= 200 for b in blocks)
    assert list(minhash._blocks(i, j, sizes, int(sizes.sum()))) == [slice(0, len(i))]


def test_units_of_long_texts_in_blocks(tmp_path, monkeypatch):
    import pandas as pd

    rng = random.Random(12)
    texts = []
    for size in (40, 400, 3000):
        base = words(rng, size).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, size // 60)):
                w[rng.randrange(size)] = words(rng, 1)
            texts.append(" ".join(w))
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    meta = pd.concat(minhash._sets(f"file://{tmp_path}")(iter([pdf])))
    # One unit for every key, of all documents: pairs that share no key are told apart inside.
    units = pd.concat([meta.drop(columns="name").assign(unit=k, k=k, one=0, two=0, part=0) for k in range(minhash.SYMBOLS)])
    _, want = brute_near(list(enumerate(texts)))
    for gather in (50, 2000, 1 << 22):
        monkeypatch.setattr(minhash, "GATHER", gather)
        links = minhash._units(f"file://{tmp_path}", 85)(units.astype({"doc_id": "int64", "at": "int64"}))
        up = embeddings.Forest(len(texts))
        up.join_all(links["a"].to_numpy(), links["b"].to_numpy())
        assert {k: up.find(k) for k in range(len(texts))} == want


def test_keys_meet_all_pairs_up_to_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (400, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        at = rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)
        b[k, at] += 1
    first = minhash._first_keys(a == b)
    assert (first >= 0).all()
    import pandas as pd

    keys = lambda x: pd.concat(minhash._index([pd.DataFrame({"sig": [r.tobytes() for r in x], "doc_id": range(len(x))})]))
    both = keys(a).merge(keys(b), on=["key", "k", "doc_id"])
    assert set(both["doc_id"]) == set(range(len(a)))
    low = both.groupby("doc_id")["k"].min()
    assert (low.sort_index().to_numpy() == first).all()


def low_pairs():
    """Texts of 210 words, each with a copy of 4 changed words far apart (186 of 226 shingles, J = 0.82) and one of 9 (J = 0.64)."""
    rng = random.Random(21)
    rows = []
    for k in range(40):
        w = words(rng, 210).split()
        for at, n in ((0, 0), (1, 4), (2, 9)):
            x = list(w)
            for i in range(n):
                x[10 + 20 * i] = f"changed{k}x{at}x{i}"
            rows.append((3 * k + at, " ".join(x)))
    return rows


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline as c

    rows = low_pairs()
    _, want = brute_near(rows, 80)
    _, strict = brute_near(rows, 85)
    assert len(set(strict.values())) == len(rows)  # no pair reaches 0.85
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 80, tile=16).collect()}
    assert got == want
    assert {r.doc_id for r in c.near_dedup(spark, df, "").collect()} == set(want.values())
    assert len(set(want.values())) == 80


def test_low_keys_meet_all_pairs_with_one_wrong_symbol_in_a_chunk():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        b[k, rng.choice(minhash.SYMBOLS, 15, replace=False)] += 1
    assert (minhash._first_keys(a == b, minhash.LOW_CHUNKS) >= 0).all()


# --- 9 ------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(1)
    pieces = ["\\", "###", "</turn>", "\n", ": ", "#", "<", "text", "### assistant: "]
    for _ in range(300):
        turns = [("".join(rng.choices(pieces + ["user", "assistant"], k=rng.randint(0, 2))), "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError, match="no turn"):
        chat.parse_turns("hello")


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "\\### Assistant: </turn> ok", 1), (2, 5, None, None, 1), (3, None, "assistant", "a", 1), (3, 0, "user", "b", 1), (3, 0, "user", "b", 1), (None, 0, "user", "x", 1)]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k}", 1) for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.format_turns(turns)[0])
    assert chat.conversation_digests(df.filter("conv_id < 0")).count() == 0


def test_reply_trees(spark):
    rng = random.Random(4)
    rows, parent, score = [], {}, {}
    for n in range(60):
        parent[n] = None if n < 3 else rng.randrange(n)
        score[n] = rng.choice([0.0, 0.5, 1.0, None])
        rows.append((7, n, parent[n], "user", f"m{n}", score[n]))
    rows += [(8, 1, 2, "x", "cycle", 0.0), (8, 2, 1, "x", "cycle", 0.0), (9, 1, 55, "x", "no such parent", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")

    def path(n):
        return ([] if parent[n] is None else path(parent[n])) + [n]

    leaves = set(parent) - set(parent.values())
    best = collections.defaultdict(list)
    for leaf in leaves:
        p = path(leaf)
        best[p[0]].append((-sum(score[x] or 0.0 for x in p) / len(p), leaf, p))
    want = {(7, leaf, k + 1, "".join(f"### user: m{x}</turn>\n" for x in p)) for r in best.values() for k, (_, leaf, p) in enumerate(sorted(r)[:2])}
    got = {(r.tree, r.leaf, r["rank"], r.formatted) for r in chat.format_conversations(df, branches=2).collect()}
    assert got == want | {(9, 1, 1, "### x: no such parent</turn>\n")}


# --- 10 -----------------------------------------------------------------------------------------------


def brute_lines(rows):
    """The same definition by plain loops over token lists, one group at a time."""
    places = collections.defaultdict(list)
    for i, text in rows:
        if i is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                tokens = tuple("<*>" if any(c in "0123456789" for c in t) else t for t in re.split("[\\x20\\x09-\\x0D]+", line) if t)
                if tokens:
                    places[tokens].append((i, k))
    groups, template = collections.defaultdict(list), {}
    for t in places:
        groups[(len(t), t[:4])].append(t)
    open_ = list(groups.values())
    while open_:
        group = open_.pop()
        if len(group) < 2 or len({i for t in group for i, _ in places[t]}) < 2:
            continue
        total = sum(len(places[t]) for t in group)
        have, kinds = collections.Counter(), collections.Counter()
        for t in group:
            for at in enumerate(t):
                have[at] += len(places[t])
                kinds[at] += 1
        smaller = collections.defaultdict(list)
        for t in group:
            if sum(2 * have[at] > total for at in enumerate(t)) >= 0.7 * len(t):
                template[t] = id(group), group[0]
            elif anchors := [(have[at], -at[0], at) for at in enumerate(t) if have[at] < total and kinds[at] > 1]:
                smaller[max(anchors)[2]].append(t)
        open_ += smaller.values()
    members = collections.defaultdict(list)
    for t, found in places.items():
        members[template.get(t, t)] += found
    gone = collections.defaultdict(set)
    for found in members.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                if (i, k) != min(found):
                    gone[i].add(k)
    return gone


def test_line_templates_against_brute_force(spark, docs, rows, nothing):
    rng = random.Random(12)
    shared = [words(rng, n) for n in (6, 9, 60)]
    more = []
    for k in range(80):
        parts = [words(rng, rng.randint(1, 12)) for _ in range(3)]
        parts.insert(1, rng.choice(shared))
        parts.append(f"Page {k} of 99 in the long report by {words(rng, 1)}")
        if k % 9 == 0:
            w = shared[2].split()
            w[20] = words(rng, 1)
            parts.append(" ".join(w))
        more.append((2000 + k, "\n".join(parts)))
    every = docs.select("doc_id", "text", "n", "line").unionByName(spark.createDataFrame([(i, t, 1, "l") for i, t in more], "doc_id long, text string, n long, line string"))
    plain = [*rows, *more]
    gone = brute_lines(plain)
    out = linededup.dedup_lines(every)
    assert out.columns == [*every.columns, "n_lines", "n_dropped"]
    want = bag()
    for i, t in plain:
        lines = None if t is None else t.split("\n")
        stay = None if t is None else [x for k, x in enumerate(lines) if k not in gone.get(i, ())]
        want[(i, None if t is None else "\n".join(stay), 0 if t is None else len(lines), 0 if t is None else len(gone.get(i, ())))] += 1
    assert bag((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert sum(map(len, gone.values())) > 150
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_templates_of_mixed_leaves_against_brute_force(spark):
    rng = random.Random(77)
    rows = [(rng.randrange(40), "\n".join(" ".join(["a", "b", "c", "d", *rng.choices(letters, k=9)]) for letters in ("efg", "hi"))) for _ in range(60)]
    gone = brute_lines(rows)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows)


def test_short_lines_that_recur_go(spark):
    import corpus_pipeline as c

    texts = ["Les.\none line of its own here", "Les.\n\nAll rights reserved.\nPage 1", "  All rights\treserved. \n\nPage 22\nanother", "Les.", "a b c d\na b c e", "a b c e\n a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = {0: texts[0], 1: "\nAll rights reserved.\nPage 1", 2: "\nanother", 3: "", 4: texts[4], 5: ""}
    assert {r.doc_id: r.text for r in linededup.op10(df).collect()} == left
    assert {r.doc_id: r.text for r in c.line_dedup(spark, df, "").collect()} == {i: t for i, t in left.items() if t}


def test_two_templates_of_a_leaf_half_each(spark):
    one = "we saw the big {} near a cold river on the way to town"
    two = "we saw the big {} under some very old trees before noon came again"
    assert len(one.split()) == len(two.split())
    rows = [(k, (one if k % 2 else two).format("w" + chr(97 + k // 4) + chr(97 + k // 2 % 2))) for k in range(60)]
    out = linededup.op10(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(r.n_dropped for r in out.collect()) == 58


def test_hot_line_does_not_hide_other_templates(spark):
    one = "we saw the big {} near a cold river on the way to town"
    two = "we saw the big {} under some very old trees before noon came again"
    hot = "we saw the big advertisement printed here one hundred times over for us all"
    rows = [(k, hot) for k in range(30)] + [(100 + k, one.format(f"w{chr(97 + k)}")) for k in range(6)] + [(200 + k, two.format(f"w{chr(97 + k)}")) for k in range(6)]
    rows = [(i, f"{t}\n{'x' * (1 + i)}") for i, t in rows]
    got = {r.doc_id: r.text for r in linededup.op10(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, t in got.items() if "we saw" in t} == {0, 100, 200}


def test_recall_of_planted_templates(spark):
    """Templates with two variable fields, several to a leaf, among lines that do not recur: 90 percent of the repeats go, no clean line does."""
    rng = random.Random(404)
    head, vocabulary = "read more in our", words(rng, 400).split()
    templates = [f"{head} {' '.join(rng.choices(vocabulary, k=10))}".split() for _ in range(40)]
    rows, planted, clean = [], 0, set()
    for i in range(600):
        lines = []
        for t in rng.sample(templates, 2):
            t = list(t)
            for at in rng.sample(range(5, 14), 2):
                t[at] = "".join(rng.choices("klmnopqrstuvwxyz", k=8))
            lines.append(" ".join(t))
            planted += 1
        own = f"{head} {' '.join(''.join(rng.choices('abcdefghijklmnop', k=7)) for _ in range(10))}"
        clean.add(own)
        rows.append((i, "\n".join([*lines, own])))
    out = linededup.op10(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = [x for r in out for x in r.text.split("\n")]
    assert clean <= set(left)
    assert sum(r.n_dropped for r in out) >= 0.9 * (planted - len(templates))


def test_line_dedup_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b\nc", 5, 6, 7), (2, "a b\nd", 8, 9, 10)], "doc_id long, text string, __id long, __GONE long, __n_lines long")
    import corpus_pipeline as c

    assert sorted(map(tuple, c.line_dedup(spark, df, "").collect())) == [(1, "a b\nc", 5, 6, 7), (2, "d", 8, 9, 10)]


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as c

    folder = str(tmp_path)
    # doc_ids of labels that split good from bad
    rng = random.Random(5)
    vocabulary = words(rng, 200).split()
    extra = [(5000 + k, " ".join(rng.choices(vocabulary, k=40)) + ("" if k < 60 else " $$$" * 60), 1, "k", 2, 3, 4, 5, True, "l") for k in range(90)]
    table = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5000 + k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    for name, stage in c.STAGES[:-1]:
        before = seen
        stage(spark, seen, folder).write.parquet(f"{folder}/{name}")
        seen = spark.read.parquet(f"{folder}/{name}")
        assert seen.columns == before.columns
        assert 0 < seen.count() <= before.count()
    kept = {r.doc_id for r in spark.read.parquet(f"{folder}/quality").collect()}
    assert sum(5000 + k in kept for k in range(60)) >= 58
    assert sum(5000 + k in kept for k in range(60, 90)) <= 1
    ids = {r.doc_id for r in seen.collect()}
    packed = c.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    empty = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = 77777")
    for _, stage in c.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_scratch_is_shared(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert F is not None
