"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log weight is the log likelihood ratio of two generative models of its n-grams, as in "Data Selection for Language
Models via Importance Resampling" (Xie et al., 2023): one counted over the labelled good documents, one over all
documents.  N-grams are words and punctuation runs, and pairs of neighbours, hashed to a fixed number of buckets.  The
k documents with the largest log weight plus Gumbel noise are a sample without replacement in proportion to the weights.

Where k is not given it follows from the labels: it is the number of documents above the weight that
separates labelled good from bad ones at the least cost, where losing a good one costs more than keeping a bad one.
Labelled documents are weighed by a model that has not counted their own half of the labels, so that this cut holds for unlabelled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.runtime import Scratch, free_name, ship, small_batches

BUCKETS = 1 << 16
MAX_LABELS = 20_000  # labelled documents that the target model counts at most (those of lowest hash)
SMOOTH = 10.0  # n-grams that the target model has of every bucket beside those counted, in the raw model's proportion
TEMPERATURE = 1.0  # log weight that one unit of Gumbel noise is worth; 1 samples in proportion to the weights
COST = 20.0  # of losing a good document, against keeping a bad one
SEED = 20240607
BINS = 4096

_WORDS = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) >= 200_000:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of a whole text's n-grams; a null text has none."""
    words = _WORDS.findall(text or "")
    u = np.fromiter(map(_hash, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        two = ((u[:-1] * _MIX) ^ (u[1:] + (u[:-1] >> np.uint64(7)))) * _MIX
    return (np.concatenate([u, two]) >> np.uint64(20)).astype(np.int64) % BUCKETS


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams per bucket: of all documents, and of the good ones of each half of the labels."""
    total = np.zeros((BUCKETS, 3), np.int64)
    for pdf in batches:
        for column, rows in ((0, pdf), (1, pdf[pdf["fold"] == 0]), (2, pdf[pdf["fold"] == 1])):
            rows = rows if column == 0 else rows[rows["quality"] == 1]
            if len(rows):
                total[:, column] += np.bincount(np.concatenate([ngram_buckets(t) for t in rows["text"]]), minlength=BUCKETS)
    some = np.nonzero(total[:, 0])[0]
    yield pd.DataFrame({"bucket": some, "raw": total[some, 0], "half0": total[some, 1], "half1": total[some, 2]})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) per bucket; 0 where nothing was counted or there is no target.

    A bucket's rate in the target, relative to raw text, is its count over the expected one, both with SMOOTH added:
    a rare n-gram weighs little until it has been seen often enough.
    """
    if not target.sum():
        return np.zeros(len(raw))
    p = raw / max(1, raw.sum())
    rate = (target + SMOOTH) / (p * target.sum() + SMOOTH)
    return np.where(raw > 0, np.log(rate) - np.log((p * rate).sum()), 0.0)


def weight(text: str | None, ratios: np.ndarray) -> tuple[int, float]:
    """Number of n-grams, and the log likelihood ratio: the sum of theirs."""
    b = ngram_buckets(text)
    return len(b), float(ratios[b].sum())


class Model:
    """Log ratios of the whole target, and of the target without either half of the labels."""

    def __init__(self, raw: np.ndarray, half0: np.ndarray, half1: np.ndarray):
        self.all, self.without = log_ratios(raw, half0 + half1), (log_ratios(raw, half1), log_ratios(raw, half0))
        self.empty = not (half0.sum() + half1.sum())

    def weigh(self, name: str = "text", fold: str = "fold") -> Column:
        """struct(n, weight) of the text; fold (null: unlabelled) says which half must not count."""
        everything, without = self.all, self.without

        @F.pandas_udf("struct<n long, weight double>")
        def weigh(text: pd.Series, fold: pd.Series) -> pd.DataFrame:
            rows = [weight(t, everything if pd.isna(f) else without[int(f)]) for t, f in zip(text, fold, strict=True)]
            return pd.DataFrame(rows, columns=["n", "weight"])

        return weigh(F.col(name), F.col(fold))


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int, quality: str = "quality", fold: str = "fold") -> DataFrame:
    """docs with quality and fold of its label; the labels joined are at most max_labels rows, so they are broadcast."""
    id_ = free_name(docs, "id")
    one = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias(id_)).agg(F.min("quality").cast("int").alias(quality))
    one = one.orderBy(F.xxhash64(id_), id_).limit(max_labels).withColumn(fold, F.pmod(F.xxhash64(id_, F.lit(1)), F.lit(2)).cast("int"))
    return docs.join(F.broadcast(one), docs["doc_id"].cast("long") == F.col(id_), "left").drop(id_)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise that follows from the doc_id alone, so that a repeated task draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(seed)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, by histograms of fixed size instead of a sort."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return 0.0
    while True:
        width = (hi - lo) / BINS
        if not width > 0 or lo + width == lo:
            return lo
        inside = values.filter(F.col(column).between(lo, hi))
        at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1))
        bins = {r["at"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        above = values.filter(F.col(column) > F.lit(hi)).count()
        for b in sorted(bins, reverse=True):
            n, low, high = bins[b]
            if above + n >= k:
                break
            above += n
        if low == high:
            return low
        lo, hi = low, high


def cut_weight(scores: DataFrame) -> float | None:
    """The weight that parts labelled good from bad at the least cost; None without both kinds."""
    known = scores.filter("fold is not null")
    lo, hi = known.agg(F.min(F.asinh("weight")), F.max(F.asinh("weight"))).first()
    if lo is None:
        return None
    width = max((hi - lo) / BINS, 1e-12)  # narrow bins where weights are small
    rows = known.groupBy(F.least(F.floor((F.asinh("weight") - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1)).alias("b"), "quality").count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in rows:
        (good if r["quality"] == 1 else bad)[int(r["b"])] += r["count"]
    if not good.sum() or not bad.sum():
        return None
    lost = np.concatenate([[0], np.cumsum(good)[:-1]])  # good ones in lower bins
    kept = bad.sum() - np.concatenate([[0], np.cumsum(bad)[:-1]])
    cost = COST * lost + kept
    first = int(np.argmin(cost))  # the middle of the first stretch of least cost, so that neither kind is at its edge
    more = np.nonzero(cost[first:] != cost[first])[0]
    return float(np.sinh(lo + width * (first + (int(more[0]) - 1 if len(more) else len(cost) - 1 - first) / 2)))


class Selection:
    """Fitted on docs and labels: the model, k and the key of the k-th document."""

    def __init__(self, docs: DataFrame, labels: DataFrame, *, k: int | None = None, temperature: float = TEMPERATURE, max_labels: int = MAX_LABELS, seed: int = SEED):
        self.spark, self.labels, self.max_labels, self.seed, self.temperature = docs.sparkSession, labels, max_labels, seed, temperature
        ship(self.spark)
        scratch = Scratch(self.spark, "quality")
        rows = labelled(docs.select("doc_id", "text"), labels, max_labels)
        counted = rows.select("text", "quality", "fold").mapInPandas(_count, "bucket long, raw long, half0 long, half1 long")
        with small_batches(self.spark):
            table = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "half0", "half1"))).toPandas()  # BUCKETS rows at most
        counts = np.zeros((BUCKETS, 3))
        counts[table["bucket"].to_numpy(np.int64)] = table[["raw", "half0", "half1"]].to_numpy(np.float64)
        self.model = Model(*counts.T)
        scored = rows.withColumn("w", self.model.weigh("text", "fold")).select("doc_id", "w.n", "w.weight", self._key(F.col("w.weight")).alias("key"), "quality", "fold")
        self.scores = scratch.save(scored, "scores")
        if k is None:
            cut = None if self.model.empty else cut_weight(self.scores)
            k = None if cut is None else self.scores.filter(F.col("weight") >= F.lit(cut)).count()
        self.k = k
        self.least = kth_largest(self.scores, "key", k) if k else None

    def _key(self, weight: Column) -> Column:
        return weight / F.lit(self.temperature) + gumbel(F.col("doc_id"), self.seed)

    def kept(self, key: Column) -> Column:
        return F.lit(self.k is None) if self.least is None else key >= F.lit(self.least)

    def filter(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are kept, with their columns. Weights are computed again, which moves no text between machines."""
        names = [free_name(docs, x) for x in ("quality", "fold", "w")]
        rows = labelled(docs, self.labels, self.max_labels, *names[:2]).withColumn(names[2], self.model.weigh("text", names[1]))
        return rows.filter(self.kept(self._key(F.col(names[2])["weight"]))).select(*docs.columns)


def select_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_ngrams, weight, key, kept.

    ``k`` says how many documents to sample (0: none; more than there are: all); without it the labels do. Null and empty texts weigh 0. Rows tied
    with the k-th key are kept too, so repeated rows share their fate; rows without a doc_id draw the noise of doc_id 0.
    Labels without documents, with null parts, or beyond ``max_labels`` do not count; of several labels of a document the
    lowest quality does. Without k, and without good or without bad labels, nothing is rejected. An empty table gives an empty table.
    """
    s = Selection(docs, labels, **options)
    return s.scores.select("doc_id", F.col("n").alias("n_ngrams"), "weight", "key", s.kept(F.col("key")).alias("kept"))
