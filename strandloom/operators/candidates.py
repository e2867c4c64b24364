"""Candidate insertions: segments without a parent, of plausible length, in genome order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.sequence import n_fraction, reverse_complement


def candidate_segments(segments: DataFrame, min_length: int = 100, max_length: int = 10000, max_sequences: int | None = None, include_last: bool = False) -> DataFrame:
    """Insertions of segments(genome, seg_index, sequence, start, length, has_parent), numbered from 0 in seg_index order.

    The last segment of a genome is not looked at unless include_last. max_sequences of None or 0 means all; it bounds the
    rows that are numbered, so the sort for numbering is a top-k when it is given.
    """
    rows = segments
    if not include_last:
        last = segments.groupBy("genome").agg(F.max("seg_index").alias("last"))
        rows = rows.join(last, "genome").filter(F.col("seg_index") < F.col("last")).drop("last")
    rows = rows.filter(~F.col("has_parent") & F.col("length").between(min_length, max_length))
    if max_sequences:
        rows = rows.orderBy("seg_index").limit(max_sequences)
    return number(rows, ["genome"], ["seg_index"], "i")


def number(rows: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """0-based numbers in order within keys, without sorting a whole key in one task.

    The first order column (a number) is cut into ranges; ranges are numbered by themselves and the counts of the
    ranges before are added.
    """
    lo_hi = rows.groupBy(*keys).agg(F.min(order[0]).alias("__lo"), F.max(order[0]).alias("__hi"))
    # Without keys the summaries are one row and ``buckets`` rows at most, so they are broadcast; with keys they grow with these.
    ranged = rows.join(lo_hi, keys) if keys else rows.crossJoin(F.broadcast(lo_hi))
    width = F.greatest(F.lit(1.0), (F.col("__hi") - F.col("__lo") + 1) / F.lit(float(buckets)))
    ranged = ranged.withColumn("__range", F.floor((F.col(order[0]) - F.col("__lo")) / width).cast("int")).drop("__lo", "__hi")
    ranged = ranged.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)).cast("long"))
    sizes = ranged.groupBy(*keys, "__range").agg(F.max("__n").alias("__size"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__before", F.sum("__size").over(w.orderBy("__range")) - F.col("__size")).drop("__size")
    return ranged.join(sizes if keys else F.broadcast(sizes), [*keys, "__range"]).withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__range", "__n", "__before")


def both_strands(candidates: DataFrame, bases: str = "seq", name: str = "name") -> DataFrame:
    """Candidates as they are, and reverse-complemented with _comp after their names."""
    reverse = candidates.withColumn(bases, reverse_complement(bases)).withColumn(name, F.concat(F.col(name).cast("string"), F.lit("_comp"))).withColumn("strand", F.lit("-"))
    return candidates.withColumn(name, F.col(name).cast("string")).withColumn("strand", F.lit("+")).unionByName(reverse)


def filter_n(sequences: DataFrame, most: float = 0.2, seq: str = "seq") -> DataFrame:
    """Sequences with a share of N strictly below ``most``; empty ones go."""
    return sequences.filter(n_fraction(seq) < most)


def mask_tandem_repeats(sequences: DataFrame, unit: int = 6, copies: int = 5, seq: str = "seq") -> DataFrame:
    """Runs of ``copies`` or more equal units of up to ``unit`` bases become N, one for each base.

    An approximation of a tandem-repeat masker: only exact repeats count.
    """
    pattern = r"(?i)([ACGT]{1,%d}?)\1{%d,}" % (unit, copies - 1)
    runs = F.regexp_extract_all(F.col(seq), F.lit(pattern), F.lit(0))
    at = lambda s, r: F.instr(s["rest"], r)
    masked = F.aggregate(
        runs, F.struct(F.col(seq).alias("rest"), F.lit("").alias("done")),
        lambda s, r: F.struct(F.substring(s["rest"], at(s, r) + F.length(r), F.length(s["rest"])).alias("rest"), F.concat(s["done"], F.substring(s["rest"], F.lit(1), at(s, r) - 1), F.repeat(F.lit("N"), F.length(r))).alias("done")),
    )
    return sequences.withColumn(seq, F.concat(masked["done"], masked["rest"]))
