"""Scalar functions over sequences, headers and pairs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def subsequence(seq, start, length) -> Column:
    """Bases from a 0-based start."""
    return F.substring(_c(seq), _c(start) + F.lit(1), _c(length))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def n_fraction(seq) -> Column:
    """Share of upper-case N; null for an empty sequence."""
    return F.try_divide(F.regexp_count(_c(seq), F.lit("N")), F.length(_c(seq)))


def proportion_shared(shared, len_i, len_j) -> Column:
    return F.lit(2.0) * _c(shared) / (_c(len_i) + _c(len_j)).cast("double")


def jukes_cantor_shared(p, least: float = 0.25) -> Column:
    """Jukes-Cantor distance of a shared proportion; null at or below the saturation point. Above 1 it is negative."""
    p = _c(p)
    return F.when(p > least, F.lit(-0.75) * F.log(F.lit(1.0) - F.lit(4.0 / 3.0) * (F.lit(1.0) - p)))


def jukes_cantor_different(q) -> Column:
    """The same of a differing proportion; null from 0.75 on."""
    q = _c(q)
    return F.when(q < 0.75, F.lit(-0.75) * F.log(F.lit(1.0) - F.lit(4.0 / 3.0) * q))


def overlap_fraction(s, e, other_s, other_e) -> Column:
    """Bases of the closed interval that the other covers, over its half-open length: it can exceed 1."""
    s, e, os_, oe = map(_c, (s, e, other_s, other_e))
    return F.when((s > oe) | (os_ > e), F.lit(0.0)).otherwise((F.least(e, oe) - F.greatest(s, os_) + F.lit(1)) / (e - s).cast("double"))


def letters(seq) -> Column:
    """A sequence as an array of its letters in upper case."""
    return F.filter(F.split(F.upper(_c(seq)), ""), lambda x: x != "")


LANES = 7  # letters in a 64-bit word: a byte each, whose top bit stays free
LOW, TOP = 0x7F7F7F7F7F7F7F, 0x80808080808080


def packed_letters(seq) -> Column:
    """An ASCII sequence as 64-bit words of seven letters, packed once before any pairing; others raise."""
    words = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / LANES).cast("int") - 1, F.lit(0))), lambda i: F.aggregate(F.slice(x, i * LANES + 1, LANES), F.lit(0).cast("long"), lambda w, c: w * 256 + F.ascii(c)))
    packed = F.get(F.transform(F.array(letters(seq)), words), 0)
    return F.when(F.octet_length(_c(seq)) == F.length(_c(seq)), packed).otherwise(F.raise_error(F.lit("sequences are ASCII")).cast("array<bigint>"))


def packed_differences(a, b) -> Column:
    """Letters that differ between two packed sequences of one length: bytes of a xor b that are not 0."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count((x.bitwiseXOR(y) + F.lit(LOW)).bitwiseAND(F.lit(TOP)))), F.lit(0), lambda s, n: s + n)


def identity_count(a, b) -> Column:
    """Positions of two equally long sequences that agree whatever their case."""
    same = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda x: x)
    return F.size(same)


def header_number(name) -> Column:
    """The integer that a header begins with, or null."""
    return F.regexp_extract(_c(name), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def fields(line) -> Column:
    """White-space separated fields; none for a blank line."""
    return F.filter(F.split(_c(line), r"\s+"), lambda x: x != "")


def edge_score(shared, gap_penalty, min_adjacency) -> Column:
    return _c(shared) - (gap_penalty if isinstance(gap_penalty, Column) else F.lit(gap_penalty)) * _c(min_adjacency)


def block_weight(degree, length) -> Column:
    return _c(degree) * _c(length)


def file_url(path: str) -> str:
    return f"file://{path}"
