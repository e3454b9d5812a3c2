"""Columns over alignment records, intervals, reads and closed-form statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col

#: Names of the twelve flag bits of an alignment record, from bit 0.
FLAG_BITS = (
    "read_paired", "read_mapped_in_pair", "read_unmapped", "mate_unmapped", "read_reverse", "mate_reverse",
    "first_in_pair", "second_in_pair", "not_primary", "read_fails_qc", "read_is_duplicate", "supplementary",
)


def has_flag(flag, bit: int) -> Column:
    return col(flag).cast("int").bitwiseAND(F.lit(bit)) != 0


def parse_flag(flag) -> Column:
    return F.struct(*[has_flag(flag, 1 << i).alias(n) for i, n in enumerate(FLAG_BITS)])


def phred(qual) -> Column:
    """array of Phred scores of a quality string (offset 33)."""
    return F.transform(F.filter(F.split(col(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def quality_sum(qual) -> Column:
    """The sum of a quality string's Phred scores, as a long."""
    q = col(qual)
    return F.aggregate(F.split(q, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) - 33 * F.octet_length(q)


def quality_at_least(qual, score: int) -> Column:
    """How many of a quality string's scores are so high."""
    low = "".join(chr(33 + s) for s in range(score))
    return F.octet_length(F.translate(col(qual), low, ""))


def mean_quality_of(qual) -> Column:
    """The mean Phred score of a quality string, NaN for an empty one."""
    n = F.octet_length(col(qual))
    return F.when(n == 0, F.lit(float("nan"))).otherwise(quality_sum(qual).cast("double") / F.greatest(n, F.lit(1)))


def mean_quality(scores: Column) -> Column:
    """NaN for no scores."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, q: a + q)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(total.cast("double") / F.greatest(n, F.lit(1)))


def intervals_overlap(chrom1, start1, end1, chrom2, start2, end2) -> Column:
    return (col(chrom1) == col(chrom2)) & (col(start1) < col(end2)) & (col(start2) < col(end1))


def overlap_length(chrom1, start1, end1, chrom2, start2, end2) -> Column:
    common = F.least(col(end1), col(end2)) - F.greatest(col(start1), col(start2))
    return F.when(col(chrom1) == col(chrom2), F.greatest(F.lit(0).cast("long"), common)).otherwise(F.lit(0).cast("long"))


def interval_length(start, end) -> Column:
    return F.abs(col(end) - col(start))


def gap_distance(start1, end1, start2, end2) -> Column:
    """0 for intervals that touch or overlap, else what lies between them."""
    return F.greatest(F.lit(0).cast("long"), col(start2) - col(end1), col(start1) - col(end2))


def tss_distance(read_chrom, read_pos, gene_chrom, gene_start, gene_end, strand) -> Column:
    tss = F.when(col(strand) == "+", col(gene_start)).otherwise(col(gene_end))
    return F.when(col(read_chrom) == col(gene_chrom), F.abs(col(read_pos) - tss))


def tn5_insertion_site(pos, is_reverse) -> Column:
    return F.when(col(is_reverse), col(pos) - 1).otherwise(col(pos))


def extract_part(read, length: int, start: int) -> Column:
    """The bytes [start, start + length), null past the end: barcodes and UMIs."""
    r = col(read)
    return F.when(F.octet_length(r) >= start + length, F.substring(r, start + 1, length))


def extract_barcode(read, barcode_len: int, barcode_start: int = 0) -> Column:
    return extract_part(read, barcode_len, barcode_start)


def extract_umi(read, umi_len: int, umi_start: int = 0) -> Column:
    return extract_part(read, umi_len, umi_start)


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def hypergeometric_test(k, n, k_total, n_total) -> Column:
    """1 up to the expected count, else the normal density at k's z-score (a density, no tail)."""
    k, n, big_k, big_n = (col(x).cast("double") for x in (k, n, k_total, n_total))
    mean = n * big_k / big_n
    var = n * (big_k / big_n) * (1 - big_k / big_n) * (big_n - n) / F.when(big_n == 1, F.lit(float("nan"))).otherwise(big_n - 1)
    z = (k - mean) / F.when(var == 0, F.lit(float("nan"))).otherwise(F.sqrt(var))
    return F.when(k <= mean, F.lit(1.0)).when(var == 0, F.lit(0.0)).otherwise(normal_density(z))


def fisher_exact(a, b, c, d) -> Column:
    """The normal density at ln(odds ratio) over its error; NaN if a or d is 0."""
    a, b, c, d = (col(x).cast("double") for x in (a, b, c, d))
    safe = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    z = F.log(safe(a) * safe(d) / (safe(b) * safe(c))) / F.sqrt(1 / safe(a) + 1 / safe(b) + 1 / safe(c) + 1 / safe(d))
    edge = F.when((a == 0) | (d == 0), F.lit(float("nan"))).when((b == 0) | (c == 0), normal_density(F.lit(0.0)))
    return F.coalesce(edge, normal_density(z))
