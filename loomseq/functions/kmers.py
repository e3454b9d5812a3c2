"""Columns over k-mers of a sequence, upper-cased; a sequence shorter than k has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col, let, ratio, reverse_complement


def windows(s: Column, k: int) -> Column:
    n = F.octet_length(s)
    at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    found = F.transform(at, lambda i: F.substring(s, i, F.lit(k)))
    return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))


def kmers(seq, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be positive")
    return let(F.upper(col(seq)), lambda s: windows(s, k))


def distinct_kmers(seq, k: int) -> Column:
    return F.array_distinct(kmers(seq, k))


def canonical_kmers(seq, k: int) -> Column:
    """Each k-mer or its reverse complement, whichever is first; that is a window of the whole complement, from the other end."""

    def both(p: Column) -> Column:
        n = F.size(p["other"])
        return F.transform(p["own"], lambda x, i: F.least(x, F.get(p["other"], n - 1 - i)))

    s = F.upper(col(seq))
    return let(F.struct(kmers(s, k).alias("own"), kmers(reverse_complement(s), k).alias("other")), both)


def sketch_hash(kmer: Column, method: str = "xxhash64") -> Column:
    """A k-mer's sketch hash; md5_60 (60 bits, never negative) can be had in other engines too."""
    if method == "md5_60":
        return F.conv(F.substring(F.md5(kmer.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.xxhash64(kmer)


def minhash_sketch(seq, k: int, num_hashes: int, method: str = "xxhash64") -> Column:
    """The num_hashes least hashes of the distinct k-mers, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(kmers(seq, k), lambda x: sketch_hash(x, method)))), 1, num_hashes)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    counted = let(both, lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("n"), (F.size(x["a"]) + F.size(x["b"])).alias("all")))
    return let(counted, lambda x: ratio(x["n"], x["all"] - x["n"]))


def jaccard_similarity(a, b, k: int) -> Column:
    return jaccard(kmers(a, k), kmers(b, k))


def containment_index(a, b, k: int) -> Column:
    x, y = kmers(a, k), kmers(b, k)
    both = F.struct(x.alias("a"), y.alias("b"))
    return let(both, lambda z: ratio(F.size(F.array_intersect(z["a"], z["b"])), F.size(F.array_distinct(z["a"]))))


def mash_from_jaccard(j: Column, k: int, formula: str = "plain") -> Column:
    """-ln(J)/k, or -ln(2J/(1+J))/k with formula='standard'; in [0, 1], and 1 for J = 0."""
    x = 2 * j / (1 + j) if formula == "standard" else j
    safe = F.when(j > 0, x).otherwise(F.lit(1.0))
    return F.when(j > 0, F.least(F.lit(1.0), -F.log(safe) / k + 0.0)).otherwise(F.lit(1.0))


def mash_distance(a, b, k: int, size: int, method: str = "xxhash64", formula: str = "plain") -> Column:
    j = jaccard(minhash_sketch(a, k, size, method), minhash_sketch(b, k, size, method))
    return let(j, lambda x: mash_from_jaccard(x, k, formula))


def ani_approximate(a, b, k: int, size: int, method: str = "xxhash64") -> Column:

    def ani(j: Column) -> Column:
        safe = F.when(j > 0, 2 * j / (1 + j)).otherwise(F.lit(1.0))
        return F.when(j > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.log(safe) / k))).otherwise(F.lit(0.0))

    return let(jaccard(minhash_sketch(a, k, size, method), minhash_sketch(b, k, size, method)), ani)


def genome_sketch(seq, k: int, size: int, method: str = "xxhash64") -> Column:
    return minhash_sketch(seq, k, size, method)


def contamination_screen(seq, host: Column, k: int, size: int, method: str = "xxhash64") -> Column:
    """The part of a sketch that is among the host's hashes."""
    return let(minhash_sketch(seq, k, size, method), lambda own: ratio(F.size(F.array_intersect(own, host)), F.size(own)))


def syncmers(seq, k: int, s: int) -> Column:
    """array of struct(pos, kmer): k-mers whose first or last s-mer is their least; all with s = 0."""
    if s >= k:
        raise ValueError("s must be below k")
    every = F.transform(kmers(seq, k), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("kmer")))
    if s == 0:
        return every

    def closed(x: Column) -> Column:
        least = F.array_min(windows(x["kmer"], s))
        return (F.left(x["kmer"], F.lit(s)) == least) | (F.right(x["kmer"], F.lit(s)) == least)

    return F.filter(every, closed)


def minimizers(seq, k: int, w: int) -> Column:
    """array of struct(pos, kmer): the least k-mer of each w in a row, leftmost first, where its text changes.

    A sequence with fewer than w k-mers is one window.
    """

    def least(every: Column) -> Column:
        # the least of 1, 2, 4, ... in a row, each from two of the one before
        found, span, width = every, 1, F.least(F.lit(w), F.size(every))
        while 2 * span <= w:
            found = let(found, lambda x: F.transform(x, lambda y, i: F.least(y, F.get(x, i + span))))
            span *= 2
        last = F.greatest(F.size(every) - (w - 1), F.lit(1))
        return let(found, lambda x: F.transform(F.slice(x, F.lit(1), last), lambda y, i: F.least(y, F.get(x, i + F.greatest(width - span, F.lit(0))))))

    def changed(found: Column) -> Column:
        kept = F.filter(found, lambda x, i: x.isNotNull() & ((i == 0) | (x["kmer"] != F.get(found, i - 1)["kmer"])))
        return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["kmer"].alias("kmer")))

    every = F.transform(kmers(seq, k), lambda x, i: F.struct(x.alias("kmer"), i.cast("long").alias("pos")))
    return let(let(every, least), changed)
