"""Columns over nucleotide sequences. Lengths are bytes; text is meant to be ASCII."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T, C, A, G.
CODE_BASES = "TCAG"
CODE_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Codons that end a reading frame, and the one that starts it.
STOPS, START = ("TAA", "TAG", "TGA"), "ATG"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def let(value: Column, body) -> Column:
    """body(value), with value computed once though body uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def seq_length(seq) -> Column:
    return F.octet_length(col(seq)).cast("long")


def _without(seq: Column, chars: str) -> Column:
    return F.octet_length(F.translate(seq, chars, ""))


def count_char(seq, char: str) -> Column:
    s = F.upper(col(seq))
    return (F.octet_length(s) - _without(s, char)).cast("long")


def gc_content(seq) -> Column:
    s = F.upper(col(seq))
    n = F.octet_length(s)
    return ratio(n - _without(s, "GC"), n)


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ATGCNatgcnUu", "TACGNTACGNAA"))


def base_counts(seq) -> Column:
    """array of struct(base, n), by base; every character counts, upper-cased."""

    def counts(chars: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(chars)), lambda b: F.struct(b.alias("base"), F.size(F.filter(chars, lambda c: c == b)).cast("long").alias("n")))

    return let(F.filter(F.split(F.upper(col(seq)), ""), lambda c: c != ""), counts)


def count_bases(seq) -> Column:
    """map of base to count."""
    return F.map_from_entries(base_counts(seq))


def is_valid_dna(seq) -> Column:
    return col(seq).rlike(r"^[ATGCNatgcn]+\z")


def is_valid_rna(seq) -> Column:
    return col(seq).rlike(r"^[AUGCNaugcn]+\z")


def transcribe(seq) -> Column:
    return F.translate(col(seq), "Tt", "Uu")


def reverse_transcribe(seq) -> Column:
    return F.translate(col(seq), "Uu", "Tt")


def count_n(seq) -> Column:
    return count_char(seq, "N")


def normalize_seq(seq) -> Column:
    return F.upper(col(seq))


def seq_slice(seq, start, end, on_error: str = "raise") -> Column:
    """The part [start, end) from 0; a bad range is an error, or null with on_error='null'."""
    s, a, b = col(seq), F.lit(start), F.lit(end)
    fits = (a >= 0) & (a <= b) & (b <= F.octet_length(s))
    bad = F.lit(None).cast("string") if on_error == "null" else F.raise_error(F.lit("slice outside the sequence")).cast("string")
    return F.when(s.isNull(), F.lit(None).cast("string")).when(fits, F.substring(s, a + 1, b - a)).otherwise(bad)


def concat_seqs(seqs, separator: str = "") -> Column:
    return F.array_join(col(seqs), separator)


def compression_ratio(seq) -> Column:
    """Shannon entropy of the characters in bits, over 2."""
    n = F.octet_length(F.upper(col(seq))).cast("double")
    bits = F.aggregate(base_counts(seq), F.lit(0.0), lambda a, x: a - (x["n"] / n) * F.log2(x["n"] / n))
    return F.when(n == 0, F.lit(0.0)).otherwise(bits / 2)


def is_low_complexity(seq, threshold: float) -> Column:
    n = F.octet_length(col(seq))
    most = F.array_max(F.transform(base_counts(seq), lambda x: x["n"]))
    return F.when(n == 0, True).otherwise(most / n > threshold)


def codon(seq: Column, at: Column) -> Column:
    return F.substring(seq, at + 1, F.lit(3))


def find_orfs(seq) -> Column:
    """array of struct(start, end, orf): each in-frame ATG to its first stop, by frame and start."""

    def orfs(s: Column) -> Column:
        last = F.octet_length(s) - 3

        def orf(i: Column) -> Column:
            stop = F.get(F.filter(F.sequence(i, last, F.lit(3)), lambda j: codon(s, j).isin(*STOPS)), F.lit(0))
            return F.struct((i % 3).alias("frame"), i.cast("long").alias("start"), (stop + 3).cast("long").alias("end"))

        # a short sequence has place 0 only, whose codon is no start
        starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: codon(s, i) == START)
        found = F.sort_array(F.filter(F.transform(starts, orf), lambda x: x["end"].isNotNull()))
        part = lambda x: F.substring(s, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), part(x).alias("orf")))

    return let(F.upper(col(seq)), orfs)


def translate(seq) -> Column:
    """Residues of the first frame up to and with the first stop; X for unknown codons."""
    code = F.create_map(*[F.lit(x) for c, r in zip(product(CODE_BASES, repeat=3), CODE_RESIDUES) for x in ("".join(c), r)])
    codons = F.regexp_extract_all(F.upper(col(seq)), F.lit("(?s).{3}"), F.lit(0))
    whole = F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")
    return F.regexp_extract(whole, r"^[^*]*\*?", 0)


def seq_stats(seq) -> Column:
    parts = {"length": seq_length(seq), "gc_content": gc_content(seq), "n_count": count_n(seq), "is_valid_dna": is_valid_dna(seq)}
    parts |= {f"{b.lower()}_count": count_char(seq, b) for b in "ATGC"}
    return F.struct(*[c.alias(n) for n, c in parts.items()])
