"""Columns over pairs of sequences, and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col


def hamming_distance(a, b, on_error: str = "raise") -> Column:
    """Places that differ; unequal lengths are an error, or null with on_error='null'."""
    x, y = col(a), col(b)
    apart = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda d: d)).cast("long")
    bad = F.lit(None).cast("long") if on_error == "null" else F.raise_error(F.lit("sequences of unequal length")).cast("long")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("long")).when(F.octet_length(x) == F.octet_length(y), apart).otherwise(bad)


def levenshtein_distance(a, b) -> Column:
    return F.levenshtein(col(a), col(b)).cast("long")


def parse_cigar(cigar) -> Column:
    """array of struct(op, len); a missing or zero length is 1."""
    parts = F.regexp_extract_all(col(cigar), F.lit(r"([0-9]*)([^0-9])"), F.lit(0))
    length = lambda t: F.greatest(F.lit(1).cast("long"), F.coalesce(F.left(t, F.length(t) - 1).try_cast("long"), F.lit(1).cast("long")))
    return F.transform(parts, lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), length(t).alias("len")))


def cigar_sum(ops: Column, which: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*which)), F.lit(0).cast("long"), lambda n, o: n + o["len"])


#: The fields of cigar_stats and the operations they add up.
CIGAR_FIELDS = {"matches": "M=", "mismatches": "X", "insertions": "I", "deletions": "D", "soft_clips": "S", "hard_clips": "H"}


def cigar_stats(cigar) -> Column:
    ops = parse_cigar(cigar)
    return F.struct(*[cigar_sum(ops, which).alias(n) for n, which in CIGAR_FIELDS.items()])


def primer_match(seq, primer, max_mismatch: int, metric: str = "levenshtein") -> Column:
    """array of struct(pos, dist): windows as long as the primer and at most max_mismatch edits from it."""
    s, p = col(seq), primer if isinstance(primer, Column) else F.lit(primer)
    last = F.octet_length(s) - F.octet_length(p) + 1
    part = lambda i: F.substring(s, i, F.octet_length(p))

    def apart(x: Column) -> Column:
        if metric == "hamming":
            return hamming_distance(x, p)
        near = F.levenshtein(x, p, max_mismatch)  # -1 beyond that
        return F.when(near >= 0, near.cast("long")).otherwise(max_mismatch + 1)

    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct((i - 1).cast("long").alias("pos"), apart(part(i)).alias("dist")))
    kept = F.filter(found, lambda x: x["dist"] <= max_mismatch)
    return F.when(last >= 1, kept).otherwise(F.slice(kept, 1, 0))


def preprocess_16s(seq, forward: str, reverse: str, max_mismatch: int) -> Column:
    """The part after the first forward-primer hit up to the first hit of the reverse primer's complement."""
    from .sequence import reverse_complement

    s = col(seq)
    start = F.get(primer_match(s, forward, max_mismatch), F.lit(0))["pos"] + len(forward)
    end = F.get(primer_match(s, reverse_complement(F.lit(reverse)), max_mismatch), F.lit(0))["pos"]
    return F.when(start < end, F.substring(s, (start + 1).cast("int"), (end - start).cast("int")))


def splice_junctions(cigar, pos) -> Column:
    """array of struct(junction, start, end): one for each N operation."""
    start = F.struct(col(pos).cast("long").alias("at"), F.array().cast("array<struct<junction:string,start:bigint,end:bigint>>").alias("found"))

    def step(a: Column, o: Column) -> Column:
        end = a["at"] + o["len"]
        one = F.struct(F.concat(a["at"].cast("string"), F.lit("-"), end.cast("string")).alias("junction"), a["at"].alias("start"), end.alias("end"))
        found = F.when(o["op"] == "N", F.concat(a["found"], F.array(one))).otherwise(a["found"])
        return F.struct(F.when(o["op"].isin(*"M=XDN"), end).otherwise(a["at"]).alias("at"), found.alias("found"))

    return F.aggregate(parse_cigar(cigar), start, step, lambda a: a["found"])


def detect_intron_retention(cigar, pos, intron_start, intron_end) -> Column:
    """Whether one M, = or X block covers [intron_start, intron_end]."""
    start = F.struct(col(pos).cast("long").alias("at"), F.lit(False).alias("hit"))

    def step(a: Column, o: Column) -> Column:
        end = a["at"] + o["len"]
        hit = o["op"].isin(*"M=X") & (a["at"] <= F.lit(intron_start)) & (end >= F.lit(intron_end))
        return F.struct(F.when(o["op"].isin(*"M=XDN"), end).otherwise(a["at"]).alias("at"), (a["hit"] | hit).alias("hit"))

    return F.aggregate(parse_cigar(cigar), start, step, lambda a: a["hit"])
