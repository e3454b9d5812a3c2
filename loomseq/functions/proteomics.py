"""Columns over peptides and proteins (upper-case residues)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col, let

#: Monoisotopic residue masses, with water and the proton.
MONOISOTOPIC = {
    "G": 57.02146, "A": 71.03711, "V": 99.06841, "L": 113.08406, "I": 113.08406, "P": 97.05276, "F": 147.06841,
    "W": 186.07931, "M": 131.04049, "S": 87.03203, "T": 101.04768, "C": 103.00919, "Y": 163.06333, "H": 137.05891,
    "D": 115.02694, "E": 129.04259, "N": 114.04293, "Q": 128.05858, "K": 128.09496, "R": 156.10111,
}
WATER, PROTON = 18.01056, 1.007276
#: Average residue masses, with water.
AVERAGE = {
    "G": 57.052, "A": 71.079, "V": 99.133, "L": 113.160, "I": 113.160, "P": 97.117, "F": 147.177, "W": 186.213,
    "M": 131.199, "S": 87.078, "T": 101.105, "C": 103.144, "Y": 163.176, "H": 137.142, "D": 115.089, "E": 129.116,
    "N": 114.104, "Q": 128.131, "K": 128.174, "R": 156.188,
}
AVERAGE_WATER = 18.015


def _mass(seq, masses: dict[str, float], start: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in masses.items() for x in pair])
    return F.aggregate(F.split(col(seq), ""), F.lit(start), lambda a, c: a + F.coalesce(F.try_element_at(table, c), F.lit(0.0)))


def peptide_mass(seq) -> Column:
    return _mass(seq, MONOISOTOPIC, WATER)


def protein_molecular_weight(seq) -> Column:
    return _mass(seq, AVERAGE, AVERAGE_WATER)


def peptide_mz(seq, charge) -> Column:
    z = F.lit(charge)
    return F.when(z == 0, F.lit(float("inf"))).otherwise((peptide_mass(seq) + z * PROTON) / F.when(z == 0, 1).otherwise(z))


def _count(seq: Column, residues: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, residues, ""))


def peptide_pi(seq) -> Column:
    """7 plus half of (K, R, H) minus (D, E)."""
    s = col(seq)
    return 7.0 + (_count(s, "KRH") - _count(s, "DE")) * 0.5


def trypsin_digest(seq, max_missed: int) -> Column:
    """array of peptides: cut after K or R but not before P, by missed cleavages and then start."""

    def peptides(s: Column) -> Column:
        n = F.length(s)
        site = lambda i: F.substring(s, i, F.lit(1)).isin("K", "R") & (F.substring(s, i + 1, F.lit(1)) != "P")
        inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & site(i))
        return let(F.concat(F.array(F.lit(0)), inner, F.array(n)), lambda cuts: pieces(s, cuts))

    def pieces(s: Column, cuts: Column) -> Column:
        m = F.size(cuts) - 1

        def spans(k: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: i + k + 1 <= m)
            return F.transform(at, lambda i: F.substring(s, F.get(cuts, i) + 1, F.get(cuts, i + k + 1) - F.get(cuts, i)))

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_missed)), spans)), lambda x: x != "")

    return let(col(seq), peptides)


def enumerate_missed_cleavages(seq) -> Column:
    """array of all substrings, by length and then start: quadratic, for short peptides."""

    def parts(s: Column) -> Column:
        n = F.length(s)
        of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k))
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of))
        return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))

    return let(col(seq), parts)


def generate_decoy(seq) -> Column:
    return F.reverse(col(seq))


def enumerate_modification_sites(seq, residues: list[str]) -> Column:
    """array of places (from 0) of residues that are the first letter of any given one."""
    letters = [r[0] for r in residues if r]
    s = col(seq)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1)).isin(*letters))
    return F.transform(at, lambda i: (i - 1).cast("long"))
