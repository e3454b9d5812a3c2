"""Column functions against values worked out from their rules."""

import math

import pytest
from pyspark.sql import functions as F

from loomseq.functions import alignment as A
from loomseq.functions import kmers as K
from loomseq.functions import proteomics as P
from loomseq.functions import records as R
from loomseq.functions import sequence as S

READ = "ATGCGCATATGCGCGATATAGCTAGCTAGCTAGCTAGCN"


@pytest.fixture(scope="module")
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("x")).first().x

    return of


def lit(s):
    return F.lit(s)


def test_sequences(value):
    assert value(S.gc_content(lit(READ))) == pytest.approx(19 / 39)
    assert value(S.gc_content(lit(""))) == 0
    assert value(S.reverse_complement(lit(READ))) == "NGCTAGCTAGCTAGCTAGCTATATCGCGCATATGCGCAT"
    assert value(S.count_bases(lit(READ))) == {"A": 10, "C": 9, "G": 10, "N": 1, "T": 9}
    assert value(S.compression_ratio(lit(READ))) == pytest.approx(1.0594035206656258)
    assert value(S.compression_ratio(lit(""))) == 0
    assert value(S.is_low_complexity(lit("AAAAAAACCCCCC"), 0.6)) is False
    assert value(S.is_low_complexity(lit(""), 0.6)) is True
    assert value(S.find_orfs(lit("ATGAAATTTAAACCCGGGATGCCC"))) == []
    assert [tuple(x) for x in value(S.find_orfs(lit("ATGCCCTTTGGGAAATGA")))] == [(0, 18, "ATGCCCTTTGGGAAATGA")]
    assert value(S.find_orfs(lit("AT"))) == []
    assert value(S.translate(lit("ATGAAATTTAAACCC"))) == "MKFKP"
    assert value(S.translate(lit("ATGTAAATG"))) == "M*"
    assert value(S.translate(lit("ATNCC"))) == "X"
    assert value(S.is_valid_dna(lit("ATG\n"))) is False
    assert value(S.is_valid_dna(lit(""))) is False
    assert value(S.seq_slice(lit("ACGT"), 1, 3)) == "CG"
    assert value(S.seq_slice(lit("ACGT"), 3, 9, "null")) is None
    with pytest.raises(Exception, match="slice outside"):
        value(S.seq_slice(lit("ACGT"), 3, 9))


def test_kmers(value):
    s = lit("ATGCGCATGCGCATGCGC")
    assert [tuple(x) for x in value(K.minimizers(s, 3, 4))] == [(0, "ATG"), (3, "CGC"), (5, "CAT"), (6, "ATG"), (9, "CGC"), (11, "CAT"), (12, "ATG")]
    assert len(set(value(K.canonical_kmers(s, 3)))) == 3
    assert value(K.kmers(lit("AC"), 3)) == []
    assert value(K.minimizers(lit("AC"), 3, 4)) == []
    assert value(K.jaccard_similarity(lit("ATGC"), lit("ATGG"), 3)) == pytest.approx(1 / 3)
    assert value(K.mash_from_jaccard(lit(4 / 9), 3)) == pytest.approx(0.27031007207210955)
    assert value(K.mash_distance(lit("ACGT"), lit("ACGT"), 3, 9)) == 0
    assert value(K.mash_distance(lit("AAAA"), lit("CCCC"), 3, 9)) == 1
    assert len(value(K.syncmers(lit("ACGTACG"), 4, 0))) == 4
    with pytest.raises(ValueError):
        K.kmers(lit("ACGT"), 0)


def test_alignment(value):
    assert value(A.hamming_distance(lit("ATGC"), lit("ATCC"))) == 1
    assert value(A.hamming_distance(lit("ATGC"), lit("AT"), "null")) is None
    assert value(A.levenshtein_distance(lit("kitten"), lit("sitting"))) == 3
    assert [tuple(x) for x in value(A.parse_cigar(lit("10M2I5M3D8M")))] == [("M", 10), ("I", 2), ("M", 5), ("D", 3), ("M", 8)]
    assert [tuple(x) for x in value(A.parse_cigar(lit("*")))] == [("*", 1)]
    assert tuple(value(A.cigar_stats(lit("10M2I5M3D8M")))) == (23, 0, 2, 3, 0, 0)
    assert value(A.primer_match(lit("AC"), "ACGT", 1)) == []
    assert [tuple(x) for x in value(A.splice_junctions(lit("50M100N50M"), F.lit(1000)))] == [("1050-1150", 1050, 1150)]
    assert value(A.detect_intron_retention(lit("100M"), F.lit(1000), 1050, 1150)) is False
    assert value(A.detect_intron_retention(lit("200M"), F.lit(1000), 1050, 1150)) is True


def test_peptides(value):
    assert value(P.trypsin_digest(lit("MPEPTIDEKFRANOTHER"), 2)) == ["MPEPTIDEK", "FR", "ANOTHER", "MPEPTIDEKFR", "FRANOTHER", "MPEPTIDEKFRANOTHER"]
    assert value(P.trypsin_digest(lit(""), 1)) == []
    assert value(P.trypsin_digest(lit("AKPK"), 0)) == ["AKPK"]
    assert value(P.peptide_mass(lit("MPEPTIDE"))) == pytest.approx(930.40043)
    assert value(P.peptide_mz(lit("MPEPTIDE"), 2)) == pytest.approx(466.207491)
    assert value(P.peptide_mz(lit("MPEPTIDE"), 0)) == math.inf
    assert value(P.peptide_pi(lit("MPEPTIDE"))) == 5.5
    assert value(P.enumerate_missed_cleavages(lit("ABC"))) == ["A", "B", "C", "AB", "BC", "ABC"]
    assert value(P.enumerate_missed_cleavages(lit(""))) == []
    assert value(P.enumerate_modification_sites(lit("MPEPTIDEMS"), ["M", "S"])) == [0, 8, 9]


def test_records(value):
    n = lambda x: F.lit(x).cast("long")
    assert value(R.parse_flag(F.lit(0x11)))["read_paired"] is True
    assert value(R.parse_flag(F.lit(0x11)))["read_unmapped"] is False
    assert value(R.overlap_length(lit("a"), n(1), n(5), lit("a"), n(3), n(9))) == 2
    assert value(R.tss_distance(lit("a"), n(1), lit("b"), n(3), n(9), lit("+"))) is None
    assert value(R.extract_part(lit("ACGT"), 3, 2)) is None
    assert value(R.fisher_exact(*[F.lit(x) for x in (10, 2, 3, 15)])) == pytest.approx(0.0008, abs=0.05)
    assert math.isnan(value(R.fisher_exact(*[F.lit(x) for x in (0, 2, 3, 15)])))
    assert value(R.hypergeometric_test(*[F.lit(x) for x in (1, 10, 20, 100)])) == 1
    assert math.isnan(value(R.mean_quality(R.phred(lit("")))))
