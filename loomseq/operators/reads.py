"""Quality control of reads (seq, qual), alignment, variant and annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import has_flag, mean_quality, mean_quality_of, phred, quality_at_least, quality_sum
from ..functions.sequence import gc_content
from .statistics import upper_median


def _zero(c, kind: str = "long"):
    return F.coalesce(c, F.lit(0)).cast(kind)


def _part(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.greatest(b, F.lit(1)))


def fastq_stats(reads: DataFrame) -> DataFrame:
    """One row of twelve sums and rates; rates are over bases of sequences."""
    up = F.upper("seq")
    rows = reads.select(
        F.octet_length("seq").cast("long").alias("n"),
        quality_sum("qual").alias("qs"),
        quality_at_least("qual", 20).alias("q20"),
        quality_at_least("qual", 30).alias("q30"),
        (F.octet_length(up) - F.octet_length(F.translate(up, "GC", ""))).alias("gc"),
        (F.octet_length(up) - F.octet_length(F.translate(up, "N", ""))).alias("ns"),
    )
    s = rows.agg(
        F.count("*").alias("total_reads"),
        _zero(F.sum("n")).alias("total_bases"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_length"),
        _zero(F.min("n")).alias("min_length"),
        _zero(F.max("n")).alias("max_length"),
        _zero(F.sum("qs")).alias("qs"),
        _zero(F.sum("q20")).alias("q20_bases"),
        _zero(F.sum("q30")).alias("q30_bases"),
        _zero(F.sum("gc")).alias("gc"),
        _zero(F.sum("ns")).alias("n_bases"),
    )
    b = F.col("total_bases")
    return s.select(
        "total_reads", "total_bases", "avg_length", "min_length", "max_length", _part(F.col("qs"), b).alias("avg_qual"), "q20_bases", "q30_bases",
        _part(F.col("q20_bases"), b).alias("q20_rate"), _part(F.col("q30_bases"), b).alias("q30_rate"), _part(F.col("gc"), b).alias("gc_content"), "n_bases",
    )


def fastq_filter(reads: DataFrame, min_len: int, min_qual: float) -> DataFrame:
    """Reads that long with that mean quality; one without qualities has NaN, which passes."""
    return reads.where((F.octet_length("seq") >= min_len) & (mean_quality_of("qual") >= min_qual))


def per_base_quality(reads: DataFrame) -> DataFrame:
    """(pos, mean, median): mean and upper median quality at each place, counted by value before the shuffle."""
    rows = reads.select(F.posexplode(phred("qual")).alias("pos", "value"))
    means = rows.groupBy("pos").agg(F.avg("value").alias("mean"))
    return means.join(upper_median(rows, ["pos"]), "pos").select(F.col("pos").cast("long").alias("pos"), "mean", F.col("median").cast("long").alias("median"))


def length_distribution(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.octet_length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))


def gc_distribution(reads: DataFrame, bin_size: float) -> DataFrame:
    """(bin_lo, bin_hi, label, n); labels have one decimal and are for display only."""
    k = F.floor(gc_content("seq") / F.lit(bin_size))
    rows = reads.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    lo, hi = F.col("k") * F.lit(bin_size), F.col("k") * F.lit(bin_size) + F.lit(bin_size)
    return rows.select(lo.alias("bin_lo"), hi.alias("bin_hi"), F.format_string("%.1f-%.1f", lo, hi).alias("label"), "n")


def sliding_window_filter(reads: DataFrame, window: int, min_avg: float) -> DataFrame:
    """One row (total, passed): reads none of whose full windows has a lower mean; a short read is one window."""
    if window < 1:
        raise ValueError("window must be positive")
    rows = reads.select(phred("qual").alias("q"))
    n = F.size("q")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    full = F.forall(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: total(F.slice("q", i, F.lit(window))) / float(window) >= min_avg)
    passed = F.when(n < window, mean_quality(F.col("q")) >= min_avg).otherwise(full)
    return rows.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))


def sam_stats(sam: DataFrame) -> DataFrame:
    mapped = ~has_flag("flag", 0x4)
    placed = mapped & (F.col("rname") != "*")
    return sam.agg(
        F.count("*").alias("total_reads"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(~mapped).alias("unmapped"),
        F.count_if(has_flag("flag", 0x1)).alias("paired"),
        F.count_if(has_flag("flag", 0x400)).alias("duplicates"),
        F.count_if(~has_flag("flag", 0x100)).alias("primary"),
        F.count_if(has_flag("flag", 0x800)).alias("supplementary"),
        F.coalesce(F.avg(F.when(placed, F.col("mapq"))), F.lit(0.0)).alias("avg_mapq"),
    )


def sam_chrom_counts(sam: DataFrame) -> DataFrame:
    return sam.where(~has_flag("flag", 0x4) & (F.col("rname") != "*")).groupBy(F.col("rname").alias("chrom")).agg(F.count("*").alias("n"))


def filter_by_mapq(sam: DataFrame, min_mapq: int) -> DataFrame:
    return sam.where(~has_flag("flag", 0x4) & (F.col("mapq") >= min_mapq)).select("qname")


def fetch_region(sam: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(qname, pos, cigar) of mapped reads that start in the region, its ends included."""
    return sam.where(~has_flag("flag", 0x4) & (F.col("rname") == chrom) & F.col("pos").between(start, end)).select("qname", "pos", "cigar")


def coverage_at_position(sam: DataFrame, chrom: str, position: int) -> DataFrame:
    """One row (depth): mapped reads over a place, each as long as its sequence."""
    over = ~has_flag("flag", 0x4) & (F.col("rname") == chrom) & (F.col("pos") <= position) & (F.col("pos") + F.octet_length("seq") > position)
    return sam.agg(F.count_if(over).alias("depth"))


def sam_spans(sam: DataFrame) -> DataFrame:
    """(chrom, pos, span) of mapped reads, for region_coverage."""
    return sam.where(~has_flag("flag", 0x4)).select(F.col("rname").alias("chrom"), "pos", F.octet_length("seq").cast("long").alias("span"))


def insert_size_stats(sam: DataFrame) -> DataFrame:
    """One row over paired mapped reads with a positive template length; zeros for none."""
    rows = sam.where(has_flag("flag", 0x1) & ~has_flag("flag", 0x4) & (F.col("tlen") > 0)).select(F.lit(0).alias("g"), F.col("tlen").alias("value"))
    s = rows.agg(F.count("*").alias("count"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), _zero(F.min("value")).alias("min"), _zero(F.max("value")).alias("max"))
    return s.join(upper_median(rows, ["g"]).select("median"), how="left").select("count", "mean", _zero(F.col("median")).alias("median"), "min", "max")


def vcf_stats(vcf: DataFrame) -> DataFrame:
    snp = (F.octet_length("ref") == 1) & (F.octet_length("alt") == 1)
    return vcf.agg(F.count("*").alias("total_variants"), F.count_if(snp).alias("snps"), F.count_if(~snp).alias("indels"))


def vcf_filter(vcf: DataFrame, min_qual: float) -> DataFrame:
    return vcf.where(F.col("qual") >= min_qual).select("chrom", "pos", "id", "ref", "alt", "qual")


def gtf_stats(gtf: DataFrame) -> DataFrame:
    return gtf.agg(F.count_if(F.col("feature") == "gene").alias("gene_count"), F.count_if(F.col("feature") == "transcript").alias("transcript_count"))


def attribute(name: str, default: str = ""):
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(default))


def feature_reads(gtf: DataFrame, points: DataFrame, feature: str, key: str) -> DataFrame:
    """(key, n): reads with start <= pos < end of each feature row, in the file's coordinates."""
    from .intervals import point_counts

    rows = gtf.where(F.col("feature") == feature).select("chrom", "start_", "end_", attribute(key).alias(key))
    return point_counts(rows, points, [key])


def gene_count_matrix(gtf: DataFrame, points: DataFrame) -> DataFrame:
    return feature_reads(gtf, points, "gene", "gene_id")


def exon_count(gtf: DataFrame, points: DataFrame) -> DataFrame:
    return feature_reads(gtf, points, "exon", "exon_id")


def gene_biotype_stats(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'gene'").groupBy(attribute("gene_biotype", "unknown").alias("biotype")).agg(F.count("*").alias("n"))


def transcript_length_stats(gtf: DataFrame) -> DataFrame:
    """(transcript_id, length): summed end - start of exon rows."""
    rows = gtf.where("feature = 'exon'")
    return rows.groupBy(attribute("transcript_id").alias("transcript_id")).agg(F.sum(F.col("end_") - F.col("start_")).alias("length"))
