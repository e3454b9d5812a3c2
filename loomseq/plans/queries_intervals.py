"""Queries over intervals, reads and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import intervals as I
from .views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def genes(spark, d):
    return view(spark, d, "g_intervals")


def points(spark, d):
    return view(spark, d, "g_frags").select("chrom", F.col("start_").alias("pos"))


def fragments(spark, d):
    """Distinct fragments, numbered by their place."""
    rows = view(spark, d, "g_frags").select("chrom", "start_", "end_").distinct()
    return rows.withColumn("idx", F.xxhash64("chrom", "start_", "end_"))


def peaks(spark, d):
    """Every interval of the minus strand."""
    return genes(spark, d).where("strand = '-'")


def others(spark, d):
    return genes(spark, d).where("strand = '+'")


A, B = "(SELECT * FROM g_intervals WHERE strand = '-') a", "(SELECT * FROM g_intervals WHERE strand = '+') b"
HIT = "a.chrom = b.chrom AND a.start_ < b.end_ AND b.start_ < a.end_"
GAP = "greatest(0, b.start_ - a.end_, a.start_ - b.end_)"
COVER = "SELECT a.idx, count(p.start_) AS n FROM g_intervals a {} JOIN g_frags p ON p.chrom = a.chrom AND p.start_ >= a.start_ AND p.start_ < a.end_ GROUP BY a.idx"

_add("coverage_over_intervals", lambda s, d: I.coverage_over_intervals(genes(s, d), points(s, d)), COVER.format("LEFT"))
_add("coverage_over_bins", lambda s, d: I.coverage_over_bins(points(s, d), genes(s, d)), COVER.format("LEFT"))
_add("count_reads_in_peaks", lambda s, d: I.count_reads_in_peaks(points(s, d), genes(s, d)), COVER.format(""))
_add("batch_overlap", lambda s, d: I.batch_overlap(peaks(s, d), others(s, d)), f"SELECT a.idx AS a_idx, b.idx AS b_idx FROM {A}, {B} WHERE {HIT}")
INTERSECT = f"""SELECT a.idx AS a_idx, b.idx AS b_idx, a.chrom, greatest(a.start_, b.start_) AS start_, least(a.end_, b.end_) AS end_, a.name AS a_name, b.name AS b_name,
  least(a.end_, b.end_) - greatest(a.start_, b.start_) AS length FROM {A}, {B} WHERE {HIT} AND least(a.end_, b.end_) > greatest(a.start_, b.start_)"""
_add("bed_intersect", lambda s, d: I.bed_intersect(peaks(s, d), others(s, d)), INTERSECT)
TWO = INTERSECT.replace("SELECT a.idx", "SELECT b.idx % 3 AS file_no, a.idx", 1)


def _many(s, d):
    """The intervals of the plus strand as three files."""
    return I.bed_intersect_files(peaks(s, d), others(s, d).withColumn("file", F.col("idx") % 3)).withColumnRenamed("file", "file_no")


_add("parallel_bed_intersect", _many, TWO)
_add("intervals_overlap", lambda s, d: genes(s, d).select("idx", R.intervals_overlap("chrom", "start_", "end_", F.lit("chr7"), F.lit(500000), F.lit(900000)).alias("value")), "SELECT idx, chrom = 'chr7' AND start_ < 900000 AND 500000 < end_ AS value FROM g_intervals")
_add(
    "overlap_length",
    lambda s, d: genes(s, d).select("idx", R.overlap_length("chrom", "start_", "end_", F.lit("chr7"), F.lit(500000).cast("long"), F.lit(900000).cast("long")).alias("value")),
    "SELECT idx, CASE WHEN chrom = 'chr7' THEN greatest(0, least(end_, 900000) - greatest(start_, 500000)) ELSE 0 END AS value FROM g_intervals",
)
_add("interval_length", lambda s, d: genes(s, d).select("idx", R.interval_length("end_", "start_").alias("value")), "SELECT idx, abs(end_ - start_) AS value FROM g_intervals")
_add(
    "tss_distance",
    lambda s, d: genes(s, d).select("idx", R.tss_distance(F.lit("chr7"), F.lit(700000), "chrom", "start_", "end_", "strand").alias("value")),
    "SELECT idx, CASE WHEN chrom = 'chr7' THEN abs(700000 - CASE strand WHEN '+' THEN start_ ELSE end_ END) END AS value FROM g_intervals",
)
_add("interval_tree_query", lambda s, d: I.interval_query(genes(s, d), "chr7", 500000, 900000).select("idx", "chrom", "start_", "end_"), "SELECT idx, chrom, start_, end_ FROM g_intervals WHERE chrom = 'chr7' AND start_ < 900000 AND 500000 < end_")
_add("sliding_bins", lambda s, d: I.sliding_bins(s, "chr1", 0, 2000000, 500, 100), "SELECT 'chr1' AS chrom, i AS start_, i + 500 AS end_ FROM (SELECT unnest(range(0, 1999501, 100)) AS i)")
_add(
    "window_count",
    lambda s, d: I.window_count(genes(s, d), points(s, d), 100),
    """WITH w AS (SELECT idx, chrom, start_, end_, unnest(range(0, (end_ - start_) // 100 + 1)) AS win FROM g_intervals)
SELECT w.idx, win AS "window", count(p.start_) AS n FROM w LEFT JOIN g_frags p ON p.chrom = w.chrom AND p.start_ >= w.start_ AND p.start_ < w.end_ AND (p.start_ - w.start_) // 100 = win GROUP BY w.idx, win""",
)
_add("filter_blacklist", lambda s, d: I.filter_blacklist(peaks(s, d), others(s, d)).select("idx", "chrom", "start_", "end_"), f"SELECT a.idx, a.chrom, a.start_, a.end_ FROM {A} WHERE NOT EXISTS (SELECT 1 FROM {B} WHERE {HIT})")
_add(
    "fragment_overlap_peaks",
    lambda s, d: I.fragment_overlap_peaks(peaks(s, d), others(s, d)).select("idx", F.array_join(F.transform("peaks", lambda x: x.cast("string")), ",").alias("peaks")),
    f"SELECT a.idx, coalesce(string_agg(b.idx, ',' ORDER BY b.idx), '') AS peaks FROM {A} LEFT JOIN {B} ON {HIT} GROUP BY a.idx",
)
_add("match_enhancer_promoter", lambda s, d: I.match_enhancer_promoter(peaks(s, d), others(s, d), 300), f"SELECT a.name AS enhancer, b.name AS promoter, {GAP} AS distance FROM {A}, {B} WHERE a.chrom = b.chrom AND {GAP} <= 300")


def _methylation(s, d):
    calls = view(s, d, "g_frags").select("chrom", F.col("start_").alias("pos"), (F.col("l_partkey") % 2 == 0).alias("methylated"))
    return I.cpg_methylation_levels(calls, genes(s, d).select("chrom", F.col("start_").alias("pos")).distinct(), 50)


_add(
    "cpg_methylation_levels",
    _methylation,
    """SELECT a.chrom, a.start_ AS pos, count(*) FILTER (p.l_partkey % 2 = 0) AS methylated, count(*) AS total
FROM (SELECT DISTINCT chrom, start_ FROM g_intervals) a JOIN g_frags p ON p.chrom = a.chrom AND p.start_ BETWEEN a.start_ - 50 AND a.start_ + 50 GROUP BY a.chrom, a.start_""",
)
_add(
    "bed_merge",
    lambda s, d: I.bed_merge(genes(s, d)),
    """WITH o AS (SELECT *, max(end_) OVER (PARTITION BY chrom ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g_intervals),
i AS (SELECT *, sum(CASE WHEN before >= start_ THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, min(start_) AS start_, max(end_) AS end_ FROM i GROUP BY chrom, island""",
)
_add(
    "bed_subtract",
    lambda s, d: I.bed_subtract(peaks(s, d), others(s, d)).select("idx", "chrom", "start_", "end_"),
    f"""WITH c AS (SELECT a.idx, b.start_ AS s, b.end_ AS e FROM {A} JOIN {B} ON {HIT}),
k AS (SELECT idx, s, e, max(e) OVER (PARTITION BY idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT a.idx, a.chrom, coalesce(greatest(before, a.start_), a.start_) AS start_, s AS end_ FROM k JOIN {A} USING (idx)
  UNION ALL SELECT a.idx, a.chrom, greatest(max(e), any_value(a.start_)), any_value(a.end_) FROM c JOIN {A} USING (idx) GROUP BY a.idx, a.chrom
  UNION ALL SELECT a.idx, a.chrom, a.start_, a.end_ FROM {A} WHERE idx NOT IN (SELECT idx FROM c))
SELECT * FROM g WHERE start_ < end_""",
)
NEAR = f"""SELECT a.idx, a.name, (min(struct_pack(d := {GAP}, i := b.idx))).i AS b_idx, min({GAP}) AS distance FROM {A} JOIN {B} ON a.chrom = b.chrom GROUP BY a.idx, a.name"""
_add(
    "bed_closest",
    lambda s, d: I.bed_closest(peaks(s, d), others(s, d)).select("idx", "chrom", "start_", "end_", "name", "closest", "distance"),
    f"""WITH n AS ({NEAR}) SELECT a.idx, a.chrom, a.start_, a.end_, a.name, coalesce('g' || b_idx, '') AS closest, coalesce(distance, 9223372036854775807) AS distance FROM {A} LEFT JOIN n USING (idx)""",
)
_add(
    "nearest_feature",
    lambda s, d: I.nearest_feature(peaks(s, d).select("idx", "chrom", F.col("start_").alias("pos")), others(s, d)),
    f"""WITH n AS ({NEAR.replace("a.end_", "a.start_")}) SELECT n.idx, b.name, distance,
  CASE WHEN a.start_ < b.start_ THEN 'upstream' WHEN a.start_ > b.end_ THEN 'downstream' ELSE 'overlapping' END AS direction
FROM n JOIN {A} ON a.idx = n.idx JOIN {B} ON b.idx = n.b_idx""",
)


def _frip(s, d):
    return I.fragment_stats(fragments(s, d), genes(s, d)).withColumn("frip", F.round("frip", 9))


_add(
    "cuttag_fragment_stats",
    _frip,
    """WITH f AS (SELECT DISTINCT chrom, start_, end_ FROM g_frags),
h AS (SELECT f.*, EXISTS (SELECT 1 FROM g_intervals a WHERE a.chrom = f.chrom AND a.start_ < f.end_ AND f.start_ < a.end_) AS hit FROM f),
m AS (SELECT end_ - start_ AS len, row_number() OVER (ORDER BY end_ - start_) - 1 AS r, count(*) OVER () AS n FROM f)
SELECT count(*) AS total_fragments, count(*) FILTER (hit) AS fragments_in_peaks, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS frip,
  (SELECT max(len) FROM m WHERE r = n // 2) AS median_fragment_length FROM h""",
)
_add(
    "chipseq_peak_coverage",
    lambda s, d: I.peak_coverage(points(s, d), "chr7", 500000, 900000).withColumn("mean_coverage", F.round("mean_coverage", 9)),
    """WITH c AS (SELECT start_, count(*) AS n FROM g_frags WHERE chrom = 'chr7' AND start_ >= 500000 AND start_ < 900000 GROUP BY start_)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_reads, coalesce(max(n), 0) AS max_coverage, round(coalesce(sum(n), 0)::DOUBLE / 400000, 9) AS mean_coverage, 400000::BIGINT AS peak_length FROM c""",
)
_add(
    "tn5_insertion_sites",
    lambda s, d: genes(s, d).select("idx", "chrom", R.tn5_insertion_site("start_", F.col("strand") == "-").alias("pos")),
    "SELECT idx, chrom, CASE strand WHEN '-' THEN start_ - 1 ELSE start_ END AS pos FROM g_intervals",
)
_add("fragment_length_distribution", lambda s, d: I.value_counts(view(s, d, "g_frags").select((F.col("end_") - F.col("start_")).alias("length")), "length"), "SELECT end_ - start_ AS length, count(*) AS n FROM g_frags GROUP BY 1")
