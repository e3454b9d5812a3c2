"""Interval joins without quadratic work: (idx, chrom, start_, end_, ...) tables, half-open.

An overlap join puts each interval in the bins that it touches, joins by
chromosome and bin, and keeps a pair only in the bin where the later start
lies, so no pair comes twice and nothing is made distinct. A long interval is
put in wider bins, SPAN at most; a shorter one goes to these too where such
long ones are in the other table, and a pair is looked for at the level of
the longer of the two. Windows over a whole chromosome, of which there are
few, only see one row per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import gap_distance

#: Width of a bin; about the intervals' median length is best. Bins of an interval at most; how much wider the next level's are.
WIDTH, SPAN = 1000, 64
#: Width of the ranges in which neighbours and merges are first looked for.
RANGE = 100_000
NO_DISTANCE = (1 << 63) - 1


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _level(width: int, low: Column, high: Column) -> Column:
    """The least level whose bins, width * SPAN ** level wide, the span from low to high fills SPAN of at most."""
    n, found = high - low, F.lit(0)
    for level in range(1, 6):
        found = F.when(n > F.lit(width * SPAN**level), level).otherwise(found)
    return found


def _levels(df: DataFrame, width: int, low: str | Column, high: str | Column) -> list[int]:
    """Which levels there are; six at most."""
    return sorted(df.agg(F.collect_set(_level(width, low, high)).alias("x")).first().x)


def _binned(df: DataFrame, prefix: str, width: int, low: Column, high: Column, levels: list[int]) -> DataFrame:
    """A row for each bin of an interval at its own level and at the other table's higher levels."""
    own = _level(width, low, high)

    def bins(level: int) -> Column:
        w = width * SPAN**level
        at = F.transform(F.sequence(_bin(low, w), F.greatest(_bin(low, w), _bin(high, w))), lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin")))
        return F.when(own == level if level not in levels else own <= level, at).otherwise(F.slice(at, 1, 0))

    rows = _prefixed(df, prefix).withColumn(f"{prefix}level_", own)
    return rows.withColumn("at_", F.explode(F.flatten(F.array(*[bins(x) for x in sorted({*levels, *range(6)})])))).select("*", F.col("at_.level").alias("at_level_"), F.col("at_.bin").alias("bin_")).drop("at_")


def _joined(a: DataFrame, b: DataFrame, width: int, ends_a: tuple[Column, Column], ends_b: tuple[Column, Column], hit: Column, later: Column) -> DataFrame:
    """Pairs of a_ and b_ rows in one bin, at the level of the longer, that hit and whose later start is in the bin."""
    x = _binned(a, "a_", width, *ends_a, _levels(_prefixed(b, "b_"), width, *ends_b))
    y = _binned(b, "b_", width, *ends_b, _levels(_prefixed(a, "a_"), width, *ends_a))
    bin_width = F.lit(width) * F.element_at(F.array(*[F.lit(SPAN**i) for i in range(6)]), x.at_level_ + 1)
    own = x.bin_ == F.floor(later / bin_width).cast("long")
    longer = F.greatest("a_level_", "b_level_") == x.at_level_
    found = x.join(y, (x.a_chrom == y.b_chrom) & (x.at_level_ == y.at_level_) & (x.bin_ == y.bin_) & hit & longer & own)
    return found.drop("bin_", "at_level_", "a_level_", "b_level_")


def overlap_join(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """All pairs that overlap (a.start < b.end and b.start < a.end), columns prefixed a_ and b_."""
    hit = (F.col("a_start_") < F.col("b_end_")) & (F.col("b_start_") < F.col("a_end_"))
    ends = [(F.col(f"{x}_start_"), F.col(f"{x}_end_") - 1) for x in "ab"]
    return _joined(a, b, width, *ends, hit, F.greatest("a_start_", "b_start_"))


def near_join(a: DataFrame, b: DataFrame, most: int, width: int = WIDTH) -> DataFrame:
    """All pairs of a chromosome with at most most bases between them (0 if they touch), with distance."""
    gap = gap_distance("a_start_", "a_end_", "b_start_", "b_end_")
    ends = (F.col("a_start_") - most, F.col("a_end_") + most), (F.col("b_start_"), F.col("b_end_"))
    return _joined(a, b, max(width, most), *ends, gap <= most, F.greatest(F.col("a_start_") - most, F.col("b_start_"))).withColumn("distance", gap)


def point_join(intervals: DataFrame, points: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of an interval (i_...) and a point (p_chrom, p_pos, ...) with start <= pos < end."""
    low, high = F.col("i_start_"), F.col("i_end_") - 1
    x = _binned(intervals, "i_", width, low, high, [])
    at = [F.struct(F.lit(i).alias("level"), _bin(F.col("p_pos"), width * SPAN**i).alias("bin")) for i in _levels(_prefixed(intervals, "i_"), width, low, high)]
    y = _prefixed(points, "p_").withColumn("to_", F.explode(F.array(*at).cast("array<struct<level:int,bin:bigint>>")))
    hit = (F.col("p_pos") >= F.col("i_start_")) & (F.col("p_pos") < F.col("i_end_"))
    return x.join(y, (x.i_chrom == y.p_chrom) & (x.at_level_ == F.col("to_.level")) & (x.bin_ == F.col("to_.bin")) & hit).drop("bin_", "at_level_", "i_level_", "to_")


def point_counts(intervals: DataFrame, points: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """(by, n): points in each interval that has any; equal points are counted before the join."""
    at = points.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    return point_join(intervals, at, width).groupBy(*[F.col("i_" + c).alias(c) for c in by]).agg(F.sum("p_n").alias("n"))


def coverage_over_intervals(intervals: DataFrame, points: DataFrame, width: int = WIDTH) -> DataFrame:
    """(idx, n) for every interval, 0 where no point is."""
    counts = point_counts(intervals, points, ["idx"], width)
    return intervals.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage_over_bins(points: DataFrame, bins: DataFrame, width: int = WIDTH) -> DataFrame:
    return coverage_over_intervals(bins, points, width)


def count_reads_in_peaks(points: DataFrame, peaks: DataFrame, width: int = WIDTH) -> DataFrame:
    return point_counts(peaks, points, ["idx"], width)


def batch_overlap(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    return overlap_join(a, b, width).select("a_idx", "b_idx")


def bed_intersect(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chrom, start_, end_, a_name, b_name, length): each pair's common part, if it has a base."""
    start, end = F.greatest("a_start_", "b_start_"), F.least("a_end_", "b_end_")
    rows = overlap_join(a, b, width).select("a_idx", "b_idx", F.col("a_chrom").alias("chrom"), start.alias("start_"), end.alias("end_"), "a_name", "b_name", (end - start).alias("length"))
    return rows.where("length > 0")


def bed_intersect_files(a: DataFrame, files: DataFrame, width: int = WIDTH) -> DataFrame:
    """bed_intersect of a with each file's intervals (file, idx, chrom, start_, end_, name), with file, in one plan."""
    start, end = F.greatest("a_start_", "b_start_"), F.least("a_end_", "b_end_")
    rows = overlap_join(a, files, width)
    rows = rows.select(F.col("b_file").alias("file"), "a_idx", "b_idx", F.col("a_chrom").alias("chrom"), start.alias("start_"), end.alias("end_"), "a_name", "b_name", (end - start).alias("length"))
    return rows.where("length > 0")


def filter_blacklist(intervals: DataFrame, blacklist: DataFrame, width: int = WIDTH) -> DataFrame:
    hit = overlap_join(intervals, blacklist, width).select(F.col("a_idx").alias("idx"))
    return intervals.join(hit, "idx", "left_anti")


def interval_query(intervals: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return intervals.where((F.col("chrom") == chrom) & (F.col("start_") < end) & (F.lit(start) < F.col("end_")))


def fragment_overlap_peaks(fragments: DataFrame, peaks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(idx, peaks): the sorted numbers of the peaks that each fragment overlaps; may be none."""
    hits = overlap_join(fragments, peaks, width).groupBy(F.col("a_idx").alias("idx")).agg(F.sort_array(F.collect_list("b_idx")).alias("peaks"))
    return fragments.select("idx").join(hits, "idx", "left").select("idx", F.coalesce("peaks", F.array().cast("array<bigint>")).alias("peaks"))


def match_enhancer_promoter(enhancers: DataFrame, promoters: DataFrame, most: int, width: int = WIDTH) -> DataFrame:
    return near_join(enhancers, promoters, most, width).select(F.col("a_name").alias("enhancer"), F.col("b_name").alias("promoter"), "distance")


def cpg_methylation_levels(calls: DataFrame, sites: DataFrame, most: int) -> DataFrame:
    """(chrom, pos, methylated, total): each call counts at every site at most most bases away."""
    at = calls.groupBy("chrom", F.col("pos").alias("start_")).agg(F.count_if("methylated").alias("m"), F.count("*").alias("n")).withColumn("end_", F.col("start_"))
    of = sites.select("chrom", F.col("pos").alias("start_"), F.col("pos").alias("end_"))
    rows = near_join(of, at, most, max(1, most))
    return rows.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start_").alias("pos")).agg(F.sum("b_m").alias("methylated"), F.sum("b_n").alias("total"))


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy("start_", "end_")
    before = F.max("end_").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("new_", F.when(before >= F.col("start_"), 0).otherwise(1))
    rows = rows.withColumn("island_", F.sum("new_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island_").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_")).drop("island_")


def bed_merge(intervals: DataFrame) -> DataFrame:
    """(chrom, start_, end_): intervals that overlap or touch, merged.

    First among those that start in one range, so that a chromosome's final
    pass only sees what is left of them.
    """
    rows = intervals.select("chrom", "start_", "end_", _bin(F.col("start_"), RANGE).alias("range_"))
    return _islands(_islands(rows, ["chrom", "range_"]).drop("range_"), ["chrom"])


def bed_subtract(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """(idx, chrom, start_, end_, name): what is left of each a without all b; none to many pieces."""
    cuts = overlap_join(a, b.select("chrom", "start_", "end_").distinct(), width)
    cuts = cuts.groupBy(F.col("a_idx").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("b_start_").alias("s"), F.col("b_end_").alias("e")))).alias("cuts"))
    kind = "array<struct<s:bigint,e:bigint>>"
    start = F.struct(F.col("start_").cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def piece(s: Column, e: Column) -> Column:
        return F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))

    def step(x: Column, c: Column) -> Column:
        out = F.when(c["s"] > x["at"], F.concat(x["out"], piece(x["at"], c["s"]))).otherwise(x["out"])
        return F.struct(F.greatest(x["at"], c["e"]).alias("at"), out.alias("out"))

    def end(x: Column) -> Column:
        return F.when(x["at"] < F.col("end_"), F.concat(x["out"], piece(x["at"], F.col("end_")))).otherwise(x["out"])

    rows = a.join(cuts, "idx", "left")
    left = F.when(F.col("cuts").isNull(), piece(F.col("start_"), F.col("end_"))).otherwise(F.aggregate(F.coalesce("cuts", F.array().cast(kind)), start, step, end))
    return rows.select("idx", "chrom", "name", F.explode(left).alias("p")).select("idx", "chrom", F.col("p.s").alias("start_"), F.col("p.e").alias("end_"), "name")


def _neighbour(a: DataFrame, b: DataFrame, left: bool) -> DataFrame:
    """(idx, near): for each a the struct of the closest b on one side, least idx first among equals."""
    sign = 1 if left else -1
    own = F.struct((sign * F.col("end_" if left else "start_")).alias("key"), (-F.col("idx")).alias("minus"))
    rows = b.select("chrom", (sign * F.col("end_" if left else "start_")).alias("key"), F.lit(0).alias("kind"), own.alias("val"), F.lit(None).cast("long").alias("idx"))
    asks = a.select("chrom", (sign * F.col("start_" if left else "end_")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("struct<key:bigint,minus:bigint>").alias("val"), "idx")
    every = rows.select("chrom", F.col("key").cast("long"), "kind", F.col("val").cast("struct<key:bigint,minus:bigint>"), "idx").union(asks).withColumn("range_", _bin(F.col("key"), RANGE))
    inside = W.partitionBy("chrom", "range_").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    here = every.withColumn("near", F.max("val").over(inside)).where("kind = 1").select("chrom", "range_", "idx", "near")
    before = W.partitionBy("chrom").orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    tops = every.groupBy("chrom", "range_").agg(F.max("val").alias("top")).withColumn("top", F.max("top").over(before))
    return here.join(tops, ["chrom", "range_"]).select("idx", F.coalesce("near", "top").alias("near"))


def closest(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """a with b_idx and distance of its nearest b (0 if they touch or overlap), least b_idx among equals; null if the chromosome has none."""
    touch = near_join(a.select("idx", "chrom", "start_", "end_"), b.select("idx", "chrom", "start_", "end_"), 0, width)
    found = touch.select(F.col("a_idx").alias("idx"), F.struct("distance", F.col("b_idx").alias("b_idx")).alias("near"))
    for left in (True, False):
        side = _neighbour(a, b, left).join(a.select("idx", "start_", "end_"), "idx")
        gap = (F.col("start_") - F.col("near.key")) if left else (-F.col("near.key") - F.col("end_"))
        found = found.union(side.where("near is not null").select("idx", F.struct(gap.cast("long").alias("distance"), (-F.col("near.minus")).alias("b_idx"))))
    least = found.groupBy("idx").agg(F.min("near").alias("near"))
    return a.join(least, "idx", "left").select(*[a[c] for c in a.columns], F.col("near.b_idx").alias("b_idx"), F.col("near.distance").alias("distance"))


def bed_closest(a: DataFrame, b: DataFrame, compat: bool = True, width: int = WIDTH) -> DataFrame:
    """a with the name and distance of its nearest b; without one '' and the largest long, or nulls."""
    names = b.select(F.col("idx").alias("b_idx"), F.col("name").alias("b_name"))
    rows = closest(a, b, width).join(names, "b_idx", "left")
    name, far = (F.lit(""), F.lit(NO_DISTANCE)) if compat else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    return rows.select(*a.columns, F.coalesce("b_name", name).alias("closest"), F.coalesce("distance", far).alias("distance"))


def nearest_feature(points: DataFrame, features: DataFrame, width: int = WIDTH) -> DataFrame:
    """(idx, name, distance, direction): the feature nearest to each point, ends included."""
    at = points.select("idx", "chrom", F.col("pos").alias("start_"), F.col("pos").alias("end_"))
    f = features.select(F.col("idx").alias("b_idx"), "name", F.col("start_").alias("s"), F.col("end_").alias("e"))
    rows = closest(at, features, width).join(f, "b_idx")
    way = F.when(F.col("start_") < F.col("s"), "upstream").when(F.col("start_") > F.col("e"), "downstream").otherwise("overlapping")
    return rows.select("idx", "name", "distance", way.alias("direction"))


def sliding_bins(spark, chrom: str, start: int, end: int, size: int, step: int) -> DataFrame:
    """(chrom, start_, end_): bins of a size at each step that end in the range."""
    if step <= 0:
        raise ValueError("step must be positive")
    rows = spark.range(start, max(start, end - size + 1), step)
    return rows.select(F.lit(chrom).alias("chrom"), F.col("id").alias("start_"), (F.col("id") + size).alias("end_"))


def window_count(intervals: DataFrame, points: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """(idx, window, n): points in consecutive windows of each interval, floor(length / size) + 1 of them."""
    at = points.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    hits = point_join(intervals.select("idx", "chrom", "start_", "end_"), at, width)
    hits = hits.groupBy(F.col("i_idx").alias("idx"), F.floor((F.col("p_pos") - F.col("i_start_")) / size).cast("long").alias("window")).agg(F.sum("p_n").alias("n"))
    every = intervals.select("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_") - F.col("start_")) / size).cast("long"))).alias("window"))
    return every.join(hits, ["idx", "window"], "left").select("idx", "window", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def interval_stats(intervals: DataFrame) -> DataFrame:
    """One row: count, bases, and the least, greatest and mean length; zeros for none."""
    n = F.col("end_") - F.col("start_")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return intervals.agg(
        F.count("*").alias("total_intervals"),
        zero(F.sum(n)).alias("total_bases"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"),
        zero(F.min(n)).alias("min_length"),
        zero(F.max(n)).alias("max_length"),
    )


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(column, n): rows of each value."""
    return df.groupBy(F.col(column).alias(name or column)).agg(F.count("*").alias("n"))


def fragment_stats(fragments: DataFrame, peaks: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row: fragments, those that overlap a peak, their part, and the upper median length."""
    from .statistics import upper_median

    hit = overlap_join(fragments.select("idx", "chrom", "start_", "end_"), peaks.select("chrom", "start_", "end_"), width).select(F.col("a_idx").alias("idx")).distinct()
    flags = fragments.select("idx", (F.col("end_") - F.col("start_")).alias("len")).join(hit.withColumn("hit", F.lit(True)), "idx", "left")
    sums = flags.agg(F.count("*").alias("total_fragments"), F.count("hit").alias("fragments_in_peaks"))
    mid = upper_median(flags.select(F.lit(0).alias("g"), F.col("len").alias("value")), ["g"]).select(F.col("median").cast("long").alias("median_fragment_length"))
    part = F.when(F.col("total_fragments") == 0, 0.0).otherwise(F.col("fragments_in_peaks") / F.greatest("total_fragments", F.lit(1)))
    return sums.join(mid, how="left").select("total_fragments", "fragments_in_peaks", part.alias("frip"), F.coalesce("median_fragment_length", F.lit(0).cast("long")).alias("median_fragment_length"))


def peak_coverage(points: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """One row for one peak: its reads, the most at one place, reads per base, and its size."""
    if end < start:
        raise ValueError("end before start")
    at = points.where((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end)).groupBy("pos").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    mean = F.lit(0.0) if end == start else total / float(end - start)
    return at.agg(total.alias("total_reads"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_coverage"), mean.alias("mean_coverage"), F.lit(end - start).cast("long").alias("peak_length"))


def region_coverage(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(pos, depth) for each place of [start, end): reads (chrom, pos, span) that cover it.

    Reads add one where they start and take one where they end, and a running
    sum over the region's places gives the depth: reads are never spread out.
    """
    if end < start:
        raise ValueError("end before start")
    spark = reads.sparkSession
    hit = reads.where((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("pos") + F.col("span") > start))
    ends = F.explode(F.array(F.struct(F.greatest("pos", F.lit(start).cast("long")).alias("pos"), F.lit(1).alias("d")), F.struct((F.col("pos") + F.col("span")).alias("pos"), F.lit(-1).alias("d"))))
    change = hit.select(ends.alias("x")).select("x.*").groupBy("pos").agg(F.sum("d").alias("d"))
    every = spark.range(start, end).withColumnRenamed("id", "pos").join(change, "pos", "left").withColumn("range_", _bin(F.col("pos"), RANGE))
    inside = W.partitionBy("range_").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    tops = every.groupBy("range_").agg(F.sum("d").alias("d")).withColumn("base", F.sum("d").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)))
    rows = every.withColumn("here", F.sum("d").over(inside)).join(tops.select("range_", "base"), "range_")
    return rows.select("pos", (F.coalesce("here", F.lit(0)) + F.coalesce("base", F.lit(0))).cast("long").alias("depth"))
