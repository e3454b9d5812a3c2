"""Mergeable aggregates over directories into which text files arrive.

The same column functions as in batch, on Structured Streaming: a running
table of counts that each micro-batch adds to, in update or complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import kmers
from ..functions.sequence import gc_content, seq_length


def stream_sequences(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(file, seq): a stream of files with one sequence per line; blank lines and lines with > are passed over."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return rows.where((F.trim("value") != "") & ~F.col("value").startswith(">")).select(F.input_file_name().alias("file"), F.trim("value").alias("seq"))


def length_counts(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy(seq_length("seq").alias("length")).agg(F.count("*").alias("n"))


def gc_counts(seqs: DataFrame, bin_size: float = 0.1) -> DataFrame:
    return seqs.groupBy(F.floor(gc_content("seq") / F.lit(bin_size)).alias("bin")).agg(F.count("*").alias("n"))


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    return seqs.select(F.explode(kmers("seq", k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def peak_counts(points: DataFrame, peaks: DataFrame, width: int = 1000) -> DataFrame:
    """(idx, n): streamed points (chrom, pos) in static peaks."""
    from ..operators.intervals import point_join

    return point_join(peaks, points, width).groupBy(F.col("i_idx").alias("idx")).agg(F.count("*").alias("n"))
