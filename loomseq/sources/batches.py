"""Functions over several files, each as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import bed_intersect_files
from ..operators.reads import fastq_filter
from .fastq import read_fastq
from .text import fastq_line, path_exists, read_bed, read_fasta


def parallel_parse_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header, seq) of all files; one that is missing has no rows."""
    return read_fasta(spark, *paths, ignore_missing=True)


def parallel_bed_intersect(spark: SparkSession, path_a: str, paths_b: list[str]) -> DataFrame:
    """(file, a_idx, b_idx, chrom, start_, end_, a_name, b_name, length): the common parts of A with each B.

    A file that is missing has no rows. Numbers of intervals differ within a
    table and have no other meaning.
    """
    number = F.monotonically_increasing_id()
    there = [p for p in paths_b if path_exists(spark, p)]
    if not there or not path_exists(spark, path_a):
        return spark.createDataFrame([], "file string, a_idx long, b_idx long, chrom string, start_ long, end_ long, a_name string, b_name string, length long")
    a, b = read_bed(spark, path_a).drop("file").withColumn("idx", number), read_bed(spark, *there).withColumn("idx", number)
    return bed_intersect_files(a, b)


def batch_fastq_filter(spark: SparkSession, inputs: dict[str, str], out: str, min_length: int, min_quality: float, compression: str = "gzip") -> DataFrame:
    """Filters every input (name by path) into the folder input=<name> of out, and gives (input, kept).

    All inputs are read and written by one plan, dealt by input, and rows of
    one input to many files; an input of which nothing is left has no folder.
    """
    names = F.create_map(*[F.lit(x) for pair in inputs.items() for x in pair])
    under = F.filter(F.array(*[F.lit(p) for p in inputs]), lambda p: (F.col("file") == p) | F.col("file").startswith(F.concat(p, F.lit("/"))))
    rows = fastq_filter(read_fastq(spark, *inputs), min_length, min_quality)
    lines = rows.select(F.element_at(names, F.get(under, F.lit(0))).alias("input"), fastq_line())
    lines.write.mode("overwrite").partitionBy("input").option("compression", compression).text(out)
    every = spark.createDataFrame([(n,) for n in dict.fromkeys(inputs.values())], "input string")
    written = [p for p in (f"{out}/input={n}" for n in dict.fromkeys(inputs.values())) if path_exists(spark, p)]
    if not written:
        return every.withColumn("kept", F.lit(0).cast("long"))
    counts = read_fastq(spark, *written).groupBy(F.regexp_extract("file", r"/input=([^/]+)/", 1).alias("input")).agg(F.count("*").alias("kept"))
    return every.join(counts, "input", "left").select("input", F.coalesce("kept", F.lit(0)).alias("kept"))
