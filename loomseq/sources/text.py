"""Readers of tab-separated genomic text, FASTA and matrices, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrices import mtx_value, to_matrix_market


def _number(x: Column, kind: str = "long", default=0) -> Column:
    """A field as a number; anything but an optional sign and digits (or a float) gives the default."""
    shape = r"^[+-]?[0-9]+$" if kind != "double" else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return F.coalesce(F.when(x.rlike(shape), x.try_cast(kind)), F.lit(default).cast(kind))


def _small(x: Column, top: int) -> Column:
    n = _number(x)
    return F.when((n >= 0) & (n <= top), n).otherwise(F.lit(0)).cast("int")


def read_lines(spark: SparkSession, *paths: str, comment: str | None = "#") -> DataFrame:
    """(file, f): fields of each line that is neither empty nor a comment."""
    rows = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r$", "").alias("line"))
    rows = rows.where(F.trim("line") != "")
    if comment:
        rows = rows.where(~F.col("line").startswith(comment))
    return rows.select("file", F.split("line", "\t").alias("f"))


def _at(i: int, default: str | None = None) -> Column:
    x = F.try_element_at("f", F.lit(i + 1))
    return x if default is None else F.coalesce(x, F.lit(default))


def parse_bed(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.size("f") >= 3)
    strand = F.substring(_at(5, "."), 1, 1)
    return rows.select(
        "file", _at(0).alias("chrom"), _number(_at(1)).alias("start_"), _number(_at(2)).alias("end_"), _at(3, ".").alias("name"), _number(_at(4, "0"), "double", 0.0).alias("score"), F.when(strand == "", ".").otherwise(strand).alias("strand")
    )


def read_bed(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, chrom, start_, end_, name, score, strand), with . 0 . for what is missing."""
    rows = read_lines(spark, *paths)
    return parse_bed(rows.where(~F.element_at("f", 1).startswith("track") & ~F.element_at("f", 1).startswith("browser")))


def _pairs(x: Column, cut: str, pair) -> Column:
    """A map from text; the last of equal keys wins."""
    parts = F.filter(F.split(x, cut), lambda p: F.trim(p) != "")
    entries = F.transform(parts, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda g: g["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_vcf(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.size("f") >= 8)

    def info(p: Column) -> Column:
        at = F.locate("=", p)
        return F.struct(F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p).alias("key"), F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit("true")).alias("value"))

    return rows.select(
        "file", _at(0).alias("chrom"), _number(_at(1)).alias("pos"), _at(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), _number(_at(5), "double", 0.0).alias("qual"), _at(6).alias("filter"), _pairs(_at(7), ";", info).alias("info")
    )


def read_vcf(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_vcf(read_lines(spark, *paths))


def parse_gtf(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.size("f") >= 9)

    def attribute(p: Column) -> Column:
        t = F.trim(p)
        at = F.locate(" ", t)
        value = F.regexp_replace(F.trim(F.substring(t, at + 1, F.length(t))), r'^"+|"+$', "")
        return F.struct(F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t).alias("key"), F.when(at > 0, value).otherwise(F.lit("")).alias("value"))

    return rows.select(
        "file", _at(0).alias("chrom"), _at(1).alias("source"), _at(2).alias("feature"), _number(_at(3)).alias("start_"), _number(_at(4)).alias("end_"),
        _at(5).alias("score"), _at(6).alias("strand"), _at(7).alias("frame"), _pairs(_at(8), ";", attribute).alias("attributes"),
    )


def read_gtf(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_gtf(read_lines(spark, *paths))


def parse_sam(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.size("f") >= 11)

    def tag(p: Column) -> Column:
        return F.struct(F.substring(p, 1, 2).alias("key"), F.substring(p, F.lit(6), F.length(p)).alias("value"))

    tags = F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda p: F.length(p) >= 5)
    return rows.select(
        "file", _at(0).alias("qname"), _small(_at(1), 65535).alias("flag"), _at(2).alias("rname"), _number(_at(3)).alias("pos"), _small(_at(4), 255).alias("mapq"),
        _at(5).alias("cigar"), _at(6).alias("rnext"), _number(_at(7)).alias("pnext"), _number(_at(8)).alias("tlen"), _at(9).alias("seq"), _at(10).alias("qual"),
        F.map_from_entries(F.filter(F.transform(tags, tag), lambda t, i: ~F.exists(F.slice(F.transform(tags, tag), i + 2, F.size(tags)), lambda u: u["key"] == t["key"]))).alias("tags"),
    )


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_sam(read_lines(spark, *paths, comment="@"))


def read_fasta(spark: SparkSession, *paths: str, ignore_missing: bool = False) -> DataFrame:
    """(file, header, seq): a record is what stands from one > at a line's start to the next; without a header it goes."""
    if ignore_missing:
        paths = [p for p in paths if path_exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], "file string, header string, seq string")
    rows = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("file"), F.col("value"), F.monotonically_increasing_id().alias("n"))
    # only a file's first record still has its >; text before a file's first > is no record
    body = F.regexp_replace("value", r"\r", "")
    first = F.split(F.regexp_replace(body, r"^>", ""), "\n")
    seq = F.array_join(F.transform(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    head = F.trim(F.element_at(first, 1))
    starts = rows.groupBy("file").agg(F.min("n").alias("n0"))
    rows = rows.join(starts, "file").where((F.col("n") > F.col("n0")) | F.col("value").startswith(">"))
    return rows.select("file", head.alias("header"), seq.alias("seq")).where("header <> ''")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_expression_matrix(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(gene, cell, col, value) in long form; the first line names the cells; what is no number is 0."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = rows.orderBy("n").limit(1).select(F.split("value", F.lit("\\" + delimiter if delimiter in "|.*+" else delimiter)).alias("names"), F.col("n").alias("n0"))
    parts = F.split("value", "\\" + delimiter if delimiter in "|.*+" else delimiter)
    body = rows.join(F.broadcast(head), F.col("n") > F.col("n0")).where(F.trim("value") != "")  # one row
    body = body.select(F.get(parts, F.lit(0)).alias("gene"), "names", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("col", "text"))
    return body.select("gene", F.get("names", F.col("col") + 1).alias("cell"), F.col("col").cast("long").alias("col"), _number(F.trim("text"), "double", 0.0).alias("value"))


def read_gz(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value): a text file, plain or gzip with any number of members, as one row, so of 2 GB at most.

    With lines a row is what stands before or between line feeds: no row is
    as large as a file, and an empty file has none.
    """
    return spark.read.text(path, lineSep="\n") if lines else spark.read.text(path, wholetext=True)


def write_gz(lines: DataFrame, path: str) -> None:
    """Writes a column of lines as gzip text files."""
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def fastq_line() -> Column:
    return F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value")


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.select(fastq_line())


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    fastq_lines(df).write.mode("overwrite").option("compression", compression).text(path)


def fasta_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(df: DataFrame, path: str) -> None:
    fasta_lines(df).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def tab_lines(df: DataFrame) -> DataFrame:
    """Columns as text, side by side with tabs."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def sam_to_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The first six fields and the sequence's, as text, of alignment lines with ten fields."""
    rows = read_lines(spark, path, comment="@").where(F.size("f") >= 10)
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq"]
    return rows.select(*[_at(i).alias(n) for i, n in zip((0, 1, 2, 3, 4, 5, 9), names)])


def gtf_to_bed(spark: SparkSession, path: str, feature: str, zero_based: bool = False) -> DataFrame:
    """(chrom, start_, end_, name, score, strand) of one feature's rows; start as it is unless zero_based."""
    rows = read_gtf(spark, path).where(F.col("feature") == feature)
    start = F.col("start_") - (1 if zero_based else 0)
    return rows.select("chrom", start.alias("start_"), "end_", F.coalesce(F.try_element_at("attributes", F.lit("gene_id")), F.lit(".")).alias("name"), F.lit(0).alias("score"), "strand")


def vcf_to_table(spark: SparkSession, path: str) -> DataFrame:
    """The first seven fields, as text."""
    rows = read_lines(spark, path).where(F.size("f") >= 7)
    return rows.select(*[_at(i).alias(n) for i, n in enumerate(["chrom", "pos", "id", "ref", "alt", "qual", "filter"])])


def fastq_to_fasta(records: DataFrame, path: str) -> int:
    """Writes records as FASTA; returns how many."""
    write_fasta(records, path)
    return records.count()


def write_matrix_market(entries: DataFrame, n_rows: int, n_cols: int, path: str) -> int:
    """Writes the entries that are not zero as one Matrix Market file, with their real number; returns it.

    The format is one ordered text, so the lines are sorted in Spark and
    written by one task.
    """
    some = entries.where("value <> 0")
    lines = to_matrix_market(some, n_rows, n_cols).orderBy("part", "row", "col")
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
    return some.count()


__all__ = [n for n in dir() if n.startswith(("read_", "write_", "parse_"))] + ["mtx_value"]
