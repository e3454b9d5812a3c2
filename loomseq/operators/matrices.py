"""Count matrices in long form (row, col, value), cells and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_barcode_matrix(entries: DataFrame, features: DataFrame, barcodes: DataFrame) -> DataFrame:
    """(row, col, feature, barcode, value): entries with the names of dimensions (idx, name)."""
    f = features.select(F.col("idx").alias("row"), F.col("name").alias("feature"))
    b = barcodes.select(F.col("idx").alias("col"), F.col("name").alias("barcode"))
    return entries.join(f, "row", "left").join(b, "col", "left").select("row", "col", "feature", "barcode", "value")


def mtx_value(value) -> F.Column:
    """A number as text, without .0 for whole ones."""
    v = F.col(value) if isinstance(value, str) else value
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def to_matrix_market(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(part, row, col, line): the lines of a Matrix Market file in the order of part, row, col; entries as given, from 1."""
    head = entries.agg(F.count("*").alias("n")).select(
        F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("%%MatrixMarket matrix coordinate real general").alias("line")), F.struct(F.lit(1).alias("part"), F.concat(F.lit(f"{n_rows} {n_cols} "), F.col("n").cast("string")).alias("line")))).alias("x")
    )
    head = head.select("x.part", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), "x.line")
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), mtx_value("value"))
    return head.union(entries.select(F.lit(2), F.col("row").cast("long"), F.col("col").cast("long"), line))


def merge_count_matrices(matrices: list[tuple[DataFrame, int]]) -> DataFrame:
    """(row, col, value): matrices (rows, number of columns) side by side; rows beyond the first matrix's go, missing ones are 0 and absent."""
    first, offset = matrices[0]
    rows = first.select("row").distinct()
    out = None
    for df, width in matrices:
        part = (df if out is None else df.join(rows, "row", "left_semi")).select("row", (F.col("col") + offset if out is not None else F.col("col")).alias("col"), "value")
        if out is None:
            out, offset = part, width
        else:
            out, offset = out.union(part), offset + width
    return out


def cell_qc(cells: DataFrame) -> DataFrame:
    """One row from (counts, genes) per cell."""
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    return cells.agg(
        F.count("*").alias("n_cells"),
        zero(F.sum("counts")).alias("total_counts"),
        zero(F.sum("genes")).alias("total_genes"),
        zero(F.avg("counts"), "double").alias("avg_counts_per_cell"),
        zero(F.avg("genes"), "double").alias("avg_genes_per_cell"),
        zero(F.max("counts")).alias("max_counts"),
        zero(F.min("counts")).alias("min_counts"),
    )


def demux_tags(tags: DataFrame, threshold: float) -> DataFrame:
    """(cell, tag): the tag with the greatest value above max(0, threshold), first by number among equals, else unknown.

    tags: (cell, tag_idx, tag, value).
    """
    hit = F.when(F.col("value") > max(0.0, threshold), F.struct("value", (-F.col("tag_idx")).alias("minus"), "tag"))
    return tags.groupBy("cell").agg(F.max(hit).alias("best")).select("cell", F.coalesce("best.tag", F.lit("unknown")).alias("tag"))


def count_guides(assignments: DataFrame, column: str = "guide") -> DataFrame:
    return assignments.groupBy(column).agg(F.count("*").alias("n"))


def classify_nucleosome_free(fragments: DataFrame, most: int) -> DataFrame:
    """One row: fragments (length) up to most, and longer ones."""
    return fragments.agg(F.count_if(F.col("length") <= most).alias("nucleosome_free"), F.count_if(F.col("length") > most).alias("nucleosomal"))
