"""Rows that share a text: operators work on each text once and put its rows back as slices of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About the rows of a slice; two slices side by side are SLICE * SLICE rows of a result.
SLICE = 256
#: Tables up to so many rows are sent to all tasks; larger ones are joined by their keys. Results are the same.
SENT = 500_000


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to all tasks: few and small rows that become many stay apart."""
    return df.repartition(tasks(df), *by)


def sliced(df: DataFrame, by: str, keep: str) -> DataFrame:
    """(by, members): the rows of each by (null is one too) in slices, members being structs of keep."""
    n = df.groupBy(F.col(by).alias("by_")).agg(F.count("*").alias("n_"))
    rows = df.join(n, F.col(by).eqNullSafe(F.col("by_")))
    part = F.pmod(F.xxhash64(keep), F.ceil(F.col("n_") / SLICE))
    return rows.groupBy(by, part.alias("part_")).agg(F.collect_list(F.struct(keep)).alias("members")).drop("part_")


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def member(of: str, keep: str) -> Column:
    """One row for each of a slice's members; its keep is then in of."""
    return F.explode(F.col(of)[keep]).alias(of)


def once(value: Column) -> Column:
    """The value, worked out before its row becomes many; Spark may put off a plain column into the loop over them."""
    return F.explode(F.array(value))
