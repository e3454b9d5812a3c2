"""Statistics over (group, idx, value) tables.

Places in an order come from cells: quantiles of the values, from a mergeable
sketch, cut the values into CELLS cells of about equal numbers of rows,
whatever their distribution; rows are counted by cell, and only rows of one
cell are ordered together. A value so common that it is several quantiles is
a cell of its own, cut again by the next column of the order. So no window
runs over a whole group; those over the cells' counts see CELLS of them a
group, and some more for each common value.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import normal_density
from ..sources.scratch import settled

#: Cells of a table's values; rows of a block of rolling windows.
CELLS, BLOCK = 1024, 8192


def _cuts(df: DataFrame, value: str, cells: int = CELLS) -> tuple[list[float], list[float]]:
    """Quantiles of a column that part it into cells, and the values among them that are more than one quantile."""
    at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), at, 10 * cells)).first()[0] or []
    return sorted(set(found)), sorted({x for x, y in zip(found, found[1:]) if x == y})


def _celled(df: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """df with the number of the cell of value: values below the first cut, from it to the next, and so on."""
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    given = df.withColumn(f"{name}_of", F.col(value).cast("double"))
    splits = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=splits, inputCol=f"{name}_of", outputCol=name, handleInvalid="keep").transform(given).drop(f"{name}_of")


def nth_values(df: DataFrame, by: list[str], places: dict[str, Column]) -> DataFrame:
    """(by, names): for each group the value at each place (from 0, of the sorted values; n is their count).

    Equal values are counted before they are ordered, by group and cell.
    """
    cuts, _ = _cuts(df, "value")
    counts = _celled(df.groupBy(*by, "value").agg(F.count("*").alias("c")), "value", cuts, "cell_")
    counts = settled(counts)
    cells = counts.groupBy(*by, "cell_").agg(F.sum("c").alias("in_"))
    cells = cells.withColumn("n", F.sum("in_").over(W.partitionBy(*by)))
    cells = cells.withColumn("from_", F.sum("in_").over(W.partitionBy(*by).orderBy("cell_")) - F.col("in_"))
    hit = lambda at, start, size: (at >= start) & (at < start + size)
    some = cells.where(reduce(lambda x, y: x | y, [hit(at, F.col("from_"), F.col("in_")) for at in places.values()]))
    up = W.partitionBy(*by, "cell_").orderBy("value")
    rows = counts.join(some, [*by, "cell_"]).withColumn("to", F.col("from_") + F.sum("c").over(up))
    return rows.groupBy(*by).agg(*[F.max(F.when(hit(at, F.col("to") - F.col("c"), F.col("c")), F.col("value"))).alias(n) for n, at in places.items()])


def _half(n: Column) -> Column:
    return F.floor(n / 2)


def upper_median(df: DataFrame, by: list[str]) -> DataFrame:
    return nth_values(df, by, {"median": _half(F.col("n"))})


def descriptive_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, count, mean, median, std_dev, variance, min, max, q1, q3) of value; population variance."""
    n = F.col("n")
    at = nth_values(df, by, {"low": _half(n - 1), "high": _half(n), "q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)})
    v = F.col("value")
    sums = df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    return sums.join(at, by).select(*by, "count", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "std_dev", "variance", "min", "max", "q1", "q3")


def pearson_correlation(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, r): 0 without variance."""
    c = df.groupBy(*by).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    both = F.col("sx") * F.col("sy")
    return c.select(*by, F.when(both > 0, F.col("c") / F.when(both > 0, both)).otherwise(F.lit(0.0)).alias("r"))


def _ranked(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """df with rank (from 1) in its group by (value, tie), and n, the group's size; both are numbers that a double can hold.

    before_ is the number of the group's rows before those that were ordered
    together with the row, so it tells them apart.
    """
    cuts, common = _cuts(df, value)
    rows = _celled(df, value, cuts, "cell_")
    if not common:
        rows = rows.withColumn("sub_", F.lit(0.0))
    else:
        # a common value begins its cell; what is above it in there comes after it
        hot = F.col(value).cast("double").isin(common)
        rows = _celled(rows, tie, _cuts(df, tie)[0], "sub_").withColumns({"cell_": 2 * F.col("cell_") + F.when(hot, 0).otherwise(1), "sub_": F.when(hot, F.col("sub_")).otherwise(0.0)})
    rows = settled(rows)
    group = W.partitionBy(*(by or [F.lit(0)]))
    sizes = rows.groupBy(*by, "cell_", "sub_").agg(F.count("*").alias("in_"))
    sizes = sizes.withColumns({"n": F.sum("in_").over(group), "before_": F.sum("in_").over(group.orderBy("cell_", "sub_")) - F.col("in_")}).drop("in_")
    at = F.row_number().over(W.partitionBy(*by, "cell_", "sub_").orderBy(value, tie))
    rows = rows.withColumn("at_", at).join(settled(sizes), [*by, "cell_", "sub_"])
    return rows.withColumn("rank", (F.col("at_") + F.col("before_")).cast("long")).drop("at_", "cell_", "sub_")


def rolling_correlation(df: DataFrame, by: list[str], window: int) -> DataFrame:
    """(by, idx, r): Pearson's r of each window of rows by idx that is full, at its first row; 0 without variance.

    Rows are numbered in their group and dealt in blocks, each with the
    window - 1 rows after it, so windows need no whole group in one task.
    """
    if window < 1:
        raise ValueError("window must be positive")
    block = max(BLOCK, 4 * window)
    rows = _ranked(df.select(*by, "idx", "x", "y"), by, "idx", "idx").withColumn("at", F.col("rank") - 1)
    own, left = F.floor(F.col("at") / block), F.col("at") % block
    both = F.when((left < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.select(*by, "idx", "x", "y", "at", F.explode(both).alias("block"))
    ahead = W.partitionBy(*by, "block").orderBy("at").rowsBetween(0, window - 1)
    over = {"size": F.count("*"), "sxy": F.covar_pop("x", "y"), "sx": F.stddev_pop("x"), "sy": F.stddev_pop("y")}
    rows = rows.withColumns({n: f.over(ahead) for n, f in over.items()}).where((F.col("size") == window) & (F.floor(F.col("at") / block) == F.col("block")))
    d = F.col("sx") * F.col("sy")
    return rows.select(*by, "idx", F.when(d > 0, F.col("sxy") / F.when(d > 0, d)).otherwise(F.lit(0.0)).alias("r"))


def bh_correction(df: DataFrame, method: str = "prefix") -> DataFrame:
    """(idx, value, q): p times n over rank, at most 1, and the running minimum from the least p.

    The standard procedure takes it from the greatest p: method='standard'.
    """
    rows = _ranked(df, [], "value", "idx").withColumn("q", F.col("value") * F.col("n") / F.col("rank"))
    up = method != "standard"
    # rows that were ranked together have one number of rows before them
    inside = W.partitionBy("before_").orderBy("rank" if up else F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    across = W.orderBy("before_" if up else F.col("before_").desc()).rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("before_").agg(F.min("q").alias("m")).withColumn("m", F.min("m").over(across))
    rows = rows.withColumn("here", F.min("q").over(inside)).join(tops, "before_")
    return rows.select("idx", "value", F.least(F.lit(1.0), F.col("here"), F.coalesce("m", F.lit(1.0))).alias("q"))


def mann_whitney_u(df: DataFrame) -> DataFrame:
    """One row (u_statistic, p_value) of rows (idx, value, is_a): ordinal ranks, a first among equals; the p-value is a density.

    Of rows with one value and one is_a only the number counts, so the table
    of values is ranked, not the rows.
    """
    cuts, _ = _cuts(df, "value")
    counts = df.groupBy("value").agg(F.count_if("is_a").alias("a"), F.count_if(~F.col("is_a")).alias("b"))
    counts = settled(_celled(counts, "value", cuts, "cell"))
    cells = counts.groupBy("cell").agg(F.sum(F.col("a") + F.col("b")).alias("in"))
    cells = cells.select("cell", (F.sum("in").over(W.orderBy("cell")) - F.col("in")).alias("from"))
    up = W.partitionBy("cell").orderBy("value")
    rows = counts.join(cells, "cell").withColumn("before", F.col("from") + F.sum(F.col("a") + F.col("b")).over(up) - F.col("a") - F.col("b"))
    # a rows at places before + 1 .. before + a
    of_a = F.col("a") * F.col("before") + F.col("a") * (F.col("a") + 1) / 2
    s = rows.agg(F.coalesce(F.sum(of_a), F.lit(0.0)).cast("double").alias("ra"), F.coalesce(F.sum("a"), F.lit(0)).cast("double").alias("na"), F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("nb"))
    ua = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    both = F.col("na") * F.col("nb")
    s = s.select("na", "nb", F.least(ua, both - ua).alias("u"))
    sd = F.sqrt(both * (F.col("na") + F.col("nb") + 1) / 12)
    z = F.when(sd > 0, (F.col("u") - both / 2) / F.when(sd > 0, sd)).otherwise(F.lit(0.0))
    return s.select(F.col("u").alias("u_statistic"), normal_density(z).alias("p_value"))


def _drawn(method: str, seed: int, *of: Column) -> Column:
    """A hash, never negative, of seed and columns; md5_60 can be had in other engines too."""
    if method == "md5_60":
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in of]).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 4)


def permutation_test(df: DataFrame, n: int, seed: int = 0, method: str = "xxhash64") -> DataFrame:
    """One row (observed_diff, p_value, n_permutations) of rows (idx, value, is_a).

    Permutation i calls as many rows a as there are members a: those with the
    least hashes of (seed, i, idx), which must be one row each. Rows are
    counted and summed by permutation and the hash's top bits before the
    shuffle; only rows of the cell where the last member falls are ordered.
    """
    size = df.agg(F.count_if("is_a").alias("na"), F.count("*").alias("n"), F.avg(F.when(F.col("is_a"), F.col("value"))).alias("ma"), F.avg(F.when(~F.col("is_a"), F.col("value"))).alias("mb"))
    na, count, ma, mb = size.first()
    seen = (ma or 0.0) - (mb or 0.0)
    trials = df.select("idx", "value", F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("trial")).where(F.lit(n > 0))
    hashed = trials.withColumn("h", _drawn(method, seed, F.col("trial"), F.col("idx"))).withColumn("cell", F.shiftright("h", 50))
    cells = hashed.groupBy("trial", "cell").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    up = W.partitionBy("trial").orderBy("cell")
    cells = settled(cells.withColumn("to", F.sum("c").over(up)))
    whole = cells.groupBy("trial").agg(F.sum("s").alias("total"), F.coalesce(F.sum(F.when(F.col("to") <= na, F.col("s"))), F.lit(0.0)).alias("a"))
    edge = cells.where((F.col("to") > na) & (F.col("to") - F.col("c") < na)).select("trial", "cell", (F.lit(na) - F.col("to") + F.col("c")).alias("more"))
    order = W.partitionBy("trial").orderBy("h", "idx")
    last = hashed.join(edge, ["trial", "cell"]).withColumn("nth", F.row_number().over(order)).where("nth <= more").groupBy("trial").agg(F.sum("value").alias("rest"))
    diff = whole.join(last, "trial", "left").withColumn("a", F.col("a") + F.coalesce("rest", F.lit(0.0)))
    diff = diff.select((F.col("a") / F.nullif(F.lit(na), F.lit(0)) - (F.col("total") - F.col("a")) / F.nullif(F.lit(count - na), F.lit(0))).alias("d"))
    hits = diff.agg(F.count_if(F.abs("d") >= abs(seen)).alias("hits"))
    p = F.col("hits") / float(n) if n > 0 else F.lit(math.nan)
    return hits.select(F.lit(seen).alias("observed_diff"), p.alias("p_value"), F.lit(n).cast("long").alias("n_permutations"))


def bootstrap_ci(df: DataFrame, n: int, confidence: float, seed: int = 0, method: str = "xxhash64") -> DataFrame:
    """One row (mean, ci_lower, ci_upper, confidence, n_bootstrap) of rows (idx dense from 0, value).

    Resample i draws row hash(seed, i, j) mod size for each j. The draws are
    shuffled once, to their rows, and summed by resample before the next
    shuffle.
    """
    if n < 1:
        raise ValueError("n must be positive")
    size, mean = df.agg(F.count("*"), F.avg("value")).first()
    if not size:
        raise ValueError("no rows")
    spark = df.sparkSession
    draws = spark.range(n * size).select(F.expr(f"id div {size}").alias("trial"), F.expr(f"id % {size}").alias("j"))
    draws = draws.select("trial", F.pmod(_drawn(method, seed, F.col("trial"), F.col("j")), F.lit(size)).alias("idx"))
    means = draws.join(df.select("idx", "value"), "idx").groupBy("trial").agg((F.sum("value") / size).alias("value"))
    alpha = (1 - confidence) / 2
    low, high = min(int(alpha * n), n - 1), min(int((1 - alpha) * n), n - 1)
    at = nth_values(means.select(F.lit(0).alias("g"), "value"), ["g"], {"ci_lower": F.lit(low), "ci_upper": F.lit(high)})
    return at.select(F.lit(mean).alias("mean"), "ci_lower", "ci_upper", F.lit(confidence).alias("confidence"), F.lit(n).cast("long").alias("n_bootstrap"))
