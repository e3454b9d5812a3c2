"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target in words. Whole passes over the source come first;
what is left of the target is a budget below the source's size. Documents are
counted by exact length, and a bounded-knapsack dynamic programme over these
counts says how many documents of each length to take once more. Which ones
is drawn by a seeded hash, among documents of one source and length.

The budget can be far larger than a table of reachable sums, so each length
first gives its even share less a margin, the longest lengths fill up until
SPAN words are left, and the programme fits these exactly where a subset does.
A source's counts (one row per distinct length) go to one task; documents
never do. A group of one source and length is ranked in CELLS cells by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, row_key, settled

SPAN, CELLS, SEED = 1 << 16, 1024, 42


def _longest_first(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    take = np.zeros_like(counts)
    for i in range(len(lengths) - 1, -1, -1):
        take[i] = min(int(counts[i]), budget // int(lengths[i]))
        budget -= int(take[i] * lengths[i])
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many of each length (positive, at most counts) to take, for a sum near budget and not above.

    lengths ascend. The sum is the budget itself wherever the last span words
    of it are a sum of what is left over; where lengths beyond span leave more
    than that, it is the better one of two greedy fits.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    share = max(0.0, budget - span) / total
    take = np.minimum(counts, np.floor(counts * share).astype(np.int64))
    rest = budget - int((lengths * take).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= span:
            break
        more = min(int(counts[i] - take[i]), (rest - span // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(lengths[i])
    if rest > span:
        # what is left of lengths is longer than rest - span / 2 each, so one fits at most, the longest
        fits = np.flatnonzero((take < counts) & (lengths <= rest))
        take[fits[-1:]] += 1
        return max(take, _longest_first(lengths, counts, budget), key=lambda x: int((lengths * x).sum()))
    # bounded knapsack: sums as bits of an integer, counts split in powers of two
    limit, reach = (1 << rest + 1) - 1, 1
    steps = []
    for i in range(len(lengths)):
        size = int(lengths[i])
        left, part = min(int(counts[i] - take[i]), rest // size), 1
        while left > 0:
            now = min(part, left)
            steps.append((reach, i, now))
            reach |= reach << now * size & limit
            left, part = left - now, part * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for before, i, now in reversed(steps):
        if not before >> at & 1:
            take[i] += now
            at -= now * int(lengths[i])
    return take


def _key(source) -> F.Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _running(df: DataFrame, order: list, values: dict[str, F.Column]) -> DataFrame:
    """df with sums of values over the rows before each, in an order without ties.

    Rows are dealt into ranges by the order; sums in a range are added to
    those of the ranges before, so a window over the whole table only has a
    row for each range.
    """
    rows = settled(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    within = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("range_").agg(*[F.sum(v).alias(f"{n}_") for n, v in values.items()])
    ranges = ranges.select("range_", *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_") for n in values])
    rows = rows.withColumns({n: F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}).join(ranges, "range_")
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_") for n in values}).drop("range_", *[f"{n}_" for n in values])


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(mix_key, source_size, target) for each source of (source, size).

    Sources by code point, null last, have the weights in turn and share
    budget times all sizes; a target stops at cap times its source's size,
    and the excess is shared by weight among the others until none is above.
    That is: the least of its cap and its weight times one common level. The
    table has one row per source, and may have many.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = _running(s, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    s = settled(s.withColumn("top", F.col("source_size") * F.lit(float(cap))))
    whole, weight = s.agg(F.sum("source_size") * float(budget), F.sum("weight")).first()
    s = _running(s.withColumn("fill", F.col("top") / F.col("weight")), ["fill", "nth"], {"below": F.col("top"), "passed": F.col("weight")})
    # at the level where the sources before are full; the highest that doesn't fill its own source holds
    level = (F.lit(whole) - F.col("below")) / (F.lit(weight) - F.col("passed"))
    s = settled(s)
    found = s.agg(F.max(F.when(level * F.col("weight") <= F.col("top"), level))).first()[0]
    target = F.col("top") if found is None else F.least("top", F.lit(found) * F.col("weight"))
    return s.select(_key(F.col("source")).alias("mix_key"), "source_size", target.alias("target"))


def _plan(key, rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("size").to_numpy())
    lengths, counts = rows.column("size").to_numpy()[order], rows.column("n").to_numpy()[order]
    target, whole = rows.column("target")[0].as_py(), rows.column("source_size")[0].as_py()
    passes = min(int(target // whole), 2) if whole else 0
    some = lengths > 0
    more = np.zeros(len(lengths), np.int64)
    more[some] = fit_counts(lengths[some], counts[some], round(target - passes * whole))
    return pa.table([rows.column("mix_key"), pa.array(lengths), pa.array(np.full(len(lengths), passes, np.int64)), pa.array(more)], ["mix_key", "mix_size", "passes", "more"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target and copies added.

    copies is how often the mix takes the row: the passes over its source,
    and once more if drawn. A null size is 0; a row of size 0 takes nothing
    from the budget and is copied by the passes only. Rows are drawn by a
    hash of all their columns, so rows of one doc_id, or none, are drawn as
    rows of their own, and of rows equal in all columns as many as the plan
    says. Reruns draw the same rows. Columns named like the new ones are
    replaced, others stay; an empty table gives an empty one.
    """
    docs = docs.drop("source_size", "target", "copies")
    size = F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))
    targets = settled(source_targets(docs.select("source", size.alias("size")), weights, budget, cap))
    k1, k2 = row_key(docs, docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, _key(F.col("source")).alias("mix_key"), size.alias("mix_size"), F.xxhash64(F.lit(seed), "doc_id", k1).alias("mix_hash"), k2.alias("mix_tie"))
    rows = rows.withColumn("mix_cell", F.shiftrightunsigned("mix_hash", 40) % CELLS)
    cells = settled(rows.groupBy("mix_key", "mix_size", "mix_cell").agg(F.count("*").alias("n")))
    counts = cells.groupBy("mix_key", F.col("mix_size").alias("size")).agg(F.sum("n").alias("n")).join(targets, "mix_key")
    plan = counts.groupBy("mix_key").applyInArrow(lambda key, rows: _plan(key, rows), "mix_key string, mix_size long, passes long, more long")
    before = W.partitionBy("mix_key", "mix_size").orderBy("mix_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, ["mix_key", "mix_size"])
    cells = cells.select("mix_key", "mix_size", "mix_cell", "passes", (F.col("more") - F.col("before")).alias("quota")).join(targets, "mix_key")
    inside = W.partitionBy("mix_key", "mix_size", "mix_cell").orderBy("mix_hash", "mix_tie")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(cells, ["mix_key", "mix_size", "mix_cell"])
    copies = F.col("passes") + F.when(F.col("nth") <= F.col("quota"), 1).otherwise(0)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "source_size", "target", copies.cast("long").alias("copies"))


def op1_mix_knapsack(docs: DataFrame) -> DataFrame:
    sized = settled(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.col("text")).alias("text_hash")))
    found = mix(sized)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
