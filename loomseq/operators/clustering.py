"""Greedy first-fit clustering, which depends on the order of rows (idx), in rounds over links.

Each item joins the first earlier representative that it is linked to, and is
one itself where there is none. So an item is decided as soon as it has an
earlier representative, or all its earlier neighbours are members: each round
decides, in all groups at once, at least the first undecided item of every
chain, and for items in no special order nearly all within a few rounds. No
task holds a group; a round is joins and aggregates over the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import distinct_kmers
from ..sources.scratch import settled


def first_fit(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item, head): the representative that each item joins; a representative's is itself.

    items: (item), numbers that are their order; links: (item, other) of
    linked items, other < item.
    """
    links = settled(links)
    heads = settled(items.join(links.select("item").distinct(), "item", "left_anti"))
    left = links  # of undecided items, to others that may yet be representatives
    while True:
        joined = settled(left.join(heads.select(F.col("item").alias("other")), "other", "left_semi").select("item").distinct())
        undecided = left.join(joined, "item", "left_anti")
        waiting = settled(undecided.join(joined.select(F.col("item").alias("other")), "other", "left_anti"))
        new = undecided.select("item").distinct().join(waiting.select("item").distinct(), "item", "left_anti")
        heads, left = settled(heads.union(new)), waiting
        if left.isEmpty():
            break
    own = heads.select("item", F.col("item").alias("head"))
    found = links.join(heads.select(F.col("item").alias("other")), "other", "left_semi").join(heads, "item", "left_anti")
    return own.union(found.groupBy("item").agg(F.min("other").alias("head")))


def _near_umis(umis: DataFrame, by: list[str], most: int) -> DataFrame:
    """(item, other): pairs of distinct UMIs of a group within most edits, the later first.

    One of most + 1 pieces of either is in the other, moved by most places at most.
    """
    pieces = most + 1
    n = F.length("umi")
    edge = lambda size, k: F.floor(size * k / pieces).cast("int")
    own = F.array(*[F.struct(F.lit(k).alias("k"), F.substring(F.col("umi"), edge(n, k) + 1, edge(n, k + 1) - edge(n, k)).alias("part")) for k in range(pieces)])
    cut = umis.select(*by, "item", "umi", n.alias("size"), F.explode(own).alias("p")).select(*by, "item", "umi", "size", "p.*")
    other = umis.select(*by, F.col("item").alias("other"), F.col("umi").alias("other_umi"), F.explode(F.sequence(F.greatest(n - most, F.lit(0)), n + most)).alias("size"))
    moved = []
    for k in range(pieces):
        at, end = edge(F.col("size"), k), edge(F.col("size"), k + 1)
        for s in range(-most, most + 1):
            moved.append(F.when(at + s >= 0, F.struct(F.lit(k).alias("k"), F.substring(F.col("other_umi"), at + s + 1, end - at).alias("part"))))
    found = F.array_distinct(F.filter(F.array(*moved), lambda x: x.isNotNull()))
    theirs = other.select(*by, "other", "other_umi", "size", F.explode(found).alias("p")).select(*by, "other", "other_umi", "size", "p.*")
    pairs = cut.join(theirs, [*by, "size", "k", "part"]).where("item <> other and levenshtein(umi, other_umi) <= " + str(most))
    return pairs.select(F.greatest("item", "other").alias("item"), F.least("item", "other").alias("other")).distinct()


def umi_collapse(df: DataFrame, by: list[str], max_distance: int) -> DataFrame:
    """(by, representative, members): each UMI joins the first group whose first UMI is within max_distance edits.

    Rows (by, idx, umi) by idx, which is unique. Equal UMIs always share a
    group, so the distinct ones are clustered, by their first idx. Null UMIs
    and groups take no part in any.
    """
    rows = df.dropna(subset=["umi", *by])
    umis = settled(rows.groupBy(*by, "umi").agg(F.min("idx").alias("item")))
    found = first_fit(umis.select("item"), _near_umis(umis, by, max_distance))
    named = umis.join(found, "item").join(umis.select(F.col("item").alias("head"), F.col("umi").alias("representative")), "head")
    members = rows.join(named.select(*by, "umi", "head", "representative"), [*by, "umi"])
    return members.groupBy(*by, "head", "representative").agg(F.sort_array(F.collect_list("idx")).alias("members")).drop("head")


def umi_dedup(df: DataFrame, by: list[str], max_edit_distance: int) -> DataFrame:
    return umi_collapse(df, by, max_edit_distance)


def greedy_cluster(df: DataFrame, by: list[str], threshold: float, k: int) -> DataFrame:
    """(by, representative, members): each sequence joins the first cluster whose first sequence has that Jaccard index of k-mers.

    Rows (by, idx, seq) by idx, which is unique. Links are found by a join on
    k-mers in each group. Sequences without k-mers are like no other; with a
    threshold of 0 or less a group is one cluster.
    """
    rows = df.dropna(subset=["seq", *by])
    if threshold <= 0:
        found = rows.groupBy(*by).agg(F.min("idx").alias("head")).join(rows.select(*by, F.col("idx").alias("item")), by).select("item", "head")
    else:
        words = settled(rows.select(*by, "idx", F.explode(distinct_kmers("seq", k)).alias("kmer")))
        sizes = words.groupBy("idx").agg(F.count("*").alias("n"))
        other = words.select(*by, F.col("idx").alias("other"), "kmer")
        both = words.join(other, [*by, "kmer"]).where("other < idx").groupBy("idx", "other").agg(F.count("*").alias("both"))
        both = both.join(sizes, "idx").join(sizes.toDF("other", "m"), "other")
        links = both.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= threshold).select(F.col("idx").alias("item"), "other")
        found = first_fit(rows.select(F.col("idx").alias("item")), links)
    named = rows.select(*by, "idx", "seq").join(found, F.col("idx") == F.col("item")).select(*by, "idx", "head")
    heads = rows.select(F.col("idx").alias("head"), F.col("seq").alias("representative"))
    return named.join(heads, "head").groupBy(*by, "head", "representative").agg(F.sort_array(F.collect_list("idx")).alias("members")).drop("head")
