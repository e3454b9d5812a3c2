"""K-mer tables and joins over (idx, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import distinct_kmers, kmers
from ..functions.sequence import ratio, reverse_complement
from ..sources.scratch import settled
from .copies import SENT, once, sent, sliced, spread, tasks

#: About the pairs that a task counts at once; more of them don't fit its memory and go to disk.
PAIRS = 500_000
#: Queries are dealt to so many tasks for that, at most.
MOST_TASKS = 10_000


def tokenise(df: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(idx, kmer): a row for each window; none for shorter sequences."""
    if k < 1:
        raise ValueError("k must be positive")
    s = F.upper("seq")
    rows = df.select("idx", s.alias("s"), *([reverse_complement(s).alias("r")] if canonical else [])).where(F.length("s") >= k)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("s") - (k - 1))).alias("i"))
    own = F.substring(F.col("s"), F.col("i"), F.lit(k))
    # the window's reverse complement is a window of the whole one, from the other end
    other = F.substring(F.col("r"), F.length("s") - F.col("i") - (k - 2), F.lit(k))
    return rows.select("idx", (F.least(own, other) if canonical else own).alias("kmer"))


def kmer_counts(df: DataFrame, k: int, canonical: bool = False, strict: bool = False) -> DataFrame:
    """(kmer, n) over all sequences. With strict, one that is shorter than k is an error."""
    if strict:
        short = F.octet_length("seq") < k
        df = df.withColumn("seq", F.when(short, F.raise_error(F.lit(f"a sequence is shorter than {k}")).cast("string")).otherwise(F.col("seq")))
    return tokenise(df, k, canonical).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_counts_by_sequence(df: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    return tokenise(df, k, canonical).groupBy("idx", "kmer").agg(F.count("*").alias("n"))


def kmer_spectrum(df: DataFrame, k: int) -> DataFrame:
    """(multiplicity, n): how many distinct k-mers come that often."""
    return kmer_counts(df, k).groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("n"))


def _common(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    x = tokenise(a, k).distinct().select(F.col("idx").alias("i"), "kmer")
    y = tokenise(b, k).distinct().select(F.col("idx").alias("j"), "kmer")
    return x.join(y, "kmer")


def _sizes(df: DataFrame, k: int, key: str, name: str) -> DataFrame:
    return df.select(F.col("idx").alias(key), F.size(distinct_kmers("seq", k)).cast("long").alias(name))


def shared_kmers(a: DataFrame, b: DataFrame, k: int, triangle: bool = False) -> DataFrame:
    """(i, j, both): distinct k-mers that two sequences share, for pairs that share any."""
    rows = _common(a, b, k)
    return (rows.where("i < j") if triangle else rows).groupBy("i", "j").agg(F.count("*").alias("both"))


def jaccard_pairs(df: DataFrame, k: int) -> DataFrame:
    """(i, j, jaccard) for i < j that share a k-mer; all other pairs are 0."""
    n = _sizes(df, k, "i", "ni")
    m = n.toDF("j", "nj")
    rows = shared_kmers(df, df, k, triangle=True).join(n, "i").join(m, "j")
    return rows.select("i", "j", (F.col("both") / (F.col("ni") + F.col("nj") - F.col("both"))).alias("jaccard"))


def symmetric(pairs: DataFrame, value: str, diagonal: DataFrame) -> DataFrame:
    """(i, j, value) both ways from pairs i < j, with a diagonal (i, j, value)."""
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value)
    return pairs.select("i", "j", value).union(back).union(diagonal.select("i", "j", value))


def _shown(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def _texts(df: DataFrame) -> DataFrame:
    """(idx, seq, n): the different sequences of (idx, seq), each numbered by its least idx, and how many rows have it."""
    return df.groupBy(F.upper("seq").alias("seq")).agg(F.min("idx").alias("idx"), F.count("*").alias("n"))


def jaccard_matrix(df: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(i, j, jaccard) of the dense matrix's entries that are not 0, 1 on the diagonal; rounded to digits, if given.

    K-mers are compared between different sequences; their rows are put back
    at the end, when a pair of slices becomes its rows without a shuffle.
    """
    one = _texts(df)
    filled = F.size(distinct_kmers("seq", k)) > 0
    own = one.where(filled).select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("jaccard"))
    pairs = symmetric(jaccard_pairs(one, k), "jaccard", own).withColumn("jaccard", _shown(F.col("jaccard"), digits))
    rows = df.select(F.col("idx").alias("key"), F.upper("seq").alias("seq")).join(one, "seq").select("idx", "key")
    slices = sliced(rows, "idx", "key")
    wide = spread(pairs.join(slices.toDF("i", "x"), "i")).join(slices.toDF("j", "y"), "j")
    rows = wide.select(F.explode("x.key").alias("i"), "y", "jaccard").select("i", F.explode("y.key").alias("j"), "jaccard")
    # a sequence without k-mers is like itself only
    bare = df.where(~F.coalesce(filled, F.lit(False))).select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("jaccard"))
    return rows.union(bare)


def _sets(df: DataFrame, k: int, others: int = 0) -> DataFrame:
    """(idx, kmers): each idx's distinct k-mers, dealt by idx, to tasks of about PAIRS pairs with so many others."""
    parts = min(-(-df.count() * others // PAIRS), MOST_TASKS) if others else 0
    rows = df.select("idx", "seq").repartition(max(tasks(df), parts), "idx").groupBy("idx").agg(F.collect_list("seq").alias("seqs"))
    return rows.select("idx", F.array_distinct(F.flatten(F.transform("seqs", lambda s: kmers(s, k)))).alias("kmers"))


def marker_gene_match(queries: DataFrame, markers: DataFrame, k: int, threshold: float, digits: int | None = None) -> DataFrame:
    """(idx, marker, jaccard): markers (idx, name, seq) at least so similar, for each query; rounded to digits, if given.

    Each of the markers' different sequences is compared once; its markers
    are put back at the end. If the k-mers of these are few, a query's pairs
    are counted and become its rows in one task, without a shuffle.
    """
    one = settled(_texts(markers).withColumnRenamed("idx", "j").select("*", distinct_kmers("seq", k).alias("kmers")))
    sizes = one.agg(F.sum(F.size("kmers")), F.sum("n"), F.count("*")).first()
    found = sent(one.select("j", F.size("kmers").alias("nj"), F.explode("kmers").alias("kmer")), sizes[0] or 0)
    apart = (sizes[0] or 0) <= SENT and threshold > 0
    own = _sets(queries, k, sizes[2] if apart else 0).select("idx", F.size("kmers").alias("ni"), "kmers")
    both = own.select("idx", "ni", F.explode("kmers").alias("kmer")).join(found, "kmer").groupBy("idx", "ni", "j", "nj").agg(F.count("*").alias("both"))
    hits = both.select("idx", "j", (F.col("both") / (F.col("ni") + F.col("nj") - F.col("both"))).alias("jaccard"))
    if threshold <= 0:
        none = queries.select("idx").distinct().crossJoin(one.select("j")).join(hits.select("idx", "j"), ["idx", "j"], "left_anti")
        hits = hits.union(none.select("idx", "j", F.lit(0.0)))
    hits = hits.where(F.col("jaccard") >= threshold).select("idx", "j", once(_shown(F.col("jaccard"), digits)).alias("jaccard"))
    names = markers.select("name", F.upper("seq").alias("seq")).join(one.select("j", F.col("seq").alias("seq_")), F.col("seq").eqNullSafe(F.col("seq_"))).select("j", "name")
    back = sliced(names, "j", "name").select("j", F.col("members.name").alias("names"))
    rows = (hits if apart else spread(hits, "idx")).join(sent(back, sizes[1] or 0), "j")
    return rows.select("idx", F.explode("names").alias("marker"), "jaccard")


def kmer_classify(queries: DataFrame, reference: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(idx, taxon, score): a taxon's part of all hits of a query's distinct k-mers in reference (kmer, taxon); rounded to digits, if given.

    Taxa with the same k-mers, told by their number and 128 bits of hashes,
    are looked up as one, the first; they are put back at the end.
    """
    rows = reference.groupBy("kmer", "taxon").agg(F.count("*").alias("c"))
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "kmer", "c"))
    taxa = settled(rows.groupBy("taxon").agg(F.struct(F.count("*"), bits(1), bits(2)).alias("like")))
    heads = taxa.groupBy("like").agg(F.min("taxon").alias("head"), F.count("*").alias("m"))
    found = settled(rows.join(heads, F.col("taxon").eqNullSafe(F.col("head"))).select("kmer", "head", "c", "m"))
    hits = _sets(queries, k).select("idx", F.explode("kmers").alias("kmer")).join(sent(found, found.count()), "kmer")
    # each query's rows are still in one task unless found was too large to be sent
    hits = hits.groupBy("idx", "head").agg(F.sum("c").alias("n"), F.first("m").alias("m"))
    total = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("idx"))
    scores = hits.select("idx", F.col("head").alias("of"), (F.col("n") / total).alias("score")).select("idx", "of", once(_shown(F.col("score"), digits)).alias("score"))
    back = sliced(taxa.join(heads, "like").select("head", "taxon"), "head", "taxon")
    rows = spread(scores, "idx").join(sent(back, taxa.count()), F.col("of").eqNullSafe(F.col("head")))
    return rows.select("idx", F.explode("members.taxon").alias("taxon"), "score")


def estimate_abundance(query: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: the part of the reference's distinct k-mers (kmer) that the query has."""
    keys = reference.select("kmer").distinct()
    hits = keys.join(query.select("kmer").distinct().withColumn("hit", F.lit(True)), "kmer", "left")
    return hits.agg(ratio(F.count("hit"), F.count("*")).alias("abundance"))
