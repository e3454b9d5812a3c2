"""A training corpus in stages, each of which applies one operator of loomseq.llm.

Language ID, line dedup, near-duplicates, source mixing, tokens. Each stage
takes (spark, docs, sf_dir), works on every row that its predecessor kept and
returns the columns of documents, the last one its tokens' digests. Every
stage's rows are written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import bpe, langid, linededup, mixing, simhash
from loomseq.llm.common import delete_path, n_words, shared_path, table

#: A document whose language is less sure than this goes, and so do those without letters.
LEAST_SCORE = 0.5
#: Words of a shingle in the near-duplicate stage, and the least similarity of duplicates.
SHINGLE, SIMILAR = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: no letters, or no language with half of the posterior.

    So null and empty texts go; repeated rows and ids stay rows of their own.
    An empty table stays empty.
    """
    training = docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang")
    aside = {c: f"own_{c}" for c in docs.columns if c in ("lang_pred", "score")}  # names that the operator puts
    found = langid.identify(docs.withColumnsRenamed(aside), training)
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated chunks of lines; a document of which nothing is left goes.

    Null texts stay as empty ones, repeated rows lose what the first one
    keeps, and n_chars follows a changed text. An empty table stays empty.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    left = linededup.remove_repeated_lines(docs.select("doc_id", "text", others.alias("row"))).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return left.select(*[own[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the least by (doc_id, text), null ids last.

    Rows are told apart by doc_id and text, so different texts of one doc_id
    are different documents; rows equal in both are one. Null and wordless
    texts are one class. An empty table gives an empty one.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "t").alias("key")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", simhash.text_key(F.col("text")).alias("t"))
    rows = rows.select(key, "t", "row").groupBy("key", "t").agg(F.first("row").alias("row"))
    stay = simhash.similar_components(docs, SHINGLE, SIMILAR).where("stays").select(key, "t")
    return rows.join(stay, ["key", "t"], "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the sources' target weights; one taken twice is two rows.

    A null source is a source; null texts have no words. Repeated rows are
    drawn one by one. An empty table stays empty.
    """
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"), n_words(F.col("text")).alias("size"))
    drawn = mixing.mix(rows).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: tokens and digests of each row.

    Null is the empty text; repeated rows stay, and an empty table stays empty.
    """
    return bpe.op5_byte_bpe(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Fitted models and hash decisions have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is deleted then."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            delete_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
