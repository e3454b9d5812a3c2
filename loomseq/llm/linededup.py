"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash runs over the hashes of each two lines that follow each other; a
chunk begins where it is less than at the lines before and after. So whether a
chunk begins at a line depends on that line, the one before and two after, and
the chunks move with the text when lines are put in or taken out elsewhere.
Chunks have two lines at least: minima are two apart, a text's first two lines
are in one chunk and so are its last two. Chunks that occur more than once anywhere
are found by a 128-bit digest, and compared byte by byte with their first
occurrence; all other occurrences go. Only digests of all chunks and texts of
repeated chunks are shuffled by digest; the counts are merged before the
shuffle, and the first occurrence of a chunk that a third of all documents
share goes to as many parts as its other occurrences need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, settled

#: The rolling hash of two lines.
BASE, PRIME = 257, 1_000_003
#: Occurrences of a chunk that are compared in one part.
SPREAD = 256


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _chunks(text: Column) -> Column:
    """The chunks of a text, in order: struct(lines array, eligible boolean).

    A chunk is eligible if two of its lines at least have a character that is
    not white space.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    # a one-element array binds what is used repeatedly, so it is computed once
    def rolled(pair: Column) -> Column:
        hs, n = pair["hs"], F.size(pair["ls"])
        two = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(hs, i) * BASE + F.get(hs, i + 1)) % PRIME)  # the last is null
        return F.struct(pair["ls"].alias("ls"), two.alias("rs"))

    def cut(pair: Column) -> Column:
        rs, n = pair["rs"], F.size(pair["ls"])

        def ends(i: Column) -> Column:
            here = F.get(rs, i)
            return (i == n) | ((i >= 2) & (i < n - 1) & (here < F.get(rs, i - 1)) & (here < F.coalesce(F.get(rs, i + 1), F.lit(PRIME))))

        return F.struct(pair["ls"].alias("ls"), F.filter(F.sequence(F.lit(1), n), ends).alias("es"))

    hashed = F.transform(F.array(lines), lambda ls: F.struct(ls.alias("ls"), F.transform(ls, _line_hash).alias("hs")))

    def chunk(ls: Column, es: Column, j: Column) -> Column:
        start = F.when(j > 1, F.element_at(es, F.greatest(j - 1, F.lit(1)))).otherwise(0)
        part = F.slice(ls, start + 1, F.element_at(es, j) - start)
        return F.transform(F.array(part), lambda p: F.struct(p.alias("lines"), (F.size(F.filter(p, lambda x: x.rlike(r"\S"))) >= 2).alias("eligible")))

    found = F.transform(F.transform(F.transform(hashed, rolled), cut), lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p["es"])), lambda j: chunk(p["ls"], p["es"], j))))
    return F.element_at(found, 1)


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("chunk"), text).alias("h2")]


def repeated_chunks(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(k1, k2, gone): for each distinct row that has any, the numbers (from 1) of the chunks to remove.

    rows: (k1, k2, doc_id, text) as they are; distinct: (k1, k2, row, copies),
    each once, dealt by (k1, k2). Of equal chunks the first by (doc_id, place,
    k1, k2) stays, a null doc_id coming last.
    """
    every = rows.select("k1", "k2", "doc_id", F.posexplode(_chunks(F.col("text"))).alias("j", "chunk")).where("chunk.eligible")
    digests = every.select("k1", "k2", "doc_id", F.col("j") + 1, *_digests(F.array_join("chunk.lines", "\n"))).toDF("k1", "k2", "doc_id", "j", "h1", "h2")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "j", "k1", "k2")
    again = digests.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = settled(again)  # so that Spark can split the join on a chunk that many documents have
    # a chunk's first occurrence goes to as many parts as its other occurrences are dealt to
    parts = F.ceil(F.col("n") / SPREAD).cast("long")
    part = F.pmod(F.xxhash64("k1", "k2", "j"), parts)
    at = F.struct("j", "h1", "h2", (place == F.col("first")).alias("stays"), parts.alias("parts"), part.alias("part")).alias("at")
    asked = digests.join(again, ["h1", "h2"]).select("k1", "k2", at).groupBy("k1", "k2").agg(F.collect_set("at").alias("ats"))
    # copies is used, so that this reads the same exchange as the removal
    asked = distinct.where("copies > 0").join(asked, ["k1", "k2"]).select("k1", "k2", _chunks(F.col("row.text").cast("string")).alias("chunks"), "ats")
    one = asked.select("k1", "k2", "chunks", F.explode("ats").alias("at"))
    one = one.select("k1", "k2", "at.*", F.array_join(F.element_at("chunks", F.col("at.j"))["lines"], "\n").alias("chunk"))
    first = one.where("stays").select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("chunk").alias("first"))
    same = one.where("not stays").join(first, ["h1", "h2", "part"]).where("chunk = first")
    return same.groupBy("k1", "k2").agg(F.collect_set("j").alias("gone"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what is kept, and n_lines, n_removed (longs) added.

    Each row is a document of its own, whatever its doc_id (null included): of
    rows equal in all columns one keeps what a row without copies would, and
    the others lose all chunks of two lines. Null texts become empty; a
    document whose chunks all go gets an empty text; an empty table stays
    empty. Other columns stay as they are, but columns named n_lines or
    n_removed are replaced. n_lines counts the text's lines before, n_removed
    those removed. Whole texts are shuffled once, by row.
    """
    docs = docs.drop("n_lines", "n_removed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*row_key(docs, docs.columns), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # equal rows are merged before the shuffle; later steps read this one exchange
    distinct = docs.select(*row_key(docs, docs.columns), row).groupBy("k1", "k2").agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    left = distinct.where("copies > 0").join(repeated_chunks(rows, distinct), ["k1", "k2"], "left")
    # the first copy by what was found, the others without any chunk that counts
    left = left.select("row", "gone", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    away = lambda c, i: F.when(F.col("copy") > 1, c["eligible"]).otherwise(F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    chunks = F.transform(_chunks(F.col("row.text").cast("string")), lambda c, i: F.struct(c["lines"].alias("lines"), away(c, i).alias("away")))
    left = left.select("row", chunks.alias("chunks"))
    total = lambda cs: F.aggregate(cs, F.lit(0).cast("long"), lambda n, c: n + F.size(c["lines"]))
    kept = F.array_join(F.flatten(F.transform(F.filter("chunks", lambda c: ~c["away"]), lambda c: c["lines"])), "\n")
    return left.select(
        *[kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        total(F.col("chunks")).alias("n_lines"),
        total(F.filter("chunks", lambda c: c["away"])).alias("n_removed"),
    )


def op10_line_chunks(docs: DataFrame) -> DataFrame:
    found = remove_repeated_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
