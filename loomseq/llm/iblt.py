"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A document's paragraphs are its lines, and parts of lines: a line is also cut
after a sentence whose follower begins with one of a few letters, so cuts move
with the text. The distinct non-empty ones have 64-bit digests. Each digest
goes into one cell of each of three subtables; a cell keeps a count, the XOR
of the digests, and the XOR of their checks. Sketches of one size subtract cell
by cell, and peeling the difference recovers the digests that only one version
has: a cell with count 1 or -1 whose check fits its digest holds just that
digest, which then leaves its other two cells. A round peels one subtable,
where each digest has one cell, so a round is one aggregate.

A document's fingerprint is its sketch of CELLS cells a subtable. Two versions
are compared by their fingerprints; only pairs whose difference doesn't peel
are sketched again, GROW times larger, and so on. All sketches of a row stay
in one partition, so cells are summed without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled

SUBTABLES = 3
#: Cells of a subtable in the fingerprint, how much larger a retry's are, and rounds of peeling before one.
CELLS, GROW, ROUNDS = 16, 4, 12
#: Rows in a range of ids within which the next document is found, ranges at most, and digests in a partition.
RANGE_ROWS, RANGES, PART_DIGESTS = 1024, 1 << 15, 300_000
#: Where a line is cut: at blanks between these characters.
CUT = r"\n|(?<=[.!?]) (?=[A-Ca-c])"


def paragraph_digests(text: Column) -> Column:
    parts = F.filter(F.split(text, CUT, -1), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit((1 << 32) - 1))


def _cell(key: Column, table: int, size: int) -> Column:
    return F.lit(table * size).cast("long") + F.pmod(F.xxhash64(key, F.lit(table)), F.lit(size))


def _cells(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, cell, n, key, chk): sketches of rows (by, key)."""
    at = F.explode(F.array(*[_cell(F.col("key"), t, size) for t in range(SUBTABLES)]))
    rows = rows.select(*by, "key", at.alias("cell"))
    return rows.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor(_check(F.col("key"))).alias("chk"))


def _peel(cells: DataFrame, by: list[str], table: int, size: int) -> DataFrame:
    """One round: pure cells of a subtable become found digests and leave the other subtables."""
    key, here = F.col("key"), F.col("cell").between(table * size, table * size + size - 1)
    pure = (F.col("found") == 0) & here & (F.abs("n") == 1) & (F.col("chk") == _check(key)) & (F.col("cell") == _cell(key, table, size))

    def row(found, cell, n, k, chk):
        return F.struct(found.cast("long").alias("found"), cell.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("key"), chk.alias("chk"))

    zero = F.lit(0).cast("long")
    left = [row(zero, _cell(key, t, size), -F.col("n"), key, F.col("chk")) for t in range(SUBTABLES) if t != table]
    out = F.when(pure, F.array(row(F.lit(1), key, F.col("n"), zero, zero), *left)).otherwise(F.array(row(F.col("found"), F.col("cell"), F.col("n"), key, F.col("chk"))))
    rows = cells.select(*by, F.explode(out).alias("x")).select(*by, "x.*")
    summed = rows.groupBy(*by, "found", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return summed.where("found = 1 or n <> 0 or key <> 0 or chk <> 0")


def _parts(docs: DataFrame, versions: list[str]) -> int:
    """A number of partitions by how many digests there are."""
    total = docs.agg(F.sum(sum([F.size(v) for v in versions], F.lit(0)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_DIGESTS))


def _sketched(docs: DataFrame, versions: list[str], size: int, parts: int, more: list[str] | None = None) -> DataFrame:
    """(rid, more, version, cell, n, key, chk): the cells that are not empty, for each version (a column of digests) by its place."""
    by = ["rid", *(more or [])]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("version"), F.col(v).alias("keys")) for i, v in enumerate(versions)]))
    rows = docs.repartition(parts, "rid").select(*by, each.alias("v")).select(*by, "v.version", F.explode("v.keys").alias("key"))
    return _cells(rows, [*by, "version"], size)


def differences(docs: DataFrame, first: str, others: list[str], parts: int) -> DataFrame:
    """(rid, pair, only_a, only_b): the digests that the first version and each other one have alone.

    docs: (rid, ...) with columns of distinct digests; pair is the place in
    others. The sketches of CELLS cells are subtracted and peeled; pairs that
    fail have larger ones, until none fails. Equal versions are absent.
    """
    versions, by = [first, *others], ["rid", "pair"]
    todo, size, done = docs.select("rid", *versions, F.array(*[F.lit(i) for i in range(len(others))]).alias("pairs")), CELLS, None
    while True:
        # only versions in a pair that is still wanted
        todo = todo.select("rid", "pairs", first, *[F.when(F.array_contains("pairs", i), F.col(v)).otherwise(F.array().cast("array<bigint>")).alias(v) for i, v in enumerate(others)])
        cells = _sketched(todo, versions, size, parts, ["pairs"])
        signed = lambda pair, sign: F.struct(pair.alias("pair"), F.lit(sign).alias("sign"))
        signs = F.when(F.col("version") == 0, F.transform("pairs", lambda p: signed(p, 1))).otherwise(F.array(signed(F.col("version") - 1, -1)))
        cells = cells.select("rid", "cell", "n", "key", "chk", F.explode(signs).alias("s"))
        cells = cells.groupBy("rid", F.col("s.pair").alias("pair"), "cell").agg(F.sum(F.col("s.sign") * F.col("n")).alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
        cells = cells.where("n <> 0 or key <> 0 or chk <> 0").withColumn("found", F.lit(0).cast("long"))
        for i in range(ROUNDS):
            cells = _peel(cells, by, i % SUBTABLES, size)
        only = lambda n: F.collect_list(F.when((F.col("found") == 1) & (F.col("n") == n), F.col("cell")))
        # a digest that was found more than once is no clean peeling either
        left = F.count_if((F.col("found") == 0) | (F.abs("n") != 1))
        out = settled(cells.groupBy(*by).agg(only(1).alias("only_a"), only(-1).alias("only_b"), left.alias("left")))
        fine = out.where("left = 0").drop("left")
        done = fine if done is None else done.union(fine)
        failed = out.where("left > 0").groupBy("rid").agg(F.collect_list("pair").alias("pairs"))
        if failed.isEmpty():
            return done
        todo, size = todo.drop("pairs").join(failed, "rid"), size * GROW


def _base64(digits: Column) -> Column:
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def _hexed(x: Column, n: int) -> Column:
    return F.substring(F.lpad(F.hex(x), 16, "0"), 17 - n, n)


def sketches(docs: DataFrame, versions: list[str], parts: int) -> DataFrame:
    """(rid, version, fingerprint): sketches of each version of rows (rid, ...), as base64; none for a version without digests.

    Each of the SUBTABLES * CELLS cells is 16 bytes: count (4), digest XOR (8), check XOR (4).
    """
    cells = _sketched(docs.select("rid", *versions), versions, CELLS, parts)
    own = F.struct("cell", F.concat(_hexed(F.col("n"), 8), _hexed(F.col("key"), 16), _hexed(F.col("chk"), 8)).alias("at"))
    held = cells.groupBy("rid", "version").agg(F.map_from_entries(F.collect_list(own)).alias("held"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBTABLES * CELLS - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit("0" * 32)))
    return held.select("rid", "version", _base64(F.array_join(every, "")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next by doc_id; the last row's next is the first.

    Null ids come last; rows of one id are ordered by their text's hash. Ids
    are dealt into ranges of about equal numbers of rows, by quantiles of a
    mergeable sketch, and ordered in them; an id that is several quantiles,
    and null, is cut again by the hash. A range's last row gets the first text
    of the next range that has rows; a window over one row for each range
    finds that.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"h": F.xxhash64("text"), "at": F.col("doc_id").cast("double")})
    n = rows.count()
    cells = max(2, min(RANGES, n // RANGE_ROWS))
    cuts = rows.agg(F.percentile_approx("at", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 8 * cells)).first()[0] or []
    hot = sorted({x for x, y in zip(cuts, cuts[1:]) if x == y})
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="cell", handleInvalid="keep").transform(rows) if cuts else rows.withColumn("cell", F.lit(0.0))
    by_hash = F.shiftright("h", 56) + 128
    cut_again = F.col("doc_id").isNull() | (F.col("at").isin(hot) if hot else F.lit(False))
    part = F.coalesce(F.col("cell"), F.lit(0.0)).cast("long") * 512 + F.when(cut_again, by_hash).otherwise(256)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(splits) * 512) + by_hash).otherwise(part)
    rows = rows.select("doc_id", "text", "h", part.cast("long").alias("part"))
    inside = W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "h", "text")
    rows = rows.withColumns({"next": F.lead("text").over(inside), "nth": F.row_number().over(inside)})
    parts = rows.where("nth = 1").select("part", F.col("text").alias("first"))
    around = W.orderBy("part")
    last = F.max("part").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    edge = parts.select(F.coalesce(F.lag("part").over(around), last).alias("part"), "first")
    return rows.join(edge, "part", "left").select("doc_id", "text", F.coalesce("next", "first").alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, with their likeness.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document's. A likeness is the Jaccard index
    of two sets of paragraphs: what both have is what the one has less what
    the peeled difference of the two fingerprints has; 1 if both are empty.
    Null texts are empty, with the fingerprint of no paragraph; repeated rows
    and ids stay rows of their own; an empty table gives an empty one. A
    single row is its own next.
    """
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    near = with_next(docs).withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    base = near.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited")).alias("edited"),
        paragraph_digests(F.col("next_text")).alias("next"),
    )
    base = settled(base)
    parts = _parts(base, ["own", "edited", "next"])
    prints = sketches(base, ["own", "edited"], parts)
    prints = prints.groupBy("rid").agg(*[F.max(F.when(F.col("version") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))])
    found = differences(base, "own", ["edited", "next"], parts).select("rid", "pair", F.size("only_a").alias("x"), F.size("only_b").alias("y"))
    found = found.groupBy("rid").agg(*[F.max(F.when(F.col("pair") == i, F.struct("x", "y"))).alias(c) for i, c in enumerate(("d0", "d1"))])

    def likeness(d: str) -> Column:
        x, y = (F.coalesce(F.col(f"{d}.{c}"), F.lit(0)) for c in ("x", "y"))
        a = F.size("own")
        return F.when(a + y == 0, 1.0).otherwise((a - x) / F.greatest(a + y, F.lit(1))).cast("double")

    empty = _base64(F.lit("0" * 32 * SUBTABLES * CELLS))
    rows = base.join(prints, "rid", "left").join(found, "rid", "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", empty).alias("fingerprint"),
        F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
        likeness("d0").alias("near_edited"),
        likeness("d1").alias("near_next"),
    )


def op8_iblt_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprint_edits(docs)
