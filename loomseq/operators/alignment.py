"""Pairwise alignment by dynamic programming, in Arrow batches; pairs, matrices, whitelists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.alignment import hamming_distance
from .copies import member, once, sliced, spread

ALIGNED = "a string, b string, score int"
OUT_OF_BAND = -(1 << 30)
#: Cells of score matrices held at once, unless one pair has more.
CELLS = 1 << 21


def _codes(texts: list[str], size: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), size), fill, np.int64)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def _filled(pairs: list[tuple[str, str]], match: int, mismatch: int, gap: int, local: bool) -> np.ndarray:
    """Score matrices of all pairs, padded to one shape; each anti-diagonal of all is one array operation.

    A pair's own matrix is the corner of its lengths, which padding after it
    doesn't touch.
    """
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    x, y = _codes([a for a, _ in pairs], n, -1), _codes([b for _, b in pairs], m, -2)
    h = np.zeros((len(pairs), n + 1, m + 1), np.int32)
    if not local:
        h[:, :, 0], h[:, 0] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        step = np.where(x[:, i - 1] == y[:, j - 1], match, mismatch)
        best = np.maximum(h[:, i - 1, j - 1] + step, np.maximum(h[:, i - 1, j], h[:, i, j - 1]) + gap)
        h[:, i, j] = np.maximum(best, 0) if local else best
    return h


def _walk(a: str, b: str, h: np.ndarray, i: int, j: int, match: int, mismatch: int, gap: int, local: bool) -> tuple[str, str]:
    """The path back: a diagonal before a gap in b, and that before a gap in a."""
    left, right = [], []
    while (i > 0 and j > 0 and h[i, j] > 0) if local else (i > 0 or j > 0):
        if i > 0 and j > 0 and h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i > 0 and h[i, j] == h[i - 1, j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def aligned(pairs: list, match: int, mismatch: int, gap: int, local: bool) -> list[tuple]:
    """(a, b, score) of each pair, nulls for a pair with a null; pairs of like size are filled together."""
    out = [(None, None, None)] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if a is not None and b is not None), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        to, n, m = at, 0, 0
        while to < len(order):
            a, b = pairs[order[to]]
            n, m = max(n, len(a)), max(m, len(b))
            if to > at and (to + 1 - at) * (n + 1) * (m + 1) > CELLS:
                break
            to += 1
        some = [pairs[k] for k in order[at:to]]
        matrices = _filled(some, match, mismatch, gap, local)
        for k, (a, b), whole in zip(order[at:to], some, matrices):
            h = whole[: len(a) + 1, : len(b) + 1]
            i, j = np.unravel_index(int(h.argmax()), h.shape) if local else (len(a), len(b))
            score = int(h[i, j])
            out[k] = ("", "", 0) if local and score <= 0 else (*_walk(a, b, h, int(i), int(j), match, mismatch, gap, local), score)
        at = to
    return out


def align_global(a: str, b: str, match: int, mismatch: int, gap: int) -> tuple[str, str, int]:
    return aligned([(a, b)], match, mismatch, gap, False)[0]


def align_local(a: str, b: str, match: int, mismatch: int, gap: int) -> tuple[str, str, int]:
    return aligned([(a, b)], match, mismatch, gap, True)[0]


def scored_banded(pairs: list[tuple[str, str]], band: int, match: int, mismatch: int, gap: int) -> list[int]:
    """The global score of each pair within |i - j| <= band; a row of the band of all pairs is a few array operations.

    Column c of a row holds j = i + c - band. A run of gaps along the row is
    a running maximum.
    """
    for a, b in pairs:
        if abs(len(a) - len(b)) > band:
            raise ValueError("lengths differ by more than the band")
    if not pairs:
        return []
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    x, y = _codes([a for a, _ in pairs], n, -1), np.pad(_codes([b for _, b in pairs], m, -2), ((0, 0), (band + 1, n + band + 1)), constant_values=-2)
    c = np.arange(2 * band + 1)
    slope = c * gap
    first = np.where(c >= band, (c - band) * gap, OUT_OF_BAND)
    row = np.broadcast_to(first, (len(pairs), len(c))).astype(np.int64)
    size, width = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    out = np.where(size == 0, width * gap, 0)
    for i in range(1, n + 1):
        step = np.where(x[:, i - 1 : i] == y[:, i : i + 2 * band + 1], match, mismatch)
        above = np.concatenate([row[:, 1:], np.full((len(pairs), 1), OUT_OF_BAND)], axis=1)
        best = np.maximum(row + step, above + gap)
        j = i + c - band
        best[:, j < 0], best[:, j == 0] = OUT_OF_BAND, i * gap
        row = np.maximum.accumulate(best - slope, axis=1) + slope
        row[:, j < 0] = OUT_OF_BAND
        done = size == i
        out[done] = row[done, (width - size + band)[done]]
    return out.tolist()


def score_banded(a: str, b: str, band: int, match: int, mismatch: int, gap: int) -> int:
    return scored_banded([(a, b)], band, match, mismatch, gap)[0]


def _aligner(local: bool, match: int, mismatch: int, gap: int):
    @pandas_udf(ALIGNED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = aligned(list(zip(a, b)), match, mismatch, gap, local)
        return pd.DataFrame(rows, columns=["a", "b", "score"]).astype({"score": "Int32"})

    return run


def needleman_wunsch(a, b, match: int = 1, mismatch: int = -1, gap: int = -1) -> Column:
    """struct(a, b, score) of the global alignment with linear gaps."""
    return _aligner(False, match, mismatch, gap)(a, b)


def smith_waterman(a, b, match: int = 1, mismatch: int = -1, gap: int = -1) -> Column:
    """struct(a, b, score) of the local alignment that ends first in row-major order; empty without a positive score."""
    return _aligner(True, match, mismatch, gap)(a, b)


def banded_alignment(a, b, bandwidth: int, match: int = 1, mismatch: int = -1, gap: int = -1) -> Column:
    @pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        some = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
        found = pd.Series([None] * len(a), dtype="Int32")
        for s in range(0, len(some), 1024):  # pairs of like length share array operations
            part = some[s : s + 1024]
            found.iloc[part] = scored_banded([(a.iloc[k], b.iloc[k]) for k in part], bandwidth, match, mismatch, gap)
        return found

    return run(a, b)


def distance_matrix(df: DataFrame, metric: str = "hamming", unequal: int = 999) -> DataFrame:
    """(i, j, distance) for all pairs of (idx, seq), both ways and with the diagonal.

    The result is quadratic by its nature. Sequences of unequal lengths are
    at Hamming distance unequal. Distances are of slices of equal sequences,
    so one is worked out once for up to SLICE * SLICE pairs.
    """
    slices = sliced(df.select("idx", "seq"), "seq", "idx")
    x, y = slices.toDF("x", "i"), slices.toDF("y", "j")
    if metric == "levenshtein":
        # as a function over an array, so its code stays out of the loops over members, which are then compiled
        pair = F.array(F.struct("x", "y"))
        d = F.transform(pair, lambda p: F.levenshtein(p["x"], p["y"]).cast("long"))[0]
    else:
        d = F.coalesce(hamming_distance("x", "y", on_error="null"), F.lit(unequal).cast("long"))
    rows = spread(x).crossJoin(y).select("i", "j", once(d).alias("distance"))
    rows = rows.select(member("i", "idx"), "j", "distance").select("i", member("j", "idx"), "distance")
    return rows.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(0).cast("long")).otherwise(F.col("distance")).alias("distance"))


def _by_pieces(left: DataFrame, right: DataFrame, pieces: int) -> DataFrame:
    """Candidate pairs, each once, of equal-length texts that differ in fewer than pieces places: one of their pieces is equal."""

    def edge(text: Column, k: int) -> Column:
        return F.floor(F.length(text) * k / pieces).cast("int")

    def piece(text: Column, k: int) -> Column:
        return F.substring(text, edge(text, k) + 1, edge(text, k + 1) - edge(text, k))

    def cut(df: DataFrame, name: str) -> DataFrame:
        x = F.col(name)
        parts = F.array(*[F.struct(F.lit(k).alias("k"), piece(x, k).alias("part")) for k in range(pieces)])
        return df.withColumns({"len_": F.length(x), "piece_": F.explode(parts)})

    a, b = cut(left, "barcode"), cut(right, "entry")
    b = b.withColumnsRenamed({"len_": "len2_", "piece_": "piece2_"})
    x, y = F.col("barcode"), F.col("entry")
    # of the pieces that a pair shares, the first makes its row
    first = F.coalesce(*[F.when(piece(x, k) == piece(y, k), F.lit(k)) for k in range(pieces)])
    rows = a.join(b, (a.len_ == b.len2_) & (a.piece_ == b.piece2_)).where(first == F.col("piece_.k"))
    return rows.drop("len_", "len2_", "piece_", "piece2_")


def barcode_rescue(barcodes: DataFrame, whitelist: DataFrame, max_hamming: int) -> DataFrame:
    """(barcode, w_idx, entry, distance): whitelist entries (idx, entry) of equal length at most so far.

    Cut in max_hamming + 1 pieces, two such texts have an equal piece: the
    join is on the pieces, with no pair that shares none, and between
    different texts; the rows of an entry are put back at the end.
    """
    w = whitelist.select(F.col("idx").alias("w_idx"), "entry").where("entry is not null")
    own = barcodes.select("barcode").where("barcode is not null").distinct()
    rows = _by_pieces(spread(own, "barcode"), w.select("entry").distinct(), max_hamming + 1)
    rows = rows.withColumn("distance", hamming_distance("barcode", "entry", on_error="null")).where(F.col("distance") <= max_hamming)
    rows = spread(rows).join(sliced(w, "entry", "w_idx"), "entry")
    return rows.select("barcode", F.explode("members.w_idx").alias("w_idx"), "entry", "distance")


def correct_barcode(barcodes: DataFrame, whitelist: DataFrame, max_distance: int) -> DataFrame:
    """(barcode, corrected): the whitelist entry with the least edit distance, first among equals; null if none is near.

    An entry within max_distance edits has one of max_distance + 1 pieces of
    the barcode unchanged, moved by max_distance places at most.
    """
    pieces = max_distance + 1
    b = barcodes.select("barcode").distinct()
    n = F.length("barcode")
    edge = lambda k: F.floor(n * k / pieces).cast("int")
    own = F.array(*[F.struct(F.lit(k).alias("k"), edge(k).alias("at"), F.substring(F.col("barcode"), edge(k) + 1, edge(k + 1) - edge(k)).alias("part")) for k in range(pieces)])
    # one row per length of a text: tens, and no more than the longest has letters
    lengths = [r.n for r in b.where("barcode is not null").select(n.alias("n")).distinct().collect()]
    near = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: F.abs(F.length("entry") - x) <= max_distance)
    cut = b.select("barcode", n.alias("n"), F.explode(own).alias("p")).select("barcode", "n", "p.*")
    w = whitelist.select(F.col("idx").alias("w_idx"), "entry", F.explode(near).alias("n"))
    shifted = []
    for k in range(pieces):
        at, end = F.floor(F.col("n") * k / pieces).cast("int"), F.floor(F.col("n") * (k + 1) / pieces).cast("int")
        for s in range(-max_distance, max_distance + 1):
            shifted.append(F.when(at + s >= 0, F.struct(F.lit(k).alias("k"), F.substring(F.col("entry"), at + s + 1, end - at).alias("part"))))
    found = F.array_distinct(F.filter(F.array(*shifted), lambda x: x.isNotNull()))
    theirs = w.select("w_idx", "entry", "n", F.explode(found).alias("p")).select("w_idx", "entry", "n", "p.*")
    rows = cut.join(theirs, ["n", "k", "part"]).select("barcode", "w_idx", "entry").distinct()
    rows = rows.withColumn("distance", F.levenshtein("barcode", "entry")).where(F.col("distance") <= max_distance)
    best = rows.groupBy("barcode").agg(F.min_by("entry", F.struct("distance", "w_idx")).alias("corrected"))
    return b.join(best, "barcode", "left")


def is_unique_peptide(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(peptide, proteins): sorted numbers of the proteins (idx, seq) that contain each peptide; may be none.

    Joined on windows of proteins as long as the peptides.
    """
    p = peptides.select("peptide").distinct().withColumn("n", F.octet_length("peptide"))
    lengths = [r.n for r in p.where("n is not null").select("n").distinct().collect()]  # no more than the longest peptide has letters
    size = F.octet_length("seq")
    fit = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= size)
    rows = proteins.select("idx", "seq", F.explode(fit).alias("n"))
    at = F.transform(F.sequence(F.lit(1), F.octet_length("seq") - F.col("n") + 1), lambda i: F.substring(F.col("seq"), i, F.col("n")))
    rows = rows.select("idx", "n", F.explode(F.array_distinct(at)).alias("peptide"))
    hits = p.join(rows, ["n", "peptide"]).groupBy("peptide").agg(F.sort_array(F.collect_list("idx")).alias("proteins"))
    return p.select("peptide").join(hits, "peptide", "left").select("peptide", F.coalesce("proteins", F.array().cast("array<bigint>")).alias("proteins"))
