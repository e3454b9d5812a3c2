"""Substring dedup by recompression: long word sequences that repeat anywhere.

Rounds rename the word sequence: a run of one symbol becomes one symbol, and
in a pair round each symbol falls into a left or a right class (by a bit of
its name), and a left symbol followed by a right one becomes one symbol. A
name is a 64-bit hash of what it stands for, so names are global without a
dictionary, and equal substrings get equal symbols but for a few at the rim:
a round can only touch a rim symbol that may belong with its unseen neighbour.
What is left of a window after dropping those is its core, a function of the
window's words alone. The core at the highest level where there is one gives
the window's anchor, so equal windows have equal anchors.

Three Spark passes: (1) anchors that occur twice, by a shuffle of each chunk's
distinct anchors; (2) windows with such anchors, compared by anchor and window
hash (128 bits together), by a shuffle of each chunk's distinct ones; (3) words
under a window that occurs elsewhere go. Chunks are groups of whole documents
of about CHUNK_BYTES; a chunk's repeats are merged before each shuffle, so a
passage in a third of all documents sends one row per chunk. The answer to a
chunk is a list of its shared anchors, then one bit for each of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, mix64

CHUNK_BYTES = 4_000_000
#: Base of the rolling hash, and odd constants that keep names of rounds apart.
BASE = 0x9E3779B97F4A7C15
LEFT, RIGHT, STEP = 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
WORDS_KEPT = 1_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and how many each text has."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[ends[1:]] - before[ends[:-1]]


def word_symbols(words: pa.Array) -> np.ndarray:
    """A 64-bit name for each word, by its bytes."""
    coded = words.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in byte_rows(coded.dictionary)], np.uint64)
    return names[coded.indices.to_numpy()]


def window_starts(lengths: np.ndarray, width: int) -> np.ndarray:
    """Positions, in the documents laid end to end, where a window fits its document."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(ends))
    return at[at + width <= ends]


def window_hashes(symbols: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    n = len(symbols)
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    if n:
        up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up, out=sums[1:])
    return mix64((sums[starts + width] - sums[starts]) * down[starts])


def _runs(s: np.ndarray, salt: np.uint64):
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    named = s[first]
    if len(first) < len(s):
        size = np.diff(np.append(first, len(s)))
        long = np.flatnonzero(size > 1)
        named[long] = mix64(named[long] * np.uint64(LEFT) + size[long].astype(np.uint64) * np.uint64(RIGHT) + salt)
    return named, np.cumsum(new, dtype=np.int32) - np.int32(1)


def _pairs(s: np.ndarray, salt: np.uint64, bit: int):
    right = (s >> np.uint64(bit) & np.uint64(1)).astype(bool)
    head = np.flatnonzero(~right[:-1] & right[1:])
    start = np.ones(len(s), bool)
    start[head + 1] = False
    place = np.cumsum(start, dtype=np.int32) - np.int32(1)
    named = s[start]
    named[place[head]] = mix64(s[head] * np.uint64(LEFT) + s[head + 1] * np.uint64(RIGHT) + salt)
    return named, place, right


def anchors(symbols: np.ndarray, starts: np.ndarray, width: int, rounds: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, the first symbol of its highest core, and a number for that core's place.

    Windows with one core's place differ: equal ones have it at equal distance.

    A core is a range [a, b) of the symbols of a level. Neighbouring windows
    soon have the same range and go on as one; done has, for each round, the
    ranges that end there with their anchors, and where the others went.
    """
    s, a = symbols, starts.astype(np.int32)
    b = a + np.int32(width)
    done = []
    for r in range(rounds):
        if not len(a):
            break
        salt = mix64(np.array([(r + 1) * STEP & (1 << 64) - 1], np.uint64))[0]
        if r % 3 == 2:
            t, run = _runs(s, salt)
            c, d = run[a] + np.int32(1), run[b - 1]
        else:
            t, place, right = _pairs(s, salt, 1 + r)
            c, d = a + right[a], b - ~right[b - 1]
            some = c < d
            c, d = place[np.where(some, c, 0)], place[np.where(some, d, 1) - 1] + np.int32(1)
            d[~some] = 0
        some = c < d
        ends, goes = np.flatnonzero(~some), np.flatnonzero(some)
        c, d = c[goes], d[goes]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        done.append((len(a), ends, s[a[ends]], goes, np.cumsum(new) - 1))
        s, a, b = t, c[new], d[new]
    found, place, places = s[a], np.arange(len(a)), len(a)
    for n, ends, own, goes, group in reversed(done):
        out, at = np.empty(n, np.uint64), np.empty(n, np.int64)
        out[ends], out[goes] = own, found[group]
        at[ends], at[goes] = places + np.arange(len(ends)), place[group]
        found, place, places = out, at, places + len(ends)
    return mix64(found), place


def _part(anchor: np.ndarray, parts: int) -> np.ndarray:
    """A number below parts for each anchor, ascending with the anchor."""
    return ((anchor >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind=pa.int64()) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values, kind))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _whole(column) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _gathered(batches, columns: list[str]):
    """The batches' named columns, as one numpy array each; lists end to end, and the first list's sizes."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    out, sizes = [], None
    for name in columns:
        col = _whole(t.column(name))
        if pa.types.is_list(col.type):
            sizes = np.diff(col.offsets.to_numpy()) if sizes is None else sizes
            col = col.flatten()
        out.append(col.to_numpy(zero_copy_only=False))
    return *out, sizes


def _shared_anchors(batches):
    """(chunk, anchors): of each chunk's anchors, those that some other row has too."""
    got = _gathered(batches, ["chunk", "anchors"])
    if got is None:
        return
    chunk, anchor, sizes = got
    chunk = np.repeat(chunk, sizes)
    order = np.argsort(anchor, kind="stable")
    anchor, chunk = anchor[order], chunk[order]
    same = anchor[1:] == anchor[:-1]
    twice = np.zeros(len(anchor), bool)
    twice[1:] |= same
    twice[:-1] |= same
    anchor, chunk = anchor[twice], chunk[twice]
    if not len(anchor):
        return
    order = np.argsort(chunk, kind="stable")
    anchor, chunk = anchor[order], chunk[order]
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    for i in range(0, len(first), 1000):
        some = first[i : i + 1001]
        ends = some[1:] if len(some) > 1000 else np.append(some[1:], len(chunk))
        at = some[:1000]
        yield pa.RecordBatch.from_arrays([_ints(chunk[at]), _lists(anchor[at[0] : ends[-1]], ends - at)], ["chunk", "anchors"])


class _Chunk:
    """A chunk's documents in a fixed order, with their windows; the distinct ones ascend by anchor."""

    def __init__(self, docs: pa.Table, width: int):
        docs = docs.select(["doc_id", "text"]).combine_chunks()
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        self.ids = docs.column("doc_id")
        self.words, self.n = split_words(_whole(docs.column("text")))
        symbols = word_symbols(self.words)
        self.starts = window_starts(self.n, width)
        anchor, place = anchors(symbols, self.starts, width)
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        self.run, self.symbols, self.width = np.cumsum(new) - 1, symbols, width
        self.run_anchor = anchor[new]

    def candidates(self, shared: np.ndarray) -> None:
        """Keeps the windows whose anchor is shared with a chunk or within this one."""
        values, group, count = np.unique(self.run_anchor, return_inverse=True, return_counts=True)
        at = np.flatnonzero((np.isin(values, shared) | (count > 1))[group][self.run])
        self.starts = self.starts[at]
        anchor, key = self.run_anchor[self.run[at]], window_hashes(self.symbols, self.starts, self.width)
        by = np.lexsort((key, anchor))
        a, k = anchor[by], key[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        #: For each candidate, the place of its (anchor, key) among the distinct ones.
        self.group = np.empty(len(by), np.int64)
        self.group[by] = group
        a, k = a[new], k[new]
        #: Those found twice here, and those that other chunks may have.
        self.twice = np.bincount(group, minlength=len(a)) > 1
        self.asked = np.flatnonzero(np.isin(a, shared))
        self.anchor, self.key = a[self.asked], k[self.asked]


def _chunk_anchors(key, docs: pa.Table, width: int, parts: int) -> pa.Table:
    """(part, chunk, anchors): the distinct anchors of a chunk."""
    found = np.unique(_Chunk(docs, width).run_anchor)
    part = _part(found, parts)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    chunk = np.full(len(first), key[0].as_py(), np.int64)
    return pa.table([_ints(part[first]), _ints(chunk), _lists(found.view(np.int64), np.diff(np.append(first, len(found))))], ["part", "chunk", "anchors"])


def _list_values(t: pa.Table, name: str) -> np.ndarray:
    found = [c.flatten().to_numpy(zero_copy_only=False) for c in t.column(name).chunks]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _chunk_windows(key, docs: pa.Table, flags: pa.Table, width: int, parts: int) -> pa.Table:
    c = _Chunk(docs, width)
    c.candidates(_list_values(flags, "anchors").astype(np.int64).view(np.uint64))
    a, k = c.anchor, c.key
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(new)
    each = np.diff(np.append(at, len(a)))
    part = _part(a[at], parts)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else np.zeros(0, np.int64)
    of_anchors = np.diff(np.append(first, len(at)))
    of_keys = np.diff(np.append(at[first], len(a))) if len(at) else of_anchors
    chunk = np.full(len(first), key[0].as_py(), np.int64)
    return pa.table(
        [_ints(part[first]), _ints(chunk), _lists(a[at].view(np.int64), of_anchors), _lists(each.astype(np.int32), of_anchors, pa.int32()), _lists(k.view(np.int64), of_keys)],
        ["part", "chunk", "anchors", "each", "keys"],
    )


def _shared_windows(batches):
    """(chunk, part, bits): for each row's windows, whether another row has them too."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    chunk, part, anchor, _ = _gathered(got, ["chunk", "part", "anchors"])
    each, _ = _gathered(got, ["each"])
    key, sizes = _gathered(got, ["keys"])
    anchor = np.repeat(anchor, each)
    order = np.lexsort((key, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flag = np.empty(len(key), bool)
    flag[order] = twice
    ends = np.cumsum(sizes)
    for i in range(0, len(sizes), 1000):
        bits = [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends[i : i + 1000], sizes[i : i + 1000])]
        yield pa.RecordBatch.from_arrays([_ints(chunk[i : i + 1000]), _ints(part[i : i + 1000]), pa.array(bits, pa.binary())], ["chunk", "part", "bits"])


def _kept(key, docs: pa.Table, flags: pa.Table, width: int, parts: int) -> pa.Table:
    c = _Chunk(docs, width)
    c.candidates(_list_values(flags, "anchors").astype(np.int64).view(np.uint64))
    part = _part(c.anchor, parts)
    for p, bits in zip(flags.column("part").to_pylist(), flags.column("bits").to_pylist()):
        if bits is not None:
            i, j = np.searchsorted(part, [p, p + 1])
            c.twice[c.asked[i:j]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
    change = np.zeros(len(c.words) + 1, np.int32)
    hit = c.starts[c.twice[c.group]]
    change[hit] += 1
    change[hit + width] -= 1
    gone = np.cumsum(change[:-1]) > 0
    ends = np.concatenate([[0], np.cumsum(c.n)])
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[ends[1:]] - before[ends[:-1]]
    # removed runs, cut at the documents' ends
    head, tail = gone.copy(), gone.copy()
    head[1:] &= ~gone[:-1]
    tail[:-1] &= ~gone[1:]
    firsts = ends[:-1][c.n > 0]
    head[firsts] |= gone[firsts]
    lasts = ends[1:][c.n > 0] - 1
    tail[lasts] |= gone[lasts]
    head, tail = np.flatnonzero(head), np.flatnonzero(tail)
    doc = np.searchsorted(ends, head, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(head - ends[doc]), pa.array(tail - ends[doc])], ["first", "last"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(c.n) + 1)).astype(np.int32)), spans)
    kept = pc.binary_join(_lists(c.words.filter(pa.array(~gone)), c.n - removed, pa.string()), " ")
    return pa.table([_whole(c.ids), pa.array(c.n), pa.array(removed), spans, kept], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 35, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row of docs (doc_id, text).

    A word goes if it is covered by a window of width consecutive words whose
    sequence also starts anywhere else, the same document included. spans has
    the removed runs by first and last word; kept the other words, joined by
    one space. Null texts have no words; rows with one id, or none, and
    repeated rows count as documents of their own; a text is whole in one
    chunk, however long. Other columns go, whatever their names; an empty
    table gives no rows. Windows are equal here if their anchors and hashes
    are, of 64 bits each.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-volume // chunk_bytes))
    parts = max(12, chunks // 3)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    grouped = rows.repartition(chunks, "chunk")  # about a chunk each, so that no task has many
    own = grouped.groupBy("chunk").applyInArrow(lambda key, left: _chunk_anchors(key, left, width, parts), "part long, chunk long, anchors array<long>")
    # one plan, so that Spark shuffles the texts and the anchors once and reads them again in each pass
    shared = own.repartition(parts, "part").mapInArrow(_shared_anchors, "chunk long, anchors array<long>")
    flags = shared.select("chunk", F.lit(None).cast("long").alias("part"), "anchors", F.lit(None).cast("binary").alias("bits"))
    with_flags = grouped.groupBy("chunk").cogroup(flags.groupBy("chunk"))
    schema = "part long, chunk long, anchors array<long>, each array<int>, keys array<long>"
    windows = with_flags.applyInArrow(_bound(_chunk_windows, width, parts), schema)
    bits = windows.repartition(parts, "part").mapInArrow(_shared_windows, "chunk long, part long, bits binary")
    both = flags.union(bits.select("chunk", "part", F.lit(None).cast("array<long>").alias("anchors"), "bits"))
    schema = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string"
    return grouped.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_bound(_kept, width, parts), schema)


def _bound(f, width: int, parts: int):
    """f with its settings, as the three-argument function that Spark asks for."""

    def call(key, left, right):
        if not left.num_rows:
            return f(key, left, right, width, parts).slice(0, 0)
        return f(key, left, right, width, parts)

    return call


def op9_substring_recompression(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs, 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
