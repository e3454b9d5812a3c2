"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of byte ranges. A merge rank has a
bucket of list positions whose pair has that rank. A two-level bitmap of the
non-empty buckets (256 words of 256 bits) gives the lowest rank by two
find-first-set steps. A merge never searches the queue for the neighbours'
old entries: these are stale, and skipped when they come up. So a pre-token
of n bytes takes O(n log n) whatever its length; nothing is cut.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import partial
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, trimmed

#: Pre-tokens of a generation kept with their ids during a task (about 60 MB); the longest kept, in characters.
KEPT, KEPT_LENGTH = 300_000, 64
#: The bits of a word.
BIT = [1 << i for i in range(256)]


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost first among equals."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [get(piece[i : i + 2], -1) for i in before[1:]]
    rank_at.append(-1)
    live = n - rank_at.count(-1)  # without one, all that is left in the queue is stale
    buckets: dict[int, int | list[int]] = {}  # one position, or a heap of several
    words: dict[int, int] = {}
    top = 0
    for i, r in enumerate(rank_at):
        if r >= 0:
            if r in buckets:
                some = buckets[r]
                if some.__class__ is int:
                    buckets[r] = [some, i]
                else:
                    some.append(i)  # ascending, so a heap already
            else:
                buckets[r] = i
                high = r >> 8
                if high in words:
                    words[high] |= BIT[r & 255]
                else:
                    words[high] = BIT[r & 255]
                    top |= 1 << high
    while live:
        high = (top & -top).bit_length() - 1
        word = words[high]
        r = high << 8 | (word & -word).bit_length() - 1
        i = buckets[r]
        if i.__class__ is not int:
            some = i
            i = heappop(some)
            if len(some) == 1:
                buckets[r] = some[0]
        else:
            del buckets[r]
            word &= word - 1
            if word:
                words[high] = word
            else:
                del words[high]
                top &= top - 1
        if rank_at[i] != r:
            continue  # stale
        gone = after[i]
        end = after[gone]
        after[i] = end
        live -= 2 if rank_at[gone] >= 0 else 1
        rank_at[gone] = rank_at[i] = -1
        at, to = before[i], end
        while True:  # the pair that ends with the merged range, then the one that begins with it
            if at >= 0:
                if rank_at[at] >= 0:
                    live -= 1
                rank_at[at] = new = get(piece[at:to], -1)
                if new >= 0:
                    live += 1
                    if new in buckets:
                        some = buckets[new]
                        if some.__class__ is int:
                            buckets[new] = [some, at] if some < at else [at, some]
                        else:
                            heappush(some, at)
                    else:
                        buckets[new] = at
                        high = new >> 8
                        if high in words:
                            words[high] |= BIT[new & 255]
                        else:
                            words[high] = BIT[new & 255]
                            top |= 1 << high
            if at == i or end == n:
                break
            before[end] = at = i
            to = after[end]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Kept(dict):
    """Ids by pre-token, in two generations: a full one becomes the old one, and the old one goes."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(merge_ranks(piece.encode(), self.ranks))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.old = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Encodes and decodes with a vocabulary file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.split = regex.compile(pattern).findall
        self.kept = _Kept(self.ranks)

    def encode(self, text: str) -> list[int]:
        kept = self.kept
        return list(chain.from_iterable([kept[p] for p in self.split(text)]))

    def decode(self, ids: list[int]) -> bytes:
        get = self.bytes.__getitem__
        return b"".join(map(get, ids))


def _parts(batches, path: str, pattern: str):
    """The tokenizer with each part of each batch; what it has kept goes when the task ends."""
    with held(lambda: Tokenizer(path, pattern)) as t:
        gc.disable()  # nothing here is cyclic, and each look at what is kept costs as much as it has grown
        try:
            for batch in batches:
                for part in slices(batch):
                    yield t, part
        finally:
            gc.enable()


@trimmed
def _encoded(batches, path: str, pattern: str):
    for t, part in _parts(batches, path, pattern):
        ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


@trimmed
def _decoded(batches, path: str, pattern: str):
    for t, part in _parts(batches, path, pattern):
        found = [None if x is None else t.decode(x) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])


@trimmed
def _digests(batches, path: str, pattern: str):
    sha = hashlib.sha256
    for t, part in _parts(batches, path, pattern):
        decimal = t.decimal.__getitem__
        counts, of_ids, of_bytes = [], [], []
        for x in part.column(1).to_pylist():
            ids = t.encode(x or "")
            counts.append(len(ids))
            of_ids.append(sha(" ".join(map(decimal, ids)).encode()).hexdigest())
            of_bytes.append(sha(t.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def _rows(docs: DataFrame, col: str, kind: str) -> tuple[DataFrame, str]:
    rows = docs.select("doc_id", F.col(col).cast(kind).alias("x"))
    return rows, dict(rows.dtypes)["doc_id"]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids array): every whole text's token ids; null and empty texts have none.

    Texts of any length are encoded whole, each pre-token in O(n log n).
    Repeated rows and ids stay rows of their own; other columns go, whatever
    their names; an empty table gives an empty one.
    """
    rows, kind = _rows(docs, text_col, "string")
    return rows.mapInArrow(partial(_encoded, path=path, pattern=pattern), f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of each row of ids; null stays null."""
    rows, kind = _rows(ids, ids_col, "array<int>")
    return rows.mapInArrow(partial(_decoded, path=path, pattern=pattern), f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Digests of every whole text's ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so the ids (several times the text in
    rows) never leave the worker. Null is the empty text: no ids, empty bytes.
    Rows and columns are treated as by encode.
    """
    rows, kind = _rows(docs, text_col, "string")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_digests, path=path, pattern=pattern), schema)


def op5_byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
