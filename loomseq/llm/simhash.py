"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two 23-bit segments A and B and 18 bits C.
The binary Golay code of length 23 is perfect: each segment has one nearest
codeword within 3 bits. A segment's keys are the codewords within 4 bits,
which are the decodings of the segment and of its 23 one-bit neighbours (one
key or six). Two segments at most 2 bits apart have a midpoint one bit from
each at most, and its codeword is a key of both.

At most four differing bits over A, B, C leave one of these, so one of the
keys below is shared by every pair that must link:

* A and B differ in two bits at most each, and half of C is equal: key of A,
  key of B, that half.
* so, but both halves of C differ: then A and B have two differing bits in
  all, and two of their four blocks are equal.
* A has three or more: B is equal, or C is equal and B is one bit off.
* B has three or more: the same with A.

Only distinct fingerprints are keyed. Rows that share a key are compared, and
of each bucket a spanning forest of its links goes on, never all its pairs. A
bucket of more than BUCKET fingerprints is linked through midpoints instead:
two fingerprints link exactly when some word is within two bits of both, so
each sends its 2,081 neighbours, which is linear and needs no comparison.
"""

from __future__ import annotations

from functools import cache, partial
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, delete_path, settled, shared_path, slices, trimmed
from .graph import connected_components

#: The generator of the (23, 12) Golay code, and XXH64's seed.
GENERATOR = 0b110001110101
SEED = 42

BUCKET = 4096
LINK_BITS = 4

#: Cells in which shingles are counted, one in how many texts is, and from how many times the mean (and one) a cell is common.
CELLS, SAMPLED, COMMON = 1 << 20, 16, 4
#: Bits of the map of texts that pairs ask for; texts that a task remembers having had.
BITS, SEEN = 1 << 26, 500_000
#: Pairs of one text that are compared in one part.
SPREAD = 128
#: Bits of the sketch of a set; a shingle of more texts than this is in many.
SKETCH, FEW = 1024, 16


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error pattern of each syndrome."""
    one = []
    for bit in range(23):
        x = 1 << bit
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        one.append(x)
    errors = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= one[b]
            errors[s] = sum(1 << b for b in bits)
    return np.array(one, np.uint32), errors


def syndrome(x: np.ndarray) -> np.ndarray:
    one, _ = golay()
    s = np.zeros(len(x), np.uint32)
    for bit in range(23):
        s ^= np.where(x >> np.uint32(bit) & np.uint32(1), one[bit], np.uint32(0))
    return s


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within 4 bits of 23-bit words, and which count."""
    one, errors = golay()
    flips = np.concatenate([[0], np.uint32(1) << np.arange(23, dtype=np.uint32)]).astype(np.uint32)
    moved = np.concatenate([[0], one]).astype(np.uint32)
    s = syndrome(x)[:, None] ^ moved[None, :]
    found = (x[:, None] ^ flips[None, :] ^ errors[s]) >> np.uint32(11)
    found.sort(axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out, valid = np.zeros((len(x), 6), np.uint64), np.zeros((len(x), 6), bool)
    row = np.broadcast_to(np.arange(len(x))[:, None], found.shape)
    out[row[new], place[new]] = found[new]
    valid[row[new], place[new]] = True
    return out, valid


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints, as (key, position of the fingerprint)."""
    u = np.uint64
    a, b = fp & u(0x7FFFFF), fp >> u(23) & u(0x7FFFFF)
    halves = fp >> u(46) & u(0x1FF), fp >> u(55)
    c = fp >> u(46)
    (ka, va), (kb, vb) = nearby(a.astype(np.uint32)), nearby(b.astype(np.uint32))
    at = np.arange(len(fp))
    keys, rows = [], []

    def put(tag: int, key: np.ndarray, row: np.ndarray) -> None:
        keys.append(key | u(tag << 48))
        rows.append(row)

    both = va[:, :, None] & vb[:, None, :]
    pair = (ka[:, :, None] << u(12) | kb[:, None, :])[both]
    row = np.broadcast_to(at[:, None, None], both.shape)[both]
    for i, half in enumerate(halves):
        put(1 + i, pair << u(9) | half[row], row)
    blocks = [fp >> u(s) & u((1 << w) - 1) for s, w in ((0, 12), (12, 11), (23, 12), (35, 11))]
    for i, (x, y) in enumerate(combinations(blocks, 2)):
        put(3 + i, x << u(12) | y, at)
    for i, (k, v, whole) in enumerate(((kb, vb, b), (ka, va, a))):
        put(9 + i, whole, at)
        near = np.broadcast_to(at[:, None], v.shape)[v]
        put(11 + i, k[v] << u(18) | c[near], near)
    return np.concatenate(keys), np.concatenate(rows)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; of all words if they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    digest, norm = xxhash.xxh64_intdigest, b" ".join(words)
    if n == 1:
        return np.array([digest(norm, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter([digest(norm[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int) -> int:
    """The SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, width))


@trimmed
def _fingerprints(batches, width: int):
    for batch in batches:
        for part in slices(batch):
            found = np.array([fingerprint(t, width) for t in byte_rows(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, width))


def sketch(x: np.ndarray) -> bytes:
    """The parity of a set's hashes in each of SKETCH cells: two sets differ in as many hashes as their sketches in bits, at least."""
    odd = np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard index of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 1.0


def _new_rows(batches, col: int = 0):
    """Batches of SLICE_ROWS rows at most, without rows whose number at col this task has had; repeats may pass."""
    seen: set = set()
    for batch in batches:
        for part in slices(batch):
            ids = part.column(col).to_pylist()
            new = [i not in seen and not seen.add(i) for i in ids]
            if len(seen) > SEEN:
                seen.clear()
            yield part if all(new) else part.filter(pa.array(new, pa.bool_()))


@trimmed
def _prints(batches, width: int):
    """(t, fp, sketch) of texts (t, text)."""
    for batch in _new_rows(batches):
        hashes = [shingle_hashes(t, width) for t in byte_rows(batch.column(1))]
        fps = np.array([majority(h) for h in hashes], np.uint64)
        sketches = pa.array([sketch(np.unique(h)) for h in hashes], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), sketches], ["t", "fp", "sketch"])


@trimmed
def _similar(batches, width: int, least: float):
    """Pairs (a, b, ta, tb), in runs of one a, whose texts are similar."""
    at, x = None, None
    for batch in batches:
        for part in slices(batch):
            near = []
            for a, p, q in zip(part.column(0).to_pylist(), byte_rows(part.column("ta")), byte_rows(part.column("tb"))):
                if a != at:
                    at, x = a, shingle_set(p, width)
                near.append(jaccard(x, shingle_set(q, width)) >= least)
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


@trimmed
def _cells(batches, width: int):
    """In how many texts (t, text) there is a shingle of each cell of the hashes."""
    counts = np.zeros(CELLS, np.int64)
    for batch in _new_rows(batches):
        for t in byte_rows(batch.column(1)):
            np.add.at(counts, (shingle_set(t, width) % np.uint64(CELLS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])


@trimmed
def _prefixes(batches, width: int, least: float, cells: np.ndarray, levels: np.ndarray):
    """Postings (key, t, n, score) of the first shingles of each text, in one order for all texts: common ones last.

    n is the size of the whole set, score the percentage of common shingles
    among the first. A text without words has one posting, of size 0.
    """
    level_of = np.zeros(CELLS, np.int8)
    level_of[cells] = levels
    for batch in _new_rows(batches):
        keys, texts, sizes, scores = [], [], [], []
        for name, t in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
            x = shingle_set(t, width)
            level = level_of[(x % np.uint64(CELLS)).astype(np.int64)]
            n = len(x) - ceil(least * len(x) - 1e-9) + 1
            first = np.argsort(level, kind="stable")[:n]  # x is sorted by hash
            found = x[first] if len(x) else np.zeros(1, np.uint64)
            keys.append(found)
            texts.append(np.full(len(found), name, np.int64))
            sizes.append(np.full(len(found), len(x), np.int32))
            scores.append(np.full(len(found), int(100 * (level[first] > 0).mean()) if len(x) else 0, np.int32))
        if keys:
            columns = [pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.concatenate(c)) for c in (texts, sizes, scores)]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "t", "n", "score"])


@trimmed
def _shared(batches):
    """Rows (key, t, n) sorted by key in, equal ones side by side; each once, and only those whose key has another t."""
    last, again = None, False  # the last row so far, not out yet, and if its key has had another
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        k, t = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        own = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]))
        next_same = k[own][1:] == k[own][:-1]
        before = np.concatenate([[again], next_same])
        yield rows.take(pa.array(own[:-1][before[:-1] | next_same]))
        last, again = rows.slice(int(own[-1]), 1), bool(before[-1])
    if again:
        yield last


def _need(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """How many first shingles two sets of sizes n and m have in common at least if they are similar.

    Of the one whose first shingles end first, in the common order, only the
    rest can be in common besides.
    """
    both = np.ceil(least / (1 + least) * (n + m) - 1e-6)
    rest = np.ceil(least * np.maximum(n, m) - 1e-9) - 1
    return np.maximum(1, both - rest).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], ["a", "b", "need"])


@trimmed
def _hub_pairs(batches, least: float):
    """Rows (key, t, n) sorted by key in; each row with the first of its key, if near enough in size."""
    key, text, size = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, w, n = (batch.column(i).to_numpy() for i in range(3))
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        hub, hub_n = np.where(at >= 0, w[at], text), np.where(at >= 0, n[at], size)
        key, text, size = k[-1], hub[-1], hub_n[-1]
        near = (hub != w) & (np.minimum(n, hub_n) >= least * np.maximum(n, hub_n) - 1e-6)
        yield _pairs(w[near], hub[near], (_need(n[near], hub_n[near], least) + 1) // 2)


@trimmed
def _among(batches, slots: np.ndarray, bits: np.ndarray):
    """Rows (t, text) whose t may be among those of a bitmap of BITS bits."""
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[slots] = bits.view(np.uint64)

    def some():
        for batch in batches:
            cell = batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)
            found = bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(found.astype(bool)))

    yield from _new_rows(some())


def _columns(batch) -> list[np.ndarray]:
    """Columns (key, t, n, comp) as arrays; a sketch, if there is one, as a row of words."""
    found = [batch.column(i).to_numpy() for i in range(4)]
    if batch.num_columns > 4:
        found.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
    return found


def _mixed_keys(batches):
    """Rows (key, t, n, comp, ...) sorted by key in; arrays of the rows of each key of several components out, by n and t."""

    def keys(rows: list[np.ndarray]):
        k, w, n, c = rows[:4]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        for s, e in zip(starts, np.append(starts[1:], len(k))):
            if e - s > 1 and (c[s:e] != c[s]).any():
                order = np.lexsort((w[s:e], n[s:e])) + s
                yield [x[order] for x in rows[1:]]

    tail: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tail.append(_columns(batch))
        k = tail[-1][0]
        if k[-1] == tail[0][0][0]:
            continue  # still one key
        rows = [np.concatenate(c) for c in zip(*tail)]
        last = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1]))
        yield from keys([c[:last] for c in rows])
        tail = [[c[last:] for c in rows]]
    if tail:
        yield from keys([np.concatenate(c) for c in zip(*tail)])


def _sketch_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the sketches x differ from the sketch y."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _most_bits(n: np.ndarray, m: int, least: float) -> np.ndarray:
    """In how many hashes similar sets of sizes n and m differ at most."""
    return (n + m) * ((1 - least) / (1 + least)) + 1e-6


@trimmed
def _apart_pairs(batches, least: float):
    """Rows (key, t, n, comp), sorted by key, in; pairs of a key in different components, near enough in size, out.

    With a sketch as fifth column, without the pairs whose sketches show that they aren't similar.
    """
    found, held_back = [], 0
    for w, n, c, *sketches in _mixed_keys(batches):
        ends = np.searchsorted(n, n / least + 1e-6, side="right")
        for i in range(len(w) - 1):
            at = np.arange(i + 1, ends[i])[c[i + 1 : ends[i]] != c[i]]
            if sketches and len(at):
                at = at[_sketch_bits(sketches[0][at], sketches[0][i]) <= _most_bits(n[at], n[i], least)]
            if len(at):
                found.append((np.full(len(at), w[i]), w[at], _need(np.full(len(at), n[i]), n[at], least)))
                held_back += len(at)
            if held_back > 1 << 16:
                yield _pairs(*map(np.concatenate, zip(*found)))
                found, held_back = [], 0
    if found:
        yield _pairs(*map(np.concatenate, zip(*found)))


@trimmed
def _class_pairs(batches, least: float):
    """Rows (key, t, n, comp, sketch), sorted by key, in; of each key a forest out that spans the components.

    Its edges are pairs that may be similar by their sketches, so there are
    fewer than rows. From each text reached it takes the nearest of each
    component not reached yet.
    """
    for w, n, c, sketches in _mixed_keys(batches):
        found, rest = [], np.arange(len(w))
        while len(rest):
            own = c[rest] == c[rest[0]]
            front, rest = rest[own].tolist(), rest[~own]
            while front and len(rest):
                x = front.pop()
                bits = _sketch_bits(sketches[rest], sketches[x])
                sized = np.minimum(n[rest], n[x]) >= least * np.maximum(n[rest], n[x]) - 1e-6
                near = np.flatnonzero((bits <= _most_bits(n[rest], n[x], least)) & sized)
                if len(near):
                    near = rest[near[np.argsort(bits[near], kind="stable")]]
                    new = near[np.unique(c[near], return_index=True)[1]]
                    found.append((np.full(len(new), w[x]), w[new]))
                    own = np.isin(c[rest], c[new])
                    front += rest[own].tolist()
                    rest = rest[~own]
        if found:
            a, b = map(np.concatenate, zip(*found))
            yield _pairs(a, b, np.ones(len(a), np.int64))


@trimmed
def _keyed(batches):
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(whole), 4096):
            fp = whole[i : i + 4096]
            key, row = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], ["key", "fp"])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _forest(f: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links among the distinct fingerprints f."""
    left, right, rest = [], [], f
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _apart(rest, x) <= LINK_BITS
            if near.any():
                new = rest[near]
                left += [x] * len(new)
                right += new.tolist()
                front += list(new)
                rest = rest[~near]
    return left, right


def _links_of(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal k; enough of them to connect what is linked."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    few = 8
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat((sizes > 1) & (sizes <= few), sizes)
    at = np.flatnonzero(small)
    left, right = [], []
    for step in range(1, few):
        at = at[at + step < ends[at]]
        near = at[_apart(f[at], f[at + step]) <= LINK_BITS]
        left.append(f[near])
        right.append(f[near + step])
    for s, n in zip(starts[sizes > few], sizes[sizes > few]):
        x, y = _forest(np.sort(f[s : s + n]))  # buckets that have the same members have the same links
        left.append(np.array(x, np.uint64))
        right.append(np.array(y, np.uint64))
    return np.concatenate(left), np.concatenate(right)


def _edges(left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
    b = pa.nulls(len(left), pa.int64()) if right is None else pa.array(right.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), b], ["a", "b"])


@trimmed
def _bucket_links(batches, bucket: int):
    """Rows sorted by key in; links (a, b) out, and (a, null) for members of large buckets."""
    empty = np.zeros(0, np.uint64)
    tail_k, tail_f, large = empty, empty, None
    for batch in batches:
        k = np.concatenate([tail_k, batch.column(0).to_numpy().view(np.uint64)])
        f = np.concatenate([tail_f, batch.column(1).to_numpy().view(np.uint64)])
        if large is not None:
            still = k == large
            if still.any():
                yield _edges(f[still], None)
                k, f = k[~still], f[~still]
            if len(k):
                large = None
        if not len(k):
            tail_k, tail_f = k, f
            continue
        last = len(k) - int(np.argmax(k[::-1] != k[-1])) if (k != k[-1]).any() else 0
        if last:
            yield _edges(*_links_of(k[:last], f[:last]))
        tail_k, tail_f = k[last:], f[last:]
        if len(tail_k) > bucket:
            yield _edges(tail_f, None)
            large, tail_k, tail_f = tail_k[0], empty, empty
    if len(tail_k):
        yield _edges(*_links_of(tail_k, tail_f))


@trimmed
def _midpoints(batches):
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    ball = np.concatenate([[np.uint64(0)], one, one[i] | one[j]]).astype(np.uint64)
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for s in range(0, len(whole), 256):
            fp = whole[s : s + 256]
            key = (fp[:, None] ^ ball[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(ball)).view(np.int64))], ["key", "fp"])


@trimmed
def _chain(batches):
    """Rows sorted by key in; each row linked to the first of its key."""
    key = first = None
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        if not len(k):
            continue
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        head = np.where(at >= 0, f[np.maximum(at, 0)], first if first is not None else 0)
        key, first = k[-1], head[-1]
        apart = head != f
        yield pa.RecordBatch.from_arrays([pa.array(f[apart]), pa.array(head[apart])], ["a", "b"])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each row's SimHash as a signed long; null texts have no words and give 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(partial(_fingerprints, width=width), f"doc_id {kind}, fp long")


def fingerprint_links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (fp) at four bits or fewer."""
    keyed = distinct_fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_bucket_links, bucket=bucket), "a long, b long")
    found = settled(found.distinct())
    links = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return links
    spread = hot.mapInArrow(_midpoints, "key long, fp long")
    return links.union(spread.repartition("key").sortWithinPartitions("key").mapInArrow(_chain, "a long, b long"))


def components(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and near-duplicate class.

    component_id is the smallest id reachable over links, the row's own
    included. Null and wordless texts share fingerprint zero and link like any
    other; repeated rows stay; rows whose id is null take part, and have a
    null component only where no id is reachable. An empty table gives none.
    """
    rows = settled(fingerprints(docs, width, id_col, text_col))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = connected_components(fingerprint_links(least, bucket))
    placed = least.join(stars, least.fp == stars.node, "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    # settled, so that Spark can split the joins on a class or a fingerprint that many rows have
    placed = settled(placed)
    names = settled(placed.groupBy("comp").agg(F.min("least").alias("component_id")))
    by_fp = settled(placed.join(names, "comp").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def text_key(text: F.Column) -> F.Column:
    """The number that stands for a text, the same for equal texts; null has one of its own."""
    return F.xxhash64(text.cast("string"))


def similar_components(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, t, component_id, stays): classes of documents whose sets of word shingles have that Jaccard index.

    One row for each different pair of doc_id and text_key(text); such rows
    are one document. Of each class the least by (doc_id, t) stays, a null
    doc_id coming last, and component_id is its doc_id.

    Links come from two searches, and every link is decided by the whole texts.
    First SimHashes within four bits by Golay keys, and each text with the
    most common text of each of its shingle keys: these link groups of near
    copies in linear work. SimHash misses most pairs near 0.8, so the second
    search is complete: two sets that similar have some of the first
    (1 - least) of their shingles in common, in any order common to all sets,
    and that many (``_need``). The order puts common shingles last, by counts
    of a sample, which decide the work and not the result. Of a key that many
    texts have, first a forest over the components is compared, of pairs whose
    sketches (``sketch``) allow that they are similar; so a group of near
    copies without a common centre is linked in as many pairs as it has rows.
    Then all pairs of a key that aren't connected are counted, of such a key
    those that the sketches allow. Sketches never rule out a similar pair.
    Texts without words are alike.
    """
    given = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("t", text_key(F.col("text")))
    rows = settled(given.select("doc_id", "t"))
    texts = given.select("t", "text")
    written: list[str] = []

    def verified(asked: DataFrame) -> DataFrame:
        ends: dict[str, DataFrame] = {}
        asked = settled(asked.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b"))
        # only the texts that some pair asks for, and few others, are shuffled
        cells = asked.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod("id", F.lit(BITS)).alias("cell"))
        slots = cells.groupBy(F.shiftright("cell", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 AS int)))").alias("bits")).toArrow()
        some = texts.mapInArrow(partial(_among, slots=slots["slot"].to_numpy(), bits=slots["bits"].to_numpy()), texts.schema).dropDuplicates(["t"])
        # a text in many pairs goes to as many parts as these are dealt to
        for end, other in (("a", "b"), ("b", "a")):
            many = settled(asked.groupBy(end).agg(F.ceil(F.count("*") / SPREAD).cast("long").alias(f"parts_{end}")))
            asked = asked.join(many, end).withColumn(f"part_{end}", F.pmod(F.xxhash64(other), F.col(f"parts_{end}"))).drop(f"parts_{end}")
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{end}") - 1)).alias(f"part_{end}")
            ends[end] = some.toDF(end, f"t{end}").join(many, end).select(end, f"t{end}", each)
        pairs = asked.join(ends["b"], ["b", "part_b"]).join(ends["a"], ["a", "part_a"]).select("a", "b", "ta", "tb")
        # written and read, as a checkpoint keeps its plan's estimate of its size, which the joins of some searches in a row multiply beyond all bounds
        path = shared_path(docs.sparkSession, "links")
        pairs.mapInArrow(partial(_similar, width=width, least=least), "a long, b long").write.parquet(path)
        written.append(path)
        return docs.sparkSession.read.schema("a long, b long").parquet(path)

    sample = texts.where(F.pmod("t", F.lit(SAMPLED)) == 0)
    counted = settled(sample.mapInArrow(partial(_cells, width=width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / CELLS
    common = counted.where(F.col("n") >= COMMON * (1 + mean)).toArrow()
    cells, levels = common["cell"].to_numpy(), np.log2(common["n"].to_numpy()).astype(np.int8)
    postings = texts.mapInArrow(partial(_prefixes, width=width, least=least, cells=cells, levels=levels), "key long, t long, n int, score int")
    by_key = postings.repartition("key").sortWithinPartitions("key", F.desc("score"), "t").select("key", "t", "n")
    shared = settled(by_key.mapInArrow(_shared, "key long, t long, n int"))

    prints = settled(texts.mapInArrow(partial(_prints, width=width), "t long, fp long, sketch binary"))
    heads = settled(prints.groupBy("fp").agg(F.min("t").alias("head")))
    alike = prints.join(heads, "fp").where("t <> head").select(F.col("head").alias("a"), F.col("t").alias("b"))
    near = fingerprint_links(heads.select("fp")).toDF("x", "y").join(heads.toDF("x", "a"), "x").join(heads.toDF("y", "b"), "y").select("a", "b")
    golay = alike.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("need"))
    hubs = shared.mapInArrow(partial(_hub_pairs, least=least), "a long, b long, need long")  # its partitions are still sorted
    links = verified(golay.union(hubs))
    sketches = prints.select("t", "sketch").dropDuplicates(["t"])

    def placed() -> tuple[DataFrame, DataFrame]:
        """Rows (key, t, n, comp) of the keys of several components: of few texts, and of many with sketches."""
        stars = connected_components(links)
        found = shared.join(stars, shared.t == stars.node, "left").select("key", "t", "n", F.coalesce("comp", "t").alias("comp"))
        keys = found.groupBy("key").agg((F.count("*") > FEW).alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        found = settled(found.join(settled(keys.where("lo <> hi").select("key", "many")), "key"))
        many = found.where("many").join(sketches, "t").select("key", "t", "n", "comp", "sketch")
        return found.where("not many").select("key", "t", "n", "comp"), many

    def by_keys(rows: DataFrame, pairs) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(partial(pairs, least=least), "a long, b long, need long")

    few, many = placed()
    if not many.isEmpty():
        links = links.union(verified(by_keys(many, _class_pairs)))
        few, many = placed()
    rest = by_keys(few, _apart_pairs).union(by_keys(many, _apart_pairs))
    stars = connected_components(links.union(verified(rest)))
    for path in written:
        delete_path(docs.sparkSession, path)

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    firsts = settled(rows.groupBy("t").agg(F.min(place).alias("first")).join(stars, F.col("t") == stars.node, "left").select("t", "first", F.coalesce("comp", "t").alias("comp")))
    heads = settled(firsts.groupBy("comp").agg(F.min("first").alias("head")))
    named = settled(firsts.join(heads, "comp").select("t", "head"))
    found = rows.distinct().join(named, "t")
    return found.select("doc_id", "t", F.col("head.doc_id").alias("component_id"), (place == F.col("head")).alias("stays"))


def op4_simhash_golay(docs: DataFrame) -> DataFrame:
    found = components(docs, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
