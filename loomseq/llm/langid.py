"""Language identification by a linear-chain conditional random field.

Each word of a text gets a label. Its features are its affixes, its byte
trigrams and a lexicon entry, each hashed to a row of weights per label, and
transitions between labels are learned too. A text's posteriors come from
forward-backward over all its words; the text's language has the largest mean
posterior over words with letters, which is the score.

Training texts are monolingual, so training sequences are made code-switched:
pieces of texts of different languages, end to end, with each piece's language
as the gold label of its words. Training uses a bounded sample of labelled
rows, SAMPLE whole texts a label, and every word of them; prediction reads
every whole text.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, held, mix64, settled, slices, trimmed

#: The bound of the labelled sample: rows per label. Rows that are broadcast at most.
SAMPLE, BROADCAST_ROWS = 400, 200_000
#: Hashed weight rows, the words of a training sequence, and of one piece in it.
ROWS, LENGTH, PIECE = 1 << 16, 48, 16
#: Passes over the sample, sequences of a step.
PASSES, AT_ONCE, RATE, DECAY = 6, 1024, 0.35, 1e-4
SEED = 42
#: Words kept with their scores during a task; characters of texts worked on at once.
WORDS_KEPT, CHARS_AT_ONCE, BYTES_AT_ONCE = 100_000, 500_000, 3 << 19
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
AROUND = ".,;:!?\"'()[]|"


def _rows_of(code: np.ndarray, kind: int) -> np.ndarray:
    """Weight rows of feature codes; kinds of features with equal codes get other rows. Row 0 is for words without letters."""
    return 1 + (mix64(code + np.uint64(kind << 56)) % np.uint64(ROWS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, of, letters): weight rows with the number of their word, and which words have letters.

    A word, in lower case without punctuation around it, has its lexicon
    entry, affixes of one to four bytes, and all its byte trigrams with marks
    for its ends; it is cut up in numpy, many words at once.
    """
    clean = [w.lower().strip(AROUND) for w in words]
    letters = np.fromiter((LETTER.search(w) is not None for w in clean), bool, len(clean))
    at = np.flatnonzero(letters)
    coded = [clean[i].encode() for i in at.tolist()]
    text = np.frombuffer(b"".join([b"<%b>" % c for c in coded]) + b"   ", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    end = np.cumsum(size + 2)
    start = end - size - 2
    u = np.uint64
    entry = np.fromiter(map(xxhash.xxh32_intdigest, coded), u, len(coded))
    rows, of = [np.zeros(len(clean) - len(at), np.int64), _rows_of(entry, 1)], [np.flatnonzero(~letters), at]
    head, tail = np.zeros(len(at), u), np.zeros(len(at), u)
    for n in range(1, 5):
        some = np.flatnonzero(size >= n)
        head[some] = head[some] << u(8) | text[start[some] + n]
        tail[some] = tail[some] << u(8) | text[end[some] - 1 - n]
        rows += [_rows_of(head[some], 1 + n), _rows_of(tail[some], 5 + n)]
        of += [at[some], at[some]]
    word = np.repeat(np.arange(len(at)), size)
    place = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    rows.append(_rows_of(text[place] << u(16) | text[place + 1] << u(8) | text[place + 2], 10))
    of.append(at[word])
    return np.concatenate(rows), np.concatenate(of), letters


def word_scores(weights: np.ndarray, rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, weights[rows, y], n) for y in range(weights.shape[1])], axis=1)


def posteriors(scores: np.ndarray, steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences laid end to end, in probabilities scaled at each word.

    scores: (words, labels) log potentials; steps: (labels, labels) log
    transitions. Words are laid out by time, longest sequence first, so a step
    in time takes one slice: the sequences that still run.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")  # sequences longer than t
    begin = np.cumsum(alive) - alive
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    time = np.arange(n) - np.repeat(starts, lengths)
    place = begin[time] + np.repeat(rank, lengths)
    emit = np.empty((n, k))
    emit[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(steps - steps.max())
    ahead, back = np.empty((n, k)), np.ones((n, k))
    bounds = list(zip(begin.tolist(), alive.tolist()))
    was = None
    for at, m in bounds:
        a = emit[at : at + m] if was is None else (was[:m] @ move) * emit[at : at + m]
        was = ahead[at : at + m] = a / a.sum(axis=1, keepdims=True)
    move = move.T.copy()
    for (at, _), (after, m) in zip(bounds[-2::-1], bounds[:0:-1]):
        b = (back[after : after + m] * emit[after : after + m]) @ move
        back[at : at + m] = b / b.sum(axis=1, keepdims=True)
    ahead *= back
    ahead /= ahead.sum(axis=1, keepdims=True)
    return ahead[place]


def train(texts: list[tuple[str, str]], labels: list[str], passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (ROWS, labels) and transitions (labels, labels) from all words of (text, label) rows.

    All pieces of PIECE words are laid end to end in a seeded order and cut
    into sequences of LENGTH (the last one begins earlier, so as to be full),
    so languages change within them. Each pass takes all sequences, AT_ONCE a
    step, in another order.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    weights, moves = np.zeros((ROWS, k)), np.zeros((k, k))
    known: dict[str, int] = {}
    pieces = []
    for text, label in texts:
        words = np.array([known.setdefault(w, len(known)) for w in text.split()], np.int64)
        y = labels.index(label)
        pieces += [(words[i : i + PIECE], y) for i in range(0, len(words), PIECE)]
    if not pieces:
        return weights, moves
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    words, gold = np.concatenate([p for p, _ in pieces]), np.repeat([y for _, y in pieces], [len(p) for p, _ in pieces])
    length = min(LENGTH, len(words))
    starts = np.arange(0, len(words), length)
    starts[-1] = len(words) - length
    at = starts[:, None] + np.arange(length)
    words, gold = words[at], gold[at]
    rows, of, _ = features(list(known))
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    ends = np.searchsorted(of, np.arange(len(known) + 1))
    seen_w, seen_m = np.full((ROWS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(passes):
        mixed = rng.permutation(len(words))
        for i in range(0, len(mixed), AT_ONCE):
            some = mixed[i : i + AT_ONCE]
            # the words of this step, and their features
            distinct, t = np.unique(words[some], return_inverse=True)
            t, g = t.reshape(-1), gold[some].reshape(-1)
            sizes = ends[distinct + 1] - ends[distinct]
            own = np.repeat(ends[distinct], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            r, o = rows[own], np.repeat(np.arange(len(distinct)), sizes)
            slope_w, slope_m = _slopes(word_scores(weights, r, o, len(distinct))[t], moves, g.reshape(len(some), length))
            by_word = np.stack([np.bincount(t, slope_w[:, y], len(distinct)) for y in range(k)], axis=1)
            slope_w = np.stack([np.bincount(r, by_word[o, y], ROWS) for y in range(k)], axis=1) / len(t) - DECAY * weights / len(t)
            slope_m /= len(t)
            seen_w += slope_w**2
            seen_m += slope_m**2
            weights += RATE * slope_w / np.sqrt(seen_w)
            moves += RATE * slope_m / np.sqrt(seen_m)
    return weights, moves


def _slopes(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log likelihood of gold (sequences, length): by word and label, and by transition."""
    total, length = gold.shape
    k = len(moves)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(total, length, k)
    move = np.exp(moves - moves.max())
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    for t in range(length):
        a = emit[:, t] if t == 0 else (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (back[:, t + 1] * emit[:, t + 1]) @ move.T
        back[:, t] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    by_word = -p.reshape(-1, k)
    by_word[np.arange(total * length), gold.reshape(-1)] += 1
    # expected transitions, from forward values and the backward ones of the word after
    joint = ahead[:, :-1, :, None] * move * (emit * back)[:, 1:, None, :]
    joint /= np.maximum(joint.sum(axis=(2, 3), keepdims=True), 1e-300)
    by_move = -joint.sum(axis=(0, 1))
    np.add.at(by_move, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
    return by_word, by_move


class Model:
    """A trained field; keeps the scores of words it has met."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights.astype(np.float32), moves
        self.place: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(labels)))
        self.letters = np.empty(1 << 12, bool)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the score table for words; scores new ones, in one go."""
        place = self.place
        if len(place) > WORDS_KEPT:
            place.clear()
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            rows, of, letters = features(new)
            start = len(place)
            place.update(zip(new, range(start, start + len(new))))
            while len(place) > len(self.letters):
                self.table, self.letters = np.concatenate([self.table, self.table]), np.concatenate([self.letters, self.letters])
            self.table[start : len(place)] = word_scores(self.weights, rows, of, len(new))
            self.letters[start : len(place)] = letters
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words end to end, which have letters, and each text's number of words."""
        split = [t.split() for t in texts]
        return *self._words(split), np.fromiter(map(len, split), np.int64, len(split))

    def _words(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = self.places([w for ws in split for w in ws])
        if not len(at) or not self.labels:
            return np.zeros((0, len(self.labels))), np.zeros(0, bool)
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        return posteriors(self.table[at], self.moves, starts, counts[some]), self.letters[at]

    def languages(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Each text's language and score; null texts and those without letters are unknown, with score 0.

        Texts of like length go through forward-backward together, so that a
        long one doesn't make short ones wait.
        """
        order = sorted((i for i, t in enumerate(texts) if t and self.labels), key=lambda i: len(texts[i]))
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = 0
        while at < len(order):
            to, total = at, 0
            while to < len(order) and (to == at or total + len(texts[order[to]]) <= CHARS_AT_ONCE):
                total += len(texts[order[to]])
                to += 1
            split = {i: ws for i in order[at:to] if (ws := texts[i].split())}
            some = list(split)
            at = to
            p, letters = self._words(list(split.values()))
            if not len(p):
                continue
            counts = np.array([len(split[i]) for i in some])
            first = np.cumsum(counts) - counts
            n = np.add.reduceat(letters.astype(np.int64), first)
            mean = np.add.reduceat(p * letters[:, None], first, axis=0) / np.maximum(n, 1)[:, None]
            best = mean.argmax(axis=1)
            for i, y, m, v in zip(some, best.tolist(), n.tolist(), mean.max(axis=1).tolist()):
                if m:
                    names[i], scores[i] = self.labels[y], min(1.0, max(0.0, v))
        return names, scores


def labelled_sample(docs: DataFrame, rows: int = SAMPLE, seed: int = SEED) -> list[tuple[str, str]]:
    """At most rows (text, lang) pairs of each language of docs (text, lang), with whole texts.

    Texts are dealt by hash into as many cells a language, and the least hash
    of each cell is taken: counts and hashes are merged before the shuffle.
    """
    docs = docs.where("text is not null and lang is not null")
    hashed = docs.select("text", "lang", F.xxhash64(F.lit(seed), "text").alias("h"))
    cell = F.pmod(F.shiftright("h", 7), F.lit(rows))
    least = settled(hashed.groupBy("lang", cell.alias("cell")).agg(F.min("h").alias("h")).select("lang", "h"))
    small = least.count() <= BROADCAST_ROWS  # of a hash and a language; else the join shuffles
    taken = hashed.join(F.broadcast(least) if small else least, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    return [(r.text, r.lang) for r in taken.orderBy("lang", "h").collect()]


@trimmed
def _predicted(batches, shared):
    with held(lambda: Model(*pickle.loads(shared.value))) as model:
        for batch in batches:
            for b in slices(batch, BYTES_AT_ONCE):
                names, scores = model.languages(b.column("text").cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, training: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score added, by a field trained on a sample of training (text, lang).

    Null and empty texts and texts without letters are ``und`` with score 0.
    With no labelled row everything is ``und``. Very long texts are read
    whole; of languages that tie the first by code point wins. Repeated rows
    and other columns stay, but columns named lang_pred or score are replaced.
    An empty table gives an empty one. Model and sample grow with the number
    of languages, which is to be a small one (tens).
    """
    docs = docs.drop("lang_pred", "score")
    sample = labelled_sample(training, rows)
    labels = sorted({lang for _, lang in sample})
    weights, moves = train(sample, labels)
    freed(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((labels, weights.astype(np.float32), moves)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(lambda b: _predicted(b, shared), schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_crf_language(docs: DataFrame) -> DataFrame:
    training = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    found = identify(docs.select("doc_id", "text"), training)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
