"""The training-data operators against brute force, on small tables."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.llm import bpe, chat, iblt, langid, linededup, media, mixing, recompress, simhash, warc
from loomseq.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", " \t\n", "a", "Ünï çödé", "x " * 3000, "same line\nsame line\nsame line\nsame line\n", "\n\n\n"]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for c, v in more.items():
        df = df.withColumn(c, v)
    return df


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def some_texts(seed, n=60, vocab=40):
    r = random.Random(seed)
    base = [f"w{r.randrange(vocab)}" for _ in range(400)]
    out = list(EDGES)
    for _ in range(n):
        s = r.randrange(300)
        part = base[s : s + r.randrange(100)]
        out.append(" ".join([f"w{r.randrange(vocab)}" for _ in range(r.randrange(30))] + part + [f"w{r.randrange(vocab)}" for _ in range(r.randrange(20))]))
    return out + out[-5:]


# SimHash


def test_golay_is_perfect():
    _, errors = simhash.golay()
    assert len(set(errors.tolist())) == 2048
    x = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.uint32)
    keys, valid = simhash.nearby(x)
    for bits in (1, 2):
        y = x.copy()
        for row in range(len(y)):
            for b in random.Random(row).sample(range(23), bits):
                y[row] ^= np.uint32(1 << b)
        other, ok = simhash.nearby(y)
        for a, v, b, w in zip(keys, valid, other, ok):
            assert set(a[v]) & set(b[w])


def test_keys_cover_four_bits():
    r = random.Random(2)
    fp = np.array([r.getrandbits(64) for _ in range(400)], np.uint64)
    near = np.array([int(f) ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for f in fp], np.uint64)
    keys = defaultdict(set)
    for name, x in (("a", fp), ("b", near)):
        k, row = simhash.golay_keys(x)
        for key, i in zip(k.tolist(), row.tolist()):
            keys[name, i].add(key)
    assert all(keys["a", i] & keys["b", i] for i in range(len(fp)))


def _classes(ids, fps):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_against_all_pairs(spark, bucket):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(150):
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    stars = {x.node: x.comp for x in connected_components(simhash.fingerprint_links(df, bucket)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x, f in zip(signed, fps):
        got[stars.get(x, x)].add(f)
    for f, c in _classes(fps, fps).items():
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_query(spark):
    import xxhash

    texts = some_texts(4)
    got = {r.doc_id: r for r in simhash.op4_simhash_golay(frame(spark, texts)).collect()}
    fps = []
    for t in texts:
        ws = [w.decode() for w in (t or "").encode().lower().split()]
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    want = _classes(list(range(len(texts))), fps)
    assert all(got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i] for i in got)
    assert len(got) == len(texts)
    assert simhash.op4_simhash_golay(frame(spark, ["x"]).limit(0)).count() == 0


def test_similar_components(spark):
    r = random.Random(20)
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    texts, want = [], []
    for i in range(60):
        ws = [f"w{r.randrange(900)}" for _ in range(r.randrange(60, 300))]
        near = list(ws)
        for _ in range(1 + i % 4):
            near[r.randrange(len(ws))] = f"new{r.random()}"
        a, b = shingles(ws), shingles(near)
        want.append(len(a & b) / len(a | b))
        texts += [" ".join(ws), "  ".join(near)]
    texts += [texts[0], texts[0].replace(" ", "\n"), " ".join(sorted(texts[2].split()))]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()}
    hits = [got[2 * i] == got[2 * i + 1] for i in range(60)]
    assert sum(h for h, j in zip(hits, want) if j >= 0.84) >= 0.9 * sum(j >= 0.84 for j in want)
    assert not any(h for h, j in zip(hits, want) if j < 0.7)
    assert got[120] == got[121] == got[0] == 0
    assert got[122] == 122  # the same words in another order


def test_similar_components_against_all_pairs(spark):
    r = random.Random(22)
    some = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    texts = []
    for i in range(40):  # cut at the end, appended to, a block replaced; about 0.8, some of over 128 shingles
        ws = some(r.randrange(60, 500))
        k = int(len(ws) * r.choice([0.17, 0.19, 0.2, 0.21, 0.23]))
        texts += [ws, [ws[:-k], ws + some(k), ws[: len(ws) // 2] + some(k // 2) + ws[len(ws) // 2 + k // 2 :]][i % 3]]
    base = some(170)
    for i in range(60):  # each about 0.84 to the base, under 0.8 to most others
        ws = list(base)
        for _ in range(3):
            ws[r.randrange(170)] = f"new{r.random()}"
        texts.append(ws)
    texts.append(base)
    sets = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for ws in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, map(" ".join, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want[80:])) < 5 and 20 < len(set(want[:80])) < 78


# byte-level BPE


def test_bpe_as_the_library(spark):
    tiktoken, tok = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tok.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = [*EDGES, "a" * 5000, "abcab" * 900, "<|endoftext|>", "été 日本語 🙂 x", "".join(r.choice("etaoin shrdlu'ABC123 \n\t.,") for _ in range(4000)), "".join(chr(r.randrange(32, 0x3000)) for _ in range(2000))]
    got = {x.doc_id: x for x in bpe.op5_byte_bpe(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    odd = frame(spark, ["a b", "a b", None], ids=F.lit("x"), n_tokens=F.lit("y"))
    assert sorted(x.n_tokens for x in bpe.op5_byte_bpe(odd.union(odd)).collect()) == [0, 0, 2, 2, 2, 2]
    assert bpe.op5_byte_bpe(odd.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(frame(spark, texts), path, tok.PATTERN), path, tok.PATTERN)
    assert {x.doc_id: bytes(x.bytes).decode() for x in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


# substrings


def _repeats(texts, width):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), gone))
    return out


@pytest.mark.parametrize("width,chunk_bytes", [(35, 4_000_000), (35, 700), (3, 300)])
def test_repeats_against_all_windows(spark, width, chunk_bytes):
    texts = [*some_texts(6, vocab=3 if width == 35 else 60), "ab cd " * 60, "x y ab cd " + "ab cd " * 50]
    got = {r.doc_id: r for r in recompress.remove_repeats(frame(spark, texts), width, chunk_bytes).collect()}
    for i, (n, m, kept, gone) in enumerate(_repeats(texts, width)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, m, kept)
        covered = [j for s in got[i].spans for j in range(s.first, s.last + 1)]
        assert covered == [j for j, g in enumerate(gone) if g]


def test_repeated_rows_and_empty(spark):
    df = frame(spark, [" ".join(f"w{i}" for i in range(40))])
    assert [r.n_removed for r in recompress.remove_repeats(df.union(df)).collect()] == [40, 40]
    assert recompress.remove_repeats(df.limit(0)).count() == 0


# lines


def test_line_chunks(spark):
    r = random.Random(7)
    passage = [f"shared {i} {r.random()}" for i in range(30)]
    texts = list(EDGES)
    for _ in range(25):
        own = [f"own {r.random()}" for _ in range(r.randrange(1, 9))]
        texts.append("\n".join(own + passage + own[:2]))
    texts.append(texts[-1])
    df = frame(spark, texts).selectExpr("*", "1 AS n_lines", "2 AS lines", "3 AS gone")
    out = {x.doc_id: x for x in linededup.remove_repeated_lines(df.drop("n_lines")).collect()}
    assert len(out) == len(texts)
    kept = Counter(line for x in out.values() for line in x.text.split("\n"))
    assert sum(kept[p] for p in passage) < 0.35 * len(passage) * 26
    assert all(kept[p] for p in passage)  # one copy of each stays
    assert all(x.n_lines == len((texts[i] or "").split("\n")) for i, x in out.items())
    assert out[len(texts) - 1].text == ""
    assert all(x.n_removed != 1 for x in out.values())
    single = frame(spark, ["a\nb\nc", "d\ne\nf"])
    assert all(x.n_removed == 0 for x in linededup.remove_repeated_lines(single).collect())


def _line_chunks(text):
    """The chunks of a text, as lists of lines, by plain loops."""
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(a * 257 + b) % 1_000_003 for a, b in zip(h, h[1:])]
    out, start = [], 0
    for i in range(2, len(lines) - 1):
        if r[i] < r[i - 1] and (i + 1 == len(r) or r[i] < r[i + 1]):
            out.append(lines[start:i])
            start = i
    return [*out, lines[start:]]


def _without_repeats(rows):
    """(kept text, lines, removed) of rows (doc_id, text), in order of doc_id."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        kept, gone = [], 0
        chunks = _line_chunks(text)
        for c in chunks:
            if sum(bool(x.strip()) for x in c) >= 2 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
            seen.add(tuple(c))
        out.append(("\n".join(kept), sum(map(len, chunks)), gone))
    return out


def test_line_chunks_against_plain_loops(spark):
    r = random.Random(23)
    pool = [[f"p{i} line {j}" for j in range(r.randrange(2, 25))] for i in range(6)]
    texts = [*EDGES, "\n".join(f"very long {i}" for i in range(5000))]
    for _ in range(60):
        lines = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            s = r.randrange(len(p))
            lines += [f"own {r.random()}" for _ in range(r.randrange(5))] + p[s : s + r.randrange(2, 25)] + r.choice([[], ["", ""]])
        texts.append("\n".join(lines))
    rows = [(5 * i - 40, t) for i, t in enumerate(texts)]
    clash = {c: f"'{c}'" for c in ("dedup_row", "dedup_gone", "dedup_chunks", "chunks", "gone", "row", "tag", "id", "key", "copies", "copy", "j", "h1", "t")}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()], "0 AS n_lines")
    got = sorted(linededup.remove_repeated_lines(df).collect(), key=lambda x: x.doc_id)
    assert [(x.text, x.n_lines, x.n_removed) for x in got] == _without_repeats(rows)
    assert all(x[c] == c for x in got for c in clash)
    query = sorted(linededup.op10_line_chunks(df).collect(), key=lambda x: x.doc_id)
    assert [x.kept_sha256 for x in query] == [hashlib.sha256(x.text.encode()).hexdigest() for x in got]
    assert linededup.op10_line_chunks(df.limit(0)).count() == 0


def test_line_chunks_are_removed_by_row(spark):
    r = random.Random(21)
    long = "\n".join(f"long {r.random()}" for _ in range(60))
    for key in (None, 5):
        rows = [(1, long), (key, long), (key, "own 1\nown 2"), (key, "own 3\nown 4\nown 5"), (key, "own 1\nown 2")]
        out = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(x.text for x in out) == sorted([long, "", rows[2][1], rows[3][1], ""])
        assert sorted(x.n_removed for x in out) == [0, 0, 0, 2, 60]


# sketches


def _print_of(digests, xxh):
    """A sketch by plain loops: cell -> [count, digest XOR, check XOR]."""
    cells = [[0, 0, 0] for _ in range(iblt.SUBTABLES * iblt.CELLS)]
    for key in digests:
        for t in range(iblt.SUBTABLES):
            c = cells[t * iblt.CELLS + xxh(key, t) % iblt.CELLS]
            c[0] += 1
            c[1] ^= key & (1 << 64) - 1
            c[2] ^= xxh(key, -1) & (1 << 32) - 1
    return cells


def _peeled(a, b, xxh):
    """What two sketches have alone, by plain loops; None if their difference doesn't peel."""
    d = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b)]
    only = {1: set(), -1: set()}
    moved = True
    while moved:
        moved = False
        for i, (n, key, check) in enumerate(d):
            signed = key - (1 << 64) if key >> 63 else key
            if n in only and xxh(signed, -1) & (1 << 32) - 1 == check and i % iblt.CELLS == xxh(signed, i // iblt.CELLS) % iblt.CELLS:
                only[n].add(signed)
                for t in range(iblt.SUBTABLES):
                    c = d[t * iblt.CELLS + xxh(signed, t) % iblt.CELLS]
                    c[0], c[1], c[2] = c[0] - n, c[1] ^ key, c[2] ^ check
                moved = True
    return None if any(map(any, d)) else only


def test_sketches_recover_differences(spark):
    import re

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # Spark's hash of a long and an int: each is 8 or 4 bytes, the first one's hash is the seed of the second
    hash_long = lambda x, seed: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    xxh = lambda key, t: signed(xxhash.xxh64_intdigest((t & (1 << 32) - 1).to_bytes(4, "little"), hash_long(key, 42)))
    r = random.Random(8)
    texts = list(EDGES)
    for _ in range(40):
        texts.append("\n".join(f"line {r.randrange(60)}." + r.choice(["", " and more. Also. Bits", " then"]) for _ in range(r.randrange(1, 120))))
    texts += [texts[-1], texts[-2], "\n".join(f"far {i}" for i in range(3000))]
    got = {x.doc_id: x for x in iblt.op8_iblt_fingerprints(frame(spark, texts)).collect()}
    sets = lambda t: {signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.split(iblt.CUT, t) if x}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    read = lambda s: [[int.from_bytes(c[:4], "big"), int.from_bytes(c[4:12], "big"), int.from_bytes(c[12:], "big")] for raw in [base64.b64decode(s)] for c in (raw[i : i + 16] for i in range(0, len(raw), 16))]
    peels = 0
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(near(sets(t), sets(edited)))
        assert got[i].near_next == pytest.approx(near(sets(t), sets(after)))
        prints = read(got[i].fingerprint), read(got[i].edited_fingerprint)
        assert prints == (_print_of(sets(t), xxh), _print_of(sets(edited), xxh))
        only = _peeled(*prints, xxh)
        if only is not None:  # the likeness can be had from the two fingerprints alone
            size = sum(c[0] for c in prints[0][: iblt.CELLS])
            x, y = len(only[1]), len(only[-1])
            assert got[i].near_edited == pytest.approx((size - x) / (size + y) if size + y else 1.0)
            peels += 1
    assert 10 < peels < len(texts)
    assert got[len(texts) - 3].fingerprint == got[len(texts) - 4].fingerprint
    assert iblt.op8_iblt_fingerprints(frame(spark, ["x"]).limit(0)).count() == 0


def test_next_documents(spark):
    far = [(-(2**63), "least"), (2**63 - 1, "most"), (5, "five"), (None, "n1"), (None, "n2"), (None, None), (7, "seven"), (7, "seven"), (7, "other seven"), (2**53 + 1, "odd"), (2**53, "even")]
    df = spark.createDataFrame(far, "doc_id long, text string")
    rows = iblt.with_next(df).collect()
    assert len(rows) == len(far)
    after = defaultdict(list)
    for x in rows:
        after[x.doc_id].append((x.text, x.next_text))
    assert after[-(2**63)] == [("least", "five")] and after[2**53] == [("even", "odd")] and after[2**53 + 1] == [("odd", "most")]
    assert after[5][0][1] in ("seven", "other seven") and after[2**63 - 1][0][1] in ("n1", "n2", "")
    assert sorted(b for key in (2**63 - 1, None) for _, b in after[key]) == ["", "least", "n1", "n2"]
    assert sorted(b for _, b in after[7]).count("even") == 1
    hot = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "CAST(id AS STRING) AS text")
    got = iblt.with_next(hot).collect()
    following = {x.text: x.next_text for x in got}
    assert len(got) == len(following) == len(set(following.values())) == 6000
    at, seen = "5999", 0
    while seen < 6000:  # one round through all rows, ids ascending, nulls last
        at = following[at]
        seen += 1
    assert at == "5999"


# mixing


def test_fit_counts_is_exact():
    r = random.Random(9)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randrange(1, 8))))
        counts = np.array([r.randrange(1, 5) for _ in lengths])
        budget = r.randrange(0, int((lengths * counts).sum()) + 3)
        take = mixing.fit_counts(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and (take >= 0).all()
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_counts_of_long_documents():
    fit = lambda lengths, counts, budget: mixing.fit_counts(np.array(lengths), np.array(counts), budget, 100).tolist()
    assert fit([10**12], [1], 5 * 10**11) == [0]
    assert fit([3, 10**9, 10**12], [1, 2, 1], 10**12 + 7) == [1, 0, 1]
    assert fit([900, 950, 2000], [1, 1, 1], 1000) == [0, 1, 0]


def test_mix(spark):
    r = random.Random(10)
    rows = [(i, " ".join("w" * r.randrange(0, 60)), "en", r.choice(["a", "b", "c", "é", None, "a", "a"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(1))
    got = mixing.op1_mix_knapsack(df).collect()
    assert sorted(got) == sorted(mixing.op1_mix_knapsack(df.repartition(7)).collect())
    source = {i: s for i, _, _, s, _ in rows}
    total, taken, target = Counter(), Counter(), {}
    for x in got:
        total[source[x.doc_id]] += x.size
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
        assert x.taken in (0, x.size, 2 * x.size)
    names = sorted(n for n in total if n is not None) + [None]
    weight = dict(zip(names, [3, 1, 2] * 9))
    want, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 2 * total[n]}
        if not over:
            want |= share
            break
        for n in over:
            want[n] = 2 * total[n]
            left -= want[n]
        free -= over
    for n in names:
        assert target[n] == pytest.approx(want[n])
        assert abs(taken[n] - want[n]) <= 1
    assert mixing.op1_mix_knapsack(df.limit(0)).count() == 0


def test_mix_of_odd_tables(spark):
    names = ["mix_quota", "mix_size", "mix_key", "mix_hash", "mix_cell", "mix_nth", "mix_passes", "row", "quota", "passes", "nth", "n", "target", "copies"]
    rows = [(None, "a", 5, "k1"), (None, "a", 5, "k1"), (1, "a", 5, "k1"), (1, "a", 7, "k2"), (2, None, None, None), (3, "b", 10**12, "k3"), (4, "b", 0, "k4")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, keep string").withColumns({n: F.lit(n) for n in names})
    out = mixing.mix(df).collect()
    assert sorted((x.doc_id or 0, x.keep or "") for x in out) == sorted((r[0] or 0, r[3] or "") for r in rows)
    assert all(x[n] == n for x in out for n in names[:-2]) and all(0 <= x.copies <= 2 for x in out)
    many = spark.range(5000).selectExpr("id AS doc_id", "CONCAT('host', id % 2500) AS source", "id % 7 AS size")
    weights = {x.mix_key: x.target / max(x.source_size, 1) for x in mixing.source_targets(many).collect()}
    assert len(weights) == 2500
    mixed = mixing.mix(many).selectExpr("sum(copies * size)", "sum(target / 2)").first()
    assert abs(mixed[0] - 1.5 * sum(i % 7 for i in range(5000))) < 2500


# archives


def test_archive(spark, tmp_path):
    big, kind = "<p>" + "x" * 200, "page_id long, url string, html string"
    rows = [(5, "http://a", big), (3, "http://b\r\nEvil: 1", big), (9, None, big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", "é" * 100), (4, "u", "small")]
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in warc.op3_warc_content_addressed(df).collect())
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = sorted(((p, len((h or "").encode()), sha(h), "revisit" if h == big and p != 3 else "response", 3 if h == big and p != 3 else None) for p, _, h in rows), key=str)
    assert sorted(got, key=str) == want
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    assert spark.read.parquet(path + "/payloads").count() == 4
    for r in warc.parsed(warc.read_archive(spark, path)).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert body[length:] == b"\r\n\r\n" and body[:length] == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert b"\r\nEvil" not in head
    names = [x.name for x in warc.read_archive(spark, path).selectExpr("regexp_extract(decode(header, 'UTF-8'), 'WARC-Record-ID: (.*)', 1) AS name").collect()]
    assert len(set(names)) == len(rows)  # also of repeated rows
    assert warc.op3_warc_content_addressed(df.limit(0)).count() == 0


# chat


def test_chat(spark):
    r = random.Random(11)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\INST]", "hi", "\n", "é🙂", "<", "/", "s>", "["]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "odd\nrole\\n", "[INST]", None]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randrange(12)))])))
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (0, 0, rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns = [x[1:] for x in sorted(turns)]
        assert chat.read_back(made[c].formatted) == turns
        assert [chat.unescape(made[c].formatted[s.start : s.end]) for s in made[c].loss] == [x for role, x in turns if role == "assistant"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {x.conv_id: x.formatted for x in chat.format_conversations(df).collect()} == {c: x.formatted for c, x in made.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chat.op6_chat_columnar(df.limit(0)).count() == 1


# media


def test_images():
    r = np.random.default_rng(12)
    grey = r.integers(0, 256, (5, 7)).astype(np.uint8)
    for put in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(put(grey))[:, :, 0] == grey).all()
    assert media.decode(b"P2\n# c\n2 1\n255\n3 200\n").ravel().tolist() == [3, 200]
    assert media.decode(b"P1 3 1\n101").ravel().tolist() == [0, 1, 0]
    assert media.decode(b"P4 3 1\n\xa0").ravel().tolist() == [0, 1, 0]
    assert media.decode(b"P6 1 1 255\nabc").tolist() == [[[97, 98, 99]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    for rows, columns in ((2, 3), (8, 9)):
        out = media.area_resize(grey, rows, columns)
        fine = np.kron(grey.astype(float), np.ones((rows, columns)))  # each cell is whole pixels of this
        want = fine.reshape(rows, 5, columns, 7).mean(axis=(1, 3))
        assert np.allclose(out, want)


def _plain_tile(payload):
    """Means over the areas of an image 64 wide, by fractions, and the bits of neighbours that grow."""
    from fractions import Fraction

    image = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    (rows, columns), h = media.TILE, len(image)

    def weights(n, parts, k):
        low, high = Fraction(k * n, parts), Fraction((k + 1) * n, parts)
        return {i: min(high, i + 1) - max(low, i) for i in range(int(low), min(n, int(high) + 1)) if min(high, i + 1) > max(low, i)}

    tile = []
    for y in range(rows):
        wy = weights(h, rows, y)
        column = [sum(f * image[i][j] for i, f in wy.items()) for j in range(64)]
        line = []
        for x in range(columns):
            wx = weights(64, columns, x)
            line.append(round(sum(f * column[j] for j, f in wx.items()) / sum(wy.values()) / sum(wx.values())))
        tile.append(line)
    bits = [int(b > a) for line in tile for a, b in zip(line, line[1:])]
    return tile, f"{int(''.join(map(str, bits)), 2):016x}"


def test_media(spark, monkeypatch):
    monkeypatch.setattr(media, "STRIP", 7)  # here; the workers use the large one
    r = random.Random(24)
    texts = [*EDGES, "x" * 64, "y" * 65, *["".join(chr(r.randrange(32, 500)) for _ in range(r.randrange(3000))) for _ in range(6)]]
    df = frame(spark, texts, tile=F.lit("t"), media=F.lit(1))
    df = df.union(df.where("doc_id = 3"))
    got = {x.doc_id: x for x in media.op7_media_netpbm(df).collect()}
    tiles = {x.doc_id: np.load(__import__("io").BytesIO(x.tile)) for x in media.measure(media.store_texts(df, "bmp")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile, feature = _plain_tile(padded)
        assert tiles[i].tolist() == tile and x.feature == feature
        assert x.tile_sha256 == hashlib.sha256(media.npy(np.array(tile, np.uint8))).hexdigest()
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        assert np.clip(np.rint(media.area_resize(image, *media.TILE)), 0, 255).tolist() == tile
    assert got[0].feature == got[1].feature and len(got[0].feature) == 16
    assert media.op7_media_netpbm(df).count() == len(texts) + 1 and media.op7_media_netpbm(df.limit(0)).count() == 0


# languages


def _plain_posteriors(scores, steps):
    n, k = scores.shape
    from itertools import product

    total, out = 0.0, np.zeros((n, k))
    for path in product(range(k), repeat=n):
        w = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            out[t, y] += w
    return out / total


def test_forward_backward():
    r = np.random.default_rng(13)
    lengths = np.array([3, 1, 5, 2])
    scores, steps = r.normal(size=(11, 3)), r.normal(size=(3, 3))
    starts = np.cumsum(lengths) - lengths
    got = langid.posteriors(scores, steps, starts, lengths)
    for s, n in zip(starts, lengths):
        assert np.allclose(got[s : s + n], _plain_posteriors(scores[s : s + n], steps))


def test_language_query(spark):
    r = random.Random(14)
    vocab = {"aa": ["the", "of", "thing", "was"], "bb": ["der", "und", "nicht", "schon"], "cc": ["les", "une", "dans", "être"]}
    rows = []
    for i in range(150):
        lang = r.choice(list(vocab))
        rows.append((i, " ".join(r.choice(vocab[lang]) + r.choice(["", "x", "s"]) for _ in range(r.randrange(1, 50))), lang, "s", 0))
    rows += [(200 + i, t, "aa", "s", 0) for i, t in enumerate([None, "", "12 | 3", "the " * 3000])]
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in langid.op2_crf_language(df).collect()}
    assert len(got) == len(rows)
    held = [x for x in rows[:150] if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)
    assert sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.9 * len(held)
    assert [got[200 + i].lang_pred for i in range(4)] == ["und", "und", "und", "aa"]
    # labels of held-out rows are no input
    other = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    assert {x.doc_id: x.lang_pred for x in langid.op2_crf_language(other).collect()} == {i: x.lang_pred for i, x in got.items()}
    assert langid.op2_crf_language(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path)
    got = langid.op2_crf_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 150
    clear = [x for x in got if x.lang_pred != "und"]
    assert len(clear) >= 0.95 * len(got) and sum(x.lang_pred == x.lang for x in clear) >= 0.97 * len(clear)


def test_languages_of_odd_tables(spark):
    rows = [(i, "the of thing was", "aa") for i in range(30)] + [(30 + i, "der und nicht schon", "bb") for i in range(30)]
    rows += [(None, "der und", "bb"), (None, "der und", "bb"), (7, "der und nicht " * 4000, None), (7, None, "zz"), (8, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("x"), "score": F.lit("y"), "h": F.lit(1), "cell": F.lit(2)})
    out = langid.identify(df, df.select("text", "lang"))
    assert out.columns.count("lang_pred") == 1 and out.count() == len(rows)
    assert Counter((x.text or "")[:7] + x.lang_pred for x in out.collect()) == {"the of aa": 30, "der undbb": 33, "und": 2}
    assert all(x.h == 1 and x.cell == 2 for x in out.collect())
    none = langid.identify(df, df.limit(0).select("text", "lang"))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_code_switching():
    r = random.Random(15)
    vocab = {"aa": ["the", "of", "thing", "was"], "bb": ["der", "und", "nicht", "schon"]}
    texts = [(" ".join(r.choice(v) for _ in range(40)), y) for y, v in vocab.items() for _ in range(20)]
    model = langid.Model(["aa", "bb"], *langid.train(texts, ["aa", "bb"]))
    p, letters, _ = model.words(["the thing was of der und nicht schon"])
    assert letters.all() and p.argmax(axis=1).tolist() == [0] * 4 + [1] * 4


def test_bpe_merges_a_repeated_pretoken_once(monkeypatch):
    """A task's usual number of different pre-tokens fits what is kept, so one that comes again isn't merged again."""
    from loomseq.llm import bpe

    merged = []
    monkeypatch.setattr(bpe, "merge_ranks", lambda piece, ranks: merged.append(piece) or [0])
    kept = bpe._Kept({})
    words = [f" w{i}" for i in range(250_000)]
    assert all(kept[w] == (0,) for w in words * 2) and len(merged) == len(words)


def test_components_give_the_drivers_memory_back(spark, monkeypatch):
    from loomseq.llm import graph

    rounds = []
    monkeypatch.setattr(graph, "freed", lambda session: rounds.append(session))
    found = graph.connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    assert {r.node: r.comp for r in found.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and rounds
