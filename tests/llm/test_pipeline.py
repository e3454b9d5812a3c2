"""The pipeline's stages, each on its own input, and their order."""

import base64
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _without_repeats

import corpus_pipeline as P
from loomseq.llm import langid, simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, target string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    vocab = {"aa": [f"the{i}" for i in range(60)], "bb": [f"und{i}" for i in range(60)]}
    rows = []
    for i in range(80):
        lang = r.choice(list(vocab))
        t = "\n".join(" ".join(r.choice(vocab[lang]) for _ in range(12)) for _ in range(r.randrange(4, 9)))
        rows.append((i, t, lang, r.choice("xyz"), len(t), "r", 1, "t"))
    rows += [(100 + i, rows[3][1], "aa", "x", 0, "r", 1, "t") for i in range(4)]
    rows += [(200, None, "aa", None, 0, None, None, None), (201, "12 | 34", None, None, 0, None, None, None), rows[0], (None, rows[5][1], "aa", "x", 0, "r", 1, "t")]
    return spark.createDataFrame(rows, KIND)


def test_stages_keep_the_columns(spark, docs):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_language_rejects(spark, docs):
    ids = Counter(r.doc_id for r in P.language(spark, docs, "").collect())
    assert 200 not in ids and 201 not in ids and ids[0] == 2 and len(ids) == 85


def test_near_dedup_keeps_one(spark, docs):
    out = P.near_dedup(spark, docs, "").collect()
    texts = Counter(r.text for r in out)
    assert max(texts.values()) == 1
    ids = {r.doc_id for r in out}
    assert 3 in ids and not ids & {100, 101, 102, 103, None}


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    r = random.Random(31)
    some = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(40))
    a, b, c, d = some(), some(), some(), some()
    rows = [(1, a), (1, b), (1, b), (None, c), (None, d), (2, a.upper()), (None, None), (3, " "), (None, d + " more")]
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("own")).withColumn("key", F.lit(1)), "").collect()
    near = {(None, d), (None, d + " more")}
    found = {(x.doc_id, x.text) for x in out}
    assert len(out) == 5 and found - near == {(1, a), (1, b), (None, c), (3, " ")} and len(found & near) == 1
    assert all(x.t == "own" and x.key == 1 for x in out)


def _shingles(text):
    ws = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _near_classes(rows):
    """Row number -> least row number of its class, and the similar pairs, by comparing all that share a shingle."""
    sets = [_shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, x in enumerate(sets):
        for g in x or {None}:
            by[g].append(i)
    both = Counter((i, j) for ids in by.values() for n, j in enumerate(ids) for i in ids[:n])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    found = {}
    for (i, j), n in both.items():
        union = len(sets[i]) + len(sets[j]) - n
        near = n / union if union else 1.0
        if near >= 0.8:
            found[i, j] = near
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return [root(i) for i in range(len(rows))], found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_near_dedup_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # copies with words put in at random, so that many pairs are just above and below 0.8
    r = random.Random(33)
    rows = sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
    for i, (_, text) in enumerate(rows[:120]):
        ws = (text or "").split()
        for _ in range(max(1, len(ws) * (10 + i % 16) // 600)):
            ws.insert(r.randrange(len(ws) + 1), f"new{r.random()}")
        rows.append((100_000 + i, " ".join(ws)))
    up, pairs = _near_classes(rows)
    assert sum(x < 0.82 for x in pairs.values()) > 5
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(rows[i][0] for i in set(up))


def test_near_dedup_of_copies_without_a_centre(spark, monkeypatch):
    # many pairs are similar, but no text is similar to most of the others
    r = random.Random(35)
    base, rows = [f"w{r.randrange(3000)}" for _ in range(250)], []
    for i in range(400):
        ws = list(base)
        for _ in range(r.randint(2, 5)):
            ws[r.randrange(len(ws))] = f"w{r.randrange(3000)}"
        rows.append((i, " ".join(ws)))
    up, pairs = _near_classes(rows)
    assert len(pairs) > 10_000 and len(set(up)) > 1
    compared, settled = [], simhash.settled

    def counted(df):
        found = settled(df)
        if found.columns == ["a", "b"]:
            compared.append(found.count())
        return found

    monkeypatch.setattr(simhash, "settled", counted)
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(up))
    assert max(compared) < 10 * len(rows)


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(36)
    for n in (0, 1, 30, 500, 5000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 8 :], r.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
        bits = [np.frombuffer(simhash.sketch(s), np.uint64).reshape(1, -1) for s in (x, y)]
        assert simhash._sketch_bits(bits[0], bits[1][0])[0] <= len(np.setxor1d(x, y))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_stages_against_plain_loops(spark, tmp_path):
    tiktoken, tok = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sample = langid.labelled_sample(given.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    labels = sorted({y for _, y in sample})
    rows = sorted((x.doc_id, x.text) for x in given.select("doc_id", "text").collect())
    names, scores = langid.Model(labels, *langid.train(sample, labels)).languages([t for _, t in rows])
    rows = [x for x, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5]
    of = lambda name: sorted((x.doc_id, x.text) for x in out[name].collect())
    assert of("language") == rows
    rows = [(i, text) for (i, _), (text, _, gone) in zip(rows, _without_repeats(rows)) if not gone or text.strip()]
    assert of("line_dedup") == rows
    rows = [rows[i] for i in sorted(set(_near_classes(rows)[0]))]
    assert of("near_dedup") == rows
    mixed = Counter(x[0] for x in of("mix"))
    assert set(mixed) <= {i for i, _ in rows} and max(mixed.values()) <= 2
    size, source = {i: len(t.encode().split()) for i, t in rows}, {x.doc_id: x.source for x in out["near_dedup"].collect()}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        taken[source[i]] += n * mixed[i]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(total.values()), abs=len(total)) or any(taken[s] >= 2 * total[s] - 1 for s in total)
    with open(tok.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, text = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={}), dict(rows)
    tokens = out["encode"].collect()
    assert Counter(x.doc_id for x in tokens) == mixed
    for x in tokens:
        ids = own.encode_ordinary(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_mix_repeats_rows(spark, docs):
    out = P.mix(spark, docs.where("doc_id < 80").dropDuplicates(["doc_id"]), "")
    assert out.count() > 80 and max(Counter(r.doc_id for r in out.collect()).values()) <= 2


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 60
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "mix", "encode"]
    assert out.where(F.col("n_tokens") == 0).count() == 0
