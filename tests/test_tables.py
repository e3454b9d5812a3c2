"""Statistics, clustering, matrices, alignment and k-mer tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import alignment as A
from loomseq.operators import clustering as C
from loomseq.operators import kmers as K
from loomseq.operators import matrices as M
from loomseq.operators import statistics as S


def test_descriptive(spark):
    df = spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("value"))
    r = S.descriptive_stats(df, ["g"]).first()
    assert (r.mean, r.median, r.q1, r.q3) == (5.5, 5.5, 3, 8)
    assert r.std_dev == pytest.approx(2.8722813232690143)


def test_bh(spark):
    ps = [0.01, 0.04, 0.03, 0.5, 0.8, 0.1]
    df = spark.createDataFrame(list(enumerate(ps)), "idx long, value double")
    assert [r.q for r in S.bh_correction(df).orderBy("idx").collect()] == pytest.approx([0.06] * 6)
    standard = [r.q for r in S.bh_correction(df, "standard").orderBy("idx").collect()]
    assert standard == pytest.approx([0.06, 0.08, 0.08, 0.6, 0.8, 0.15])


def test_mann_whitney(spark):
    rows = [(i, float(i), i < 5) for i in range(10)]
    r = S.mann_whitney_u(spark.createDataFrame(rows, "idx long, value double, is_a boolean")).first()
    assert r.u_statistic == 0 and r.p_value == pytest.approx(math.exp(-(12.5**2) / (25 * 11 / 12) / 2) / math.sqrt(2 * math.pi))


def test_correlation(spark):
    rows = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip([1, 2, 3, 4, 5], [2, 4, 5, 4, 5]))]
    df = spark.createDataFrame([*rows, ("h", 0, 1.0, 1.0), ("h", 1, 1.0, 2.0)], "g string, idx long, x double, y double")
    assert {r.g: round(r.r, 9) for r in S.pearson_correlation(df, ["g"]).collect()} == {"g": 0.774596669, "h": 0.0}
    assert len(S.rolling_correlation(df, ["g"], 3).collect()) == 3


def test_simulations(spark):
    df = spark.createDataFrame([(i, float(i), i < 5) for i in range(10)], "idx long, value double, is_a boolean")
    a, b = S.permutation_test(df, 200, 1).first(), S.permutation_test(df, 200, 1).first()
    assert a == b and a.observed_diff == -5 and a.p_value < 0.1
    r = S.bootstrap_ci(df, 200, 0.9).first()
    assert r.ci_lower < r["mean"] < r.ci_upper
    with pytest.raises(ValueError):
        S.bootstrap_ci(df, 0, 0.9)


def test_umi_collapse(spark):
    umis = ["AAGG", "AAGT", "TTCC", "TTCG", "GGGG", "AAGG"]
    df = spark.createDataFrame([("c", i, u) for i, u in enumerate(umis)], "cell string, idx long, umi string")
    got = {r.representative: r.members for r in C.umi_collapse(df, ["cell"], 1).collect()}
    assert got == {"AAGG": [0, 1, 5], "TTCC": [2, 3], "GGGG": [4]}


def test_greedy_cluster(spark):
    seqs = ["ATGCGC", "ATGCGC", "TTTAAA", "TTTAAA", "ATGCGC"]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(seqs)], "g long, idx long, seq string")
    assert {r.representative: r.members for r in C.greedy_cluster(df, ["g"], 0.8, 3).collect()} == {"ATGCGC": [0, 1, 4], "TTTAAA": [2, 3]}


def _plain(a, b, match, mismatch, gap, local=False):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                h[i][j] = 0 if local else (i + j) * gap
            else:
                h[i][j] = max(h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap, *([0] if local else []))
    return max(map(max, h)) if local else h[-1][-1]


def test_alignments():
    assert A.align_global("ATGC", "ATCC", 2, -1, -1) == ("ATGC", "ATCC", 5)
    assert A.align_local("ATGC", "ATGC", 2, -1, -1) == ("ATGC", "ATGC", 8)
    assert A.align_local("AAA", "CCC", 2, -1, -1) == ("", "", 0)
    assert A.score_banded("ATGCAT", "ATGCAT", 2, 2, -1, -1) == 12
    with pytest.raises(ValueError):
        A.score_banded("A", "AAAAA", 2, 2, -1, -1)
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randrange(0, 14))) for _ in range(2))
        x, y, s = A.align_global(a, b, 2, -1, -2)
        assert s == _plain(a, b, 2, -1, -2) and x.replace("-", "") == a and y.replace("-", "") == b
        assert A.align_local(a, b, 2, -1, -2)[2] == _plain(a, b, 2, -1, -2, True)
        assert A.score_banded(a, b, 14, 2, -1, -2) == s
    pairs = [tuple("".join(r.choice("ACGT") for _ in range(r.randrange(n, n + 4))) for _ in range(2)) for n in range(0, 20) for _ in range(3)]
    for band in (3, 5):
        want = []
        for a, b in pairs:
            h = {}
            for i in range(len(a) + 1):
                for j in range(max(0, i - band), min(len(b), i + band) + 1):
                    steps = [h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1)] if i and j else []
                    steps += [h[k] - 2 for k in ((i - 1, j), (i, j - 1)) if k in h]
                    h[i, j] = max(steps, default=0)
            want.append(h[len(a), len(b)])
        assert A.scored_banded(pairs, band, 2, -1, -2) == want


def test_places_of_skewed_values(spark):
    r = random.Random(41)
    rows = [(r.choice("gh"), r.choice([1.0, 1.0, 1.0, r.random(), 1e300, -5.0])) for _ in range(5000)] + [("h", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, value double").where("value is not null")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    for x in S.descriptive_stats(df, ["g"]).collect():
        v = sorted(by[x.g])
        n = len(v)
        assert (x["count"], x.min, x.max, x.q1, x.q3) == (n, v[0], v[-1], v[n // 4], v[3 * n // 4]) and x.median == (v[(n - 1) // 2] + v[n // 2]) / 2
    assert S.descriptive_stats(df.limit(0), ["g"]).count() == 0


def test_ranks_of_skewed_values(spark):
    r = random.Random(42)
    ps = [r.choice([1.0, 1.0, 0.05, r.random(), r.random() / 1000]) for _ in range(4000)]
    df = spark.createDataFrame([(3 * i, p, i % 3 == 0) for i, p in enumerate(ps)], "idx long, value double, is_a boolean")
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    q = {i: ps[i] * len(ps) / (k + 1) for k, i in enumerate(order)}
    for method, ranks in (("prefix", order), ("standard", order[::-1])):
        want, least = {}, 1.0
        for i in ranks:
            least = min(least, q[i])
            want[3 * i] = least
        assert {x.idx: x.q for x in S.bh_correction(df, method).collect()} == pytest.approx(want)
    place = {i: k + 1 for k, i in enumerate(sorted(range(len(ps)), key=lambda i: (ps[i], i % 3 != 0, i)))}
    na = sum(i % 3 == 0 for i in range(len(ps)))
    ua = sum(place[i] for i in range(len(ps)) if i % 3 == 0) - na * (na + 1) / 2
    assert S.mann_whitney_u(df).first().u_statistic == min(ua, na * (len(ps) - na) - ua)


def test_rolling_windows(spark, monkeypatch):
    import statistics

    monkeypatch.setattr(S, "BLOCK", 16)
    r = random.Random(43)
    rows = [(g, i * i, float(r.randrange(4)), r.random()) for g, n in (("a", 300), ("b", 5), ("c", 2)) for i in range(n)] + [("d", i, 1.0, float(i)) for i in range(9)]
    got = {(x.g, x.idx): x.r for x in S.rolling_correlation(spark.createDataFrame(rows, "g string, idx long, x double, y double"), ["g"], 3).collect()}
    want = {}
    for g in "abcd":
        own = [x for x in rows if x[0] == g]
        for i in range(len(own) - 2):
            xs, ys = [x[2] for x in own[i : i + 3]], [x[3] for x in own[i : i + 3]]
            want[g, own[i][1]] = statistics.correlation(xs, ys) if len(set(xs)) > 1 else 0.0
    assert got == pytest.approx(want, abs=1e-6)


def test_permutations_against_sorting(spark):
    r = random.Random(44)
    rows = [(i, float(r.randrange(20)), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "idx long, value double, is_a boolean")
    hashed = spark.range(1, 31).join(df).select(F.col("id").alias("trial"), "idx", "value", S._drawn("xxhash64", 5, F.col("id").cast("int"), F.col("idx")).alias("h")).collect()
    seen = sum(v for _, v, a in rows if a) / 100 - sum(v for _, v, a in rows if not a) / 300
    hits = 0
    for t in range(1, 31):
        own = [x.value for x in sorted((x for x in hashed if x.trial == t), key=lambda x: x.h)]
        hits += abs(sum(own[:100]) / 100 - sum(own[100:]) / 300) >= abs(seen)
    got = S.permutation_test(df, 30, 5).first()
    assert got.observed_diff == pytest.approx(seen) and got.p_value == hits / 30


def test_clusters_against_plain_folds(spark):
    r = random.Random(45)

    def edits(a, c):
        d = list(range(len(c) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(c, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    def folded(items, near):
        heads = []
        for idx, x in items:
            hit = next((h for h in heads if near(h[0], x)), None)
            if hit:
                hit[1].append(idx)
            else:
                heads.append((x, [idx]))
        return sorted((h, m) for h, m in heads)

    rows = [(g, i, "".join(r.choice("ACGT") for _ in range(r.choice([4, 5, 6])))) for i, g in enumerate(r.choice("xy") for _ in range(160))]
    df = spark.createDataFrame([*rows, ("x", 999, None)], "g string, idx long, umi string")
    for most in (0, 1, 2):
        got = C.umi_collapse(df, ["g"], most).collect()
        for g in "xy":
            assert sorted((x.representative, x.members) for x in got if x.g == g) == folded([(i, u) for h, i, u in rows if h == g], lambda a, b: edits(a, b) <= most)
    words = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    seqs = [(g, i, u + r.choice(["", "A", u[:2]])) for g, i, u in rows] + [("x", 500, "A"), ("x", 501, "A")]
    df = spark.createDataFrame(seqs, "g string, idx long, seq string")
    for least in (0.3, 0.6):
        got = C.greedy_cluster(df, ["g"], least, 2).collect()
        for g in "xy":
            want = folded([(i, s) for h, i, s in seqs if h == g], lambda a, b: bool(words(a) & words(b)) and len(words(a) & words(b)) / len(words(a) | words(b)) >= least)
            assert sorted((x.representative, x.members) for x in got if x.g == g) == want
    assert len(C.greedy_cluster(df, ["g"], 0.0, 2).collect()) == 2


def test_barcodes(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    white = [(i, word(8)) for i in range(60)]
    codes = list({(word(8),) for _ in range(150)} | {(w[1][1:] + "A",) for w in white[:20]})
    w = spark.createDataFrame(white, "idx long, entry string")
    b = spark.createDataFrame(codes, "barcode string")
    got = {x.barcode: x.corrected for x in A.correct_barcode(b, w, 2).collect()}

    def edits(a, c):
        d = list(range(len(c) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(c, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    for (c,) in codes:
        best = min((edits(c, e), i, e) for i, e in white)
        assert got[c] == (best[2] if best[0] <= 2 else None)
    near = sorted((x.barcode, x.w_idx, x.distance) for x in A.barcode_rescue(b, w, 3).collect())
    assert near == sorted((c, i, d) for (c,) in codes for i, e in white if (d := sum(p != q for p, q in zip(c, e))) <= 3)


def test_kmer_tables(spark):
    df = spark.createDataFrame([(0, "ATGCGCATGCGCATGCGC")], "idx long, seq string")
    assert {r.kmer: r.n for r in K.kmer_counts(df, 3).collect()} == {"ATG": 3, "CAT": 2, "CGC": 3, "GCA": 2, "GCG": 3, "TGC": 3}
    assert {r.multiplicity: r.n for r in K.kmer_spectrum(df, 3).collect()} == {2: 2, 3: 4}
    with pytest.raises(Exception, match="shorter"):
        K.kmer_counts(df, 99, strict=True).collect()


def test_matrices(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.5)], "row long, col long, value double")
    lines = [r.line for r in M.to_matrix_market(e, 2, 3).orderBy("part", "row", "col").collect()]
    assert lines == ["%%MatrixMarket matrix coordinate real general", "2 3 2", "1 1 1", "2 3 2.5"]
    assert M.cell_qc(spark.createDataFrame([], "counts long, genes long")).first().n_cells == 0
    tags = spark.createDataFrame([(0, 0, "a", 5.0), (0, 1, "b", 5.0), (1, 0, "a", 1.0)], "cell long, tag_idx long, tag string, value double")
    assert {r.cell: r.tag for r in M.demux_tags(tags, 2.0).collect()} == {0: "a", 1: "unknown"}


def test_pairs_of_copies(spark, monkeypatch):
    """Rows with equal texts are compared once, and no pair of them is lost, whatever the slices."""
    from loomseq.operators import copies

    monkeypatch.setattr(copies, "SLICE", 2)
    r = random.Random(5)
    texts = ["".join(r.choice("ACGT") for _ in range(12)) for _ in range(4)] + ["acgtacgtacgt", "ACGTACGTACGT", "AC", "ACGTT"]
    rows = [(i, texts[i % 8], f"m{i}") for i in range(37)]
    df = spark.createDataFrame(rows, "idx long, seq string, name string")
    words = lambda s, k: {s.upper()[i : i + k] for i in range(len(s) - k + 1)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = sorted((i, j, 1.0 if i == j else round(like(words(s, 3), words(t, 3)), 9)) for i, s, _ in rows for j, t, _ in rows if i == j or words(s, 3) & words(t, 3))
    assert sorted(map(tuple, K.jaccard_matrix(df, 3, digits=9).collect())) == want
    apart = lambda s, t: sum(a != b for a, b in zip(s, t)) if len(s) == len(t) else 999
    assert sorted(map(tuple, A.distance_matrix(df).collect())) == sorted((i, j, apart(s, t)) for i, s, _ in rows for j, t, _ in rows)
    edits = {(x.i, x.j): x.distance for x in A.distance_matrix(df, "levenshtein").collect()}
    assert len(edits) == 37 * 37 and all(edits[i, j] == edits[j, i] for i, j in edits) and edits[6, 7] == 3 and edits[0, 8] == 0
    reads = spark.createDataFrame([(100 + i, "".join(r.choice("ACGT") for _ in range(20))) for i in range(9)] + [(200, None)], "idx long, seq string")
    for least in (0.1, 0.0):
        got = sorted(map(tuple, K.marker_gene_match(reads, df, 3, least, digits=9).collect()))
        pairs = [(q.idx, n, round(like(words(q.seq or "", 3), words(s, 3)), 9)) for q in reads.collect() for _, s, n in rows]
        assert got == sorted(p for p in pairs if p[2] >= least)
    reference = df.select(F.explode(F.array(*[F.substring("seq", i, 3) for i in (1, 2, 3, 4)])).alias("kmer"), F.col("name").alias("taxon")).where("length(kmer) = 3").distinct()
    known = [tuple(x) for x in reference.collect()]
    got = {(x.idx, x.taxon): x.score for x in K.kmer_classify(reads, reference, 3).collect()}
    for q in reads.collect():
        hits = [t for w, t in known if w in words(q.seq or "", 3)]
        assert {t: s for (i, t), s in got.items() if i == q.idx} == {t: pytest.approx(hits.count(t) / len(hits)) for t in hits}


def test_a_task_counts_few_pairs_and_none_is_shuffled(spark, monkeypatch):
    """Queries are dealt to more tasks the more markers differ, and what a task counts stays there."""
    monkeypatch.setattr(K, "PAIRS", 1000, raising=False)
    r = random.Random(7)
    dna = lambda n: [(i, "".join(r.choice("ACGT") for _ in range(60)), f"m{i}") for i in range(n)]
    reads, markers = dna(300), dna(40)
    words = lambda s: {s[i : i + 3] for i in range(58)}
    df = K.marker_gene_match(*(spark.createDataFrame(x, "idx long, seq string, name string") for x in (reads, markers)), 3, 0.0001)
    got = df.withColumn("task", F.spark_partition_id()).collect()
    want = {(i, m): len(w & v) / len(w | v) for i, s, _ in reads for _, t, m in markers for w, v in [(words(s), words(t))] if w & v}
    assert len(got) == len(want) and {(x.idx, x.marker): x.jaccard for x in got} == pytest.approx(want)
    tasks = [x.task for x in got]
    assert max(map(tasks.count, set(tasks))) <= 2000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("hashpartitioning(idx") == 1


def test_few_rows_become_many_in_many_tasks(spark):
    """The copies' pairs are made by all tasks, and no pair is shuffled."""
    df = spark.range(1200).selectExpr("id AS idx", "if(id % 2 = 0, 'ACGTACGT', 'ACGTTTTT') AS seq", "concat('m', id) AS name")
    white = df.selectExpr("idx", "seq AS entry")
    for rows in (K.jaccard_matrix(df, 4), A.distance_matrix(df), A.distance_matrix(df, "levenshtein"), A.barcode_rescue(df.selectExpr("seq AS barcode"), white, 8), K.marker_gene_match(df, df, 4, 0.05)):
        assert rows.count() >= 2400
        plan = rows._jdf.queryExecution().executedPlan().toString()
        final = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert "Generate explode" in final.split("Exchange")[0]
