"""Interval joins against nested loops."""

import random

import pytest

from loomseq.operators import intervals as I

KIND = "idx long, chrom string, start_ long, end_ long, name string"


def some(n, seed, zero=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(-50, 3000)
        out.append((i, r.choice("ab"), s, s + r.randrange(0 if zero else 1, 400), f"n{i}"))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    a, b = some(120, 1), some(150, 2)
    return a, b, spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width", [1, 37, 1000])
def test_overlap(tables, width):
    a, b, x, y = tables
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    assert rows(I.batch_overlap(x, y, width)) == want
    hit = {p for p, _ in want}
    assert sorted(r.idx for r in I.filter_blacklist(x, y, width).collect()) == [p[0] for p in a if p[0] not in hit]


@pytest.mark.parametrize("most", [0, 25])
def test_near(tables, most):
    a, b, x, y = tables
    want = sorted((p[4], q[4], max(0, q[2] - p[3], p[2] - q[3])) for p in a for q in b if p[1] == q[1] and max(0, q[2] - p[3], p[2] - q[3]) <= most)
    assert rows(I.match_enhancer_promoter(x, y, most)) == want


def test_closest(spark, tables):
    a, b, x, y = tables
    a = [*a, (999, "c", 5, 9, "alone")]
    got = {r.idx: (r.closest, r.distance) for r in I.bed_closest(spark.createDataFrame(a, KIND), y).collect()}
    for p in a:
        best = min(((max(0, q[2] - p[3], p[2] - q[3]), q[0], q[4]) for q in b if q[1] == p[1]), default=(I.NO_DISTANCE, 0, ""))
        assert got[p[0]] == (best[2], best[0])


def test_merge_and_subtract(spark):
    a, b = some(80, 3, zero=False), some(60, 4)
    x, y = spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND)
    want = []
    for c in "ab":
        last = None
        for s, e in sorted((p[2], p[3]) for p in a if p[1] == c):
            if last and last[2] >= s:
                last[2] = max(last[2], e)
            else:
                want.append(last := [c, s, e])
    assert rows(I.bed_merge(x)) == sorted(map(tuple, want))
    assert rows(I.bed_merge(I.bed_merge(x))) == sorted(map(tuple, want))
    pieces = []
    for p in a:
        left = [(p[2], p[3])]
        for q in sorted((q[2], q[3]) for q in b if q[1] == p[1] and q[2] < p[3] and p[2] < q[3]):
            left = [z for s, e in left for z in (((s, min(e, q[0])), (max(s, q[1]), e)) if q[0] < e and s < q[1] else ((s, e),)) if z[0] < z[1]]
        pieces += [(p[0], p[1], s, e) for s, e in left]
    assert rows(I.bed_subtract(x, y).select("idx", "chrom", "start_", "end_")) == sorted(pieces)


def test_points(spark, tables):
    a, _, x, _ = tables
    r = random.Random(5)
    at = [(r.choice("ab"), r.randrange(0, 1500)) for _ in range(400)]
    p = spark.createDataFrame(at, "chrom string, pos long")
    want = sorted((i[0], sum(c == i[1] and i[2] <= q < i[3] for c, q in at)) for i in a)
    assert rows(I.coverage_over_intervals(x, p)) == want
    depth = {r.pos: r.depth for r in I.region_coverage(p.selectExpr("chrom", "pos", "30L AS span"), "a", 100, 200).collect()}
    assert depth == {q: sum(c == "a" and s <= q < s + 30 for c, s in at) for q in range(100, 200)}
    empty = x.limit(0)
    assert I.coverage_over_intervals(empty, p).count() == 0
    assert I.interval_stats(empty).first().total_intervals == 0


def test_sliding_bins(spark):
    assert I.sliding_bins(spark, "chr1", 0, 1000, 100, 50).count() == 19
    assert I.sliding_bins(spark, "chr1", 0, 50, 100, 50).count() == 0
    with pytest.raises(ValueError):
        I.sliding_bins(spark, "chr1", 0, 1000, 100, 0)
