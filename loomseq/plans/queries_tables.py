"""Queries over barcodes, matrices and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import alignment as OA
from ..operators import clustering as C
from ..operators import matrices as M
from ..operators import statistics as ST
from .views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def umis(spark, d):
    return view(spark, d, "g_umis")


# reads and single cells
_add("extract_barcode", lambda s, d: view(s, d, "g_reads").select("idx", R.extract_barcode("seq", 16, 4).alias("value")), "SELECT idx, substr(seq, 5, 16) AS value FROM g_reads")
_add("extract_umi", lambda s, d: view(s, d, "g_reads").select("idx", R.extract_umi("seq", 12, 60).alias("value")), "SELECT idx, CASE WHEN strlen(seq) >= 72 THEN substr(seq, 61, 12) END AS value FROM g_reads")
FLAGS = ", ".join(f"flag & {1 << i} <> 0 AS {n}" for i, n in enumerate(R.FLAG_BITS))
_add("parse_flag", lambda s, d: view(s, d, "g_sam").select("qname", R.parse_flag("flag").alias("x")).select("qname", "x.*"), f"SELECT qname, {FLAGS} FROM g_sam")


def _whitelist(s, d):
    return view(s, d, "g_taxa").select("idx", F.left("seq", F.lit(8)).alias("entry"))


_add(
    "correct_barcode",
    lambda s, d: OA.correct_barcode(umis(s, d), _whitelist(s, d), 2),
    """WITH b AS (SELECT DISTINCT barcode FROM g_umis), w AS (SELECT idx, left(seq, 8) AS entry FROM g_taxa),
n AS (SELECT barcode, entry, row_number() OVER (PARTITION BY barcode ORDER BY levenshtein(barcode, entry), idx) AS r FROM b, w WHERE levenshtein(barcode, entry) <= 2)
SELECT barcode, entry AS corrected FROM b LEFT JOIN (SELECT * FROM n WHERE r = 1) USING (barcode)""",
)
_add(
    "barcode_rescue",
    lambda s, d: OA.barcode_rescue(umis(s, d), _whitelist(s, d), 3),
    """WITH b AS (SELECT DISTINCT barcode FROM g_umis), w AS (SELECT idx, left(seq, 8) AS entry FROM g_taxa)
SELECT barcode, idx AS w_idx, entry, CAST(hamming(barcode, entry) AS BIGINT) AS distance FROM b, w WHERE hamming(barcode, entry) <= 3""",
)
UMI_GROUPS = """WITH RECURSIVE u AS (SELECT left(barcode, 2) AS cell, feature, umi, min(idx) AS first FROM g_umis GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY cell, feature ORDER BY first) AS n FROM u),
f AS (
  SELECT DISTINCT cell, feature, 0::BIGINT AS n, NULL::VARCHAR AS umi, NULL::VARCHAR AS representative, []::VARCHAR[] AS heads FROM u
  UNION ALL
  SELECT cell, feature, n, umi, CASE WHEN len(near) > 0 THEN near[1] ELSE umi END, CASE WHEN len(near) > 0 THEN heads ELSE list_append(heads, umi) END
  FROM (SELECT o.cell, o.feature, o.n, o.umi, f.heads, list_filter(f.heads, lambda h: levenshtein(h, o.umi) <= 1) AS near
    FROM f JOIN o ON o.cell = f.cell AND o.feature = f.feature AND o.n = f.n + 1))
SELECT f.cell, f.feature, f.representative, g.idx FROM f JOIN g_umis g ON left(g.barcode, 2) = f.cell AND g.feature = f.feature AND g.umi = f.umi"""
for _name, _f in (("umi_collapse", C.umi_collapse), ("umi_dedup", C.umi_dedup)):
    _add(
        _name,
        lambda s, d, f=_f: f(umis(s, d).withColumn("cell", F.left("barcode", F.lit(2))), ["cell", "feature"], 1).select("cell", "feature", "representative", F.explode("members").alias("idx")),
        UMI_GROUPS,
    )
_add("count_guides", lambda s, d: M.count_guides(umis(s, d), "feature"), "SELECT feature, count(*) AS n FROM g_umis GROUP BY feature")


def _entries(s, d):
    e = umis(s, d).select(F.left("barcode", F.lit(2)).alias("b"), "feature")
    return e.groupBy("feature", "b").agg(F.count("*").cast("double").alias("value"))


def _matrix(s, d):
    e = _entries(s, d).select(F.length("feature").cast("long").alias("row"), F.ascii("b").cast("long").alias("col"), "value")
    return e.groupBy("row", "col").agg(F.sum("value").alias("value"))


ENTRIES = "e AS (SELECT strlen(feature)::BIGINT AS row, ascii(barcode)::BIGINT AS col, count(*)::DOUBLE AS value FROM g_umis GROUP BY 1, 2)"


def _named(s, d):
    e = _matrix(s, d)
    f = e.select(F.col("row").alias("idx")).distinct().withColumn("name", F.concat(F.lit("f"), F.col("idx").cast("string")))
    b = e.select(F.col("col").alias("idx")).distinct().withColumn("name", F.concat(F.lit("b"), F.col("idx").cast("string")))
    return M.feature_barcode_matrix(e, f, b)


_add("build_feature_barcode_matrix", _named, f"WITH {ENTRIES} SELECT row, col, 'f' || row AS feature, 'b' || col AS barcode, value FROM e")
_add(
    "to_matrix_market",
    lambda s, d: M.to_matrix_market(_matrix(s, d), 100, 100).select("line"),
    f"""WITH {ENTRIES} SELECT '%%MatrixMarket matrix coordinate real general' AS line UNION ALL SELECT '100 100 ' || count(*) FROM e
UNION ALL SELECT (row + 1) || ' ' || (col + 1) || ' ' || CAST(value AS BIGINT) FROM e""",
)
_add(
    "cell_qc",
    lambda s, d: M.cell_qc(umis(s, d).groupBy("barcode").agg(F.count("*").alias("counts"), F.countDistinct("feature").alias("genes"))).withColumns({c: F.round(c, 9) for c in ("avg_counts_per_cell", "avg_genes_per_cell")}),
    """WITH c AS (SELECT count(*) AS counts, count(DISTINCT feature) AS genes FROM g_umis GROUP BY barcode)
SELECT count(*) AS n_cells, CAST(sum(counts) AS BIGINT) AS total_counts, CAST(sum(genes) AS BIGINT) AS total_genes, round(avg(counts), 9) AS avg_counts_per_cell, round(avg(genes), 9) AS avg_genes_per_cell,
  max(counts) AS max_counts, min(counts) AS min_counts FROM c""",
)


def _tags(s, d):
    t = umis(s, d).groupBy(F.col("barcode").alias("cell"), F.col("feature").alias("tag")).agg(F.count("*").cast("double").alias("value"))
    return t.withColumn("tag_idx", F.length("tag").cast("long") * 256 + F.ascii("tag"))


_add(
    "demux_tags",
    lambda s, d: M.demux_tags(_tags(s, d), 2.0),
    """WITH t AS (SELECT barcode AS cell, feature AS tag, count(*) AS v, strlen(feature) * 256 + ascii(feature) AS i FROM g_umis GROUP BY 1, 2),
r AS (SELECT cell, tag, row_number() OVER (PARTITION BY cell ORDER BY v DESC, i) AS r FROM t WHERE v > 2)
SELECT DISTINCT t.cell, coalesce(r.tag, 'unknown') AS tag FROM t LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (cell)""",
)
_add(
    "classify_nucleosome_free",
    lambda s, d: M.classify_nucleosome_free(view(s, d, "g_frags").select((F.col("end_") - F.col("start_")).alias("length")), 147),
    "SELECT count(*) FILTER (end_ - start_ <= 147) AS nucleosome_free, count(*) FILTER (end_ - start_ > 147) AS nucleosomal FROM g_frags",
)


# statistics
def _by(rows, names, digits=6):
    return rows.withColumns({n: F.round(n, digits) for n in names})


def _series(s, d):
    return view(s, d, "g_series")


STATS = """WITH o AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM g_series)
SELECT g, count(*) AS count, round(avg(x), 6) AS mean, round((max(x) FILTER (r = (n - 1) // 2) + max(x) FILTER (r = n // 2)) / 2, 6) AS median, round(stddev_pop(x), 6) AS std_dev, round(var_pop(x), 3) AS variance,
  min(x) AS min, max(x) AS max, max(x) FILTER (r = n // 4) AS q1, max(x) FILTER (r = 3 * n // 4) AS q3 FROM o GROUP BY g"""


def _describe(s, d):
    rows = ST.descriptive_stats(_series(s, d).select("g", F.col("x").alias("value")), ["g"])
    return _by(_by(rows, ["mean", "median", "std_dev"]), ["variance"], 3)


_add("descriptive_stats", _describe, STATS)
_add("parallel_descriptive_stats", _describe, STATS)
_add("pearson_correlation", lambda s, d: _by(ST.pearson_correlation(_series(s, d), ["g"]), ["r"], 9), "SELECT g, round(corr(x, y), 9) AS r FROM g_series GROUP BY g")
_add(
    "rolling_correlation",
    lambda s, d: _by(ST.rolling_correlation(_series(s, d), ["g"], 7), ["r"]),
    """WITH w AS (SELECT g, idx, count(*) OVER f AS n, corr(x, y) OVER f AS r FROM g_series WINDOW f AS (PARTITION BY g ORDER BY idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT g, idx, round(r, 6) AS r FROM w WHERE n = 7""",
)
BH = """WITH r AS (SELECT idx, value, row_number() OVER (ORDER BY value, idx) AS r, count(*) OVER () AS n FROM g_pvalues)
SELECT idx, round(value, 9) AS value, round(least(1.0, min(value * n / r) OVER (ORDER BY value, idx ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r"""
_add("bh_correction", lambda s, d: _by(ST.bh_correction(view(s, d, "g_pvalues")), ["value", "q"], 9), BH)
_add(
    "mann_whitney_u",
    lambda s, d: _by(ST.mann_whitney_u(view(s, d, "g_pvalues")), ["p_value"], 9),
    """WITH r AS (SELECT is_a, row_number() OVER (ORDER BY value, is_a DESC, idx) AS r FROM g_pvalues),
u AS (SELECT count(*) FILTER (is_a)::DOUBLE AS na, count(*) FILTER (NOT is_a)::DOUBLE AS nb, sum(r) FILTER (is_a)::DOUBLE - na * (na + 1) / 2 AS ua FROM r),
v AS (SELECT na, nb, least(ua, na * nb - ua) AS u FROM u)
SELECT u AS u_statistic, round(exp(-power((u - na * nb / 2) / sqrt(na * nb * (na + nb + 1) / 12), 2) / 2) / sqrt(2 * pi()), 9) AS p_value FROM v""",
)
HASH60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_add(
    "permutation_test",
    lambda s, d: _by(ST.permutation_test(view(s, d, "g_table").select("idx", F.col("a").cast("double").alias("value"), (F.col("d") < 3).alias("is_a")), 50, 7, "md5_60"), ["observed_diff"], 9),
    f"""WITH t AS (SELECT idx, a::DOUBLE AS value, d < 3 AS is_a FROM g_table),
o AS (SELECT avg(value) FILTER (is_a) - avg(value) FILTER (NOT is_a) AS seen, count(*) FILTER (is_a) AS na FROM t),
p AS (SELECT trial, value, row_number() OVER (PARTITION BY trial ORDER BY {HASH60.format("'7:' || trial || ':' || idx")}, idx) AS r FROM t, range(1, 51) x(trial)),
q AS (SELECT trial, avg(value) FILTER (r <= na) - avg(value) FILTER (r > na) AS diff FROM p, o GROUP BY trial)
SELECT round(seen, 9) AS observed_diff, count(*) FILTER (abs(diff) >= abs(seen)) / 50.0::DOUBLE AS p_value, 50::BIGINT AS n_permutations FROM q, o GROUP BY seen""",
)
_add(
    "bootstrap_ci",
    lambda s, d: _by(ST.bootstrap_ci(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").cast("double").alias("value")), 100, 0.95, 7, "md5_60"), ["mean", "ci_lower", "ci_upper"]),
    f"""WITH c AS (SELECT c_custkey AS idx, c_acctbal::DOUBLE AS value FROM customer), n AS (SELECT count(*) AS n, avg(value) AS mean FROM c),
x AS (SELECT trial, {HASH60.format("'7:' || trial || ':' || j")} % n AS idx FROM n, range(0, 100) t(trial), range(0, (SELECT count(*) FROM customer)) y(j)),
m AS (SELECT trial, avg(value) AS mean, row_number() OVER (ORDER BY avg(value)) - 1 AS r FROM x JOIN c USING (idx) GROUP BY trial)
SELECT round(n.mean, 6) AS mean, round(max(m.mean) FILTER (r = 2), 6) AS ci_lower, round(max(m.mean) FILTER (r = 97), 6) AS ci_upper, 0.95::DOUBLE AS confidence, 100::BIGINT AS n_bootstrap FROM m, n GROUP BY n.mean""",
)
_add(
    "fisher_exact",
    lambda s, d: view(s, d, "g_table").select("idx", F.round(R.fisher_exact("a", "b", "c", "d"), 9).alias("value")),
    """SELECT idx, CASE WHEN a = 0 OR d = 0 THEN 'nan'::DOUBLE ELSE round(exp(-power(ln(a::DOUBLE * d / (b * c)) / sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b + 1.0::DOUBLE / c + 1.0::DOUBLE / d), 2) / 2) / sqrt(2 * pi()), 9) END AS value
FROM (SELECT idx, a, b, c, CASE WHEN a = 0 THEN 0 ELSE d END AS d FROM g_table)""",
)
_add(
    "hypergeometric_test",
    lambda s, d: view(s, d, "g_table").select("idx", F.round(R.hypergeometric_test("a", F.col("b") + 20, F.col("c") + 10, F.lit(200)), 9).alias("value")),
    """SELECT idx, CASE WHEN a <= (b + 20) * ((c + 10)::DOUBLE / 200) THEN 1.0 ELSE round(exp(-power((a - (b + 20) * ((c + 10)::DOUBLE / 200)) /
  sqrt((b + 20) * ((c + 10)::DOUBLE / 200) * (1 - (c + 10)::DOUBLE / 200) * (200 - (b + 20)) / 199), 2) / 2) / sqrt(2 * pi()), 9) END AS value FROM g_table""",
)
