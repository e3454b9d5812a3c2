"""Queries over sequences, k-mers, alignments and peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import kmers as K
from ..functions import proteomics as P
from ..functions import sequence as S
from ..operators import alignment as OA
from ..operators import clustering as C
from ..operators import kmers as OK
from .views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}

COMPLEMENT = "reverse(translate({}, 'ATGCNatgcnUu', 'TACGNTACGNAA'))"
KMERS = "SELECT idx, upper(seq) AS s, unnest(range(1, CAST(strlen(seq) AS BIGINT) - {k} + 2)) AS i FROM {src}"


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _column(name: str, make, sql: str, src: str = "g_reads") -> None:
    """A query (idx, value) for a column function, with the value's SQL."""
    _add(name, lambda spark, d: view(spark, d, src).select("idx", make().alias("value")), f"SELECT idx, {sql} AS value FROM {src}")


GC = "(strlen(seq) - strlen(translate(upper(seq), 'GC', '')))::DOUBLE / strlen(seq)"
ENTROPY = """WITH c AS (SELECT idx, c, count(*)::DOUBLE / any_value(strlen(seq)) AS p
  FROM (SELECT idx, seq, unnest(string_split(upper(seq), '')) AS c FROM g_reads) GROUP BY idx, c)
SELECT idx, {} AS value FROM c GROUP BY idx"""

_column("gc_content", lambda: F.round(S.gc_content("seq"), 9), f"round({GC}, 9)")
_column("reverse_complement", lambda: S.reverse_complement("seq"), COMPLEMENT.format("seq"))
_column("seq_length", lambda: S.seq_length("seq"), "CAST(strlen(seq) AS BIGINT)")
_column("is_valid_dna", lambda: S.is_valid_dna("seq"), "regexp_full_match(seq, '[ATGCNatgcn]+')")
_column("is_valid_rna", lambda: S.is_valid_rna(S.transcribe("seq")), "regexp_full_match(translate(seq, 'Tt', 'Uu'), '[AUGCNaugcn]+')")
_column("transcribe", lambda: S.transcribe("seq"), "translate(seq, 'Tt', 'Uu')")
_column("reverse_transcribe", lambda: S.reverse_transcribe(S.transcribe("seq")), "seq")
_column("count_n", lambda: S.count_n("seq"), "CAST(strlen(seq) - strlen(translate(upper(seq), 'N', '')) AS BIGINT)")
_column("normalize_seq", lambda: S.normalize_seq(F.lower("seq")), "upper(lower(seq))")
_column("seq_slice", lambda: S.seq_slice("seq", 5, 25), "substr(seq, 6, 20)")
_column("concat_seqs", lambda: S.concat_seqs(F.array("seq", F.reverse("seq")), "-"), "seq || '-' || reverse(seq)")
_add("compression_ratio", lambda spark, d: view(spark, d, "g_reads").select("idx", F.round(S.compression_ratio("seq"), 9).alias("value")), ENTROPY.format("round(-sum(p * log2(p)) / 2, 9)"))
_add("is_low_complexity", lambda spark, d: view(spark, d, "g_reads").select("idx", S.is_low_complexity("seq", 0.35).alias("value")), ENTROPY.format("max(p) > 0.35"))
_add(
    "count_bases",
    lambda spark, d: view(spark, d, "g_reads").select("idx", F.explode(S.base_counts("seq")).alias("x")).select("idx", "x.*"),
    "SELECT idx, base, count(*) AS n FROM (SELECT idx, unnest(string_split(upper(seq), '')) AS base FROM g_reads) GROUP BY idx, base",
)
ORFS = """WITH s AS (SELECT idx, seq, unnest(range(0, CAST(strlen(seq) AS BIGINT) - 2)) AS st FROM g_reads),
a AS (SELECT idx, seq, st FROM s WHERE substr(seq, st + 1, 3) = 'ATG'),
e AS (SELECT idx, seq, st, unnest(range(st, CAST(strlen(seq) AS BIGINT) - 2, 3)) AS j FROM a)
SELECT idx, st AS start_, min(j) + 3 AS end_, substr(any_value(seq), st + 1, min(j) + 3 - st) AS orf
FROM e WHERE substr(seq, j + 1, 3) IN ('TAA', 'TAG', 'TGA') GROUP BY idx, st"""


def _orfs(spark, d):
    rows = view(spark, d, "g_reads").select("idx", F.explode(S.find_orfs("seq")).alias("x"))
    return rows.select("idx", F.col("x.start").alias("start_"), F.col("x.end").alias("end_"), "x.orf")


_add("find_orfs", _orfs, ORFS)
_add("parallel_find_orfs", _orfs, ORFS)
RESIDUE = f"""CASE WHEN least(strpos('TCAG', substr(s, i + 1, 1)), strpos('TCAG', substr(s, i + 2, 1)), strpos('TCAG', substr(s, i + 3, 1))) = 0 THEN 'X'
  ELSE substr('{S.CODE_RESIDUES}', 16 * (strpos('TCAG', substr(s, i + 1, 1)) - 1) + 4 * (strpos('TCAG', substr(s, i + 2, 1)) - 1) + strpos('TCAG', substr(s, i + 3, 1)), 1) END"""
_add(
    "translate",
    lambda spark, d: view(spark, d, "g_reads").select("idx", S.translate("seq").alias("value")),
    f"""WITH c AS (SELECT idx, upper(seq) AS s, unnest(range(0, CAST(strlen(seq) AS BIGINT) - 2, 3)) AS i FROM g_reads)
SELECT idx, regexp_extract(string_agg({RESIDUE}, '' ORDER BY i), '^[^*]*\\*?') AS value FROM c GROUP BY idx""",
)
COUNT = "CAST(strlen(seq) - strlen(translate(upper(seq), '{0}', '')) AS BIGINT) AS {1}_count"
STATS = f"""SELECT idx, CAST(strlen(seq) AS BIGINT) AS length, round({GC}, 9) AS gc_content, {COUNT.format('N', 'n')},
  regexp_full_match(seq, '[ATGCNatgcn]+') AS is_valid_dna, {', '.join(COUNT.format(b, b.lower()) for b in 'ATGC')} FROM g_reads"""


def _stats(spark, d):
    return view(spark, d, "g_reads").select("idx", S.seq_stats("seq").alias("x")).select("idx", "x.*").withColumn("gc_content", F.round("gc_content", 9))


_add("seq_stats", _stats, STATS)
_add("parallel_seq_stats", _stats, STATS)
_column("parallel_gc_content", lambda: F.round(S.gc_content("seq"), 9), f"round({GC}, 9)")
_column("parallel_reverse_complement", lambda: S.reverse_complement("seq"), COMPLEMENT.format("seq"))

# k-mers
K8 = f"WITH k AS (SELECT idx, i, substr(s, i, 8) AS kmer FROM ({KMERS.format(k=8, src='g_reads')}))"
_add("count_kmers", lambda spark, d: OK.kmer_counts_by_sequence(view(spark, d, "g_reads"), 3), f"WITH k AS (SELECT idx, substr(s, i, 3) AS kmer FROM ({KMERS.format(k=3, src='g_reads')})) SELECT idx, kmer, count(*) AS n FROM k GROUP BY idx, kmer")
_add("parallel_count_kmers", lambda spark, d: OK.kmer_counts(view(spark, d, "g_reads"), 8), f"{K8} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
_add(
    "canonical_kmer",
    lambda spark, d: OK.kmer_counts(view(spark, d, "g_reads"), 8, canonical=True),
    f"{K8} SELECT least(kmer, {COMPLEMENT.format('kmer')}) AS kmer, count(*) AS n FROM k GROUP BY 1",
)
_add("kmer_spectrum", lambda spark, d: OK.kmer_spectrum(view(spark, d, "g_reads"), 8), f"{K8} SELECT c AS multiplicity, count(*) AS n FROM (SELECT kmer, count(*) AS c FROM k GROUP BY kmer) GROUP BY c")


def _placed(make):
    def q(spark, d):
        return view(spark, d, "g_reads").select("idx", F.explode(make()).alias("x")).select("idx", "x.pos", "x.kmer")

    return q


_add(
    "minimizers",
    _placed(lambda: K.minimizers("seq", 8, 5)),
    f"""{K8}, m AS (SELECT idx, i, min(struct_pack(kmer := kmer, i := i)) OVER (PARTITION BY idx ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS least,
  count(*) OVER (PARTITION BY idx) AS n FROM k),
p AS (SELECT idx, i, least, lag(least.kmer) OVER (PARTITION BY idx ORDER BY i) AS was FROM m WHERE i <= n - 4)
SELECT idx, CAST(least.i - 1 AS BIGINT) AS pos, least.kmer AS kmer FROM p WHERE was IS NULL OR was <> least.kmer""",
)
_add(
    "syncmers",
    _placed(lambda: K.syncmers("seq", 8, 3)),
    f"""{K8}, s AS (SELECT idx, i, kmer, (SELECT min(substr(kmer, j, 3)) FROM (SELECT unnest(range(1, 7)) AS j)) AS least FROM k)
SELECT idx, CAST(i - 1 AS BIGINT) AS pos, kmer FROM s WHERE least IN (left(kmer, 3), right(kmer, 3))""",
)
MD5 = "CAST('0x' || substr(md5(substr(s, i, 11)), 1, 15) AS BIGINT)"


def _sketch_sql(size: int, src: str = "g_reads") -> str:
    return f"""SELECT idx, h FROM (SELECT idx, h, row_number() OVER (PARTITION BY idx ORDER BY h) AS r
  FROM (SELECT DISTINCT idx, {MD5} AS h FROM ({KMERS.format(k=11, src=src)}))) WHERE r <= {size}"""


def _sketch(f):
    return lambda spark, d: view(spark, d, "g_reads").select("idx", F.explode(f("seq", 11, 16, "md5_60")).alias("h"))


_add("minhash_sketch", _sketch(K.minhash_sketch), _sketch_sql(16))
_add("genome_sketch", _sketch(K.genome_sketch), _sketch_sql(16))

#: Each read against itself with its first 16 letters at the end.
OTHER = lambda: F.concat(F.substring("seq", 17, 48), F.left("seq", F.lit(16)))
PAIR = "a AS (SELECT idx, upper(seq) AS s FROM g_reads), b AS (SELECT idx, substr(s, 17, 48) || left(s, 16) AS s FROM a)"


def _pair_sql(k: int, value: str, hashed: bool = False, size: int = 0) -> str:
    word = f"substr(s, i, {k})" if not hashed else MD5.replace("11", str(k))
    words = lambda t: f"(SELECT DISTINCT idx, {word} AS w FROM (SELECT idx, s, unnest(range(1, CAST(strlen(s) AS BIGINT) - {k} + 2)) AS i FROM {t}))"
    cut = lambda t: words(t) if not size else f"(SELECT idx, w FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY w) AS r FROM {words(t)}) WHERE r <= {size})"
    return f"""WITH {PAIR}, x AS {cut('a')}, y AS {cut('b')},
n AS (SELECT idx, count(*) AS nx FROM x GROUP BY idx), m AS (SELECT idx, count(*) AS ny FROM y GROUP BY idx),
c AS (SELECT x.idx, count(*) AS hits FROM x JOIN y ON x.idx = y.idx AND x.w = y.w GROUP BY x.idx),
j AS (SELECT n.idx, nx, coalesce(hits, 0)::DOUBLE AS hits, coalesce(hits, 0)::DOUBLE / (nx + ny - coalesce(hits, 0)) AS j FROM n JOIN m USING (idx) LEFT JOIN c USING (idx))
SELECT idx, round({value}, 9) AS value FROM j"""


def _pair(make):
    return lambda spark, d: view(spark, d, "g_reads").select("idx", F.round(make(), 9).alias("value"))


_add("jaccard_similarity", _pair(lambda: K.jaccard_similarity("seq", OTHER(), 5)), _pair_sql(5, "j"))
_add("containment_index", _pair(lambda: K.containment_index("seq", OTHER(), 5)), _pair_sql(5, "hits / nx"))
_add("mash_distance", _pair(lambda: K.mash_distance("seq", OTHER(), 11, 20, "md5_60")), _pair_sql(11, "CASE WHEN j = 0 THEN 1.0 ELSE least(1.0, -ln(j) / 11) + 0.0 END", True, 20))
_add("ani_approximate", _pair(lambda: K.ani_approximate("seq", OTHER(), 11, 20, "md5_60")), _pair_sql(11, "CASE WHEN j = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 + ln(2 * j / (1 + j)) / 11)) END", True, 20))


def _screen(spark, d):
    reads, host = view(spark, d, "g_reads"), view(spark, d, "g_taxa")
    own = reads.select("idx", F.explode(K.minhash_sketch("seq", 6, 16, "md5_60")).alias("h"))
    hashes = OK.tokenise(host, 6).select(K.sketch_hash(F.col("kmer"), "md5_60").alias("h")).distinct().withColumn("hit", F.lit(True))
    return own.join(hashes, "h", "left").groupBy("idx").agg(F.round(S.ratio(F.count("hit"), F.count("*")), 9).alias("value"))


MD5_6 = MD5.replace("11", "6")
_add(
    "contamination_screen",
    _screen,
    f"""WITH own AS ({_sketch_sql(16).replace('11', '6').replace(KMERS.format(k=11, src='g_reads'), KMERS.format(k=6, src='g_reads'))}),
host AS (SELECT DISTINCT {MD5_6} AS h FROM ({KMERS.format(k=6, src='g_taxa')}))
SELECT idx, round(count(host.h)::DOUBLE / count(*), 9) AS value FROM own LEFT JOIN host USING (h) GROUP BY idx""",
)
WORDS = "SELECT DISTINCT idx, substr(s, i, {k}) AS w FROM ({src})"


def _words(k: int, src: str) -> str:
    return WORDS.format(k=k, src=KMERS.format(k=k, src=src))


_add(
    "kmer_classify",
    lambda spark, d: OK.kmer_classify(view(spark, d, "g_reads"), OK.tokenise(view(spark, d, "g_taxa"), 8).distinct().select("kmer", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("taxon")), 8, digits=9),
    f"""WITH q AS ({_words(8, 'g_reads')}), r AS ({_words(8, 'g_taxa')}),
h AS (SELECT q.idx, 't' || r.idx AS taxon, count(*) AS n FROM q JOIN r ON q.w = r.w GROUP BY ALL)
SELECT idx, taxon, round(n::DOUBLE / sum(n) OVER (PARTITION BY idx), 9) AS score FROM h""",
)
JACCARD = """x AS (SELECT q.idx AS i, r.idx AS j, count(*) AS hits FROM q JOIN r ON q.w = r.w GROUP BY ALL),
n AS (SELECT idx AS i, count(*) AS ni FROM q GROUP BY idx), m AS (SELECT idx AS j, count(*) AS nj FROM r GROUP BY idx),
p AS (SELECT i, j, hits::DOUBLE / (ni + nj - hits) AS jaccard FROM x JOIN n USING (i) JOIN m USING (j))"""
_add(
    "marker_gene_match",
    lambda spark, d: OK.marker_gene_match(view(spark, d, "g_reads"), view(spark, d, "g_taxa"), 5, 0.05, digits=9),
    f"WITH q AS ({_words(5, 'g_reads')}), r AS ({_words(5, 'g_taxa')}), {JACCARD} SELECT i AS idx, 't' || j AS marker, round(jaccard, 9) AS jaccard FROM p WHERE jaccard >= 0.05",
)
_add(
    "parallel_jaccard_matrix",
    lambda spark, d: OK.jaccard_matrix(view(spark, d, "g_taxa"), 4, digits=9),
    f"WITH q AS ({_words(4, 'g_taxa')}), r AS (SELECT * FROM q), {JACCARD} SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE jaccard END, 9) AS jaccard FROM p",
)
_add(
    "estimate_abundance",
    lambda spark, d: OK.estimate_abundance(OK.tokenise(view(spark, d, "g_reads"), 8), OK.tokenise(view(spark, d, "g_taxa"), 8)).select(F.round("abundance", 9).alias("abundance")),
    f"WITH q AS (SELECT DISTINCT w FROM ({_words(8, 'g_reads')})), r AS (SELECT DISTINCT w FROM ({_words(8, 'g_taxa')})) SELECT round(count(q.w)::DOUBLE / count(*), 9) AS abundance FROM r LEFT JOIN q USING (w)",
)
_add(
    "greedy_cluster",
    lambda spark, d: C.greedy_cluster(view(spark, d, "g_taxa"), ["grp"], 0.5, 4).select("grp", "representative", F.explode("members").alias("idx")),
    """WITH RECURSIVE s AS (SELECT grp, idx, seq, row_number() OVER (PARTITION BY grp ORDER BY idx) AS n,
  list_distinct([substr(upper(seq), i, 4) FOR i IN range(1, CAST(strlen(seq) AS BIGINT) - 2)]) AS ws FROM g_taxa),
f AS (
  SELECT DISTINCT grp, 0::BIGINT AS n, NULL::BIGINT AS idx, NULL::VARCHAR AS representative, []::STRUCT(seq VARCHAR, ws VARCHAR[])[] AS heads FROM s
  UNION ALL
  SELECT grp, n, idx, CASE WHEN len(near) > 0 THEN near[1].seq ELSE seq END, CASE WHEN len(near) > 0 THEN heads ELSE list_append(heads, {'seq': seq, 'ws': ws}) END
  FROM (SELECT s.grp, s.n, s.idx, s.seq, s.ws, f.heads,
      list_filter(f.heads, lambda h: len(list_intersect(h.ws, s.ws))::DOUBLE / (len(h.ws) + len(s.ws) - len(list_intersect(h.ws, s.ws))) >= 0.5) AS near
    FROM f JOIN s ON s.grp = f.grp AND s.n = f.n + 1))
SELECT grp, representative, idx FROM f WHERE n > 0""",
)

# alignment
_column("hamming_distance", lambda: A.hamming_distance("seq", F.reverse("seq")), "CAST(hamming(seq, reverse(seq)) AS BIGINT)")
_column("levenshtein_distance", lambda: A.levenshtein_distance("seq", F.reverse("seq")), "levenshtein(seq, reverse(seq))", "g_proteins")
#: Score matrices by anti-diagonals (lists by i, of the last two), then the way back, a step at a time.
GRID = """WITH RECURSIVE pair AS (SELECT idx, seq AS a, reverse(seq) AS b, CAST(strlen(seq) AS BIGINT) AS n, CAST(strlen(seq) AS BIGINT) AS m FROM g_proteins),
diagonal AS (
  SELECT idx, a, b, n, m, 0::BIGINT AS d, [CASE WHEN i = 0 THEN 0 END FOR i IN range(0, n + 1)] AS cur, [NULL::INTEGER FOR i IN range(0, n + 1)] AS was FROM pair
  UNION ALL
  SELECT idx, a, b, n, m, d + 1, list_transform(range(0, n + 1), lambda i: CASE
      WHEN i > d + 1 OR d + 1 - i > m {outside} THEN NULL
      WHEN i = 0 OR i = d + 1 THEN {edge}
      ELSE greatest({floor} was[i] + CASE WHEN substr(a, i, 1) = substr(b, d + 1 - i, 1) THEN 2 ELSE -1 END, cur[i] - 2, cur[i + 1] - 2) END), cur
  FROM diagonal WHERE d < n + m)"""
WALK = """,
grid AS MATERIALIZED (SELECT idx, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, any_value(m) AS m, list(cur ORDER BY d) AS h FROM diagonal GROUP BY idx),
{begin},
walk AS (
  SELECT idx, i, j, score, '' AS x, '' AS y FROM best
  UNION ALL
  SELECT idx, CASE WHEN how < 2 THEN i - 1 ELSE i END, CASE WHEN how <> 1 THEN j - 1 ELSE j END, score,
    CASE WHEN how < 2 THEN substr(a, i, 1) ELSE '-' END || x, CASE WHEN how <> 1 THEN substr(b, j, 1) ELSE '-' END || y
  FROM (SELECT walk.*, a, b, CASE
      WHEN i > 0 AND j > 0 AND h[i + j + 1][i + 1] = h[i + j - 1][i] + CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN 2 ELSE -1 END THEN 0
      WHEN i > 0 AND h[i + j + 1][i + 1] = h[i + j][i] - 2 THEN 1 ELSE 2 END AS how
    FROM walk JOIN grid USING (idx) WHERE {go}))
SELECT idx, x AS a, y AS b, score FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY i + j) AS r FROM walk) WHERE r = 1"""
GLOBAL_EDGE = "CAST((d + 1) * -2 AS INTEGER)"
BEST_CELL = """cell AS (SELECT idx, d, unnest(cur) AS score, unnest(range(0, n + 1)) AS i FROM diagonal),
best AS (SELECT idx, i, d - i AS j, score FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, i, d - i) AS r FROM cell WHERE score IS NOT NULL) WHERE r = 1)"""


def _aligned(f):
    return lambda spark, d: view(spark, d, "g_proteins").select("idx", f(F.col("seq"), F.reverse("seq"), 2, -1, -2).alias("x")).select("idx", "x.*")


_add(
    "needleman_wunsch",
    _aligned(OA.needleman_wunsch),
    GRID.format(outside="", edge=GLOBAL_EDGE, floor="") + WALK.format(begin="best AS (SELECT idx, n AS i, m AS j, h[n + m + 1][n + 1] AS score FROM grid)", go="i > 0 OR j > 0"),
)
_add("smith_waterman", _aligned(OA.smith_waterman), GRID.format(outside="", edge="0", floor="0,") + WALK.format(begin=BEST_CELL, go="i > 0 AND j > 0 AND h[i + j + 1][i + 1] > 0"))
_add(
    "banded_alignment",
    lambda spark, d: view(spark, d, "g_proteins").select("idx", OA.banded_alignment(F.col("seq"), F.reverse("seq"), 5, 2, -1, -2).alias("score")),
    GRID.format(outside="OR abs(2 * i - d - 1) > 5", edge=GLOBAL_EDGE, floor="") + " SELECT idx, cur[n + 1] AS score FROM diagonal WHERE d = n + m",
)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "start_"]
KEYS = ", ".join(KEY)
OPS = f"""WITH o AS (SELECT {KEYS}, cigar, i, right(x, 1) AS op, greatest(1, coalesce(TRY_CAST(left(x, strlen(x) - 1) AS BIGINT), 1)) AS len
  FROM (SELECT {KEYS}, cigar, unnest(ts) AS x, unnest(range(0, len(ts))) AS i FROM (SELECT {KEYS}, cigar, regexp_extract_all(cigar, '[0-9]*[^0-9]') AS ts FROM g_frags)))"""
_add(
    "parse_cigar",
    lambda spark, d: view(spark, d, "g_frags").select(*KEY, "cigar", F.posexplode(A.parse_cigar("cigar")).alias("i", "x")).select(*KEY, "cigar", F.col("i").cast("long").alias("i"), "x.op", "x.len"),
    f"{OPS} SELECT {KEYS}, cigar, i, op, len FROM o",
)
SUMS = ", ".join("CAST(coalesce(list_sum(list_transform(list_filter(ts, lambda t: right(t, 1) IN ({})), lambda t: greatest(1, coalesce(TRY_CAST(left(t, strlen(t) - 1) AS BIGINT), 1)))), 0) AS BIGINT) AS {}".format(", ".join(f"'{x}'" for x in which), n) for n, which in A.CIGAR_FIELDS.items())
_add(
    "cigar_stats",
    lambda spark, d: view(spark, d, "g_frags").select(*KEY, "cigar", A.cigar_stats("cigar").alias("x")).select(*KEY, "cigar", "x.*"),
    f"SELECT {KEYS}, cigar, {SUMS} FROM (SELECT *, regexp_extract_all(cigar, '[0-9]*[^0-9]') AS ts FROM g_frags)",
)
WINDOWS = "SELECT idx, i - 1 AS pos, levenshtein(substr(seq, i, 6), 'ACGTAC') AS dist FROM (SELECT idx, seq, unnest(range(1, CAST(strlen(seq) AS BIGINT) - 4)) AS i FROM g_reads)"
_add("primer_match", lambda spark, d: view(spark, d, "g_reads").select("idx", F.explode(A.primer_match("seq", "ACGTAC", 2)).alias("x")).select("idx", "x.*"), f"SELECT * FROM ({WINDOWS}) WHERE dist <= 2")
_add(
    "preprocess_16s",
    lambda spark, d: view(spark, d, "g_reads").select("idx", A.preprocess_16s("seq", "ACGTAC", "GGTACC", 2).alias("value")),
    f"""WITH f AS (SELECT idx, min(pos) + 6 AS st FROM ({WINDOWS}) WHERE dist <= 2 GROUP BY idx),
r AS (SELECT idx, min(pos) AS en FROM ({WINDOWS.replace("'ACGTAC'", COMPLEMENT.format("'GGTACC'"))}) WHERE dist <= 2 GROUP BY idx)
SELECT g_reads.idx, CASE WHEN st < en THEN substr(seq, st + 1, en - st) END AS value FROM g_reads LEFT JOIN f USING (idx) LEFT JOIN r USING (idx)""",
)
_add(
    "splice_junction_stats",
    lambda spark, d: view(spark, d, "g_frags").select("l_orderkey", "l_linenumber", F.explode(A.splice_junctions("cigar", "start_")).alias("x")).select("l_orderkey", "l_linenumber", "x.junction", F.col("x.start").alias("s"), F.col("x.end").alias("e")),
    """WITH j AS (SELECT l_orderkey, l_linenumber, start_ + CAST(split_part(cigar, 'M', 1) AS BIGINT) AS s, CAST(regexp_extract(cigar, 'M([0-9]+)N', 1) AS BIGINT) AS n FROM g_frags)
SELECT l_orderkey, l_linenumber, s || '-' || (s + n) AS junction, s, s + n AS e FROM j""",
)
_add(
    "detect_intron_retention",
    lambda spark, d: view(spark, d, "g_frags").select("l_orderkey", "l_linenumber", A.detect_intron_retention("cigar", "start_", F.col("start_") + 5, F.col("start_") + 20).alias("retained")),
    "SELECT l_orderkey, l_linenumber, CAST(split_part(cigar, 'M', 1) AS BIGINT) >= 20 AS retained FROM g_frags",
)
SELF = "SELECT a.idx AS i, b.idx AS j, CAST({} AS BIGINT) AS distance FROM g_taxa a, g_taxa b"
_add("parallel_hamming_matrix", lambda spark, d: OA.distance_matrix(view(spark, d, "g_taxa")), SELF.format("hamming(a.seq, b.seq)"))
_add("parallel_levenshtein_matrix", lambda spark, d: OA.distance_matrix(view(spark, d, "g_taxa"), "levenshtein"), SELF.format("levenshtein(a.seq, b.seq)"))

# proteomics
CUTS = """WITH s AS (SELECT idx, seq, list_concat(list_concat([0::BIGINT], list_filter(range(1, CAST(strlen(seq) AS BIGINT)), lambda i: substr(seq, i, 1) IN ('K', 'R') AND substr(seq, i + 1, 1) <> 'P')), [CAST(strlen(seq) AS BIGINT)]) AS cuts FROM g_proteins),
m AS (SELECT idx, seq, cuts, unnest([0, 1, 2]) AS mc FROM s), p AS (SELECT idx, seq, cuts, mc, unnest(range(1, len(cuts) - mc)) AS i FROM m)"""
_add(
    "trypsin_digest",
    lambda spark, d: view(spark, d, "g_proteins").select("idx", F.explode(P.trypsin_digest("seq", 2)).alias("peptide")),
    f"{CUTS} SELECT idx, substr(seq, cuts[i] + 1, cuts[i + 1 + mc] - cuts[i]) AS peptide FROM p",
)


def _mass_sql(masses: dict, start: float) -> str:
    case = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in masses.items()) + " ELSE 0 END"
    return f"SELECT idx, {start}::DOUBLE + sum({case}) AS m, strlen(any_value(seq)) AS n FROM (SELECT idx, seq, unnest(string_split(seq, '')) AS c FROM g_proteins) GROUP BY idx"


_add("peptide_mass", lambda spark, d: view(spark, d, "g_proteins").select("idx", F.round(P.peptide_mass("seq"), 5).alias("value")), f"SELECT idx, round(m, 5) AS value FROM ({_mass_sql(P.MONOISOTOPIC, P.WATER)})")
_add("protein_molecular_weight", lambda spark, d: view(spark, d, "g_proteins").select("idx", F.round(P.protein_molecular_weight("seq"), 5).alias("value")), f"SELECT idx, round(m, 5) AS value FROM ({_mass_sql(P.AVERAGE, P.AVERAGE_WATER)})")
_add("peptide_mz", lambda spark, d: view(spark, d, "g_proteins").select("idx", F.round(P.peptide_mz("seq", 2), 5).alias("value")), f"SELECT idx, round((m + 2 * {P.PROTON}::DOUBLE) / 2, 5) AS value FROM ({_mass_sql(P.MONOISOTOPIC, P.WATER)})")
_column("peptide_pi", lambda: P.peptide_pi("seq"), "7.0::DOUBLE + (strlen(translate(seq, 'DE', '')) - strlen(translate(seq, 'KRH', ''))) * 0.5::DOUBLE", "g_proteins")
_column("generate_decoy", lambda: P.generate_decoy("seq"), "reverse(seq)", "g_proteins")
_add(
    "enumerate_missed_cleavages",
    lambda spark, d: view(spark, d, "g_proteins").select("idx", F.explode(P.enumerate_missed_cleavages("seq")).alias("part")),
    "WITH a AS (SELECT idx, seq, unnest(range(1, CAST(strlen(seq) AS BIGINT) + 1)) AS n FROM g_proteins), b AS (SELECT idx, seq, n, unnest(range(1, CAST(strlen(seq) AS BIGINT) + 2 - n)) AS i FROM a) SELECT idx, substr(seq, i, n) AS part FROM b",
)
_add(
    "enumerate_modification_sites",
    lambda spark, d: view(spark, d, "g_proteins").select("idx", F.explode(P.enumerate_modification_sites("seq", ["S", "M"])).alias("pos")),
    "SELECT idx, i - 1 AS pos FROM (SELECT idx, seq, unnest(range(1, CAST(strlen(seq) AS BIGINT) + 1)) AS i FROM g_proteins) WHERE substr(seq, i, 1) IN ('S', 'M')",
)
_add(
    "is_unique_peptide",
    lambda spark, d: OA.is_unique_peptide(view(spark, d, "g_proteins").select(F.left("seq", F.lit(4)).alias("peptide")), view(spark, d, "g_proteins")).select("peptide", F.explode("proteins").alias("idx")),
    "WITH p AS (SELECT DISTINCT left(seq, 4) AS peptide FROM g_proteins) SELECT peptide, idx FROM p JOIN g_proteins ON contains(seq, peptide)",
)
