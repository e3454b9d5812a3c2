"""Genomic inputs derived from the driver's tables by keys.

Each view is a projection of one table, in text that Spark and DuckDB both
read, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: How hexadecimal digits become bases, qualities and residues.
HEX = "'0123456789abcdef'"

VIEWS: dict[str, tuple[str, str]] = {
    "g_reads": (
        "orders",
        f"""o_orderkey AS idx,
       concat(translate(md5(CAST(o_orderkey AS VARCHAR(20))),{HEX},'ACGTACGTACGTACGN'),
              translate(md5(concat('b',CAST(o_orderkey AS VARCHAR(20)))),{HEX},'ACGTACGTACGTACGT')) AS seq,
       translate(concat(md5(concat('q',CAST(o_orderkey AS VARCHAR(20)))),md5(concat('r',CAST(o_orderkey AS VARCHAR(20))))),
                 {HEX},'!&+05:?ABCDEFGHI') AS qual""",
    ),
    "g_proteins": ("part", f"p_partkey AS idx, translate(md5(CAST(p_partkey AS VARCHAR(20))),{HEX},'ACDEFGHIKLMNPQRS') AS seq"),
    "g_intervals": (
        "orders",
        """o_orderkey AS idx, concat('chr',CAST(o_custkey%25+1 AS VARCHAR(20))) AS chrom,
       (o_orderkey*137)%2000000 AS start_, (o_orderkey*137)%2000000+500 AS end_,
       CASE WHEN o_orderstatus='F' THEN '-' ELSE '+' END AS strand, concat('g',CAST(o_orderkey AS VARCHAR(20))) AS name""",
    ),
    "g_frags": (
        "lineitem",
        """l_orderkey, l_linenumber, l_partkey, concat('chr',CAST(l_suppkey%25+1 AS VARCHAR(20))) AS chrom,
       (l_partkey*1000+l_orderkey%1000)%2000000 AS start_,
       (l_partkey*1000+l_orderkey%1000)%2000000+CAST(l_quantity AS BIGINT)*10 AS end_,
       concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)),'M',CAST(l_linenumber*100 AS VARCHAR(20)),'N30M') AS cigar""",
    ),
    "g_umis": (
        "events",
        f"""event_id AS idx, translate(substring(md5(CAST(user_id AS VARCHAR(20))),1,8),{HEX},'ACGTACGTACGTACGT') AS barcode,
       translate(substring(md5(CAST(event_id AS VARCHAR(20))),1,4),{HEX},'ACGTACGTACGTACGT') AS umi,
       event_type AS feature""",
    ),
    "g_sam": (
        "orders",
        f"""concat('r',CAST(o_orderkey AS VARCHAR(20))) AS qname, CAST((o_orderkey*7)%4096 AS INT) AS flag,
       CASE WHEN o_orderkey%11=0 THEN '*' ELSE concat('chr',CAST(o_custkey%25+1 AS VARCHAR(20))) END AS rname,
       (o_orderkey*137)%100000 AS pos, CAST(o_orderkey%61 AS INT) AS mapq, concat(CAST(30+o_orderkey%30 AS VARCHAR(20)),'M') AS cigar, '=' AS rnext,
       (o_orderkey*131)%100000 AS pnext, o_orderkey%1000-300 AS tlen,
       substring(translate(md5(CAST(o_orderkey AS VARCHAR(20))),{HEX},'ACGTACGTACGTACGN'),1,CAST(10+o_orderkey%20 AS INT)) AS seq, '*' AS qual""",
    ),
    "g_vcf": (
        "part",
        """concat('chr',CAST(p_partkey%25+1 AS VARCHAR(20))) AS chrom, p_partkey*10 AS pos, concat('rs',CAST(p_partkey AS VARCHAR(20))) AS id,
       substring('ACGTA',CAST(p_partkey%4+1 AS INT),CAST(1+CASE WHEN p_partkey%7=0 THEN 1 ELSE 0 END AS INT)) AS ref_,
       substring('GTACG',CAST(p_partkey%4+1 AS INT),CAST(1+CASE WHEN p_partkey%5=0 THEN 1 ELSE 0 END AS INT)) AS alt, CAST(p_partkey%50 AS DOUBLE) AS qual,
       CASE WHEN p_partkey%9=0 THEN 'LowQual' ELSE 'PASS' END AS filter_""",
    ),
    "g_gtf": (
        "orders",
        """concat('chr',CAST(o_custkey%25+1 AS VARCHAR(20))) AS chrom,
       CASE o_orderkey%4 WHEN 0 THEN 'gene' WHEN 1 THEN 'transcript' ELSE 'exon' END AS feature,
       (o_orderkey*137)%2000000 AS start_, (o_orderkey*137)%2000000+500 AS end_, CASE WHEN o_orderstatus='F' THEN '-' ELSE '+' END AS strand,
       concat('G',CAST(o_orderkey%500 AS VARCHAR(20))) AS gene_id, concat('T',CAST(o_orderkey%700 AS VARCHAR(20))) AS transcript_id,
       concat('E',CAST(o_orderkey%900 AS VARCHAR(20))) AS exon_id, CASE o_orderkey%3 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'lncRNA' END AS biotype""",
    ),
    "g_taxa": ("supplier", f"s_suppkey AS idx, s_nationkey AS grp, concat('t',CAST(s_suppkey AS VARCHAR(20))) AS name, translate(md5(CAST(s_suppkey%60 AS VARCHAR(20))),{HEX},'ACGTACGTACGTACGT') AS seq"),
    "g_series": ("orders", "o_orderkey AS idx, o_orderstatus AS g, o_totalprice AS x, CAST((o_orderkey*31)%997 AS DOUBLE) AS y"),
    "g_pvalues": ("orders", "o_orderkey AS idx, CAST((o_orderkey*7919)%10007 AS DOUBLE)/10007 AS value, o_orderstatus='F' AS is_a"),
    "g_table": ("part", "p_partkey AS idx, p_partkey%17 AS a, p_partkey%13+1 AS b, p_partkey%11+1 AS c, p_partkey%7 AS d"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.selectExpr(*[c.strip() for c in _top_level(columns)])


def _top_level(columns: str) -> list[str]:
    """Splits a select list at the commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def with_views(sql: str) -> str:
    """sql for DuckDB, after the definitions of the views that it names."""
    used = [f"{n} AS (SELECT {columns} FROM {table})" for n, (table, columns) in VIEWS.items() if n in sql]
    head = ", ".join(used)
    if not head:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().upper().startswith(start):
            return f"{start}{head}, {sql.lstrip()[len(start):]}"
    return f"WITH {head} {sql}"
