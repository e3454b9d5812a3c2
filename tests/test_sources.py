"""Readers and writers over small files."""

import gzip

import pytest

from loomseq.operators import reads as Q
from loomseq.operators.intervals import interval_stats, region_coverage
from loomseq.sources import batches as B
from loomseq.sources import text as T
from loomseq.sources.fastq import read_fastq

#: 40 bases, 7 of them G or C, two N; qualities of 10 at the first five bases, of 35 at the others.
SEQ = "TTTAACCTTTAANNAATTGGATTTTAAACTTTTAAAGGTT"
FASTQ = "".join(f"@lane4:{7 * i}\n{SEQ}\n+\n{'+' * 5}{'D' * 35}\n" for i in range(60))
SAM = "@SQ\tSN:scafA\n" + "".join(
    "\t".join(map(str, r)) + "\n"
    for r in [
        ("alpha", 16, "scafA", 1000, 40, "20M", "*", 0, 0, "T" * 20, "F" * 20, "AS:i:7"),
        ("beta", 0, "scafA", 1010, 20, "25M", "scafB", 90, 35, "G" * 25, "F" * 25),
        ("gamma", 4, "*", 0, 0, "*", "*", 0, 0, "CCATG", "FFFFF"),
        ("delta", 0, "scafA", 1500, 60, "12M", "*", 0, 0, "A" * 12, "F" * 12),
        ("eps", 1024, "scafB", 77, 0, "8M", "*", 0, 0, "C" * 8, "F" * 8),
    ]
)
VCF = "##made by hand\n#CHROM\tPOS\n" + "".join(
    "\t".join(r) + "\n"
    for r in [
        ("scafB", "905", "v1", "T", "C", "12.5", "q20", "AF=0.5;SOMATIC;AF=0.25"),
        ("scafA", "31", "v2", "GGT", "G", "77", "PASS", "."),
        ("scafA", "64", "v3", "C", "CA", "40", "PASS", "."),
        ("scafA", "65", "v4", "A", "T", "x", "PASS", "."),
        ("scafC", "5", "v5", "G", "A", "41", "PASS", "END=9"),
    ]
)
GTF = "\n".join(
    [
        '# by hand\nscafA\tm\tgene\t2000\t2600\t.\t-\t.\tgene_id "lin7"; gene_biotype "snoRNA";',
        'scafA\tm\tgene\t2500\t4000\t.\t+\t.\tgene_id "abc1";',
        'scafC\tm\tgene\t10\t90\t.\t+\t.\tgene_id "zip"; gene_biotype "snoRNA";',
        'scafA\tm\ttranscript\t2000\t2600\t.\t-\t.\tgene_id "lin7"; transcript_id "lin7.a";',
        'scafA\tm\texon\t2000\t2150\t.\t-\t.\tgene_id "lin7"; transcript_id "lin7.a"; exon_id "one"; exon_id "uno";',
        'scafA\tm\texon\t2400\tx9\t.\t-\t.\tgene_id "lin7"; transcript_id "lin7.a"; exon_id "two";',
    ]
)


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        if name.endswith(".gz"):
            half = len(text) // 2
            p.write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
        else:
            p.write_text(text)
        return str(p)

    return write


@pytest.mark.parametrize("name,split", [("a.fq", 1 << 20), ("a.fq", 1000), ("a.fq.gz", 1000)])
def test_fastq(spark, put, name, split):
    df = read_fastq(spark, put(name, "junk\n" + FASTQ + "@cut\nAC\n"), split=split)
    r = Q.fastq_stats(df).first()
    assert (r.total_reads, r.total_bases, r.n_bases, r.min_length) == (60, 2400, 120, 40)
    assert r.avg_qual == pytest.approx((5 * 10 + 35 * 35) / 40) and r.q30_rate == pytest.approx(35 / 40) and r.gc_content == pytest.approx(7 / 40)
    assert Q.fastq_filter(df, 40, 31).count() == 60 and Q.fastq_filter(df, 40, 32).count() == 0
    assert tuple(Q.sliding_window_filter(df, 5, 30.0).first()) == (60, 0) and tuple(Q.sliding_window_filter(df, 10, 22.5).first()) == (60, 60)
    assert {r.header for r in df.collect()} == {f"lane4:{7 * i}" for i in range(60)}


def test_empty_qualities_pass(spark):
    df = spark.createDataFrame([("h", "", "")], "header string, seq string, qual string")
    assert Q.fastq_filter(df, 0, 99.0).count() == 1
    assert Q.fastq_stats(df.limit(0)).first().total_reads == 0


def test_quality_lines_like_headers(spark, put):
    text = "".join(f"@r{i}\nACGT\n+\n@@@{'@+I'[i % 3]}\n" for i in range(60))
    for split in (37, 101, 4096):
        assert sorted(r.header for r in read_fastq(spark, put("q.fq", text), split=split).collect()) == sorted(f"r{i}" for i in range(60))


def test_sam(spark, put):
    sam = T.read_sam(spark, put("a.sam", SAM))
    r = Q.sam_stats(sam).first()
    assert (r.total_reads, r.mapped, r.unmapped, r.duplicates, r.avg_mapq) == (5, 4, 1, 1, 30.0)
    assert {r.chrom: r.n for r in Q.sam_chrom_counts(sam).collect()} == {"scafA": 3, "scafB": 1}
    assert tuple(Q.insert_size_stats(sam).first()) == (0, 0.0, 0, 0, 0)
    assert sam.where("qname = 'alpha'").first().tags == {"AS": "7"}
    assert [Q.coverage_at_position(sam, "scafA", p).first().depth for p in (999, 1005, 1015, 1020, 1035)] == [0, 1, 2, 1, 0]
    assert [r.depth for r in region_coverage(Q.sam_spans(sam), "scafA", 1008, 1012).orderBy("pos").collect()] == [1, 1, 2, 2]
    assert T.sam_to_tsv(spark, put("b.sam", SAM)).count() == 5


def test_vcf_gtf_bed(spark, put):
    vcf = T.read_vcf(spark, put("a.vcf", VCF))
    assert tuple(Q.vcf_stats(vcf).first()) == (5, 3, 2)
    assert [r.id for r in Q.vcf_filter(vcf, 40).orderBy("id").collect()] == ["v2", "v3", "v5"]
    assert vcf.where("id = 'v1'").first().info == {"AF": "0.25", "SOMATIC": "true"}
    gtf = T.read_gtf(spark, put("a.gtf", GTF))
    assert tuple(Q.gtf_stats(gtf).first()) == (3, 1)
    assert gtf.where("feature = 'exon'").orderBy("start_").collect()[0].attributes["exon_id"] == "uno"
    assert {r.biotype: r.n for r in Q.gene_biotype_stats(gtf).collect()} == {"snoRNA": 2, "unknown": 1}
    assert Q.transcript_length_stats(gtf).first().length == (2150 - 2000) + (0 - 2400)  # what is no number is 0
    reads = spark.createDataFrame([("scafA", 2000), ("scafA", 2550), ("scafA", 2600), ("scafA", 4000), ("scafC", 89), ("scafB", 50)], "chrom string, pos long")
    assert {r.gene_id: r.n for r in Q.gene_count_matrix(gtf, reads).collect()} == {"lin7": 2, "abc1": 2, "zip": 1}
    assert T.gtf_to_bed(spark, put("b.gtf", GTF), "gene", zero_based=True).orderBy("start_").first().start_ == 9
    bed = T.read_bed(spark, put("a.bed.gz", "browser hide all\nscafA\t7\t19\thill\t3\t-\nscafA\t40\t44\n\nscafD\tq\t25\tz\n"))
    assert interval_stats(bed).first().total_bases == 12 + 4 + 25
    assert bed.where("start_ = 40").first().name == "."


def test_batches(spark, put, tmp_path):
    a, b = put("x.fq", FASTQ), put("y.fq.gz", FASTQ[: len(FASTQ) // 2])
    out = {r.input: r.kept for r in B.batch_fastq_filter(spark, {a: "first", b: "second"}, str(tmp_path / "out"), 40, 31.0).collect()}
    assert out["first"] == 60 and 28 <= out["second"] <= 30
    assert {r.input: r.kept for r in B.batch_fastq_filter(spark, {a: "first"}, str(tmp_path / "none"), 41, 0.0).collect()} == {"first": 0}
    fasta = B.parallel_parse_fasta(spark, [put("k.fa", ">p\nGG\n"), "/nowhere/k.fa", put("l.fa", ">q\nTT\n>r\nA\n")])
    assert sorted((r.header, r.seq) for r in fasta.collect()) == [("p", "GG"), ("q", "TT"), ("r", "A")]
    left = put("left.bed", "c1\t0\t10\tl1\nc1\t100\t90000\tl2\nc2\t5\t9\tl3\n")
    rows = B.parallel_bed_intersect(spark, left, [put("r1.bed", "c1\t9\t101\tm1\nc2\t9\t12\tm2\n"), "/nowhere/r.bed", put("r2.bed", "c2\t0\t6\tm3\n")])
    assert sorted((r.a_name, r.b_name, r.start_, r.end_) for r in rows.collect()) == [("l1", "m1", 9, 10), ("l2", "m1", 100, 101), ("l3", "m3", 5, 6)]
    assert B.parallel_bed_intersect(spark, left, ["/nowhere/r.bed"]).count() == 0


def test_fasta_and_matrix(spark, put):
    fasta = T.read_fasta(spark, put("a.fa", "junk\n>\nAA\n>one x\nAC\nGT\n>two\r\nTT\r\n"))
    assert sorted((r.header, r.seq) for r in fasta.collect()) == [("one x", "ACGT"), ("two", "TT")]
    assert T.read_fasta(spark, "/nowhere/at/all.fa", ignore_missing=True).count() == 0
    m = T.read_expression_matrix(spark, put("m.csv", "gene,c1,c2\ng1,1,x\ng2,2.5\n"), ",")
    assert sorted((r.gene, r.cell, r.value) for r in m.collect()) == [("g1", "c1", 1.0), ("g1", "c2", 0.0), ("g2", "c1", 2.5)]
    assert T.read_gz(spark, put("t.gz", "one\ntwo\n")).first().value == "one\ntwo\n"


@pytest.mark.parametrize("name", ["write_gz", "read_gz"])
def test_gz_of_a_task_without_rows(spark, tmp_path, name):
    """A row group belongs to the task that has its middle, so a file's first task may have no rows; Spark then writes an empty file."""
    from loomseq.plans.registry import queries

    orders = spark.range(5000).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "'F' AS o_orderstatus")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    size = str(max(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("part-*")) // 4)
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = [r.line for r in queries()[name](spark, str(tmp_path)).collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(lines) == 5000 and "" not in lines


def test_matrix_market(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, 2.0), (0, 1, 0.0), (0, 0, 1.5)], "row long, col long, value double")
    assert T.write_matrix_market(e, 2, 2, str(tmp_path / "m")) == 2
    (part,) = (tmp_path / "m").glob("part-*")
    assert part.read_text().splitlines()[1:] == ["2 2 2", "1 1 1.5", "2 1 2"]
