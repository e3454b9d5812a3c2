"""Streaming aggregates end with what a batch gives."""

from loomseq.operators.kmers import kmer_counts as batch_counts
from loomseq.streaming import directories as D


def test_kmers(spark, tmp_path):
    seqs = ["ATGCGCATGC", "GGGCCCATAT", "ACGTACGT"]
    for i, s in enumerate(seqs):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(f">h{i}\n{s}\n\n")
    stream = D.stream_sequences(spark, str(tmp_path / "in"), 1)
    for name, df in (("kmers", D.kmer_counts(stream, 3)), ("lengths", D.length_counts(stream)), ("gc", D.gc_counts(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    want = batch_counts(spark.createDataFrame(list(enumerate(seqs)), "idx long, seq string"), 3)
    assert sorted(map(tuple, spark.table("kmers").collect())) == sorted(map(tuple, want.collect()))
    assert {r.length: r.n for r in spark.table("lengths").collect()} == {10: 2, 8: 1}
    assert sum(r.n for r in spark.table("gc").collect()) == 3
