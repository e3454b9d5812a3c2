"""The driver's contract, and a sample of queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomseq.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["coverage_over_intervals", "bed_closest", "bed_subtract", "find_orfs", "minimizers", "translate", "trypsin_digest", "fastq_stats", "region_coverage", "bh_correction", "correct_barcode"]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 141


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted(map(str, found.fetchall()))
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want
