"""Registered queries against their SQL, and the entry points without the training-data operators."""

import os
import subprocess
import sys

import duckdb
import pytest

from strandlake.plans import bitstreams, catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    plain = lambda r: tuple(int(x) if hasattr(x, "as_tuple") else x for x in r)
    want = sorted((plain(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((plain(r) for r in got.select(columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_bitstream_queries_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_native_headers(spark):
    r = bitstreams.ivf_headers(spark, SF).first()
    assert (r["header_length"], r["width"], r["height"], r["tb_den"], r["tb_num"], r["frame_count"]) == (32, 16, 16, 30, 1, 4)


def test_entry_points_without_the_operators(tmp_path):
    """The rest imports where strandlake.llm and corpus_pipeline are gone."""
    block = "import sys; sys.modules['strandlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) == {k for k in e.oracle_sql() if not k.startswith('op')})"
    out = subprocess.run([sys.executable, "-c", block], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split()[-1] == "True"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
