import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 20 and got[0]["n"] >= got[1]["n"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["tok_restricted", "lex_shape", "match_sequence", "k_seq2col", "w08_svo", "entity_prf", "like_num", "arch_multi_hash_embed", "string_store", "w15_noun_chunks", "classify"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert key(got) == key(want)
