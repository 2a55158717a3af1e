"""Every query with SQL gives the SQL's rows; every other runs."""

import duckdb
import pytest

import __spark_entry__
from cloudweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    want = duck.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert ordered(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect())) == ordered(want.project(",".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["p4_embedding_search", "p5_projection", "t2_maxmin_subsample", "x1_cross_barcodes_h0", "e14_fusion", "i3_capped_components", "i4_explained_r2", "i6_nulls_of_blocks", "g1_spectrum", "g2_canonical_features"])
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
