import math

import pytest

import __spark_entry__ as entry
from siftwork import plans
from siftwork.errors import DataIntegrityError

DATA = "/root/testdata/sf0.001"


def cells(row):
    return tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else None if isinstance(v, float) and math.isnan(v) else list(v) if isinstance(v, (list, tuple)) else v for v in row)


def same(spark, name, query, sql, data=DATA):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = query(spark, data)
    names = sorted(df.columns)
    got = sorted((cells(r) for r in df.select(*names).collect()), key=repr)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({sql}) AS t").fetchall()
    assert got == sorted((cells(r) for r in found), key=repr), name


@pytest.mark.parametrize("name", sorted(set(plans.ORACLES) - {"split_assignment"}))
def test_query_equals_sql(spark, name):
    same(spark, name, entry.queries()[name], plans.ORACLES[name])


def test_split_assignment_equals_sql(spark):
    query, sql = entry.queries()["split_assignment"], plans.ORACLES["split_assignment"]
    same(spark, "split_assignment", query, sql, "/root/testdata/sf0.01")
    with pytest.raises(DataIntegrityError, match="two fake families"):  # the smallest size lacks them
        query(spark, DATA)


def test_temperature_fit(spark):
    (row,) = entry.queries()["temperature_fit"](spark, DATA).collect()
    assert 0 < row["nll"] <= row["nll_before"] + 1e-7 and row["temperature"] > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 13
