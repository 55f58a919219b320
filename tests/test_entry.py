"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    by = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(([plain(r[k]) for k in by] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6


def test_read_features_of_every_candidate(spark, duck):
    got = {r["k"]: (r["bam_coverage"], r["flow_candidate_signal_mean"]) for r in __spark_entry__.queries()["read_features"](spark, SF).collect()}
    assert sorted(got) == sorted(r[0] for r in duck.sql("SELECT p_partkey FROM part").fetchall())
    spanning = dict(duck.sql(ORACLES["spanning_reads"]).fetchall())
    assert {k: n for k, (n, _) in got.items() if n} == spanning and any(x is not None for _, x in got.values())
