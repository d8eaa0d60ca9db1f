"""Every registered query against its DuckDB oracle (the driver's gate),
on the smallest data folder."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

# the training-data queries have tests of their own and may be absent
OTHER = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in E.queries().items() if not OTHER.match(k)}
ORACLES = {k: v for k, v in E.oracle_sql().items() if not OTHER.match(k)}
FAST = os.environ.get("CHAINLAKE_FAST_TESTS") == "1"


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_documented():
    assert not set(QUERIES) - set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["chain", "mod_name", "hour_ms", "n_events", "n_success_extrinsics"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    if FAST and name.startswith("stream_"):
        pytest.skip("streaming skipped in fast mode")
    df = QUERIES[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
