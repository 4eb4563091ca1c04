"""Every registered query at the smallest scale, against its SQL where given."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if n not in entry.LLM_QUERIES]  # the others are tested in their own folder

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    want = con.execute(SQL[name]).to_arrow_table()
    rows = lambda t: canonical(t.column_names, zip(*[c.to_pylist() for c in t.columns]))
    assert rows(got) == rows(want)


def test_names_and_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert not [n for n in OWN if re.match(r"op\d", n) or "pipeline" == n]
    assert entry.entry(spark).limit(1).count() == 1
