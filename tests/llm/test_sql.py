"""Every training-data query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracles import digest
from conftest import SF_SMALL
from kbpipe.llm.oracle import ORACLES
from kbpipe.sources.tables import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    assert digest(got) == digest(con.execute(E.oracle_sql()[name]).df())
