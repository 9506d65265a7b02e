"""Counts over the required and common columns against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from abode.sources.tables import TABLES, table_path
from tests.conftest import SF0001


@pytest.mark.parametrize("name", ["b01b_required_column_counts", "l01b_common_column_counts"])
def test_counts_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    got = E.queries()[name](spark, SF0001)
    want = [tuple(dict(zip(("column_name", "side", "n_rows"), r if len(r) == 3 else (r[0], None, r[1])))[c] for c in got.columns)
            for r in con.execute(E.oracle_sql()[name]).fetchall()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want)
