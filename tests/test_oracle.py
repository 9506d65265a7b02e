"""A sample of registered queries against their SQL text in DuckDB (the full sweep is tools/oracle_check.py)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from abode.sources.tables import TABLES, table_path
from tests.conftest import SF0001

SAMPLE = ["p0_price_per_m2_by_city_age", "p1_price_features", "d08_floor_text", "d14a_include_lowest",
          "c06_not_contains_keep_null", "e06_describe_numeric", "e07_describe_object", "e10_histogram",
          "j03_exact_split", "e01_rare_levels", "b06_failing_rows", "k01_target_encoding_fit", "l03_drift_report_lineitem",
          "m05c_chi_square", "n02_windowed_drift_events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    return c


def _canon(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v.item() if hasattr(v, "item") else v
    rows = [tuple(norm(v) for v in r) for r in pdf.itertuples(index=False)]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = _canon(E.queries()[name](spark, SF0001).toPandas())
    want = _canon(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
