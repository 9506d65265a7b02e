"""Job queries of both tasks: the price report against its SQL, the credit training with val and test metrics."""

from __future__ import annotations

import duckdb

import __spark_entry__ as E
from abode.config import BENCH_MODELS, CREDIT
from abode.plans import jobs
from abode.sources.tables import TABLES, table_path
from tests.conftest import SF0001


def test_price_report_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    got = E.queries()["p6_validate_job_price"](spark, SF0001)
    want = con.execute(E.oracle_sql()["p6_validate_job_price"]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None)) and len(want)


def test_credit_training_has_val_and_test_metrics(spark, monkeypatch):
    seen, fit = [], jobs.train_and_evaluate

    def small(data, cfg, presets, *args, **kwargs):
        assert presets == CREDIT["models"]
        out = fit(data, cfg, {"random_forest": BENCH_MODELS["random_forest"] | {"n_estimators": 2, "max_depth": 2}}, *args, **kwargs)
        seen.extend(r.split for r in out[2].collect())
        return out

    monkeypatch.setattr(jobs, "train_and_evaluate", small)
    assert E.queries()["p7_train_job_credit"](spark, SF0001).count() == 1
    assert set(seen) == {"val", "test"}
