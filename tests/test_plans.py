"""Plan shape: no Python in the plans, broadcast only for fixed lookups, pruning and pushdown reach the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from abode.catalog import ORACLE, QUERIES, load_all
from tests.conftest import SF0001

load_all()
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF",
                "MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow", "FlatMapCoGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_checked_queries_stay_in_the_jvm(spark, name):
    if name.startswith(("a0", "i01", "n0", "k0", "k1")):
        pytest.skip("writes files or fits models while building")
    plan = _plan(QUERIES[name](spark, SF0001))
    assert not any(p in plan for p in PYTHON_NODES), name


def test_listing_view_prunes_and_broadcasts_nation(spark):
    from abode.sources.listing_view import listing_view
    plan = _plan(listing_view(spark, SF0001).select("listing_id", "city_slug"))
    assert "BroadcastHashJoin" in plan
    assert "o_orderstatus" not in plan and "c_acctbal" not in plan   # pruned from the scans


def test_filters_reach_the_scan(spark):
    from abode.sources.tables import read_table
    li = read_table(spark, SF0001, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    plan = _plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_split_partition_pruning(spark, tmp_path):
    from abode.sources.files import read_splits
    df = spark.range(20).withColumn("split", F.when(F.col("id") < 5, "val").otherwise("train"))
    df.write.partitionBy("split").parquet(str(tmp_path / "s"))
    plan = _plan(read_splits(spark, str(tmp_path / "s")).where(F.col("split") == "train"))
    assert "PartitionFilters: [isnotnull(split" in plan


@pytest.mark.parametrize("name", ["e06_describe_numeric", "e11_box_stats", "l03_drift_report_lineitem", "m04_summaries_by_city_class"])
def test_order_statistics_read_their_source_once_without_python(spark, monkeypatch, name):
    # value counts are written; neither their plan nor any later one, written or not, holds Python or a range exchange
    import abode.operators.drift as D
    import abode.operators.ordered as O
    seen = []
    real = O.materialize

    def spy(df, label, partition_by=None):
        seen.append((label, _plan(df)))
        return real(df, label, partition_by)

    monkeypatch.setattr(O, "materialize", spy)
    monkeypatch.setattr(D, "materialize", spy)
    last = _plan(QUERIES[name](spark, SF0001))
    plans = [p for _, p in seen] + [last]
    assert seen and not any(n in p for n in (*PYTHON_NODES, "rangepartitioning", "SinglePartition, REPARTITION") for p in plans)
    reads = [p for p in plans if "lineitem.parquet" in p or "orders.parquet" in p]
    assert len(reads) <= (1 if name.startswith("e") else 2)  # the drift report also reads the level columns
