"""Data contracts (group B): presence, not-null, range and coercion rules, evaluated lazily.

All rules of a contract are evaluated in ONE aggregate per split (``groupBy(split)``), then
stacked to a long report ``(split, rule, n_checked, n_failed)``; failing rows carry the list
of the rules they break. Nothing is collected but the gate's single failure count.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.config import CREDIT, PRICE, RAW_REQUIRED_COLUMNS
from abode.functions.scalars import to_number


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    kind: str            # "not_null" | "range" | "coerce_double"
    lo: float | None = None
    hi: float | None = None

    def checked(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return F.lit(True)
        return c.isNotNull()

    def failed(self, numeric: bool = False) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "range":
            v = c.cast("double") if numeric else to_number(c)  # coerce first: strings parse leniently
            return c.isNotNull() & (v.isNull() | ~v.between(F.lit(self.lo), F.lit(self.hi)))
        if self.kind == "coerce_double":
            return F.lit(False) if numeric else (c.isNotNull() & to_number(c).isNull())
        raise ValueError(self.kind)


class DataValidationError(Exception):
    pass


def missing_columns(spark: SparkSession, df: DataFrame, required: Sequence[str]) -> DataFrame:
    """B1: required names absent from the frame (metadata only, no job over the data)."""
    present = set(df.columns)
    rows = [(c,) for c in required if c not in present]
    return spark.createDataFrame(rows, "column_name string")


def column_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null rows of each named column, null where the frame has no such column; one aggregate."""
    held = [F.struct(F.lit(c).alias("column_name"), (F.count(c) if c in df.columns else F.lit(None).cast("long")).alias("n_rows")) for c in names]
    return df.agg(F.array(*held).alias("c")).select(F.inline("c"))


def price_rules(cfg: dict = PRICE) -> list[Rule]:
    """Processed sale frames: target and size present and inside bounds, city and category present."""
    o, t = cfg["outliers"], cfg["target_column"]
    return [
        Rule(f"{t}_not_null", t, "not_null"),
        Rule(f"{t}_in_range", t, "range", o["price_value_min"], o["price_value_max"]),
        Rule("building_size_not_null", "building_size", "not_null"),
        Rule("building_size_in_range", "building_size", "range", o["building_size_min"], o["building_size_max"]),
        Rule("city_slug_not_null", "city_slug", "not_null"),
        Rule("cat2_slug_not_null", "cat2_slug", "not_null"),
    ]


def credit_rules(cfg: dict = CREDIT) -> list[Rule]:
    o, t = cfg["outliers"], cfg["target_column"]
    return [
        Rule(f"{t}_not_null", t, "not_null"),
        Rule(f"{t}_in_range", t, "range", o["total_credit_min"], o["total_credit_max"]),
        Rule("building_size_not_null", "building_size", "not_null"),
        Rule("building_size_in_range", "building_size", "range", o["building_size_min"], o["building_size_max"]),
        Rule("city_slug_not_null", "city_slug", "not_null"),
    ]


def raw_rules() -> list[Rule]:
    """The raw contract coerces money, size and coordinates to numbers."""
    return [Rule(f"{c}_coerce_double", c, "coerce_double") for c in
            ("price_value", "rent_value", "credit_value", "building_size", "location_latitude", "location_longitude")]


def _numeric_cols(df: DataFrame) -> set:
    from pyspark.sql import types as T
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}


def contract_report(df: DataFrame, rules: Sequence[Rule], split: str | None = "split") -> DataFrame:
    """Every rule evaluated in one pass per split: ``(split, rule, n_checked, n_failed)``."""
    num = _numeric_cols(df)
    keys = [F.col(split)] if split else [F.lit("all").alias("split")]
    aggs = []
    for i, r in enumerate(rules):
        aggs.append(F.count_if(r.checked()).alias(f"_c{i}"))
        aggs.append(F.count_if(r.failed(r.column in num)).alias(f"_f{i}"))
    one = df.groupBy(*keys).agg(*aggs)
    split_col = split if split else "split"
    stacked = one.select(F.col(split_col).alias("split"), F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"_c{i}").alias("n_checked"), F.col(f"_f{i}").alias("n_failed"))
        for i, r in enumerate(rules)])).alias("s"))
    return stacked.select("split", "s.rule", "s.n_checked", "s.n_failed")


def failing_rows(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken rules."""
    num = _numeric_cols(df)
    broken = F.array_compact(F.array(*[F.when(r.failed(r.column in num), F.lit(r.name)) for r in rules]))
    return df.select(*keep, broken.alias("broken_rules")).where(F.size("broken_rules") > 0)


def gate(report: DataFrame, skip: bool = False) -> DataFrame:
    """Per-split pass flag; raises ``DataValidationError`` on any failure unless ``skip``."""
    summary = report.groupBy("split").agg(F.sum("n_failed").alias("n_failed"))
    summary = summary.withColumn("passed", F.col("n_failed") == 0)
    if not skip:
        total = report.agg(F.coalesce(F.sum("n_failed"), F.lit(0))).first()[0]
        if total:
            raise DataValidationError(f"contract failed: {total} rule violations")
    return summary


def validate_raw(spark: SparkSession, df: DataFrame) -> DataFrame:
    """P6 raw: required columns present (raises), then the coercion report."""
    miss = [c for c in RAW_REQUIRED_COLUMNS if c not in df.columns]
    if miss:
        raise DataValidationError(f"missing required columns: {miss}")
    return contract_report(df, raw_rules(), split=None)
