"""Encoders (group K1-K4) as Spark ML stages.

* :class:`SmoothedTargetEncoder` (K1/K2): per-level target statistics from an aggregate,
  applied by a null-safe left join (unseen -> prior). Two smoothing modes: ``sigmoid``
  (weight ``1/(1+exp(-(n-min_samples_leaf)/smoothing))`` blends level mean and prior) and
  ``additive`` (``(sum + s*prior)/(n + s)``, Spark's own ``TargetEncoder`` formula).
* One-hot (K3): ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)`` on
  columns whose nulls are first turned into a level, so unseen levels encode as zeros.
* :func:`feature_pipeline` (K4): boolean codes -> target encoding -> one-hot -> assembler.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_LEVEL = "__null__"


class _TEParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to encode", TypeConverters.toListString)
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of encoded columns", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "numeric target", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "smoothing strength", TypeConverters.toFloat)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "sigmoid offset", TypeConverters.toFloat)
    mode = Param(Params._dummy(), "mode", "sigmoid | additive", TypeConverters.toString)
    prior = Param(Params._dummy(), "prior", "fitted global target mean", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(outputSuffix="_te", labelCol="label", smoothing=10.0, minSamplesLeaf=20.0, mode="sigmoid")


def target_encoding_table(df: DataFrame, cols: Sequence[str], label: str, smoothing: float = 10.0,
                          min_samples_leaf: float = 20.0, mode: str = "sigmoid"):
    """K1: ``(column_name, level, n, encoding)`` for every level seen, plus the prior (train mean).

    One unpivot to ``(column_name, level, y)`` and one aggregate, so all encoded columns
    share a single shuffle with map-side partial sums. Nulls are kept as a level.
    """
    prior = df.agg(F.avg(label)).scalar()
    longdf = df.select(F.col(label).cast("double").alias("_y"),
                       *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_y"], list(cols), "column_name", "level")
    stats = longdf.groupBy("column_name", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_mean"), F.sum("_y").alias("_sum"))
    s = float(smoothing)
    if mode == "sigmoid":
        w = 1.0 / (1.0 + F.exp(-(F.col("n") - float(min_samples_leaf)) / s))
        enc = prior * (1 - w) + F.col("_mean") * w
    elif mode == "additive":
        enc = (F.col("_sum") + s * prior) / (F.col("n") + s)
    else:
        raise ValueError(mode)
    return stats.select("column_name", "level", "n", enc.alias("encoding")), prior


def apply_target_encoding(df: DataFrame, table: DataFrame, prior, cols: Sequence[str], suffix: str = "_te") -> DataFrame:
    """Null-safe left join per column; unseen levels (and unseen null) -> prior.

    The level table grows with the key's cardinality, so it is joined without a hint;
    AQE broadcasts it once measured small.
    """
    out = df
    for c in cols:
        m = table.where(F.col("column_name") == c).select(F.col("level").alias(f"_lvl_{c}"),
                                                          F.col("encoding").alias(f"_enc_{c}"))
        out = out.join(m, F.col(c).cast("string").eqNullSafe(F.col(f"_lvl_{c}")), "left")
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_enc_{c}"), prior))
        out = out.drop(f"_lvl_{c}", f"_enc_{c}")
    return out


class SmoothedTargetEncoder(Estimator, _TEParams, MLReadable, MLWritable):
    """K1 as an Estimator: ``fit`` requires the label column."""

    def __init__(self, inputCols=None, labelCol="label", smoothing=10.0, minSamplesLeaf=20.0, mode="sigmoid",
                 outputSuffix="_te"):
        super().__init__()
        self._set(labelCol=labelCol, smoothing=smoothing, minSamplesLeaf=minSamplesLeaf, mode=mode,
                  outputSuffix=outputSuffix)
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, df: DataFrame) -> "SmoothedTargetEncoderModel":
        label = self.getOrDefault("labelCol")
        if label not in df.columns:
            raise ValueError(f"target encoder fit requires the label column {label!r}")
        cols = self.getOrDefault("inputCols")
        table, prior = target_encoding_table(df, cols, label, self.getOrDefault("smoothing"),
                                             self.getOrDefault("minSamplesLeaf"), self.getOrDefault("mode"))
        # The fitted model owns a written copy of the (small, per-level) table: fitting is
        # one job, later transforms read files instead of re-running the aggregate.
        from abode.session import materialize
        table = materialize(table, "te-table")
        model = SmoothedTargetEncoderModel(table)
        self._copyValues(model)
        # the prior is a single number of model state (like a fitted mean), kept as a param
        model._set(prior=float(df.agg(F.avg(label)).first()[0]))
        return model

    def write(self):
        return _ParamsOnlyWriter(self)

    @classmethod
    def read(cls):
        return _ParamsOnlyReader(cls)


class SmoothedTargetEncoderModel(Model, _TEParams, MLReadable, MLWritable):
    """K2: applies the level table; unseen -> prior."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, df: DataFrame) -> DataFrame:
        prior = F.lit(self.getOrDefault("prior"))
        return apply_target_encoding(df, self.table, prior, self.getOrDefault("inputCols"),
                                     self.getOrDefault("outputSuffix"))

    def write(self):
        return _TEModelWriter(self)

    @classmethod
    def read(cls):
        return _TEModelReader(cls)


class _ParamsOnlyWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)


class _ParamsOnlyReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        inst = self.cls()
        DefaultParamsReader.getAndSetParams(inst, meta)
        return inst


class _TEModelWriter(_ParamsOnlyWriter):
    def saveImpl(self, path):
        super().saveImpl(path)
        self.instance.table.write.mode("overwrite").parquet(f"{path}/data")


class _TEModelReader(_ParamsOnlyReader):
    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        inst = self.cls(self.sparkSession.read.parquet(f"{path}/data"))
        DefaultParamsReader.getAndSetParams(inst, meta)
        return inst


def bool_code_stage(cols: Sequence[str], suffix: str = "_code") -> SQLTransformer:
    """D6 inside a pipeline: boolean -> 1/0, missing -> -1."""
    exprs = ", ".join(f"coalesce(CAST(TRY_CAST(`{c}` AS BOOLEAN) AS INT), -1) AS `{c}{suffix}`" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def null_level_stage(cols: Sequence[str], suffix: str = "_lvl") -> SQLTransformer:
    """Null becomes its own level before indexing (a null seen at fit is a category)."""
    exprs = ", ".join(f"coalesce(CAST(`{c}` AS STRING), '{NULL_LEVEL}') AS `{c}{suffix}`" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def one_hot_stages(cols: Sequence[str]) -> list:
    """K3: sorted levels, unseen -> all zeros."""
    lvl = [f"{c}_lvl" for c in cols]
    idx = [f"{c}_idx" for c in cols]
    ohe = [f"{c}_ohe" for c in cols]
    return [
        null_level_stage(cols),
        StringIndexer(inputCols=lvl, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # the indexer's "keep" bucket is the last category; dropLast removes exactly that slot
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
    ]


def feature_pipeline(cfg: dict, numeric_cols: Sequence[str], label: str = "label", te_mode: str = "sigmoid") -> Pipeline:
    """K4: boolean codes -> target encoding -> one-hot -> ``features`` vector (sparse)."""
    enc = cfg["encoding"]
    bools, te_cols, cats = enc["boolean_columns"], enc["target_encoder_cols"], enc["categorical_columns"]
    stages = [
        bool_code_stage(bools),
        SmoothedTargetEncoder(inputCols=te_cols, labelCol=label, smoothing=float(enc["target_encoder_smoothing"]),
                              mode=te_mode),
        *one_hot_stages(cats),
        VectorAssembler(inputCols=list(numeric_cols) + [f"{c}_te" for c in te_cols] + [f"{c}_code" for c in bools]
                        + [f"{c}_ohe" for c in cats], outputCol="features", handleInvalid="keep"),
    ]
    return Pipeline(stages=stages)


def feature_names(fitted, cfg: dict, numeric_cols: Sequence[str]) -> list[str]:
    """Names of the slots of ``features``, in order: numbers, target encodings, codes, then ``column=level``."""
    enc = cfg["encoding"]
    labels = next(s for s in fitted.stages if hasattr(s, "labelsArray")).labelsArray
    return ([*numeric_cols] + [f"{c}_te" for c in enc["target_encoder_cols"]] + [f"{c}_code" for c in enc["boolean_columns"]]
            + [f"{c}={level}" for c, levels in zip(enc["categorical_columns"], labels) for level in levels])


def features_long(df: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """K4 long form ``(key, feature, value)``: every slot of the assembled vector that is not 0."""
    from pyspark.ml.functions import vector_to_array
    slots = df.select(key, F.posexplode(vector_to_array("features")).alias("slot", "value")).where("value <> 0")
    return slots.select(key, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1).alias("feature"), "value")


def one_hot_long(df: DataFrame, fitted_indexers, cols: Sequence[str], key: str) -> DataFrame:
    """K3 long form ``(key, column_name, level)`` for each active one-hot slot."""
    from pyspark.ml.functions import vector_to_array
    parts = []
    for c in cols:
        labels = fitted_indexers[c]
        arr = vector_to_array(F.col(f"{c}_ohe"))
        pos = F.array_position(arr, 1.0)
        lvl = F.element_at(F.array(*[F.lit(x) for x in labels]), pos.cast("int"))
        parts.append(df.where(pos > 0).select(key, F.lit(c).alias("column_name"),
                                              F.when(lvl == NULL_LEVEL, F.lit(None)).otherwise(lvl).alias("level")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
