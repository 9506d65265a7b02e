"""Sale-price flow: feature preparation (P1) and the split dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.config import PRICE
from abode.functions import scalars as S
from abode.functions.bins import interval_bin
from abode.operators import projections as C


def add_building_age(df: DataFrame, cfg: dict, pre_1370_labels=(), out: str = "building_age") -> DataFrame:
    """Binned building age (age <= 0, null, unparsable -> 'unselect')."""
    ba = cfg["building_age"]
    edges = [0.0, *[float(b) for b in ba["bins"][1:]], float("inf")]
    age = S.building_age_years("construction_year", ba["reference_year"], pre_1370_labels)
    return df.withColumn(out, interval_bin(age, edges, ba["labels"], missing="unselect")).drop("construction_year")


def add_luxury_scores(df: DataFrame, cfg: dict) -> DataFrame:
    """D5 + D4 + D3: balcony tri-state fixed, flags summed and labelled, flags dropped."""
    lux, non = cfg["luxury_cols"], cfg["non_luxury_cols"]
    if "has_balcony" in df.columns:
        df = df.withColumn("has_balcony", S.tri_state_bool("has_balcony"))
    df = df.withColumns({
        cfg["luxury_name"]: S.luxury_label(S.flag_sum(lux)),
        cfg["non_luxury_name"]: S.luxury_label(S.flag_sum(non)),
    })
    return C.drop_existing(df, lux + non)


def prepare_price_features(df: DataFrame, cfg: dict = PRICE, pre_1370_labels=(), key: str = "listing_id") -> DataFrame:
    """Sale rows -> features -> category filters -> outlier bounds.

    Row filters are declared after the feature columns as in the source flow; Catalyst
    pushes the deterministic ones down to the scan anyway.
    """
    target = cfg["target_column"]
    o = cfg["outliers"]
    data = C.where_not_null(df, target)
    data = C.keep_existing(data, [key] + cfg["feature_columns"] + [target])
    data = add_building_age(data, cfg, pre_1370_labels)
    data = add_luxury_scores(data, cfg)
    data = data.withColumn("rooms_count", S.map_rooms_count("rooms_count"))
    data = C.where_in(data, "cat2_slug", cfg["sell_cat2_slugs"])
    data = C.fill_unselect(data, ["cat2_slug"])
    data = C.where_not_contains(data, "cat3_slug", "-rent")
    data = C.fill_unselect(data, ["cat3_slug", "deed_type", "floor_material"])
    data = C.drop_null_any(data, ["building_size", "city_slug"])
    return C.within_bounds(data, {
        "building_size": (o["building_size_min"], o["building_size_max"]),
        target: (o["price_value_min"], o["price_value_max"]),
    })


def price_per_m2_by_city_age(features: DataFrame) -> DataFrame:
    """Flagship report: listings and mean price per square metre by city and building age."""
    return (
        features.groupBy("city_slug", "building_age")
        .agg(
            F.count(F.lit(1)).alias("n_listings"),
            F.round(F.avg(F.col("price_value") / F.col("building_size")), 4).alias("avg_price_per_m2"),
        )
    )


def apply_floor_features(df: DataFrame, cfg: dict = PRICE, split: str = "split") -> DataFrame:
    """P2 floors: number (D7) -> negatives to 0 (D10) -> train mode (E2) -> int -> bins."""
    from abode.operators.impute import fill_modes

    df = df.withColumns({
        "floor": S.clamp_negative(S.to_number("floor")),
        "total_floors_count": S.clamp_negative(S.to_number("total_floors_count")),
    })
    df = fill_modes(df, ["floor", "total_floors_count"], df.where(F.col(split) == "train"))
    df = df.withColumns({
        "floor_cat": interval_bin("floor", cfg["floor_bins"], cfg["floor_labels"]),
        "total_floors_cat": interval_bin("total_floors_count", cfg["total_floors_bins"], cfg["total_floors_labels"]),
    })
    return df.drop("floor", "total_floors_count")


def prepare_price_dataset(df: DataFrame, cfg: dict = PRICE, exact: bool = False, key: str = "listing_id",
                          pre_1370_labels=(), materialize: bool = True) -> DataFrame:
    """P1 -> split (J1, or J3 with ``exact``) -> train rows need coordinates -> floors -> locations.

    Returns one frame with a ``split`` column (train/val); write it ``partitionBy("split")``.
    """
    from abode.operators.impute import fill_location
    from abode.operators.split import exact_two_way_split, two_way_split

    feats = prepare_price_features(df, cfg, pre_1370_labels, key)
    sp = cfg["split"]
    splitter = exact_two_way_split if exact else two_way_split
    data = splitter(feats, key, sp["test_size"], sp["random_state"])
    data = data.where((F.col("split") != "train")
                      | (F.col("location_latitude").isNotNull() & F.col("location_longitude").isNotNull()))
    if materialize:
        from abode.session import materialize as _write
        data = _write(data, "price-split", "split")
    data = apply_floor_features(data, cfg)
    return fill_location(data)


STATISTICS = ("floor_mode", "total_floors_mode", "lat_mean", "lon_mean")


def fit_price_statistics(train: DataFrame) -> dict:
    """Statistics the scoring path needs, fitted on the prepared train split.

    Returns four scalars (two floor modes, two coordinate means: single numbers pulled to
    the driver) and the per-city coordinate table (a DataFrame, joined lazily).
    """
    from abode.operators.impute import mode_value

    t = train.withColumns({
        "floor": S.clamp_negative(S.to_number("floor")),
        "total_floors_count": S.clamp_negative(S.to_number("total_floors_count")),
    })
    row = t.agg(F.avg("location_latitude").alias("lat"), F.avg("location_longitude").alias("lon")).first()
    modes = t.select(mode_value(t, "floor").alias("f"), mode_value(t, "total_floors_count").alias("tf")).limit(1).first()
    cities = (t.where(F.col("city_slug").isNotNull()).groupBy("city_slug")
              .agg(F.avg("location_latitude").alias("_cm_lat"), F.avg("location_longitude").alias("_cm_lon")))
    return {"floor_mode": modes["f"], "total_floors_mode": modes["tf"], "lat_mean": row["lat"],
            "lon_mean": row["lon"], "cities": cities}


def save_price_statistics(spark, stats: dict, path: str) -> None:
    """Write fitted statistics: one row of scalars and the table of cities."""
    row = tuple(None if stats[k] is None else float(stats[k]) for k in STATISTICS)
    spark.createDataFrame([row], ", ".join(f"{k} double" for k in STATISTICS)).coalesce(1).write.mode("overwrite").parquet(f"{path}/scalars")
    stats["cities"].write.mode("overwrite").parquet(f"{path}/cities")


def load_price_statistics(spark, path: str) -> dict:
    """Statistics that ``save_price_statistics`` wrote."""
    return spark.read.parquet(f"{path}/scalars").first().asDict() | {"cities": spark.read.parquet(f"{path}/cities")}


def apply_price_statistics(feats: DataFrame, stats: dict, cfg: dict = PRICE) -> DataFrame:
    """Scoring-path preparation of P1 features with fitted train statistics (works on streams:
    literals plus a stream-static left join on the city table)."""
    df = feats.withColumns({
        "floor": F.coalesce(S.clamp_negative(S.to_number("floor")), F.lit(stats["floor_mode"])).cast("int"),
        "total_floors_count": F.coalesce(S.clamp_negative(S.to_number("total_floors_count")),
                                         F.lit(stats["total_floors_mode"])).cast("int"),
    })
    df = df.withColumns({
        "floor_cat": interval_bin("floor", cfg["floor_bins"], cfg["floor_labels"]),
        "total_floors_cat": interval_bin("total_floors_count", cfg["total_floors_bins"], cfg["total_floors_labels"]),
    }).drop("floor", "total_floors_count")
    df = df.join(stats["cities"], "city_slug", "left")
    df = df.withColumns({
        "location_latitude": F.coalesce("location_latitude", "_cm_lat", F.lit(stats["lat_mean"])),
        "location_longitude": F.coalesce("location_longitude", "_cm_lon", F.lit(stats["lon_mean"])),
    })
    return df.drop("_cm_lat", "_cm_lon")
