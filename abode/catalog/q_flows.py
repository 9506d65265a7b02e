"""Flow-level queries (group P) over the derived listing view."""

from __future__ import annotations

from abode.catalog import register
from abode.catalog.sqltext import price_features_sql, with_listings
from abode.config import PRE_1370_LABEL
from abode.plans.price import prepare_price_features, price_per_m2_by_city_age
from abode.sources.listing_view import listing_view


@register("p0_price_per_m2_by_city_age", with_listings(f"""
SELECT city_slug, building_age, CAST(count(*) AS BIGINT) AS n_listings,
       round(avg(price_value / building_size), 4) AS avg_price_per_m2
FROM ({price_features_sql()}) f
GROUP BY city_slug, building_age"""))
def p0_price_per_m2_by_city_age(spark, sf_dir):
    return price_per_m2_by_city_age(prepare_price_features(listing_view(spark, sf_dir)))


@register("p1_price_features", with_listings(price_features_sql()))
def p1_price_features(spark, sf_dir):
    return prepare_price_features(listing_view(spark, sf_dir))


@register("p1_price_features_documented_pre1370", with_listings(price_features_sql(pre_labels=[PRE_1370_LABEL])))
def p1_price_features_documented(spark, sf_dir):
    return prepare_price_features(listing_view(spark, sf_dir), pre_1370_labels=[PRE_1370_LABEL])
