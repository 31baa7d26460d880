"""Column names and types of the shared tables."""
from pyspark.sql import DataFrame, functions as F

BAG = {
    "id": "string", "slug": "string", "brand": "string", "brand_slug": "string",
    "name": "string", "category": "string", "category_source": "string", "url": "string",
    "image": "string", "volume_l": "double", "volume_source": "string",
    "dims_cm": "array<double>", "dims_source": "string", "linear_cm": "double",
    "weight_g": "int", "weight_source": "string", "laptop_in": "double",
    "price_min": "double", "price_max": "double", "price_usd_approx": "double",
    "currency": "string", "currency_source": "string", "price_market": "string",
    "on_sale": "boolean", "in_stock": "boolean", "colors": "array<string>",
    "color_families": "array<string>", "sizes": "array<string>",
    "materials": "array<string>", "features": "array<string>",
    "features_source": "string", "tags": "array<string>", "variant_count": "int",
    "merged_from": "int", "split_from": "string", "legacy_slug": "string",
    "source": "string", "fetched_at": "timestamp", "updated_at": "string",
    "gtin": "string", "product_type": "string", "ord": "bigint",
}
VARIANT = {
    "bag_id": "string", "pos": "bigint", "sku": "string", "variant_id": "bigint",
    "title": "string", "options": "map<string,string>", "color": "string",
    "color_family": "string", "size": "string", "price": "double", "compare_at": "double",
    "available": "boolean", "grams": "int", "barcode": "string", "image": "string",
}
LEDGER = ("ts timestamp_ntz, bag_id string, brand string, name string, sku string, "
          "color string, price double, compare_at double, available boolean, basis string, "
          "rebased boolean, prev_price double, delta double, direction string")
STATE = {
    "key": "string", "price": "double", "compare_at": "double", "available": "boolean",
    "basis": "string", "first_seen": "timestamp_ntz", "low": "double",
    "last_change": "timestamp_ntz",
}


def conform(df: DataFrame, schema: dict) -> DataFrame:
    """Project to a schema; a column the table does not have is null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
