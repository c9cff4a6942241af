"""product features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRODUCT_FEATURES = ["product_id", "product_category_name", "product_vol_cm3",
                    "product_weight_kg", "product_photos_qty"]


def product_features(products: DataFrame) -> DataFrame:
    """Volume = round(L * H * W, 2) cm3, weight in kg, keep id, category, photos."""
    return products.select(
        "product_id",
        "product_category_name",
        F.round(F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"), 2)
         .alias("product_vol_cm3"),
        (F.col("product_weight_g") / 1000).alias("product_weight_kg"),
        "product_photos_qty",
    )
