"""Explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

RULE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("conditions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("discount_tiers", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("combo_codes", T.ArrayType(T.StringType())),
    T.StructField("related_pages", T.ArrayType(T.IntegerType())),
])

ALERT = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("original_value", T.StringType()),
    T.StructField("corrected_value", T.StringType()),
])

DOCUMENT_PRODUCT = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("product_line", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("normalized_category", T.StringType()),
    T.StructField("volume_weight", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("regular_price", T.DoubleType()),
    T.StructField("promotional_price", T.DoubleType()),
    T.StructField("savings", T.DoubleType()),
    T.StructField("discount_percentage", T.DoubleType()),
    T.StructField("promotion_active", T.BooleanType()),
    T.StructField("promotional_rule", RULE),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("page", T.IntegerType()),
    T.StructField("quadrant", T.StringType()),
    T.StructField("alerts", T.ArrayType(ALERT)),
])

METADATA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("cycle", T.StringType()),
    T.StructField("validity_start", T.DateType()),
    T.StructField("validity_end", T.DateType()),
    T.StructField("total_pages", T.IntegerType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("pages_processed", T.IntegerType()),
    T.StructField("pages_with_errors", T.ArrayType(T.IntegerType())),
    T.StructField("exported_at", T.TimestampType()),
])

STATISTICS = T.StructType([
    T.StructField("total_products", T.LongType()),
    T.StructField("products_with_promotion", T.LongType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("product_lines", T.ArrayType(T.StringType())),
])

DOCUMENT = T.StructType([
    T.StructField("metadata", METADATA),
    T.StructField("global_promotional_rules", T.ArrayType(RULE)),
    T.StructField("products", T.ArrayType(DOCUMENT_PRODUCT)),
    T.StructField("statistics", STATISTICS),
])

PAGE_RESPONSE = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("page_number", T.LongType()),
    T.StructField("raw_response", T.StringType()),
])
