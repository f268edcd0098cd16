"""Row-by-row reshaping: rename, sanitise, features, flattening, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vitrine import constants as K
from vitrine.functions import numbers as N, text as X


def rename_columns(df: DataFrame, mapping: dict[str, str] = K.DOCUMENT_TO_ANALYSIS) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def flatten_rule(df: DataFrame, rule: str = "regra_promocional") -> DataFrame:
    """Promotional rule struct to the columns promo_type, promo_description, discount_tiers, combo_codes."""
    r = F.col(rule)
    return df.withColumns({
        "promo_type": F.coalesce(r["type"], F.lit("none")),
        "promo_description": F.coalesce(r["description"], F.lit("")),
        "discount_tiers": F.coalesce(
            r["discount_tiers"], F.create_map().cast("map<string,double>")
        ),
        "combo_codes": F.coalesce(r["combo_codes"], F.array().cast("array<string>")),
    })


def flatten_alerts(df: DataFrame, alerts: str = "alertas") -> DataFrame:
    """Alert list to the columns alert_count, has_errors, has_warnings."""
    a = F.col(alerts)
    level = lambda name: F.coalesce(F.exists(a, lambda x: x["level"] == name), F.lit(False))
    return df.withColumns({
        "alert_count": F.coalesce(F.size(a), F.lit(0)),
        "has_errors": level("error"),
        "has_warnings": level("warning"),
    })


def sanitize_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("codigo", F.when(~F.col("codigo").isin(K.NULL_CODES), F.col("codigo")))


def sanitize_promo_price(df: DataFrame) -> DataFrame:
    p = F.col("preco_promocional")
    return df.withColumn("preco_promocional", F.nullif(p, F.lit(0).cast(df.schema["preco_promocional"].dataType)))


def coerce_numbers(df: DataFrame, cols: list[str] = K.NUMERIC_COLUMNS) -> DataFrame:
    """Numbers from text; what is no number becomes null."""
    def number(c: str) -> Column:
        if df.schema[c].dataType.typeName() != "string":
            return F.col(c).try_cast("double")
        return F.when(X.strip(F.col(c)).rlike(N.NUMBER), F.col(c).try_cast("double"))  # no NaN, no `1.5d`

    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def sanitize_text(df: DataFrame, cols: list[str] = K.TEXT_COLUMNS) -> DataFrame:
    """Null-like text becomes null, then the rest is trimmed, in this order."""
    return df.withColumns({
        c: X.strip(F.when(~F.col(c).isin(K.NULL_TEXTS), F.col(c))) for c in cols if c in df.columns
    })


def default_flags_and_lists(df: DataFrame) -> DataFrame:
    """Missing flag becomes false, a missing list becomes empty."""
    out = {}
    if "promocao_ativa" in df.columns:
        out["promocao_ativa"] = F.coalesce(F.col("promocao_ativa"), F.lit(False))
    for c in ("caracteristicas", "alertas"):
        if c in df.columns:
            out[c] = F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    return df.withColumns(out)


def sanitize(df: DataFrame) -> DataFrame:
    """All clean-up steps in order; one projection after Catalyst collapses them."""
    df = sanitize_codes(df) if "codigo" in df.columns else df
    df = sanitize_promo_price(df) if "preco_promocional" in df.columns else df
    return default_flags_and_lists(coerce_numbers(sanitize_text(df)))


def sanitize_report(df: DataFrame) -> DataFrame:
    """How many codes and prices ``sanitize`` nulls; a line only where the count is above zero."""
    counts = df.agg(
        F.count_if(F.col("codigo").isin(K.NULL_CODES)).alias("invalid_codes_fixed"),
        F.count_if(F.col("preco_promocional") == 0).alias("zero_promo_prices_fixed"),
    )
    return counts.unpivot(
        [], ["invalid_codes_fixed", "zero_promo_prices_fixed"], "fix", "fixed_count"
    ).where("fixed_count > 0")


def add_volume(df: DataFrame) -> DataFrame:
    """Number and unit of the volume text."""
    volume = X.parse_volume(F.col("volume_peso"))
    return df.withColumns({"volume_numeric": volume["number"], "volume_unit": volume["unit"]})


def add_price_features(df: DataFrame) -> DataFrame:
    """Unit price, effective discount, tier, feature count of rows with their volume."""
    return df.withColumns({
        "price_per_unit": N.price_per_unit(F.col("preco_regular"), F.col("volume_numeric")),
        "desconto_calculado": N.effective_discount(
            F.col("preco_promocional"), F.col("preco_regular"), F.col("desconto_percentual")
        ),
        "price_tier": N.price_tier(F.col("preco_regular")),
        "features_count": N.features_count(F.col("caracteristicas")),
    })


def add_features(df: DataFrame) -> DataFrame:
    """Derived columns: volume, unit price, effective discount, tier, feature count."""
    return add_price_features(add_volume(df))


def display_frame(df: DataFrame, placeholder: str = K.PLACEHOLDER) -> DataFrame:
    """Readable version: text nulls become the placeholder, lists and maps become text."""
    out = {
        c: F.coalesce(F.col(c), F.lit(placeholder))
        for c in K.DISPLAY_TEXT_COLUMNS if c in df.columns
    }
    for c in ("caracteristicas", "alertas", "combo_codes", "discount_tiers"):
        if c not in df.columns:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.MapType):
            shown = F.to_json(c)
        elif isinstance(kind.elementType, T.StringType):
            shown = F.array_join(c, "; ")
        elif isinstance(kind.elementType, T.StructType):
            shown = F.array_join(F.transform(c, lambda x: F.to_json(x)), "; ")
        else:
            shown = F.array_join(F.col(c).cast("array<string>"), "; ")
        out[c] = F.when(F.size(c) > 0, shown).otherwise(F.lit(placeholder))
    return df.withColumns(out)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def transpose(df: DataFrame, index: str, labels: list[str], cast: str = "double") -> DataFrame:
    """Swap rows and columns of a small aggregate table whose row labels are known."""
    cols = [c for c in df.columns if c != index]
    long = df.select(index, *[F.col(c).cast(cast).alias(c) for c in cols]).unpivot(
        [index], cols, "measure", "value"
    )
    return long.groupBy("measure").pivot(index, labels).agg(F.first("value"))


def preview(df: DataFrame, keys: list, n: int) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*keys).limit(n)


def union_catalogs(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
