"""Validation rules and auto-correction as column expressions.

A rule is an expression giving an alert struct or null. ``validate`` puts all of them into one
projection. Deliberate deviations: the price swap succeeds and leaves savings non-negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import constants as K
from vitrine.functions.numbers import rounded
from vitrine.functions.text import strip
from vitrine.operators.categories import normalize_categories
from vitrine.schema import ALERT

#: Rows with their alerts that one task sorts by code, and values of the hash by which codes are counted.
TASK_ROWS = 250_000
HASHES = 1 << 16

_NAME_UNUSUAL = r"(?U)[^\w\s" + K.NAME_EXTRA_CHARACTERS + "]"


def _text(key: str, *args: Column) -> Column:
    template = K.ALERT_TEXTS[key]
    return F.format_string(template, *args) if args else F.lit(template)


def _alert(when: Column, level: str, field: str, message: Column, original=None, corrected=None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(
        F.lit(level).alias("level"), F.lit(field).alias("field"), message.alias("message"),
        (none if original is None else original.cast("string")).alias("original_value"),
        (none if corrected is None else corrected.cast("string")).alias("corrected_value"),
    ))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _filled(c: Column) -> Column:
    """Present and not zero."""
    return _true(c != 0)


def rule_code() -> list[Column]:
    c = F.col("codigo")
    given = _true(c != "")
    return [
        _alert(~given, "error", "codigo", _text("code_missing")),
        _alert(given & ~c.rlike("^[0-9]+$"), "warning", "codigo", _text("code_non_numeric", c), c),
        F.coalesce(
            _alert(given & (F.length(c) < K.MIN_CODE_LENGTH), "warning", "codigo", _text("code_short", c), c),
            _alert(given & (F.length(c) > K.MAX_CODE_LENGTH), "warning", "codigo", _text("code_long", c), c),
        ),
    ]


def rule_name() -> list[Column]:
    c = F.col("nome")
    short = _true(F.length(strip(c)) < K.MIN_NAME_LENGTH) | c.isNull()
    return [
        _alert(short, "error", "nome", _text("name_short"), c),
        _alert(~short & c.rlike(_NAME_UNUSUAL), "info", "nome", _text("name_unusual"), c),
    ]


def rule_regular() -> list[Column]:
    r = F.col("preco_regular")
    return [F.coalesce(
        _alert(r <= 0, "error", "preco_regular", _text("price_zero"), r),
        _alert(r > K.MAX_PRICE, "warning", "preco_regular", _text("price_high", r.cast("string")), r),
    )]


def rule_promo() -> list[Column]:
    r, p = F.col("preco_regular"), F.col("preco_promocional")
    field = "preco_promocional"
    return [F.coalesce(
        _alert(p <= 0, "warning", field, _text("promo_zero"), p),
        _alert(p > r, "error", field, _text("promo_above", p.cast("string"), r.cast("string")), p),
        _alert(p == r, "info", field, _text("promo_equal"), p),
    )]


def rule_discount() -> list[Column]:
    r, p = F.col("preco_regular"), F.col("preco_promocional")
    pct = (1 - p / F.nullif(r, F.lit(0.0))) * 100
    high = (r > 0) & (p > 0) & (pct > K.MAX_DISCOUNT_PCT)
    shown = F.format_string("%.1f", pct)
    return [_alert(high, "warning", "preco_promocional", _text("discount_high", shown), p)]


def rule_savings() -> list[Column]:
    r, p, s = F.col("preco_regular"), F.col("preco_promocional"), F.col("economia")
    want = rounded(r - p)
    off = _filled(s) & _filled(p) & _filled(r) & (F.abs(s - want) > K.SAVINGS_TOLERANCE)
    text = _text("savings_differ", want.cast("string"), s.cast("string"))
    return [_alert(off, "warning", "economia", text, s, want)]


def rule_category(match: Column) -> list[Column]:
    """``match`` is what the normaliser says about a raw category that has no normalised one."""
    c = F.col("categoria")
    lost = _true(c != "") & ~_true(F.col("categoria_normalizada") != "") & (match == K.UNMAPPED)
    return [_alert(lost, "info", "categoria", _text("category_unmapped", c), c, F.lit(K.UNMAPPED))]


def rule_volume() -> list[Column]:
    c = F.col("volume_peso")
    unknown = (c != "") & ~F.lower(c).rlike(K.VOLUME_PATTERN)
    return [_alert(unknown, "info", "volume_peso", _text("volume_unknown", c), c)]


def rule_flag() -> list[Column]:
    r, p = F.col("preco_regular"), F.col("preco_promocional")
    missing = _filled(p) & (p < r) & ~_true(F.col("promocao_ativa"))
    return [_alert(missing, "info", "promocao_ativa", _text("flag_missing"), F.lit("false"), F.lit("true"))]


def rule_promo_rule() -> list[Column]:
    rule = F.col("regra_promocional")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return [F.coalesce(
        _alert((rule["type"] == "progressive_discount") & empty(rule["discount_tiers"]),
               "warning", "regra_promocional", _text("tiers_missing")),
        _alert((rule["type"] == "combo") & empty(rule["combo_codes"]),
               "warning", "regra_promocional", _text("combo_missing")),
    )]


def all_rules(match: Column) -> list[Column]:
    return (
        rule_code() + rule_name() + rule_regular() + rule_promo() + rule_discount() + rule_savings()
        + rule_category(match) + rule_volume() + rule_flag() + rule_promo_rule()
    )


def alerts_of(rules: list[Column]) -> Column:
    return F.filter(F.array(*rules), lambda a: a.isNotNull()).cast(f"array<{ALERT.simpleString()}>")


def validate(df: DataFrame, dim: DataFrame | None = None, out: str = "alertas") -> DataFrame:
    """Alert list of every row.

    With a category dimension, a raw category that has no normalised one is looked up first.
    """
    match = F.lit(None).cast("string")
    if dim is not None:
        df = normalize_categories(df, "categoria", dim, "_match")
        match = F.col("_match")
    return df.withColumn(out, alerts_of(all_rules(match))).drop("_match")


def duplicate_alerts(df: DataFrame, key: str = "codigo") -> DataFrame:
    """One warning per code that occurs more than once."""
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    c = F.col(key)
    return repeated.select(key, _alert(
        F.lit(True), "warning", "codigo", _text("code_duplicate", c), c).alias("alert"))


def _by_code(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """``aggs`` for each code (``by``), whose buffers are wide and so are sorted, not hashed.

    Rows are dealt to as many tasks as their number asks for. Codes are counted by hash first: those that may be
    too large for one task go through partial results instead, which leave one row of a code a task.
    """
    hashed = F.pmod(F.xxhash64(*by), F.lit(HASHES)).cast("int")
    sizes = {r["_hash"]: r["count"] for r in df.groupBy(hashed.alias("_hash")).count().collect()}  # HASHES rows at most
    few = lambda part: part.repartition(max(1, -(-sum(sizes.values()) // TASK_ROWS)), *by).groupBy(*by).agg(*aggs)
    large = [h for h, n in sizes.items() if n > TASK_ROWS]
    if not large:
        return few(df)
    return few(df.where(~hashed.isin(large))).unionByName(df.where(hashed.isin(large)).groupBy(*by).agg(*aggs))


def validate_batch(df: DataFrame, order: list[str], key: str = "codigo", alerts: str = "alertas") -> DataFrame:
    """Alerts per code: the last row (by ``order``) that has any wins, then the duplicate warning."""
    has = F.size(alerts) > 0
    c = F.col(key)
    per_code = _by_code(
        df.where(c.isNotNull()).select(key, *(x for x in order if x != key), alerts), [key],
        F.max_by(F.when(has, F.col(alerts)), F.when(has, F.struct(*order))).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    double = _alert(F.col("_n") > 1, "warning", "codigo", _text("code_duplicate", c), c)
    none = F.array().cast(f"array<{ALERT.simpleString()}>")
    found = F.concat(F.coalesce("_last", none), F.filter(F.array(double), lambda a: a.isNotNull()))
    return per_code.select(key, found.alias("alerts")).where(F.size("alerts") > 0)


def auto_correct(df: DataFrame, dim: DataFrame | None = None, alerts: str = "alertas") -> DataFrame:
    """Fill category, flag and savings and swap inverted prices, all read from the original row."""
    r, p, s = F.col("preco_regular"), F.col("preco_promocional"), F.col("economia")
    given = _filled(p)
    swap = given & (p > r)
    changes = {
        "promocao_ativa": _true(F.col("promocao_ativa")) | (given & (p < r)),
        "economia": F.when(given & _filled(r) & ~_filled(s), rounded(F.abs(r - p))).otherwise(s),
        "preco_regular": F.when(swap, p).otherwise(r),
        "preco_promocional": F.when(swap, r).otherwise(p),
    }
    swapped = _alert(swap, "warning", "preco_regular", _text("prices_swapped"), r, p)
    if dim is not None:
        df = normalize_categories(df, "categoria", dim, "_match")
        fill = _true(F.col("categoria") != "") & ~_true(F.col("categoria_normalizada") != "")
        changes["categoria_normalizada"] = F.when(fill, F.col("_match")).otherwise(F.col("categoria_normalizada"))
    old = F.col(alerts) if alerts in df.columns else F.array()
    old = F.coalesce(old.cast(f"array<{ALERT.simpleString()}>"), F.array().cast(f"array<{ALERT.simpleString()}>"))
    changes[alerts] = F.concat(old, F.filter(F.array(swapped), lambda a: a.isNotNull()))
    return df.withColumns(changes).drop("_match")


def process_products(df: DataFrame, dim: DataFrame, threshold: int = K.FUZZY_THRESHOLD, scorer: str = "weighted") -> DataFrame:
    """Normalise, correct, validate; the new alerts follow the ones already there."""
    df = normalize_categories(df, "categoria", dim, "categoria_normalizada", threshold, scorer)
    fixed = auto_correct(df)
    checked = validate(fixed, out="_new")
    return checked.withColumn("alertas", F.concat("alertas", "_new")).drop("_new")


def summary(batch: DataFrame) -> DataFrame:
    """Codes with issues and alerts by level, from the output of ``validate_batch``."""
    level = lambda name: F.sum(F.size(F.filter("alerts", lambda a: a["level"] == name)).cast("long"))
    return batch.agg(
        F.count(F.lit(1)).alias("products_with_issues"),
        F.coalesce(F.sum(F.size("alerts").cast("long")), F.lit(0)).alias("total_alerts"),
        F.coalesce(level("error"), F.lit(0)).alias("errors"),
        F.coalesce(level("warning"), F.lit(0)).alias("warnings"),
        F.coalesce(level("info"), F.lit(0)).alias("info"),
    )


def summary_by_field(batch: DataFrame) -> DataFrame:
    return batch.select(F.explode("alerts").alias("a")).groupBy(F.col("a.field").alias("field")).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.desc("count"), "field")


def report(df: DataFrame, order: list[str], catalog: str = "source_file", alerts: str = "alertas") -> tuple[DataFrame, DataFrame]:
    """Per catalogue: a summary row each, and the details, one row per code with issues."""
    has = F.size(alerts) > 0
    c = F.col("codigo")
    per_code = _by_code(
        df.where(c.isNotNull()).select(catalog, "codigo", *(x for x in order if x not in (catalog, "codigo")), alerts), [catalog, "codigo"],
        F.max_by(F.when(has, F.col(alerts)), F.when(has, F.struct(*order))).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    double = _alert(F.col("_n") > 1, "warning", "codigo", _text("code_duplicate", c), c)
    none = F.array().cast(f"array<{ALERT.simpleString()}>")
    all_codes = per_code.select(catalog, "codigo", "_n", F.concat(
        F.coalesce("_last", none), F.filter(F.array(double), lambda a: a.isNotNull())).alias("alerts"))
    level = lambda name: F.sum(F.size(F.filter("alerts", lambda a: a["level"] == name)).cast("long"))
    head = all_codes.groupBy(catalog).agg(
        F.sum("_n").alias("total_products"),
        F.count_if(F.size("alerts") > 0).alias("products_with_issues"),
        F.sum(F.size("alerts").cast("long")).alias("total_alerts"),
        level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("info"),
    )
    return head, all_codes.where(F.size("alerts") > 0).drop("_n")
