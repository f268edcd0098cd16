"""Scalar functions: the semantics that are easy to get wrong, one row each."""

import pytest
from pyspark.sql import functions as F

from vitrine import constants as K
from vitrine.functions import numbers as N, text as X
from vitrine.functions.similarity import weighted_ratio


def evaluate(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_price_text(spark):
    values = ["R$ 1.234,56", "55.90", "abc", None, "", "1,5d", "-3,20", "R$ 0,99"]
    assert evaluate(spark, values, "string", lambda c: N.parse_price(c)) == [1234.56, 5590.0, None, None, None, None, -3.2, 0.99]
    assert evaluate(spark, values[2:4], "string", lambda c: N.parse_price(c, 0.0)) == [0.0, 0.0]


def test_code(spark):
    values = ["123", " 85675\n", "123456", "A12", "", None]
    assert evaluate(spark, values, "string", X.norm_code) == ["00123", "85675", "123456", "A12", "", None]


def test_volume(spark):
    values = ["200ml", "2x100ml", "1,5l", "0,5 l", "1 colonia", "400 g", "2kg", "4 unidades de 80 g cada", "3un", "", None, "  ", "0l", "kit"]
    got = evaluate(spark, values, "string", X.parse_volume)
    assert [(r["number"], r["unit"]) for r in got] == [
        (200.0, "ml"), (200.0, "ml"), (1000.0, "ml"), (None, "ml"), (1000.0, "ml"), (400.0, "g"), (2000.0, "g"),
        (4.0, "g"), (3.0, "un"), (None, None), (None, None), (None, "un"), (None, "ml"), (None, "un")]


def test_bins_are_closed_on_the_right(spark):
    prices = [0.0, 30.0, 30.01, 60.0, 100.0, 200.0, 200.01, None]
    assert evaluate(spark, prices, "double", N.price_tier) == [
        None, "Budget", "Economy", "Economy", "Standard", "Premium", "Luxury", None]
    discounts = [-0.1, -0.05, 0.0, 10.0, 10.5, 50.0, 50.1, 100.0, 100.5]
    assert evaluate(spark, discounts, "double", N.discount_range) == [
        None, "No Discount", "No Discount", "1-10%", "11-20%", "41-50%", "50%+", "50%+", None]
    assert evaluate(spark, [49.99, 50.0, 100.0, 200.0], "double", N.cluster_name) == ["Budget", "Economy", "Premium", "Luxury"]


def test_currency_and_percentages(spark):
    assert evaluate(spark, [1234.56, 0.5, 1234567.0], "double", N.format_brl) == ["R$ 1.234,56", "R$ 0,50", "R$ 1.234.567,00"]
    assert evaluate(spark, [0.0, 4.0], "double", lambda c: N.safe_percentage(F.lit(1.0), c)) == [0.0, 25.0]
    got = evaluate(spark, [None, 0.0, 55.9, 80.0], "double", lambda c: N.discount_pct(c, F.lit(69.9)))
    assert got == [None, None, 20.03, -14.45]


def test_file_names(spark):
    names = ["O_Boticário_Ciclo_05_x.json", "natura_c3.json", "other.json"]
    assert evaluate(spark, names, "string", X.cycle_of) == [5, None, None]
    assert evaluate(spark, names, "string", lambda c: X.detect_brand(c, K.BRAND_KEYS, K.BRAND_KEY_DEFAULT)) == ["boticario", "natura", "natura"]
    assert evaluate(spark, names, "string", lambda c: X.detect_brand(c, K.BRAND_PATTERNS, K.BRAND_DEFAULT, fold=False)) == [
        "O Boticário", "Natura", "Unknown"]
    assert evaluate(spark, ["Marca / Ciclo 03"], "string", X.safe_name) == ["marca_-_ciclo_03"]


@pytest.mark.parametrize("raw, want", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```{"a": 1}```', '{"a": 1}'), ('  {"a": 1} \n', '{"a": 1}'), ("```json\n```", "")])
def test_fence(spark, raw, want):
    assert evaluate(spark, [raw], "string", X.strip_fence) == [want]


def test_text_and_labels(spark):
    assert evaluate(spark, ["Água-de-Rosas, 50%!", None], "string", X.clean_text) == ["águaderosas 50", ""]
    assert evaluate(spark, ["Loção Rosa e Mel", "Mel puro", "nada"], "string",
                    lambda c: X.label_by_keywords(c, K.SCENT_FAMILIES, K.SCENT_DEFAULT)) == ["floral", "gourmand", "other"]
    assert evaluate(spark, ["Simple Discount", "combo", "BOGUS", None], "string", X.norm_promo_type) == [
        "simple_discount", "combo", "none", "none"]


def test_weighted_ratio():
    assert weighted_ratio("Produtos para Cabelo", "cabelo") == 90
    assert weighted_ratio("perfumaria", "Perfumaria") == 100
    assert weighted_ratio("perfumari", "Perfumaria") == 95
    assert weighted_ratio("", "x") == 0
