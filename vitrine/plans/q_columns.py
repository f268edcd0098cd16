"""Projections, filters and scalar functions (P, F)."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from vitrine import constants as K
from vitrine.functions import numbers as N, text as X
from vitrine.operators import filters as FI, projections as P, stats as S
from vitrine.plans.products import BRANDS, base, featured, on_features, on_products, products
from vitrine.plans.registry import query, rnd, table

KEY = ["pagina", "pos"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("p01_rename", on_products("SELECT pagina AS page, codigo AS code, nome AS name, brand FROM p"))
def p01(spark, d):
    back = {v: k for k, v in K.DOCUMENT_TO_ANALYSIS.items()}
    return P.rename_columns(products(spark, d).select("pagina", "codigo", "nome", "brand"), back)


@query("p02_code", on_products("SELECT pagina, pos, codigo FROM p"))
def p02(spark, d):
    return products(spark, d).select(*KEY, X.norm_code(F.concat(F.lit(" "), "codigo_raw", F.lit("\n"))).alias("codigo"))


PRICE_SQL = ("TRY_CAST(replace(replace(replace(replace(preco_text, 'R$', ''), ' ', ''), '.', ''), ',', '.') AS DOUBLE)")


@query("p03_regular_price", on_products(f"SELECT pagina, pos, COALESCE({PRICE_SQL}, 0.0) AS price FROM p"))
def p03(spark, d):
    return products(spark, d).select(*KEY, N.parse_price(F.col("preco_text"), 0.0).alias("price"))


@query("p04_promo_price", on_products(f"SELECT pagina, pos, {PRICE_SQL} AS price FROM p"))
def p04(spark, d):
    return products(spark, d).select(*KEY, N.parse_price(F.col("preco_text")).alias("price"))


@query("p05_discount_pct", on_products("SELECT pagina, pos, desconto_percentual AS discount FROM p"))
def p05(spark, d):
    return products(spark, d).select(
        *KEY, N.discount_pct(F.col("preco_promocional"), F.col("preco_regular")).alias("discount"))


@query("p06_effective_discount", on_features(f"SELECT pagina, pos, {rnd('desconto_calculado', 4)} AS discount FROM f"))
def p06(spark, d):
    return featured(spark, d).select(*KEY, N.rounded(F.col("desconto_calculado"), 4).alias("discount"))


@query("p07_unit_price", on_features(f"SELECT pagina, pos, {rnd('price_per_unit', 4)} AS unit_price FROM f"))
def p07(spark, d):
    return featured(spark, d).select(*KEY, N.rounded(F.col("price_per_unit"), 4).alias("unit_price"))


@query("p08_price_tier", on_features("SELECT pagina, pos, price_tier FROM f"))
def p08(spark, d):
    return featured(spark, d).select(*KEY, "price_tier")


@query("p09_discount_range", on_features("""SELECT pagina, pos, CASE WHEN desconto_calculado <= -0.1 THEN NULL
  WHEN desconto_calculado <= 0 THEN 'No Discount' WHEN desconto_calculado <= 10 THEN '1-10%'
  WHEN desconto_calculado <= 20 THEN '11-20%' WHEN desconto_calculado <= 30 THEN '21-30%'
  WHEN desconto_calculado <= 40 THEN '31-40%' WHEN desconto_calculado <= 50 THEN '41-50%'
  WHEN desconto_calculado <= 100 THEN '50%+' END AS discount_range FROM f"""))
def p09(spark, d):
    return featured(spark, d).select(*KEY, N.discount_range(F.col("desconto_calculado")).alias("discount_range"))


@query("p10_features_count", on_features("SELECT pagina, pos, features_count FROM f"))
def p10(spark, d):
    return featured(spark, d).select(*KEY, "features_count")


def ruled(spark, d):
    """Products with the promotional rule as one struct; no rule where the type is none."""
    return products(spark, d).select(*KEY, "codigo", "brand", F.when(F.col("promo_type") != "none", F.struct(
        F.col("promo_type").alias("type"), F.lit(None).cast("string").alias("description"),
        "discount_tiers", "combo_codes")).alias("regra_promocional"))


@query("p11_flatten_rule", on_products("""SELECT pagina, pos, promo_type, '' AS promo_description,
  len(tier_values) AS tiers, array_to_string(combo_codes, ';') AS combos FROM p"""))
def p11(spark, d):
    out = P.flatten_rule(ruled(spark, d))
    return out.select(*KEY, "promo_type", "promo_description", F.size("discount_tiers").cast("long").alias("tiers"),
                      F.array_join("combo_codes", ";").alias("combos"))


@query("p13_invalid_codes", on_products("""SELECT pagina, pos, CASE WHEN t = 0 THEN NULL ELSE codigo END AS codigo FROM p"""))
def p13(spark, d):
    raw = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("pagina"),
        F.expr("(l_linenumber * 1000000000L + l_partkey) * 100000000L + l_suppkey").alias("pos"),
        F.expr("cast(floor(l_tax * 100 + 0.5) as int)").alias("t"),
        X.norm_code(F.col("l_partkey").cast("string")).alias("codigo"))
    bad = F.when(F.col("t") != 0, F.col("codigo")).when(F.col("pos") % 2 == 0, "None").otherwise("")
    return P.sanitize_codes(raw.withColumn("codigo", bad)).select(*KEY, "codigo")


@query("p14_zero_promo_price", on_products("""SELECT pagina, pos, CASE WHEN promocao_ativa THEN preco_promocional END AS preco_promocional FROM p"""))
def p14(spark, d):
    df = products(spark, d).withColumn(
        "preco_promocional", F.when(F.col("promocao_ativa"), F.col("preco_promocional")).otherwise(0.0))
    return P.sanitize_promo_price(df).select(*KEY, "preco_promocional")


@query("p15_coerce_numbers", on_products("""SELECT pagina, pos, CASE WHEN preco_text = 'n/a' OR pagina % 50 IN (7, 9) THEN NULL
  ELSE preco_regular END AS preco_regular, economia FROM p"""))
def p15(spark, d):
    df = products(spark, d).select(
        *KEY, F.when(F.col("preco_text") == "n/a", "n/a").when(F.col("pagina") % 50 == 7, "NaN").when(F.col("pagina") % 50 == 9, "1.5d").otherwise(F.col("preco_regular").cast("string")).alias("preco_regular"),
        F.coalesce(F.col("economia").cast("string"), F.lit("?")).alias("economia"))
    return P.coerce_numbers(df, ["preco_regular", "economia"])


@query("p16_clean_text", on_products("""SELECT pagina, pos, CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN nome
  ELSE 'None' END AS nome, volume_peso FROM p"""))
def p16(spark, d):
    m = F.col("pos") % 3
    df = products(spark, d).select(
        *KEY, F.when(m == 0, "NULL").when(m == 1, F.concat(F.lit("\t"), "nome", F.lit(" "))).otherwise(" None ").alias("nome"),
        F.coalesce("volume_peso", F.lit("")).alias("volume_peso"))
    return P.sanitize_text(df)


@query("p17_defaults", on_products("""SELECT pagina, pos, promocao_ativa, COALESCE(feature_len, 0) AS n FROM p"""))
def p17(spark, d):
    df = products(spark, d).select(*KEY, F.nullif("promocao_ativa", F.lit(False)).alias("promocao_ativa"), "caracteristicas")
    return P.default_flags_and_lists(df).select(*KEY, "promocao_ativa", F.size("caracteristicas").alias("n"))


@query("p18_display", on_products("""SELECT pagina, pos, COALESCE(linha, '-') AS linha, COALESCE(volume_peso, '-') AS volume_peso,
  CASE WHEN feature_len > 0 THEN rtrim(repeat(feature || '; ', feature_len), '; ') ELSE '-' END AS caracteristicas,
  CASE WHEN len(combo_codes) > 0 THEN array_to_string(combo_codes, '; ') ELSE '-' END AS combo_codes FROM p"""))
def p18(spark, d):
    return P.display_frame(products(spark, d).select(*KEY, "linha", "volume_peso", "caracteristicas", "combo_codes"))


@query("p19_unpivot", on_products("""SELECT pagina, pos, 'preco_regular' AS measure, preco_regular AS value FROM p
  UNION ALL SELECT pagina, pos, 'preco_promocional', preco_promocional FROM p"""))
def p19(spark, d):
    df = products(spark, d).select(*KEY, "preco_regular", "preco_promocional")
    return P.unpivot(df, KEY, ["preco_regular", "preco_promocional"], "measure", "value")


@query("p20_transpose", on_products(f"""WITH g AS (SELECT brand, CAST(COUNT(*) AS DOUBLE) AS n, {rnd('MAX(preco_regular)')} AS top FROM p GROUP BY 1)
  SELECT m.measure, MAX(CASE WHEN measure = 'n' THEN n ELSE top END) FILTER (WHERE brand = 'aurora') AS aurora,
  MAX(CASE WHEN measure = 'n' THEN n ELSE top END) FILTER (WHERE brand = 'brisa') AS brisa
  FROM g CROSS JOIN (VALUES ('n'), ('top')) m(measure) GROUP BY 1"""))
def p20(spark, d):
    g = products(spark, d).groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), N.rounded(F.max("preco_regular")).alias("top"))
    return P.transpose(g, "brand", BRANDS)


@query("p21_preview", on_products("SELECT pagina, pos, codigo, nome FROM p ORDER BY pagina, pos LIMIT 5"))
def p21(spark, d):
    return P.preview(products(spark, d).select(*KEY, "codigo", "nome"), KEY, 5)


@query("a44_sanitize_report", on_products("""SELECT 'invalid_codes_fixed' AS fix, COUNT(*) FILTER (WHERE t = 0) AS fixed_count
  FROM p UNION ALL SELECT 'zero_promo_prices_fixed', COUNT(*) FILTER (WHERE NOT promocao_ativa) FROM p"""))
def a44(spark, d):
    base = table(spark, d, "lineitem").select(
        F.expr("case when cast(floor(l_tax * 100 + 0.5) as int) = 0 then 'none' else cast(l_partkey as string) end").alias("codigo"),
        F.expr("case when l_returnflag <> 'N' then 1.5D else 0.0D end").alias("preco_promocional"))
    return P.sanitize_report(base)


def filter_query(name, cond, fn):
    @query(name, on_features(f"SELECT pagina, pos, codigo FROM f WHERE {cond}"))
    def run(spark, d):
        return fn(featured(spark, d)).select(*KEY, "codigo")


filter_query("f01_positive_discount", "desconto_calculado > 0", lambda df: FI.positive(df, "desconto_calculado"))
filter_query("f02_outlier_cuts", "preco_regular < 500 AND volume_numeric < 1000 AND price_per_unit < 5",
             lambda df: FI.below(FI.below(FI.below(df, "preco_regular", 500), "volume_numeric", 1000), "price_per_unit", 5))
filter_query("f03_positive_savings", "economia > 0 AND preco_regular < 500",
             lambda df: FI.below(FI.positive(df, "economia"), "preco_regular", 500))
filter_query("f04_price_pairs", "preco_promocional IS NOT NULL AND preco_regular < 500",
             lambda df: FI.present_pairs(df, "preco_regular", "preco_promocional", 500))
filter_query("f05_promo_type", "promo_type = 'combo'", lambda df: FI.of_promo_type(df, "combo"))
filter_query("f06_brand", "brand = 'aurora'", lambda df: FI.of_brand(df, "aurora"))
filter_query("f07_complete", "preco_regular IS NOT NULL AND desconto_calculado IS NOT NULL AND volume_numeric IS NOT NULL",
             lambda df: FI.complete(df, ["preco_regular", "desconto_calculado", "volume_numeric"]))


@query("f08_volume", on_features("SELECT pagina, pos, volume_numeric, volume_unit FROM f"))
def f08(spark, d):
    v = X.parse_volume(F.col("volume_peso"))
    return products(spark, d).select(*KEY, v["number"].alias("volume_numeric"), v["unit"].alias("volume_unit"))


@query("f09_cycle", on_products("SELECT pagina, pos, cycle FROM p"))
def f09(spark, d):
    return products(spark, d).select(*KEY, X.cycle_of(F.col("source_file")).alias("cycle"))


@query("f10_brand_folded", """SELECT doc_id, CASE WHEN contains(strip_accents(lower(text)), 'ereement') THEN 'a'
  WHEN contains(strip_accents(lower(text)), 'ecao') THEN 'b' ELSE 'c' END AS brand FROM documents""")
def f10(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.detect_brand(F.col("text"), [("ereement", "a"), ("ecao", "b")], "c").alias("brand"))


@query("f11_brand_ordered", on_products("""SELECT pagina, pos, CASE WHEN contains(source_file, 'aurora') THEN 'Aurora'
  WHEN contains(source_file, '_01') THEN 'January' ELSE 'Unknown' END AS brand FROM p"""))
def f11(spark, d):
    return products(spark, d).select(*KEY, X.detect_brand(
        F.upper("source_file"), [("aurora", "Aurora"), ("_01", "January")], K.BRAND_DEFAULT, fold=False).alias("brand"))


@query("f12_currency", on_products("""SELECT pagina, pos, 'R$ ' || translate(format('{:,.2f}', preco_regular * 100), ',.', '.,') AS price FROM p"""))
def f12(spark, d):
    return products(spark, d).select(*KEY, N.format_brl(F.col("preco_regular") * 100).alias("price"))


@query("f13_safe_percentage", on_products(f"""SELECT pagina, pos, CASE WHEN d > 0 THEN {rnd('preco_promocional / d * 100', 4)}
  ELSE 0.0 END AS pct FROM p"""))
def f13(spark, d):
    b = base(spark, d).select((F.col("l_orderkey") + 1).alias("pagina"),
        F.expr("(l_linenumber * 1000000000L + l_partkey) * 100000000L + l_suppkey").alias("pos"), "d", F.expr("pc / 100").alias("promo"))
    return b.select(*KEY, N.rounded(N.safe_percentage(F.col("promo"), F.col("d")), 4).alias("pct"))


@query("f14_promo_type", on_products("""SELECT pagina, pos, CASE WHEN promo_type = 'pack' THEN 'none' ELSE promo_type END AS promo_type FROM p"""))
def f14(spark, d):
    raw = F.upper(F.replace(F.col("promo_type"), F.lit("_"), F.lit(" ")))
    raw = F.when(F.col("promo_type") == "pack", "BUNDLE").otherwise(raw)
    return products(spark, d).select(*KEY, X.norm_promo_type(raw).alias("promo_type"))


@query("f15_strip_fence", "SELECT event_id, props FROM events")
def f15(spark, d):
    m = F.col("event_id") % 4
    fenced = F.when(m == 0, F.concat(F.lit(" ```json\n"), "props", F.lit("\n```\n"))).when(
        m == 1, F.concat(F.lit("```"), "props", F.lit("```"))).when(
        m == 2, F.concat(F.lit("\n"), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.strip_fence(fenced).alias("props"))


@query("f16_clean_text", f"SELECT doc_id, md5(translate(lower(text), {q(string.punctuation)}, '')) AS digest FROM documents")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("digest"))


SCENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower({{c}}), {q(k)})" for k in ks) + f" THEN {q(n)}" for n, ks in K.SCENT_FAMILIES) + " ELSE 'other' END"


@query("f17_keyword_label", "SELECT doc_id, " + SCENT_SQL.format(c="text") + " AS family FROM documents")
def f17(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.label_by_keywords(F.col("text"), K.SCENT_FAMILIES, K.SCENT_DEFAULT).alias("family"))


@query("f18_tier_stats", on_products("""SELECT pagina, pos, CASE WHEN len(tier_values) > 0 THEN CAST(len(tier_values) AS INTEGER) END AS tier_count,
  list_min(tier_values) AS min_tier, list_max(tier_values) AS max_tier FROM p"""))
def f18(spark, d):
    return products(spark, d).select(*KEY, N.tier_stats(F.col("discount_tiers")).alias("s")).select(*KEY, "s.*")


@query("f19_safe_name", "SELECT p_partkey, replace(replace(lower(p_name || ' / ' || p_brand), ' ', '_'), '/', '-') AS safe_name FROM part")
def f19(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.safe_name(F.concat("p_name", F.lit(" / "), "p_brand")).alias("safe_name"))


@query("f20_cluster_name", on_products("""SELECT codigo, CASE WHEN AVG(preco_regular) / 100 < 50 THEN 'Budget' WHEN AVG(preco_regular) / 100 < 100 THEN 'Economy'
  WHEN AVG(preco_regular) / 100 < 200 THEN 'Premium' ELSE 'Luxury' END AS name FROM p GROUP BY 1"""))
def f20(spark, d):
    avg = products(spark, d).groupBy("codigo").agg(F.avg("preco_regular").alias("a"))
    return avg.select("codigo", N.cluster_name(F.col("a") / 100).alias("name"))
