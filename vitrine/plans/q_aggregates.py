"""Overview, distribution, pricing, promotion and quality reports (A, W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import constants as K
from vitrine.operators import filters as FI, ranking as R, stats as S
from vitrine.plans.products import BRANDS, CYCLES, featured, on_features, on_products, products, products_with
from vitrine.plans.registry import msum, query, rnd, table

PCT = lambda c: f"100.0 * COUNT(*) FILTER (WHERE {c}) / COUNT(*)"


@query("a01_overview", on_features(f"""
SELECT COUNT(*) AS total_products, COUNT(DISTINCT codigo) AS unique_products, COUNT(DISTINCT brand) AS brands,
  COUNT(DISTINCT source_file) AS catalogs, COUNT(DISTINCT cycle) AS cycles,
  COUNT(DISTINCT categoria_normalizada) AS categories, COUNT(DISTINCT linha) AS product_lines,
  COUNT(*) FILTER (WHERE promocao_ativa) AS products_with_promotion,
  {rnd(PCT('promocao_ativa'))} AS promotion_rate, {rnd('AVG(preco_regular)')} AS avg_regular_price,
  {rnd('AVG(desconto_calculado)')} AS avg_discount FROM f"""))
def a01(spark, d):
    return S.overview(featured(spark, d))


@query("a02_rows_per_brand", on_products("SELECT brand, COUNT(*) AS count FROM p GROUP BY brand"))
def a02(spark, d):
    return S.value_counts(products(spark, d), "brand")


@query("a03_catalogs_per_brand", on_products(
    "SELECT brand, COUNT(DISTINCT source_file) AS distinct_count FROM p GROUP BY brand"))
def a03(spark, d):
    return S.distinct_by(products(spark, d), "brand", "source_file")


@query("a04_rows_per_brand_cycle", on_products(
    "SELECT brand, cycle, COUNT(*) AS count FROM p GROUP BY brand, cycle"))
def a04(spark, d):
    return S.counts_by(products(spark, d), ["brand", "cycle"])


def hist_sql(col, bins, cond):
    return on_features(f"""
WITH x AS (SELECT CAST({col} AS DOUBLE) AS v FROM f WHERE {cond} AND {col} IS NOT NULL),
r AS (SELECT MIN(v) AS lo, (MAX(v) - MIN(v)) / {float(bins)} AS w FROM x),
n AS (SELECT LEAST(CAST(FLOOR((v - lo) / w) AS BIGINT), {bins - 1}) AS bin, COUNT(*) AS n FROM x, r GROUP BY 1)
SELECT b.range AS bin, {rnd('lo + b.range * w', 4)} AS bin_start, {rnd('lo + (b.range + 1) * w', 4)} AS bin_end,
  COALESCE(n.n, 0) AS count FROM range({bins}) b CROSS JOIN r LEFT JOIN n ON n.bin = b.range""")


@query("a05_price_histogram", hist_sql("preco_regular", 50, "preco_regular < 500"))
def a05(spark, d):
    return S.histogram(FI.below(featured(spark, d), "preco_regular", 500), "preco_regular", 50)


@query("a05_discount_histogram", hist_sql("desconto_calculado", 30, "desconto_calculado > 0"))
def a05b(spark, d):
    return S.histogram(FI.positive(featured(spark, d), "desconto_calculado"), "desconto_calculado", 30)


@query("a05_volume_histogram", hist_sql("volume_numeric", 40, "volume_numeric < 1000"))
def a05c(spark, d):
    return S.histogram(FI.below(featured(spark, d), "volume_numeric", 1000), "volume_numeric", 40)


@query("a06_median_price", on_products(f"SELECT {rnd('quantile_cont(preco_regular, 0.5)')} AS median FROM p"))
def a06(spark, d):
    return S.median_of(products(spark, d), "preco_regular")


@query("a06_median_discount", on_features(
    f"SELECT {rnd('quantile_cont(desconto_calculado, 0.5)')} AS median FROM f WHERE desconto_calculado > 0"))
def a06b(spark, d):
    return S.median_of(FI.positive(featured(spark, d), "desconto_calculado"), "desconto_calculado")


CORR = ["preco_regular", "preco_promocional", "economia", "desconto_calculado", "volume_numeric",
        "price_per_unit", "pagina", "features_count"]


@query("a07_correlation", on_features(" UNION ALL ".join(
    f"SELECT '{CORR[j]}' AS \"row\", '{CORR[i]}' AS col, {rnd(f'corr({CORR[i]}, {CORR[j]})', 4)} AS corr FROM f"
    for i in range(8) for j in range(i + 1, 8))))
def a07(spark, d):
    return S.corr_matrix(featured(spark, d), CORR)


def stats_sql(col, cond="TRUE"):
    return on_features(f"""SELECT brand, COUNT({col}) AS count, {rnd(f'AVG({col})')} AS mean,
  {rnd(f'quantile_cont({col}, 0.5)')} AS median, {rnd(f'stddev_samp({col})')} AS std, {rnd(f'MIN({col})')} AS min,
  {rnd(f'MAX({col})')} AS max FROM f WHERE {cond} GROUP BY brand""")


@query("a08_discount_stats", stats_sql("desconto_calculado", "desconto_calculado > 0"))
def a08(spark, d):
    return S.stats_by(FI.positive(featured(spark, d), "desconto_calculado"), "brand", "desconto_calculado")


def box_sql(keys, col, cond):
    k = ", ".join(keys)
    return on_features(f"""
WITH x AS (SELECT {k}, {col} AS v FROM f WHERE {cond} AND {col} IS NOT NULL),
q AS (SELECT {k}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM x GROUP BY {k}),
j AS (SELECT *, v >= q1 - (q3 - q1) * 1.5 AND v <= q3 + (q3 - q1) * 1.5 AS ok FROM x JOIN q USING ({k}))
SELECT {k}, {rnd('MIN(q1)')} AS q1, {rnd('MIN(median)')} AS median, {rnd('MIN(q3)')} AS q3,
  {rnd('MIN(v) FILTER (WHERE ok)')} AS whisker_low, {rnd('MAX(v) FILTER (WHERE ok)')} AS whisker_high,
  COUNT(*) FILTER (WHERE NOT ok) AS outliers FROM j GROUP BY {k}""")


@query("a09_discount_box", box_sql(["brand"], "desconto_calculado", "desconto_calculado > 0"))
def a09(spark, d):
    return S.box_stats(FI.positive(featured(spark, d), "desconto_calculado"), ["brand"], "desconto_calculado")


@query("a09_price_box", box_sql(["categoria_normalizada", "brand"], "preco_regular", "preco_regular < 500"))
def a09b(spark, d):
    return S.box_stats(
        FI.below(featured(spark, d), "preco_regular", 500), ["categoria_normalizada", "brand"], "preco_regular")


@query("a09_unit_price_box", box_sql(
    ["categoria_normalizada"], "price_per_unit", "volume_unit = 'ml' AND price_per_unit < 5"))
def a09c(spark, d):
    df = featured(spark, d).where(F.col("volume_unit") == "ml")
    return S.box_stats(FI.below(df, "price_per_unit", 5), ["categoria_normalizada"], "price_per_unit")


def pivot_sql(key, label, values, src="f"):
    cells = ", ".join(f"COUNT(*) FILTER (WHERE {label} = '{v}') AS \"{v}\"" for v in values)
    return on_features(f"SELECT {key}, {cells} FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}")


RANGE_SQL = "(SELECT *, CASE WHEN desconto_calculado <= -0.1 THEN NULL WHEN desconto_calculado <= 0 THEN 'No Discount' " \
    + " ".join(f"WHEN desconto_calculado <= {e} THEN '{n}'" for e, n in zip(K.DISCOUNT_EDGES[1:], K.DISCOUNT_LABELS[1:])) \
    + " END AS discount_range FROM f)"


@query("a10_discount_range_by_brand", pivot_sql("brand", "discount_range", K.DISCOUNT_LABELS, RANGE_SQL))
def a10(spark, d):
    from vitrine.functions.numbers import discount_range
    df = featured(spark, d).withColumn("discount_range", discount_range(F.col("desconto_calculado")))
    return S.pivot_counts(df, "brand", "discount_range", K.DISCOUNT_LABELS)


@query("a11_discount_by_category", on_features(f"""SELECT categoria_normalizada, {rnd('AVG(desconto_calculado)')} AS mean,
  {rnd('quantile_cont(desconto_calculado, 0.5)')} AS median, COUNT(desconto_calculado) AS count
  FROM f WHERE desconto_calculado > 0 GROUP BY 1"""))
def a11(spark, d):
    return S.mean_by(FI.positive(featured(spark, d), "desconto_calculado"), "categoria_normalizada", "desconto_calculado")


@query("a12_price_stats", stats_sql("preco_regular"))
def a12(spark, d):
    return S.stats_by(featured(spark, d), "brand", "preco_regular")


TIERS = [n for _, n in K.PRICE_TIERS] + [K.PRICE_TIER_TOP]


@query("a13_price_tier_by_brand", pivot_sql("brand", "price_tier", TIERS))
def a13(spark, d):
    return S.pivot_counts(featured(spark, d), "brand", "price_tier", TIERS)


@query("a14_savings_stats", on_products(f"""SELECT brand, COUNT(economia) AS count, {rnd(msum('economia'))} AS sum,
  {rnd('AVG(economia)')} AS mean, {rnd('quantile_cont(economia, 0.5)')} AS median, {rnd('MAX(economia)')} AS max
  FROM p WHERE economia > 0 GROUP BY brand"""))
def a14(spark, d):
    return S.savings_stats(FI.positive(products(spark, d), "economia"), "brand")


@query("a15_savings_by_category", on_products(f"""SELECT categoria_normalizada, {rnd(msum('economia'))} AS sum,
  {rnd('AVG(economia)')} AS mean, COUNT(economia) AS count FROM p WHERE economia > 0 GROUP BY 1"""))
def a15(spark, d):
    return S.savings_by(FI.positive(products(spark, d), "economia"), "categoria_normalizada")


@query("a16_category_distribution", on_products(f"""SELECT categoria_normalizada, COUNT(*) AS count,
  {rnd('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM p)')} AS pct FROM p GROUP BY 1"""))
def a16(spark, d):
    return S.distribution(products(spark, d), "categoria_normalizada")


@query("a17_category_share_in_brand", on_products(f"""SELECT brand, categoria_normalizada,
  {rnd('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY brand)')} AS share_pct FROM p GROUP BY 1, 2"""))
def a17(spark, d):
    return S.share_within(products(spark, d), "brand", "categoria_normalizada")


@query("a18_portfolio", on_products(f"""SELECT brand, categoria_normalizada, COUNT(codigo) AS count,
  {rnd('AVG(preco_regular)')} AS avg_price FROM p GROUP BY 1, 2"""))
def a18(spark, d):
    return S.portfolio(products(spark, d), ["brand", "categoria_normalizada"])


@query("a19_line_metrics", on_features(f"""SELECT linha, COUNT(codigo) AS product_count,
  {rnd('AVG(preco_regular)')} AS avg_price, {rnd('AVG(CAST(promocao_ativa AS DOUBLE))')} AS promo_rate,
  {rnd('AVG(desconto_calculado)')} AS avg_discount FROM f WHERE linha IS NOT NULL GROUP BY 1
  HAVING COUNT(codigo) >= 10 ORDER BY product_count DESC, linha LIMIT 30"""))
def a19(spark, d):
    return S.line_metrics(featured(spark, d))


@query("a20_volume_by_unit", on_features(f"""SELECT volume_unit, COUNT(volume_numeric) AS count,
  {rnd('AVG(volume_numeric)')} AS mean, {rnd('stddev_samp(volume_numeric)')} AS std, {rnd('MIN(volume_numeric)')} AS min,
  {rnd('quantile_cont(volume_numeric, 0.25)')} AS p25, {rnd('quantile_cont(volume_numeric, 0.5)')} AS p50,
  {rnd('quantile_cont(volume_numeric, 0.75)')} AS p75, {rnd('MAX(volume_numeric)')} AS max
  FROM f WHERE volume_numeric IS NOT NULL GROUP BY 1"""))
def a20(spark, d):
    return S.describe_by(featured(spark, d).where("volume_numeric IS NOT NULL"), ["volume_unit"], "volume_numeric")


MEASURES = {
    "total_products": "COUNT(codigo)", "unique_products": "COUNT(DISTINCT codigo)",
    "unique_lines": "COUNT(DISTINCT linha)", "avg_price": "AVG(preco_regular)",
    "median_price": "quantile_cont(preco_regular, 0.5)", "max_price": "MAX(preco_regular)",
    "promo_rate": "AVG(CAST(promocao_ativa AS DOUBLE))", "avg_discount": "AVG(desconto_calculado)",
    "total_savings": msum("economia"), "avg_features": "AVG(features_count)",
}


@query("a21_brand_comparison", on_features("WITH m AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS measure, brand, {rnd(x)} AS value FROM f GROUP BY brand" for n, x in MEASURES.items()) + """)
SELECT measure, MAX(value) FILTER (WHERE brand = 'aurora') AS aurora, MAX(value) FILTER (WHERE brand = 'brisa') AS brisa
FROM m GROUP BY measure"""))
def a21(spark, d):
    return S.compare_brands(featured(spark, d), BRANDS)


@query("a22_scaled_profile", on_features(f"""SELECT brand, {rnd('AVG(preco_regular) / 100', 4)} AS avg_price,
  {rnd('AVG(CAST(promocao_ativa AS DOUBLE))', 4)} AS promo_rate, {rnd('AVG(desconto_calculado) / 100', 4)} AS avg_discount,
  {rnd('COUNT(DISTINCT linha) / 100.0', 4)} AS product_lines, {rnd('AVG(features_count)', 4)} AS avg_features
  FROM f GROUP BY brand"""))
def a22(spark, d):
    return S.scaled_profile(featured(spark, d), {"avg_price": 100, "avg_discount": 100, "product_lines": 100})


@query("a23_promo_type_distribution", on_products(f"""SELECT promo_type, COUNT(*) AS count,
  {rnd('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM p)')} AS pct FROM p GROUP BY 1"""))
def a23(spark, d):
    return S.distribution(products(spark, d), "promo_type")


@query("a24_promo_type_by_brand", pivot_sql("promo_type", "brand", BRANDS))
def a24(spark, d):
    return S.pivot_counts(products(spark, d), "promo_type", "brand", BRANDS)


@query("a27_category_promo_crosstab", on_products("SELECT categoria_normalizada, " + ", ".join(
    rnd(f"COUNT(*) FILTER (WHERE promo_type = '{t}') * 100.0 / COUNT(*)") + f" AS {t}" for t in K.PROMO_TYPES)
    + " FROM p GROUP BY 1"))
def a27(spark, d):
    return S.crosstab_pct(products(spark, d), "categoria_normalizada", "promo_type", K.PROMO_TYPES)


@query("a28_tier_summary", on_products("WITH t AS (SELECT len(tier_values) AS n, list_min(tier_values) AS lo, "
    "list_max(tier_values) AS hi FROM p WHERE promo_type = 'progressive_discount' AND len(tier_values) > 0), "
    "m AS (SELECT 'tier_count' AS measure, CAST(n AS DOUBLE) AS v FROM t UNION ALL SELECT 'min_tier', lo FROM t "
    f"UNION ALL SELECT 'max_tier', hi FROM t) SELECT measure, COUNT(v) AS count, {rnd('AVG(v)')} AS mean, "
    f"{rnd('stddev_samp(v)')} AS std, {rnd('MIN(v)')} AS min, {rnd('quantile_cont(v, 0.25)')} AS p25, "
    f"{rnd('quantile_cont(v, 0.5)')} AS p50, {rnd('quantile_cont(v, 0.75)')} AS p75, {rnd('MAX(v)')} AS max "
    "FROM m GROUP BY measure"))
def a28(spark, d):
    return S.tier_summary(products(spark, d))


@query("a29_tier_counts", on_products("SELECT CAST(len(tier_values) AS INTEGER) AS tier_count, COUNT(*) AS count FROM p "
    "WHERE promo_type = 'progressive_discount' AND len(tier_values) > 0 GROUP BY 1"))
def a29(spark, d):
    return S.tier_counts(products(spark, d))


@query("a30_promo_trend", on_features(f"""SELECT brand, cycle, COUNT(codigo) AS total_products,
  COUNT(*) FILTER (WHERE promocao_ativa) AS products_with_promo, {rnd('AVG(desconto_calculado)')} AS avg_discount,
  {rnd('COUNT(*) FILTER (WHERE promocao_ativa) / COUNT(codigo) * 100')} AS promo_rate FROM f GROUP BY 1, 2"""))
def a30(spark, d):
    return S.promo_trend(featured(spark, d), ["brand", "cycle"])


@query("a31_category_cycle_rate", on_products("SELECT categoria_normalizada, " + ", ".join(
    "COALESCE(" + rnd(f"AVG(CAST(promocao_ativa AS DOUBLE)) FILTER (WHERE cycle = {c}) * 100") + f", 0) AS \"{c}\""
    for c in CYCLES) + " FROM p GROUP BY 1"))
def a31(spark, d):
    return S.rate_matrix(products(spark, d), "categoria_normalizada", "cycle", CYCLES)


FIELDS = K.KEY_FIELDS


@query("a36_missing_summary", on_products("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"{rnd(PCT(c + ' IS NULL'))} AS missing_pct FROM p" for c in FIELDS) + ")"))
def a36(spark, d):
    return S.missing_summary(products(spark, d), FIELDS)


@query("a37_missing_matrix", on_products("SELECT pagina, pos, " + ", ".join(
    f"{c} IS NULL AS {c}_missing" for c in FIELDS) + " FROM p ORDER BY pagina, pos LIMIT 500"))
def a37(spark, d):
    return S.missing_matrix(products(spark, d), FIELDS, ["pagina", "pos"])


@query("a38_missing_by_brand", on_products(" UNION ALL ".join(
    f"SELECT brand, '{c}' AS field, {rnd(PCT(c + ' IS NULL'))} AS missing_pct FROM p GROUP BY brand" for c in FIELDS)))
def a38(spark, d):
    return S.missing_by(products(spark, d), "brand", FIELDS)


@query("a39_mapping_counts", on_products("SELECT categoria_raw, categoria_normalizada, COUNT(*) AS count FROM p GROUP BY 1, 2"))
def a39(spark, d):
    return S.mapping_counts(products(spark, d), "categoria_raw", "categoria_normalizada")


@query("a39_mapping_totals", on_products("SELECT COUNT(DISTINCT categoria_raw) AS unique_raw, "
    "COUNT(DISTINCT categoria_normalizada) AS unique_normalized FROM p"))
def a39b(spark, d):
    return S.mapping_totals(products(spark, d), "categoria_raw", "categoria_normalizada")


@query("a40_unmapped_share", on_products(f"""SELECT COUNT(*) FILTER (WHERE categoria_normalizada = 'Outros') AS unmapped_count,
  {rnd(PCT("categoria_normalizada = 'Outros'"))} AS unmapped_pct FROM p"""))
def a40(spark, d):
    return S.unmapped_share(products(spark, d), "categoria_normalizada")


@query("a40_unmapped_values", on_products("SELECT categoria_raw, COUNT(*) AS count FROM p "
    "WHERE categoria_normalizada = 'Outros' GROUP BY 1 ORDER BY count DESC, categoria_raw LIMIT 10"))
def a40b(spark, d):
    return S.unmapped_values(products(spark, d), "categoria_raw", "categoria_normalizada")


@query("a42_catalog_statistics", on_products("""SELECT source_file, COUNT(*) AS total_products,
  COUNT(*) FILTER (WHERE promocao_ativa) AS products_with_promotion,
  array_to_string(list_sort(list(DISTINCT categoria_normalizada)), ';') AS categories,
  array_to_string(list_sort(list(DISTINCT linha) FILTER (WHERE linha IS NOT NULL)), ';') AS product_lines
  FROM p GROUP BY source_file"""))
def a42(spark, d):
    out = S.catalog_statistics(products(spark, d))
    return out.withColumns({c: F.array_join(c, ";") for c in ("categories", "product_lines")})


@query("a43_extraction_summary", on_products("""WITH t AS (SELECT source_file, COUNT(DISTINCT pagina) AS pages,
  COUNT(*) AS products FROM p GROUP BY 1), g AS (SELECT source_file, categoria_normalizada AS category, COUNT(*) AS count,
  CAST(row_number() OVER (PARTITION BY source_file ORDER BY COUNT(*) DESC, categoria_normalizada) AS INTEGER) AS rank
  FROM p GROUP BY 1, 2) SELECT source_file, pages, products, rank, category, count FROM t JOIN g USING (source_file)
  WHERE rank <= 5"""))
def a43(spark, d):
    return S.extraction_summary(products(spark, d))


@query("w01_top_lines", on_products("SELECT linha, COUNT(*) AS count FROM p WHERE linha IS NOT NULL GROUP BY 1 "
    "ORDER BY count DESC, linha LIMIT 20"))
def w01(spark, d):
    return R.top_counts(products(spark, d), "linha", 20)


@query("w02_top_lines_by_brand", on_products("""SELECT * FROM (SELECT brand, linha, COUNT(*) AS count,
  CAST(row_number() OVER (PARTITION BY brand ORDER BY COUNT(*) DESC, linha) AS INTEGER) AS rank
  FROM p WHERE linha IS NOT NULL GROUP BY 1, 2) WHERE rank <= 10"""))
def w02(spark, d):
    return R.top_counts_by(products(spark, d), "brand", "linha", 10)


@query("w03_share_of_total", on_products(f"""SELECT linha, COUNT(*) AS count,
  {rnd('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()')} AS share_pct FROM p WHERE linha IS NOT NULL GROUP BY 1"""))
def w03(spark, d):
    return S.with_share(S.value_counts(products(spark, d), "linha"), "count")


@query("w03_share_of_group", on_products(f"""SELECT brand, linha, COUNT(*) AS count,
  {rnd('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY brand)')} AS share_pct
  FROM p WHERE linha IS NOT NULL GROUP BY 1, 2"""))
def w03b(spark, d):
    return S.with_share(S.counts_by(products(spark, d), ["brand", "linha"]), "count", ["brand"])


@query("w04_sample_rows", on_products("""SELECT pagina, pos, codigo, nome FROM p
  ORDER BY md5('42|' || CAST(pagina AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), pagina, pos LIMIT 1000"""))
def w04(spark, d):
    return R.sample_rows(products(spark, d).select("pagina", "pos", "codigo", "nome"), ["pagina", "pos"], 1000)


@query("w05_pages_in_order", on_products("SELECT source_file, pagina, COUNT(*) AS products FROM p GROUP BY 1, 2"))
def w05(spark, d):
    pages = products(spark, d).groupBy("source_file", "pagina").agg(F.count(F.lit(1)).alias("products"))
    return R.ordered(pages, ["source_file", "pagina"])


@query("u01_distinct_lines", on_products("SELECT DISTINCT linha FROM p WHERE linha IS NOT NULL"))
def u01(spark, d):
    return R.distinct_list(products_with(spark, d, ["linha"]), "linha")


@query("u02_duplicate_codes", on_products("SELECT codigo, COUNT(*) AS count FROM p GROUP BY 1 HAVING COUNT(*) > 1"))
def u02(spark, d):
    return R.duplicate_keys(products_with(spark, d, ["codigo"]), "codigo")
