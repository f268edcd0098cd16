"""Validation, correction and alert reports (V, P12, A32-A35, A41, D09-D11, D25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import constants as K
from vitrine.functions.numbers import effective_discount
from vitrine.operators import kpis as KP, projections as P, ranking as R, rules as V, stats as S
from vitrine.plans.products import on_products, products
from vitrine.plans.q_categories import derived_dim
from vitrine.plans.registry import msum, query, rnd

ORDER = ["pagina", "pos"]


def items(spark, d):
    """Products with faults of every kind worked in, by code number modulo 50."""
    m = F.col("codigo_raw").cast("long") % 50
    rule = F.when(F.col("promo_type") != "none", F.struct(
        F.col("promo_type").alias("type"), F.lit(None).cast("string").alias("description"),
        "discount_tiers", "combo_codes"))
    return products(spark, d).withColumn("m", m).select(
        "source_file", "brand", "cycle", *ORDER,
        F.expr("case m when 0 then '' when 1 then concat('A', codigo_raw) else codigo_raw end").alias("codigo"),
        F.expr("case m when 2 then 'ab' when 3 then concat(nome, '#') else nome end").alias("nome"), "linha",
        F.col("categoria_raw").alias("categoria"),
        F.expr("case when categoria_normalizada <> 'Outros' then categoria_normalizada end").alias("categoria_normalizada"),
        F.coalesce("volume_peso", F.lit("avulso")).alias("volume_peso"),
        F.expr("case m when 4 then 0.0D else preco_regular end").alias("preco_regular"),
        F.expr("case m when 6 then (cast(round(preco_regular * 100) as bigint) div 10) / 100 when 7 then preco_regular "
               "when 8 then 0.0D else preco_promocional end").alias("preco_promocional"),
        "economia", "promocao_ativa", rule.alias("regra_promocional"), "caracteristicas", "desconto_percentual",
    )


def checked(spark, d):
    return V.validate(items(spark, d), derived_dim(spark, d))


ALERT_SQL = """
i AS (SELECT source_file, brand, cycle, pagina, pos, c, m, linha,
    CASE m WHEN 0 THEN '' WHEN 1 THEN 'A' || codigo_raw ELSE codigo_raw END AS codigo,
    CASE m WHEN 2 THEN 'ab' WHEN 3 THEN nome || '#' ELSE nome END AS nome, categoria_raw AS categoria,
    CASE WHEN categoria_normalizada <> 'Outros' THEN categoria_normalizada END AS cn,
    COALESCE(volume_peso, 'avulso') AS volume_peso, CASE m WHEN 4 THEN 0.0 ELSE preco_regular END AS r,
    CASE m WHEN 6 THEN (c // 10) / 100 WHEN 7 THEN preco_regular WHEN 8 THEN 0.0 ELSE preco_promocional END AS q,
    economia AS s, promocao_ativa, promo_type, tier_values, combo_codes, desconto_percentual
  FROM (SELECT *, CAST(codigo_raw AS BIGINT) % 50 AS m FROM p)),
w AS (SELECT *, CAST(ROUND(CAST(r - q AS DECIMAL(38,6)), 2) AS DOUBLE) AS want,
    CASE WHEN r > 0 THEN (1 - q / r) * 100 END AS pct,
    CASE WHEN categoria LIKE 'zz%' THEN 'Outros' ELSE '' END AS match FROM i),
al AS (
  SELECT *, 1 AS o, 'error' AS level, 'codigo' AS field, 'Product code is missing' AS message, NULL AS orig, NULL AS corr FROM w WHERE codigo = ''
  UNION ALL SELECT *, 2, 'warning', 'codigo', 'Product code contains non-numeric characters: ' || codigo, codigo, NULL FROM w
    WHERE codigo <> '' AND NOT regexp_full_match(codigo, '[0-9]+')
  UNION ALL SELECT *, 3, 'warning', 'codigo', 'Product code seems too short: ' || codigo, codigo, NULL FROM w WHERE codigo <> '' AND length(codigo) < 4
  UNION ALL SELECT *, 3, 'warning', 'codigo', 'Product code seems too long: ' || codigo, codigo, NULL FROM w WHERE length(codigo) > 6
  UNION ALL SELECT *, 4, 'error', 'nome', 'Product name is missing or too short', nome, NULL FROM w WHERE nome IS NULL OR length(trim(nome)) < 3
  UNION ALL SELECT *, 5, 'info', 'nome', 'Product name contains unusual characters', nome, NULL FROM w
    WHERE length(trim(nome)) >= 3 AND regexp_matches(nome, '[^\\pL\\pN_\\s°º%/\\-+()]')
  UNION ALL SELECT *, 6, 'error', 'preco_regular', 'Regular price is zero or negative', CAST(r AS VARCHAR), NULL FROM w WHERE r <= 0
  UNION ALL SELECT *, 6, 'warning', 'preco_regular', 'Regular price seems unusually high: R$ ' || r, CAST(r AS VARCHAR), NULL FROM w WHERE r > 10000
  UNION ALL SELECT *, 7, 'warning', 'preco_promocional', 'Promotional price is zero or negative', CAST(q AS VARCHAR), NULL FROM w WHERE q <= 0
  UNION ALL SELECT *, 7, 'error', 'preco_promocional', 'Promotional price (R$ ' || q || ') is higher than regular price (R$ ' || r || ')',
    CAST(q AS VARCHAR), NULL FROM w WHERE q > 0 AND q > r
  UNION ALL SELECT *, 7, 'info', 'preco_promocional', 'Promotional price equals regular price (no discount)', CAST(q AS VARCHAR), NULL FROM w WHERE q > 0 AND q = r
  UNION ALL SELECT *, 8, 'warning', 'preco_promocional', 'Discount seems unusually high: ' || printf('%.1f', pct) || '%', CAST(q AS VARCHAR), NULL
    FROM w WHERE r > 0 AND q > 0 AND pct > 80
  UNION ALL SELECT *, 9, 'warning', 'economia', 'Savings value doesn''t match price difference. Expected: R$ ' || want || ', Got: R$ ' || s,
    CAST(s AS VARCHAR), CAST(want AS VARCHAR) FROM w WHERE s <> 0 AND q <> 0 AND r <> 0 AND abs(s - want) > 0.10
  UNION ALL SELECT *, 10, 'info', 'categoria', 'Category could not be normalized: ' || categoria, categoria, 'Outros' FROM w
    WHERE categoria <> '' AND cn IS NULL AND match = 'Outros'
  UNION ALL SELECT *, 11, 'info', 'volume_peso', 'Volume/weight format not recognized: ' || volume_peso, volume_peso, NULL FROM w
    WHERE volume_peso <> '' AND NOT regexp_matches(lower(volume_peso), '[0-9]+\\s*(ml|g|kg|l|unidades?|un)|[0-9]+\\s*x\\s*[0-9]+')
  UNION ALL SELECT *, 12, 'info', 'promocao_ativa', 'Product has promotional price but promocao_ativa is False', 'false', 'true' FROM w
    WHERE q <> 0 AND q < r AND NOT promocao_ativa
  UNION ALL SELECT *, 13, 'warning', 'regra_promocional', 'Progressive discount rule has no discount tiers defined', NULL, NULL FROM w
    WHERE promo_type = 'progressive_discount' AND len(tier_values) = 0
  UNION ALL SELECT *, 13, 'warning', 'regra_promocional', 'Combo rule has no combo codes defined', NULL, NULL FROM w
    WHERE promo_type = 'combo' AND len(combo_codes) = 0),
rows_al AS (SELECT w.*, COALESCE(g.n, 0) AS n_al, COALESCE(g.err, 0) AS err, COALESCE(g.warn, 0) AS warn, g.sig
  FROM w LEFT JOIN (SELECT pagina, pos, c, COUNT(*) AS n, COUNT(*) FILTER (WHERE level = 'error') AS err,
    COUNT(*) FILTER (WHERE level = 'warning') AS warn, string_agg(level || ':' || field || ':' || message, '|' ORDER BY o) AS sig
    FROM al GROUP BY 1, 2, 3) g USING (pagina, pos, c)),
last AS (SELECT codigo, COUNT(*) AS n, max({'pagina': pagina, 'pos': pos}) FILTER (WHERE n_al > 0) AS k FROM rows_al GROUP BY 1),
batch AS (SELECT l.codigo, a.level, a.field, a.o FROM last l JOIN al a ON a.pagina = l.k.pagina AND a.pos = l.k.pos AND a.codigo = l.codigo
  UNION ALL SELECT codigo, 'warning', 'codigo', 99 FROM last WHERE n > 1)
"""


def on_alerts(sql):
    body = sql.strip()
    return on_products("WITH " + ALERT_SQL.strip() + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body))


def rule_query(name, rules, order):
    @query(name, on_alerts("SELECT pagina, pos, level, field, message, orig AS original_value, corr AS corrected_value "
                           f"FROM al WHERE o IN ({order})"))
    def run(spark, d):
        df = items(spark, d)
        return df.select(*ORDER, F.explode(V.alerts_of(rules())).alias("a")).select(*ORDER, "a.*")


rule_query("v01_code", V.rule_code, "1, 2, 3")
rule_query("v02_name", V.rule_name, "4, 5")
rule_query("v03_regular_price", V.rule_regular, "6")
rule_query("v04_promo_price", V.rule_promo, "7")
rule_query("v05_discount", V.rule_discount, "8")
rule_query("v06_savings", V.rule_savings, "9")
rule_query("v08_volume", V.rule_volume, "11")
rule_query("v09_flag", V.rule_flag, "12")
rule_query("v10_promo_rule", V.rule_promo_rule, "13")


@query("v07_category", on_alerts("SELECT pagina, pos, level, field, message, orig AS original_value, corr AS corrected_value FROM al WHERE o = 10"))
def v07(spark, d):
    return checked(spark, d).select(*ORDER, F.explode("alertas").alias("a")).select(*ORDER, "a.*").where("field = 'categoria'")


def signature(c):
    return F.nullif(F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["level"], a["field"], a["message"])), "|"), F.lit(""))


@query("v11_validate", on_alerts("SELECT pagina, pos, sig AS alerts FROM rows_al"))
def v11(spark, d):
    return checked(spark, d).select(*ORDER, signature(F.col("alertas")).alias("alerts"))


@query("v12_validate_batch", on_alerts("SELECT codigo, string_agg(level || ':' || field, '|' ORDER BY o) AS alerts FROM batch GROUP BY 1"))
def v12(spark, d):
    out = V.validate_batch(checked(spark, d), ORDER)
    return out.select("codigo", F.array_join(F.transform("alerts", lambda a: F.concat_ws(":", a["level"], a["field"])), "|").alias("alerts"))


@query("v13_duplicate_codes", on_products("""SELECT codigo, 'warning' AS level, 'Duplicate product code found: ' || codigo AS message
  FROM p GROUP BY codigo HAVING COUNT(*) > 1"""))
def v13(spark, d):
    return V.duplicate_alerts(products(spark, d)).select("codigo", "alert.level", "alert.message")


CORRECTED_SQL = f"""fix AS (SELECT *, COALESCE(q <> 0 AND q > r, FALSE) AS swap, COALESCE(s <> 0, FALSE) AS has_s,
  COALESCE(q <> 0, FALSE) AS has_q FROM w),
fixed AS (SELECT pagina, pos, source_file, cycle, r AS old_r, q AS old_q, s AS old_s, promocao_ativa AS old_flag, categoria,
  promocao_ativa OR (has_q AND q < r) AS promocao_ativa,
  CASE WHEN has_q AND r <> 0 AND NOT has_s THEN {rnd('abs(r - q)')} ELSE s END AS economia,
  CASE WHEN swap THEN q ELSE r END AS preco_regular, CASE WHEN swap THEN r ELSE q END AS preco_promocional, swap,
  CASE WHEN cn IS NULL THEN CASE WHEN categoria LIKE 'zz%' THEN 'Outros' ELSE upper(substring(categoria, 1, 2)) END ELSE upper(substring(cn, 1, 2)) END AS cat2
  FROM fix)"""


@query("v14_auto_correct", on_alerts("WITH " + CORRECTED_SQL + """ SELECT pagina, pos, promocao_ativa, economia, preco_regular,
  preco_promocional, swap AS swapped, cat2 FROM fixed"""))
def v14(spark, d):
    out = V.auto_correct(items(spark, d), derived_dim(spark, d))
    n = F.col("categoria_normalizada")
    return out.select(
        *ORDER, "promocao_ativa", "economia", "preco_regular", "preco_promocional", (F.size("alertas") > 0).alias("swapped"),
        F.when(n == K.UNMAPPED, n).otherwise(F.substring(n, 1, 2)).alias("cat2"))


@query("v15_summary", on_alerts("""SELECT COUNT(DISTINCT codigo) AS products_with_issues, COUNT(*) AS total_alerts,
  COUNT(*) FILTER (WHERE level = 'error') AS errors, COUNT(*) FILTER (WHERE level = 'warning') AS warnings,
  COUNT(*) FILTER (WHERE level = 'info') AS info FROM batch"""))
def v15(spark, d):
    return V.summary(V.validate_batch(checked(spark, d), ORDER))


@query("v16_summary_by_field", on_alerts("SELECT field, COUNT(*) AS count FROM batch GROUP BY 1"))
def v16(spark, d):
    return V.summary_by_field(V.validate_batch(checked(spark, d), ORDER))


REPORT_SQL = """lastc AS (SELECT source_file, codigo, COUNT(*) AS n, max({'pagina': pagina, 'pos': pos}) FILTER (WHERE n_al > 0) AS k
  FROM rows_al GROUP BY 1, 2),
rep AS (SELECT l.source_file, l.codigo, a.level, a.field, a.o FROM lastc l JOIN al a ON a.pagina = l.k.pagina AND a.pos = l.k.pos
    AND a.codigo = l.codigo AND a.source_file = l.source_file
  UNION ALL SELECT source_file, codigo, 'warning', 'codigo', 99 FROM lastc WHERE n > 1)"""


@query("v17_report_summary", on_alerts("WITH " + REPORT_SQL + """, t AS (SELECT source_file, COUNT(*) AS total_products FROM w GROUP BY 1)
SELECT source_file, total_products, COUNT(DISTINCT codigo) AS products_with_issues, COUNT(*) AS total_alerts,
  COUNT(*) FILTER (WHERE level = 'error') AS errors, COUNT(*) FILTER (WHERE level = 'warning') AS warnings,
  COUNT(*) FILTER (WHERE level = 'info') AS info FROM rep JOIN t USING (source_file) GROUP BY 1, 2"""))
def v17(spark, d):
    return V.report(checked(spark, d), ORDER)[0]


@query("v17_report_details", on_alerts("WITH " + REPORT_SQL + """ SELECT source_file, codigo,
  string_agg(level || ':' || field, '|' ORDER BY o) AS alerts FROM rep GROUP BY 1, 2"""))
def v17b(spark, d):
    out = V.report(checked(spark, d), ORDER)[1]
    return out.select("source_file", "codigo", F.array_join(
        F.transform("alerts", lambda a: F.concat_ws(":", a["level"], a["field"])), "|").alias("alerts"))


FIXED_ITEMS = f"""i2 AS (SELECT * REPLACE (
    CASE WHEN COALESCE(q <> 0 AND q > r, FALSE) THEN q ELSE r END AS r, CASE WHEN COALESCE(q <> 0 AND q > r, FALSE) THEN r ELSE q END AS q,
    CASE WHEN COALESCE(q <> 0, FALSE) AND r <> 0 AND NOT COALESCE(s <> 0, FALSE) THEN {rnd('abs(r - q)')} ELSE s END AS s,
    promocao_ativa OR (COALESCE(q <> 0, FALSE) AND q < r) AS promocao_ativa, 'known' AS cn),
    COALESCE(q <> 0 AND q > r, FALSE) AS swap FROM i),
w AS ("""


def on_processed(sql):
    """The alert tables over corrected rows."""
    fixed = ALERT_SQL.strip().replace("w AS (", FIXED_ITEMS, 1).replace("AS match FROM i)", "AS match FROM i2)", 1)
    return on_products("WITH " + fixed + " " + sql)


@query("v18_process_products", on_processed(f"""SELECT pagina, pos, CASE WHEN categoria LIKE 'zz%' THEN 'Outros' ELSE upper(substring(categoria, 1, 2)) END AS cat2,
  r AS preco_regular, q AS preco_promocional, s AS economia, promocao_ativa,
  NULLIF(concat_ws('|', CASE WHEN swap THEN 'warning:preco_regular:{K.ALERT_TEXTS["prices_swapped"]}' END, sig), '') AS alerts FROM rows_al"""))
def v18(spark, d):
    out = V.process_products(items(spark, d), derived_dim(spark, d), scorer="levenshtein")
    n = F.col("categoria_normalizada")
    return out.select(*ORDER, F.when(n == K.UNMAPPED, n).otherwise(F.substring(n, 1, 2)).alias("cat2"), "preco_regular", "preco_promocional",
                      "economia", "promocao_ativa", signature(F.col("alertas")).alias("alerts"))


def flagged(spark, d):
    return P.flatten_alerts(checked(spark, d))


@query("p12_flatten_alerts", on_alerts("""SELECT pagina, pos, CAST(n_al AS INTEGER) AS alert_count, err > 0 AS has_errors,
  warn > 0 AS has_warnings FROM rows_al"""))
def p12(spark, d):
    return flagged(spark, d).select(*ORDER, "alert_count", "has_errors", "has_warnings")


PCT = lambda c: f"100.0 * COUNT(*) FILTER (WHERE {c}) / COUNT(*)"


@query("a32_alert_overview", on_alerts(f"""SELECT COUNT(*) AS total_products, COUNT(*) FILTER (WHERE n_al > 0) AS products_with_alerts,
  COUNT(*) FILTER (WHERE err > 0) AS products_with_errors, COUNT(*) FILTER (WHERE warn > 0) AS products_with_warnings,
  {rnd(PCT('n_al > 0'))} AS alert_rate, {rnd(PCT('err > 0'))} AS error_rate FROM rows_al"""))
def a32(spark, d):
    return S.alert_overview(flagged(spark, d))


@query("a33_alert_rows", on_alerts("SELECT codigo AS product_code, brand, cn AS category, level, field, message FROM al"))
def a33(spark, d):
    return S.explode_alerts(checked(spark, d))


@query("a34_alerts_by_level", on_alerts("SELECT level, COUNT(*) AS count FROM al GROUP BY 1"))
def a34(spark, d):
    return S.value_counts(S.explode_alerts(checked(spark, d)), "level")


@query("a35_alerts_by_field", on_alerts("SELECT field, COUNT(*) AS count FROM al GROUP BY 1 ORDER BY count DESC, field LIMIT 10"))
def a35(spark, d):
    return R.top_counts(S.explode_alerts(checked(spark, d)), "field", 10)


@query("a41_key_findings", on_alerts(f"""SELECT COUNT(*) AS total_products, COUNT(DISTINCT cn) AS categories, COUNT(DISTINCT linha) AS product_lines,
  {rnd('AVG(r)')} AS avg_price, {rnd('MIN(r)')} AS min_price, {rnd('MAX(r)')} AS max_price,
  COUNT(*) FILTER (WHERE promocao_ativa) AS with_promotion, {rnd(PCT('promocao_ativa'))} AS promotion_rate,
  {rnd('AVG(disc) FILTER (WHERE disc > 0)')} AS avg_discount, {rnd(msum('s'))} AS total_savings,
  COUNT(*) FILTER (WHERE n_al > 0) AS products_with_alerts, {rnd(PCT('err > 0'))} AS error_rate,
  {rnd(PCT('codigo IS NOT NULL AND nome IS NOT NULL AND r IS NOT NULL'))} AS completeness, {rnd('quantile_cont(r, 0.5)')} AS median_price
  FROM (SELECT *, CASE WHEN r > 0 AND q IS NOT NULL THEN (r - q) / r * 100 ELSE desconto_percentual END AS disc FROM rows_al)"""))
def a41(spark, d):
    df = flagged(spark, d).withColumn("desconto_calculado", effective_discount(
        F.col("preco_promocional"), F.col("preco_regular"), F.col("desconto_percentual")))
    return S.key_findings(df)


@query("d09_error_rate", on_alerts(f"""WITH g AS (SELECT brand, cycle, COUNT(*) AS products, 100.0 * COUNT(*) FILTER (WHERE err > 0) / COUNT(*) AS rate
  FROM rows_al GROUP BY 1, 2) SELECT brand, cycle, products, {rnd('rate', 4)} AS error_rate,
  {rnd('rate - lag(rate) OVER (PARTITION BY brand ORDER BY cycle)', 4)} AS change FROM g"""))
def d09(spark, d):
    return KP.error_rate(flagged(spark, d), ["brand"], "cycle")


@query("d10_alert_pareto", on_alerts(f"""WITH g AS (SELECT field, COUNT(*) AS count FROM al GROUP BY 1)
SELECT field, count, {rnd('100.0 * SUM(count) OVER (ORDER BY count DESC, field ROWS UNBOUNDED PRECEDING) / SUM(count) OVER ()')} AS cumulative_pct FROM g"""))
def d10(spark, d):
    return KP.pareto(S.explode_alerts(checked(spark, d)), "field")


@query("d11_correction_counts", on_alerts("WITH " + CORRECTED_SQL + f""" SELECT 'preco_regular' AS field,
  COUNT(*) FILTER (WHERE old_r IS DISTINCT FROM preco_regular) AS corrected, {rnd(PCT('old_r IS DISTINCT FROM preco_regular'))} AS corrected_pct FROM fixed
  UNION ALL SELECT 'preco_promocional', COUNT(*) FILTER (WHERE old_q IS DISTINCT FROM preco_promocional), {rnd(PCT('old_q IS DISTINCT FROM preco_promocional'))} FROM fixed
  UNION ALL SELECT 'economia', COUNT(*) FILTER (WHERE old_s IS DISTINCT FROM economia), {rnd(PCT('old_s IS DISTINCT FROM economia'))} FROM fixed
  UNION ALL SELECT 'promocao_ativa', COUNT(*) FILTER (WHERE old_flag IS DISTINCT FROM promocao_ativa), {rnd(PCT('old_flag IS DISTINCT FROM promocao_ativa'))} FROM fixed"""))
def d11(spark, d):
    before = items(spark, d)
    return KP.correction_counts(before, V.auto_correct, ["preco_regular", "preco_promocional", "economia", "promocao_ativa"])


@query("d25_quality_kpis", on_alerts(f"""SELECT {rnd(PCT('err = 0'))} AS accuracy,
  {rnd('100.0 * SUM(' + ' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in ('codigo', 'nome', 'linha', 'cn', 'volume_peso', 'r', 'q')) + ') / (COUNT(*) * 7)')} AS completeness,
  {rnd(PCT('cn IS NOT NULL'))} AS coverage FROM rows_al"""))
def d25(spark, d):
    return KP.quality_kpis(flagged(spark, d), [
        "codigo", "nome", "linha", "categoria_normalizada", "volume_peso", "preco_regular", "preco_promocional"])
