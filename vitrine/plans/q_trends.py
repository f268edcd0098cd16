"""Cycle, price, cluster and key-figure reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.numbers import effective_discount, rounded
from vitrine.operators import clusters as CL, filters as FI, kpis as KP, trends as TR
from vitrine.plans.products import featured, on_features, on_products, products
from vitrine.plans.registry import msum, query, rnd

PCT = lambda c: f"100.0 * COUNT(*) FILTER (WHERE {c}) / COUNT(*)"


@query("d01_price_percentiles", on_products("SELECT categoria_normalizada, " + ", ".join(
    rnd(f"quantile_cont(preco_regular, {p})") + f" AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9)) + " FROM p GROUP BY 1"))
def d01(spark, d):
    return TR.percentiles(products(spark, d), "preco_regular", [0.25, 0.5, 0.75, 0.9], ["categoria_normalizada"])


@query("d02_discount_outliers", on_features("SELECT pagina, pos, codigo FROM f WHERE desconto_calculado > 50"))
def d02(spark, d):
    return FI.outliers(featured(spark, d), "desconto_calculado", 50).select("pagina", "pos", "codigo")


@query("d02_outlier_share", on_features(f"""SELECT categoria_normalizada, COUNT(*) FILTER (WHERE desconto_calculado > 50) AS outliers,
  {rnd('100.0 * COUNT(*) FILTER (WHERE desconto_calculado > 50) / COUNT(desconto_calculado)')} AS outlier_pct FROM f GROUP BY 1"""))
def d02b(spark, d):
    return TR.outlier_share(featured(spark, d), "desconto_calculado", 50, "categoria_normalizada")


@query("d03_price_ratio", on_products(f"""SELECT categoria_normalizada, COUNT(*) AS count, {rnd('AVG(preco_promocional / preco_regular)', 4)} AS avg_ratio
  FROM p WHERE preco_promocional IS NOT NULL AND preco_regular > 0 GROUP BY 1"""))
def d03(spark, d):
    return TR.price_ratio(products(spark, d), "categoria_normalizada")


@query("d04_savings_totals", on_products(f"""SELECT source_file, cycle, {rnd(msum('economia'))} AS total_savings,
  {rnd(msum('economia') + ' / ' + msum('preco_regular') + ' * 100', 4)} AS savings_pct FROM p WHERE economia > 0 GROUP BY 1, 2"""))
def d04(spark, d):
    return TR.savings_totals(products(spark, d), ["source_file", "cycle"])


@query("d05_category_growth", on_products(f"""WITH g AS (SELECT categoria_normalizada, cycle, COUNT(*) AS count FROM p GROUP BY 1, 2),
l AS (SELECT *, lag(count) OVER (PARTITION BY categoria_normalizada ORDER BY cycle) AS b FROM g)
SELECT categoria_normalizada, cycle, count, count - b AS change, {rnd('(count - b) / b * 100')} AS growth_pct FROM l"""))
def d05(spark, d):
    return TR.growth(products(spark, d), "categoria_normalizada", "cycle")


@query("d06_modal_size", on_products("""WITH g AS (SELECT categoria_normalizada, volume_peso, COUNT(*) AS count FROM p WHERE volume_peso IS NOT NULL GROUP BY 1, 2)
SELECT categoria_normalizada, volume_peso, count FROM (SELECT *, row_number() OVER (PARTITION BY categoria_normalizada ORDER BY count DESC, volume_peso) AS r FROM g) WHERE r = 1"""))
def d06(spark, d):
    return TR.modal_value(products(spark, d), "categoria_normalizada", "volume_peso")


MISS = ["linha", "volume_peso", "preco_promocional", "economia"]


@query("d12_missing_corr", on_products(" UNION ALL ".join(
    f"SELECT {rnd(PCT(' AND '.join(c + ' IS NOT NULL' for c in MISS)))} AS complete_pct, '{MISS[i]}' AS a, '{MISS[j]}' AS b, "
    + rnd(f"corr(CAST({MISS[i]} IS NULL AS DOUBLE), CAST({MISS[j]} IS NULL AS DOUBLE))", 4) + " AS corr FROM p"
    for i in range(4) for j in range(i + 1, 4))))
def d12(spark, d):
    return TR.missing_corr(products(spark, d), MISS)


def kmeans_sql(ks, starts, rounds, source="f", cols=CL.FEATURES):
    """The rounds of k-means, one after the other: pt (distinct points), last (k, s, cluster, centre), cost, won."""
    most, xyz = max(ks), ", ".join(f"x{i}" for i in range(len(cols)))
    scaled = ", ".join(f"({c} - (SELECT AVG({c}) FROM r)) / (SELECT CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END FROM r) AS x{i}" for i, c in enumerate(cols))
    code = ", ".join(f"CAST(floor({c} * 10000 + 0.5) AS BIGINT)" for c in cols)
    far = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(len(cols)))
    out = f"""r AS (SELECT * FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}),
pt AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM (SELECT {scaled}, n, h FROM (SELECT {', '.join(cols)}, COUNT(*) AS n, md5(concat_ws(',', '42', {code})) AS h FROM r GROUP BY ALL))),
dr AS (SELECT *, row_number() OVER (ORDER BY h, {xyz}) - 1 AS d FROM pt QUALIFY d < {most * starts}),
c0 AS MATERIALIZED (SELECT k, d // {most} AS s, d % {most} AS cluster, {xyz} FROM dr, (SELECT unnest({list(ks)}) AS k) WHERE d % {most} < k)"""
    for n in range(rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT i, k, s, list_position(f, list_min(f)) - 1 AS cluster, list_min(f) AS far FROM (SELECT p.i, k, s, list_transform(l, lambda c: {far}) AS f
  FROM pt p, (SELECT k, s, list({{{', '.join(f"'x{i}': x{i}" for i in range(len(cols)))}}} ORDER BY cluster) AS l FROM c{n} GROUP BY 1, 2)))"""
        if n < rounds:
            out += f""",
c{n + 1} AS MATERIALIZED (SELECT k, s, cluster, {', '.join(f'COALESCE(g.x{i}, c.x{i}) AS x{i}' for i in range(len(cols)))} FROM c{n} c
  LEFT JOIN (SELECT k, s, cluster, {', '.join(f'SUM(n * x{i}) / SUM(n) AS x{i}' for i in range(len(cols)))} FROM a{n} JOIN pt USING (i) GROUP BY 1, 2, 3) g USING (k, s, cluster))"""
    return out + f""",
cost AS (SELECT k, s, SUM(n * far) AS cost FROM a{rounds} JOIN pt USING (i) GROUP BY 1, 2),
won AS (SELECT k, MIN(s) AS s, MIN(cost) AS cost FROM cost JOIN (SELECT k, MIN(cost) AS least FROM cost GROUP BY 1) USING (k) WHERE cost <= least * (1 + 1e-9) GROUP BY 1)"""


ONE = dict(starts=10, rounds=CL.ROUNDS)
LABELLED = f"""fin AS (SELECT k, s, cluster, x0, x1, x2 FROM c{CL.ROUNDS} JOIN won USING (k, s)),
m AS (SELECT {', '.join(f'AVG({c}) AS m{i}, CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END AS d{i}' for i, c in enumerate(CL.FEATURES))} FROM r),
lab AS (SELECT pagina, pos, {', '.join(CL.FEATURES)}, CAST(arg_min(cluster, (far, cluster)) AS INTEGER) AS cluster FROM (SELECT r.*, fin.cluster AS cluster, {' + '.join(
    f'(({c} - m{i}) / d{i} - x{i}) ** 2' for i, c in enumerate(CL.FEATURES))} AS far FROM r, m, fin) GROUP BY ALL)"""


@query("d14_clusters_imputed", on_features(f"""WITH fi AS (SELECT * REPLACE (CASE WHEN preco_regular > 0
    THEN (preco_regular - COALESCE(preco_promocional, preco_regular)) / preco_regular * 100 ELSE desconto_percentual END AS desconto_calculado) FROM f),
{kmeans_sql([4], **ONE, source='fi')}, {LABELLED},
g AS (SELECT cluster, COUNT(preco_regular) AS count, {rnd('AVG(preco_regular)')} AS avg_price, {rnd('AVG(desconto_calculado)')} AS avg_discount, {rnd('AVG(volume_numeric)')} AS avg_volume FROM lab GROUP BY 1)
SELECT *, CASE WHEN avg_price < 50 THEN 'Budget' WHEN avg_price < 100 THEN 'Economy' WHEN avg_price < 200 THEN 'Premium' ELSE 'Luxury' END AS cluster_name FROM g"""))
def d14(spark, d):
    f = CL.impute_promo(featured(spark, d)).withColumn("desconto_calculado", effective_discount(
        F.col("preco_promocional"), F.col("preco_regular"), F.col("desconto_percentual")))
    return CL.cluster_profiles(CL.kmeans(f.select("pagina", "pos", *CL.FEATURES), 4, **ONE))


G = "g AS (SELECT categoria_normalizada, cycle, AVG(preco_regular) AS y, AVG(CAST(promocao_ativa AS DOUBLE)) * 100 AS r FROM p GROUP BY 1, 2)"


@query("d19_moving_average", on_products(f"""WITH {G} SELECT categoria_normalizada, cycle, {rnd('y')} AS avg_price, {rnd('r')} AS promo_rate,
  {rnd('AVG(y) OVER l')} AS avg_price_ma, {rnd('AVG(r) OVER l')} AS promo_rate_ma FROM g
  WINDOW l AS (PARTITION BY categoria_normalizada ORDER BY cycle RANGE 2 PRECEDING)"""))
def d19(spark, d):
    return TR.moving_average(products(spark, d), "categoria_normalizada", "cycle")


@query("d20_decompose", on_products(f"""WITH {G}, t AS (SELECT *, CASE WHEN COUNT(*) OVER c = 3 THEN AVG(y) OVER c END AS tr FROM g
  WINDOW c AS (PARTITION BY categoria_normalizada ORDER BY cycle RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
s AS (SELECT *, AVG(y - tr) OVER (PARTITION BY categoria_normalizada, cycle % 3) AS se FROM t)
SELECT categoria_normalizada, cycle, {rnd('y', 4)} AS value, {rnd('tr', 4)} AS trend, {rnd('se', 4)} AS seasonal, {rnd('y - tr - se', 4)} AS residual FROM s"""))
def d20(spark, d):
    return TR.decompose(products(spark, d), "categoria_normalizada", "cycle")


@query("d20_decompose_even", on_products(f"""WITH {G}, o AS (SELECT * FROM g WHERE cycle <> 4),
t AS (SELECT o.*, (SELECT CASE WHEN COUNT(*) = 5 THEN SUM(CASE WHEN abs(w.cycle - o.cycle) = 2 THEN w.y / 2 ELSE w.y END) / 4 END FROM o w
  WHERE w.categoria_normalizada = o.categoria_normalizada AND abs(w.cycle - o.cycle) <= 2) AS tr FROM o),
s AS (SELECT *, AVG(y - tr) OVER (PARTITION BY categoria_normalizada, cycle % 4) AS se FROM t)
SELECT categoria_normalizada, cycle, {rnd('y', 4)} AS value, {rnd('tr', 4)} AS trend, {rnd('se', 4)} AS seasonal, {rnd('y - tr - se', 4)} AS residual FROM s"""))
def d20_even(spark, d):
    return TR.decompose(products(spark, d).where("cycle <> 4"), "categoria_normalizada", "cycle", 4)  # a missing cycle


@query("d21_trend_slope", on_products(f"WITH {G} SELECT categoria_normalizada, {rnd('regr_slope(y, cycle)', 4)} AS slope FROM g GROUP BY 1"))
def d21(spark, d):
    return TR.trend_slope(products(spark, d), "categoria_normalizada", "cycle")


@query("d22_introductions", on_products("SELECT cycle, COUNT(*) AS new_products FROM (SELECT codigo, MIN(cycle) AS cycle FROM p GROUP BY 1) GROUP BY 1"))
def d22(spark, d):
    return TR.introductions(products(spark, d))


@query("d23_lifecycle", on_products("""WITH s AS (SELECT codigo, MIN(cycle) AS first_cycle, MAX(cycle) AS last_cycle, COUNT(DISTINCT cycle) AS cycles FROM p GROUP BY 1)
SELECT *, CASE WHEN first_cycle = (SELECT MAX(cycle) FROM p) THEN 'new' WHEN last_cycle < (SELECT MAX(cycle) FROM p) THEN 'retired'
  WHEN cycles = last_cycle - first_cycle + 1 THEN 'continuous' ELSE 'intermittent' END AS stage FROM s"""))
def d23(spark, d):
    return TR.lifecycle(products(spark, d))


@query("d24_kpis", on_features(f"""WITH c AS (SELECT brand, categoria_normalizada, COUNT(*) AS n FROM f GROUP BY 1, 2),
t AS (SELECT brand, {rnd('100.0 * SUM(n) FILTER (WHERE r <= 3) / SUM(n)')} AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, categoria_normalizada) AS r FROM c) GROUP BY 1)
SELECT brand, {rnd(PCT('promocao_ativa'))} AS promotion_rate, {rnd('AVG(desconto_calculado) FILTER (WHERE desconto_calculado > 0)')} AS avg_discount,
  MIN(top_share) AS top_share, {rnd('(AVG(preco_regular) / (SELECT AVG(preco_regular) FROM f) - 1) * 100', 4)} AS price_premium,
  {rnd(msum('economia') + ' / ' + msum('preco_regular') + ' * 100', 4)} AS savings_intensity FROM f JOIN t USING (brand) GROUP BY 1"""))
def d24(spark, d):
    return KP.kpis(featured(spark, d))


SCALED = ", ".join(rnd(f"({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER ()", 4) + f" AS {c}_scaled" for c in CL.FEATURES)


@query("m01_standardize", on_features(f"""SELECT pagina, pos, {SCALED} FROM f
  WHERE preco_regular IS NOT NULL AND desconto_calculado IS NOT NULL AND volume_numeric IS NOT NULL"""))
def m01(spark, d):
    out = CL.standardize(featured(spark, d))
    return out.select("pagina", "pos", *[rounded(F.col(f"{c}_scaled"), 4).alias(f"{c}_scaled") for c in CL.FEATURES])


SWEEP = dict(ks=range(2, 11), starts=10, rounds=CL.ROUNDS)


@query("m02_kmeans_sweep", on_features(f"""WITH {kmeans_sql(**SWEEP)},
l AS (SELECT i, a.k, a.cluster, x0, x1, x2, n, x0 * x0 + x1 * x1 + x2 * x2 AS q FROM a{SWEEP['rounds']} a JOIN won USING (k, s) JOIN pt USING (i)),
t AS (SELECT k, cluster, SUM(n) AS n, SUM(n * q) AS q, SUM(n * x0) AS s0, SUM(n * x1) AS s1, SUM(n * x2) AS s2 FROM l GROUP BY 1, 2),
d AS (SELECT l.i, l.k, l.n, any_value(t.n) FILTER (t.cluster = l.cluster) AS own,
  SUM(greatest(0, l.q * t.n - 2 * (x0 * s0 + x1 * s1 + x2 * s2) + t.q)) FILTER (t.cluster = l.cluster) AS a,
  MIN(greatest(0, l.q * t.n - 2 * (x0 * s0 + x1 * s1 + x2 * s2) + t.q) / t.n) FILTER (t.cluster <> l.cluster) AS b FROM l JOIN t USING (k) GROUP BY 1, 2, 3),
e AS (SELECT k, SUM(n * CASE WHEN own > 1 AND greatest(a / (own - 1), b) > 0 THEN (b - a / (own - 1)) / greatest(a / (own - 1), b) ELSE 0 END) / SUM(n) AS v FROM d GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, {rnd('cost', 4)} AS inertia, {rnd('v', 5)} AS silhouette_squared, v = (SELECT MAX(v) FROM e) AS best FROM won JOIN e USING (k)"""))
def m02(spark, d):
    out = CL.kmeans_sweep(featured(spark, d).select("pagina", "pos", *CL.FEATURES), **SWEEP)
    return out.withColumns({"inertia": rounded(F.col("inertia"), 4), "silhouette_squared": rounded(F.col("silhouette_squared"), 5)})


@query("m02_silhouette_sweep")
def m02_plain(spark, d):
    return CL.silhouette_sweep(featured(spark, d).select("pagina", "pos", *CL.FEATURES), **SWEEP)


@query("m03_kmeans", on_features(f"WITH {kmeans_sql([4], **ONE)}, {LABELLED} SELECT * FROM lab"))
def m03(spark, d):
    return CL.kmeans(featured(spark, d).select("pagina", "pos", *CL.FEATURES), 4, **ONE)


@query("m04_cluster_profiles", on_features(f"""WITH g AS (SELECT CAST(cycle AS INTEGER) AS cluster, COUNT(preco_regular) AS count, {rnd('AVG(preco_regular)')} AS avg_price,
  {rnd('AVG(desconto_calculado)')} AS avg_discount, {rnd('AVG(volume_numeric)')} AS avg_volume FROM f GROUP BY 1)
SELECT *, CASE WHEN avg_price < 50 THEN 'Budget' WHEN avg_price < 100 THEN 'Economy' WHEN avg_price < 200 THEN 'Premium' ELSE 'Luxury' END AS cluster_name FROM g"""))
def m04(spark, d):
    return CL.cluster_profiles(featured(spark, d).withColumn("cluster", F.col("cycle")))
