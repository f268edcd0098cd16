"""Baskets, combos, semi-joins and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import constants as K
from vitrine.operators import baskets as B, clusters as CL, itemsets as I
from vitrine.plans.products import on_features, on_products, products, products_with, featured
from vitrine.plans.registry import query, rnd, table

PAGE = ["source_file", "pagina"]


@query("m12_baskets", on_products("""SELECT source_file, pagina, codigo, basket_size FROM (SELECT source_file, pagina, codigo,
  COUNT(*) OVER (PARTITION BY source_file, pagina) AS basket_size FROM p) WHERE basket_size > 1"""))
def m12(spark, d):
    return B.baskets(products(spark, d), PAGE, "codigo")


PAIRS = {
    "page": """g AS (SELECT source_file, pagina FROM p GROUP BY 1, 2 HAVING COUNT(*) > 1),
c AS (SELECT DISTINCT source_file, pagina, promo_type AS k FROM p JOIN g USING (source_file, pagina)),""",
    "code": """g AS (SELECT source_file, pagina FROM p GROUP BY 1, 2 HAVING COUNT(*) > 1),
c AS (SELECT DISTINCT x.source_file, x.pagina, y.promo_type AS k FROM p x JOIN g USING (source_file, pagina) JOIN p y ON x.codigo = y.codigo),""",
}
PAIR_TAIL = " pairs AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS count FROM c a JOIN c b ON a.source_file = b.source_file AND a.pagina = b.pagina AND a.k < b.k GROUP BY 1, 2)"


@query("m13_category_pairs_page", on_products("WITH " + PAIRS["page"] + PAIR_TAIL + " SELECT * FROM pairs"))
def m13(spark, d):
    return B.category_pairs(products(spark, d), "promo_type", "page")


@query("m13_category_pairs_code", on_products("WITH " + PAIRS["code"] + PAIR_TAIL + " SELECT * FROM pairs ORDER BY count DESC, a, b LIMIT 15"))
def m13b(spark, d):
    p = products_with(spark, d, [*PAGE, "codigo", "promo_type"], stored=True)
    return B.top_pairs(B.category_pairs(p, "promo_type", "code"), 15)


@query("m14_cooccurrence_matrix", on_products("WITH " + PAIRS["page"] + PAIR_TAIL + """, m AS (SELECT a, b, count FROM pairs UNION ALL SELECT b, a, count FROM pairs)
SELECT a AS category, """ + ", ".join(f"COALESCE(CAST(SUM(count) FILTER (WHERE b = '{t}') AS BIGINT), 0) AS {t}" for t in K.PROMO_TYPES) + " FROM m GROUP BY 1"))
def m14(spark, d):
    return B.cooccurrence_matrix(B.category_pairs(products(spark, d), "promo_type", "page"), K.PROMO_TYPES)


COMBO = ["codigo", "combo_codes", "promo_type", "brand", "categoria_normalizada"]
EDGES = "e AS (SELECT pagina, pos, codigo AS source, unnest(combo_codes) AS target, brand, categoria_normalizada AS category FROM p WHERE promo_type = 'combo')"


@query("a25_combo_edges", on_products(f"WITH {EDGES} SELECT source, target, brand, category FROM e"))
def a25(spark, d):
    return B.combo_edges(products_with(spark, d, COMBO))


@query("a26_combo_links", on_products(f"WITH {EDGES} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e"))
def a26(spark, d):
    return B.combo_graph(B.combo_edges(products_with(spark, d, COMBO)))[0]


@query("a26_combo_degree", on_products(f"""WITH {EDGES}, l AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e)
SELECT node, COUNT(*) AS degree FROM (SELECT a AS node FROM l UNION ALL SELECT b FROM l) GROUP BY 1"""))
def a26b(spark, d):
    return B.combo_graph(B.combo_edges(products_with(spark, d, COMBO)))[1]


@query("d07_combo_saving", on_products(f"""WITH {EDGES}, c AS (SELECT codigo, AVG(preco_regular) AS price FROM p GROUP BY 1)
SELECT e.pagina, e.pos, COUNT(*) AS members, COUNT(price) AS priced_members, {rnd('MIN(COALESCE(preco_promocional, preco_regular))')} AS bundle_price,
  CASE WHEN COUNT(*) = COUNT(price) THEN {rnd('SUM(price)')} END AS members_price,
  CASE WHEN COUNT(*) = COUNT(price) THEN {rnd('SUM(price) - MIN(COALESCE(preco_promocional, preco_regular))')} END AS saving
  FROM e LEFT JOIN c ON c.codigo = target AND c.codigo <> '7' JOIN p ON p.pagina = e.pagina AND p.pos = e.pos GROUP BY 1, 2"""))
def d07(spark, d):
    p = products(spark, d)
    unpriced = p.withColumn("preco_regular", F.when(F.col("codigo") != "7", F.col("preco_regular")))  # a member nobody knows the price of
    return B.combo_saving(unpriced, ["pagina", "pos"])


@query("d08_combo_pairs", on_products(f"""WITH {EDGES}, m AS (SELECT DISTINCT pagina, pos, target FROM e)
SELECT a.target AS a, b.target AS b, COUNT(*) AS count FROM m a JOIN m b ON a.pagina = b.pagina AND a.pos = b.pos AND a.target < b.target GROUP BY 1, 2"""))
def d08(spark, d):
    return B.combo_pairs(B.combo_edges(products(spark, d), ["pagina", "pos"]), ["pagina", "pos"])


RULES = """m AS (SELECT DISTINCT pagina, linha AS k FROM p WHERE linha IS NOT NULL),
n AS (SELECT COUNT(DISTINCT pagina) AS n FROM m), c AS (SELECT k, COUNT(*) AS nk FROM m GROUP BY 1),
q AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS count FROM m a JOIN m b ON a.pagina = b.pagina AND a.k <> b.k GROUP BY 1, 2)"""


@query("d18_association_rules", on_products(f"""WITH {RULES} SELECT a AS antecedent, b AS consequent, count, {rnd('count / n.n', 4)} AS support,
  {rnd('count / x.nk', 4)} AS confidence, {rnd('(count / x.nk) / (y.nk / n.n)', 4)} AS lift
  FROM q JOIN c x ON x.k = a JOIN c y ON y.k = b, n WHERE count / n.n >= 0.002 AND count / x.nk >= 0.05"""))
def d18(spark, d):
    return B.association_rules(products(spark, d), ["pagina"], "linha", 0.002, 0.05)


@query("d18_frequent_itemsets", on_products(f"""WITH {RULES}, r AS (SELECT a.k AS a, b.k AS b, e.k AS e, COUNT(*) AS count FROM m a JOIN m b ON a.pagina = b.pagina AND a.k < b.k
    JOIN m e ON e.pagina = b.pagina AND b.k < e.k GROUP BY 1, 2, 3)
SELECT k AS items, nk AS count FROM c, n WHERE nk / n.n >= 0.004 UNION ALL SELECT a || ';' || b, count FROM q, n WHERE a < b AND count / n.n >= 0.004
UNION ALL SELECT a || ';' || b || ';' || e, count FROM r, n WHERE count / n.n >= 0.004"""))
def d18b(spark, d):
    out = I.frequent_itemsets(products(spark, d), ["pagina"], "linha", 0.004, 3)
    return out.select(F.array_join("items", ";").alias("items"), "count")


FOURS = f"""{RULES}, r AS (SELECT a.pagina, a.k AS a, b.k AS b, e.k AS e FROM m a JOIN m b ON a.pagina = b.pagina AND a.k < b.k JOIN m e ON e.pagina = b.pagina AND b.k < e.k),
i AS (SELECT [k] AS items, nk AS count FROM c UNION ALL SELECT [a, b], count FROM q WHERE a < b
  UNION ALL SELECT [a, b, e], COUNT(*) FROM r GROUP BY 1
  UNION ALL SELECT [a, b, e, k], COUNT(*) FROM r JOIN m ON m.pagina = r.pagina AND e < k GROUP BY 1),
o AS (SELECT items, count FROM i, n WHERE count / n.n >= {{0}})"""


@query("d18_itemsets_of_four", on_products(f"WITH {FOURS.format(0.0004)} SELECT array_to_string(items, ';') AS items, len(items) AS size, count FROM o"))
def d18c(spark, d):
    out = I.frequent_itemsets(products(spark, d), ["pagina"], "linha", 0.0004, 4)
    return out.select(F.array_join("items", ";").alias("items"), F.size("items").cast("long").alias("size"), "count")


@query("d18_itemset_rules", on_products(f"""WITH {FOURS.format(0.0004)},
s AS (SELECT items, count, unnest(range(1, CAST(2 ** len(items) AS BIGINT) - 1)) AS mask FROM o WHERE len(items) > 1),
t AS (SELECT count, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS antecedent, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS consequent FROM s)
SELECT array_to_string(antecedent, ';') AS antecedent, array_to_string(consequent, ';') AS consequent, t.count, {rnd('t.count / n.n', 4)} AS support,
  {rnd('t.count / x.count', 4)} AS confidence, {rnd('(t.count / x.count) / (y.count / n.n)', 4)} AS lift
FROM t JOIN o x ON x.items = antecedent JOIN o y ON y.items = consequent, n WHERE len(antecedent) <= 3 AND t.count / x.count >= 0.1"""))
def d18d(spark, d):
    out = I.itemset_rules(products(spark, d), ["pagina"], "linha", 0.0004, 0.1)
    return out.withColumns({c: F.array_join(c, ";") for c in ("antecedent", "consequent")})


@query("j07_rows_on_page", on_products("""SELECT pagina, pos, codigo FROM p WHERE codigo IN (SELECT DISTINCT lpad(CAST(l_partkey AS VARCHAR), 5, '0')
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""))
def j07(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("pagina"))
    p = products(spark, d).select("pagina", "pos", "codigo")
    codes = p.join(urgent, "pagina", "left_semi").select("codigo").distinct()
    return p.join(codes, "codigo", "left_semi").select("pagina", "pos", "codigo")


@query("j08_combo_members", on_products(f"""WITH {EDGES}, c AS (SELECT codigo, MIN(nome) AS nome, {rnd('AVG(preco_regular)')} AS price FROM p GROUP BY 1)
SELECT e.pagina, e.pos, source, target, nome, price FROM e JOIN c ON c.codigo = target"""))
def j08(spark, d):
    from vitrine.functions.numbers import rounded
    p = products(spark, d)
    known = p.groupBy(F.col("codigo").alias("target")).agg(F.min("nome").alias("nome"), rounded(F.avg("preco_regular")).alias("price"))
    return B.combo_edges(p, ["pagina", "pos"]).join(known, "target").select("pagina", "pos", "source", "target", "nome", "price")


@query("j09_cluster_names", on_features("""WITH c AS (SELECT pagina, pos, cycle AS cluster, preco_regular FROM f),
n AS (SELECT cluster, ROUND(CAST(AVG(preco_regular) AS DECIMAL(38,6)), 2) AS a FROM c GROUP BY 1)
SELECT pagina, pos, cluster, CASE WHEN a < 50 THEN 'Budget' WHEN a < 100 THEN 'Economy' WHEN a < 200 THEN 'Premium' ELSE 'Luxury' END AS cluster_name FROM c JOIN n USING (cluster)"""))
def j09(spark, d):
    f = featured(spark, d).withColumn("cluster", F.col("cycle"))
    return CL.with_cluster_name(f, CL.cluster_profiles(f)).select("pagina", "pos", "cluster", "cluster_name")
