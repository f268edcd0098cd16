"""Category matching and dimension upkeep (J), weak matches."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from vitrine.operators import categories as C
from vitrine.plans.products import on_products, products
from vitrine.plans.registry import query, table


def derived_dim(spark, d):
    """Dimension over the part table: types are masters, brands are synonyms of their first type."""
    part = table(spark, d, "part")
    masters = part.select(F.lit("master").alias("kind"), F.col("p_type").alias("term"), F.col("p_type").alias("master")).distinct()
    synonyms = part.groupBy(F.lit("synonym").alias("kind"), F.col("p_brand").alias("term")).agg(F.min("p_type").alias("master"))
    both = masters.unionByName(synonyms)
    # one row per word of a vocabulary, so a single ordering task is enough
    return both.select(
        (F.row_number().over(W.orderBy("kind", "term")) - 1).cast("long").alias("pos"),
        "kind", "term", F.lower("term").alias("term_lc"), "master")


def with_raw_category(df):
    """Raw category text: part type, mangled part type, or a brand in lower case."""
    return df.withColumn("cat_in", F.when(
        F.col("codigo_raw").cast("long") % 7 == 3, F.lower("linha")).otherwise(F.col("categoria_raw")))


DIM_SQL = """
x AS (SELECT *, CASE WHEN CAST(codigo_raw AS BIGINT) % 7 = 3 THEN lower(linha) ELSE categoria_raw END AS cat_in FROM p),
dim AS (SELECT row_number() OVER (ORDER BY kind, term) - 1 AS pos, * FROM (
  SELECT DISTINCT 'master' AS kind, p_type AS term, p_type AS master FROM part
  UNION ALL SELECT 'synonym', p_brand, MIN(p_type) FROM part GROUP BY p_brand)),
vals AS (SELECT DISTINCT cat_in FROM x WHERE cat_in <> ''),
direct AS (SELECT cat_in, kind, master FROM (SELECT cat_in, kind, master,
    row_number() OVER (PARTITION BY cat_in ORDER BY kind, pos) AS r FROM vals JOIN dim ON lower(trim(cat_in)) = lower(term)) WHERE r = 1),
scored AS (SELECT cat_in, term, master, pos, CAST(floor((greatest(length(cat_in), length(term))
    - levenshtein(lower(cat_in), lower(term))) * 100.0 / greatest(length(cat_in), length(term))) AS INTEGER) AS score
  FROM vals CROSS JOIN dim WHERE cat_in NOT IN (SELECT cat_in FROM direct)),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY cat_in ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored),
mapping AS (SELECT cat_in, master, CASE kind WHEN 'master' THEN 'exact' ELSE 'synonym' END AS stage, 100 AS score FROM direct
  UNION ALL SELECT cat_in, CASE WHEN score >= 75 THEN master ELSE 'Outros' END, CASE WHEN score >= 75 THEN 'fuzzy' ELSE 'none' END, score
  FROM best WHERE rank = 1)
"""


def on_dim(sql):
    body = sql.strip()
    return on_products("WITH " + DIM_SQL.strip() + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body))


@query("j01_exact_match", on_dim("SELECT cat_in, master FROM mapping WHERE stage = 'exact'"))
def j01(spark, d):
    found = C.match_categories(with_raw_category(products(spark, d)), "cat_in", derived_dim(spark, d), scorer="levenshtein")
    return found.where("stage = 'exact'").select("cat_in", "master")


@query("j02_synonym_match", on_dim("SELECT cat_in, master FROM mapping WHERE stage = 'synonym'"))
def j02(spark, d):
    found = C.match_categories(with_raw_category(products(spark, d)), "cat_in", derived_dim(spark, d), scorer="levenshtein")
    return found.where("stage = 'synonym'").select("cat_in", "master")


@query("j03_fuzzy_match", on_dim("SELECT cat_in, master, stage, score FROM mapping"))
def j03(spark, d):
    found = C.match_categories(with_raw_category(products(spark, d)), "cat_in", derived_dim(spark, d), scorer="levenshtein")
    return found.select("cat_in", "master", "stage", "score")


@query("j03_fuzzy_weighted")
def j03b(spark, d):
    return C.match_categories(with_raw_category(products(spark, d)), "cat_in", derived_dim(spark, d), scorer="weighted")


NAMES_SQL = """WITH v AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 2)) WHEN 1 THEN substr(p_name, 1, 5) || 'x' || substr(p_name, 6)
    ELSE replace(p_name, 'e', '') || ' s' END AS name FROM part),
d AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS pos, p_name AS term FROM (SELECT DISTINCT p_name FROM part)),
s AS (SELECT name, term, pos, CAST(floor((greatest(length(trim(name)), length(term)) - levenshtein(lower(trim(name)), lower(term))) * 100.0
    / greatest(length(trim(name)), length(term), 1)) AS INTEGER) AS score FROM v CROSS JOIN d)
"""


def mangled_names(spark, d):
    """Part names with a letter lost, put in, or several lost, and a dimension of all part names."""
    part = table(spark, d, "part")
    name = F.col("p_name")
    turn = F.col("p_partkey") % 3
    values = part.select(
        F.when(turn == 0, F.upper(F.expr("substr(p_name, 2)")))
        .when(turn == 1, F.concat(F.substring(name, 1, 5), F.lit("x"), F.expr("substr(p_name, 6)")))
        .otherwise(F.concat(F.replace(name, F.lit("e"), F.lit("")), F.lit(" s"))).alias("name")).distinct()
    # one row per word of a vocabulary, as in derived_dim
    dim = part.select(F.col("p_name").alias("term")).distinct().select(
        (F.row_number().over(W.orderBy("term")) - 1).cast("long").alias("pos"), F.lit("master").alias("kind"),
        "term", F.lower("term").alias("term_lc"), F.col("term").alias("master"))
    return values, dim


@query("j03_fuzzy_indexed", NAMES_SQL + """SELECT name, term, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, pos) AS r
  FROM s WHERE score >= 75) WHERE r = 1""")
def j03c(spark, d):
    values, dim = mangled_names(spark, d)
    return C.best_near_term(values, "name", dim).select("name", "term", "score")


@query("j03_near_terms", NAMES_SQL + "SELECT name, term, score FROM s WHERE score >= 85")
def j03d(spark, d):
    values, dim = mangled_names(spark, d)
    return C.near_terms(values, "name", dim, 85).select("name", "term", "score")


@query("j04_normalize_rows", on_dim("SELECT pagina, pos, COALESCE(master, 'Outros') AS normalized FROM x LEFT JOIN mapping USING (cat_in)"))
def j04(spark, d):
    rows = with_raw_category(products(spark, d)).select("pagina", "pos", "cat_in")
    return C.normalize_categories(rows, "cat_in", derived_dim(spark, d), "normalized", scorer="levenshtein").select(
        "pagina", "pos", "normalized")


@query("j05_upsert_synonyms", on_dim("""WITH n AS (SELECT DISTINCT p_type AS master, p_name AS term FROM part
  UNION SELECT p_type, upper(p_brand) FROM part UNION SELECT 'MISSING', p_name FROM part),
fresh AS (SELECT lower(term) AS low, min({'term': term, 'master': master}) AS s FROM n
  WHERE master IN (SELECT term FROM dim WHERE kind = 'master')
  AND lower(term) NOT IN (SELECT lower(term) FROM dim WHERE kind = 'synonym') GROUP BY 1)
SELECT pos, kind, term, master FROM dim UNION ALL
SELECT (SELECT MAX(pos) FROM dim) + row_number() OVER (ORDER BY low), 'synonym', s.term, s.master FROM fresh"""))
def j05(spark, d):
    part = table(spark, d, "part")
    new = part.select(F.col("p_type").alias("master"), F.col("p_name").alias("term")).union(
        part.select("p_type", F.upper("p_brand"))).union(part.select(F.lit("MISSING"), "p_name")).distinct()
    return C.upsert_synonyms(derived_dim(spark, d), new).select("pos", "kind", "term", "master")


@query("j05_add_categories", on_dim("""SELECT pos, kind, term, master FROM dim UNION ALL
SELECT (SELECT MAX(pos) FROM dim) + row_number() OVER (ORDER BY c_mktsegment), 'master', c_mktsegment, c_mktsegment
  FROM (SELECT DISTINCT c_mktsegment FROM customer)"""))
def j05b(spark, d):
    dim = derived_dim(spark, d)
    new = table(spark, d, "customer").select(F.col("c_mktsegment").alias("master")).union(
        table(spark, d, "part").select("p_type"))
    return C.add_categories(dim, new).select("pos", "kind", "term", "master")


@query("j06_synonyms_of", on_dim("SELECT term FROM dim WHERE kind = 'synonym' AND master = 'ECONOMY'"))
def j06(spark, d):
    return C.synonyms_of(derived_dim(spark, d), "ECONOMY")


@query("j06_dim_statistics", on_dim("SELECT master, COUNT(*) FILTER (WHERE kind = 'synonym') AS synonyms FROM dim GROUP BY 1"))
def j06b(spark, d):
    return C.dim_statistics(derived_dim(spark, d))


@query("d13_weak_matches", on_dim("""SELECT a.cat_in, a.score, a.master, b.score AS second_score, b.master AS second_master,
  a.score >= 75 AND a.score < 85 AS low_confidence, a.score - b.score < 5 AND a.master <> b.master AS ambiguous
  FROM best a JOIN best b ON a.cat_in = b.cat_in AND a.rank = 1 AND b.rank = 2
  WHERE (a.score >= 75 AND a.score < 85) OR (a.score - b.score < 5 AND a.master <> b.master)"""))
def d13(spark, d):
    dim = derived_dim(spark, d)
    rows = with_raw_category(products(spark, d))
    left = C.match_categories(rows, "cat_in", dim, scorer="levenshtein").where("stage IN ('fuzzy', 'none')")
    scored = C.score_categories(left, "cat_in", dim, "levenshtein", keep=2)
    return C.weak_matches(scored, "cat_in", 75, 85)
