"""Documents, page responses, page selection, retry, streaming (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import projections as P, stats as S
from vitrine.plans.products import on_products, products
from vitrine.plans.registry import query, table
from vitrine.session import materialise, new_run_dir
from vitrine.sources import catalogs as C, pages as PG, responses as RS
from vitrine.streaming.ingest import compact, read_ingested, stream_pages

BRAND_RULES = [("aurora", "aurora"), ("brisa", "brisa")]
_WRITTEN: dict[tuple[str, str], str] = {}


def document_rows(spark, d):
    rule = F.struct(F.col("promo_type").alias("type"), F.lit(None).cast("string").alias("description"),
                    F.create_map().cast("map<string,string>").alias("conditions"), "discount_tiers", "combo_codes",
                    F.array().cast("array<int>").alias("related_pages"))
    alert = F.struct(F.lit("ERROR").alias("level"), F.lit("preco_promocional").alias("field"), F.lit("acima do regular").alias("message"),
                     F.col("preco_promocional").cast("string").alias("original_value"), F.lit(None).cast("string").alias("corrected_value"))
    return products(spark, d).withColumns({
        "pos": F.expr("pos div 100000000000000000"),  # the place on the page, first part of the number
        "regra_promocional": F.when(F.col("promo_type") != "none", rule),
        "alertas": F.when(F.col("preco_promocional") > F.col("preco_regular"), F.array(alert)).otherwise(F.array().cast("array<struct<level:string,field:string,message:string,original_value:string,corrected_value:string>>"))})


def global_rules(spark, d):
    """Two rules for each promotion type of a catalogue that differ in their page only."""
    types = products(spark, d).groupBy("source_file", F.col("promo_type").alias("type")).agg(F.min("pagina").alias("low"), F.max("pagina").alias("high"))
    return types.select("source_file", "type", F.lit(None).cast("string").alias("description"), F.create_map().cast("map<string,string>").alias("conditions"),
                        F.create_map().cast("map<string,double>").alias("discount_tiers"), F.array().cast("array<string>").alias("combo_codes"),
                        F.explode(F.array(F.array(F.col("low").cast("int")), F.array(F.col("high").cast("int"), F.col("low").cast("int")))).alias("related_pages"))


def headers(spark, d):
    return products(spark, d).groupBy("source_file", "brand", F.col("cycle").cast("string").alias("cycle")).agg(
        F.countDistinct("pagina").cast("int").alias("total_pages")).withColumns({
            "name": F.initcap("source_file"), "validity_start": F.expr("make_date(2024, cast(cycle as int), 1)"),
            "validity_end": F.expr("last_day(make_date(2024, cast(cycle as int), 1))"),
            "pages_processed": F.col("total_pages"), "pages_with_errors": F.array().cast("array<int>")})


def written(spark, d):
    """Folder with the documents of all catalogues, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        path = new_run_dir(spark, "documents")
        C.write_catalogs(document_rows(spark, d), headers(spark, d), path, global_rules(spark, d), compression="gzip")
        _WRITTEN[key] = path
    return _WRITTEN[key]


@query("s01_read_catalogs", on_products("""SELECT source_file, brand, cycle, pagina, codigo, nome, linha, categoria, preco_regular,
  preco_promocional, economia, promocao_ativa, promo_type, CAST(len(combo_codes) AS INTEGER) AS combos, COALESCE(feature_len, 0) AS features,
  CASE WHEN preco_promocional > preco_regular THEN 1 ELSE 0 END AS alert_count FROM p"""))
def s01(spark, d):
    df = C.read_catalogs(spark, written(spark, d), "lines", BRAND_RULES, "none")
    return df.select("source_file", "brand", "cycle", F.col("pagina").cast("long").alias("pagina"), "codigo", "nome", "linha",
                     "categoria", "preco_regular", "preco_promocional", "economia", "promocao_ativa", "promo_type",
                     F.size("combo_codes").alias("combos"), F.coalesce(F.size("caracteristicas"), F.lit(0)).alias("features"), "alert_count")


@query("s02_discover", on_products("SELECT brand, COUNT(DISTINCT source_file) AS catalogs, COUNT(*) AS products FROM p GROUP BY brand"))
def s02(spark, d):
    path = new_run_dir(spark, "nested")  # two folders below the one that is read
    C.write_catalogs(document_rows(spark, d).where("brand = 'aurora'"), headers(spark, d), f"{path}/deep/er/a", compression="gzip")
    C.write_catalogs(document_rows(spark, d).where("brand = 'brisa'"), headers(spark, d), f"{path}/b", compression="gzip")
    return C.read_catalogs(spark, path, "lines", BRAND_RULES, "none").groupBy("brand").agg(F.countDistinct("source_file").alias("catalogs"), F.count(F.lit(1)).alias("products"))


@query("s05_headers", on_products("""SELECT source_file, brand, cycle, CAST(COUNT(DISTINCT pagina) AS INTEGER) AS total_pages,
  CAST(make_date(2024, cycle, 1) AS VARCHAR) AS validity_start, CAST(last_day(make_date(2024, cycle, 1)) AS VARCHAR) AS validity_end FROM p GROUP BY 1, 2, 3"""))
def s05(spark, d):
    h = C.read_catalog_headers(spark, written(spark, d), "lines", BRAND_RULES, "none")
    return h.select("source_file", "brand", "cycle", "total_pages", F.col("validity_start").cast("string").alias("validity_start"),
                    F.col("validity_end").cast("string").alias("validity_end"))


@query("s06_write_catalogs", on_products("""SELECT source_file, COUNT(*) AS total_products, COUNT(*) FILTER (WHERE promocao_ativa) AS products_with_promotion,
  array_to_string(list_sort(list(DISTINCT categoria_normalizada)), ';') AS categories, COUNT(*) AS listed FROM p GROUP BY 1"""))
def s06(spark, d):
    docs = C.read_documents(spark, written(spark, d), "lines")
    return docs.groupBy("source_file").agg(
        F.max("document.statistics.total_products").alias("total_products"),
        F.max("document.statistics.products_with_promotion").alias("products_with_promotion"),
        F.max(F.array_join("document.statistics.categories", ";")).alias("categories"), F.sum(F.size("document.products")).cast("long").alias("listed"))


_NESTED: dict[tuple[str, str], str] = {}


def nested(spark, d):
    """Folder with one nested document a catalogue, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _NESTED:
        path = new_run_dir(spark, "nested")
        C.write_nested(document_rows(spark, d), headers(spark, d), path, global_rules(spark, d), whole=False, compression="gzip")
        _NESTED[key] = path
    return _NESTED[key]


@query("s06_nested_documents", on_products("""SELECT source_file, pagina, codigo, nome, preco_regular, preco_promocional, promo_type,
  preco_promocional > preco_regular AS flagged FROM p"""))
def s06_nested(spark, d):
    rows = C.read_catalogs(spark, nested(spark, d), "parts", BRAND_RULES, "none")
    return rows.select("source_file", F.col("pagina").cast("long").alias("pagina"), "codigo", "nome", "preco_regular", "preco_promocional", "promo_type",
                       F.when(F.col("preco_promocional").isNotNull() & F.col("preco_regular").isNotNull(), F.size("alertas") > 0).alias("flagged"))


@query("s06_nested_order", on_products("""SELECT source_file, pagina, COUNT(*) AS listed, CAST(MIN(place) AS INTEGER) AS first_place, CAST(MAX(place) AS INTEGER) AS last_place
  FROM (SELECT source_file, pagina, row_number() OVER (PARTITION BY source_file ORDER BY pagina) - 1 AS place FROM p) GROUP BY 1, 2"""))
def s06_nested_order(spark, d):
    rows = C.read_catalogs(spark, nested(spark, d), "parts", BRAND_RULES, "none")
    return rows.groupBy("source_file", F.col("pagina").cast("long").alias("pagina")).agg(
        F.count(F.lit(1)).alias("listed"), F.min("pos").alias("first_place"), F.max("pos").alias("last_place"))


@query("s06_global_rules", on_products("""SELECT source_file, promo_type AS type, unnest([1, 2]) AS pages, CAST(unnest([MIN(pagina), MAX(pagina)]) AS INTEGER) AS first_page
  FROM p GROUP BY 1, 2"""))
def s06_rules(spark, d):
    rules = C.read_global_rules(spark, written(spark, d), "lines")
    return rules.select("source_file", "type", F.size("related_pages").alias("pages"), F.col("related_pages")[0].alias("first_page"))


@query("s06_round_trip", on_products("""SELECT source_file, pagina, codigo, preco_regular, preco_promocional, promo_type, 'ERROR' AS level,
  'preco_promocional' AS field, 'acima do regular' AS message FROM p WHERE preco_promocional > preco_regular"""))
def s06_alerts(spark, d):
    rows = C.read_catalogs(spark, written(spark, d), "lines", BRAND_RULES, "none")
    each = rows.select("source_file", F.col("pagina").cast("long").alias("pagina"), "codigo", "preco_regular", "preco_promocional", "promo_type", F.explode("alertas").alias("a"))
    return each.select("source_file", "pagina", "codigo", "preco_regular", "preco_promocional", "promo_type", "a.level", "a.field", "a.message")


@query("s07_flat_csv", on_products("""SELECT codigo, nome, COALESCE(linha, '-') AS linha, categoria_normalizada, COALESCE(volume_peso, '-') AS volume_peso,
  preco_regular, preco_promocional, economia, desconto_percentual, promocao_ativa, promo_type, brand, cycle, pagina FROM p"""))
def s07(spark, d):
    path = new_run_dir(spark, "csv")
    frame = C.export_frame(products(spark, d))
    C.write_flat_csv(products(spark, d), path)
    return spark.read.schema(frame.schema).option("header", "true").csv(path)


_ANSWERS: dict[tuple[str, str], DataFrame] = {}


def responses(spark, d):
    """Stored page answers, derived once per session from the product rows."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ANSWERS:
        _ANSWERS[key] = materialise(derive_responses(spark, d), "responses", compression="zstd")
    return _ANSWERS[key]


def derive_responses(spark, d):
    """A page answer per product row: every tenth kind of fault is worked in by position."""
    kind = F.col("pos") % 10
    p = products(spark, d).withColumn("kind", kind)
    rule = F.struct(
        F.when(F.col("kind") == 8, F.upper(F.replace(F.col("promo_type"), F.lit("_"), F.lit(" ")))).otherwise(F.col("promo_type")).alias("tipo"),
        F.lit("regra").alias("descricao"), "discount_tiers", "combo_codes")

    def page(price):
        item = F.struct(
            F.when(F.col("kind") != 6, F.col("codigo_raw")).alias("codigo"), F.when(F.col("kind") != 5, F.col("nome")).alias("nome"),
            "linha", F.col("categoria_raw").alias("categoria"), "volume_peso", price.alias("preco_regular"), "preco_promocional",
            "promocao_ativa", F.when(F.col("promo_type") != "none", rule).alias("regra_promocional"),
            F.coalesce("caracteristicas", F.array().cast("array<string>")).alias("caracteristicas"), F.lit("A1").alias("quadrante"))
        rules = F.array(
            F.struct(F.lit("Combo").alias("tipo"), F.lit("todas").alias("descricao"), F.array(F.lit(1), F.lit(2)).alias("paginas_relacionadas")),
            F.struct(F.lit(None).cast("string").alias("tipo"), F.lit("sem tipo").alias("descricao"), F.array(F.lit(3)).alias("paginas_relacionadas")))
        kind_of_page = F.when(F.col("kind") == 1, "publicidade").otherwise("produtos")
        return F.to_json(F.struct(kind_of_page.alias("tipo_pagina"), F.array(item).alias("itens"), rules.alias("regras_globais")), {"ignoreNullFields": "false"})

    price = F.when(F.col("kind") == 7, -F.col("preco_regular")).otherwise(F.col("preco_regular"))
    text = F.when(F.col("kind") == 4, page(F.col("preco_text"))).otherwise(page(price))
    raw = (
        F.when(F.col("kind") == 0, F.substring(text, 1, 40))
        .when(F.col("kind") == 2, F.concat(F.lit("```json\n"), text, F.lit("\n```\n")))
        .when(F.col("kind") == 3, F.concat(F.lit("```"), text, F.lit("```"))).otherwise(text))
    return p.select(F.concat_ws("#", "source_file", "pagina").alias("source_file"), F.col("pos").alias("page_number"), raw.alias("raw_response"))


PAGE_SQL = """i AS (SELECT *, source_file || '#' || pagina AS file, pos % 10 AS kind,
  CASE WHEN pos % 10 = 4 THEN CASE WHEN preco_text = 'n/a' THEN 0.0 ELSE preco_regular END WHEN pos % 10 = 7 THEN -preco_regular ELSE preco_regular END AS price FROM p)"""


@query("s08_parse_responses", on_products(f"WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number, kind <> 0 AS success, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'publicidade' ELSE 'produtos' END AS page_type FROM i"))
def s08(spark, d):
    return RS.parse_page_responses(responses(spark, d)).select("source_file", "page_number", "success", "page_type")


ITEM_SQL = f"""WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number, CASE WHEN kind = 6 THEN 'None' ELSE codigo END AS codigo, nome, linha,
  categoria_raw AS categoria, volume_peso, price AS preco_regular, preco_promocional, promocao_ativa, promo_type,
  CAST(len(tier_values) AS INTEGER) AS tiers, CAST(len(combo_codes) AS INTEGER) AS combos, COALESCE(feature_len, 0) AS features FROM i"""


def item_columns(df):
    r = F.col("regra_promocional")
    return df.select(
        "source_file", "page_number", "codigo", "nome", "linha", "categoria", "volume_peso", "preco_regular", "preco_promocional",
        "promocao_ativa", F.coalesce(r["type"], F.lit("none")).alias("promo_type"), F.coalesce(F.size(r["discount_tiers"]), F.lit(0)).alias("tiers"),
        F.coalesce(F.size(r["combo_codes"]), F.lit(0)).alias("combos"), F.size("caracteristicas").alias("features"))


@query("s09_items", on_products(ITEM_SQL + " WHERE kind NOT IN (0, 1, 5, 7)"))
def s09(spark, d):
    return item_columns(RS.split_valid(RS.explode_items(RS.parse_page_responses(responses(spark, d))))[0])


@query("s10_global_rules", on_products(f"WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number, 0 AS rule_pos, 'combo' AS type, 'todas' AS description, '1;2' AS pages FROM i WHERE kind NOT IN (0, 1)"))
def s10(spark, d):
    out = RS.explode_global_rules(RS.parse_page_responses(responses(spark, d)))
    return out.select("source_file", "page_number", F.col("pos").alias("rule_pos"), "type", "description",
                      F.array_join(F.col("related_pages").cast("array<string>"), ";").alias("pages"))


@query("s11_page_results", on_products(f"WITH {PAGE_SQL} SELECT split_part(file, '#', 1) AS source_file, COUNT(*) AS pages, COUNT(*) FILTER (WHERE kind <> 0) AS pages_processed, COUNT(*) FILTER (WHERE kind = 0) AS pages_failed FROM i GROUP BY 1"))
def s11(spark, d):
    results = RS.page_results(RS.parse_page_responses(responses(spark, d)))
    return S.page_summary(results.withColumn("source_file", F.substring_index("source_file", "#", 1)))


@query("s12_rejected_items", on_products(f"WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number, CASE kind WHEN 5 THEN 'nome' ELSE 'preco_regular' END AS reject_reason FROM i WHERE kind IN (5, 7)"))
def s12(spark, d):
    return RS.split_valid(RS.explode_items(RS.parse_page_responses(responses(spark, d))))[1].select("source_file", "page_number", "reject_reason")


@query("s13_select_pages", on_products("SELECT pagina, pos, codigo FROM p WHERE pagina BETWEEN 1 AND 100 OR pagina BETWEEN 90 AND 2000 OR pagina IN (2500, 3000)"))
def s13(spark, d):
    return PG.select_pages(products(spark, d), "1-100,2500,90-2000, 3000", "pagina").select("pagina", "pos", "codigo")


def retried(spark, d):
    """Pages of a first run and their outcomes, and those of a second run: failed pages with an even rest come out whole
    this time. Outcomes are stored, as what is asked of them would parse every answer again each time."""
    parsed = RS.parse_page_responses(responses(spark, d))
    results = materialise(RS.page_results(parsed), "results")
    again = results.where(~F.col("success") & (F.col("page_number") % 20 == 0)).select(
        "source_file", "page_number", F.lit('{"itens": [{"codigo": 77, "nome": "de novo", "preco_regular": "R$ 1.234,56"}]}').alias("raw_response"))
    second = RS.parse_page_responses(again)
    return parsed, results, second, materialise(RS.page_results(second), "results")


@query("s14_merge_retry", on_products(f"WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number, CASE kind WHEN 0 THEN '00077' WHEN 6 THEN 'None' ELSE codigo END AS codigo, CASE kind WHEN 0 THEN 1234.56 ELSE price END AS preco_regular FROM i WHERE kind NOT IN (0, 1, 5, 7) OR pos % 20 = 0"))
def s14(spark, d):
    first, results, second, second_results = retried(spark, d)
    merged, _, _ = PG.merge_retry(
        RS.split_valid(RS.explode_items(first))[0], results, RS.split_valid(RS.explode_items(second))[0], second_results)
    return merged.select("source_file", "page_number", "codigo", "preco_regular")


@query("s14_still_failed", on_products(f"WITH {PAGE_SQL} SELECT file AS source_file, pos AS page_number FROM i WHERE kind = 0 AND pos % 20 <> 0"))
def s14b(spark, d):
    first, results, second, second_results = retried(spark, d)
    return PG.merge_retry(RS.explode_items(first), results, RS.explode_items(second), second_results)[2]


def listing(spark, d):
    s = table(spark, d, "supplier")
    files = s.select(F.concat("s_name", F.lit(".pdf")).alias("name"))
    done = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("cat_"), "s_name", F.lit("_20240101_120000.json")).alias("name"))
    return files, done


@query("s15_pending_inputs", """SELECT s_name || '.pdf' AS name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier x
  WHERE x.s_suppkey % 3 = 0 AND contains('cat_' || x.s_name || '_20240101_120000.json', s.s_name))""")
def s15(spark, d):
    files, done = listing(spark, d)
    return PG.pending_inputs(files, done)


@query("s16_batch_outcome", """SELECT COUNT(*) FILTER (WHERE s_suppkey % 3 = 1) AS processed, COUNT(*) FILTER (WHERE s_suppkey % 3 = 0) AS skipped,
  COUNT(*) FILTER (WHERE s_suppkey % 3 = 2) AS failed FROM supplier""")
def s16(spark, d):
    files, done = listing(spark, d)
    results = table(spark, d, "supplier").select(F.concat("s_name", F.lit(".pdf")).alias("name"), (F.col("s_suppkey") % 3 == 1).alias("success"))
    return PG.batch_outcome(files, done, results)


def send(answers, path, files):
    """Appends the answers in so many files without a shuffle, or with one where they lie in fewer pieces; of row groups that
    several tasks can read."""
    dealt = answers.coalesce(files) if answers.rdd.getNumPartitions() >= files else answers.repartition(files)
    dealt.write.mode("append").option("parquet.block.size", 1 << 22).parquet(path, compression="zstd")


@query("s17_stream_pages", on_products(ITEM_SQL + " WHERE kind NOT IN (0, 1, 5, 7)"))
def s17(spark, d):
    run = new_run_dir(spark, "stream")
    send(responses(spark, d), f"{run}/in", 6)
    stream_pages(spark, f"{run}/in", f"{run}/out", f"{run}/progress", files_per_batch=2)
    return item_columns(RS.split_valid(read_ingested(spark, f"{run}/out")[0])[0])


@query("s17_compacted_pages", on_products(ITEM_SQL + " WHERE kind NOT IN (0, 1, 5, 7)"))
def s17_compacted(spark, d):
    """Half of the pages are ingested and compacted; then come the others, and some of the first again."""
    run = new_run_dir(spark, "stream")
    answers = responses(spark, d)
    half = F.pmod(F.hash("source_file", "page_number"), F.lit(4))
    send(answers.where(half < 2), f"{run}/in", 3)
    stream_pages(spark, f"{run}/in", f"{run}/out", f"{run}/progress", files_per_batch=2)
    compact(spark, f"{run}/out")
    send(answers.where(half >= 1), f"{run}/in", 3)
    stream_pages(spark, f"{run}/in", f"{run}/out", f"{run}/progress", files_per_batch=2)
    return item_columns(RS.split_valid(read_ingested(spark, f"{run}/out")[0])[0])


@query("s18_union_catalogs", on_products("SELECT brand, pagina, pos, codigo, CASE WHEN brand = 'aurora' THEN linha END AS linha FROM p"))
def s18(spark, d):
    p = products(spark, d).select("brand", "pagina", "pos", "codigo", "linha")
    return P.union_catalogs(p.where("brand = 'aurora'"), p.where("brand = 'brisa'").drop("linha"))
