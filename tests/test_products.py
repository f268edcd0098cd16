"""The product table derived from order lines and parts."""

import datetime

from vitrine.plans import QUERIES
from vitrine.plans.products import derive_products, products


def tables(spark, folder):
    lines = [(k, p, 7, n, 1000.0 * n, 0.05, 0.02, "N", "O", datetime.datetime(1996, k, 1)) for k in (1, 2) for n, p in enumerate([1, 1, 2, None, 9], 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(1, "a", "B1", "LARGE", 2, 1.0), (2, "b", "B2", "SMALL", 35, 1.0), (2, "b2", None, None, None, 1.0), (None, "c", "B3", "X", 4, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_part_columns_are_worked_out_once_a_part(spark, tmp_path):
    plan = derive_products(spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join " in line)
    texts = [i for i, line in enumerate(plan) if "regexp_extract" in line or "2x" in line]
    assert texts and min(texts) > join


def test_products_of_repeated_and_missing_parts(spark, tmp_path):
    rows = products(spark, tables(spark, tmp_path)).where("cycle = 1").collect()
    got = sorted((r["codigo"], r["nome"], r["categoria_raw"], r["volume_peso"], r["volume_numeric"], r["volume_unit"]) for r in rows if r["nome"] != "b2")
    assert got == [("00001", "a", "large", "2x2ml", 4.0, "ml")] * 2 + [("00002", "b", "SMAL", "35ml", 35.0, "ml")]
    assert [(r["codigo"], r["volume_numeric"]) for r in rows if r["nome"] == "b2"] == [("00002", None)]


def test_retries_parse_answers_for_their_items_alone(spark, tmp_path):
    plan = lambda name: QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    folder = tables(spark, tmp_path)
    assert "parse_json" not in plan("s14_still_failed")
    scans = [line for line in plan("s14_merge_retry").split("\n") if "raw_response" in line and "Relation" in line]
    assert len(scans) == 1


def test_queries_of_few_columns_work_out_no_others(spark, tmp_path):
    folder = tables(spark, tmp_path)
    for name, held, left_out in (("u02_duplicate_codes", "l_partkey", "l_extendedprice"), ("a26_combo_links", "l_discount", "l_extendedprice")):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        used = "".join(line for line in plan.split("\n") if "Relation " not in line)
        assert held in used and left_out not in used
    before = [sorted(map(str, QUERIES[n](spark, folder).collect())) for n in ("u02_duplicate_codes", "a26_combo_links", "a25_combo_edges", "m13_category_pairs_code")]
    assert before[0] == ["Row(codigo='00001', count=4)", "Row(codigo='00002', count=4)"]
    products(spark, folder).count()  # now the table is stored, and gives the same
    assert before == [sorted(map(str, QUERIES[n](spark, folder).collect())) for n in ("u02_duplicate_codes", "a26_combo_links", "a25_combo_edges", "m13_category_pairs_code")]
