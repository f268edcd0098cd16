"""Validation, correction and summary on the rows the reference's own tests use."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import categories as C, rules as V

COLS = ("codigo string, nome string, categoria string, categoria_normalizada string, volume_peso string, preco_regular double, "
        "preco_promocional double, economia double, promocao_ativa boolean, "
        "regra_promocional struct<type:string,description:string,discount_tiers:map<string,double>,combo_codes:array<string>>, pagina int")


def product(**kw):
    base = dict(codigo="12345", nome="Produto Teste", categoria=None, categoria_normalizada=None, volume_peso=None, preco_regular=100.0,
                preco_promocional=None, economia=None, promocao_ativa=False, regra_promocional=None, pagina=1)
    base.update(kw)
    return tuple(base.values())


def alerts(spark, **kw):
    df = spark.createDataFrame([product(**kw)], COLS)
    return [(a["level"], a["field"]) for a in V.validate(df).first()["alertas"]]


def test_valid_row(spark):
    got = alerts(spark, codigo="85675", nome="Creme Hidratante Corporal Cuide-se Bem", categoria="Hidratação", volume_peso="200ml",
                 preco_regular=69.9, preco_promocional=55.9, promocao_ativa=True)
    assert got == []


@pytest.mark.parametrize("row, want", [
    (dict(codigo=""), ("error", "codigo")),
    (dict(codigo="12A45"), ("warning", "codigo")),
    (dict(codigo="123"), ("warning", "codigo")),
    (dict(codigo="1234567"), ("warning", "codigo")),
    (dict(nome="AB"), ("error", "nome")),
    (dict(nome="Creme d'água"), ("info", "nome")),
    (dict(preco_regular=50.0, preco_promocional=60.0), ("error", "preco_promocional")),
    (dict(preco_regular=0.0), ("error", "preco_regular")),
    (dict(preco_regular=10000.5), ("warning", "preco_regular")),
    (dict(preco_promocional=10.0, promocao_ativa=True), ("warning", "preco_promocional")),
    (dict(preco_promocional=100.0), ("info", "preco_promocional")),
    (dict(preco_promocional=80.0, economia=25.0, promocao_ativa=True), ("warning", "economia")),
    (dict(volume_peso="avulso"), ("info", "volume_peso")),
    (dict(preco_promocional=80.0), ("info", "promocao_ativa")),
    (dict(regra_promocional=("progressive_discount", None, {}, [])), ("warning", "regra_promocional")),
    (dict(regra_promocional=("combo", None, {}, [])), ("warning", "regra_promocional")),
])
def test_each_rule(spark, row, want):
    assert want in alerts(spark, **row)


def test_name_rule_knows_accents(spark):
    assert alerts(spark, nome="Colônia Água 50% + Refil (kit)") == []


def test_auto_correct(spark):
    df = spark.createDataFrame([
        product(codigo="1", preco_regular=50.0, preco_promocional=70.0), product(codigo="2", preco_promocional=80.0),
        product(codigo="3", preco_promocional=80.0, economia=5.0, promocao_ativa=True)], COLS)
    a, b, c = V.auto_correct(df).orderBy("codigo").collect()
    assert (a["preco_regular"], a["preco_promocional"], a["economia"], a["promocao_ativa"]) == (70.0, 50.0, 20.0, False)
    assert [x["message"] for x in a["alertas"]] == ["Prices were swapped (promotional was higher than regular)"]
    assert (b["promocao_ativa"], b["economia"], b["alertas"]) == (True, 20.0, [])
    assert (c["promocao_ativa"], c["economia"]) == (True, 5.0)


def test_batch_takes_last_alerting_row_and_duplicates(spark):
    df = spark.createDataFrame([
        product(pagina=1, nome="AB"), product(pagina=2, volume_peso="avulso"), product(pagina=3), product(codigo="67890", pagina=4)], COLS)
    batch = V.validate_batch(V.validate(df), ["pagina"])
    assert {r["codigo"]: [(a["level"], a["field"]) for a in r["alerts"]] for r in batch.collect()} == {
        "12345": [("info", "volume_peso"), ("warning", "codigo")]}
    assert V.summary(batch).first().asDict() == {
        "products_with_issues": 1, "total_alerts": 2, "errors": 0, "warnings": 1, "info": 1}
    assert [tuple(r) for r in V.summary_by_field(batch).collect()] == [("codigo", 1), ("volume_peso", 1)]


CASES = [("Perfumaria", "Perfumaria"), ("PERFUMARIA", "Perfumaria"), (" perfumaria ", "Perfumaria"), ("Shampoo", "Cabelos"),
         ("batom", "Maquiagem"), ("Produtos para Cabelo", "Cabelos"), ("Rosto", "Skincare"), ("", "Outros"), (None, "Outros"), ("qqqqq", "Outros")]


def test_categories(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    out = C.normalize_categories(df, "c", C.category_dim(spark), "m").orderBy("i").collect()
    assert [r["m"] for r in out] == [m for _, m in CASES]


def test_dimension_upkeep(spark):
    dim = C.category_dim(spark)
    assert dim.where("kind = 'synonym'").count() == 117
    new = spark.createDataFrame([("Cabelos", "Topete"), ("Nowhere", "x"), ("Unhas", "shampoo")], "master string, term string")
    more = C.upsert_synonyms(dim, new)
    assert more.count() == dim.count() + 1
    assert [r[0] for r in more.where("term = 'Topete'").select("master").collect()] == ["Cabelos"]


def test_large_dimension_is_cut_into_pieces(spark):
    words = [f"categoria {i:05d}" for i in range(C.PIECE * 3)]
    dim = C.category_dim(spark, words, {})
    df = spark.createDataFrame([("categoria 00700x",), ("CATEGORIA 00001",)], "c string")
    out = C.normalize_categories(df, "c", dim, "m", scorer="levenshtein").collect()
    assert {r["c"]: r["m"] for r in out} == {"categoria 00700x": "categoria 00700", "CATEGORIA 00001": "categoria 00001"}


def test_category_alert_without_normalised_value(spark):
    df = spark.createDataFrame([product(categoria="qqqqq"), product(categoria="Shampoo")], COLS)
    out = V.validate(df, C.category_dim(spark)).orderBy("categoria").collect()
    assert sorted(len(r["alertas"]) for r in out) == [0, 1]


def test_pipeline_appends_alerts(spark):
    df = spark.createDataFrame([product(categoria="Shampoo", preco_regular=50.0, preco_promocional=70.0)], COLS)
    row = V.process_products(df, C.category_dim(spark)).first()
    assert row["categoria_normalizada"] == "Cabelos"
    assert [a["field"] for a in row["alertas"]] == ["preco_regular", "promocao_ativa"]


def test_rows_stay_where_they_are_when_few_categories_are_found(spark, capsys):
    dim = spark.createDataFrame([(1, "master", "Creams", "creams", "Creams")], "pos long, kind string, term string, term_lc string, master string")
    df = spark.range(100_000).select("id", F.when(F.col("id") % 50 > 0, F.lit("Creams")).otherwise(F.lit("zz9")).alias("raw"))
    out = C.normalize_categories(df, "raw", dim, "found", scorer="levenshtein")
    assert sorted(map(tuple, out.groupBy("raw", "found").count().collect())) == [("Creams", "Creams", 98_000), ("zz9", "Outros", 2_000)]
    out.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_alerts_of_a_code_of_any_size(spark, monkeypatch):
    # 400 rows of one code and a few of others, ten rows a task
    monkeypatch.setattr(V, "TASK_ROWS", 10, raising=False)
    alert = lambda i: [("info", "f", f"m{i}", None, None)] if i % 3 == 0 else []
    rows = [(("a", "b", None)[i % 3], None if i == 7 else "hot" if i < 400 else f"c{i % 40}", i // 2, i, alert(i)) for i in range(700)]
    df = spark.createDataFrame(rows, f"source_file string, codigo string, pagina int, pos int, alertas {V.ALERT.simpleString().join(['array<', '>'])}")
    want, each = {}, {}
    for s, c, _, i, a in rows:
        if c is not None:
            for found, k in ((want, c), (each, (s, c))):
                n, last = found.get(k, (0, []))
                found[k] = (n + 1, [x[2] for x in a] or last)
    full = lambda found: {k: last + [f"Duplicate product code found: {k if isinstance(k, str) else k[1]}"] * (n > 1) for k, (n, last) in found.items() if last or n > 1}
    got = {r["codigo"]: [a["message"] for a in r["alerts"]] for r in V.validate_batch(df, ["pagina", "pos"]).collect()}
    assert got == full(want)
    head, details = V.report(df, ["pagina", "pos"])
    assert {(r["source_file"], r["codigo"]): [a["message"] for a in r["alerts"]] for r in details.collect()} == full(each)
    assert sum(r["total_products"] for r in head.collect()) == 699
    parts = V._by_code(df.where("codigo <> 'hot'"), ["codigo"], F.count(F.lit(1))).rdd.getNumPartitions()
    assert parts >= 30
