"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import align, chat, decontam, fim, langid, mixing, pii, ppm, quality, simhash, tokens, topk, urls
from vitrine.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from vitrine.plans.registry import table

#: Listed hosts and paths: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op1_simhash_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(urls.labelled_urls(), "url string, label int")
    return urls.judge(table(spark, sf_dir, "pages"), labelled, URL_RULES)


@query(
    "op6_exact_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, ["doc_id"], host=docs["source"])


@query("op4_source_mixing", mixing.mixing_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, made = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    named = ("source", "lang", "topic", "tokens", "weight", "probability", "sampled")
    return out.select("doc_id", *(out[made[n]].alias(n) for n in named))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_chat_format")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(table(spark, sf_dir, "conversations"))


@query("op11_lm_score")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 10 != 0
    out = ppm.score(docs, train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), *(c for c in out.columns if c not in ("doc_id", "train")))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path_a, path_b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), path_a, path_b)


@query("op13_fill_in_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents"), rate=50, spm_rate=80, seed=42))
