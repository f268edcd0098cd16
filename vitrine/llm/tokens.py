"""Token counts as the library for a word-level BPE file gives them, by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once. Tier two encodes a
pre-token that is not in it and keeps the length in a cache of the worker. Texts never leave their task,
and no pre-token is shuffled.

Cutting a text into pre-tokens here gives what the library's normaliser and splitter give for texts made
of the characters in ``PLAIN`` (for these, normal form C changes nothing and lower case is one to one). A
text with any other character, or with the string of an added token, is encoded by the library whole.
The table and the cache decide on speed only, never on a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, utf8

#: Characters for which the cut below is known to agree with the library.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E¡-įı-ňŊ-ž]*+")
#: Fixed: the splitter of the vocabulary file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Frequent pre-tokens in the broadcast table, and documents sampled to find them.
TABLE_ROWS = 20_000
SAMPLE_DOCS = 2_000
#: Pre-tokens a worker remembers before it starts afresh.
CACHE_ROWS = 200_000


class Lengths(dict):
    """Pre-token -> number of tokens; encodes and remembers what it does not hold."""

    def __init__(self, tokenizer, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tokenizer, self.table = tokenizer, table

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.table) + CACHE_ROWS:
            self.clear()
            self.update(self.table)
        self[word] = n = whole_count(self.tokenizer, word)
        return n


def whole_count(tokenizer, text: str) -> int:
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer, and the strings of its added tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def count(text: str, tokenizer, special: tuple[str, ...], lengths: Lengths) -> int:
    if not PLAIN.fullmatch(text) or any(s in text for s in special):
        return whole_count(tokenizer, text)
    return sum(map(lengths.__getitem__, PRE_TOKEN.findall(text.lower())))


def frequent_lengths(docs: DataFrame, path: str, text: str, table_rows: int, sample_docs: int, seed: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most ``sample_docs`` documents, drawn by hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for t in utf8(batch.column(0)):
                t = t.decode("utf-8", "replace")
                if PLAIN.fullmatch(t):
                    seen.update(PRE_TOKEN.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    some = docs.select(docs[f"`{text}`"].alias("text")).sample(share, seed)
    top = some.mapInArrow(cut, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    tokenizer, _ = load(path)
    return {r.word: whole_count(tokenizer, r.word) for r in top.orderBy(F.desc("n"), "word").limit(table_rows).collect()}


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
    table_rows: int = TABLE_ROWS, sample_docs: int = SAMPLE_DOCS, seed: int = 8,
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` names the tokenizer's file, which every worker can read. Null counts as empty: no bytes, no
    tokens. Repeated rows each give a row; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text, table_rows, sample_docs, seed))

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer, special = load(path)
        lengths = Lengths(tokenizer, table.value)
        for column in batches:
            yield pa.array([count(t.decode("utf-8", "replace"), tokenizer, special, lengths) for t in utf8(column)], pa.int64())

    whole = docs[f"`{text}`"]
    out = docs.select(docs[f"`{key}`"].alias(key), F.coalesce(F.octet_length(whole), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(whole).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
