"""URL filter: listed rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table. Its weights are one vector of fixed length, so they
can be sent to every task; no URL is shuffled for a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches

#: Labelled rows are brought to the driver for training, no more than this.
MOST_LABELLED = 20_000
BUCKETS = 1 << 16

#: Words of names that a block list holds, and of names that it does not.
BLOCK_WORDS = (
    "casinos onlinecasino pokerroom pokerstar bet betting bettor sportsbet slots slotmachine jackpot roulette blackjack bingo lottery "
    "lotto gamble gambling wager spammer spammers spamming bulkmail massmail linkfarms linkspam backlinks pill pillstore viagra "
    "cialis pharma meds xanax dietpill adults adultcams xxx porn pornhd sexcam sexchat nudes escort hookup webcamgirl adserver adserv "
    "adclick adsense banners popup popunder tracker tracking trackers clickbait pixeltag malware spyware trojan phishing phish keylogger "
    "ransom warez crack cracked keygen serials torrent nulled payday loans quickcash replica fakewatch counterfeit getrich cheapest "
    "cheaper freebie freecoins winner winbig prizes"
).split()
ALLOW_WORDS = (
    "news daily herald library museum school college garden weather recipes science history travel forum wiki music books health cycling "
    "astronomy station nation mountain river thunder weather theatre theory mathematics other brother earth north south letters "
    "writing reading teaching learning painting sailing fishing hiking running cooking baking engine motion fashion ocean island "
    "village station education information tradition translation hospital doctor nature forest animal birds butterfly flowers tree "
    "kitchen bread cheese coffee tea orchard harvest farmer market bakery railway bridge harbour lantern window shelter timber stone "
    "paper pencil canvas violin piano choir orchestra ballet opera festival parish council ministry senate archive almanac journal "
    "gazette chronicle observer parent children family wedding holiday heritage castle cathedral"
).split()
PREFIXES = ("", "www.", "", "blog.", "m.", "", "shop.", "en.")
ENDINGS = ("com", "net", "org", "info", "co", "de")
PATHS = ("/", "/en/page", "/fr/12", "/de/77.html", "/es/5", "/about", "/item/903", "/2021/04/a-post", "/index.php", "", "/c/9.htm")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, 1 for block: names of one word, or of two joined or hyphened. Both classes
    have the same number of rows and the same prefixes, endings, paths and joints in turn, so only the words tell."""
    rows = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i in range(3 * max(len(BLOCK_WORDS), len(ALLOW_WORDS))):
            turn, at = divmod(i, len(words))
            second = words[(at * 7 + 11 * turn + 5) % len(words)]
            name = (words[at], f"{words[at]}-{second}", f"{words[at]}{second}")[i % 3]
            rows.append((f"http{'s' * (i // 2 % 2)}://{PREFIXES[i % len(PREFIXES)]}{name}.{ENDINGS[i % len(ENDINGS)]}{PATHS[i % len(PATHS)]}", label))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path as one text) and verdict of the longest of ``rules`` (verdict, host, path) that
    fits; of equally long ones the longer host, then block, then the first in order of text. Rules are a
    hand-kept list, so they become one expression."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in reversed(ranked):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams (3 to 5) of host and path, each marked with its part."""
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = part.encode()
        out += [zlib.crc32(mark.encode() + raw[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
    return out


def _design(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and values; each row has length one."""
    found = [np.unique(grams(h, p)) for h, p in rows]
    sizes = np.array([len(f) for f in found], int)
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate(found or [np.array([], int)]).astype(int), np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)


def train(labelled: DataFrame, url: str = "url", label: str = "label", steps: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression (1: block) over ``labelled``; rows with a null are left
    out. The table is small by contract: more than ``MOST_LABELLED`` rows are refused."""
    known = labelled.where(F.col(url).isNotNull()).select(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.col(label).cast("int").alias("y")).dropna()
    rows = sorted(known.limit(MOST_LABELLED + 1).collect())
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    at, bucket, value = _design([(r.h, r.p) for r in rows])
    y = np.array([r.y for r in rows], float)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps if len(rows) else 0):
        score = np.bincount(at, w[bucket] * value, len(rows)) + b
        off = (1 / (1 + np.exp(-score)) - y) / len(rows)
        w -= rate * (np.bincount(bucket, off[at] * value, BUCKETS) + decay * w)
        b -= rate * off.sum()
    return w.astype(np.float32), float(b)


def judge(
    pages: DataFrame, labelled: DataFrame, rules: Iterable[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url", bar: float = 0.5
) -> DataFrame:
    """``key, host, path, rule, verdict, score`` for every row of ``pages``.

    ``verdict`` (allow or block) is that of the rule, else block where ``score``, the probability of
    block, is at least ``bar``. A URL that is null or has no ``://`` has an empty host and path and is
    judged like any other. Repeated rows each give a row; other columns are left out.
    """
    spark = pages.sparkSession
    small_batches(spark, 10_000)
    model = spark.sparkContext.broadcast(train(labelled))

    @F.arrow_udf("double")
    def block(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        w, b = model.value
        at, bucket, value = _design(list(zip(hosts.to_pylist(), paths.to_pylist())))
        return pa.array(1 / (1 + np.exp(-(np.bincount(at, w[bucket] * value, len(hosts)) + b))), pa.float64())

    address = pages[f"`{url}`"]
    parts = pages.select(pages[f"`{key}`"].alias(key), host_of(address).alias("host"), path_of(address).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("verdict"), F.round(block("host", "path"), 6).alias("score"))
    own = F.when(F.col("score") >= bar, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", own))
