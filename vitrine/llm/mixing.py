"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Tokens are summed by cell (source, language, topic). The cells' weights are raked until each marginal
has its target share, one dimension after the other, over again. The ratio of a cell's weight to its share
of all tokens is how much more or less of it is wanted; scaled so that the largest is one, it is the
probability with which each of the cell's documents is drawn, so the drawn tokens have the target shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cols, fresh, stored, text_or_empty

#: Topic of a text: the first whose words it holds (lower case), else the last.
TOPICS = [("legal", ("license", "copyright", "terms of")), ("table", (" | ",)), ("contact", ("@", "+1 ", "<email>", "<phone>"))]
OTHER_TOPIC = "prose"
#: Where no targets are given, a share of the corpus to this power, scaled to sum to one.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS = 8


def topic_of(text: Column) -> Column:
    low, out = F.lower(text), F.lit(OTHER_TOPIC)
    for name, words in reversed(TOPICS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key: repeated keys get the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on columns of the same name in which nulls are equal; the names appear once."""
    other = right.select(*(F.col(n).alias(f"{n}_r") for n in names), *(c for c in right.columns if c not in names))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_r"))
    return left.join(other, on).drop(*(f"{n}_r" for n in names))


def rake(cells: DataFrame, targets: dict[str, DataFrame], weight: str = "tokens", sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` with ``w``: weights with the target shares on each dimension.

    ``targets`` holds a table ``<dimension>, share`` for each; a value without a target gets none. The shares
    are put beside the cells once; each step is then a grouped sum and a join, written before the next, so
    that plans stay as small as in the first step.
    """
    now = cells.withColumn("w", F.col(weight).cast("double"))
    for name, target in targets.items():
        now = _joined(now, target.withColumnRenamed("share", f"share_{name}"), [name])
    now = stored(now, "cells")
    for _ in range(sweeps):
        for name in targets:
            sums = now.groupBy(name).agg(F.sum("w").alias("total"))
            scaled = F.when(F.col("total") > 0, F.col("w") * F.col(f"share_{name}") / F.col("total")).otherwise(0.0)
            now = stored(_joined(now, sums, [name]).withColumn("w", scaled).drop("total"), "cells")
    return now.drop(*(f"share_{name}" for name in targets))


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """Target shares of a dimension: shares of the tokens to a power, scaled to sum to one."""
    sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    total = sums.agg(F.sum(F.pow("n", F.lit(power))).alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(name, (F.pow("n", F.lit(power)) / F.col("total")).alias("share"))  # one row


def mix(
    docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None,
    targets: dict[str, dict] | None = None, sweeps: int = SWEEPS, seed: int = 4,
) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of ``docs`` and, for every row, source, language, topic, tokens, weight, probability
    and whether it is drawn; the frame and the names of these columns.

    ``topic`` names a column; without it the topic comes from the text. ``targets`` gives shares by value
    for dimensions ``source``, ``lang`` and ``topic``; a dimension left out gets the tempered shares of the
    corpus. Null is a value of its own. Tokens are words between blanks. A null text has none; a cell
    without tokens, or without a target, is never drawn. Repeated keys are drawn alike.
    """
    made = dict(zip(("source", "lang", "topic", "tokens", "draw", "weight", "probability", "sampled"), fresh(docs, *(f"mix_{n}" for n in ("source", "lang", "topic", "tokens", "draw", "weight", "probability", "sampled")))))
    whole = text_or_empty(docs[f"`{text}`"])
    table = docs.select(
        *cols(docs, *keep), docs[f"`{source}`"].alias(made["source"]), docs[f"`{lang}`"].alias(made["lang"]),
        (docs[f"`{topic}`"] if topic else topic_of(whole)).alias(made["topic"]), word_count(whole).alias(made["tokens"]),
        draw(docs[f"`{key}`"], seed).alias(made["draw"]),
    )
    if text not in keep:  # whole texts are rather read twice than written once more
        table = stored(table, "mix")
    dims = ("source", "lang", "topic")
    cells = table.groupBy(*(table[made[d]].alias(d) for d in dims)).agg(F.sum(made["tokens"]).alias("tokens"))
    cells, wanted = stored(cells, "cells"), {}
    for name in dims:
        given = (targets or {}).get(name)
        if given:
            present = cells.where("tokens > 0").select(name).distinct()
            shares = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{name} string, share double")
            shares = _joined(shares, present, [name])
            wanted[name] = stored(shares.crossJoin(F.broadcast(shares.agg(F.sum("share").alias("total")))).select(name, (F.col("share") / F.col("total")).alias("share")), "targets")
        else:
            wanted[name] = stored(tempered(cells, name, POWERS[name]), "targets")
    raked = rake(cells, wanted, "tokens", sweeps)
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    ratio = raked.crossJoin(F.broadcast(total)).select(*dims, F.when(F.col("tokens") > 0, F.col("w") * F.col("total") / F.col("tokens")).otherwise(0.0).alias("ratio"))
    most = ratio.agg(F.max("ratio").alias("most"))
    ratio = stored(ratio.crossJoin(F.broadcast(most)).select(
        *dims, F.round("ratio", 6).alias("ratio"), F.round(F.when(F.col("most") > 0, F.col("ratio") / F.col("most")).otherwise(0.0), 9).alias("chance")
    ), "cells")
    ratio = ratio.select(*(F.col(d).alias(f"{d}_c") for d in dims), F.col("ratio"), F.col("chance"))
    on = F.lit(True)
    for d in dims:
        on = on & table[made[d]].eqNullSafe(ratio[f"{d}_c"])
    out = table.join(ratio, on, "left").select(
        *(table[f"`{c}`"] for c in keep), *(table[made[n]] for n in ("source", "lang", "topic", "tokens")),
        F.coalesce(ratio["ratio"], F.lit(0.0)).alias(made["weight"]), F.coalesce(ratio["chance"], F.lit(0.0)).alias(made["probability"]),
        (table[made["draw"]] < F.coalesce(ratio["chance"], F.lit(0.0))).alias(made["sampled"]),
    )
    return out, made


def sampled(docs: DataFrame, **more) -> DataFrame:
    """The drawn rows of ``docs``; columns stay as they are. See ``mix``."""
    out, made = mix(docs, docs.columns, **more)
    return out.where(F.col(made["sampled"])).select(*cols(out, *docs.columns))


def mixing_sql(sweeps: int = SWEEPS, seed: int = 4) -> str:
    """The SQL twin of ``mix`` over ``documents`` with tempered targets."""
    topic = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{name}'" for name, words in TOPICS
    )
    parts = [f"""d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
    CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d
), c0 AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST(sum(tokens) AS DOUBLE) AS w FROM m GROUP BY ALL
)"""]  # fmt: skip
    for name, power in POWERS.items():
        parts.append(f"""t_{name} AS (
  SELECT {name}, pow(n, {power}) / sum(pow(n, {power})) OVER () AS share FROM (SELECT {name}, sum(tokens) AS n FROM c0 GROUP BY ALL) WHERE n > 0
)""")
    step = 0
    for _ in range(sweeps):
        for name in POWERS:
            parts.append(f"""c{step + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, CASE WHEN z > 0 THEN w * share / z ELSE 0 END AS w FROM (
    SELECT c.*, t.share, sum(c.w) OVER (PARTITION BY c.{name}) AS z FROM c{step} c JOIN t_{name} t ON c.{name} IS NOT DISTINCT FROM t.{name})
)""")
            step += 1
    parts.append(f"""r AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w * (SELECT sum(tokens) FROM c0) / tokens ELSE 0 END AS ratio FROM c{step}
), p AS (
  SELECT *, round(CASE WHEN max(ratio) OVER () > 0 THEN ratio / max(ratio) OVER () ELSE 0 END, 9) AS chance FROM r
)
SELECT m.doc_id, m.source, m.lang, m.topic, m.tokens, round(coalesce(p.ratio, 0), 6) AS weight,
  coalesce(p.chance, 0) AS probability, m.u < coalesce(p.chance, 0) AS sampled
FROM m LEFT JOIN p ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang AND m.topic = p.topic""")
    return "WITH " + ", ".join(parts)
