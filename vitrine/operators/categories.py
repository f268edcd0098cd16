"""Category dimension and staged matching: exact, synonym, fuzzy.

Only distinct values that the two equi-joins leave over are scored. Where the score of values that no
term comes close to is not asked for, pieces of the terms find the few that can reach the threshold.
Else each value meets the dimension in pieces of bounded size, and the best score is folded inside the
row: no pair is ever emitted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from vitrine import constants as K
from vitrine.functions.similarity import weighted_ratio
from vitrine.functions.text import strip
from vitrine.session import materialise

DIM_SCHEMA = "pos long, kind string, term string, term_lc string, master string"
PIECE = 256


def category_dim(
    spark: SparkSession, masters: list[str] | None = None, synonyms: dict[str, list[str]] | None = None
) -> DataFrame:
    """Dimension in matching order: masters, then synonyms; a later master takes a synonym over."""
    masters = list(masters or K.MASTER_CATEGORIES)
    synonyms = K.CATEGORY_SYNONYMS if synonyms is None else synonyms
    owner: dict[str, tuple[str, str]] = {}
    for master, terms in synonyms.items():
        if master in masters:
            for term in terms:
                first = owner.get(term.lower(), (term,))[0]
                owner[term.lower()] = (first, master)
    rows = [(i, "master", m, m.lower(), m) for i, m in enumerate(masters)]
    rows += [
        (len(masters) + i, "synonym", term, low, master)
        for i, (low, (term, master)) in enumerate(owner.items())
    ]
    return spark.createDataFrame(rows, DIM_SCHEMA)


def levenshtein_score(raw: Column, term: Column) -> Column:
    """Whole percent of characters that need no edit, ignoring case."""
    a, b = F.lower(strip(raw)), F.lower(term)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.floor((longest - F.levenshtein(a, b)) * 100.0 / longest).cast("int")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _weighted_scores(raw: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([[weighted_ratio(r, t) for t in ts] for r, ts in zip(raw, terms)])


def score_categories(values: DataFrame, raw: str, dim: DataFrame, scorer: str = "levenshtein", keep: int = 1) -> DataFrame:
    """The ``keep`` best dimension terms of each distinct value: raw, rank, score, term, master.

    A term stands for itself; ties go to the earlier one in the dimension.
    """
    term = F.struct("pos", "term", "master")
    pieces = dim.withColumn("_piece", F.floor(F.col("pos") / PIECE)).groupBy("_piece").agg(
        F.sort_array(F.collect_list(term)).alias("_terms")
    )
    last = dim.agg(F.max(F.floor(F.col("pos") / PIECE))).scalar()
    spread = values.select(raw).distinct().withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    joined = spread.join(pieces, "_piece")
    if scorer == "levenshtein":
        scored = F.transform("_terms", lambda t: F.struct(
            levenshtein_score(F.col(raw), t["term"]).alias("score"), (-t["pos"]).alias("order"),
            t["term"].alias("term"), t["master"].alias("master")))
    else:
        joined = joined.withColumn("_scores", _weighted_scores(raw, F.col("_terms.term")))
        scored = F.transform(F.arrays_zip("_scores", "_terms"), lambda z: F.struct(
            z["_scores"].alias("score"), (-z["_terms"]["pos"]).alias("order"),
            z["_terms"]["term"].alias("term"), z["_terms"]["master"].alias("master")))
    best = joined.select(raw, F.slice(F.sort_array(scored, asc=False), 1, keep).alias("_best"))
    merged = best.groupBy(raw).agg(F.flatten(F.collect_list("_best")).alias("_best"))
    top = F.slice(F.sort_array("_best", asc=False), 1, keep)
    return merged.select(raw, F.posexplode(top).alias("_i", "_b")).select(
        raw, (F.col("_i") + 1).alias("rank"), "_b.score", "_b.term", "_b.master"
    )


def _kinds(text: Column, n: int) -> Column:
    """A bit for each class of runs of ``n`` letters in ``text``."""
    runs = F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))
    bits = F.transform(runs, lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(r), F.lit(64))))
    return F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)), F.lit(0).cast("long"))


def _alone(a: str, b: str) -> Column:
    """The greater number of classes that one of two sets has and the other has not."""
    return F.greatest(*[F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) for x, y in ((a, b), (b, a))])


def met_terms(values: DataFrame, raw: str, dim: DataFrame, threshold: int = K.FUZZY_THRESHOLD) -> DataFrame:
    """Pairs of a value and a term among which are all that score ``threshold`` (above 0) or more by edits.

    A score that high allows a term of n letters n (100 - t) / t edits at most. Cut into one piece more
    than that, it keeps a piece whole, which the value holds close to the same place. Values meet terms by
    length, piece and its number only, and a pair goes where one side alone has more letters than edits,
    or more letter pairs than twice that; a pair that shares several pieces comes several times.
    """
    lost, kept = 100 - threshold, threshold
    length, number = F.col("_length"), F.col("_number")
    pieces = F.floor(length * lost / kept) + 1
    start, end = F.floor(number * length / pieces), F.floor((number + 1) * length / pieces)
    terms = dim.select("pos", "term", "master", F.lower("term").alias("_term")).withColumn("_length", F.length("_term"))
    posted = terms.withColumns({"_one": _kinds(F.col("_term"), 1), "_two": _kinds(F.col("_term"), 2)}).withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).select(
        "*", F.substring("_term", start + 1, end - start).alias("_piece"))
    lengths = terms.agg(F.sort_array(F.collect_set("_length"))).scalar()
    edited = values.select(raw).distinct().withColumn("_value", F.lower(strip(F.col(raw)))).withColumns(
        {"_size": F.length("_value"), "_own_one": _kinds(F.col("_value"), 1), "_own_two": _kinds(F.col("_value"), 2)})
    size = F.col("_size")
    met = edited.withColumn("_length", F.explode(lengths)).where((length * 100 >= size * kept) & (size * 100 >= length * kept))
    edits = F.floor(F.greatest(size, length) * lost / 100)
    shifts = F.filter(F.sequence(-edits, edits), lambda by: (
        (F.abs(by) + F.abs(size - length - by) <= edits) & (start + by >= 0) & (end + by <= size)))
    held = F.array_distinct(F.transform(shifts, lambda by: F.substring(F.col("_value"), start + by + 1, end - start)))
    asked = (
        met.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
        .select(raw, "_value", "_own_one", "_own_two", edits.alias("_edits"), "_length", "_number", F.explode(held).alias("_piece"))
    )
    few = (_alone("_own_one", "_one") <= F.col("_edits")) & (_alone("_own_two", "_two") <= 2 * F.col("_edits"))
    return asked.join(posted, ["_length", "_number", "_piece"]).where(few).select(raw, "_value", "_term", "pos", "term", "master")


def near_terms(values: DataFrame, raw: str, dim: DataFrame, threshold: int = K.FUZZY_THRESHOLD) -> DataFrame:
    """All terms that score ``threshold`` (above 0) or more by edits, once each: raw, score, pos, term, master."""
    score = levenshtein_score(F.col("_value"), F.col("_term")).alias("score")
    met = met_terms(values, raw, dim, threshold).dropDuplicates([raw, "pos"])
    return met.select(raw, score, "pos", "term", "master").where(F.col("score") >= threshold)


def best_near_term(values: DataFrame, raw: str, dim: DataFrame, threshold: int = K.FUZZY_THRESHOLD) -> DataFrame:
    """The best term of every value that has one of ``threshold`` or more; ties as in ``score_categories``."""
    best = F.max(F.struct("score", (-F.col("pos")).alias("order"), "term", "master")).alias("_b")
    return near_terms(values, raw, dim, threshold).groupBy(raw).agg(best).select(raw, "_b.score", "_b.term", "_b.master")


def match_categories(
    df: DataFrame, raw: str, dim: DataFrame, threshold: int = K.FUZZY_THRESHOLD, scorer: str = "weighted",
    low_scores: bool = True,
) -> DataFrame:
    """One row per distinct value: its master, the stage that found it, and the fuzzy score.

    Without ``low_scores`` a score below the threshold is null, and the scorer by edits takes the index.
    """
    values = df.where(F.col(raw) != "").select(raw).distinct()
    lookup = dim.groupBy("term_lc").agg(
        F.min(F.struct(F.when(F.col("kind") == "master", 0).otherwise(1).alias("k"), "pos", "master")).alias("_hit")
    )
    staged = values.withColumn("term_lc", F.lower(strip(F.col(raw)))).join(lookup, "term_lc", "left").drop("term_lc")
    direct = staged.where("_hit IS NOT NULL").select(
        raw, F.col("_hit.master").alias("master"),
        F.when(F.col("_hit.k") == 0, "exact").otherwise("synonym").alias("stage"),
        F.lit(100).alias("score"),
    )
    left = staged.where("_hit IS NULL")
    if low_scores or threshold <= 0 or scorer != "levenshtein":
        best = score_categories(left, raw, dim, scorer)
        if not low_scores:
            best = best.withColumn("score", F.when(F.col("score") >= threshold, F.col("score")))
    else:
        best = left.select(raw).join(best_near_term(left, raw, dim, threshold), raw, "left")
    good = F.col("score") >= threshold
    fuzzy = best.select(
        raw, F.when(good, F.col("master")).otherwise(F.lit(K.UNMAPPED)).alias("master"),
        F.when(good, "fuzzy").otherwise("none").alias("stage"), "score",
    )
    return direct.unionByName(fuzzy)


def normalize_categories(
    df: DataFrame, raw: str, dim: DataFrame, out: str = "categoria_normalizada",
    threshold: int = K.FUZZY_THRESHOLD, scorer: str = "weighted",
) -> DataFrame:
    """Master category of every row; no category, or none good enough, gives the unmapped label.

    What is found, a row for each distinct value, is stored: its size is known, and if it is small the rows stay where
    they are. Dealt by value, all rows of a frequent one would be sorted in one task.
    """
    found = materialise(match_categories(df, raw, dim, threshold, scorer, low_scores=False).select(
        F.col(raw).alias("_raw"), F.col("master").alias("_master")), "categories")
    joined = df.join(found, F.col(raw) == F.col("_raw"), "left")
    return joined.withColumn(out, F.coalesce("_master", F.lit(K.UNMAPPED))).drop("_raw", "_master")


def _numbered(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """``rows`` with ``pos``: their place in the order of ``key`` after ``start``.

    Rows are dealt out by ranges of the key and counted within their range; only the ranges' sizes, a
    row for each partition, are summed up in one place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, key).sortWithinPartitions(key)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("_range"), within.alias("_at")), "terms")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn("pos", start + 1 + F.col("_before") + F.col("_at")).drop(
        "_range", "_at", "_before")


def add_categories(dim: DataFrame, new: DataFrame) -> DataFrame:
    """Add master categories (column ``master``) that are not there yet, in name order."""
    fresh = new.select("master").distinct().join(dim.where("kind = 'master'").select("master"), "master", "left_anti")
    next_pos = dim.agg(F.max("pos")).scalar()
    return dim.unionByName(_numbered(fresh, "master", next_pos).select(
        F.col("pos").cast("long").alias("pos"), F.lit("master").alias("kind"),
        F.col("master").alias("term"), F.lower("master").alias("term_lc"), "master"))


def upsert_synonyms(dim: DataFrame, new: DataFrame) -> DataFrame:
    """Add synonyms (columns ``master``, ``term``): the master must exist, a known synonym stays."""
    known = dim.where("kind = 'synonym'").select("term_lc")
    masters = dim.where("kind = 'master'").select("master")
    fresh = (
        new.withColumn("term_lc", F.lower("term"))
        .join(masters, "master", "left_semi").join(known, "term_lc", "left_anti")
        .groupBy("term_lc").agg(F.min(F.struct("term", "master")).alias("s"))
    )
    next_pos = dim.agg(F.max("pos")).scalar()
    return dim.unionByName(_numbered(fresh, "term_lc", next_pos).select(
        F.col("pos").cast("long").alias("pos"),
        F.lit("synonym").alias("kind"), F.col("s.term").alias("term"), "term_lc", F.col("s.master").alias("master")))


def synonyms_of(dim: DataFrame, master: str) -> DataFrame:
    return dim.where((F.col("kind") == "synonym") & (F.col("master") == master)).select("term").orderBy("term")


def dim_statistics(dim: DataFrame) -> DataFrame:
    """Synonyms per master category."""
    return dim.groupBy("master").agg(F.count_if(F.col("kind") == "synonym").alias("synonyms"))


def weak_matches(scored: DataFrame, raw: str, low: int, high: int, margin: int = 5) -> DataFrame:
    """Values matched with little confidence, or whose two best masters score nearly alike.

    ``scored`` is the output of ``score_categories`` with ``keep=2``.
    """
    first = F.max(F.when(F.col("rank") == 1, F.struct("score", "term", "master")))
    second = F.max(F.when(F.col("rank") == 2, F.struct("score", "master")))
    both = scored.groupBy(raw).agg(first.alias("a"), second.alias("b"))
    return both.select(
        raw, F.col("a.score").alias("score"), F.col("a.master").alias("master"),
        F.col("b.score").alias("second_score"), F.col("b.master").alias("second_master"),
        ((F.col("a.score") >= low) & (F.col("a.score") < high)).alias("low_confidence"),
        F.coalesce((F.col("a.score") - F.col("b.score") < margin) & (F.col("a.master") != F.col("b.master")),
                   F.lit(False)).alias("ambiguous"),
    ).where("low_confidence OR ambiguous")
