"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base spans (e-mail, IP address, card, phone) are found by fixed patterns and checks and are the seeds.
The words before and after a seed make lexical patterns: the word before, the word after, and both. A
graph links patterns to the identifier-like values that stand in them. A pattern's confidence for a kind
is the share of its values that are of that kind; a value's score is the best confidence of its
patterns. Both are worked out in turn, and values scored high by patterns of high confidence are new
identifiers, wherever they stand. Such a value must have the rough shape of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cols, fresh, stored, text_or_empty

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans. A start inside a run that already failed is not tried again, and runs give
#: nothing back where the next character could not match anyway: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a pattern cannot match.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Words with a digit or an at sign: the values patterns may discover.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Rough shape a discovered value needs.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9a-fA-F]{1,4}(?:[.:][0-9a-fA-F]{1,4}){3,7}$",
    "card": r"^[0-9](?:-?[0-9]){11,22}$",
    "phone": r"^\+?[(]?[0-9](?:[().-]*[0-9]){6,14}$",
}
#: Characters looked at for the word next to a value.
NEAR = 80
#: Matches whose places are summed up at a time.
STEP = 256


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Array of ``start, end, value, before, after`` of the matches in a text that is not null."""

    def around(parts: Column) -> Column:
        zipped = F.arrays_zip(
            parts.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
            F.slice(parts, F.lit(2), F.lit(2**31 - 2)).alias("next"),
        )
        return F.transform(
            F.filter(zipped, lambda z: z["value"].isNotNull()),
            lambda z: F.struct(
                F.length(z["gap"]).alias("gap"), F.length(z["value"]).alias("size"), z["value"].alias("value"),
                F.lower(F.regexp_extract(F.substring(z["gap"], -NEAR, NEAR), r"(\S+)\s*$", 1)).alias("before"),
                F.lower(F.regexp_extract(F.substring(z["next"], 1, NEAR), r"^\s*(\S+)", 1)).alias("after"),
            ),
        )

    return _once(_once(F.split(text, pattern, -1), around), _placed)


_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _placed(found: Column) -> Column:
    """Running sums of gaps and sizes turn into places; in blocks, so that a text with very many matches
    does not copy its whole list for each."""
    width = lambda s, x: s + x["gap"] + x["size"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda i: F.slice(found, (i * STEP + 1).cast("int"), STEP))
    state = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda s, block: F.struct(
            F.aggregate(block, s["at"], width).alias("at"),
            F.array_append(s["out"], F.aggregate(
                block,
                F.struct(s["at"].alias("at"), F.array().cast(_SPAN).alias("out")),
                lambda t, x: F.struct(
                    width(t["at"], x).alias("at"),
                    F.array_append(t["out"], F.struct(
                        (t["at"] + x["gap"]).alias("start"), width(t["at"], x).alias("end"),
                        x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"),
                    )).alias("out"),
                ),
                lambda t: t["out"],
            )).alias("out"),
        ),
        lambda s: F.flatten(s["out"]),
    )
    return F.when(F.size(found) > 0, state).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    back = F.split(F.reverse(_digits(value)), "")
    digit = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digit, F.lit(0), lambda s, d: s + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The check a match of a kind must pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    found = F.when(text.rlike(SIGNS[kind]), F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"])))
    return F.coalesce(found, F.array().cast(_SPAN))


def _edges(rows: DataFrame) -> DataFrame:
    """Distinct ``pattern, value, kind`` of ``rows(value, before, after, kind)``; kind is null for a value
    that is no seed. A side without a word makes no pattern."""
    left, right = F.col("before") != "", F.col("after") != ""
    patterns = F.array_compact(F.array(
        F.when(left, F.concat(F.lit("L "), "before")), F.when(right, F.concat(F.lit("R "), "after")),
        F.when(left & right, F.concat(F.lit("B "), "before", F.lit(" "), "after")),
    ))
    return rows.select(F.explode(patterns).alias("pattern"), "value", "kind").distinct()


def discover(seeds: DataFrame, others: DataFrame, rounds: int = 3, support: int = 5, sure: float = 0.8) -> DataFrame:
    """``value, kind`` of new identifiers, from ``seeds(value, before, after, kind)`` and
    ``others(value, before, after)``.

    A pattern counts for a kind if ``support`` different seeds of that kind stand in it and its confidence
    (scores of its values over their number and one) is at least ``sure``. A value with equal scores for two
    kinds gets the first of ``KINDS``.
    """
    known = seeds.select("value", F.col("kind").alias("seed")).distinct()
    own = _edges(seeds)
    strong = own.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern").distinct()
    unseen = _edges(others.select("*", F.lit(None).cast("string").alias("kind"))).join(known.select("value").distinct(), "value", "left_anti")
    edges = stored(own.unionByName(unseen).join(strong, "pattern", "left_semi"), "edges")
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    scores = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    links = edges.select("pattern", "value").distinct()
    fresh_links = edges.where("kind is null").select("pattern", "value")
    shape = F.lit(False)
    for kind in KINDS:
        shape = shape | ((F.col("kind") == kind) & F.col("value").rlike(SHAPES[kind]))
    new = None
    for _ in range(rounds):
        now = scores if new is None else scores.unionByName(new)
        sums = links.join(now, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum((F.col("score") == 1).cast("int")).alias("seeds"))
        good = sums.join(sizes, "pattern").withColumn("sure", F.col("s") / (F.col("n") + 1)).where((F.col("seeds") >= support) & (F.col("sure") >= sure))
        hits = fresh_links.join(good.select("pattern", "kind", "sure"), "pattern").where(shape)
        new = stored(hits.groupBy("value", "kind").agg(F.max("sure").alias("score")), "values")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return new.groupBy("value").agg(F.max_by("kind", F.struct("score", -order)).alias("kind"))


def find(docs: DataFrame, keep: list[str], text: str = "text", rounds: int = 3, support: int = 5, sure: float = 0.8) -> tuple[DataFrame, str, str]:
    """Columns ``keep`` of ``docs`` and, for every row, the base spans and all spans; the frame and the names
    of the two added columns.

    Spans are arrays of ``start, order, end`` (code points, end exclusive; order: place in ``KINDS``) in order
    of start, then kind. Base spans of different kinds may overlap; added ones overlap none.
    A null text counts as empty and has no span. Repeated rows each keep their spans.
    """
    row, base, words, extra, every = fresh(docs, "row", "base", "words", "extra", "every")
    whole = text_or_empty(docs[f"`{text}`"])
    per_kind = [_base(whole, kind) for kind in KINDS]
    seeded = F.array(*(F.struct(F.lit(kind).alias("kind"), spans.alias("spans")) for kind, spans in zip(KINDS, per_kind)))
    tokens = F.coalesce(F.when(whole.rlike("[0-9@]"), _matches(whole, TOKEN)), F.array().cast(_SPAN))
    table = stored(docs.select(*cols(docs, *keep), F.monotonically_increasing_id().alias(row), seeded.alias(base), tokens.alias(words)), "spans")
    by_kind = table.where(F.exists(base, lambda k: F.size(k["spans"]) > 0)).select(F.explode(base).alias("k"))
    seeds = by_kind.select(F.col("k.kind").alias("kind"), F.explode("k.spans").alias("m")).select("kind", "m.value", "m.before", "m.after")
    # a word's brackets and stops are no part of the value; places are kept beside it
    head = F.length(F.regexp_extract("m.value", r"^[\"'(<\[]*", 0))
    value = F.regexp_replace("m.value", r"^[\"'(<\[]+|[\"')>\],.;:!?]+$", "")
    others = table.where(F.size(words) > 0).select(F.col(row).alias(row), F.explode(words).alias("m"), F.col(base).alias(base))
    others = others.select(row, base, "m.before", "m.after", value.alias("value"), (F.col("m.start") + head).alias("start"))
    others = others.where(" or ".join(f"value rlike '{s}'" for s in (r"[0-9@][^0-9@]*[0-9@]", "@")))
    new = stored(discover(seeds, others.select("value", "before", "after"), rounds, support, sure), "values")
    end = (F.col("start") + F.length("value")).alias("end")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    placed = others.join(new, "value").select(row, base, F.struct("start", order.alias("order"), end).alias("span"))
    apart = ~F.exists(base, lambda k: F.exists(k["spans"], lambda m: (m["start"] < F.col("span.end")) & (m["end"] > F.col("span.start"))))
    more = stored(placed.where(apart).groupBy(row).agg(F.collect_set("span").alias(extra)), "spans")
    numbered = F.flatten(F.transform(base, lambda k: F.transform(k["spans"], lambda m: F.struct(
        m["start"].alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), k["kind"]).cast("int") - 1).alias("order"), m["end"].alias("end")
    ))))
    joined = table.join(more, row, "left").select(*(F.col(f"`{c}`") for c in keep), F.array_sort(numbered).alias(base), F.col(extra))
    whole_spans = F.when(F.col(extra).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, extra)))
    return joined.select(*(F.col(f"`{c}`") for c in keep), F.col(base), whole_spans.alias(every)), base, every


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``; counts are of
    all spans. See ``find``."""
    found, base, every = find(docs, [key], text, **more)
    count = lambda i: F.size(F.filter(every, lambda s: s["order"] == i)).cast("long")
    return found.select(
        F.col(f"`{key}`"), *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(listed(F.col(base)), 256).alias("base_sha256"), listed(F.col(every)).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", **more) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; what overlaps becomes one. Null texts
    stay null, other columns as they are."""
    found, _, every = find(docs, docs.columns, text, **more)
    whole, names = F.col(f"`{text}`"), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    pieces = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(
                F.concat(s["out"], F.array(F.substring(whole, s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["order"] + 1)))
            ).alias("out"),
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(whole, s["at"] + 1, F.length(whole))),
    )
    clean = F.when(F.size(every) > 0, pieces).otherwise(whole)
    return found.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
