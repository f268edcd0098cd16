"""Scoring of texts by prediction by partial matching over bytes, beside a word model.

Training cuts every text into words and counts, inside each task, its words and its byte grams: a context
of ``order`` bytes and the byte after it. One grouped aggregation makes the corpus counts. The context trie
is a table: the grams of every order come from those of the highest by cutting bytes off the front, a
node's total and number of followers from its grams. A byte seen after its whole context has the share of
its count; one not seen there pays the escape (as many counts as the node has followers, method C) and is
looked for after a shorter context, where the bytes that followed the longer one are excluded. A byte that
followed nothing is one of those left of the alphabet. Because a byte that follows a context also follows
each shorter one, the bytes excluded are always those of the next longer context alone, so totals without
them are one join and one sum.

Each different gram of the corpus is scored once. Scores go back to the texts in two tiers: the most
frequent grams and words, whose number is a parameter, are broadcast; the rest meet their texts in a join,
where none is frequent any more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import at_least, small_batches, stored, utf8

#: Bytes of context.
ORDER = 5
#: Byte values a text can hold once its white space is one space between words and an end.
ALPHABET = 256 - 4
#: The end of a text; no word holds it.
END = b"\n"
#: Grams and words that are broadcast.
FREQUENT_GRAMS, FREQUENT_WORDS = 1 << 19, 1 << 17
#: Bytes worked on at a time, and different words or grams a task gathers before it hands them on.
SLICE, GATHERED = 1 << 20, 1 << 19


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def grams(bodies: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of every byte of the texts and of their ends, each with ``order`` bytes before it, and the text
    of each code; in slices. A text begins after ends."""
    pad = END * order
    line = np.frombuffer(b"".join(pad + b + END for b in bodies), np.uint8)
    size = np.array([len(b) + 1 + order for b in bodies])
    first = np.cumsum(size) - size
    owned = np.ones(len(line), bool)
    owned[(first[:, None] + np.arange(order)).ravel()] = False
    for low in range(0, len(line), SLICE):
        at = low + np.flatnonzero(owned[low : low + SLICE])
        code = np.zeros(len(at), np.int64)
        for back in range(order, -1, -1):
            code = code << 8 | line[at - back]
        yield code, np.searchsorted(first, at, "right") - 1


def merged(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes with the sums of their times (one column for each kind)."""
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=code[0] - 1)) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(time[order], first, axis=0) if len(code) else time


def gathered(docs: DataFrame, text: Column, train: Column, order: int) -> DataFrame:
    """Stored: ``word, gram, trained, held``: each different word of the texts to learn from, or gram of all
    texts, with how often the former and the other texts hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, codes, times = Counter(), [], []

        def out(keep: bool) -> Iterator[pa.RecordBatch]:
            nonlocal codes, times
            if codes:
                code, time = merged(codes, times)
                codes, times = [code], [time]
                if not keep or len(code) > GATHERED:
                    codes, times = [], []
                    none = pa.nulls(len(code), pa.binary())
                    yield pa.RecordBatch.from_arrays([none, *map(pa.array, (code, time[:, 0], time[:, 1]))], names)
            if not keep or len(seen) > GATHERED:
                n = pa.array(seen.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.nulls(len(n), pa.int64()), n, pa.array(np.zeros(len(n), np.int64))], names)
                seen.clear()

        names = ["word", "gram", "trained", "held"]
        for batch in batches:
            learn, bodies = batch.column(1).to_pylist(), ([], [])
            for t, own in zip(utf8(batch.column(0)), learn, strict=True):
                own_words = words_of(t)
                bodies[not own].append(b" ".join(own_words))
                if own:
                    seen.update(own_words)
                    seen[END] += 1
            for kind, own in enumerate(bodies):
                for part in _slices(own):
                    for code, _ in grams(part, order):
                        code, n = np.unique(code, return_counts=True)
                        codes.append(code)
                        times.append(np.eye(2, dtype=np.int64)[[kind]] * n[:, None])
                        if sum(map(len, codes)) > 4 * GATHERED:
                            yield from out(True)
            yield from out(True) if len(seen) > GATHERED else ()
        yield from out(False)

    each = docs.select(text.alias("text"), train.alias("train")).mapInArrow(work, "word binary, gram bigint, trained bigint, held bigint")
    return stored(each.groupBy("word", "gram").agg(F.sum("trained").alias("trained"), F.sum("held").alias("held")), "counts")


def _slices(bodies: list[bytes]) -> Iterator[list[bytes]]:
    now, size = [], 0
    for b in bodies:
        if now and size + len(b) > SLICE:
            yield now
            now, size = [], 0
        now.append(b)
        size += len(b)
    if now:
        yield now


def _tail(code: Column, size: int | Column) -> Column:
    """The last ``size`` bytes of a code."""
    return code.bitwiseAND(F.lit((1 << 8 * size) - 1) if isinstance(size, int) else F.pow(F.lit(256.0), size).cast("long") - 1)


def trie(seen: DataFrame, order: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``gram, trained``: grams of every order (``k, code, n``); nodes (``k, context, total, kinds``);
    and what the next longer context excludes (``k, longer, taken, gone``)."""
    every = F.array(*(F.struct(F.lit(k).alias("k"), _tail(F.col("gram"), k + 1).alias("code")) for k in range(order + 1)))
    edges = seen.select(F.explode(every).alias("e"), "trained").groupBy("e.k", "e.code").agg(F.sum("trained").alias("n"))
    edges = stored(edges, "grams")
    nodes = edges.groupBy("k", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    longer = edges.where("k > 0").select((F.col("k") - 1).alias("k"), F.col("code").alias("long"), _tail(F.col("code"), F.col("k")).alias("code"))
    steps = longer.join(edges, ["k", "code"]).groupBy("k", F.shiftright("long", 8).alias("longer")).agg(
        F.sum("n").alias("taken"), F.count(F.lit(1)).alias("gone"))
    return edges, stored(nodes, "nodes"), stored(steps, "steps")


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """Stored: ``gram, times, score`` for each gram of ``counts``: log10 of the last byte's probability after the others."""
    edges, nodes, steps = trie(counts.where("trained > 0"), order)
    times = F.col("trained") + F.col("held")
    top = nodes.where(F.col("k") == order).select("context", "total", "kinds")
    known = counts.where("trained > 0").withColumn("context", F.shiftright("gram", 8)).join(top, "context").select(
        "gram", times.alias("times"), F.log10(F.col("trained") / (F.col("total") + F.col("kinds"))).alias("score"))
    places = F.array(*(
        F.struct(F.lit(k).alias("k"), _tail(F.col("gram"), k + 1).alias("code"), F.shiftright(_tail(F.col("gram"), k + 1), 8).alias("context"),
                 F.shiftright(_tail(F.col("gram"), k + 2), 8).alias("longer") if k < order else F.lit(None).cast("long").alias("longer"))
        for k in range(order + 1)))
    new = counts.where("trained = 0").select("gram", times.alias("times"), F.explode(places).alias("p")).select("gram", "times", "p.*")

    def looked_up(rows: DataFrame, part: str, small) -> DataFrame:
        out = rows.where(part)
        for found, keys in ((edges, ["k", "code"]), (nodes, ["k", "context"]), (steps, ["k", "longer"])):
            out = out.join(small(found.where(part)), keys, "left")
        return out

    # up to order 1 there are 65,792 grams at most, and each is met by many rows
    both = looked_up(new, "k <= 1", F.broadcast).unionByName(looked_up(new, "k > 1", lambda df: df))
    left, kinds = F.col("total") - F.coalesce("taken", F.lit(0)), F.col("kinds") - F.coalesce("gone", F.lit(0))
    escape = F.when(F.col("n").isNull() & (left + kinds > 0), F.log10(kinds / (left + kinds))).otherwise(0.0)
    hit = F.when(F.col("n").isNotNull() & (left > 0), F.log10(F.col("n") / (left + kinds)))
    rest = F.log10(1.0 / (ALPHABET - F.coalesce(F.max(F.when(F.col("k") == 0, F.col("kinds"))), F.lit(0))))
    unknown = both.groupBy("gram", "times").agg(
        (F.sum(escape) + F.coalesce(F.max_by(hit, F.when(F.col("n").isNotNull(), F.col("k"))), rest)).alias("score"))
    return stored(known.unionByName(unknown), "scores")


class Table:
    """Codes and their values by open addressing; built and asked for many codes at once."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.codes, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left = np.arange(len(codes))
        at = self._place(codes)
        while len(left):
            free = self.codes[at] == -1
            self.codes[at[free]] = codes[left[free]]  # of several at one place, one stays
            put = self.codes[at] == codes[left]
            self.values[at[put]] = values[left[put]]
            left, at = left[~put], (at[~put] + 1) & (len(self.codes) - 1)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where a code is not held, and the places of the codes that are not."""
        at = self._place(codes)
        held, values = self.codes[at], self.values[at]
        missing, open_ = [], np.flatnonzero(held != codes)
        values[open_] = 0.0
        at, held = at[open_], held[open_]
        while len(open_):
            missing.append(open_[held == -1])
            go = held != -1
            open_, at = open_[go], (at[go] + 1) & (len(self.codes) - 1)
            held = self.codes[at]
            hit = held == codes[open_]
            values[open_[hit]] = self.values[at[hit]]
            open_, at, held = open_[~hit], at[~hit], held[~hit]
        return values, np.concatenate(missing) if missing else np.zeros(0, np.int64)


def score(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
    frequent_grams: int = FREQUENT_GRAMS, frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """``key, train, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    The rows where ``train``, a condition on columns of ``docs``, holds are learnt from (null: not). A text
    is its words, A-Z lower-cased and cut at ASCII white space, and an end. ``base_score`` is the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))) over words and end, ``n_known`` those with c > 0, ``train_tokens``
    N. ``score`` is log10 of the probability of the same words, one space apart, and the end, byte by byte;
    so both scores are of the same thing. Null and empty texts are an end alone. Repeated rows are learnt
    from and scored each. With nothing to learn from, base_score is 0 and every byte has one chance in
    ``ALPHABET``. An empty table gives no row; other columns are left out, whatever their names. A very long
    text is worked on in slices. ``order`` is 1 to 6.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    spark = docs.sparkSession
    small_batches(spark)
    whole, learn = docs[f"`{text}`"], F.coalesce(train, F.lit(False))
    counts = gathered(docs, whole, learn, order)
    words = counts.where("gram IS NULL").select("word", F.col("trained").alias("n"))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = total + 0.1 * (kinds + 1)
    words = words.withColumn("base", F.log10((F.col("n") + 0.1) / below))
    table = gram_scores(counts.where("gram IS NOT NULL").select("gram", "trained", "held"), order)

    # two tables of bounded size go through the driver
    least_word, least_gram = at_least(words, F.col("n"), frequent_words), at_least(table, F.col("times"), frequent_grams)
    often = words.where(F.col("n") >= least_word).select("word", "base").toArrow()
    common = table.where(F.col("times") >= least_gram).select("gram", "score").toArrow()
    sent = spark.sparkContext.broadcast((
        dict(zip(often["word"].to_pylist(), often["base"].to_pylist(), strict=True)),
        Table(common["gram"].to_numpy(), common["score"].to_numpy())))

    kind = pa.struct([
        ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
        ("words", pa.list_(pa.binary())), ("word_times", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), ("gram_times", pa.list_(pa.int32()))])

    @F.arrow_udf(
        "struct<row:bigint,n_tokens:bigint,known:bigint,base:double,score:double,"
        "words:array<binary>,word_times:array<int>,grams:array<bigint>,gram_times:array<int>>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bases, held = sent.value
        row = TaskContext.get().partitionId() << 33
        for column in batches:
            out, bodies = {f.name: [] for f in kind}, []
            for t in utf8(column):
                own = words_of(t)
                found = list(map(bases.get, [*own, END]))
                rare = Counter(w for w, b in zip([*own, END], found, strict=True) if b is None) if None in found else {}
                got = [b for b in found if b is not None] if rare else found
                values = (row, len(own) + 1, len(got), math.fsum(got), list(rare.keys()), list(rare.values()))
                for name, v in zip(("row", "n_tokens", "known", "base", "words", "word_times"), values, strict=True):
                    out[name].append(v)
                bodies.append(b" ".join(own))
                row += 1
            for part in _slices(bodies):
                sums, rest = np.zeros(len(part)), []
                for code, of in grams(part, order):
                    values, missing = held.find(code)
                    sums += np.bincount(of, values, len(part))
                    rest.append(np.stack([of[missing], code[missing]], axis=1))
                rest = np.concatenate(rest)
                rest, n = np.unique(rest, axis=0, return_counts=True) if len(rest) else (rest, np.zeros(0, np.int64))
                cut = np.searchsorted(rest[:, 0], np.arange(len(part) + 1))
                out["score"] += sums.tolist()
                out["grams"] += [rest[i:j, 1] for i, j in zip(cut[:-1], cut[1:], strict=True)]
                out["gram_times"] += [n[i:j].astype(np.int32) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in kind], fields=list(kind))

    made = docs.select(docs[f"`{key}`"].alias(key), learn.alias("learnt from"), work(whole).alias("made of"))
    made = stored(made.select(f"`{key}`", F.col("`learnt from`"), "`made of`.*"), "scored")

    def rest(names: str, times: str) -> DataFrame:
        return made.select("row", F.explode(F.arrays_zip(names, times)).alias("e")).select("row", F.col(f"e.{names}").alias("item"), F.col(f"e.{times}").alias("t"))

    rare_words = words.where(F.col("n") < least_word).select(F.col("word").alias("item"), "n", F.col("base").alias("b"))
    unknown = math.log10(0.1 / below)
    by_word = rest("words", "word_times").join(rare_words, "item", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("k"), F.sum(F.col("t") * F.coalesce("b", F.lit(unknown))).alias("b"), F.lit(0.0).alias("s"))
    rare_grams = table.where(F.col("times") < least_gram).select(F.col("gram").alias("item"), F.col("score").alias("s"))
    by_gram = rest("grams", "gram_times").join(rare_grams, "item").groupBy("row").agg(
        F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("b"), F.sum(F.col("t") * F.col("s")).alias("s"))
    more = by_word.unionByName(by_gram).groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    add = lambda own, other: F.col(own) + F.coalesce(F.col(other), F.lit(0))
    return made.join(more, "row", "left").select(
        f"`{key}`", F.col("`learnt from`").alias("train"), "n_tokens", add("known", "k").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        add("base", "b").alias("base_score"), add("score", "s").alias("score"))
