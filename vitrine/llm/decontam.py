"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical words: numbers, names (capitalised words) and units turn into typed
placeholders, all else is lower-cased, punctuation goes. Windows of five canonical words of the benchmark
are hash-joined with those of the documents: the benchmark's side is a sorted table of window hashes of
bounded size, so documents are never shuffled. A benchmark item is found where at least the asked share of
its windows lies in a document on one diagonal (same shift, give or take a few words). The words that
stand in the placeholders there are then compared: the same original must have the same replacement
throughout, and different originals different ones, so an item with other numbers and names is caught and
a chance meeting of placeholders is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, stored, utf8

WINDOW, SHARE = 5, 0.8
#: Window hashes of the benchmark that go to the tasks at once; a larger benchmark takes several rounds.
BLOCK_WORDS = 500_000
#: Bytes of documents handled at a time, and words by which a match may shift (words put in or left out).
PIECE, SLACK = 1 << 19, 4

#: Fixed: words that stand for units.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (11, 13, 17))
_LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_DIGIT[48:58] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64))


_POWERS = _powers(1 << 10)


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hash, plain hash, kind (0 word, 1 number, 2 name, 3 unit) and place of each word of a
    text, worked out in pieces that end between words."""
    parts, start = [], 0
    while start < len(text) or not parts:
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        canonical, plain, kind, place = _words(text[start:end])
        parts.append((canonical, plain, kind, place + start))
        start = end
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    digit = _DIGIT[raw]
    # a point or comma between digits belongs to the number, an apostrophe or hyphen ends a word
    inside = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inside[1:-1] = digit[:-2] & digit[2:] & ((raw[1:-1] == 46) | (raw[1:-1] == 44))
    member = _LETTER[raw] | digit | inside
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.array([], np.uint64)
        return none, none, np.array([], np.int8), np.array([], np.int64)
    low = _LOWER[raw].copy()
    # capital letters of two bytes, U+00C0 to U+00DE
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[second] += 32
    size = np.diff(np.append(start, len(raw)))
    place = np.zeros(len(raw), np.int64)  # of a byte in its word; blanks before the first word stay zero
    place[start[0] :] = np.arange(start[0], len(raw)) - np.repeat(start, size)
    longest = int((end - start).max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    with np.errstate(over="ignore"):
        value = np.where(member, (low.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
        plain = np.add.reduceat(value, start)
        plain ^= plain >> np.uint64(29)
        plain *= _BASE
        plain ^= plain >> np.uint64(32)
    digits = np.add.reduceat(np.where(member, digit, False).astype(np.int32), start)
    first = raw[start]
    capital = (first >= 65) & (first <= 90)
    two = np.minimum(start + 1, len(raw) - 1)
    capital |= (first == 0xC3) & (raw[two] >= 0x80) & (raw[two] <= 0x9E) & (raw[two] != 0x97)
    kind = np.where(digits > 0, 1, np.where(capital, 2, np.where(np.isin(plain, _unit_hashes()), 3, 0))).astype(np.int8)
    canonical = np.choose(kind, [plain, _NUMBER, _NAME, _UNIT])
    return canonical, plain, kind, start


_UNIT_CACHE: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_CACHE:
        _UNIT_CACHE.append(np.array([], np.uint64))
        _UNIT_CACHE[0] = np.sort(words_of(" ".join(UNITS).encode())[1])
    return _UNIT_CACHE[0]


def _forms(canonical: np.ndarray, plain: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With capitals as names, and with them as any other word, for texts in another case."""
    names, other = np.flatnonzero(kind == 2), canonical.copy()
    other[names] = np.where(np.isin(plain[names], _unit_hashes()), _UNIT, plain[names])
    return canonical, other


def windows(canonical: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(canonical) - size + 1
    if n <= 0:
        return np.array([], np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ canonical[i : i + n]) * _BASE
            out ^= out >> np.uint64(31)
    return out


class Index:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = WINDOW) -> None:
        self.size, self.ids, self.words, hashes, owner, place = size, [], [], [], [], []
        for item, text in items:
            canonical, plain, kind, _ = words_of(text)
            for form in _forms(canonical, plain, kind):
                found = windows(form, size)
                if len(found):
                    hashes.append(found)
                    owner.append(np.full(len(found), len(self.ids)))
                    place.append(np.arange(len(found)))
                    self.ids.append(item)
                    self.words.append((plain, kind))
        none = [np.array([], np.int64)]
        hashes, owner, place = (np.concatenate(x or none) for x in (hashes, owner, place))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order].astype(np.uint64), owner[order], place[order]
        self.heads = np.zeros(1 << 16, bool)  # a first, cheap look
        self.heads[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the document, entry of the index and place in the item of each equal window."""
        maybe = np.flatnonzero(self.heads[(found >> np.uint64(48)).astype(np.int64)])
        left = np.searchsorted(self.hashes, found[maybe])
        count = np.searchsorted(self.hashes, found[maybe], "right") - left
        at = np.repeat(maybe, count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(left, count) + within
        return at, self.owner[entry], self.place[entry]

    def found_in(self, texts: list[bytes], share: float = SHARE) -> Iterator[tuple[int, int, float]]:
        """Place of a document in ``texts``, item found in it and the share of the item's windows."""
        start = 0
        while start < len(texts):  # small documents are handled together
            end, held = start + 1, len(texts[start])
            while end < len(texts) and held + len(texts[end]) <= PIECE:
                held += len(texts[end])
                end += 1
            yield from ((start + doc, item, part) for doc, item, part in self._found(texts[start:end], share))
            start = end

    def _found(self, texts: list[bytes], share: float) -> Iterator[tuple[int, int, float]]:
        canonical, plain, kind, place_of = words_of(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        where, owner, place = [], [], []
        for form in _forms(canonical, plain, kind):
            at, who, there = self.hits(windows(form, self.size))
            where.append(at)
            owner.append(who)
            place.append(there)
        where, owner, place = map(np.concatenate, (where, owner, place))
        if not len(where):
            return
        doc = np.searchsorted(ends, place_of[where], "right")
        inside = doc == np.searchsorted(ends, place_of[where + self.size - 1], "right")
        where, owner, place, doc = where[inside], owner[inside], place[inside], doc[inside]
        order = np.lexsort((owner, doc))
        where, owner, place, doc = where[order], owner[order], place[order], doc[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(owner) != 0)) + 1
        best: dict[tuple[int, int], float] = {}
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]):
            who = owner[low] if high > low else 0
            total = len(self.words[who][0]) - self.size + 1 if high > low else 0
            if high - low < max(1, share * total):
                continue
            part = self._best(where[low:high], place[low:high], who, plain, kind, total, share)
            if part >= share:
                at = int(doc[low]), self.ids[who]
                best[at] = max(part, best.get(at, 0.0))
        yield from ((d, item, part) for (d, item), part in best.items())

    def _best(self, at: np.ndarray, place: np.ndarray, who: int, plain: np.ndarray, kind: np.ndarray, total: int, share: float) -> float:
        """Largest share of the item's windows in one stretch of the document whose slots agree."""
        shift = at - place
        order = np.lexsort((place, shift))
        at, place, shift = at[order], place[order], shift[order]
        if len(np.unique(place)) < share * total:
            return 0.0
        best, need = 0.0, share * total
        low = 0
        for high_shift in np.unique(shift):  # hits whose shifts differ by no more than SLACK
            low = np.searchsorted(shift, high_shift - SLACK)
            high = np.searchsorted(shift, high_shift, "right")
            if high - low < need:
                continue
            places, first = np.unique(place[low:high], return_index=True)
            if len(places) >= need and len(places) > best * total and self._agrees(at[low:high][first], places, who, plain, kind):
                best = len(places) / total
        return best

    def _agrees(self, at: np.ndarray, place: np.ndarray, who: int, plain: np.ndarray, kind: np.ndarray) -> bool:
        """Whether slots are filled one to one: for nearly all pairs of original and replacement, each is
        the other's only partner. Fewer than three words outside of slots say nothing."""
        item_plain, item_kind = self.words[who]
        span = np.arange(self.size)
        pairs = np.unique(np.stack([(place[:, None] + span).ravel(), (at[:, None] + span).ravel()], axis=1), axis=0)
        i, d = pairs.T
        fixed = item_kind[i] == 0
        if len(np.unique(item_plain[i[fixed]])) < 3:
            return bool(np.all(item_plain[i] == plain[d]))
        slot = np.flatnonzero(~fixed & (kind[d] > 0))
        if not len(slot):
            return True
        both = np.unique(np.stack([item_plain[i[slot]], plain[d[slot]]], axis=1), axis=0)
        partners = max(len(both) - len(np.unique(both[:, 0])), len(both) - len(np.unique(both[:, 1])))
        return partners <= 0.2 * len(both)


def _indexes(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, size: int) -> Iterator:
    """The benchmark as broadcast indexes, each of a block of bounded size."""
    known = stored(benchmark.select(benchmark[f"`{item}`"].cast("long").alias("item_id"), benchmark[f"`{item_text}`"].alias("text")).dropna()
                   .withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20))), "benchmark")
    size_of = known.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size_of) // BLOCK_WORDS))
    for block in range(blocks):
        # one block of the benchmark reaches the driver and the tasks at a time
        items = known.where(F.pmod("part", F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text.encode()) for r in sorted(items)], size))


def matches(docs: DataFrame, benchmark: DataFrame, row: str, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE, size: int = WINDOW) -> DataFrame:
    """``row, item_id, overlap`` for each item found in a document; ``row`` names a column of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[row].dataType
    slim, out = docs.select(docs[f"`{row}`"].alias("row"), docs[f"`{text}`"].alias("text")), None
    for index in _indexes(docs, benchmark, item, item_text, size):

        def look(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, ids, parts = [], [], []
                for i, found, part in index.value.found_in(list(utf8(batch.column(1))), share):
                    rows.append(i)
                    ids.append(found)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(parts, pa.float64())],
                    ["row", "item_id", "overlap"],
                )

        found = slim.mapInArrow(look, f"row {kind.simpleString()}, item_id bigint, overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``key, item_id, overlap, contaminated`` for each benchmark item found in each row of ``docs``.

    ``overlap`` is the share of the item's windows found, ``contaminated`` is true. Null and empty texts hold
    nothing; items that are null or shorter than a window say nothing. Repeated rows are reported each, equal
    items each with their id, repeated items once. Other columns are left out.
    """
    found = matches(docs, benchmark, key, text, **more)
    return found.select(F.col("row").alias(key), "item_id", F.round("overlap", 6).alias("overlap"), F.lit(True).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns stay as they are. Each block of the
    benchmark is one more filter over the documents: nothing is joined, shuffled or stored."""
    small_batches(docs.sparkSession)

    def without(index):
        @F.arrow_udf("boolean")
        def clean(column: pa.Array) -> pa.Array:
            held = np.ones(len(column), bool)
            held[[i for i, _, _ in index.value.found_in(list(utf8(column)), share)]] = False
            return pa.array(held)

        return clean

    out = docs
    for index in _indexes(docs, benchmark, item, item_text, size):
        out = out.where(without(index)(out[f"`{text}`"]))
    return out
