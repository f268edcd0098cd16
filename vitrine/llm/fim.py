"""Fill-in-middle transformation of whole texts.

The ends of a text's units form a boundary set in the manner of a Roaring bitmap: one container for each
65,536 code points, kept as a sorted array, a bitmap or runs, whichever is smallest, with cumulative
cardinalities over the containers. The offset of the r-th boundary is a search for the container and a
select inside it; two selects give the two cuts. Work is row by row: nothing is shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, utf8

PREFIX, SUFFIX, MIDDLE = MARKERS = "<P>", "<S>", "<M>"
SPAN = 1 << 16


class Array:
    """Sorted low halves, two bytes each."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class Bitmap:
    """One bit for each of the 65,536 places, with the number of bits up to each word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.upto, rank, "right"))
        left, word = rank - (int(self.upto[at - 1]) if at else 0), int(self.words[at])
        for _ in range(left):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class Runs:
    """First place and length of each run of neighbouring places."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
        self.first = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low))

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.upto, rank, "right"))
        return int(self.first[at]) + rank - (int(self.upto[at - 1]) if at else 0)


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form for sorted places below 65,536."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    kind = min((2 * len(low), 0, Array), (SPAN // 8, 1, Bitmap), (4 * runs, 2, Runs))[2]
    return kind(low)


class Boundaries:
    """A sorted set of offsets with ``select``."""

    def __init__(self, ends: np.ndarray) -> None:
        self.high, first = np.unique(ends // SPAN, return_index=True)
        parts = np.split(ends % SPAN, first[1:]) if len(ends) else []
        self.containers = [container(p) for p in parts]
        self.upto = np.cumsum([len(p) for p in parts], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, rank: int) -> int:
        """The boundary with ``rank`` smaller ones."""
        at = int(np.searchsorted(self.upto, rank, "right"))
        return int(self.high[at]) * SPAN + self.containers[at].select(rank - (int(self.upto[at - 1]) if at else 0))

    def cut(self, units: int) -> int:
        """Offset after the first ``units`` units."""
        return self.select(units - 1) if units else 0


def unit_ends(text: str) -> np.ndarray:
    """End offsets, in code points, of the units: a word with the white space before it, or what white space is left."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(points)) if len(points) else ends


def rearranged(text: str, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    bounds = Boundaries(unit_ends(text))
    n, (h1, h2, h3, h4) = len(bounds), draws
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = (bounds.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``n`` units; ``form`` is plain, psm or spm; ``output`` is the whole rearranged text. About ``rate`` of
    100 texts are rearranged, ``spm_rate`` of 100 of these suffix first. Cuts and form hang on the key and
    the seed alone. Null counts as empty and stays plain with no unit, as does a text that holds a marker;
    then both lengths are null. Bytes that are no UTF-8 are read as U+FFFD. A null key draws as an empty
    one; repeated rows each give the same row again; an empty table gives none; other columns are left
    out, whatever their names. A very long text is held once, with its boundary set, in its own task.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for texts, *drawn in batches:
            numbers = zip(*(d.to_pylist() for d in drawn), strict=True)
            rows = [rearranged(t.decode("utf-8", "replace"), h, rate, spm_rate) for t, h in zip(utf8(texts), numbers, strict=True)]
            names = [f.name for f in kind]
            yield pa.array([dict(zip(names, r, strict=True)) for r in rows], kind)

    own = docs[f"`{key}`"]
    made = docs.select(own.alias(key), work(docs[f"`{text}`"], *draws(own, seed)).alias("made of"))
    return made.select(f"`{key}`", "`made of`.*")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Markers share no end with a beginning, so the first one found is the one set."""
    body = F.substr(output, F.lit(4))
    first = lambda marker: F.split(body, marker, 2)  # noqa: E731  what is before the second part's marker, and the rest
    a, rest = first(SUFFIX)[0], F.split(first(SUFFIX)[1], MIDDLE, 2)
    psm = F.concat(a, rest[1], rest[0])
    b, rest = first(PREFIX)[0], F.split(first(PREFIX)[1], MIDDLE, 2)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(rest[0], rest[1], b))


def digests(made: DataFrame) -> DataFrame:
    """The output of ``fill_in_middle`` with texts replaced by SHA-256 of the output and of the text rebuilt from it."""
    kept = [made[f"`{c}`"] for c in made.columns if c != "output"]
    back = restored(made["output"], made["form"])
    return made.select(*kept, F.sha2(made["output"], 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
