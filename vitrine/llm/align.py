"""Alignment of two tokenizers over the same bytes.

A token's place is its byte range. Offsets where a token of A and a token of B both end cut a text into
groups and link the two tokens that end there. The merge runs in lockstep: the texts of a batch are dealt
into lanes of bounded length (a lane is a byte range of one text, so long texts are many lanes), two
vectors hold every lane's place in A and in B, and each step compares all lanes at once, emits a link and
a cut where the ends agree, and moves the pointer that is behind, or both. Lanes that are done are taken
out.

Tokens are made once and never leave their task; what is stored is each text's distinct linked id pairs
with how often they occur. Pair totals come from one grouped aggregation. They go back to the texts in two
tiers: the most frequent pairs, whose number is a parameter, are broadcast; the rest meet their texts in a
join, where no pair is frequent any more.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import at_least, small_batches, stored, utf8

#: Characters for which the splitter below is known to agree in both libraries.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E¡-įı-ňŊ-ž]*+")
#: Fixed: the splitter of a byte-level vocabulary file.
PIECE_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a lane, and bytes of text worked on at a time.
LANE, SLICE = 1_024, 1 << 20
#: Pairs that are broadcast.
FREQUENT = 1 << 16


class Tokens:
    """One tokenizer: the bytes and byte length of each token, and ``encode`` of texts that begin with a space."""

    def __init__(self, names: list[bytes], whole: Callable[[list[str]], list]) -> None:
        self.names, self.whole = names, whole
        self.lengths = np.array([len(n) for n in names], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; none where the tokens' bytes are not the text's own."""
        own = lambda ids, t: b"".join(map(self.names.__getitem__, ids)) == t.encode()
        return [np.array(ids, np.int64) if own(ids, t) else None for ids, t in zip(self.whole(texts), texts, strict=True)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others, in order, for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """Tokenizer A: a byte-level vocabulary file.

    Where each merge makes the next id, ids are merge ranks, and texts in ``PLAIN`` go to the faster library
    for ranks, which gives the same ids; the file's own library takes all others.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    letter, special = _byte_letters(), {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    names = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        names[i] = special[i].encode() if i in special else bytes(map(letter.__getitem__, entry))
    own = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    ranked = _by_ranks(path, {n: i for i, n in enumerate(names) if i not in special})
    if ranked is None:
        return Tokens(names, own)

    def whole(texts: list[str]) -> list:
        plain = [bool(PLAIN.fullmatch(t)) for t in texts]
        rest = iter(own([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [ranked(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]

    return Tokens(names, whole)


def _by_ranks(path: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]] | None:
    """An encoder by ranks, if the file's merges are in the order of its ids and its splitter is the known one."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letter = _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    made = [ranks.get(bytes(map(letter.__getitem__, "".join(m)))) for m in merges]
    cut = file.get("pre_tokenizer") or {}
    if made != list(range(256, 256 + len(made))) or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("use_regex") is False:
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PIECE_A, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> Tokens:
    """Tokenizer B: a sentencepiece model, which puts a space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            names.append(bytes([int(piece[3:5], 16)]))
        else:
            names.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return Tokens(names, lambda texts: model.encode([t[1:] for t in texts], num_threads=1))


def lockstep(a: list[np.ndarray], b: list[np.ndarray], lane: int = LANE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places of the linked tokens in A and in B, in order, from the sorted ends of their tokens."""
    if not a:
        return []
    # all ends on one line: text d's offsets are shifted by what the texts before it take
    size = np.array([int(x[-1]) if len(x) else 0 for x in a], np.int64)
    shift = np.cumsum(size) - size
    own_a, own_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ends_a = np.concatenate(a) + np.repeat(shift, own_a)
    ends_b = np.concatenate(b) + np.repeat(shift, own_b)
    # a lane is a range of offsets; no range begins before a text and ends in it
    lanes = -(-size // lane)
    text = np.repeat(np.arange(len(size)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    top = shift[text] + np.minimum((nth + 1) * lane, size[text])
    stop_a, stop_b = np.searchsorted(ends_a, top, "right"), np.searchsorted(ends_b, top, "right")
    at_a, at_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
    linked_a, linked_b = [], []
    open_ = (at_a < stop_a) & (at_b < stop_b)
    at_a, at_b, stop_a, stop_b = at_a[open_], at_b[open_], stop_a[open_], stop_b[open_]
    while len(at_a):
        x, y = ends_a[at_a], ends_b[at_b]
        cut = x == y
        linked_a.append(at_a[cut])
        linked_b.append(at_b[cut])
        at_a = at_a + (x <= y)
        at_b = at_b + (y <= x)
        open_ = (at_a < stop_a) & (at_b < stop_b)
        if not open_.all():
            at_a, at_b, stop_a, stop_b = at_a[open_], at_b[open_], stop_a[open_], stop_b[open_]
    places_a = np.sort(np.concatenate(linked_a)) if linked_a else np.zeros(0, np.int64)
    places_b = np.sort(np.concatenate(linked_b)) if linked_b else np.zeros(0, np.int64)
    first_a, first_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
    upto = np.searchsorted(places_a, np.append(first_a, len(ends_a)))
    return [(places_a[i:j] - fa, places_b[i:j] - fb) for i, j, fa, fb in zip(upto[:-1], upto[1:], first_a, first_b, strict=True)]


class Written:
    """The groups of a text as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int) -> None:
        # each id with what follows it: a comma inside a group's side, | after the last of A, ; after the last of B
        self.base = n_a
        self.parts = [f"{i}{c}" for c in ",|" for i in range(n_a)] + [f"{i}{c}" for c in ",;" for i in range(n_b)]
        self.n_b = n_b

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``last_a`` and ``last_b``: the places of the last token of each group."""
        if not len(last_a):
            return ""
        kind_a, kind_b = a.copy(), b + 2 * self.base
        kind_a[last_a] += self.base
        kind_b[last_b] += self.n_b
        line = np.empty(len(a) + len(b), np.int64)
        # A's token comes after B's of the groups before; B's comes after A's of its own group too
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        line[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = kind_a
        line[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = kind_b
        return "".join(map(self.parts.__getitem__, line.tolist()))[:-1]


@lru_cache(maxsize=2)
def _written(n_a: int, n_b: int) -> Written:
    return Written(n_a, n_b)


def aligned(texts: list[str], a: Tokens, b: Tokens) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
    """For each text the ids of A and of B and the places of the last token of each group in either; none
    for a text without tokens."""
    spaced = [f" {t}" for t in texts]
    ids_a, ids_b = a.encode(spaced), b.encode(spaced)
    held = [i for i, t in enumerate(texts) if t and ids_a[i] is not None and ids_b[i] is not None]
    places = lockstep([np.cumsum(a.lengths[ids_a[i]]) for i in held], [np.cumsum(b.lengths[ids_b[i]]) for i in held])
    out: list = [None] * len(texts)
    for i, (x, y) in zip(held, places, strict=True):
        out[i] = ids_a[i], ids_b[i], x, y
    return out


def _slices(texts: list[str], most: int) -> Iterator[list[str]]:
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > most:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Each text aligned, stored: ``row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``
    (and ``groups`` if asked for).

    ``pairs`` holds the distinct linked pairs of a text as ``id of A * size of B + id of B``, ``times`` how
    often each occurs. ``row`` tells rows apart. Null and empty texts, and texts whose tokens' bytes are not
    those of a space and the text, have no tokens: zeros, an empty text in place of the digest.
    """
    small_batches(docs.sparkSession)
    fields = [("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
              ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    kind = pa.struct(fields)

    @F.arrow_udf("struct<row:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,groups:string,pairs:array<bigint>,times:array<int>>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = byte_level(path_a), sentence_pieces(path_b)
        write, row = _written(len(a.names), len(b.names)), TaskContext.get().partitionId() << 33
        for column in batches:
            made = {name: [] for name, _ in fields}
            whole = [t.decode("utf-8", "replace") for t in utf8(column)]
            for found in chain.from_iterable(aligned(s, a, b) for s in _slices(whole, SLICE)):
                x, y, last_a, last_b = found or (np.zeros(0, np.int64),) * 4
                line = write.groups(x, y, last_a, last_b)
                pairs, times = np.unique(x[last_a] * len(b.names) + y[last_b], return_counts=True)
                sha = hashlib.sha256(line.encode()).hexdigest() if len(x) else ""
                values = (row, len(x), len(y), len(last_a), len(last_a), sha, line if groups else None, pairs, times.astype(np.int32))
                for (name, _), v in zip(fields, values, strict=True):
                    made[name].append(v)
                row += 1
            yield pa.StructArray.from_arrays([pa.array(made[n], t) for n, t in fields], fields=list(kind))

    out = docs.select(docs[f"`{key}`"].alias(key), work(docs[f"`{text}`"]).alias("made of"))
    kept = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups, "pairs", "times"]
    return stored(out.select(f"`{key}`", *(f"`made of`.{c}" for c in kept)), "aligned")


def pair_totals(made: DataFrame, n_b: int) -> DataFrame:
    """``pair, total, best`` for each linked id pair: its links in all texts, and whether no pair of its B id
    has more."""
    each = made.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("e.pairs", "e.times")
    totals = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total")), "pairs")
    # one row for each id of B at most
    most = totals.groupBy(F.pmod("pair", F.lit(n_b)).alias("b")).agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), F.pmod(totals["pair"], F.lit(n_b)) == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, groups: bool = False) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``path_a`` names a byte-level BPE file, ``path_b`` a sentencepiece model; every worker can read both.
    A pair's count is the number of links in all rows that hold it linked, repeated rows each counted.
    ``n_best`` are the links whose count is the highest of their B id, ties included; ``count_sum`` adds
    the counts over the links. ``groups`` keeps the written groups too. Null and empty texts, and texts
    that the tokens' bytes do not give back, have zeros and ''. A null key is kept; an empty table gives no
    row; other columns are left out, whatever their names. Long texts are many lanes of the merge.
    """
    made = alignments(docs, path_a, path_b, key, text, groups)
    n_b = len(sentence_pieces(path_b).names)
    totals = stored(pair_totals(made, n_b), "totals")
    least = at_least(totals, F.col("total"), frequent)
    links = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    common = F.broadcast(totals.where(F.col("total") >= least))
    met = links.join(common, "pair", "left")
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("total")).cast("long").alias("count_sum"),
    ]
    first = met.groupBy("row").agg(*sums)
    rare = links.join(common, "pair", "left_anti").join(totals.where(F.col("total") < least), "pair").groupBy("row").agg(*sums)
    both = first.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = [f"`{key}`", "n_a", "n_b", "n_groups", "n_links"]
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return made.drop("pairs", "times").join(both, "row", "left").select(*kept, *zero, "groups_sha256", *["groups"] * groups)
