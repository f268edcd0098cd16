"""Language identification by Bayesian fusion of evidence.

For each language (and ``und``, none of them) the log of four terms is added: likelihood of the text under
a character-trigram model, agreement with the language the markup declares, agreement with the address
suffix, and a prior of the host. Host priors are smoothed over a hierarchy (all documents, suffix, host)
and come from grouped sums of what the texts alone say; a document's own share is taken out of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cols, fresh, prefix, small_batches, stored, utf8

BUCKETS = 1 << 16
#: No language: also the answer where nothing else fits.
UND = "und"
#: Labelled documents the trigram model is fitted on, drawn by a seeded sample.
TRAIN_DOCS = 4_000
#: Trigrams beyond which a longer text adds little certainty.
ENOUGH = 200.0
#: Documents' worth of the level above in a prior.
STRENGTH = 10.0
#: How often a declared language, or that of a country suffix, is right.
DECLARED, SUFFIX = 0.9, 0.6
#: Bytes of one text looked at at a time.
PIECE = 1 << 20

#: Fixed: country suffixes and the language they suggest.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es",
    "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl",
}

#: ASCII that is not a letter separates words; other bytes stay.
_TABLE = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Bucket of each byte trigram of a lower-cased text, but of those with two blanks in a row."""
    for start in range(0, len(text), PIECE):
        raw = _TABLE[np.frombuffer(text[max(0, start - 2) : start + PIECE], np.uint8)]
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        code = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
        yield code[~(((a == 32) & (b == 32)) | ((b == 32) & (c == 32)))]


def lowered(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def fit(docs: DataFrame, text: str, labelled: str, train_docs: int = TRAIN_DOCS, seed: int = 9) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of each bucket (last row: ``und``, uniform), from at most
    about ``train_docs`` documents with a label. What reaches the driver is bounded by languages and buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for lang, t in zip(batch.column(1).to_pylist(), utf8(batch.column(0))):
                for part in buckets(lowered(t)):
                    seen[lang] = seen.get(lang, 0) + np.bincount(part, minlength=BUCKETS)
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    known = docs.select(docs[f"`{text}`"].alias("text"), docs[f"`{labelled}`"].alias("lang")).where("lang is not null and text is not null")
    share = min(1.0, train_docs / max(1, known.count()))
    rows = known.sample(share, seed).mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows} - {UND})
    counts = np.zeros((len(langs) + 1, BUCKETS))
    for r in rows:
        if r.lang != UND:
            counts[langs.index(r.lang), r.bucket] = r.n
    counts[:-1] += 0.1
    counts[-1] = 1
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(text: bytes, model: np.ndarray) -> list[float]:
    """Log-likelihood of each language, scaled so that a long text is no more certain than ``ENOUGH``
    trigrams would be; zeros without any trigram."""
    total, n = np.zeros(len(model)), 0
    for part in buckets(lowered(text)):
        total += model[:, part].sum(axis=1, dtype=np.float64)
        n += len(part)
    if not n:
        return total.tolist()
    scaled = total / n * (n / (1 + n / ENOUGH))
    return (scaled - scaled.max()).tolist()


def markup_language(text: Column) -> Column:
    """The language an ``html`` or ``body`` tag declares, without its region; null where none does."""
    found = F.regexp_extract(text, r"(?i)<(?:html|body)\b[^<>]{0,300}?\b(?:xml:)?lang\s{0,9}=\s{0,9}[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.lower(F.regexp_extract(host, r"\.([A-Za-z]{2,24})(?::[0-9]+)?$", 1))


def identify(
    docs: DataFrame, keep: list[str], text: str = "text", labelled: str = "lang", host: Column | None = None,
    declared: Column | None = None, bar: float = 0.5, train_docs: int = TRAIN_DOCS, model: tuple[list[str], np.ndarray] | None = None,
    out: tuple[str, str, str] = ("language", "confidence", "accepted"),
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and three more, named by ``out``, for every row.

    ``language`` is the most probable one, ``confidence`` its probability, ``accepted`` is false where it is
    ``und``, where confidence is below ``bar``, or where the text has no letter. ``host`` is an expression over
    ``docs`` (null and empty are one host of their own); ``declared`` is one too, by default what the
    markup in the text says. ``labelled`` is read only to fit the trigram model, or not at all if ``model``
    is given. A null text counts as empty. Repeated rows each give a row; an empty table gives none, and
    a table without labels knows no language.
    """
    small_batches(docs.sparkSession)
    langs, table = fit(docs, text, labelled, train_docs) if model is None else model
    names, sent = [*langs, UND], docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    def evidence(column: pa.Array) -> pa.Array:
        return pa.array([text_evidence(t, sent.value) for t in utf8(column)], pa.list_(pa.float64()))

    whole = docs[f"`{text}`"]
    ll, at, end, said, some = fresh(docs, "evidence", "host", "suffix", "declared", "letters")
    place = F.coalesce(host if host is not None else F.lit(""), F.lit(""))
    base = docs.select(
        *cols(docs, *keep), evidence(whole).alias(ll), place.alias(at), suffix_of(place).alias(end),
        (declared if declared is not None else markup_language(whole)).alias(said),
        F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias(some),
    )
    if text not in keep:  # whole texts are rather read twice than written once more
        base = stored(base, "languages")
    span, e = range(len(names)), F.col(ll)
    norm = sum((F.exp(e[i]) for i in span), F.lit(0.0))
    share = [F.when(F.col(some), F.exp(e[i]) / norm).otherwise(0.0) for i in span]  # what the text alone says
    p = prefix(base)
    seen = F.col(some).cast("double")
    by_host = base.groupBy(F.col(at).alias(f"{p}h"), F.col(end).alias(f"{p}s")).agg(F.sum(seen).alias(f"{p}hn"), *(F.sum(share[i]).alias(f"{p}h{i}") for i in span))
    by_host = stored(by_host, "hosts")
    by_suffix = by_host.groupBy(f"{p}s").agg(F.sum(f"{p}hn").alias(f"{p}sn"), *(F.sum(f"{p}h{i}").alias(f"{p}s{i}") for i in span))
    every = by_suffix.agg(F.sum(f"{p}sn").alias("n"), *(F.sum(f"{p}s{i}").alias(f"g{i}") for i in span)).first()
    total = every.n or 0.0
    prior = [((every[f"g{i}"] or 0.0) + 1.0) / (total + len(names)) for i in span]
    levels = stored(by_host.join(by_suffix, f"{p}s").select(f"{p}h", f"{p}hn", f"{p}sn", *(f"{p}h{i}" for i in span), *(f"{p}s{i}" for i in span)), "hosts")
    joined = base.join(levels, base[at].eqNullSafe(levels[f"{p}h"]), "left")

    def smooth(i: int) -> Column:
        """Prior of language i at the host, without the document itself."""
        up = (F.col(f"{p}s{i}") - share[i] + STRENGTH * prior[i]) / (F.col(f"{p}sn") - seen + STRENGTH)
        return F.log(F.greatest((F.col(f"{p}h{i}") - share[i] + STRENGTH * up) / (F.col(f"{p}hn") - seen + STRENGTH), F.lit(1e-6)))

    def agrees(claim: Column, i: int, right: float) -> Column:
        """Log-probability of a claim under language i: right with probability ``right``, else any other."""
        other = math.log((1 - right) / max(1, len(names) - 1))
        same = claim == F.lit(names[i]) if names[i] != UND else ~claim.isin(langs)
        return F.when(claim.isNull(), 0.0).when(same, math.log(right)).otherwise(other)

    country = F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv)), F.col(end))
    country = F.when(country.isin(langs), country)
    scores = [e[i] + smooth(i) + agrees(F.col(said), i, DECLARED) + agrees(country, i, SUFFIX) for i in span]
    scored = joined.select(*(F.col(f"`{c}`") for c in keep), F.col(some).alias(some), F.array(*scores).alias(ll))
    best = F.array_max(ll)
    weights = F.aggregate(F.transform(ll, lambda x: F.exp(x - best)), F.lit(0.0), lambda s, x: s + x)
    language, sure = F.element_at(F.array(*map(F.lit, names)), F.array_position(ll, best).cast("int")), F.round(1 / weights, 6)
    return scored.select(
        *(F.col(f"`{c}`") for c in keep), language.alias(out[0]), sure.alias(out[1]),
        (F.col(some) & (language != UND) & (sure >= bar)).alias(out[2]),
    )


def accepted(docs: DataFrame, text: str = "text", labelled: str = "lang", host: str = "source", **more) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; columns stay as they are."""
    out = fresh(docs, "language", "confidence", "accepted")
    found = identify(docs, docs.columns, text, labelled, docs[f"`{host}`"], out=tuple(out), **more)
    return found.where(F.col(out[2])).select(*cols(found, *docs.columns))
