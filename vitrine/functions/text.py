"""Text expressions: codes, file names, volumes, fences, cleaning, labels."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from vitrine import constants as K

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
# Fixed value: characters that count as blank at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B))
# Fixed value: a token is two or more letters, digits or underscores.
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
#: What lies between tokens.
NOT_TOKEN = r"[^\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Trim every kind of blank, line breaks included."""
    return F.btrim(c, F.lit(BLANKS))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def norm_code(c: Column) -> Column:
    """Trimmed code; a short all-digit code is zero-padded to five places."""
    t = strip(c)
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < 5), F.lpad(t, 5, "0")).otherwise(t)


def cycle_of(file_name: Column) -> Column:
    """Cycle number in a file name, or null."""
    return F.nullif(F.regexp_extract(F.lower(file_name), r"ciclo_(\d+)", 1), F.lit("")).try_cast("int")


def detect_brand(file_name: Column, rules, default: str, fold: bool = True) -> Column:
    """First rule whose pattern the lower-cased name contains; ``fold`` ignores accents."""
    name = F.lower(file_name)
    name = fold_accents(name) if fold else name
    out = None
    for pattern, brand in rules:
        hit = name.contains(pattern)
        out = F.when(hit, brand) if out is None else out.when(hit, brand)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def parse_volume(c: Column) -> Column:
    """Volume text to ``struct(number, unit)`` in ml, g or un; ``2x100ml`` multiplies."""
    s = F.lower(c)  # outer blanks change nothing below
    pair = r"(\d+)\s*x\s*(\d+\.?\d*)"
    left = F.regexp_extract(s, pair, 1).try_cast("double")
    right = F.regexp_extract(s, pair, 2).try_cast("double")
    single = F.regexp_extract(s, r"(\d+\.?\d*)", 1).try_cast("double")
    total = F.coalesce(left * right, single)
    thousandfold = (s.contains("l") & ~s.contains("ml")) | (s.contains("kg") & ~s.contains("l"))
    number = F.when(thousandfold, F.nullif(total, F.lit(0.0)) * 1000).otherwise(total)
    unit = F.when(s.contains("l"), "ml").when(s.contains("g"), "g").otherwise("un")
    present = c.isNotNull() & (c != "")
    return F.struct(F.when(present, number).alias("number"), F.when(present, unit).alias("unit"))


def norm_promo_type(c: Column) -> Column:
    """Promotion type of the closed set; anything unknown is ``none``."""
    t = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    return F.when(t.isin(K.PROMO_TYPES), t).otherwise(F.lit("none"))


def strip_fence(c: Column) -> Column:
    """Drop the markdown fence around a JSON text."""
    t = strip(c)
    cut = F.when(t.startswith("```json"), 8).when(t.startswith("```"), 4).otherwise(1)
    kept = F.when(t.endswith("```"), F.length(t) - 3).otherwise(F.length(t)) - cut + 1
    return strip(F.substring(t, cut, kept))


def clean_text(c: Column) -> Column:
    """Lower case without ASCII punctuation; null becomes empty."""
    return F.coalesce(F.translate(F.lower(c), string.punctuation, ""), F.lit(""))


def words(c: Column) -> Column:
    """Blank-separated words of a text."""
    return F.split(c, r"(?U)\s+")


def tokens(c: Column) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(1))


def label_by_keywords(c: Column, rules, default: str) -> Column:
    """Label of the first rule with a keyword inside the lower-cased text."""
    t = F.lower(c)
    out = None
    for label, keywords in rules:
        hit = None
        for k in keywords:
            hit = t.contains(k) if hit is None else hit | t.contains(k)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def safe_name(c: Column) -> Column:
    """Catalogue name as a file name."""
    return F.lower(F.replace(F.replace(c, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-")))
