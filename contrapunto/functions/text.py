"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrapunto import schemas as S

# Accented Latin letters and their base letters.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def fold(c) -> Column:
    """Upper case without accents, for matching."""
    return F.upper(strip_accents(c))


def squeeze(c) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(col(c), r"\s+", " ")


def blank_to_null(c) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def null_placeholder(c) -> Column:
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin(S.PLACEHOLDERS), c)


def any_contains(c, words: list[str]) -> Column:
    """True when the text holds at least one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def norm_words(c) -> Column:
    """Lower case, accents off, single spaces: the form names are compared in."""
    return F.trim(squeeze(F.lower(strip_accents(F.coalesce(col(c), F.lit(""))))))


def flatten_url(c) -> Column:
    """``{"url": "..."}`` or plain text to plain text."""
    c = col(c)
    parsed = F.try_variant_get(F.try_parse_json(c), "$.url", "string")
    return F.coalesce(parsed, c)


def leading_number(c) -> Column:
    """``35A`` out of ``35A. ADICIONES VALOR TOTAL``; null without a number."""
    return blank_to_null(F.regexp_extract(F.trim(col(c)), r"^(\d+[A-Z]?)\.", 1))


def natural_key(c) -> Column:
    """Sort key giving 4 < 12 < 35A < 35B, labels without a number last."""
    c = col(c)
    number = F.regexp_extract(c, r"^(\d+)([A-Z]?)$", 1).try_cast("int")
    return F.struct(
        F.coalesce(number, F.lit(10000)).alias("n"),
        F.when(number.isNotNull(), F.regexp_extract(c, r"^(\d+)([A-Z]?)$", 2)).otherwise(c).alias("t"),
    )
