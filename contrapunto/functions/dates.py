"""Date text to dates, years and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.text import blank_to_null, col, strip_accents

_LONG_ES = r"(?i)\b(\d{1,2})\s+de\s+(" + "|".join(S.MONTHS_ES) + r")\s+de\s+(\d{4})"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def norm_date(c) -> Column:
    """ISO prefix or day/month/year; the first bar-separated segment counts."""
    s = F.trim(F.substring_index(col(c), "|", 1))
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    dmy = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    return F.coalesce(
        F.try_to_date(blank_to_null(iso), "yyyy-MM-dd"),
        F.when(s.rlike(dmy), _ymd(F.regexp_extract(s, dmy, 3), F.regexp_extract(s, dmy, 2), F.regexp_extract(s, dmy, 1))),
    )


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for kv in S.MONTHS_ES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name)).cast("string")


def norm_date_es(c) -> Column:
    """The first long Spanish date of the text."""
    s = strip_accents(c)
    part = lambda i: F.regexp_extract(s, _LONG_ES, i)
    return F.when(s.rlike(_LONG_ES), _ymd(part(3), _month_number(part(2)), part(1)))


def last_long_date(c, first_year: int = 1990, last_year: int = 2030) -> Column:
    """The last long Spanish date of the text whose year is in range."""
    found = F.regexp_extract_all(col(c), F.lit(_LONG_ES), F.lit(0))
    dates = F.transform(found, norm_date_es)
    valid = F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(first_year, last_year))
    return F.try_element_at(valid, F.lit(-1))


def year_of(c) -> Column:
    s = F.substring(col(c).cast("string"), 1, 4)
    return F.when(s.rlike(r"^\d{4}$"), s)


def sheet_year(c) -> Column:
    """The four digits a sheet name ends with."""
    return blank_to_null(F.regexp_extract(col(c), r"\b(\d{4})\s*$", 1))


def age_days(c, as_of) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), col(c))
