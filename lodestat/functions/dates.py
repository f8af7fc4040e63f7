"""Reading dates written in many ways."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month and weekday names and their English counterparts.
MONTHS_FR = {
    "janvier": "january", "fevrier": "february", "février": "february", "mars": "march", "avril": "april",
    "mai": "may", "juin": "june", "juillet": "july", "aout": "august", "août": "august",
    "septembre": "september", "octobre": "october", "novembre": "november", "decembre": "december",
    "décembre": "december",
}
WEEKDAYS_FR = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]

# Accepted layouts, in Spark pattern letters.
ISO_LAYOUTS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM", "yyyy/MM"]
DAY_FIRST_LAYOUTS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy HH:mm", "d/M/yyyy HH:mm:ss", "d/M/yy", "d-M-yy"]
MONTH_FIRST_LAYOUTS = ["M/d/yyyy", "M-d-yyyy", "M/d/yyyy hh:mm a", "M/d/yy", "M-d-yy"]
TEXT_LAYOUTS = ["d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMM yy",
                "MMMM yyyy", "MMM yyyy"]
COMPACT_LAYOUTS = ["yyyyMMdd", "ddMMyyyy"]
MONTH_YEAR_LAYOUTS = ["M/yyyy", "M-yyyy"]

# Words that mark a column name as temporal.
NAME_WORDS = ["date", "datetime", "time", "timestamp", "year", "annee", "année", "mois", "month", "semaine", "week",
              "trimestre", "quarter", "an"]
_NAME = re.compile(r"(?:^|[_\s])(" + "|".join(NAME_WORDS) + r")(?:$|[_\s\d])")
ISO_WEEK = "^([0-9]{4})[- ]?[WwSs]([0-9]{1,2})$"
EXCEL_EPOCH = "1899-12-30"


def has_temporal_name(name: str) -> bool:
    return bool(_NAME.search((name or "").lower().strip()))


_MONTH_WORD = "(?<![\\p{L}0-9_])(" + "|".join(MONTHS_FR) + ")(?![\\p{L}0-9_])"


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise_date_text(c: Column) -> Column:
    """Lower case, French weekday dropped, French month names in English."""
    text = F.regexp_replace(F.lower(F.trim(c.cast("string"))), "^(" + "|".join(WEEKDAYS_FR) + ")\\s+", "")
    english = F.create_map(*[F.lit(x) for pair in MONTHS_FR.items() for x in pair])

    def translate(t: Column) -> Column:
        return bind(F.regexp_extract(t, _MONTH_WORD, 1), lambda w: F.when(w == "", t).otherwise(F.replace(t, w, english[w])))

    return bind(text, lambda t: F.when(t.rlike("\\p{L}{3}"), translate(t)).otherwise(t))


_PIECES = [("yyyy", "[0-9]{4}"), ("yy", "[0-9]{2}"), ("MMMM", "[a-z]{3,9}"), ("MMM", "[a-z]{3}"), ("MM", "[0-9]{2}"),
           ("M", "[0-9]{1,2}"), ("dd", "[0-9]{2}"), ("d", "[0-9]{1,2}"), ("HH", "[0-9]{2}"), ("hh", "[0-9]{2}"),
           ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"), ("a", "[apAP][mM]"), ("'T'", "T")]


def layout_shape(layout: str) -> str:
    """Regular expression of the texts a layout could read."""
    out, at = "", 0
    while at < len(layout):
        for piece, shape in _PIECES:
            if layout.startswith(piece, at):
                out, at = out + shape, at + len(piece)
                break
        else:
            out, at = out + re.escape(layout[at]), at + 1
    return f"^{out}$"


def first_layout(text: Column, layouts: list[str]) -> Column:
    """First layout that reads the text; a layout is tried only on texts of its shape,
    because a failed parse costs far more than a failed match."""
    return F.coalesce(*[F.when(text.rlike(layout_shape(p)), F.try_to_timestamp(text, F.lit(p))) for p in layouts])


def parse_iso_week(text: Column) -> Column:
    """Monday of an ISO week written 2021-W05 or 2021S5."""
    year = F.regexp_extract(text, ISO_WEEK, 1)
    week = F.regexp_extract(text, ISO_WEEK, 2).try_cast("int")
    jan4 = F.try_to_timestamp(F.concat(year, F.lit("-01-04")), F.lit("yyyy-MM-dd"))
    monday = F.date_trunc("week", jan4)
    return F.when(text.rlike(ISO_WEEK) & week.between(1, 53),
                  F.date_add(monday.cast("date"), (week - 1) * 7).cast("timestamp"))


def parse_date(c: Column, day_first: bool = True) -> Column:
    """First layout that fits; the preferred day/month order is tried before the other."""
    numeric = [*DAY_FIRST_LAYOUTS, *MONTH_FIRST_LAYOUTS] if day_first else [*MONTH_FIRST_LAYOUTS, *DAY_FIRST_LAYOUTS]

    def read(text: Column) -> Column:
        upper = F.upper(text)
        return (F.when(text.rlike("^[0-9]{4}[-/]"), F.coalesce(first_layout(upper, ISO_LAYOUTS), parse_iso_week(text)))
                .when(text.rlike("^[0-9]{1,2}[-/.]"), F.coalesce(first_layout(upper, numeric), first_layout(text, MONTH_YEAR_LAYOUTS)))
                .when(text.rlike("^([0-9]{1,2} )?[a-z]{3,9} "), first_layout(text, TEXT_LAYOUTS))
                .when(text.rlike("^[0-9]{8}$"), first_layout(text, COMPACT_LAYOUTS))
                .when(text.rlike(ISO_WEEK), parse_iso_week(text)))

    return bind(normalise_date_text(c), read)


def compact_date(number: Column, kind: str) -> Column:
    """Timestamp from 2021, 202101, 20210115 or a spreadsheet day number."""
    whole = F.rint(number.cast("double")).cast("bigint")
    layouts = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd"}
    if kind in layouts:
        return F.try_to_timestamp(whole.cast("string"), F.lit(layouts[kind]))
    if kind == "serial":
        return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), whole.cast("int")).cast("timestamp")
    raise ValueError(f"unknown compact date kind {kind}")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
