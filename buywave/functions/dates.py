"""Date text of trend points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thin space and the four dash variants (non-breaking hyphen, figure dash, en dash, em dash)
# that date labels carry. Fixed values.
ODD_CHARACTERS = " ‑‒–—"
PLAIN_CHARACTERS = " ----"

_MONTHS = {
    "Jan": 1,
    "Feb": 2,
    "Mar": 3,
    "Apr": 4,
    "May": 5,
    "Jun": 6,
    "Jul": 7,
    "Aug": 8,
    "Sep": 9,
    "Oct": 10,
    "Nov": 11,
    "Dec": 12,
}


def trend_date(text: Column | str) -> Column:
    """First date of a trend label, null when the label is not a date.

    Forms: ``Jun 4, 2025``; ``Dec 1–7, 2024``; ``Dec 29, 2024–Jan 4, 2025`` (the year next to
    the first day wins, so the last form gives 2024-12-29).
    """
    text = F.col(text) if isinstance(text, str) else text
    label = F.trim(F.translate(text, ODD_CHARACTERS, PLAIN_CHARACTERS))
    first = r"^([A-Za-z]{3})\s+(\d{1,2})"
    single_or_full = first + r"\s*,\s*(\d{4})(?:\s*-.*\d{4})?$"
    range_of_days = first + r"\s*-.*?(\d{4})$"
    month = F.initcap(F.regexp_extract(label, first, 1))
    day = F.regexp_extract(label, first, 2)
    year = F.coalesce(
        F.nullif(F.regexp_extract(label, single_or_full, 3), F.lit("")),
        F.nullif(F.regexp_extract(label, range_of_days, 3), F.lit("")),
    )
    number = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])
    iso = F.format_string(
        "%s-%02d-%02d",
        year,
        F.coalesce(F.try_element_at(number, month), F.lit(0)),
        F.coalesce(day.try_cast("int"), F.lit(0)),
    )
    # try_cast turns impossible dates (month 0, Feb 30) and a missing year into null.
    return iso.try_cast("date")
