"""Dates as people write them: full, partial or unreadable.

parse_partial reads the forms below into first and last day of the period they name.
Anything else, and any day that does not exist, is null. A time of day is ignored.

  2015-03-23   2015/03/23   2015-03-23T10:00:00   20150323      day
  March 23, 2015   23 March 2015   Mar 23 2015                  day
  2015-03   2015/03   March 2015   Mar 2015                     month
  2015-Q2   2015Q2   Q2 2015                                    quarter
  2015                                                          year
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


_TIME = r"([T ]\d{1,2}:\d{2}.*)?$"
_DAY = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME}"
_PACKED = rf"^\d{{8}}{_TIME}"
_MDY = r"^[A-Za-z]{3,9} \d{1,2} \d{4}$"
_DMY = r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"
_MONTH = r"^\d{4}-\d{1,2}$"
_MY = r"^[A-Za-z]{3,9} \d{4}$"
_YQ = r"^\d{4}[- ]?[Qq][1-4]$"
_QY = r"^[Qq][1-4][- ]?\d{4}$"
_YEAR = r"^\d{4}$"


def _month_no(name: Column) -> Column:
    """Two digits for a month by its full name or first three letters; another word gives '99'."""
    pairs = [x for i, m in enumerate(MONTHS, 1) for k in {m, m[:3]} for x in (F.lit(k), F.lit(f"{i:02d}"))]
    names = F.create_map(*pairs, F.lit("sept"), F.lit("09"))
    return F.coalesce(F.element_at(names, F.lower(name)), F.lit("99"))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once: nested in plain expressions it would be copied at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _canon(s: Column) -> Column:
    """struct(text as yyyy[-mm[-dd]], number of months the period lasts; 0 for a day)."""
    word = lambda i: F.split_part(s, F.lit(" "), F.lit(i))
    quarter_month = F.lpad((F.regexp_extract(s, r"[Qq]([1-4])", 1).cast("int") * 3 - 2).cast("string"), 2, "0")

    def form(text: Column, months: int) -> Column:
        return F.struct(text.alias("text"), F.lit(months).alias("months"))

    return (
        F.when(s.startswith("0000"), F.lit(None))
        .when(s.rlike(_DAY), form(s, 0))
        .when(s.rlike(_PACKED), form(F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3"), 0))
        .when(s.rlike(_MDY), form(F.concat_ws("-", word(3), _month_no(word(1)), word(2)), 0))
        .when(s.rlike(_DMY), form(F.concat_ws("-", word(3), _month_no(word(2)), word(1)), 0))
        .when(s.rlike(_MONTH), form(s, 1))
        .when(s.rlike(_MY), form(F.concat_ws("-", word(2), _month_no(word(1))), 1))
        .when(s.rlike(_YQ) | s.rlike(_QY), form(F.concat_ws("-", F.regexp_extract(s, r"(\d{4})", 1), quarter_month), 3))
        .when(s.rlike(_YEAR), form(s, 12))
    )


def parse_partial(c: Column | str) -> Column:
    """struct(first date, last date) of the named period; both null where the text names none.

    The text is brought to yyyy-mm-dd form by one of a few shapes and cast once, leniently, so days
    that do not exist become null.
    """
    c = F.col(c) if isinstance(c, str) else c
    clean = F.trim(F.regexp_replace(F.translate(c, "/,.", "-  "), r"\s+", " "))

    def ends(k: Column) -> Column:
        first = k["text"].try_cast("date")
        whole = F.last_day(F.add_months(first, k["months"] - 1))
        return F.struct(first.alias("first"), F.when(k["months"] == 0, first).otherwise(whole).alias("last"))

    return _bind(_bind(clean, _canon), ends)


def iso_day(c: Column | str) -> Column:
    """The date in the first ten characters when they read YYYY-MM-DD, else null (never a partial date)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10).try_cast("date"))


def month_floor(c: Column) -> Column:
    """Text date with a missing day completed to the first of the month."""
    return F.when(F.length(c) < 10, F.concat(c, F.lit("-01"))).otherwise(c)

