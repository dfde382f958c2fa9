"""Text-to-value scalars for the raw price files (native expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The date layouts of the three raw inputs, as Spark patterns, and
# the Python strftime layouts they stand for.
#   stock files       'd-MMM-yy'     ('%d-%b-%y', e.g. 31-Dec-13)
#   index TSV file    'MMM d, yyyy'  ('%b %d, %Y', e.g. Dec 31, 2013)
#   index CSV files   'yyyy-MM-dd'   ('%Y-%m-%d', e.g. 2013-12-31)
STOCK_DATE = "d-MMM-yy"
INDEX_TSV_DATE = "MMM d, yyyy"
INDEX_CSV_DATE = "yyyy-MM-dd"

# Fixed value: two-digit years 69..99 mean 1969..1999 and 00..68 mean 2000..2068
# (the strptime %y rule); Spark's 'yy' always maps to 2000..2099.
TWO_DIGIT_YEAR_PIVOT = 2068


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_text(c, pattern: str) -> Column:
    """Parse a date string; unparseable text gives NULL instead of failing the job."""
    c = _as_col(c)
    d = F.try_to_date(F.trim(c), pattern)
    if "yy" in pattern and "yyyy" not in pattern:
        d = F.when(F.year(d) > TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_number_text(c, allow_negative: bool = False) -> Column:
    """Numbers such as ``1,200.00``: commas removed; other text gives NULL.

    By default only digits and dots are accepted, so a minus sign or an exponent
    yields NULL (the stock loader's rule); with ``allow_negative`` signs and exponents are
    numbers too (the rule of the factor files, which are read as numbers).
    Malformed numbers such as ``1.2.3`` are NULL.
    """
    c = _as_col(c)
    s = F.replace(F.trim(c.cast("string")) if allow_negative else c.cast("string"), F.lit(","), F.lit(""))
    pattern = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$" if allow_negative else r"^[0-9.]+$"
    return F.when(s.rlike(pattern), s.try_cast("double"))


def nan_to_null(c) -> Column:
    """Missing values become SQL NULL once, at ingest (NaN would poison avg/stddev)."""
    c = _as_col(c)
    return F.nanvl(c, F.lit(None))
