"""Columns for the default access-log line format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line needs this many tokens; the last one keeps the rest of the line.
TOKENS = 12

# Month abbreviations in calendar order, three letters each, and their numbers.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH_NUMBERS = "01 02 03 04 05 06 07 08 09 10 11 12"

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = "[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}$"
_TOKEN = rf"^\[[0-9]{{2}}/{_MONTH}/{_CLOCK}"
_DATE = f"^[0-9]{{2}}-{_MONTH}-{_CLOCK}"
_ANY_DATE = f"^[0-9]{{1,2}}-(?i:{_MONTH})-{_CLOCK}"


def without_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def line_tokens(line: Column) -> Column:
    """Split on runs of spaces into at most twelve tokens.

    Runs are squeezed first, only in lines that have one, so that the split itself needs no
    regular expression and the twelfth token is the tail of the line joined by single spaces.
    """
    squeezed = F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " "))
    return F.split(F.coalesce(squeezed, line), " ", TOKENS)


def _iso(text: Column, day: int, any_case: bool = False) -> Column:
    """``2024-01-01 00:03:52`` from a date whose two-digit day starts at character ``day``."""
    name = F.substring(text, day + 3, 3)
    months = MONTHS.lower() if any_case else MONTHS
    place = F.call_function("instr", F.lit(months), F.lower(name) if any_case else name)
    return F.concat(
        F.substring(text, day + 7, 4),
        F.lit("-"),
        F.substring(F.lit(MONTH_NUMBERS), place, F.lit(2)),
        F.lit("-"),
        F.substring(text, day, 2),
        F.lit(" "),
        F.substring(text, day + 12, 8),
    )


def _any_iso(text: Column) -> Column:
    """The same for one-digit days and months in any case."""
    return F.when(text.rlike(_ANY_DATE), _iso(F.lpad(text, 20, "0"), 1, any_case=True))


def log_date(text: Column) -> Column:
    """``01-Jan-2024:00:03:52`` as ``2024-01-01 00:03:52``; NULL if the form is wrong.

    The usual form is cut at fixed places; ``1-jan-2024:00:03:52`` is accepted by a slower way. The
    day may still be missing from the calendar: ``timestamp`` tells.
    """
    return F.when(text.rlike(_DATE), _iso(text, 1)).otherwise(_any_iso(text))


def token_date(token: Column) -> Column:
    """The same for a ``[01/Jan/2024:00:03:52`` token, cleaned first if it has another form."""
    no_bracket = F.replace(without_quotes(token), F.lit("["), F.lit(""))
    cleaned = F.replace(no_bracket, F.lit("/"), F.lit("-"))
    return F.when(token.rlike(_TOKEN), _iso(token, 2)).otherwise(_any_iso(cleaned))


def timestamp(iso: Column) -> Column:
    """As TIMESTAMP_NTZ, NULL if there is no such day. The session time zone plays no role."""
    return iso.try_cast("timestamp_ntz")


def _strip_slashes(text: Column, trailing_only: bool) -> Column:
    return F.rtrim(text, F.lit("/")) if trailing_only else F.btrim(text, F.lit("/"))


def normalize_uri(uri: Column, trailing_only: bool = False) -> Column:
    """A URI that ends in a slash and is longer than one loses its slashes at both ends."""
    ends_in_slash = uri.endswith("/") & (F.length(uri) > 1)
    return F.when(ends_in_slash, _strip_slashes(uri, trailing_only)).otherwise(uri)


def normalize_referrer(referrer: Column, omit: str = "", trailing_only: bool = False) -> Column:
    """Absent or omitted referrers become empty; a final slash is stripped, at both ends."""
    absent = referrer == "-"
    if omit:
        absent = absent | F.contains(referrer, F.lit(omit))
    return (
        F.when(absent, F.lit(""))
        .when(referrer.endswith("/"), _strip_slashes(referrer, trailing_only))
        .otherwise(referrer)
    )
