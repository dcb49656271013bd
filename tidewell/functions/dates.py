"""Publication instants as Column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names by their first three letters (fixed values).
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Numbers above this are milliseconds.
MILLISECONDS_FROM = 1e11
#: Instants that a calendar of the years 1 to 9999 holds, in seconds.
_FIRST, _LAST = -62135596800, 253402300799


#: Time zone names of RFC 822 and their offsets (fixed values); these do not move with the season.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


#: ISO 8601, extended or basic: a calendar date, or a week date with a day or without (then the week's Monday). In a basic
#: week date, digits that follow are a day, or a separator and a time, as their number allows.
_DATE = r"(?:(\d{4})(-?)(\d{2})\2(\d{2})|(\d{4})-W(\d{2})(?:-(\d)(?!\d))?|(\d{4})W(\d{2})(?:(\d)(?=(?:\d(?:\d\d)*)?(?!\d))|(?=(?:\d(?:\d\d)+)?(?!\d))))"
#: After any one character a time to hours, minutes, seconds or fractions, and an offset of the same form.
_CLOCK = r"(\d{2})(?:(:?)(\d{2})(?:\%d(\d{2})(?:[.,](\d+))?)?)?"
_ISO = rf"(?s)^{_DATE}(?:.{_CLOCK % 12}(?:([+-]){_CLOCK % 18}|Z)?|Z)?\z"
#: What is read from it: year, month, day; week, its day; hours, minutes, seconds, fraction; sign, and the same four.
_MARK = "\x1f"
_PARTS = _MARK.join(("$1$5$8", "$3", "$4", "$6$9", "$7$10", "$11", "$13", "$14", "$15", "$16", "$17", "$19", "$20", "$21"))
_DAY_MICROS = 86_400_000_000


def _int(text: Column) -> Column:
    """A number; zero where the text is empty."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _made(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a date of the years 1 to 9999, or null."""
    zero = F.lit(0)
    return F.when(year > 0, F.try_make_timestamp(year, month, day, zero, zero, zero))


def _week_day(year: Column, week: Column, day: Column) -> Column:
    """Midnight of a day of an ISO week; null where the year has no such week."""
    start = F.date_trunc("week", _made(year, F.lit(1), F.lit(4))).cast("date")
    monday = F.date_add(start, (week - 1) * 7)
    return F.when(day.between(1, 7) & (F.weekofyear(monday) == week), F.date_add(monday, day - 1).cast("timestamp"))


def iso(text: Column) -> Column:
    """ISO 8601 date (calendar or week date) or date and time, extended or basic; without an offset it is UTC."""
    parts = F.split(F.when(~F.contains(text, F.lit(_MARK)), F.regexp_replace(text, _ISO, _PARTS)), _MARK)

    def number(part: Column, i: Column) -> Column:
        digits = F.when(i.isin(8, 13), F.rpad(F.left(part, F.lit(6)), 6, "0")).when((i == 4) & (part == ""), "1").when(i == 9, F.concat(part, F.lit("1"))).otherwise(part)
        return F.coalesce(digits.try_cast("bigint"), F.lit(0))

    def instant(n: Column) -> Column:
        at = [F.get(n, F.lit(i)) for i in range(14)]
        year, month, day, week, week_day = (x.cast("int") for x in at[:5])
        there = F.when(week == 0, F.when(month > 0, _made(year, month, day))).otherwise(_week_day(year, week, week_day))
        clock, offset = (((at[i] * 60 + at[i + 1]) * 60 + at[i + 2]) * 1_000_000 + at[i + 3] for i in (5, 10))
        moved = F.unix_micros(there) + clock - at[9] * offset
        sane = (at[5] < 24) & (at[6] < 60) & (at[7] < 60) & (offset < _DAY_MICROS) & moved.between(_FIRST * 1_000_000, _LAST * 1_000_000 + 999_999)
        return F.when(sane, F.timestamp_micros(moved))

    numbers = F.transform(F.filter(F.array(parts), lambda p: F.size(p) == 14), lambda p: F.transform(p, number))
    return F.get(F.transform(numbers, instant), F.lit(0))


def epoch(number: Column) -> Column:
    """Seconds, or above ``MILLISECONDS_FROM`` milliseconds, since 1970; null out of range."""
    seconds = F.when(number > MILLISECONDS_FROM, number / 1000).otherwise(number)
    return F.when(seconds.between(_FIRST, _LAST), F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))


def rfc822(text: Column) -> Column:
    """RFC 822 date and time, its weekday ignored. Two-digit years up to 49 are of this century, others of the last (RFC 2822)."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", ""), r"\s+")
    year, zone = F.get(parts, F.lit(2)), F.upper(F.get(parts, F.lit(4)))
    century = F.when(F.regexp_like(year, F.lit("^[0-4][0-9]$")), "20").when(F.regexp_like(year, F.lit("^[5-9][0-9]$")), "19").otherwise("")
    offset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone), zone)
    plain = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(century, year), F.get(parts, F.lit(3)), offset)
    read = F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")))
    return F.when(F.size(parts) == 5, read)


#: A month's name, a day and a year beside it, as pages show them (fixed values): month, day, year; and day, month, year.
_NAME, _DAY, _YEAR = "([A-Za-z]{3,9})", "([0-9]{1,2})", "([0-9]{4})"
_MONTH_FIRST = rf"(?U){_NAME}\.?\s+{_DAY}(?:st|nd|rd|th)?,?\s+{_YEAR}"
_DAY_FIRST = rf"(?U){_DAY}\s+{_NAME}\.?,?\s+{_YEAR}"
#: Numeric dates (fixed values).
_NUMERIC = {r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d", r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy", r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d"}


def _worded(text: Column) -> Column:
    """The first place in a text that reads month, day, year; where it is no date, the first that reads day, month, year."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def first(form: str, month: int, day: int) -> Column:
        number = F.try_element_at(months, F.lower(F.left(F.regexp_extract(text, form, month), F.lit(3))))
        return _made(_int(F.regexp_extract(text, form, 3)), number, _int(F.regexp_extract(text, form, day)))

    return F.coalesce(first(_MONTH_FIRST, 1, 2), first(_DAY_FIRST, 2, 1))


def displayed(text: Column) -> Column:
    """A date shown on a page: ISO, numeric (Y-M-D, D/M/Y, Y/M/D), or with an English month name."""
    read = [F.when(F.regexp_like(text, F.lit(form)), F.try_to_timestamp(text, F.lit(pattern))) for form, pattern in _NUMERIC.items()]
    return F.coalesce(iso(text), *read, _worded(text))
