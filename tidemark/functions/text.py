"""Reading amounts and the camera's clock from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def decimal_text(text: Column) -> Column:
    """An amount of digits with a point as a decimal(16,2), rounded half up to cents; null where it is none or has more than 13 digits before the point."""
    # cents depend on the third place at most, so further places are cut off, not rounded twice
    short = F.regexp_replace(text, r"([.]\d{3})\d+\z", "$1")
    return F.round(short.try_cast("decimal(16,3)"), 2).cast("decimal(16,2)")


def amount(text: Column) -> Column:
    """A decimal with two places, rounded half up, from text with a currency sign, blanks and a point or comma; null where it is none."""
    return decimal_text(F.translate(F.regexp_replace(text, r"[₽\s  ]", ""), ",", "."))


#: The forms in which a camera's clock is read, month first, in the order they are tried.
_DATE_FORMS = (r"(\d{2})-(\d{2})-(\d{4})", r"(\d{2})[\s.-]+(\d{2})[\s.-]+(\d{4})")
_TIME_FORMS = (
    r"([0-2]?\d)[:.]([0-5]\d)[:.]([0-5]\d)",
    r"([0-2]?\d)[:.\s-]+([0-5]\d)[:.\s-]+([0-5]\d)",
    r"([0-2]\d)([0-5]\d)([0-5]\d)",
    r"([0-2]\d)([0-5]\d)[:.]([0-5]\d)",
    r"([0-2]?\d)[:.\s-]+([0-5]\d)[:.\s-]+(\d)",
)
_TIME_END = r"(?!\d)(?![:.\s-]+\d)"


def tidy_clock(text: Column) -> Column:
    """A clock text with usual misreadings mended: a letter for the year's last digit, no blank or a stray sign around the weekday."""
    t = squeeze(text)
    t = F.regexp_replace(t, r"(?<=202)[fF](?=\D|$)", "6")
    t = F.regexp_replace(t, rf"(?i)(\d{{4}})\s*[/\\-]?\s*({_DAYS})", "$1 $2 ")
    t = F.regexp_replace(t, rf"(?i)\b({_DAYS})y?", "$1")
    return squeeze(F.regexp_replace(t, rf"(?i)\b({_DAYS})(?=\d)", "$1 "))


def clock_date(text: Column) -> Column:
    """The month-day-year date of the first form whose first place in the text is a valid date."""
    found = [F.regexp_extract(text, rf"(?<!\d){form}(?!\d)", 0) for form in _DATE_FORMS]
    return F.coalesce(*[F.try_to_date(F.regexp_replace(x, r"[\s.-]+", "-"), "MM-dd-yyyy") for x in found])


def clock_time(text: Column) -> Column:
    """Seconds of the time of day, after the weekday if there is one: the last valid place of the first form that has one."""
    tail = F.regexp_replace(text, rf"(?is)\A.*?\b(?:{_DAYS})\b", "")

    def seconds(form: str):
        def read(place: Column) -> Column:
            part = F.split(F.regexp_replace(place, form, "$1:$2:$3"), ":")
            h, m, s = (part[i].cast("int") for i in range(3))
            return F.when(h <= 23, h * 3600 + m * 60 + s)

        return read

    def last(form: str) -> Column:
        places = F.regexp_extract_all(tail, F.lit(rf"(?<!\d){form}{_TIME_END}"), 0)
        return F.try_element_at(F.filter(F.transform(places, seconds(form)), lambda x: x.isNotNull()), F.lit(-1))

    return F.coalesce(*map(last, _TIME_FORMS))


def clock_us(text: Column) -> Column:
    """Microseconds of a clock text's wall time since 1970-01-01; null unless it holds both date and time."""
    t = tidy_clock(text)
    return F.unix_date(clock_date(t)).cast("bigint") * 86_400_000_000 + clock_time(t).cast("bigint") * 1_000_000
