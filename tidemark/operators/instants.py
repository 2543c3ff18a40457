"""One UTC instant from timestamps written in many formats, precisions and zones.

A text is read under every format that fits it: its day first or month first, a two-digit year at either end, a zone abbreviation as each
offset it stands for. Each source mixes formats in unknown shares. Expectation-maximisation per source finds them: the E step gives
a text's valid readings their posterior by the current shares, the M step re-estimates the shares from these and a prior. The prior is what
is declared or usual, worth a finite number of texts (``DECLARED_WEIGHT``), so texts that keep contradicting it outweigh it. As
only which formats fit matters, the rounds run over counts per source and set of fitting formats. The reading of the greatest posterior
is chosen; a format whose share of its source stays below ``NOISE_SHARE`` reads nothing, a text whose best posterior is below
``min_posterior`` stays unresolved and is marked ``ambiguous``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut

#: Offsets in minutes of zone abbreviations; the usual one first where there are several.
ZONE_MINUTES = {
    "UTC": (0,), "GMT": (0,), "Z": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360), "CET": (60,), "CEST": (120,), "MEZ": (60,), "MESZ": (120,), "EET": (120,), "EEST": (180,),
    "MSK": (180,), "SAMT": (240,), "YEKT": (300,), "OMST": (360,), "IST": (330, 120, 60), "AWST": (480,), "ACST": (570,), "ACDT": (630,), "AEST": (600,), "AEDT": (660,),
    "EST": (-300,), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,), "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,),
}
#: Month names by their first letters, in lower case.
MONTHS = {
    1: ("jan", "янв", "jän"), 2: ("feb", "фев"), 3: ("mar", "мар", "mär", "mrz"), 4: ("apr", "апр"), 5: ("may", "mai", "мая", "май"), 6: ("jun", "июн"),
    7: ("jul", "июл"), 8: ("aug", "авг"), 9: ("sep", "сен"), 10: ("oct", "okt", "окт"), 11: ("nov", "ноя"), 12: ("dec", "dez", "дек"),
}
#: How many texts a declared or usual format counts for, and each other one; the share below which a format that is not declared is noise.
DECLARED_WEIGHT, BASE_WEIGHT, OTHER_WEIGHT, NOISE_SHARE = 100.0, 1.0, 0.001, 0.05
EM_ROUNDS = 20
#: The usual order of dates with dots, and of those with the year last after dashes or blanks (camera clocks).
USUAL = {"dot": "dmy", "dash": "mdy"}
ORDERS = ("dmy", "mdy", "ymd")
FIRST_US, END_US = 1_420_070_400_000_000, 1_924_992_000_000_000  # 2015 to 2030

_TIME = r"(\d{1,2})[:.h-](\d{2})(?:[:.-](\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])[Mm]\b)?"
_RUN_TIME = r"(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?()"
_ZONE = r"(?: ?(?:(?:UTC|GMT)?([+-])(\d{2})(?::?(\d{2}))?(?!\d)|([A-Za-z]{1,5})(?![A-Za-z/])))?(?: ?\[?([A-Z][A-Za-z]+/[A-Za-z_/]+)\]?)?"
_WEEKDAY = r"(?:[A-Za-zА-Яа-яё]{2,10}\.?,? ?)?"
_NAMED = r"([A-Za-zÄäА-Яа-яё]{3,10})"


def _forms(*forms: tuple[str, str, str, str]) -> tuple:
    return tuple((family, re.compile(rf"{date}{between}{time}{_ZONE}\Z")) for family, date, between, time in forms)


_DASHED = _forms(
    ("ymd", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(?:[T_]|,? )", _TIME),
    ("ymd", r"(\d{4})-(\d{2})-(\d{2})", r"[T_ ]", _RUN_TIME),
)
_WHOLE = _forms(("ymd", r"(\d{4})(\d{2})(\d{2})", r"[T_ ]?", _RUN_TIME))
_YEAR_FIRST = _forms(("ymd", r"(\d{4})[/.](\d{2})[/.](\d{2})", r"[T ]", _TIME))
_DOTTED = _forms(("dot", r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", r"(?:T|,? )", _TIME))
_SLASHED = _forms(("slash", r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", r"(?:T|,? )", _TIME))
_CLOCK = _forms(
    ("dash", r"(\d{1,2})[- ](\d{1,2})[- ](\d{4})", rf" {_WEEKDAY}", _TIME),
    ("dash", r"(\d{1,2})[- ](\d{1,2})[- ](\d{4})", rf" {_WEEKDAY}", _RUN_TIME),
)
_NAMED_DAY = _forms(("dny", rf"{_WEEKDAY}(\d{{1,2}})\.?[ -]{_NAMED}\.?[ -](\d{{4}})", r",? (?:um |at |в )?", _TIME))
_NAMED_MONTH = _forms(("ndy", rf"{_WEEKDAY}{_NAMED}\.?[ -](\d{{1,2}}),?[ -](\d{{4}})", r",? (?:um |at |в )?", _TIME))
_NAMES = _NAMED_DAY + _NAMED_MONTH
#: Forms that may fit a text, by how many digits it begins with and the sign after them.
_BY_START = {(4, "-"): _DASHED, (4, "/"): _YEAR_FIRST, (4, "."): _YEAR_FIRST} | {
    (n, sign): forms for n in (1, 2) for sign, forms in ((".", _DOTTED + _NAMED_DAY), ("/", _SLASHED), ("-", _CLOCK + _NAMED_DAY), (" ", _CLOCK + _NAMED_DAY))
}
_START = re.compile(r"\d*")
_EPOCH = re.compile(r"(\d{10})(?:\.(\d{1,9})|(\d{3}|\d{6}))?\Z")
_BLANKS = re.compile(r"[\s  ]+")
_NONE = (None, None, None, None, None, None, None)
_SCHEMA = "family string, dmy bigint, mdy bigint, ymd bigint, offset_min bigint, abbreviation string, zone string"
_MONTH = {start: m for m, starts in MONTHS.items() for start in starts}
_DAY0 = date(1970, 1, 1).toordinal()


def _day(y: str, m: str | int, d: str) -> int | None:
    try:
        return date(int(y) + (2000 if len(y) == 2 else 0), int(m), int(d)).toordinal() - _DAY0
    except ValueError:
        return None


def read_text(text: str | None) -> tuple:
    """(family, dmy, mdy, ymd, offset_min, abbreviation, zone): wall microseconds of a text's readings by order of day, month and year.

    ``family`` is ``slash``, ``dot`` or ``dash`` where orders compete, else ``one``, with its one reading in all of them. ``abbreviation`` is given where it
    stands for several offsets; ``offset_min`` is null then and where there is no offset, ``zone`` where no region is named.
    """
    if text is None:
        return _NONE
    t = _BLANKS.sub(" ", text).strip()
    digits = _START.match(t).end()
    if digits >= 10 and (e := _EPOCH.match(t)):
        seconds, fraction, more = e.groups()
        us = int(seconds) * 1_000_000 + int((fraction or more or "0").ljust(6, "0")[:6])
        return "one", us, us, us, 0, None, None
    forms = _WHOLE if digits >= 8 else _NAMES if not digits else _BY_START.get((digits, t[digits : digits + 1]), ())
    for family, form in forms:
        if found := form.match(t):
            break
    else:
        return _NONE
    a, b, c, h, mi, s, fraction, half, sign, oh, om, name, region = found.groups()
    hour, minute, second = int(h), int(mi), int(s or 0)
    if half:
        if not 1 <= hour <= 12:
            return _NONE
        hour = hour % 12 + (12 if half in "pP" else 0)
    # a day's 24:00 is left out: the standard no longer has it
    if hour > 23 or minute > 59 or second > 59:
        return _NONE
    offset = abbreviation = None
    if sign:
        if int(oh) > 18 or int(om or 0) > 59:
            return _NONE
        offset = (int(oh) * 60 + int(om or 0)) * (-1 if sign == "-" else 1)
    elif name:
        offsets = ZONE_MINUTES.get(name.upper())
        if offsets is None:
            return _NONE
        offset, abbreviation = (offsets[0], None) if len(offsets) == 1 else (None, name.upper())
    of_day = (hour * 3600 + minute * 60 + second) * 1_000_000 + int((fraction or "0").ljust(6, "0")[:6])
    wall = lambda day: None if day is None else day * 86_400_000_000 + of_day
    if family in ("slash", "dot", "dash"):
        return family, wall(_day(c, b, a)), wall(_day(c, a, b)), wall(_day(a, b, c)) if len(a) == len(c) == 2 else None, offset, abbreviation, region
    if family == "ymd":
        only = _day(a, b, c)
    else:
        day, month = (a, b) if family == "dny" else (b, a)
        month = _MONTH.get(month[:3].lower())
        only = month and _day(c, month, day)
    return "one", wall(only), wall(only), wall(only), offset, abbreviation, region


def _read(texts: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = [known[t] if t in known else known.setdefault(t, read_text(t)) for t in texts]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (object, "Int64", "Int64", "Int64", "Int64", object, object)
    return pd.DataFrame({n.split()[0]: pd.array(c, dtype=k) if k != object else list(c) for n, c, k in zip(_SCHEMA.split(", "), columns, kinds, strict=True)})


def parse_texts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_read``, a struct of ``read_text``'s values.

    In built-in expressions the forms take some sixty regular expressions a text, evaluated for every
    row; here they run in one Arrow-batched pass that tries the forms a text's beginning allows.
    """
    return df.withColumn("_read", F.pandas_udf(_read, _SCHEMA)(text))


def _fit_shares(f: pd.DataFrame) -> pd.DataFrame:
    """(source, family, declared, shares) of one source's counts (source, family, declared, d, m, y, n) of texts by which orders fit."""
    out = []
    for family, part in f.groupby("family"):
        fits, n = part[["d", "m", "y"]].to_numpy(bool), part["n"].to_numpy(float)
        declared = part["declared"].iloc[0]
        prior = np.array([DECLARED_WEIGHT if o == declared else BASE_WEIGHT if declared is None and o != "ymd" else OTHER_WEIGHT for o in ORDERS])
        share = prior / prior.sum()
        for _ in range(EM_ROUNDS):
            r = fits * share
            r /= r.sum(axis=1, keepdims=True)
            share = (prior + n @ r) / (prior.sum() + n.sum())
        out.append((part["source"].iloc[0], family, declared, share.tolist()))
    return pd.DataFrame(out, columns=["source", "family", "declared", "shares"])


def order_shares(parsed: DataFrame, source: str, declared: str) -> DataFrame:
    """(source, family, declared, shares): the shares of day first, month first and year first among each source's dates with slashes, dots and dashes, by EM.

    Texts are counted per source and set of orders that fit first, so a source's rounds run over a handful of rows, whatever its size.
    """
    r = F.col("_read")
    usual = F.when(r.family == "slash", F.col(declared)).when(r.family == "dot", USUAL["dot"]).otherwise(USUAL["dash"])
    fit = parsed.where((r.family != "one") & (r.dmy.isNotNull() | r.mdy.isNotNull() | r.ymd.isNotNull()))
    keys = [F.col(source).cast("string").alias("source"), r.family.alias("family"), r.dmy.isNotNull().alias("d"), r.mdy.isNotNull().alias("m"), r.ymd.isNotNull().alias("y")]
    counts = fit.groupBy(*keys).agg(F.count("*").alias("n"), F.max(usual).alias("declared"))
    return counts.groupBy("source").applyInPandas(_fit_shares, "source string, family string, declared string, shares array<double>")


def resolve_instants(df: DataFrame, text: str, source: str, time_zone: str, date_order: str, min_posterior: float = 0.9) -> DataFrame:
    """``df`` with ``epoch_us``, ``posterior`` and ``status``.

    status: ``instant``; ``ambiguous`` (several readings, none with ``min_posterior``), ``no_such_time`` (a wall time
    that a zone change skipped), ``no_zone`` (wall time of a source without zone), ``none`` (no reading, or
    outside 2015 to 2030), ``null``. Only ``instant`` has ``epoch_us``. A wall time that occurred twice is its earlier
    instant. An abbreviation of several offsets is the one its source's zone has at that time, else ambiguous. Sources are told apart by their text.
    Columns named ``_read``, ``epoch_us``, ``posterior``, ``status`` and ``_source`` are taken: rename yours.
    """
    # read once: the shares and the choice both start from what is written here
    parsed = cut(parse_texts(df, text))
    shares = order_shares(parsed, source, date_order).select(F.col("source").alias("_source"), F.col("family").alias("_family"), F.col("declared").alias("_declared"), "shares")
    r = F.col("_read")
    joined = parsed.join(shares, parsed[source].cast("string").eqNullSafe(F.col("_source")) & (r.family == F.col("_family")), "left")
    readings = [(r[o], F.get("shares", F.lit(i)), o) for i, o in enumerate(ORDERS)]
    # a format of too small a share is noise where another is declared or usual
    live = lambda wall, share, o: F.when(wall.isNotNull() & (F.col("_declared").isNull() | (F.col("_declared") == o) | (share >= NOISE_SHARE)), share).otherwise(0.0)
    weights = [live(*x) for x in readings]
    # readings of one instant count together
    total = weights[0] + weights[1] + weights[2]
    choice = F.greatest(*[F.struct(w.alias("w"), (-F.lit(i)).alias("i"), wall.alias("us")) for i, ((wall, _, _), w) in enumerate(zip(readings, weights, strict=True))])
    same = sum((F.when(wall == F.col("_best.us"), w).otherwise(0.0) for (wall, _, _), w in zip(readings, weights, strict=True)), F.lit(0.0))
    one = r.family == "one"
    out = joined.withColumn("_best", choice)
    wall = F.when(one, r.dmy).when(F.col("_best.w") > 0, F.col("_best.us"))
    out = out.withColumn("posterior", F.when(one & r.dmy.isNotNull(), 1.0).when(F.col("_best.w") > 0, same / total)).withColumn("_wall", wall)
    zone = F.coalesce(r.zone, F.col(time_zone))
    ts = F.timestamp_micros("_wall")
    # steps of their own, so that each conversion is done once
    out = out.withColumn("_back", F.when(r.offset_min.isNull(), F.to_utc_timestamp(ts, zone)))
    # of two instants with one wall time the conversion takes the earlier; a skipped wall time does not come back
    out = out.withColumn("_exists", F.from_utc_timestamp("_back", zone) == ts)
    exists = F.col("_exists")
    by_zone = F.when(zone.isNotNull() & exists, F.unix_micros("_back"))
    # the offset, of those an abbreviation stands for, that the zone has then
    several = {k: v for k, v in ZONE_MINUTES.items() if len(v) > 1}
    offsets = F.coalesce(*[F.when(r.abbreviation == k, F.array(*map(F.lit, v)).cast("array<bigint>")) for k, v in several.items()])
    local = F.filter(offsets, lambda m: F.from_utc_timestamp(F.timestamp_micros(F.col("_wall") - m * 60_000_000), zone) == ts)
    out = out.withColumn("_offset", F.coalesce(r.offset_min, F.when(r.abbreviation.isNotNull(), F.get(local, F.lit(0)))))
    offset = F.col("_offset")
    us = F.when(offset.isNotNull(), F.col("_wall") - offset * 60_000_000).when(r.abbreviation.isNull(), by_zone)
    out = out.withColumn("_us", us)
    us = F.when(F.col("_us").between(FIRST_US, END_US - 1), F.col("_us"))
    status = (
        F.when(F.col(text).isNull(), "null")
        .when(F.col("_wall").isNull(), "none")
        .when(F.col("posterior") < min_posterior, "ambiguous")
        .when(r.abbreviation.isNotNull() & offset.isNull(), "ambiguous")
        .when(offset.isNull() & zone.isNull(), "no_zone")
        .when(offset.isNull() & ~exists, "no_such_time")
        .when(us.isNull(), "none")
        .otherwise("instant")
    )
    out = out.withColumn("status", status).withColumn("epoch_us", F.when(F.col("status") == "instant", us))
    return out.drop("_wall", "_best", "_back", "_exists", "_offset", "_us", "_read", "_source", "_family", "_declared", "shares")
