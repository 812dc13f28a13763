"""Dates and times as text: parsed, floored and formatted in the offset they are written in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^(\d{4,})-(\d{1,2})-(\d{1,2})$"
_FULL = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
UNITS = ("day", "week", "month", "year")
TOKENS = ("%Y", "%m", "%d", "%H", "%M", "%S", "%G", "%V", "%u", "%j", "%z", "%:z", "%%")


@dataclass(frozen=True)
class Moment:
    """day: the local date or null; clock, offset: text, null for a date alone."""

    day: Column
    hour: Column
    minute: Column
    second: Column
    offset: Column


def moment(text: Column) -> Moment:
    t = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    full = t.rlike(_FULL)
    part = lambda i: F.regexp_extract(t, _FULL, i)
    pad = lambda i, n: F.lpad(F.regexp_extract(t, _DATE, i), n, "0")
    written = F.when(full, F.concat_ws("-", part(1), part(2), part(3))).when(
        t.rlike(_DATE), F.concat_ws("-", pad(1, 4), pad(2, 2), pad(3, 2))
    )
    fine = ~full | ((part(4) <= "23") & (part(5) <= "59") & (part(6) <= "60") & _offset_fine(part(8)))
    day = F.when(fine, F.try_to_date(written, "yyyy-MM-dd"))
    on = full & day.isNotNull()
    offset = F.when(F.lower(part(8)) == "z", "+00:00").otherwise(part(8))
    return Moment(day, *(F.when(on, c) for c in (part(4), part(5), part(6), offset)))


def moment_of(col: Column, kind: str) -> Moment:
    """That of a typed date or timestamp, which stands for its text: no text is made or taken apart."""
    fine = F.year(col).between(0, 9999)
    day = F.when(fine, col if kind == "date" else F.to_date(col))
    none = F.lit(None).cast("string")
    if kind == "date":
        return Moment(day, none, none, none, none)
    return Moment(day, *(F.when(fine, F.date_format(col, p)) for p in ("HH", "mm", "ss")), F.when(fine, F.lit("+00:00")))


def _offset_fine(offset: Column) -> Column:
    return (F.lower(offset) == "z") | ((F.substring(offset, 2, 2) <= "23") & (F.substring(offset, 5, 2) <= "59"))


def _day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _with_clock(m: Moment, day: Column, clock: Column) -> Column:
    zone = F.when(m.offset == "+00:00", "Z").otherwise(m.offset)
    return F.concat(_day_text(day), F.lit("T"), clock, zone)


def date(m: Moment) -> Column:
    return _day_text(m.day)


def datetime(m: Moment) -> Column:
    return _with_clock(m, m.day, F.concat_ws(":", m.hour, m.minute, m.second))


def year(m: Moment) -> Column:
    return F.year(m.day).cast("double")


def month(m: Moment) -> Column:
    return F.month(m.day).cast("double")


def day(m: Moment) -> Column:
    return F.dayofmonth(m.day).cast("double")


def date_floor(m: Moment, unit: str) -> Column:
    """The start of the day, ISO week, month or year; a full datetime keeps its offset."""
    floor = m.day if unit == "day" else F.trunc(m.day, unit)
    return F.when(m.offset.isNotNull(), _with_clock(m, floor, F.lit("00:00:00"))).otherwise(_day_text(floor))


def split_pattern(pattern: str) -> list[str] | None:
    """Literal pieces and tokens of a pattern, or None if it holds an unknown token."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] != "%":
            j = pattern.find("%", i)
            j = len(pattern) if j < 0 else j
            out.append(pattern[i:j])
            i = j
            continue
        token = next((t for t in TOKENS if pattern.startswith(t, i)), None)
        if token is None:
            return None
        out.append(token)
        i += len(token)
    return out


def date_format(m: Moment, pieces: list[str]) -> Column:
    """A date alone counts as midnight, and has no offset to print."""
    clock = lambda c: F.coalesce(c, F.lit("00"))
    iso_year = F.lpad(F.extract(F.lit("YEAROFWEEK"), m.day).cast("string"), 4, "0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    table = {
        "%Y": F.date_format(m.day, "yyyy"), "%m": F.date_format(m.day, "MM"), "%d": F.date_format(m.day, "dd"),
        "%H": clock(m.hour), "%M": clock(m.minute), "%S": clock(m.second),
        "%G": iso_year, "%V": two(F.weekofyear(m.day)), "%u": (F.weekday(m.day) + 1).cast("string"),
        "%j": F.lpad(F.dayofyear(m.day).cast("string"), 3, "0"),
        "%z": F.replace(m.offset, F.lit(":"), F.lit("")), "%:z": m.offset, "%%": F.lit("%"),
    }
    made = F.concat(F.lit(""), *[table.get(p, F.lit(p)) for p in pieces])
    return F.when(m.day.isNotNull(), made)
