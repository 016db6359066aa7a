"""Calendar scales as integer column expressions, with leap seconds from a constant table."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (first day, TAI minus UTC from then on), the published table since 1972.
LEAPS = (("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29), ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37))
US_1970_2000 = 946_684_800_000_000
#: Microseconds from 2000-01-01T00:00 UTC to the zero of TT2000.
TT_ZERO = 43_135_816_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def us2000(ts: Column) -> Column:
    return micros(ts) - US_1970_2000


def ns1970(ts: Column) -> Column:
    return micros(ts) * 1000


def mj1958(ts: Column) -> Column:
    return us2000(ts) / 86_400_000_000 + 15340


def from_us2000(us: Column) -> Column:
    return F.timestamp_micros(us + US_1970_2000)


def _us(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) * 1_000_000 - US_1970_2000


def leap_seconds(us: Column, table=LEAPS) -> Column:
    """TAI minus UTC at microseconds since 2000: one expression, newest entry first; 10 before the table."""
    out = None
    for day, n in reversed(table):
        out = F.when(us >= _us(day), n) if out is None else out.when(us >= _us(day), n)
    return out.otherwise(10)


def tt2000(ts: Column, table=LEAPS) -> Column:
    """Nanoseconds of TT since J2000, leap seconds counted by the table."""
    us = us2000(ts)
    return (us - TT_ZERO) * 1000 + (leap_seconds(us, table) - 32).cast("long") * 1_000_000_000


def from_tt2000(ns: Column, table=LEAPS) -> Column:
    """Timestamp of TT2000 nanoseconds; a leap second itself maps to the second after it."""
    n = None
    for day, k in reversed(table):
        at = (_us(day) - TT_ZERO) * 1000 + (k - 32) * 1_000_000_000
        n = F.when(ns >= at, k) if n is None else n.when(ns >= at, k)
    return from_us2000(((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("long") + TT_ZERO - (n.otherwise(10) - 32).cast("long") * 1_000_000)


def julian_day(ts: Column) -> Column:
    """Midnight-based day number."""
    return F.floor(us2000(ts) / 86_400_000_000).cast("long") + 15340 + 2_436_205


def seconds_of_day(ts: Column) -> Column:
    return F.pmod(us2000(ts), F.lit(86_400_000_000)) / 1e6


def difference(a: Column, b: Column) -> Column:
    """Seconds from b to a."""
    return (micros(a) - micros(b)) / 1e6


def ordinal(ts: Column, digits: int = 0) -> Column:
    """yyyy-ddd'T'hh:mm:ss, rounded (not cut) to so many digits, so seconds never show 60."""
    return _format(ts, "yyyy-DDD", digits)


def calendar(ts: Column, digits: int = 0) -> Column:
    return _format(ts, "yyyy-MM-dd", digits)


def _format(ts: Column, day: str, digits: int) -> Column:
    unit = 10 ** (6 - min(digits, 6))
    us = F.floor((micros(ts) + unit // 2) / unit).cast("long") * unit
    t = F.timestamp_micros(us)
    return F.date_format(t, f"{day}'T'HH:mm:ss" + ("." + "S" * min(digits, 6) if digits else ""))


def dual(ts: Column, digits: int = 0) -> Column:
    """yyyy-MM-dd (ddd)Thh:mm:ss: the day both as a date and by its number in the year."""
    return _format(ts, "yyyy-MM-dd (DDD)", digits)


#: Formats tried in order by parse_time.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-DDD'T'HH:mm:ss.SSSSSS", "yyyy-DDD'T'HH:mm:ss.SSS", "yyyy-DDD'T'HH:mm:ss", "yyyy-DDD'T'HH:mm", "yyyy-DDD", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d-MMM-yyyy", "MMM d, yyyy")


def parse_time(s: Column) -> Column:
    """The first format that fits, after Z is cut and a decimal comma made a point; null if none does."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(s), "Z$", ""), ",(?=[0-9]+$)", ".")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in FORMATS])


_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_EPOCH = datetime(1970, 1, 1)


def fields(s: str) -> tuple[int, int, int, int, int, float]:
    """Year, month, day, hour, minute and second of a time written in any common way.

    A four-digit number is the year wherever it stands, a month name the month; a three-digit number
    after the year is the day of the year; years under 100 are of the 1900s; a trailing Z or UTC, a T
    and a decimal comma are understood. Anything else raises ValueError."""
    t = re.sub(r"\s*(?:Z|UTC|GMT)\s*\Z", "", s.strip(), flags=re.I)
    # A comma is a decimal sign only in figures of a second, after colons.
    t = re.sub(r"(:\d\d),(\d+)\Z", r"\1.\2", t)
    parts = re.findall(r"[A-Za-z]+|\d+(?:\.\d+)?", re.sub(r"(?<=\d)[Tt](?=\d)", " ", t))
    if not parts or re.search(r"[^\w\s:./,;()-]", t):
        raise ValueError(f"{s!r} is no time")
    day: list[str] = []
    clock: list[str] = []
    month = None
    head = re.match(r"[^:]*?(?=\d{1,2}:|\Z)", re.sub(r"(?<=\d)[Tt](?=\d)", " ", t))[0]
    n_head = len(re.findall(r"[A-Za-z]+|\d+(?:\.\d+)?", head))
    for i, x in enumerate(parts):
        if x.isalpha():
            if x[:3].lower() in _MONTHS and month is None:
                month = _MONTHS[x[:3].lower()]
            elif x[:3].lower() not in ("mon", "tue", "wed", "thu", "fri", "sat", "sun"):
                raise ValueError(f"{s!r} is no time")
        elif i < n_head:
            day.append(x)
        else:
            clock.append(x)
    want = 2 if month else 3
    ordinal = not month and len(day) >= 2 and (len(day[1]) == 3 and len(day[0]) <= 4)
    if ordinal:
        want = 2
    if len(day) > want:
        clock, day = day[want:] + clock, day[:want]
    if not day or len(clock) > 3 or any("." in x for x in day):
        raise ValueError(f"{s!r} is no time")
    year_at = next((i for i, x in enumerate(day) if len(x) == 4), None)
    if month:
        year_at = len(day) - 1 if year_at is None else year_at
        if len(day) < 2:
            raise ValueError(f"{s!r} is no time")
        year, dom = int(day[year_at]), int(day[1 - year_at])
    else:
        year_at = (0 if ordinal or len(day) < 3 or int(day[0]) > 31 else 2) if year_at is None else year_at
        year = int(day.pop(year_at))
        month, dom = 1, 1
        if ordinal:
            dom = int(day[0])
        elif day:
            month, dom = int(day[0]), int(day[1]) if len(day) > 1 else 1
    year += 1900 if year < 100 else 0
    if not 1 <= month <= 12 or not 1 <= dom <= (366 if ordinal else 31):
        raise ValueError(f"{s!r} is no time")
    h, m = (int(float(clock[i])) if len(clock) > i else 0 for i in range(2))
    sec = float(clock[2]) if len(clock) > 2 else 0.0
    if h > 24 or m > 59 or sec >= 61:
        raise ValueError(f"{s!r} is no time")
    return year, month, dom, h, m, sec


def normal(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: float = 0.0) -> tuple[int, int, int, int, int, int, float]:
    """Year, month, day, day of year, hour, minute and second with every field carried or borrowed into its range.

    Years under 100 are of the 1900s; leap seconds aren't counted."""
    year += 1900 if 0 <= year < 100 else 0
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    whole = int(second // 1)
    t = datetime(year, month, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=whole)
    return t.year, t.month, t.day, t.timetuple().tm_yday, t.hour, t.minute, t.second + (second - whole)


def parse_micros(s: str) -> int:
    """Microseconds since 1970 of a time text, as fields() reads it."""
    y, mo, d, _, h, mi, sec = normal(*fields(s))
    return ((datetime(y, mo, d, h, mi) - _EPOCH) // timedelta(microseconds=1)) + round(sec * 1e6)


def _clock(us: int, digits: int) -> datetime:
    unit = 10 ** (6 - min(digits, 6))
    return _EPOCH + timedelta(microseconds=(us + unit // 2) // unit * unit)


def format_micros(us: int, digits: int = 3, form: str = "calendar") -> str:
    """Calendar, ordinal or dual (2020-01-05 (005)T...) text, rounded to 0 to 9 digits of a second."""
    t = _clock(us, digits)
    day = {"calendar": f"{t:%Y-%m-%d}", "ordinal": f"{t:%Y-%j}", "dual": f"{t:%Y-%m-%d} ({t:%j})"}[form]
    return f"{day}T{t:%H:%M:%S}" + (f".{t.microsecond:06d}000"[: digits + 1] if digits else "")


def shifted(s: str, seconds: float = 0.0, *, years: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, digits: int = 3) -> str:
    """A time text moved by calendar years and by days, hours, minutes and seconds."""
    y, mo, d, h, mi, sec = fields(s)
    y, mo, d, _, h, mi, sec = normal(y + years + (1900 if y < 100 else 0), mo, d + days, h + hours, mi + minutes, sec + seconds)
    return format_micros(((datetime(y, mo, d, h, mi) - _EPOCH) // timedelta(microseconds=1)) + round(sec * 1e6), digits)


def order(a: str, b: str) -> int:
    """-1, 0 or 1 by instant."""
    x, y = parse_micros(a), parse_micros(b)
    return (x > y) - (x < y)


def seconds_between(a: str, b: str) -> float:
    """Seconds from b to a."""
    return (parse_micros(a) - parse_micros(b)) / 1e6


def weekday(s: str) -> int:
    """0 for Sunday to 6 for Saturday."""
    return (_EPOCH + timedelta(microseconds=parse_micros(s))).isoweekday() % 7


def now() -> Column:
    """The query's own start, the same in every row."""
    return F.current_timestamp().cast("timestamp_ntz")


def days1958(ts: Column) -> Column:
    """Whole days since 1958-01-01."""
    return F.floor(mj1958(ts)).cast("long")


def millis_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(us2000(ts), F.lit(86_400_000_000)) / 1000).cast("long")


def from_1958(days: Column, millis: Column) -> Column:
    """Timestamp of whole days since 1958 and milliseconds of the day."""
    return from_us2000((days - 15340).cast("long") * 86_400_000_000 + millis.cast("long") * 1000)


#: Terms of the yearly swing between terrestrial and barycentric time.
_K, _EB, _M0, _M1 = 1.657e-3, 1.671e-2, 6.239996, 1.99096871e-7


def et2000(tt_ns: Column) -> Column:
    """Ephemeris seconds since J2000 of TT2000 nanoseconds."""
    t = tt_ns / 1e9
    m = F.lit(_M0) + t * _M1
    return t + _K * F.sin(m + _EB * F.sin(m))


def tt_from_et2000(et: Column, rounds: int = 3) -> Column:
    """TT2000 nanoseconds of ephemeris seconds, by that many fixed-point steps."""
    t = et
    for _ in range(rounds):
        m = F.lit(_M0) + t * _M1
        t = et - _K * F.sin(m + _EB * F.sin(m))
    return F.round(t * 1e9).cast("long")


def ns1970_checked(ts: Column, year: Column | None = None) -> Column:
    """Nanoseconds since 1970; null outside the 290 years either way that fit."""
    y = F.year(ts) if year is None else year
    return F.when((y >= 1680) & (y <= 2260), ns1970(ts))


def load_leaps(text: str) -> tuple[tuple[str, int], ...]:
    """A leap table from lines of year month day ... seconds or from DELTA_AT pairs like 10, @1972-JAN-1."""
    out = [(f"{int(y):04d}-{_MONTHS[m.lower()]:02d}-{int(d):02d}", int(n)) for n, y, m, d in re.findall(r"(\d+)\s*,\s*@(\d{4})-([A-Za-z]{3})-(\d+)", text)]
    if not out:
        rows = [x.split() for x in text.splitlines() if re.match(r"\s*\d{4}\s", x)]
        out = [(f"{int(r[0]):04d}-{int(r[1]):02d}-{int(r[2]):02d}", int(float(r[3]))) for r in rows if int(r[0]) >= 1972]
    if not out:
        raise ValueError("no leap seconds found")
    return tuple(sorted(out))


def parse_any(s: Column) -> Column:
    """Timestamps of times written in any way that fields() reads, in Arrow batches; null for others.

    For columns of known forms parse_time stays in the JVM and is quicker."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return parse_micros(v) if v is not None else None
            except ValueError:
                return None

        return x.map(one).astype("Int64")

    return F.timestamp_micros(run(s)).cast("timestamp_ntz")
