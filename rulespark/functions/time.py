"""Dates, times of day and instants. A time of day is a BIGINT of nanoseconds
since midnight; an instant without zone is a TIMESTAMP_NTZ; one with a zone is a
struct (at: TIMESTAMP_NTZ in UTC, offset: seconds east)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col

SECOND = 1_000_000_000
#: directives of strftime and what Spark's patterns have for them
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "%": "%"}


def pattern(strftime: str) -> str:
    out, i, text = "", 0, ""
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            if strftime[i] in "-_0":
                i += 1
            out += (f"'{text}'" if text else "") + PATTERNS[strftime[i]]
            text = ""
        elif c.isalpha():
            text += c
        else:
            out += (f"'{text}'" if text else "") + ("''" if c == "'" else c)
            text = ""
        i += 1
    return out + (f"'{text}'" if text else "")


def midnight() -> Column:
    return F.lit(0).cast("long")


def try_from_hms_nano(h, m, s, nano) -> Column:
    h, m, s, n = (col(x).cast("long") for x in (h, m, s, nano))
    good = (h >= 0) & (h < 24) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60) & (n >= 0) & (n < SECOND)
    return F.when(good, ((h * 60 + m) * 60 + s) * SECOND + n)


def try_from_hms(h, m, s) -> Column:
    return try_from_hms_nano(h, m, s, 0)


def try_from_hms_milli(h, m, s, milli) -> Column:
    return F.when(col(milli) < 1000, try_from_hms_nano(h, m, s, col(milli) * 1_000_000))


def try_from_hms_micro(h, m, s, micro) -> Column:
    return F.when(col(micro) < 1_000_000, try_from_hms_nano(h, m, s, col(micro) * 1000))


def _of_day(t, unit: int, most: int) -> Column:
    return F.pmod(F.floor(col(t).cast("decimal(20,0)") / unit), F.lit(most)).cast("long")


def hour(t) -> Column:
    return _of_day(t, 3600 * SECOND, 24)


def minute(t) -> Column:
    return _of_day(t, 60 * SECOND, 60)


def second(t) -> Column:
    return _of_day(t, SECOND, 60)


def millisecond(t) -> Column:
    return _of_day(t, 1_000_000, 1000)


def microsecond(t) -> Column:
    return _of_day(t, 1000, 1_000_000)


def nanosecond(t) -> Column:
    return _of_day(t, 1, SECOND)


def time2string(t) -> Column:
    """HH:MM:SS and, if there are any, nanoseconds."""
    text = F.format_string("%02d:%02d:%02d", hour(t), minute(t), second(t))
    return F.when(nanosecond(t) == 0, text).otherwise(F.regexp_replace(F.concat(text, F.format_string(".%09d", nanosecond(t))), "0+$", ""))


def string2time(s) -> Column:
    part = lambda i: F.regexp_extract(col(s), r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?$", i)
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
    return F.when(part(1) != "", try_from_hms_nano(number(part(1)), number(part(2)), number(part(3)), number(F.rpad(part(4), 9, "0"))))


to_time = string2time


def time_format(t, form: str) -> Column:
    at = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(col(t) / SECOND).cast("decimal(18,6)")))
    return F.date_format(at, pattern(form))


def time_parse(s, form: str) -> Column:
    at = F.try_to_timestamp(col(s), F.lit(pattern(form)))
    return try_from_hms(F.hour(at), F.minute(at), F.second(at))


def try_from_ymd(y, m, d) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", col(y).cast("int"), col(m).cast("int"), col(d).cast("int")), "yyyy-MM-dd")


def try_from_yo(y, day_of_year) -> Column:
    made = F.date_add(F.make_date(col(y).cast("int"), F.lit(1), F.lit(1)), col(day_of_year).cast("int") - 1)
    return F.when((col(day_of_year) >= 1) & (F.year(made) == col(y)), made)


def try_from_iso_ywd(y, w, weekday_number) -> Column:
    """ISO year, week and day (1 is Monday)."""
    fourth = F.make_date(col(y).cast("int"), F.lit(1), F.lit(4))
    made = F.date_add(fourth, (col(w).cast("int") - 1) * 7 + col(weekday_number).cast("int") - 1 - F.weekday(fourth))
    return F.when((F.extract(F.lit("YEAROFWEEK"), made) == col(y)) & col(w).between(1, 53) & col(weekday_number).between(1, 7), made)


def year(d) -> Column:
    return F.year(col(d))


def month(d) -> Column:
    return F.month(col(d))


def day(d) -> Column:
    return F.dayofmonth(col(d))


def ordinal(d) -> Column:
    return F.dayofyear(col(d))


def week(d) -> Column:
    return F.weekofyear(col(d))


def weekday(d) -> Column:
    """0 is Monday."""
    return F.weekday(col(d))


def next_day(d) -> Column:
    return F.date_add(col(d), 1)


def previous_day(d) -> Column:
    return F.date_sub(col(d), 1)


def julian_day(d) -> Column:
    return F.unix_date(col(d)).cast("long") + 2440588


def from_julian_day(n) -> Column:
    return F.date_from_unix_date((col(n) - 2440588).cast("int"))


def date_parse(s, form: str) -> Column:
    return F.try_to_date(col(s), pattern(form))


def date_format(d, form: str) -> Column:
    return F.date_format(col(d), pattern(form))


def date2string(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def string2date(s) -> Column:
    return F.try_to_date(col(s), "yyyy-MM-dd")


to_date = string2date


def datetime_parse(s, form: str) -> Column:
    return F.try_to_timestamp(col(s), F.lit(pattern(form))).cast("timestamp_ntz")


def dateTime2string(t) -> Column:  # noqa: N802
    return F.date_format(col(t), "yyyy-MM-dd'T'HH:mm:ss")


def string2datetime(s) -> Column:
    return F.try_to_timestamp(F.translate(col(s), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


to_datetime = string2datetime


def datetime_format(t, form: str) -> Column:
    return F.date_format(col(t), pattern(form))


def datetime_from_unix_timestamp(n) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=col(n).cast("decimal(18,6)"))


def utc_timezone() -> Column:
    return F.lit(0)


def offset_timezone(seconds) -> Column:
    return col(seconds).cast("int")


def utc_datetime(t) -> Column:
    return F.struct(col(t).cast("timestamp_ntz").alias("at"), F.lit(0).alias("offset"))


def change_offset(z: Column, offset) -> Column:
    return F.struct(z["at"].alias("at"), col(offset).cast("int").alias("offset"))


def _local(z: Column) -> Column:
    return z["at"] + F.make_dt_interval(secs=z["offset"].cast("decimal(18,6)"))


def _offset_text(z: Column, colon: str) -> Column:
    o = F.abs(z["offset"])
    return F.format_string("%s%02d" + colon + "%02d", F.when(z["offset"] < 0, "-").otherwise("+"), F.floor(o / 3600).cast("int"), F.pmod(F.floor(o / 60), F.lit(60)).cast("int"))


def tz_datetime_format(z: Column, form: str) -> Column:
    return F.date_format(_local(z), pattern(form))


def to_rfc3339(z: Column) -> Column:
    return F.concat(F.date_format(_local(z), "yyyy-MM-dd'T'HH:mm:ss"), F.when(z["offset"] == 0, "Z").otherwise(_offset_text(z, ":")))


tzDateTime2string = to_rfc3339  # noqa: N816


def to_rfc2822(z: Column) -> Column:
    return F.concat(F.date_format(_local(z), "EEE, dd MMM yyyy HH:mm:ss "), _offset_text(z, ""))


def _parsed(s, shape: str, form: str) -> Column:
    part = lambda i: F.regexp_extract(col(s), shape, i)
    sign = F.when(part(2) == "-", -1).otherwise(1)
    offset = sign * (F.coalesce(part(3).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(part(4).try_cast("int"), F.lit(0)) * 60)
    at = F.try_to_timestamp(part(1), F.lit(form)).cast("timestamp_ntz")
    return F.when(at.isNotNull(), F.struct((at - F.make_dt_interval(secs=offset.cast("decimal(18,6)"))).alias("at"), offset.alias("offset")))


def tz_datetime_parse_from_rfc3339(s) -> Column:
    return _parsed(s, r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:[Zz]|([+-])(\d{2}):(\d{2}))$", "yyyy-MM-dd'T'HH:mm:ss")


def tz_datetime_parse_from_rfc2822(s) -> Column:
    return _parsed(s, r"^(?:\w{3}, )?(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) ([+-])(\d{2})(\d{2})$", "dd MMM yyyy HH:mm:ss")


tz_datetime_parse = tz_datetime_parse_from_rfc3339


def format(x, form: str) -> Column:  # noqa: A001
    """Of a date or an instant."""
    return F.date_format(col(x), pattern(form))


def time(t) -> Column:
    """The time of day of an instant."""
    t = col(t)
    return try_from_hms_micro(F.hour(t), F.minute(t), F.second(t).cast("long"), F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)))
