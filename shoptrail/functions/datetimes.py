"""Date and time functions over text and epoch columns (session zone UTC)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoptrail import constants as C


def parse_time(text: Column) -> Column:
    """Timestamp of ``yyyy-MM-dd H:mm:ss`` text, NULL where it does not parse.

    Text of the usual shape takes a plain cast, which costs half as much as a format.
    """
    usual = F.length(text).between(18, 19) & (F.substring(text, 11, 1) == " ")
    return F.when(usual, text.try_cast("timestamp")).otherwise(
        F.try_to_timestamp(text, F.lit(C.TIME_PARSE_FORMAT))
    )


def before(left: Column, right: Column) -> Column:
    """Whether time text ``left`` is earlier; false where either does not parse."""
    return F.coalesce(parse_time(left) < parse_time(right), F.lit(False))


def after(left: Column, right: Column) -> Column:
    """Whether time text ``left`` is later; false where either does not parse."""
    return F.coalesce(parse_time(left) > parse_time(right), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one timestamp to another."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def minus(left: Column, right: Column) -> Column:
    """Seconds by which time text ``left`` follows ``right``; 0 where either does not parse."""
    return F.coalesce(seconds_between(parse_time(right), parse_time(left)), F.lit(0).cast("long"))


def date_hour(text: Column) -> Column:
    """``yyyy-MM-dd_HH`` of time text."""
    return F.date_format(parse_time(text), C.DATE_HOUR_FORMAT)


def today_date() -> Column:
    return F.date_format(F.current_date(), C.DATE_FORMAT)


def yesterday_date() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), C.DATE_FORMAT)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, C.DATE_FORMAT)


def format_time(ts: Column) -> Column:
    return F.date_format(ts, C.TIME_FORMAT)


def format_date_key(ts: Column) -> Column:
    """``yyyyMMdd`` of a date or timestamp."""
    return F.date_format(ts, C.DATE_KEY_FORMAT)


def parse_date_key(text: Column) -> Column:
    """Date of ``yyyyMMdd`` text, NULL where it does not parse."""
    return F.try_to_timestamp(text, F.lit(C.DATE_KEY_FORMAT)).cast("date")


def format_time_minute(ts: Column) -> Column:
    """``yyyyMMddHHmm`` of a timestamp."""
    return F.date_format(ts, C.MINUTE_KEY_FORMAT)


def millis_to_timestamp(millis: Column) -> Column:
    """Timestamp of epoch milliseconds given as number or text, NULL where not a number."""
    return F.timestamp_millis(millis.try_cast("long"))


def minute_key_date(key: Column) -> Column:
    """``yyyy-MM-dd`` part of a ``yyyyMMddHHmm`` key."""
    return F.concat_ws("-", F.substring(key, 1, 4), F.substring(key, 5, 2), F.substring(key, 7, 2))


def minute_key_hour(key: Column) -> Column:
    return F.substring(key, 9, 2)


def minute_key_minute(key: Column) -> Column:
    return F.substring(key, 11, 2)
