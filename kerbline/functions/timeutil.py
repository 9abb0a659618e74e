"""Clock conversions. Session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.constants import LOCAL_TZ


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def relative_seconds(ts: Column, start: Column) -> Column:
    """Seconds since the start of the trip, the difference cut to whole ms."""
    micros = F.unix_micros(ts) - F.unix_micros(start)
    return (micros - F.pmod(micros, F.lit(1000))) / F.lit(1000) / F.lit(1000.0)


def event_time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def clock_ms_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def to_local(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.to_date(to_local(ts, tz))


def local_hour(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.hour(to_local(ts, tz))


def local_to_utc_strict(local: Column, tz: str = LOCAL_TZ) -> Column:
    """UTC instant of a local clock reading; null where the clock jumps or repeats."""
    utc = F.to_utc_timestamp(local, tz)
    hour = F.expr("interval 1 hour")
    back = F.from_utc_timestamp(utc, tz)
    twice = (F.from_utc_timestamp(utc - hour, tz) == local) | (
        F.from_utc_timestamp(utc + hour, tz) == local
    )
    return F.when((back == local) & ~twice, utc)


def parse_local(text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def local_text_to_epoch_ms(text: Column, tz: str = LOCAL_TZ) -> Column:
    """Epoch ms of local text with or without a fraction; null if it does not parse."""
    return F.unix_millis(F.to_utc_timestamp(parse_local(text), tz))
