"""Columns over raw time stamp text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(ts: Column) -> Column:
    """TIMESTAMP_NTZ of raw text; null for shapes that no format reads, such as an ISO ':' fraction."""
    ts = F.regexp_replace(ts, r"\s+", " ")

    def read(text: Column, form: str) -> Column:
        return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")

    short = read(ts, "M/d/yy HH:mm:ss:SSS")  # two-digit years from 69 belong to the century before
    short = F.when(F.year(short) >= 2069, short - F.expr("interval 100 years")).otherwise(short)
    iso = F.replace(F.replace(ts, F.lit("T"), F.lit(" ")), F.lit(","), F.lit("."))
    forms = [read(iso, "yyyy-MM-dd HH:mm:ss." + "S" * n) for n in (3, 4, 5, 6)]
    return F.coalesce(short, read(ts, "M/d/yyyy HH:mm:ss:SSS"), *forms, read(iso, "yyyy-MM-dd HH:mm:ss"))


def ts_parts(ts: Column) -> tuple[Column, Column, Column]:
    """(date text, hour, minute); the date is null if the text has none, hour and minute if out of range."""
    words = F.split(F.trim(ts), r"\s+")
    several = F.size(words) > 1
    iso = F.split(words[0], "T", 2)
    date = F.when(several, words[0]).when(F.size(iso) > 1, iso[0])
    clock = F.when(several, F.element_at(words, -1)).otherwise(F.element_at(iso, -1))
    hms = F.split(clock, "[:.]")
    hour = F.get(hms, F.lit(0)).try_cast("int")
    minute = F.get(hms, F.lit(1)).try_cast("int")
    valid = hour.between(0, 23) & minute.between(0, 59)
    return F.when(valid, date), F.when(valid, hour), F.when(valid, minute)
