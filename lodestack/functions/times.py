"""Instants in the formats of feeds and exports, and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _c


def parse_instant(value: Column | str) -> Column:
    """A timestamp (UTC) of ISO-8601 or RFC-822 text; null for anything else.

    Text without an offset means UTC.  A weekday in front is ignored.
    """
    s = F.trim(_c(value))
    iso = F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), s))
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UT|UTC|Z)$", " +0000")
    mail = F.regexp_replace(mail, r"(\d{2}:\d{2}:\d{2})$", "$1 +0000")
    mail = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), mail)
    return F.coalesce(iso, F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def epoch_seconds(value: Column | str) -> Column:
    return F.unix_seconds(parse_instant(value))


def to_micros(value: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone (UTC then)."""
    return F.unix_micros(_c(value).cast("timestamp"))


def iso_text(value: Column | str) -> Column:
    """ISO-8601 text of a timestamp, in UTC and whole seconds."""
    return F.date_format(_c(value).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def own_year_month(value: Column | str) -> Column:
    """``YYYY/MM`` of an instant in the offset that it is written in; null for anything else."""
    s = F.trim(_c(value))
    iso = F.regexp_extract(s, r"^(\d{4})-(\d{2})", 0)
    mail = F.try_to_timestamp(F.regexp_extract(s, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy"))
    return F.when(iso != "", F.translate(iso, "-", "/")).otherwise(F.date_format(mail, "yyyy/MM"))


def backoff_minutes(failures: Column | str, base: float = 30, most_days: float = 30) -> Column:
    """Minutes to wait after so many failures: doubled each time, up to some days."""
    n = _c(failures).cast("double")
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(62.0))), F.lit(float(most_days) * 1440))
