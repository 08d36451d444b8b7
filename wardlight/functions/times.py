"""Times: reference moment, look-back bounds and day pruning."""

from pyspark.sql import Column, DataFrame, functions as F


def moment(as_of, df: DataFrame | None = None, ts: str = "ts") -> Column:
    """The moment a question is asked: a given time, else the newest row (looked up in
    the newest day partition, where there are any)."""
    if as_of is None:
        if ts == "ts" and "day" in df.columns:
            df = df.where(F.col("day") == df.select(F.max("day")).scalar())
        return df.select(F.max(ts)).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def ago(now: Column, **span) -> Column:
    """``ago(now, days=7)``: a moment so long before ``now``."""
    return now - F.make_dt_interval(*(F.lit(span.get(k, 0))
                                      for k in ("days", "hours", "mins", "secs")))


def since(df: DataFrame, bound: Column, ts: str = "ts") -> DataFrame:
    """Rows at or after ``bound``, with the same bound on the day partition."""
    kept = df.where(F.col(ts) >= bound)
    return kept.where(F.col("day") >= F.to_date(bound)) if "day" in df.columns else kept


def until(df: DataFrame, bound: Column, ts: str = "ts") -> DataFrame:
    """Rows before ``bound``, with the same bound on the day partition."""
    kept = df.where(F.col(ts) < bound)
    return kept.where(F.col("day") <= F.to_date(bound)) if "day" in df.columns else kept


def hour_crossings(earlier: Column, later: Column) -> Column:
    """Hour boundaries crossed between two times (00:59 to 01:01 is 1)."""
    at = lambda c: F.unix_seconds(F.date_trunc("hour", c))
    return ((at(later) - at(earlier)) / 3600).cast("long")


def minute_crossings(earlier: Column, later: Column) -> Column:
    at = lambda c: F.unix_seconds(F.date_trunc("minute", c))
    return ((at(later) - at(earlier)) / 60).cast("long")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction, as a double."""
    return F.unix_micros(ts) / F.lit(1e6)


def span_text(secs: Column) -> Column:
    """``45s``, ``12m``, ``3h 20m`` or ``2d 4h``."""
    s = F.greatest(F.lit(0), secs.cast("long"))
    part = lambda unit: F.floor(s / unit)
    return (F.when(s < 60, F.format_string("%ds", s))
            .when(s < 3600, F.format_string("%dm", part(60)))
            .when(s < 86400, F.format_string("%dh %dm", part(3600), F.floor(s % 3600 / 60)))
            .otherwise(F.format_string("%dd %dh", part(86400), F.floor(s % 86400 / 3600))))


def india_hour(hour_utc: Column) -> Column:
    """UTC hour as wall-clock time at +05:30."""
    m = (hour_utc * 60 + 330) % 1440
    return F.format_string("%02d:%02d", F.floor(m / 60), F.floor(m % 60))
