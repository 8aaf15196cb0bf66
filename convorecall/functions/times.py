"""Column functions on times; the session's time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convorecall.schema import WEEKDAYS


def _period(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "上午").when(F.hour(ts) < 18, "下午").otherwise("晚上")


def _date(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("年"), F.month(ts).cast("string"), F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日"))


def context_text(ts: Column, participants: Column) -> Column:
    """Date, part of the day and participants."""
    return F.concat(_date(ts), _period(ts), F.lit(" 参与者："), F.array_join(participants, ", "))


def long_label(ts: Column) -> Column:
    """Date, weekday, part of the day and time."""
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(ts) + 1)
    return F.concat(_date(ts), F.lit(" "), weekday, F.lit(" "), _period(ts), F.hour(ts).cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"))


def duration_label(start: Column, end: Column) -> Column:
    """Length of a session in words."""
    minutes = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    long_ = F.when(rest > 0, F.concat(hours, F.lit("小时"), rest.cast("string"), F.lit("分钟"))).otherwise(F.concat(hours, F.lit("小时")))
    return F.when(minutes < 1, "不到1分钟").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分钟"))).otherwise(long_)


def days_since(last: Column, as_of: Column) -> Column:
    """Whole days from ``last`` to ``as_of``; a missing ``last`` is 2000-01-01."""
    last = F.coalesce(last, F.to_timestamp(F.lit("2000-01-01")))
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400)


def window_bounds(reference: Column, direction: Column, days: Column) -> tuple[Column, Column]:
    """Epoch seconds from and to: before, after or around a reference, by a number of days."""
    span = days * 86400
    start = F.when(direction == "after", reference).otherwise(reference - span)
    end = F.when(direction == "before", reference).otherwise(reference + span)
    return start.cast("bigint"), end.cast("bigint")


def time_context(first: Column, last: Column) -> Column:
    """The day of two epoch seconds, or the span of days between them."""
    a, b = (F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd") for c in (first, last))
    return F.when(first.isNull(), F.lit(None)).when(a == b, F.concat(F.lit("都在 "), a)).otherwise(F.concat(F.lit("时间跨度："), a, F.lit(" 至 "), b))
