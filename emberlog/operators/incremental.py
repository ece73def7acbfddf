"""Detection in runs: only due windows are judged, with the stored logs around them as context.

A cursor says what was judged: all logs up to an id whose time lies before an edge.  What
is unchecked is later in time or came in later, late logs included.  A run takes whole
windows, oldest first, and reads the stored logs of its sources from one window before to
one after, by day partitions, so its cost goes with what is due and not with the store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.logs import micros

DAY = 86_400_000_000


@dataclass(frozen=True)
class Cursor:
    """Logs with ids up to ``last_id`` and times before ``before_us`` (and, by ``timeless_id``, without times) are judged."""

    before_us: int | None = None
    last_id: int = -1
    timeless_id: int = -1


@dataclass(frozen=True)
class Due:
    """What is waiting, whether to judge now, up to which time, and why."""

    waiting: int
    now: bool
    before_us: int | None
    reason: str


def by_days(rows: DataFrame, low: int | None, high: int | None, day: str | None) -> DataFrame:
    """Rows of times from ``low`` until before ``high``; ``day`` names a partition column of whole days since 1970."""
    us = micros("generated_time")
    for edge, keep, keep_day in ((low, lambda e: us >= e, lambda e: F.col(day) >= e // DAY), (high, lambda e: us < e, lambda e: F.col(day) <= (e - 1) // DAY)):
        if edge is not None:
            rows = rows.filter(keep(edge)) if day is None else rows.filter(keep_day(edge)).filter(keep(edge))
    return rows


def unchecked(stored: DataFrame, cursor: Cursor) -> DataFrame:
    us = micros("generated_time")
    timed = F.lit(True) if cursor.before_us is None else (us >= cursor.before_us) | (F.col("log_id") > cursor.last_id)
    return stored.filter((us.isNotNull() & timed) | (us.isNull() & (F.col("log_id") > cursor.timeless_id)))


def due(stored: DataFrame, cursor: Cursor, quiet: bool, window_s: int = 300) -> Due:
    """Whether logs are due: windows followed by one whole window, or all of them once the feed is quiet.

    The newest log's window is still filling, and the one before it is evidence for the
    one before that.  Logs without a time wait for the quiet period where no log has one.
    """
    step = window_s * 1_000_000
    us = micros("generated_time")
    newest = stored.agg(F.max(us)).head()[0]
    before = None if newest is None else newest - newest % step - step
    found = unchecked(stored, cursor).agg(F.count("*"), F.count_if(us.isNull() | (us < F.lit(before))) if before is not None else F.lit(0)).head()
    if not found[0]:
        return Due(0, False, None, "nothing_waiting")
    if quiet:
        return Due(found[0], True, None, "logs_stopped_arriving")
    if not found[1]:
        return Due(found[0], False, before, "newest_window_still_open")
    return Due(found[0], True, before, "window_complete")


def next_end(waiting: DataFrame, limit: int, window_s: int = 300) -> int | None:
    """End of the window in which the ``limit``-th waiting log lies, by time; null if there are fewer.

    Logs are counted by window and only the counts are put in order.
    """
    step = window_s * 1_000_000
    us = micros("generated_time")
    by = waiting.filter(us.isNotNull()).groupBy((us - F.pmod(us, F.lit(step))).alias("w")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0))  # a row a window
    start = by.withColumn("upto", upto).filter(F.col("upto") >= limit).agg(F.min("w")).head()[0]
    return None if start is None else start + step


def neighbours(stored: DataFrame, batch: DataFrame, window_s: int = 300, day: str | None = None) -> DataFrame:
    """Stored logs of the batch's sources around its windows, the batch's own left out.

    The shifted grid reaches half a window past each edge and cadence the window before
    and after, so one window before and two from the last one's start are enough.
    """
    step = window_s * 1_000_000
    us = micros("generated_time")
    low, high = batch.agg(F.min(us), F.max(us)).head()
    if low is None:
        return stored.limit(0)
    near = by_days(stored, low - low % step - step, high - high % step + 2 * step, day)
    sources = batch.filter("src_ip is not null and src_ip <> ''").select("src_ip").distinct()
    return near.join(sources, "src_ip", "left_semi").join(batch.select("log_id"), "log_id", "left_anti").select(stored.columns)


def run(stored: DataFrame, cursor: Cursor, judge: Callable[[DataFrame], DataFrame], limit: int | None = None, before_us: int | None = None, window_s: int = 300, day: str | None = None) -> tuple[DataFrame, Cursor]:
    """What ``judge`` says of the next due logs, judged with their neighbours, and the cursor after it.

    ``judge`` maps logs to results with ``log_id``.  Logs without a time go first and
    alone.  ``limit`` bounds a run by whole windows; ``before_us`` is that of ``due``.
    Late logs are judged by themselves in the run after they came in.
    """
    us = micros("generated_time")
    waiting = unchecked(stored, cursor)
    top = stored.agg(F.max("log_id")).head()[0]
    timeless = waiting.filter(us.isNull())
    if timeless.limit(1).count():
        return judge(timeless), Cursor(cursor.before_us, cursor.last_id, top)
    late = waiting.filter(us < cursor.before_us) if cursor.before_us is not None else waiting.limit(0)
    if late.limit(1).count():
        batch, after = late, Cursor(cursor.before_us, top, max(cursor.timeless_id, -1))
    else:
        ahead = by_days(waiting, cursor.before_us, before_us, day)
        end = next_end(ahead, limit, window_s) if limit else None
        if end is None:
            newest = ahead.agg(F.max(us)).head()[0]
            if newest is None:
                return judge(ahead), cursor
            end = before_us if before_us is not None else newest - newest % (window_s * 1_000_000) + window_s * 1_000_000
        batch, after = by_days(ahead, None, end, day), Cursor(end, top, cursor.timeless_id)
    context = neighbours(stored, batch, window_s, day)
    judged = judge(batch.unionByName(context))
    return judged.join(batch.select("log_id"), "log_id", "left_semi"), after
