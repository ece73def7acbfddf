"""Alerts merged on streams: the ordered fold of ``operators.merge`` with keyed state.

Groups wait in the state of their kind (log source and rule) until the watermark has
passed them and are then folded in the batch's order, so how the stream was cut into
micro-batches does not show.  What comes after that is late: it is folded at once, into
the alerts that are still kept.  When a kind is quiet, its waiting groups are folded
without waiting for a watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import ALERTS, DAY, OBSERVED, Fold, frame, plain

NAMES = [f.split()[0] for f in OBSERVED.split(", ")]


def in_order(group: dict) -> tuple:
    return group["first_us"] is None, group["first_us"] or 0, group["first_log"], group["group_key"]


def merged_stream(groups: DataFrame, lateness: str = "10 minutes", kept_us: int = DAY, quiet_ms: int = 120_000, gap_us: int = DAY) -> DataFrame:
    """A row (ALERTS) for every alert that changed, in update mode; the one with most ``merged_groups`` is current.

    ``groups`` is a stream of OBSERVED.  ``lateness`` is how far the watermark trails the
    newest group; ``kept_us`` is how long after an alert could take a timely group its
    state is kept for late ones.  Older groups than that open alerts of their own.
    Groups without a time wait for nothing.  State is one text a kind: what waits and the
    alerts of about the last day.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"waiting": [], "alerts": []}
        waiting, fold = kept["waiting"], Fold(kept["alerts"], gap_us)
        for part in parts:
            waiting += [plain({c: row[c] for c in NAMES}) for row in part.to_dict("records")]
        now = state.getCurrentWatermarkMs() * 1000
        quiet = state.hasTimedOut
        ready = sorted((g for g in waiting if quiet or g["first_us"] is None or g["first_us"] < now), key=in_order)
        waiting = [] if quiet else [g for g in waiting if g["first_us"] is not None and g["first_us"] >= now]
        changed = {}
        for group in ready:
            alert = fold.add(group)
            changed[alert["alert_key"]] = alert
        out = frame([dict(a) for a in changed.values()])
        fold.retire(now - kept_us)
        if waiting or fold.alerts:
            state.update((json.dumps({"waiting": waiting, "alerts": fold.alerts}),))
            if waiting:
                state.setTimeoutDuration(quiet_ms)
        elif state.exists:
            state.remove()
        yield out

    timed = groups.withColumn("_t", F.timestamp_micros("first_us")).withWatermark("_t", lateness)
    keyed = timed.groupBy("source_id", "primary")
    return keyed.applyInPandasWithState(step, ALERTS, "kept string", "update", GroupStateTimeout.ProcessingTimeTimeout)
