"""Facts over the trailing minutes of every log, in one ordered pass of linear time.

Logs are dealt by key and slice of time and sorted within their partition; a slice also
gets the end of the one before it, so every trailing window is whole.  A task then streams
its rows through numpy: sums over a window are differences of running sums, a distinct
count is a running sum of values that come in and go out, and equal rows in a window are
found by their place among their like.  A busy key is cut by time, never collected; a task
holds the rows of the longest window twice at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P

MINUTE = 60_000_000
#: Rows that are worked on at once at least; more where a window holds more.
ROWS = 100_000


class Frame:
    """Rows sorted by run and time, and what their trailing windows hold.  Widths are in microseconds."""

    def __init__(self, run: np.ndarray, us: np.ndarray, longest: int):
        self.n, self.run, self.us = len(run), run, us
        self.at = np.arange(self.n)
        new = np.append(True, run[1:] != run[:-1]) if self.n else np.zeros(0, bool)
        self.first = np.maximum.accumulate(np.where(new, self.at, 0)) if self.n else self.at
        self.since = us - us[self.first] if self.n else us
        self.step = int(self.since.max(initial=0)) + longest + 2
        self.number = np.cumsum(new) - 1
        if self.n and (int(self.number[-1]) + 1) * self.step >= 1 << 62:
            raise OverflowError("too many keys for one buffer: use shorter slices")
        self.place = self.number * self.step + self.since

    def left(self, width: int) -> np.ndarray:
        """The first row of each row's window: rows of the same run, no older than the width."""
        return np.searchsorted(self.place, self.place - width, "left")

    def count(self, width: int) -> np.ndarray:
        return self.at - self.left(width) + 1

    def total(self, values: np.ndarray, width: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.at + 1] - sums[self.left(width)]

    def _groups(self, codes: np.ndarray) -> np.ndarray:
        return np.lexsort((self.at, codes, self.number))

    def distinct(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Different codes in each window; codes below 0 do not count."""
        order = self._groups(codes)
        same = (codes[order][1:] == codes[order][:-1]) & (self.number[order][1:] == self.number[order][:-1])
        leaves = np.searchsorted(self.place, self.place + width, "right")
        leaves[order[:-1][same]] = np.minimum(leaves[order[:-1][same]], order[1:][same])
        known = codes >= 0
        comes = np.bincount(self.at[known], minlength=self.n + 1)
        goes = np.bincount(leaves[known], minlength=self.n + 1)
        return np.cumsum(comes - goes)[: self.n]

    def same(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Rows of the window with the row's own code; 0 for codes below 0."""
        order = self._groups(codes)
        c, r = codes[order], self.number[order]
        group = np.cumsum(np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1]))) - 1 if self.n else c
        place = group * self.step + self.since[order]
        out = np.zeros(self.n, np.int64)
        out[order] = self.at - np.searchsorted(place, place - width, "left") + 1
        return np.where(codes >= 0, out, 0)


def codes(table: pa.Table, *columns: str, nulls: bool = False) -> np.ndarray:
    """Equal rows of the columns as equal numbers; -1 where one is null, unless nulls are values."""
    out, hole = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, bool)
    for c in columns:
        coded = pc.dictionary_encode(table[c].combine_chunks())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        k = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hole |= k < 0
        out = np.unique(out * (len(coded.dictionary) + 1) + k + 1, return_inverse=True)[1]
    return out if nulls else np.where(hole, -1, out)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column of whole numbers, nulls as 0."""
    return pc.fill_null(table[column].cast(pa.int64()), 0).to_numpy()


def streamed(batches, order: list[str], names: list[str], longest: int, facts: Callable[[Frame, pa.Table], dict[str, np.ndarray]], history: int):
    """Sorted rows of a partition in, facts of those marked ``_own`` out; what later windows reach is carried along."""
    held, new, count = None, [], 0

    def work():
        table = pa.Table.from_batches(new) if held is None else pa.concat_tables([held, pa.Table.from_batches(new)])
        skip = 0 if held is None else held.num_rows
        change = np.zeros(table.num_rows, bool)
        for c in order:
            k = codes(table, c, nulls=True)
            change[1:] |= k[1:] != k[:-1]
        frame = Frame(np.cumsum(change), table["us"].to_numpy(), longest)
        give = table["_own"].to_numpy().copy()
        give[:skip] = False
        found = {"log_id": table["log_id"].to_numpy()} | facts(frame, table)
        out = pa.RecordBatch.from_arrays([pa.array(found[c][give]) for c in names], names=names)
        start = min(int(frame.left(longest)[-1]), max(int(frame.first[-1]), table.num_rows - history))
        return out, table.slice(start).combine_chunks()

    for batch in batches:
        if batch.num_rows:
            new.append(batch)
            count += batch.num_rows
            if count >= max(ROWS, 0 if held is None else held.num_rows):
                out, held = work()
                new, count = [], 0
                yield out
    if new:
        yield work()[0]


def scan(rows: DataFrame, key: list[str], longest: int, facts: Callable[[Frame, pa.Table], dict[str, np.ndarray]], schema: str, slice_us: int | None = None, history: int = 0) -> DataFrame:
    """``log_id`` and what ``facts`` gives for every row with a time.

    ``rows`` have log_id (a key), us and the columns of ``key``; equal times go by
    log_id.  ``history`` rows of a key before a slice come along however old they are.
    A slice is four times the longest window unless given, so a quarter of the rows or
    less is read twice.
    """
    step = slice_us or 4 * longest
    if step < longest:
        raise ValueError("a slice must be as long as the longest window")
    base = rows.filter("us is not null").withColumn("_slice", F.floor(F.col("us") / step).cast("long")).withColumn("_own", F.lit(True))
    near = base.filter(F.col("us") >= (F.col("_slice") + 1) * step - longest).withColumns({"_slice": F.col("_slice") + 1, "_own": F.lit(False)})
    placed = base.unionByName(near)
    if history:
        tail = Window.partitionBy(*key, "_slice").orderBy(F.desc("us"), F.desc("log_id"))
        whole = F.struct("us", "log_id", *[c for c in rows.columns if c not in ("us", "log_id")])
        tails = base.withColumn("_r", F.row_number().over(tail)).filter(F.col("_r") <= history).groupBy(*key, "_slice").agg(F.collect_list(whole).alias("_tail"))
        before = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(-history, -1)))
        old = tails.withColumn("_before", before).select("_slice", F.explode(F.slice(F.sort_array("_before", asc=False), 1, history)).alias("o")).select("o.*", "_slice", F.lit(False).alias("_own"))
        placed = placed.unionByName(old.filter(F.col("us") < F.col("_slice") * step - longest))
    order = [*key, "_slice"]
    names = [f.split()[0] for f in schema.split(", ")]

    dealt = placed.repartition(*order).sortWithinPartitions(*order, "us", "log_id")
    return dealt.mapInArrow(lambda batches: streamed(batches, order, names, longest, facts, history), schema)


#: Names and minutes of the trailing widths.
WIDTHS = {"5m": 5, "15m": 15, "1h": 60, "24h": 1440}
SUMS = {"denied": "deny", "bytes": "bytes", "sent": "bytes_sent", "unknown": "unknown", "risky": "risky"}
SETS = {"ports": "dst_port", "targets": "dst_ip"}


def trailing(logs: DataFrame, widths: dict[str, int] = WIDTHS, slice_minutes: int | None = None) -> DataFrame:
    """Facts over the trailing minutes of each log's source and host, by log_id.

    Per width: logs, denials, distinct ports and targets, bytes and bytes sent, unknown and
    risky applications, and the share of denials; and ``repeats_5m``, the logs of the last
    five minutes to the same target and port (0 without them).  Logs of equal time count
    up to the log's own id; logs without a time give nothing; a null host is one of its own.
    """
    base = logs.select(
        "log_id", "source_id", "src_ip", "dst_ip", "dst_port", "us", "bytes", "bytes_sent",
        P.lowered("action").isin("deny", "drop").cast("long").alias("deny"),
        P.lowered("app").isin(P.UNKNOWN_APPS).cast("long").alias("unknown"),
        F.coalesce((F.col("app_risk") >= 4).cast("long"), F.lit(0)).alias("risky"),
    )

    def facts(frame: Frame, table: pa.Table) -> dict[str, np.ndarray]:
        values, sets = {f: numbers(table, c) for f, c in SUMS.items()}, {f: codes(table, c) for f, c in SETS.items()}
        out = {"repeats_5m": frame.same(codes(table, "dst_ip", "dst_port"), 5 * MINUTE)}
        for name, minutes in widths.items():
            out[f"logs_{name}"] = frame.count(minutes * MINUTE)
            out |= {f"{f}_{name}": frame.total(v, minutes * MINUTE) for f, v in values.items()}
            out |= {f"{f}_{name}": frame.distinct(c, minutes * MINUTE) for f, c in sets.items()}
        return out

    names = ["log_id", *(f"{f}_{n}" for n in widths for f in ("logs", *SUMS, *SETS)), "repeats_5m"]
    longest = max(5, *widths.values()) * MINUTE
    out = scan(base, ["source_id", "src_ip"], longest, facts, ", ".join(f"{c} long" for c in names), slice_minutes and slice_minutes * MINUTE)
    return out.withColumns({f"deny_share_{n}": F.round(F.col(f"denied_{n}") / F.col(f"logs_{n}"), 4) for n in widths})


def target_counts(logs: DataFrame, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """Logs to each log's target within its source over the trailing minutes, by log_id; logs without a target have none."""
    base = logs.filter("dst_ip is not null and dst_ip <> ''").select("log_id", "source_id", "dst_ip", "us")
    facts = lambda frame, table: {f"target_logs_{n}": frame.count(m * MINUTE) for n, m in widths.items()}
    return scan(base, ["source_id", "dst_ip"], max(widths.values()) * MINUTE, facts, ", ".join(["log_id long", *(f"target_logs_{n} long" for n in widths)]))


# Families of applications by words in their names, in order.
FAMILIES = {
    "encrypted_web": ["quic", "ssl", "web-browsing", "http"],
    "dns": ["dns"],
    "network_control": ["ping", "icmp", "traceroute"],
    "remote_access": ["ssh", "rdp", "telnet", "vnc"],
    "file_transfer": ["ftp", "smb", "nfs", "file"],
    "mail": ["smtp", "imap", "pop3", "mail"],
    "social_messaging": ["facebook", "line", "twitter", "tiktok"],
    "tunnel_realtime": ["ipsec", "stun", "rtp", "vpn"],
}
UNRESOLVED = ["", "incomplete", "insufficient-data", "unknown", "unknown-tcp", "unknown-udp", "unknown-p2p", "not-applicable"]


def app_family(app: str = "app") -> Column:
    out = F.when(P.lowered(app).isin(UNRESOLVED), "unresolved")
    for family, words in FAMILIES.items():
        out = out.when(P.names_one(P.lowered(app), words), family)
    return out.otherwise("other")


def action_group(action: str = "action") -> Column:
    return F.when(P.denied(action), "deny_drop_reset").when(P.lowered(action) == "allow", "allow").otherwise("other")


def port_band(port: str = "dst_port") -> Column:
    p = F.col(port)
    return F.when(p.isNull(), "missing").when(p <= 1023, "system").when(p <= 49151, "registered").otherwise("dynamic")


CONTEXT = "log_id long, src_events_5m long, src_events_15m long, src_unique_destinations_5m long, src_unique_ports_5m long, src_deny_ratio_5m double, same_tuple_events_15m long, same_app_events_15m long, source_interarrival_log_seconds double, source_cadence_jitter double, source_events_per_minute_5m double"
#: Gaps whose spread is a source's jitter; the gap of a source's first log, in seconds; the most that jitter counts.
GAPS, FIRST_GAP, MOST_JITTER = 8, 900.0, 10.0


def rhythm(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since the run's row before, and the spread over the mean of the last GAPS of these."""
    gap = np.where(frame.at > frame.first, (frame.us - np.roll(frame.us, 1)) / 1e6, np.nan)
    padded = np.concatenate([np.full(GAPS - 1, np.nan), gap])
    last = np.lib.stride_tricks.sliding_window_view(padded, GAPS).copy() if frame.n else np.zeros((0, GAPS))
    last[(frame.at[:, None] - np.arange(GAPS)[::-1]) <= frame.first[:, None]] = np.nan  # gaps of other runs
    known = np.isfinite(last)
    n = known.sum(axis=1)
    mean = np.where(known, last, 0).sum(axis=1) / np.maximum(n, 1)
    spread = np.sqrt((np.where(known, last - mean[:, None], 0) ** 2).sum(axis=1) / np.maximum(n, 1))
    jitter = np.where((n >= 2) & (mean > 0), spread / np.where(mean > 0, mean, 1), 0.0)
    return np.where(np.isnan(gap), FIRST_GAP, gap), np.minimum(jitter, MOST_JITTER)


def context_features(logs: DataFrame, slice_minutes: int = 60) -> DataFrame:
    """Each log in the context of its source's last 5 and 15 minutes and its target's last 5, with scaled sizes.

    A log without a source or target is a source or target of its own; logs of equal time
    go by log_id; logs without a time give nothing.
    """
    own = lambda c, name: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.concat(F.lit(f"missing-{name}-"), F.col("log_id").cast("string")))
    base = logs.select("log_id", "us", own("src_ip", "source").alias("src"), own("dst_ip", "destination").alias("dst"), "dst_port", P.lowered("protocol").alias("protocol"), app_family().alias("family"), P.denied("action").cast("long").alias("deny"))

    def facts(frame: Frame, table: pa.Table) -> dict[str, np.ndarray]:
        five, fifteen = 5 * MINUTE, 15 * MINUTE
        events = frame.count(five)
        since, jitter = rhythm(frame)
        return {
            "src_events_5m": events,
            "src_events_15m": frame.count(fifteen),
            "src_unique_destinations_5m": frame.distinct(codes(table, "dst"), five),
            "src_unique_ports_5m": frame.distinct(codes(table, "dst_port"), five),
            "src_deny_ratio_5m": frame.total(numbers(table, "deny"), five) / events,
            "same_tuple_events_15m": frame.same(codes(table, "dst", "dst_port", "protocol", "family", nulls=True), fifteen),
            "same_app_events_15m": frame.same(codes(table, "family"), fifteen),
            "source_interarrival_log_seconds": np.log1p(np.maximum(since, 0.0)),
            "source_cadence_jitter": jitter,
            "source_events_per_minute_5m": events / 5.0,
        }

    by_source = scan(base, ["src"], 15 * MINUTE, facts, CONTEXT, slice_minutes * MINUTE, history=GAPS + 1)
    by_target = scan(base.select("log_id", "us", "dst"), ["dst"], 5 * MINUTE, lambda f, t: {"destination_events_5m": f.count(5 * MINUTE)}, "log_id long, destination_events_5m long", slice_minutes * MINUTE)
    size = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    logged = {f"log_{c}": F.log1p(size(c)) for c in ("src_port", "dst_port", "bytes", "bytes_sent", "bytes_received", "packets", "elapsed_time", "app_risk")}
    ratios = {"bytes_per_packet": F.log1p(size("bytes") / F.greatest(size("packets"), F.lit(1.0))), "outbound_byte_ratio": size("bytes_sent") / F.greatest(size("bytes"), F.lit(1.0))}
    plain = logs.select("log_id", *[v.alias(k) for k, v in (logged | ratios).items()])
    return plain.join(by_source, "log_id").join(by_target, "log_id")
