"""Trailing facts against a plain walk over sorted logs, slices and buffers of any size, and time on one hot host."""

import math
import random
import time
from collections import defaultdict, deque
from statistics import mean, pstdev

import numpy as np
import pyarrow as pa
import pytest

from emberlog.operators import trailing as TR

S = 1_000_000
SCHEMA = "log_id long, source_id int, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, us long, action string, app string, app_risk int, bytes long, bytes_sent long, bytes_received long, packets long, elapsed_time int"


def rows(seed, n=400, span=7200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        us = None if rng.random() < 0.01 else (rng.randrange(span) // rng.choice([1, 60, 300]) * rng.choice([1, 60, 300]) % span - 3600) * S
        out.append((i, rng.choice([1, 2, None]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", "z", None]), 9, rng.choice([1, 2, 3, 4, None]), rng.choice(["tcp", "UDP "]), us, rng.choice(["allow", "deny", "DROP", "reset-both"]), rng.choice(["ssl", "dns", "unknown", "incomplete", None]), rng.choice([1, 4, 5, None]), rng.choice([0, 10, 999, None]), rng.choice([1, 7, None]), 3, rng.choice([0, 2, 9]), 1))
    return out


def walk(data, key, minutes):
    """For each log the logs of its key that are no older than the minutes and not after it."""
    timed = sorted((r for r in data if r[7] is not None), key=lambda r: (r[7], r[0]))
    for k, r in enumerate(timed):
        yield r, [o for o in timed[: k + 1] if key(o) == key(r) and o[7] >= r[7] - minutes * 60 * S]


@pytest.mark.parametrize("seed", range(2))
def test_trailing_equals_walk(spark, seed):
    data = rows(seed)
    logs = spark.createDataFrame(data, SCHEMA)
    got = {r.log_id: r for r in TR.trailing(logs, {"5m": 5, "1h": 60}, slice_minutes=[60, 61][seed]).collect()}
    assert len(got) == sum(r[7] is not None for r in data)
    for name, m in {"5m": 5, "1h": 60}.items():
        for r, near in walk(data, lambda o: (o[1], o[2]), m):
            g = got[r[0]]
            want = (len(near), sum(o[8].lower() in ("deny", "drop") for o in near), len({o[5] for o in near} - {None}), len({o[3] for o in near} - {None}), sum(o[11] or 0 for o in near), sum(o[12] or 0 for o in near), sum(o[9] in ("unknown", "incomplete") for o in near), sum((o[10] or 0) >= 4 for o in near))
            assert (g[f"logs_{name}"], g[f"denied_{name}"], g[f"ports_{name}"], g[f"targets_{name}"], g[f"bytes_{name}"], g[f"sent_{name}"], g[f"unknown_{name}"], g[f"risky_{name}"]) == want
            if m == 5:
                assert g.repeats_5m == (sum(o[3] == r[3] and o[5] == r[5] for o in near) if r[3] and r[5] is not None else 0)
    targets = {r.log_id: r for r in TR.target_counts(logs, {"5m": 5, "1h": 60}).collect()}
    for r, near in walk([r for r in data if r[3]], lambda o: (o[1], o[3]), 60):
        assert targets[r[0]].target_logs_1h == len(near)


FAMILY = {"ssl": "encrypted_web", "dns": "dns", "unknown": "unresolved", "incomplete": "unresolved", None: "unresolved"}


def contexts(data):
    recent, targets, gaps, before = defaultdict(deque), defaultdict(deque), defaultdict(lambda: deque(maxlen=8)), {}
    for r in sorted((r for r in data if r[7] is not None), key=lambda r: (r[7], r[0])):
        src, dst = r[2] or f"-{r[0]}", r[3] or f"-{r[0]}"
        at = r[7] / S
        since = at - before[src] if src in before else 900.0
        if src in before:
            gaps[src].append(since)
        before[src] = at
        event = (at, dst, r[5], r[8] != "allow", (dst, r[5], r[6].strip().lower(), FAMILY[r[9]]))
        recent[src].append(event)
        targets[dst].append(at)
        five, fifteen = ([e for e in recent[src] if e[0] >= at - w] for w in (300, 900))
        g = list(gaps[src])
        jitter = pstdev(g) / mean(g) if len(g) >= 2 and mean(g) > 0 else 0.0
        yield r, (len(five), len(fifteen), len({e[1] for e in five}), len({e[2] for e in five} - {None}), sum(e[4] == event[4] for e in fifteen), sum(e[4][3] == event[4][3] for e in fifteen), sum(t >= at - 300 for t in targets[dst])), (sum(e[3] for e in five) / len(five), math.log1p(since), min(jitter, 10.0), len(five) / 5)


@pytest.mark.parametrize(("seed", "span", "minutes"), [(3, 7200, 15), (4, 7200, 60), (5, 400_000, 15)])
def test_context_equals_walk(spark, seed, span, minutes):
    """Also where most slices of a source are empty, so that its last gaps are many slices old."""
    data = rows(seed, 300, span)
    got = {r.log_id: r for r in TR.context_features(spark.createDataFrame(data, SCHEMA), minutes).collect()}
    seen = 0
    for r, whole, parts in contexts(data):
        g, seen = got[r[0]], seen + 1
        assert (g.src_events_5m, g.src_events_15m, g.src_unique_destinations_5m, g.src_unique_ports_5m, g.same_tuple_events_15m, g.same_app_events_15m, g.destination_events_5m) == whole
        assert np.allclose((g.src_deny_ratio_5m, g.source_interarrival_log_seconds, g.source_cadence_jitter, g.source_events_per_minute_5m), parts)
        assert math.isclose(g.log_bytes, math.log1p(r[11] or 0)) and math.isclose(g.outbound_byte_ratio, (r[12] or 0) / max(r[11] or 0, 1))
    assert seen == len(got)


def test_small_buffers_change_nothing(monkeypatch):
    """The pass over a partition in buffers of a few rows, where windows reach over many buffers."""
    rng = random.Random(6)
    data = sorted((k, rng.randrange(4000), i, rng.randrange(5)) for i, k in enumerate(rng.choices("abc", [8, 2, 1], k=600)))
    table = pa.table({"key": [d[0] for d in data], "_slice": [0] * 600, "us": [d[1] for d in data], "log_id": [d[2] for d in data], "v": [d[3] for d in data], "_own": [True] * 600})
    facts = lambda f, t: {"n": f.count(500), "d": f.distinct(TR.codes(t, "v"), 500), "s": f.same(TR.codes(t, "v"), 300), "j": TR.rhythm(f)[1]}
    out = {}
    for size in (10**6, 7, 40):
        monkeypatch.setattr(TR, "ROWS", size)
        found = [r for b in TR.streamed(table.to_batches(max_chunksize=min(size, 600)), ["key", "_slice"], ["log_id", "n", "d", "s", "j"], 500, facts, 9) for r in b.to_pylist()]
        out[size] = [(r["log_id"], r["n"], r["d"], r["s"], round(r["j"], 9)) for r in found]
    assert len(out[7]) == 600 and out[7] == out[40] == out[10**6]


def test_a_hot_host_takes_linear_time():
    """A million logs of one host in a window of all of them: seconds, where a walk of each window would take weeks."""
    took = []
    for n in (250_000, 1_000_000):
        us = np.sort(np.random.default_rng(1).integers(0, 60 * TR.MINUTE, n))
        began = time.time()
        frame = TR.Frame(np.zeros(n, np.int64), us, 60 * TR.MINUTE)
        values = np.arange(n) % 5000
        assert frame.distinct(values, 60 * TR.MINUTE)[-1] == 5000 and frame.total(values, 60 * TR.MINUTE)[-1] == values.sum() and frame.same(values, 60 * TR.MINUTE)[-1] == n // 5000
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1
