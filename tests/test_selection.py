"""Ranks, selections, windows of time and bootstrap intervals against plain code."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import evaluation as E
from emberlog.operators import groups as G
from emberlog.operators import selection as S
from emberlog.operators.ranks import quantiles, running


def test_running_sums_with_a_far_and_a_hot_value(spark):
    """Nine in ten rows share one value and one is far away: places are exact and no partition has much more than its share."""
    rng = random.Random(1)
    rows = [(i, 5 if rng.random() < 0.9 else rng.randrange(10), rng.choice([None, 1, 7])) for i in range(4000)] + [(4000, 10**15, 2), (4001, None, 3)]
    df = spark.createDataFrame(rows, "id long, v long, n long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would become one
    try:
        got, totals = running(df, [F.col("v").asc_nulls_last(), F.col("id")], {"upto": "n"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total = {}, 0
    for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))):
        total += r[2] or 0
        want[r[0]] = (k, total)
    assert {r.id: (r.row, r.upto) for r in got.collect()} == want
    assert totals == {"row": 4002, "upto": total}
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 4002 / 4
    none, totals = running(df.limit(0), [F.col("id")])
    assert none.count() == 0 and totals == {"row": 0}


def test_quantiles_and_percentiles(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random() * 9])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, v double")
    values = [r[2] for r in rows if r[2] is not None]
    assert np.allclose(quantiles(df, "v", [0.0, 0.01, 0.5, 0.77, 1.0]), np.quantile(values, [0.0, 0.01, 0.5, 0.77, 1.0]))
    assert quantiles(df.limit(0), "v", [0.5]) == [None]
    order = lambda v: (v is not None, v or 0.0)
    for least in (50, 200):
        got = {r.id: r.percentile for r in G.cohort_percentile(df, "c", "v", least).collect()}
        for i, c, v in rows:
            own = [r[2] for r in rows if r[1] == c]
            pool = own if len(own) >= least else [r[2] for r in rows]
            assert got[i] == pytest.approx(sum(order(x) <= order(v) for x in pool) / len(pool))
    cut = Counter(r.part for r in E.ordered_cut(df, ["v", "id"], 4).collect())
    assert cut == {0: 150, 1: 150, 2: 150, 3: 150}


def greedy(rows, limit):
    most, counts, chosen = max(3, limit // 8), [Counter(), Counter(), Counter()], []
    ordered = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    for r in ordered:
        if len(chosen) >= limit:
            break
        if len(chosen) < int(limit * 0.75) and all(c[v] >= most for c, v in zip(counts, r[2:], strict=True)):
            continue
        chosen.append(r)
        for c, v in zip(counts, r[2:], strict=True):
            c[v] += 1
    picked = {r[0] for r in chosen}
    return [r[0] for r in (chosen + [r for r in ordered if r[0] not in picked])[:limit]]


@pytest.mark.parametrize(("seed", "n", "limit", "values"), [(1, 900, 64, 2), (2, 900, 40, 12), (3, 700, 200, 1), (4, 60, 100, 2), (5, 500, 3, 3), (6, 900, 64, 3), (7, 0, 10, 2)])
def test_diverse_equals_greedy(spark, seed, n, limit, values):
    """Few values, so that most combinations are full; one value only; more wanted than there are."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(9)]), rng.choice(["s", "s", f"s{rng.randrange(values)}"]), rng.choice([None, f"a{rng.randrange(values)}"]), rng.choice([443, rng.randrange(values)])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, score int, source string, app string, port int")
    got = S.diverse(df, ["score", "id"], "id", ["source", "app", "port"], limit).orderBy("place").collect()
    assert [r.id for r in got] == greedy(rows, limit)


def test_rolling_windows(spark):
    rng = random.Random(3)
    rows = []
    for g in range(80):
        start = rng.randrange(1000)
        rows += [(f"g{g}", start + rng.choice([0, 1, 200])) for _ in range(rng.choice([1, 1, 2, 40]))]
    rows += [("g1", None), ("never", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, us long")
    parts = {}
    for g, us in rows:
        if us is not None:
            parts.setdefault(g, []).append(us)
    ordered = sorted(parts, key=lambda g: (min(parts[g]), max(parts[g]), g))
    share, window, filled, want = sum(map(len, parts.values())) / 3, 1, 0, {}
    for g in ordered:
        if window < 3 and filled >= share:
            window, filled = window + 1, 0
        want[g] = window
        filled += len(parts[g])
    got = S.rolling_windows(df, "g", "us", 3).collect()
    assert len(got) == len(rows) and all(r.window == (None if r.us is None else want[r.g]) for r in got)
    assert len(set(want.values())) == 3
    ends = {w: max(u for g in parts if want[g] <= w for u in parts[g]) for w in (1, 2)}
    apart = S.rolling_windows(df, "g", "us", 3, embargo_us=5).collect()
    assert all(r.window == (None if r.us is None or want[r.g] > 1 and r.us <= ends[want[r.g] - 1] + 5 else want[r.g]) for r in apart)
    assert {r.window for r in S.rolling_windows(df, "g", "us", 200).collect()} == {None}


def estimate(cells, population):
    caught = missed = false = quiet = 0.0
    for stratum, size in population.items():
        n = sum(cells[stratum].values())
        if not n:
            return [None] * 4
        a, b, c, d = (cells[stratum][k] * size / n for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
        caught, missed, false, quiet = caught + a, missed + b, false + c, quiet + d
    p = caught / (caught + false) if caught + false else None
    r = caught / (caught + missed) if caught + missed else None
    return [p, r, false / (false + quiet) if false + quiet else None, 2 * p * r / (p + r) if p and r else None]


def test_bootstrap_equals_loop_with_the_same_weights(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["alerted", "notable", "other"]), rng.choice([True, False, False, None]), rng.random() < 0.4) for i in range(150)]
    population = {"alerted": 400, "notable": 900, "other": 90_000}
    df = spark.createDataFrame(rows, "key long, stratum string, threat boolean, flagged boolean")
    pop = spark.createDataFrame(list(population.items()) + [("none", 0)], "stratum string, population long")
    got = {r.metric: (r.estimate, r.low, r.high) for r in S.bootstrap(df.repartition(4), pop, replicas=300).collect()}
    hashes = {r.key: r.h for r in df.select("key", F.xxhash64(F.lit(7), "key").alias("h")).collect()}
    weights = S.poisson_weights(np.array([hashes[r[0]] for r in rows], np.int64).view(np.uint64), 300)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05

    def rates(weight):
        cells = {s: Counter() for s in population}
        for r, w in zip(rows, weight, strict=True):
            if r[2] is not None:
                cells[r[1]][int(r[2]), int(r[3])] += int(w)
        return estimate(cells, population)

    point, draws = rates([1] * len(rows)), [rates(weights[:, k]) for k in range(300)]
    for i, metric in enumerate(["precision", "recall", "false_alarm_rate", "f1"]):
        kept = sorted(d[i] for d in draws if d[i] is not None)
        assert got[metric] == pytest.approx((point[i], kept[int(0.025 * (len(kept) - 1))], kept[int(0.975 * (len(kept) - 1))]), abs=1.1e-4)
    assert S.bootstrap(df.filter("stratum <> 'other'"), pop, replicas=30).filter("estimate is not null or low is not null").count() == 0
