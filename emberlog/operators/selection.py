"""Choosing rows for review, cutting them by time, and how sure an estimate from a sample is."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Part of a selection that has to be mixed, and the part of it that one value may fill.
MIXED, PART = 0.75, 8


def diverse(rows: DataFrame, order: list[str], key: str, dimensions: list[str], limit: int) -> DataFrame:
    """The greedy choice of ``limit`` rows by falling ``order``, mixed by ``dimensions``; with ``place`` from 1.

    Until MIXED of the limit is chosen, a row is passed over if the values of all its
    dimensions were chosen max(3, limit // PART) times each; then rows are taken as they
    come, and where too few are left, those passed over follow.  ``order`` has no nulls
    and tells all rows apart; ``key`` is a key; null is a value of a dimension.

    Exact without sorting all rows: once a row is passed over, so are all later ones of
    the same values, so the first part takes the first rows of each combination; and as
    few values can be full, it ends within a number of rows that depends on ``limit``
    alone.  So many rows are walked through in order; what follows is a limit.
    """
    down = [F.desc(c) for c in order]
    first, most = int(limit * MIXED), max(3, limit // PART)
    full = (first // most) ** len(dimensions)
    place = F.row_number().over(Window.partitionBy(*dimensions).orderBy(*down))
    heads = rows.withColumn("_r", place).filter(F.col("_r") <= first).select(key, *order, *[F.col(c).cast("string").alias(f"_d{i}") for i, c in enumerate(dimensions)])
    walked = heads.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[f"_d{i}" for i in range(len(dimensions))])
    walked = walked.orderBy(*[F.desc(f"_o{i}") for i in range(len(order))]).limit((full + 1) * first)

    def walk(parts):
        counts, n = [{} for _ in dimensions], 0
        for part in parts:
            taken = []
            for i, values in enumerate(zip(*[part[f"_d{k}"] for k in range(len(dimensions))], strict=True)):
                if n < first and not all(c.get(v, 0) >= most for c, v in zip(counts, values, strict=True)):
                    for c, v in zip(counts, values, strict=True):
                        c[v] = c.get(v, 0) + 1
                    n += 1
                    taken.append(i)
            yield part.iloc[taken]

    chosen = walked.coalesce(1).mapInPandas(walk, walked.schema).orderBy(*[F.desc(f"_o{i}") for i in range(len(order))]).collect()  # no more than limit rows
    keys = [r["_key"] for r in chosen]

    def take(rest: DataFrame) -> None:
        if len(keys) < limit:
            keys.extend(r[0] for r in rest.select(key, *order).orderBy(*down).limit(limit - len(keys)).collect())

    def unchosen() -> DataFrame:
        return rows.join(F.broadcast(numbered(keys).select(key)), key, "left_anti")

    def numbered(found: list) -> DataFrame:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(found)], f"`{key}` {kind}, place int")

    if len(chosen) == first and chosen:
        take(rows.filter(F.struct(*order) < F.struct(*[F.lit(chosen[-1][f"_o{i}"]).cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(order)])))
    take(unchosen())
    return rows.join(F.broadcast(numbered(keys)), key)


def rolling_windows(rows: DataFrame, group: str, us: str, windows: int, embargo_us: int = 0) -> DataFrame:
    """``rows`` with ``window``, 1 to ``windows``: each group whole in one, windows one after the other in time.

    Groups go by first time, last time and name; a window is full when it has its share of
    the rows.  Rows without a time, rows of too few groups, and rows no later than
    ``embargo_us`` after the last row of an earlier window get null.
    """
    timed = rows.filter(F.col(us).isNotNull())
    sizes = timed.groupBy(group).agg(F.count("*").alias("n"), F.min(us).alias("first"), F.max(us).alias("last"))
    placed, totals = running(sizes, [F.col("first"), F.col("last"), F.col(group)], {"upto": "n"})
    if totals["row"] < windows:
        return rows.withColumn("window", F.lit(None).cast("int"))
    ends, share = [], totals["upto"] / windows
    for _ in range(windows - 1):
        base = ends[-1] if ends else 0
        end = placed.filter(F.col("upto") - base >= share).agg(F.min("upto")).head()[0]
        if end is None:
            break
        ends.append(end)
    at = F.lit(1)
    for end in ends:
        at = at + (F.col("upto") - F.col("n") >= end).cast("int")
    named = placed.select(F.col(group), at.alias("_w"), "last")
    latest = named.groupBy("_w").agg(F.max("last").alias("_last"))
    before = Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)  # a row a window
    latest = latest.select("_w", F.max("_last").over(before).alias("_before"))
    out = rows.join(named.select(group, "_w"), group, "left").join(F.broadcast(latest), "_w", "left")
    late = F.col("_before").isNull() | (F.col(us) > F.col("_before") + embargo_us) if embargo_us else F.lit(True)
    return out.withColumn("window", F.when(F.col(us).isNotNull() & late, F.col("_w"))).select(*rows.columns, "window")


#: Cumulated chances of 0, 1, 2, ... of a Poisson number of mean 1, and the mixing constants of the random numbers.
POISSON = np.cumsum(np.exp(-1) / np.array([float(f) for f in np.cumprod([1, *range(1, 18)], dtype=np.int64)]))
GOLDEN, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 512


def poisson_weights(hashes: np.ndarray, replicas: int) -> np.ndarray:
    """How often each replica draws each row: rows by replicas, from the row's 64-bit hash and the replica's number."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + GOLDEN * np.arange(1, replicas + 1, dtype=np.uint64)[None, :]
        z = (z ^ (z >> np.uint64(30))) * MIX_1
        z = (z ^ (z >> np.uint64(27))) * MIX_2
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), "right")


CELLS = {"caught": ("threat", "flagged"), "missed": ("threat", "quiet"), "false": ("clean", "flagged"), "quiet": ("clean", "quiet")}


def bootstrap(outcomes: DataFrame, population: DataFrame, key: str = "key", replicas: int = 2000, seed: int = 7) -> DataFrame:
    """Precision, recall, false-alarm rate and F1 of a stratified sample, with 95 % intervals: one row a metric.

    ``outcomes`` are labelled rows (key, stratum, threat, flagged), ``population`` a row a
    stratum (stratum, population).  Every stratum's counts are scaled to its population;
    one without labelled rows leaves no estimate.  Replica 0 is the sample; in the others
    each row counts as often as a Poisson number of mean 1 made from its key says, so all
    replicas are sums that tasks add up in one pass, at any size of the sample.  Rows with
    a null threat (unsure) do not count.  Fewer than 20 replicas with a value give no interval.
    """
    rows = outcomes.filter("threat is not null").select("stratum", F.concat_ws("-", F.when(F.col("threat"), "threat").otherwise("clean"), F.when(F.col("flagged"), "flagged").otherwise("quiet")).alias("cell"), F.xxhash64(F.lit(seed), key).alias("h"))

    def draw(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            hashes = batch.column(2).to_numpy().view(np.uint64)
            for at in range(0, len(pairs), BLOCK):
                weights = np.concatenate([np.ones((len(pairs[at : at + BLOCK]), 1), np.int64), poisson_weights(hashes[at : at + BLOCK], replicas)], axis=1)
                for pair in set(pairs[at : at + BLOCK]):
                    mine = weights[[p == pair for p in pairs[at : at + BLOCK]]].sum(axis=0)
                    sums[pair] = sums.get(pair, 0) + mine
        for (stratum, cell), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([stratum] * len(total), pa.string()), pa.array([cell] * len(total), pa.string()), pa.array(np.arange(len(total)), pa.int32()), pa.array(total.astype(np.int64))], names=["stratum", "cell", "replica", "n"])

    drawn = rows.mapInArrow(draw, "stratum string, cell string, replica int, n long").groupBy("stratum", "replica").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == f"{a}-{b}", F.col("n"))), F.lit(0)).alias(c) for c, (a, b) in CELLS.items()])
    strata = population.filter("population > 0")
    grid = strata.select("stratum", "population", F.explode(F.sequence(F.lit(0), F.lit(replicas))).alias("replica"))
    known = grid.join(drawn, ["stratum", "replica"], "left")
    labelled = F.coalesce(sum((F.col(c) for c in CELLS), F.lit(0)), F.lit(0))
    scaled = known.withColumn("_n", labelled).groupBy("replica").agg(F.min("_n").alias("least"), *[F.sum(F.try_divide(F.col("population") * F.col(c), F.col("_n"))).alias(c) for c in CELLS])
    rate = lambda a, b: F.when((F.col("least") > 0) & (F.col(a) + F.col(b) > 0), F.col(a) / (F.col(a) + F.col(b)))
    rates = scaled.select("replica", rate("caught", "false").alias("precision"), rate("caught", "missed").alias("recall"), rate("false", "quiet").alias("false_alarm_rate"))
    both = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    rates = rates.withColumn("f1", both)
    metrics = ["precision", "recall", "false_alarm_rate", "f1"]
    long = rates.select("replica", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("replica", "m.*")
    # a list of at most ``replicas`` numbers a metric
    by = long.groupBy("metric").agg(F.max(F.when(F.col("replica") == 0, F.col("value"))).alias("estimate"), F.array_sort(F.collect_list(F.when(F.col("replica") > 0, F.col("value")))).alias("all"))
    at = lambda share: F.when(F.size("all") >= 20, F.round(F.get("all", F.floor(share * (F.size("all") - 1)).cast("int")), 4))
    return by.select("metric", F.round("estimate", 4).alias("estimate"), at(0.025).alias("low"), at(0.975).alias("high"))
