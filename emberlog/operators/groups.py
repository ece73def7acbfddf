"""Leakage groups, samples by class and stratum, and scores as percentiles of a cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .ranks import quantiles, running


def leakage_groups(spark: SparkSession, rows: DataFrame, key: str, prints: list[str], folder: str) -> DataFrame:
    """Rows (key, group) that share a fingerprint, directly or through others; the group is its smallest key.

    Each round gives every row the smallest group of the rows that share one of its
    fingerprints; a fingerprint's rows meet in an aggregate only, so a frequent one is no
    large group in a task.  Rounds are written to ``folder``, a path that driver and
    executors share, and end when no group changes.  Null fingerprints join nothing.
    """
    links = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.when(F.col(p).isNotNull(), F.concat(F.lit(f"{p}:"), F.col(p).cast("string"))) for p in prints])).alias("print")).filter("print is not null")
    links.write.mode("overwrite").parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    rows.select(F.col(key).alias("key"), F.col(key).alias("group")).distinct().write.mode("overwrite").parquet(f"{folder}/groups-0")
    k = 0
    while True:
        now = spark.read.parquet(f"{folder}/groups-{k}")
        low = links.join(now, "key").groupBy("print").agg(F.min("group").alias("low"))
        met = links.join(low, "print").groupBy("key").agg(F.min("low").alias("low"))
        near = now.join(met, "key", "left").select("key", F.least("group", "low").alias("group"))
        # the group of the group's own row halves the way to the smallest
        lead = near.select(F.col("key").alias("group"), F.col("group").alias("lead"))
        near.join(lead, "group", "left").select("key", F.least("group", "lead").alias("group"), "group").toDF("key", "group", "before").drop("before").write.mode("overwrite").parquet(f"{folder}/groups-{k + 1}")
        after = spark.read.parquet(f"{folder}/groups-{k + 1}")
        k += 1
        if not after.withColumnRenamed("group", "after").join(now, "key").filter("after <> group").limit(1).count():
            return after


def part_of_group(group: Column, salt: str, parts: list[tuple[str, int]]) -> Column:
    """Part names by shares of ten, the same for all rows of a group."""
    at, out = 0, None
    for name, share in parts:
        at += share
        cond = P.hash_part(group, salt) < at
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def round_robin(rows: DataFrame, label: str, order: list[str], n: int) -> DataFrame:
    """The first n rows when labels take turns, each label's rows in ``order``.

    A label needs no more than n rows, so others are cut before the turns are put in order.
    """
    turn = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", label).limit(n)


def stratified(rows: DataFrame, stratum: Column, key: str, salt: str, n: dict[str, int]) -> DataFrame:
    """Of each stratum the rows of the smallest salted digests, as many as ``n`` says, with the stratum's size."""
    draw = F.sha2(F.concat(F.lit(salt + ":"), F.col(key).cast("string")), 256)
    named = rows.withColumn("stratum", stratum).withColumn("_draw", draw)
    sizes = named.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_draw", key))
    taken = named.withColumn("_p", place).filter(F.col("_p") <= P.lookup(n, F.col("stratum"), 0)).drop("_p", "_draw")
    return taken.join(F.broadcast(sizes), "stratum")  # one row a stratum


def cohort_percentile(rows: DataFrame, cohort: str, score: str, least: int = 50) -> DataFrame:
    """``percentile``: the share of the cohort's scores not above a row's, or of all scores if the cohort is small.

    Equal scores of a cohort are counted first; the counts are summed in order over ranges,
    so neither a large cohort nor many scores are one task.  Null cohorts and scores are values.
    """
    pairs = rows.groupBy(cohort, score).agg(F.count("*").alias("_n"))
    own, _ = running(pairs, [F.col(cohort), F.col(score)], {"_upto": "_n"})
    sizes = own.groupBy(cohort).agg(F.sum("_n").alias("_many"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    whole, totals = running(pairs.groupBy(score).agg(F.sum("_n").alias("_n")), [F.col(score)], {"_upto": "_n"})
    same = lambda a, b, *names: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    table = own.alias("o").join(sizes.alias("s"), same("o", "s", cohort)).join(whole.alias("w"), same("o", "w", score))
    share = F.when(F.col("_many") >= least, (F.col("o._upto") - F.col("_start")) / F.col("_many")).otherwise(F.col("w._upto") / F.lit(max(totals["_upto"], 1)))
    table = table.select(F.col(f"o.{cohort}"), F.col(f"o.{score}"), share.alias("percentile"))
    return rows.alias("r").join(table.alias("t"), same("r", "t", cohort, score)).select("r.*", "t.percentile")


def window_class(rows: DataFrame, key: list[str], label: str, attacks: list[str], left_out: list[str]) -> DataFrame:
    """Class of each group of labelled rows: the most frequent attack, else ``exclude`` if a row is to be left out, else ``normal``."""
    by = rows.groupBy(*key, label).agg(F.count("*").alias("_n"))
    best = F.max(F.when(F.col(label).isin(attacks), F.struct(F.col("_n").alias("n"), F.col(label).alias("label"))))
    out = F.max(F.when(F.col(label).isin(left_out), True))
    return by.groupBy(*key).agg(best.alias("b"), out.alias("o")).select(*key, F.coalesce(F.col("b.label"), F.when(F.col("o"), "exclude"), F.lit("normal")).alias("class"))


def numeric_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: missing, smallest, largest, mean and exact median."""
    middle = {c: quantiles(rows, c, [0.5])[0] for c in columns}
    parts = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("missing"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"), F.avg(c).alias("mean"), F.lit(middle[c]).cast("double").alias("median")) for c in columns]
    return rows.agg(F.array(*parts).alias("a")).select(F.inline("a"))
