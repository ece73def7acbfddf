"""Label conflicts, model metrics, drift and ordered cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, running


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, from a confusion matrix."""
    hits = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = hits.join(said, "label", "full_outer").fillna(0)
    p, r = F.try_divide(F.col("hit"), F.col("said")), F.try_divide(F.col("hit"), F.col("support"))
    return both.select("label", "support", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support")), F.lit(0.0)).alias("f1"))


def cost(matrix: DataFrame, prices: dict[tuple[int, int], float]) -> DataFrame:
    """Total and mean cost of a confusion matrix; pairs without a price cost nothing."""
    key = F.concat_ws(">", "actual", "predicted")
    price = F.coalesce(F.create_map(*[F.lit(x) for (a, p), c in prices.items() for x in (f"{a}>{p}", float(c))])[key], F.lit(0.0))
    return matrix.agg(F.sum("n").alias("rows"), F.sum(price * F.col("n")).alias("cost"), (F.sum(price * F.col("n")) / F.sum("n")).alias("mean_cost"))


def _shares(rows: DataFrame, value: str, side: str, a, b) -> DataFrame:
    by = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(side) == a).alias("na"), F.count_if(F.col(side) == b).alias("nb"))
    total = by.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return by.crossJoin(F.broadcast(total)).select("v", F.try_divide(F.col("na"), F.col("ta")).alias("p"), F.try_divide(F.col("nb"), F.col("tb")).alias("q"))  # one row of totals


def total_variation(rows: DataFrame, value: str, side: str, a, b) -> DataFrame:
    """Half the summed difference of two distributions of a value."""
    return _shares(rows, value, side, a, b).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"))


def jensen_shannon(rows: DataFrame, value: str, side: str, a, b) -> DataFrame:
    """Jensen-Shannon divergence of two distributions, in bits."""
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / mid)).otherwise(0.0)
    return _shares(rows, value, side, a, b).agg(((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("divergence"))


def bounds(rows: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """The range outside of which a value is unlike the rows: quartiles and their distance."""
    q1, q3, p01, p99 = quantiles(rows, value, [0.25, 0.75, 0.01, 0.99])
    span = None if q1 is None else (q3 - q1) * factor
    low, high = (None, None) if q1 is None else (min(q1 - span, p01), max(q3 + span, p99))
    return rows.sparkSession.createDataFrame([(q1, q3, low, high)], "q1 double, q3 double, low double, high double")


def hysteresis(rows: DataFrame, key: list[str], order: list[str], level: str, up: int, down: int) -> DataFrame:
    """A two-state alarm over ordered rows: on at ``up`` or above, off at ``down`` or below, else as it was."""
    force = F.when(F.col(level) >= up, 1).when(F.col(level) <= down, 0)
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("alarm", F.coalesce(F.last(force, ignorenulls=True).over(before), F.lit(0)))


def ordered_cut(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows in order cut into ``parts`` of equal size, by exact rank, without one sorting task.

    ``order`` tells all rows apart; nulls come last.
    """
    placed, totals = running(rows, [F.col(c).asc_nulls_last() for c in order])
    return placed.withColumn("part", F.floor(F.col("row") * parts / max(totals["row"], 1)).cast("int")).drop("row")


def label_conflicts(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """Groups of rows that should be labelled alike and are not."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"), F.min(label).alias("low"), F.max(label).alias("high")).filter("labels > 1")
