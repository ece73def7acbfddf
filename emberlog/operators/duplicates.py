"""Lines stored more than once: the first copy stays, and labels and evidence follow it.

One mapping of removed to kept ids changes every table, so none is left pointing at a row
that is gone.  A line's kept copy is picked by an aggregate that is reduced before its
shuffle; the joins back to the copies are plain ones, which adaptive execution splits
where one line holds many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copies(raws: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_id, kept_raw) of the raw lines to remove, and (log_id, kept_log) of their logs.

    ``raws`` have raw_id and line_hash, ``logs`` log_id and raw_id.  The first copy that
    was parsed into a log stays, or the first one if none was.  Lines without a hash are
    no copies of anything; of several logs of one line the first stands for it.
    """
    parsed = logs.groupBy("raw_id").agg(F.min("log_id").alias("log_id"))
    rows = raws.filter("line_hash is not null").join(parsed, "raw_id", "left")
    first = rows.groupBy("line_hash").agg(F.min(F.struct(F.col("log_id").isNull().alias("bare"), "raw_id", "log_id")).alias("k"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(first.select("line_hash", F.col("k.raw_id").alias("kept_raw"), F.col("k.log_id").alias("kept_log")), "line_hash").filter("raw_id <> kept_raw")
    return gone.select("raw_id", "kept_raw"), gone.filter("log_id is not null").select("log_id", "kept_log")


def label_moves(labels: DataFrame, log_map: DataFrame) -> DataFrame:
    """Labels (label_id, log_id, ...) with ``state`` and the log they belong to afterwards.

    Of a line's labels on all its copies the newest (largest label_id) moves to the kept
    log if it is on a removed one; the others on removed logs are archived, pointing at
    the kept one.  Labels of the kept log, and of logs without copies, stay.
    """
    placed = labels.join(log_map, "log_id", "left").withColumn("_to", F.coalesce("kept_log", "log_id"))
    newest = placed.groupBy("_to").agg(F.max("label_id").alias("_newest"))
    state = F.when(F.col("kept_log").isNull(), "stays").when(F.col("label_id") == F.col("_newest"), "moves").otherwise("archived")
    return placed.join(newest, "_to").withColumn("state", state).withColumn("log_id", F.col("_to")).select(*labels.columns, "state")


def repointed(evidence: DataFrame, log_map: DataFrame) -> DataFrame:
    """Evidence (alert_id, log_id) that cites kept logs, each once."""
    return evidence.join(log_map, "log_id", "left").select("alert_id", F.coalesce("kept_log", "log_id").alias("log_id")).distinct()


def removed(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows that ``gone`` names."""
    return table.join(gone.select(key), key, "left_anti")


def plan(raws: DataFrame, raw_map: DataFrame, log_map: DataFrame, labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """What the removal would do, as (measure, value)."""
    moves = label_moves(labels, log_map)
    cited = evidence.join(log_map, "log_id", "left_semi")
    measures = {
        "stored_lines": raws.agg(F.count("*").alias("v")),
        "lines_stored_more_than_once": raw_map.agg(F.countDistinct("kept_raw").alias("v")),
        "copies_to_remove": raw_map.agg(F.count("*").alias("v")),
        "logs_to_remove": log_map.agg(F.count("*").alias("v")),
        "labels_to_move": moves.agg(F.count_if(F.col("state") == "moves").alias("v")),
        "labels_to_archive": moves.agg(F.count_if(F.col("state") == "archived").alias("v")),
        "evidence_rows_on_copies": cited.agg(F.count("*").alias("v")),
        "alerts_citing_a_copy": cited.agg(F.countDistinct("alert_id").alias("v")),
    }
    out = None
    for name, one in measures.items():
        row = one.select(F.lit(name).alias("measure"), F.col("v").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def misattached(labels: DataFrame, logs: DataFrame, raws: DataFrame) -> DataFrame:
    """Labels (label_id, log_id, created_us) made before the line of their log was imported (raws: imported_us)."""
    at = logs.select("log_id", "raw_id").join(raws.select("raw_id", "imported_us"), "raw_id")
    return labels.join(at, "log_id").filter("created_us < imported_us").select(*labels.columns, "imported_us")
