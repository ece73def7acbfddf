"""Text sources: log files, indicator feeds, labelled benchmark rows, labels; and counters as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import addresses as AD
from ..functions import predicates as P

# Header columns by which feeds are told apart.
FEED_TIME, BOTNET_COLUMN, INDICATOR_COLUMN = "first_seen_utc", "dst_ip", "ioc_value"
LABELS = ["benign", "benign_unusual", "needs_context", "suspicious", "malicious"]


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Non-blank lines (raw_line) of text files, without their line ends; at most ``limit`` if given."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r+$", "").alias("raw_line")).filter(F.trim("raw_line") != "")
    return lines.limit(limit) if limit else lines


def feed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Indicators of one feed: kind, ip, entries, state (global, private or invalid).

    A feed is comma-separated with a commented header, of botnet servers or of indicators
    with ports, or a plain list with comments.  The header, one line, says which.
    """
    text = F.trim(F.col(line))
    header = lines.filter(text.contains(f'"{FEED_TIME}"')).select(F.regexp_replace(text, r"^#+\s*", "").alias("h")).limit(1).collect()
    names = [c.strip().strip('"') for c in header[0]["h"].split(",")] if header else []
    kind = "botnet" if BOTNET_COLUMN in names else "indicators" if INDICATOR_COLUMN in names else "plain"
    body = lines.select(text.alias("t")).filter((F.col("t") != "") & ~F.col("t").startswith("#") & ~F.col("t").contains(f'"{FEED_TIME}"'))
    if kind == "plain":
        ips = body.select(F.get(F.split(F.trim(F.get(F.split("t", "#"), F.lit(0))), r"\s+"), F.lit(0)).alias("ip")).filter("ip <> ''")
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        row = F.from_csv("t", schema.simpleString().replace("struct<", "").replace(">", "").replace(":", " "), {"ignoreLeadingWhiteSpace": "true"})
        rows = body.select(row.alias("r")).select("r.*")
        if kind == "botnet":
            ips = rows.select(F.coalesce(F.trim(BOTNET_COLUMN), F.lit("")).alias("ip"))
        else:
            ips = rows.filter(F.trim("ioc_type") == "ip:port").select(F.regexp_replace(F.regexp_replace(F.coalesce(INDICATOR_COLUMN, F.lit("")), r":[^:]*$", ""), r"^\[(.*)\]$", "$1").alias("ip"))
    state = F.when(AD.parse("ip").isNull(), "invalid").when(P.is_global("ip"), "global").otherwise("private")
    return ips.groupBy("ip").agg(F.count("*").alias("entries")).select(F.lit(kind).alias("kind"), "ip", "entries", state.alias("state"))


def read_benchmark(spark: SparkSession, path: str, columns: dict[str, str], labels: dict[str, str]) -> DataFrame:
    """Rows of labelled comma-separated files with a header, columns renamed and labels mapped.

    A byte-order mark before the header is no part of its name.  Rows without a known label
    keep their text in ``error`` and have no label.
    """
    rows = spark.read.csv(path, header=True)
    rows = rows.select(*[F.col(f"`{c}`").alias(columns.get(n := c.lstrip("\ufeff").strip(), n)) for c in rows.columns])
    known = P.lookup(labels, P.lowered("label"))
    return rows.withColumn("error", F.when(known.isNull(), F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit(""))))).withColumn("label", known)


def checked_labels(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Label rows (log_id, label, all text) with ``problem``: null, no number, no such log, or no such label."""
    number = F.trim("log_id").try_cast("long")
    named = rows.withColumns({"label": P.lowered("label"), "_id": number})
    out = named.join(logs.select(F.col("log_id").alias("_id"), F.lit(True).alias("_found")), "_id", "left")
    problem = F.when(F.col("_id").isNull(), "log_id is no number").when(F.col("_found").isNull(), "no such log").when(~F.col("label").isin(LABELS), "no such label")
    return out.withColumn("problem", problem).drop("_id", "_found")


def metric_lines(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Counters in the text form of monitoring systems, a line a row; signs in label values are escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"')
    parts = [F.concat(F.lit(f'{c}="'), safe(c), F.lit('"')) for c in labels]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")
    return counts.select(F.concat(F.lit(name), inside, F.lit(" "), F.col(value).cast("string")).alias("line"))
