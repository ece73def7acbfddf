"""Scanning from the internet: which groups are nothing more, and the hour's list of scanners they go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .correlation import Config
from .rules import GROUP_KEY, MALICIOUS_EVIDENCE, keyed

# Rules that scanning raises, the kinds of alert that say nothing more of a source, and what a list keeps.
SCANNING = ["possible_horizontal_scan", "possible_port_scan", "unusual_destination_port"]
SAYING_NOTHING = [*SCANNING, "internet_scanning", "behavior_model"]
ACTIVE = ["open", "investigating", "contained", "needs_more_context"]
LOGS_KEPT, PORTS_KEPT, SCANNERS_KEPT = 20, 8, 2000
HOUR = 3_600_000_000


def group_id() -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in [*GROUP_KEY, "lone"]]))


def routed(found: DataFrame, groups: DataFrame, open_alerts: DataFrame | None = None, own_alerts: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """Candidates (``found``) of groups that only scan from the internet: their logs go on the hour's list.

    A group of a scanning rule does, if it is admitted (``groups``), no log of it has
    evidence of malice, all come from the internet, and none of its sources does more:
    has an admitted group of another kind or with evidence, or an open alert of another
    kind (``open_alerts``: src_ip, alert_type, status).  ``own_alerts`` (group_id) names
    groups that an open alert of their own takes; they stay with it.  ``found`` is read
    several times, so it should be a written table.
    """
    rows = keyed(found, cfg).withColumn("group_id", group_id()).withColumn("_strong", F.exists("matches", lambda m: m["code"].isin(MALICIOUS_EVIDENCE)))
    scanning = F.col("primary").isin(SCANNING)
    facts = rows.groupBy("group_id", "primary").agg(F.max("_strong").alias("strong"), F.min(P.from_internet()).alias("outside"))
    facts = facts.join(groups.select(group_id().alias("group_id")), "group_id", "left_semi")
    members = rows.filter("src_ip is not null and src_ip <> ''").select("group_id", "src_ip").distinct()
    more = facts.filter(~scanning | F.col("strong")).join(members, "group_id").select("src_ip")
    if open_alerts is not None:
        more = more.unionByName(open_alerts.filter(F.col("status").isin(ACTIVE) & ~F.col("alert_type").isin(SAYING_NOTHING) & F.col("src_ip").isNotNull()).select("src_ip"))
    out = facts.filter(scanning & ~F.col("strong") & F.col("outside")).select("group_id")
    out = out.join(members.join(more.distinct(), "src_ip", "left_semi").select("group_id").distinct(), "group_id", "left_anti")
    if own_alerts is not None:
        out = out.join(own_alerts.select("group_id"), "group_id", "left_anti")
    return rows.join(out, "group_id", "left_semi").drop("_strong")


LISTED = "hour_us long, address string, connections long, targets long, ports array<int>, answered long, answered_ping long, answered_ports array<int>, answering long, kept long"


def _first_ports(rows: DataFrame, name: str) -> DataFrame:
    """The first PORTS_KEPT ports of each hour and address, in order of first use, as (hour_us, address, name)."""
    first = rows.filter("dst_port is not null").groupBy("hour_us", "address", "dst_port").agg(F.min(F.struct("us", "log_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("hour_us", "address").orderBy("at"))
    return first.withColumn("_r", place).filter(F.col("_r") <= PORTS_KEPT).groupBy("hour_us", "address").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "dst_port"))), lambda x: x["dst_port"]).alias(name))


def hourly(rows: DataFrame, stored: DataFrame | None = None, live: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The lists of the hours that ``rows`` (logs of ``routed``) fall in, and the logs kept as evidence.

    The list has a row (LISTED) an hour and address: connections, the most targets of one
    check, ports in order of first use up to PORTS_KEPT, answers.  ``stored`` is the list
    so far: counts are added, ports stay and new ones follow.  Of ``live`` logs the first
    LOGS_KEPT of an hour and address are kept, of others all.  Only the SCANNERS_KEPT
    busiest addresses of an hour stay on the list; logs without a time are left out, those
    without a source are one address, ``unknown``.
    """
    at = rows.filter("us is not null").withColumns({"hour_us": F.col("us") - F.pmod("us", F.lit(HOUR)), "address": F.coalesce("src_ip", F.lit("unknown")), "_live": F.coalesce(live if live is not None else F.lit(False), F.lit(False))})
    key = ["hour_us", "address"]
    ping = P.lowered("protocol") == "icmp"
    main = at.groupBy(*key).agg(
        F.count("*").alias("connections"), F.countDistinct(F.when(F.col("dst_ip") != "", F.col("dst_ip"))).alias("targets"), F.count_if(P.answered()).alias("answered"), F.count_if(P.answered() & ping).alias("answered_ping"),
        F.countDistinct(F.when(P.answered(), F.col("dst_ip"))).alias("answering"),
    )
    now = main.join(_first_ports(at, "ports"), key, "left").join(_first_ports(at.filter(P.answered() & ~ping), "answered_ports"), key, "left")
    none = F.array().cast("array<int>")
    if stored is None:
        stored = rows.sparkSession.createDataFrame([], LISTED)
    both = now.alias("n").join(stored.alias("s"), key, "left")
    lists = lambda c: F.slice(F.concat(F.coalesce(f"s.{c}", none), F.array_except(F.coalesce(f"n.{c}", none), F.coalesce(f"s.{c}", none))), 1, PORTS_KEPT)
    add = lambda c: (F.coalesce(f"s.{c}", F.lit(0)) + F.col(f"n.{c}")).alias(c)
    most = lambda c: F.greatest(F.coalesce(f"s.{c}", F.lit(0)), F.col(f"n.{c}")).alias(c)
    before = F.coalesce("s.kept", F.lit(0))
    # whatever comes while fewer than LOGS_KEPT are kept is kept, so a log's place decides
    place = F.row_number().over(Window.partitionBy(*key).orderBy("us", "log_id"))
    first = at.withColumn("_place", place).filter(F.col("_place") <= LOGS_KEPT).join(stored.select(*key, F.col("kept").alias("_kept")), key, "left").filter(F.col("_live") & (F.col("_place") + F.coalesce("_kept", F.lit(0)) <= LOGS_KEPT))
    evidence = first.select(*key, "log_id").unionByName(at.filter(~F.col("_live")).select(*key, "log_id"))
    kept = evidence.groupBy(*key).agg(F.count("*").alias("_now"))
    merged = both.select(*key, add("connections"), most("targets"), lists("ports").alias("ports"), add("answered"), add("answered_ping"), lists("answered_ports").alias("answered_ports"), most("answering"), before.alias("_before"))
    merged = merged.join(kept, key, "left").withColumn("kept", F.col("_before") + F.coalesce("_now", F.lit(0))).drop("_before", "_now")
    others = stored.join(at.select("hour_us").distinct(), "hour_us", "left_semi").join(now.select(*key), key, "left_anti")
    names = [f.split()[0] for f in LISTED.split(", ")]
    whole = merged.select(*names).unionByName(others.select(*names))
    busiest = F.row_number().over(Window.partitionBy("hour_us").orderBy(F.desc("connections"), "address"))
    return whole.withColumn("_r", busiest).filter(F.col("_r") <= SCANNERS_KEPT).drop("_r"), evidence


def hours(listed: DataFrame) -> DataFrame:
    """The hour's alert: how many scanners its list has, their connections, and those that got answers."""
    return listed.groupBy("hour_us").agg(F.count("*").alias("scanners"), F.sum("connections").alias("connections"), F.count_if(F.col("answered") > 0).alias("answered_scanners"), F.sum("kept").alias("evidence"))
