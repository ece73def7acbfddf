"""Inside services that answer the internet: noted from logs, kept in a list, told about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .alerts import service_risk

#: Applications and sources that a service's row keeps, and when a service counts as new.
APPS_KEPT, SOURCES_KEPT, NEW_AFTER_US = 5, 10, 86_400_000_000
KEY = ["address", "port", "protocol"]


def is_exposure() -> Column:
    """A TCP or UDP connection from the internet to a port of an inside address, which was answered; no FTP data."""
    there = F.col("dst_port").isNotNull() & (F.coalesce("dst_ip", F.lit("")) != "")
    return P.lowered("protocol").isin("tcp", "udp") & there & P.from_internet() & P.answered() & ~P.is_ftp_data()


def noted(logs: DataFrame) -> DataFrame:
    """Per service what these logs show: connections, sources, first and last time, applications, sources by name.

    ``logs`` are ``prepared``.  Lists are cut from counts, so a busy service is one row a
    value before it is one list.
    """
    rows = logs.filter(is_exposure()).select(F.col("dst_ip").alias("address"), F.col("dst_port").alias("port"), P.lowered("protocol").alias("protocol"), "src_ip", F.when(P.lowered("app") == "", "unknown").otherwise(P.lowered("app")).alias("app"), "us")
    main = rows.groupBy(*KEY).agg(F.count("*").alias("connections"), F.countDistinct("src_ip").alias("sources"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    by_app = rows.groupBy(*KEY, "app").agg(F.count("*").alias("connections"))
    apps = by_app.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("app", "connections"))).alias("apps"))
    names = rows.select(*KEY, "src_ip").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy("src_ip"))).filter(F.col("_r") <= 2 * SOURCES_KEPT)
    return main.join(apps, KEY).join(names.groupBy(*KEY).agg(F.array_sort(F.collect_list("src_ip")).alias("names")), KEY)


def upsert(stored: DataFrame, now: DataFrame) -> DataFrame:
    """The list after a check: counts added, times widened, ``sources`` the most of any check, APPS_KEPT applications.

    ``stored`` has KEY, connections, sources, first_us, last_us, apps (a map), sample_sources
    and status.  Sources named first stay; new ones follow by name up to SOURCES_KEPT.
    """
    s, n = stored.alias("s"), now.alias("n")
    both = s.join(n, KEY, "full_outer")
    zero = F.create_map().cast("map<string,bigint>")
    sums = F.map_zip_with(F.coalesce("s.apps", zero), F.coalesce("n.apps", zero), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    ranked = F.array_sort(F.transform(F.map_entries(sums), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("app"), e["value"].alias("n"))))
    kept = F.map_from_entries(F.transform(F.slice(ranked, 1, APPS_KEPT), lambda e: F.struct(e["app"], e["n"])))
    old = F.coalesce("s.sample_sources", F.array().cast("array<string>"))
    return both.select(
        *KEY,
        (F.coalesce("s.connections", F.lit(0)) + F.coalesce("n.connections", F.lit(0))).alias("connections"),
        F.greatest(F.coalesce("s.sources", F.lit(0)), F.coalesce("n.sources", F.lit(0))).alias("sources"),
        F.least("s.first_us", "n.first_us").alias("first_us"),
        F.greatest("s.last_us", "n.last_us").alias("last_us"),
        kept.alias("apps"),
        F.slice(F.concat(old, F.array_except(F.coalesce("n.names", F.array().cast("array<string>")), old)), 1, SOURCES_KEPT).alias("sample_sources"),
        F.coalesce("s.status", F.lit("unreviewed")).alias("status"),
        F.coalesce("n.connections", F.lit(0)).alias("seen_now"),
    )


def findings(services: DataFrame, started_us: int | None) -> DataFrame:
    """Services of this check that have to be told about, with ``reason`` and ``severity``.

    Not expected goes before risky, that before new: first seen a day or more after the
    list was begun (``started_us``; null while there was none).  Expected ones are quiet.
    """
    rated = service_risk(services.filter("seen_now > 0 and status <> 'expected'").withColumn("_apps", F.col("apps")).withColumn("apps", F.map_keys("_apps")))
    fresh = F.lit(started_us is not None) & (F.col("first_us") >= F.lit((started_us or 0) + NEW_AFTER_US))
    reason = F.when(F.col("status") == "not_expected", "not_expected").when(F.col("risk").isNotNull(), "risky").when(fresh, "new")
    told = rated.withColumn("reason", reason).filter("reason is not null")
    severity = F.when(F.col("reason") == "not_expected", "High").when(F.col("reason") == "risky", F.col("risk_level")).otherwise("Medium")
    return told.withColumn("severity", severity).withColumn("apps", F.col("_apps")).drop("_apps")
