"""Firewall syslog lines as log columns, and exact-line deduplication, without Python code on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as AD
from ..functions import predicates as P

# Positions (from 0) of fields in the payload of each log type, and the contract of each type.
SHARED = {"receive_time": 1, "serial": 2, "log_type": 3, "subtype": 4, "generated_time": 6, "src_ip": 7, "dst_ip": 8, "nat_src_ip": 9, "nat_dst_ip": 10, "rule_name": 11, "src_user": 12, "dst_user": 13, "app": 14, "vsys": 15, "src_zone": 16, "dst_zone": 17, "inbound_interface": 18, "outbound_interface": 19, "log_action": 20, "session_id": 22, "repeat_count": 23, "src_port": 24, "dst_port": 25, "protocol": 29, "action": 30}
TRAFFIC = {"bytes": 31, "bytes_sent": 32, "bytes_received": 33, "packets": 34, "start_time": 35, "elapsed_time": 36, "category": 37, "src_country": 41, "dst_country": 42, "packets_sent": 44, "packets_received": 45, "session_end_reason": 46, "device_name": 52, "action_source": 53, "rule_uuid": 65}
THREAT = {"category": 33, "src_country": 38, "dst_country": 39, "device_name": 59, "rule_uuid": 76, "session_end_reason": 69, "threat_name": 32, "threat_severity": 34, "threat_direction": 35}
MINIMUM_FIELDS = {"TRAFFIC": 47, "THREAT": 40, "SYSTEM": 15}
REQUIRED = {"TRAFFIC": ["generated_time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "app", "src_zone", "dst_zone"], "SYSTEM": ["generated_time", "log_type", "subtype", "vsys"]}
REQUIRED["THREAT"] = REQUIRED["TRAFFIC"]

TIMES = {"receive_time", "generated_time", "start_time"}
INTEGERS = {"repeat_count", "src_port", "dst_port", "elapsed_time"}
LONGS = {"bytes", "bytes_sent", "bytes_received", "packets", "packets_sent", "packets_received"}
ADDRESSES = ["src_ip", "dst_ip", "nat_src_ip", "nat_dst_ip"]
# Field counts of known layouts, and how far from a line's last ISO time the application's fields begin.
KNOWN_FIELDS = {"TRAFFIC": [115], "THREAT": [121], "SYSTEM": [26]}
AFTER_ANCHOR = {"TRAFFIC": 3, "THREAT": 4}
APPLICATION = ["app_subcategory", "app_category", "app_technology", "app_risk", "app_characteristic"]
#: A field up to its comma: quoted, with what follows the quote, or bare.  Nothing is tried twice.
FIELD = r'("[^"]*+"(?:"[^"]*+")*+[^,]*+|[^,]*+),'


def fields(payload: Column) -> Column:
    """Fields of a line of comma-separated values in one pass; quotes around a field go, doubled ones are one."""
    unquoted = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, r'^"((?:[^"]*+(?:"")?+)*+)"', "$1"), '""', '"')).otherwise(x)
    return F.transform(F.regexp_extract_all(F.concat(payload, F.lit(",")), F.lit(FIELD), F.lit(1)), unquoted)


def is_address(c: Column) -> Column:
    return AD.parse(c).isNotNull()


def _field(name: str, at: int) -> Column:
    raw = F.trim(F.get("_f", F.lit(at)))
    raw = F.when(raw != "", raw)
    if name in TIMES:
        # wall-clock time: an offset is dropped
        return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz"), F.regexp_replace(raw, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz"))
    if name in INTEGERS or name in LONGS:
        return raw.try_cast("int" if name in INTEGERS else "long")
    return raw


def _application(kind: Column) -> tuple[Column, Column]:
    """The application's fields (a struct of APPLICATION) and how they were found.

    They follow the line's last ISO time, by type or as older releases wrote them; a risk
    from 1 to 5 tells the right place.  Else they are counted from the line's end, if it is
    not cut off.
    """
    text = lambda at: F.nullif(F.trim(F.get("_f", at)), F.lit(""))
    risk = lambda at: text(at).try_cast("int")

    def made(at: Column, checked: bool) -> Column:
        r = risk(at + 3)
        parts = [text(at), text(at + 1), text(at + 2), r if checked else F.when(r.between(1, 5), r), text(at + 4)]
        return F.struct(*[p.alias(n) for p, n in zip(parts, APPLICATION, strict=True)])

    anchor = F.col("_anchor")
    named = F.when(kind == "TRAFFIC", anchor + AFTER_ANCHOR["TRAFFIC"]).when(kind == "THREAT", anchor + AFTER_ANCHOR["THREAT"])
    least = P.lookup(MINIMUM_FIELDS, kind)
    has = kind.isin(*AFTER_ANCHOR)
    by_type, older, whole = has & risk(named + 3).between(1, 5), has & risk(anchor + 4).between(1, 5), has & (F.size("_f") >= least)
    # without a match the fields from the end count
    found = F.when(by_type, made(named, True)).when(older, made(anchor + 1, True)).when(whole, made(F.size("_f") - 10, False))
    how = F.when(by_type, "anchor").when(older, "anchor_older").when(whole, "from_end").when(has, "unresolved").otherwise("not_applicable")
    return found, how


def parse(lines: DataFrame, raw: str = "raw_line", profile: str = "firewall", only: list[str] | None = None) -> DataFrame:
    """Lines (a column ``raw``, others kept) as log columns with a parse status.

    A line is a time, a host and a payload of comma-separated values.  Status is
    ``error`` (not three parts; the row stays as evidence with empty columns),
    ``unsupported`` (a log type without a contract: shared columns only), ``partial``
    (too few fields or a required one missing) or ``parsed``.  Addresses and ports that
    cannot be are dropped and named in ``invalid_fields``; blank lines give no row.
    ``layout`` tells whether the number of fields is known, ``app_source`` where the
    application's fields were found and ``app_state`` whether it is identified.  With the
    profile ``syslog`` the payload stays a message, with ``raw`` the line is evidence only.
    ``only`` names the columns to make of a firewall's lines; work for others is left out.
    """
    parts = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*$"
    rows = lines.filter(F.coalesce(F.trim(raw), F.lit("")) != "")
    good = F.col(raw).rlike(parts)
    split = {"syslog_time": F.when(good, F.regexp_extract(raw, parts, 1)), "syslog_host": F.when(good, F.regexp_extract(raw, parts, 2)), "raw_line_hash": F.sha2(raw, 256)}
    if profile == "syslog":
        return rows.withColumns(split | {"message": F.when(good, F.regexp_extract(raw, parts, 3)), "parse_status": F.when(good, "preserved").otherwise("error")})
    if profile == "raw":
        return rows.withColumns(split | {"parse_status": F.lit("fallback")})
    rows = rows.withColumns(split | {"_f": F.when(good, fields(F.regexp_extract(raw, parts, 3)))})
    times = F.transform("_f", lambda x, i: F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}T"), i))
    rows = rows.withColumn("_anchor", F.array_max(times))
    kind = F.upper(F.trim(F.get("_f", F.lit(3))))
    out = {}
    for name in dict.fromkeys([*SHARED, *TRAFFIC, *THREAT]):
        at = [F.when(kind == k, _field(name, table[name])) for k, table in (("TRAFFIC", TRAFFIC), ("THREAT", THREAT)) if name in table]
        out[name] = _field(name, SHARED[name]) if name in SHARED else F.coalesce(*at)
    # system records have a layout of their own
    for name in set(SHARED) - {"receive_time", "serial", "log_type", "subtype", "generated_time"}:
        out[name] = F.when(kind == "SYSTEM", _field(name, 7) if name == "vsys" else F.lit(None)).otherwise(out[name])
    app, source = _application(kind)
    rows = rows.withColumns(out).withColumns({"field_count": F.size("_f"), "_app": app, "app_source": F.when(F.col("_f").isNotNull(), source)})
    rows = rows.withColumns({n: F.col("_app")[n] for n in APPLICATION}).withColumn("app_state", F.when(F.col("_f").isNotNull(), P.application_state()))
    ports = {c: F.nullif(F.trim(F.get("_f", F.lit(SHARED[c]))), F.lit("")) for c in ("src_port", "dst_port")}
    bad = {c: F.col(c).isNotNull() & ~is_address(F.col(c)) for c in ADDRESSES}
    bad |= {c: (kind != "SYSTEM") & raw_port.isNotNull() & ~F.coalesce(F.col(c).between(0, 65535), F.lit(False)) for c, raw_port in ports.items()}
    rows = rows.withColumn("invalid_fields", F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in bad.items()])))
    rows = rows.withColumns({c: F.when(~F.array_contains("invalid_fields", c), F.col(c)) for c in bad})
    need = F.lit(None).cast("array<string>")
    for k, names in REQUIRED.items():
        need = F.when(F.col("log_type") == k, F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))).otherwise(need)
    least = P.lookup(MINIMUM_FIELDS, F.col("log_type"))
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in KNOWN_FIELDS.items() for x in p])[F.col("log_type")]
    n = F.col("field_count")
    layout = F.when(F.col("log_type").isNull(), "missing_log_type").when(least.isNull(), "unsupported_log_type").when(n < least, "partial").when(F.array_contains(known, n), "known").when(n > F.array_max(known), "extended").otherwise("compatible")
    rows = rows.withColumn("missing_fields", F.coalesce(need, F.array().cast("array<string>"))).withColumn("layout", F.when(F.col("_f").isNotNull(), layout))
    status = F.when(F.col("_f").isNull(), "error").when(least.isNull(), "unsupported").when((n < least) | (F.size("missing_fields") > 0), "partial").otherwise("parsed")
    rows = rows.withColumn("parse_status", status).drop("_f", "_anchor", "_app")
    # a generator keeps filters on the results from being worked out again below, field by field
    made = [c for c in rows.columns if c not in lines.columns and (only is None or c in only)]
    return rows.select(*lines.columns, F.inline(F.array(F.struct(*made))))


def quality(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Counters of parsing for each value of ``by``: states, dropped values, missing fields, layouts."""
    rate = lambda part: P.percent(part, F.count("*"))
    return parsed.groupBy(*by).agg(
        F.count("*").alias("lines"),
        *[F.count_if(F.col("parse_status") == s).alias(s) for s in ("parsed", "partial", "unsupported", "error")],
        F.count_if(F.size("invalid_fields") > 0).alias("with_invalid"),
        F.sum(F.size("missing_fields")).alias("missing"),
        F.count_if(F.col("app_state") == "unresolved").alias("unresolved_app"),
        F.count_if(F.col("layout").isin("extended", "compatible")).alias("other_layout"),
        rate(F.count_if(F.col("parse_status") == "parsed")).alias("parsed_percent"),
        rate(F.count_if(F.col("app_state") == "unresolved")).alias("unresolved_percent"),
    )


def new_lines(parsed: DataFrame, stored: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Parsed lines without exact repeats, in the batch or among ``stored`` (raw_line_hash).

    Of equal lines that of the smallest ``order``, a key, stays, or any if none is named.  Lines
    that are not parsed are kept, repeats too, as evidence.
    """
    whole = F.coalesce(F.col("parse_status") == "parsed", F.lit(False))
    other, first = parsed.filter(~whole), parsed.filter(whole)
    if order:
        keep = first.groupBy("raw_line_hash").agg(F.min(order).alias(order))
        first = first.join(keep, ["raw_line_hash", order], "left_semi").select(other.columns)
    else:
        first = first.dropDuplicates(["raw_line_hash"])
    if stored is not None:
        first = first.join(stored.select("raw_line_hash"), "raw_line_hash", "left_anti").select(other.columns)
    return first.unionByName(other)


def import_counts(parsed: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row: lines read, kept, repeats left out, and lines that could not be parsed.

    Without ``kept`` those count that ``new_lines`` keeps of the batch alone, in one pass:
    lines are counted by hash where they are parsed, and only counts by hash move.
    """
    if kept is None:
        line = F.when(F.col("parse_status") == "parsed", F.unhex("raw_line_hash"))
        by = parsed.groupBy(line.alias("line"), "parse_status").agg(F.count("*").alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        found = by.agg(total(F.col("n")).alias("read"), total(F.when(F.col("line").isNotNull(), 1).otherwise(F.col("n"))).alias("kept"), total(F.when(F.col("parse_status") == "error", F.col("n"))).alias("failed"))
        return found.select("read", "kept", (F.col("read") - F.col("kept")).alias("repeats"), "failed")
    both = parsed.select("parse_status", F.lit(0).alias("k")).union(kept.select("parse_status", F.lit(1).alias("k")))
    found = both.agg(F.count_if(F.col("k") == 0).alias("read"), F.count_if(F.col("k") == 1).alias("kept"), F.count_if((F.col("k") == 0) & (F.col("parse_status") == "error")).alias("failed"))
    return found.select("read", "kept", (F.col("read") - F.col("kept")).alias("repeats"), "failed")
