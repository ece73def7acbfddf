"""Parsing of generated lines, deduplication, and a stream against the batch."""

from datetime import datetime

from pyspark.sql import functions as F

from emberlog.operators import parse as A
from emberlog.streaming import detect


def line(kind="TRAFFIC", n=115, **at):
    f = [""] * n
    for i, v in {1: "2024/03/01 10:00:00", 3: kind, 4: "end", 6: "2024/03/01 10:00:01", 7: "10.0.0.1", 8: "8.8.8.8", 14: "ssl", 16: "trust", 17: "untrust", 23: "1", 24: "1234", 25: "443", 29: "tcp", 30: "allow", 31: "10", 34: "high"}.items():
        if i < n:
            f[i] = v
    for i, v in at.items():
        f[int(i[1:])] = v
    return "2024-03-01T10:00:02+07:00 fw " + ",".join(f)


def test_parse(spark):
    lines = [line(), line("THREAT", 121, _32='"a, ""b"""'), line("SYSTEM", 26, _15="v"), line("ODD"), line(n=40), line(_7="host", _25="70000"), line(_7="2001:db8::1"), "two tokens", "  ", None, line(_23="1.5")]
    rows = A.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw_line string")).collect()
    got = {r.i: r for r in rows}
    assert {i: r.parse_status for i, r in got.items()} == {0: "parsed", 1: "parsed", 2: "parsed", 3: "unsupported", 4: "partial", 5: "partial", 6: "parsed", 7: "error", 10: "parsed"}
    assert (got[0].generated_time, got[0].dst_port, got[0].bytes, got[0].field_count) == (datetime(2024, 3, 1, 10, 0, 1), 443, 10, 115)
    assert (got[1].threat_name, got[1].threat_severity, got[1].bytes) == ('a, "b"', "high", None)
    assert (got[5].invalid_fields, got[5].src_ip, got[5].missing_fields) == (["src_ip", "dst_port"], None, ["src_ip", "dst_port"])
    assert got[6].src_ip == "2001:db8::1" and got[10].repeat_count is None and got[7].src_ip is None


def test_new_lines(spark):
    df = A.parse(spark.createDataFrame([(line(),), (line(),), (line(_14="dns"),), ("bad line",), ("bad line",)], "raw_line string"))
    assert A.new_lines(df).count() == 4
    assert A.new_lines(df, df.filter("app = 'dns'").select("raw_line_hash")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, datetime(2024, 3, 1, 10, i % 40, i % 60), f"10.0.0.{i % 3}", "deny" if i % 2 else "allow", 1 + i % 4) for i in range(300)] + [(1, datetime(2024, 3, 2, 10), "10.0.0.1", "allow", 1)]
    df = spark.createDataFrame(rows, "source_id int, generated_time timestamp_ntz, src_ip string, action string, repeat_count int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = detect.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    final = detect.window_counts(df).filter(F.col("window_start") < "2024-03-02")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, final.collect()))
    assert detect.bursts(final, 25, 5).count() > 0


def test_application_fields_and_ports(spark):
    at_end = {f"_{i}": v for i, v in zip(range(105, 110), ["sub", "cat", "tech", "4", "evasive-behavior"], strict=True)}
    lines = [
        line(_90="2024-03-01T10:00:00.5+07:00", _93="sub", _94="cat", _95="tech", _96="3", _97='"a,b"'),
        line("THREAT", 121, _90="2024-03-01T10:00:00.5+07:00", _94="sub", _95="cat", _96="tech", _97="5"),
        line(_90="2024-03-01T10:00:00.5+07:00", _91="sub", _92="cat", _93="tech", _94="2"),
        line(**at_end),
        line(n=40),
        line(_25="http", _14="unknown-udp"),
        line(n=120, _14=""),
    ]
    got = {r.i: r for r in A.parse(spark.createDataFrame(list(enumerate(lines)), "i int, raw_line string")).collect()}
    assert [(got[i].app_source, got[i].app_risk, got[i].app_category) for i in range(5)] == [("anchor", 3, "cat"), ("anchor", 5, "cat"), ("anchor_older", 2, "cat"), ("from_end", 4, "cat"), ("unresolved", None, None)]
    assert got[0].app_characteristic == "a,b" and got[3].app_characteristic == "evasive-behavior"
    assert got[5].invalid_fields == ["dst_port"] and got[5].app_state == "unresolved" and got[6].app_state == "absent"
    assert [got[i].layout for i in (0, 4, 6)] == ["known", "partial", "extended"]
    plain = A.parse(spark.createDataFrame([("2024-01-01T00:00:00Z host hello, world",), ("x",)], "raw_line string"), profile="syslog").collect()
    assert [(r.parse_status, r.message) for r in plain] == [("preserved", "hello, world"), ("error", None)]


def test_feeds(spark, tmp_path):
    from emberlog.sources import feeds

    text = '# "first_seen_utc","dst_ip","dst_port"\n"2024","45.33.1.2","443"\n"2024","45.33.1.2","80"\n"2024","10.0.0.1","80"\n"2024","host","1"\n'
    (tmp_path / "a.txt").write_text(text)
    got = {(r.kind, r.ip, r.entries, r.state) for r in feeds.feed(spark.read.text(str(tmp_path / "a.txt"))).collect()}
    assert got == {("botnet", "45.33.1.2", 2, "global"), ("botnet", "10.0.0.1", 1, "private"), ("botnet", "host", 1, "invalid")}
    rows = spark.createDataFrame([("8.8.8.8 # resolver",), ("# only a comment",), ("",), ("8.8.8.8",)], "value string")
    assert [(r.kind, r.ip, r.entries) for r in feeds.feed(rows).collect()] == [("plain", "8.8.8.8", 2)]
    rows = spark.createDataFrame([('# "first_seen_utc","ioc_value","ioc_type"',), ('"x","45.33.1.9:443","ip:port"',), ('"x","name","domain"',)], "value string")
    assert [(r.kind, r.ip) for r in feeds.feed(rows).collect()] == [("indicators", "45.33.1.9")]
    (tmp_path / "b.csv").write_text("﻿Kind,Label\na,BENIGN\nb,odd\n", encoding="utf-8")
    got = [(r.kind, r.label, r.error) for r in feeds.read_benchmark(spark, str(tmp_path / "b.csv"), {"Kind": "kind", "Label": "label"}, {"benign": "benign"}).collect()]
    assert got == [("a", "benign", None), ("b", None, "unknown label: odd")]
    assert feeds.read_lines(spark, str(tmp_path / "a.txt")).count() == 5


def test_import_counts_in_one_pass(spark, tmp_path):
    lines = [line(), line(), line(_14="dns"), "bad line", "bad line", "  ", line(n=40), line(n=40), None]
    whole = A.parse(spark.createDataFrame([(x,) for x in lines], "raw_line string"))
    slim = A.parse(spark.createDataFrame([(x,) for x in lines], "raw_line string"), only=["raw_line_hash", "parse_status"])
    assert slim.columns == ["raw_line", "raw_line_hash", "parse_status"]
    assert [tuple(A.import_counts(x).first()) for x in (whole, slim)] == [(7, 6, 1, 2)] * 2 == [tuple(A.import_counts(whole, A.new_lines(whole)).first())] * 2
    assert tuple(A.import_counts(slim.filter("false")).first()) == (0, 0, 0, 0)


def test_imported_lines_reads_events_once(spark):
    from emberlog.plans import ingest

    plan = ingest.imported_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
