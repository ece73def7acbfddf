"""Runs over due windows against one run over everything, late logs, and what is read of a partitioned store."""

import random
import re

from pyspark.sql import functions as F
from test_detection import INSIDE, SCHEMA, T0, log

from emberlog.operators import incremental as N
from emberlog.operators import rules as U
from emberlog.sources.logs import micros

S = 1_000_000
START = int((T0 - T0.replace(year=1970, month=1, day=1, hour=0)).total_seconds()) * S


def some(n, span, seed=1):
    rng = random.Random(seed)
    return [log(i, rng.choice([None, *[rng.randrange(span)] * 30]), src_ip=rng.choice(["10.1.0.1", "10.1.0.2", "10.1.0.3", None]), dst_port=rng.choice([22, 443, *range(1000, 1015)]), action=rng.choice(["deny", "allow"]), repeat_count=rng.choice([1, 1, 3])) for i in range(n)]


def judge(logs):
    return U.evaluate(logs).select("log_id", F.array_sort(F.col("matches.code")).alias("codes"))


def told(df):
    return {r.log_id: tuple(r.codes) for r in df.collect()}


def test_runs_equal_one_run(spark, tmp_path):
    rows = spark.createDataFrame(some(220, 3000), SCHEMA)
    rows.withColumn("day", F.floor(micros("generated_time") / N.DAY)).write.partitionBy("day").parquet(str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    want, got, cursor, runs = told(judge(stored)), {}, N.Cursor(), 0
    while N.due(stored, cursor, quiet=True).now:
        part, cursor = N.run(stored, cursor, judge, limit=90, day="day")
        part = told(part)
        assert not part.keys() & got.keys()
        got |= part
        runs += 1
    assert got == want and runs >= 3


def test_only_days_around_the_batch_are_read(spark, tmp_path):
    rows = [log(i, 86_400 * d + 10 * i, src_ip="10.1.0.1") for d in range(9) for i in range(d * 10, d * 10 + 10)]
    spark.createDataFrame(rows, SCHEMA).withColumn("day", F.floor(micros("generated_time") / N.DAY)).write.partitionBy("day").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    low = START + 4 * N.DAY
    batch = N.by_days(stored, low, low + 1000 * S, "day")
    near = N.neighbours(stored, batch, day="day")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near._jdf.queryExecution().optimizedPlan().toString() + near._jdf.queryExecution().sparkPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    first = START // N.DAY
    assert filters and all(f">= {first + 4})" in f and f"<= {first + 4})" in f for f in filters), filters
    assert {r.log_id // 10 for r in near.collect()} <= {4}


def test_due_needs_a_whole_window_behind(spark):
    rows = spark.createDataFrame([log(0, 10), log(1, 290), log(2, 310), log(3, 650)], SCHEMA)
    got = N.due(rows, N.Cursor(), quiet=False)
    assert (got.waiting, got.now, got.before_us, got.reason) == (4, True, START + 300 * S, "window_complete")
    after = N.Cursor(START + 300 * S, 3, 3)
    assert N.due(rows, after, quiet=False) == N.Due(2, False, START + 300 * S, "newest_window_still_open")
    assert N.due(rows, after, quiet=True) == N.Due(2, True, None, "logs_stopped_arriving")
    assert N.due(rows, N.Cursor(START + 900 * S, 3, 3), quiet=True).reason == "nothing_waiting"
    assert N.next_end(rows, 2) == START + 300 * S and N.next_end(rows, 3) == START + 600 * S and N.next_end(rows, 5) is None


def test_a_late_log_is_judged_with_stored_neighbours(spark):
    """The tenth port of a scan comes in after its window was judged."""
    early = [log(i, i, **INSIDE | {"dst_port": 1000 + i}) for i in range(9)] + [log(50, 2000)]
    part, cursor = N.run(spark.createDataFrame(early, SCHEMA), N.Cursor(), judge)
    assert not any("possible_port_scan" in c for c in told(part).values())
    stored = spark.createDataFrame([*early, log(60, 5, **INSIDE | {"dst_port": 2000})], SCHEMA)
    assert N.due(stored, cursor, quiet=True).waiting == 1
    part, cursor = N.run(stored, cursor, judge)
    late = told(part)
    assert late.keys() == {60} and "possible_port_scan" in late[60]
    assert not N.due(stored, cursor, quiet=True).now
