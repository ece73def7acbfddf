"""Queries over hosts beyond user 65,535, whose names in the view of the events are no addresses, against their SQL."""

import duckdb
import pytest
from test_queries import normal

from emberlog.plans import catalog
from emberlog.sources import logs as LG

USERS = [0, 3, 255, 256, 65_535, 65_536, 65_540, 70_001, 89_999, 540_000, 2_000_003]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Events of users of which the numbers go beyond two bytes, 23 of each."""
    d = tmp_path_factory.mktemp("hosts")
    users = ", ".join(map(str, USERS))
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL '37 minutes' AS ts, ([{users}])[i % {len(USERS)} + 1]::BIGINT AS user_id,
      (['click', 'view', 'error', 'purchase', 'signup'])[i % 5 + 1] AS event_type, (i % 97) * 1.25::DOUBLE AS value, '{{"k": ' || (i * 7 % 100) || '}}' AS props FROM range({23 * len(USERS)}) t(i)) TO '{d}/events.parquet' (FORMAT parquet)""")
    return str(d)


@pytest.mark.parametrize("name", ["address_blocks", "addresses", "window_shares", "parsed_lines", "parser_quality", "imported_lines"])
def test_query_equals_sql_beyond_two_bytes(spark, many, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, many).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_addresses_of_hosts(spark):
    named = {"10.1.0.0": "10.1.0.0", "10.1.255.255": "10.1.255.255", "10.1.256.0": "10.2.0.0", "10.1.2109.96": "10.9.61.96", "45.33.0.5": "45.33.0.5", "45.33.351.143": "45.34.95.143", "45.33.60000.1": "46.11.96.1", None: None}
    rows = spark.createDataFrame([(n,) for n in named], "name string").withColumn("address", LG.host_address("name")).withColumn("back", LG.host_name("address"))
    assert {r.name: (r.address, r.back) for r in rows.collect()} == {n: (a, n) for n, a in named.items()}
