"""Addresses against the standard library, on odd strings; blocks against a search of all."""

import ipaddress
import random

from pyspark.sql import functions as F

from emberlog.functions import addresses as AD


def odd(rng):
    v4 = ".".join(str(rng.choice([0, 1, 9, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255, rng.randrange(256)])) for _ in range(4))
    v6 = str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(16), 0xFFFF << 32 | rng.getrandbits(32), 0x20010DB8 << 96 | rng.getrandbits(30), 0x20010000 << 96 | rng.getrandbits(90), 0xFE80 << 112 | rng.getrandbits(64), 0x0064FF9B << 96 | rng.getrandbits(82)])))
    kind = rng.randrange(12)
    if kind < 3:
        return v4
    if kind < 6:
        return v6
    if kind == 6:
        return ipaddress.IPv6Address(v6).exploded.upper()
    if kind == 7:
        return rng.choice(["::", "::ffff:", "1:2::", "0:0:0:0:0:ffff:", "::1:", "1:2:3:4:5:6:7:"]) + v4
    if kind == 8:
        return rng.choice([v4, v6]) + rng.choice(["%eth0", "%", "%a%b", "/8", " ", "\n", ".", ":"])
    text = list(rng.choice([v4, v6]))
    for _ in range(rng.choice([1, 1, 2])):
        text[rng.randrange(len(text))] = rng.choice(["", ":", "::", ".", "0", "00", "g", "F", "1", "256", "٣"])
    return "".join(text)


def known(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_equals_library(spark):
    rng = random.Random(1)
    texts = [odd(rng) for _ in range(10_000)] + ["", "::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":", "::1.2.3", "01.2.3.4", "1.2.3.4\n", "192.0.0.9", "192.0.0.170", "64:ff9b:1::1", "3fff::1", "2001:20::5", "100.64.0.1"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select("t", AD.parse("t").alias("a"), AD.is_private("t").alias("p"), AD.is_global("t").alias("g")).collect()
    good = 0
    for r in rows:
        want = known(r.t) if r.t is not None else None
        got = None if r.a is None else (r.a.version, (r.a.high & (1 << 64) - 1) << 64 | r.a.low & (1 << 64) - 1)
        assert got == (None if want is None else (want.version, int(want))), r.t
        assert (r.p, r.g) == ((want.is_private, want.is_global) if want else (False, False)), r.t
        good += want is not None
    assert good > 5000


def test_longest_block_equals_search(spark):
    rng = random.Random(2)
    base = ["10.0.0.0", "10.1.0.0", "10.1.2.0", "192.168.1.0", "2001:db8::", "2001:db8:1::", "fe80::", "::"]
    near = lambda: int(ipaddress.ip_address(rng.choice(base))) + rng.getrandbits(rng.choice([2, 9, 17, 24]))
    nets = set()
    for _ in range(250):
        n = near()
        bits = rng.choice([0, 1, 8, 12, 15, 16, 17, 20, 24, 31, 32]) if n < 1 << 32 and rng.random() < 0.7 else None
        nets.add(str(ipaddress.ip_network((n & (1 << 32) - 1, bits), strict=False)) if bits is not None else str(ipaddress.ip_network((n << 100 & (1 << 128) - 1 | n, rng.choice([0, 4, 12, 43, 44, 45, 64, 100, 127, 128])), strict=False)))
    nets |= {"255.255.255.255/32", "255.255.255.0/24", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "10.9.9.9"}
    ips = [str(ipaddress.ip_address(near() & (1 << 32) - 1)) for _ in range(500)] + [str(ipaddress.IPv6Address((n := near()) << 100 & (1 << 128) - 1 | n)) for _ in range(400)]
    ips += ["255.255.255.255", "255.255.255.254", "::ffff:10.1.2.3", "::", "no address", "255.255.254.255", "10.9.9.9"]
    ips += [str(a) for n in nets for net in [ipaddress.ip_network(n)] for a in (net.network_address, net.broadcast_address) if True]
    ips += [str(ipaddress.ip_address(x)) for n in nets for net in [ipaddress.ip_network(n)] if net.version == 4 for x in (int(net.broadcast_address) + 1,) if x < 1 << 32]
    blocks = AD.parsed_blocks(spark.createDataFrame([(n,) for n in nets] + [("10.0.0.0/33",), ("nonsense",), (None,)], "block string"), "block")
    assert blocks.count() == len(nets)
    got = AD.longest_block(spark.createDataFrame([(i,) for i in ips * 2] + [(None,)], "ip string"), "ip", blocks).collect()
    want = {}
    for i in ips:
        a = known(i)
        if a is not None:
            a = getattr(a, "ipv4_mapped", None) or a
            holding = [(net.prefixlen, n) for n in nets for net in [ipaddress.ip_network(n)] if net.version == a.version and a in net]
            want[i] = max(holding)[0] if holding else None
    assert len(got) == len(want)
    for r in got:
        assert (None if r.block is None else ipaddress.ip_network(r.block).prefixlen) == want[r.ip], r
    assert sum(r.block is not None for r in got) > 500


def test_empty(spark):
    blocks = AD.parsed_blocks(spark.createDataFrame([], "block string"), "block")
    got = AD.longest_block(spark.createDataFrame([("1.2.3.4",)], "ip string"), "ip", blocks).collect()
    assert [r.block for r in got] == [None]
    assert AD.longest_block(spark.createDataFrame([], "ip string"), "ip", blocks).filter(F.lit(True)).count() == 0
