"""Addresses of both versions as two 64-bit halves: parsing, classes, and the longest block that holds each."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The special-purpose registries.  Private blocks, what is global inside them, and shared addresses.
PRIVATE = """0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16
198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32
::1/128 ::/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10""".split()
NOT_PRIVATE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
SHARED = ["100.64.0.0/10"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"\A{_OCTET}(\.{_OCTET}){{3}}\z"
#: Leading bits that addresses of a version share with others of their bucket, counted on 128 bits.
BUCKET_BITS = {4: 96 + 20, 6: 44}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shift(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, F.lit(by) if isinstance(by, int) else by.cast("int"))


def _joined(groups: Column, base: int) -> Column:
    """Whole number of groups of digits, each of 8 (decimal) or 16 (hexadecimal) bits."""
    return F.aggregate(groups, F.lit(0).cast("long"), lambda a, g: _shift(a, 8 if base == 10 else 16).bitwiseOR(F.conv(g, base, 10).cast("long")))


def _v6(text: Column) -> Column:
    """A struct of a version 6 address without embedded version 4 parts, else null."""
    none = F.array().cast("array<string>")
    listed = lambda t: F.when(t == "", none).otherwise(F.split(t, ":", -1))

    def built(halves: Column) -> Column:
        left, right = listed(F.get(halves, F.lit(0))), listed(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        short = F.lit(8) - F.size(left) - F.size(right)
        fits = F.when(F.size(halves) == 1, short == 0).otherwise((F.size(halves) == 2) & (short >= 1))
        groups = F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(short, F.lit(0))), right))
        return let(groups, lambda g: F.when(F.forall(g, lambda x: x.rlike(r"\A[0-9a-fA-F]{1,4}\z")), F.struct(F.lit(6).alias("version"), _joined(F.slice(g, 1, 4), 16).alias("high"), _joined(F.slice(g, 5, 4), 16).alias("low"))))

    return F.when(~text.contains(":::"), let(F.split(text, "::", -1), built))


def parse(ip: str | Column) -> Column:
    """Struct (version, high, low) of an address; null for anything else.

    Version 4 as four decimal numbers without leading zeros; version 6 in full, with one
    ``::`` for one group or more, with a version 4 tail, with a zone after ``%``.
    """

    def v6(t: Column) -> Column:
        address, zone = F.substring_index(t, "%", 1), F.split(t, "%", -1)
        tail = F.substring_index(address, ":", -1)
        embedded = F.when(tail.rlike(_V4), F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), let(_joined(F.split(tail, r"\."), 10), lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))))
        whole = F.when(address.contains("."), embedded).otherwise(address)
        zoned = (F.size(zone) == 1) | ((F.size(zone) == 2) & (F.get(zone, F.lit(1)) != ""))
        return F.when(zoned, let(whole, _v6))

    def any_version(t: Column) -> Column:
        four = F.struct(F.lit(4).alias("version"), F.lit(0).cast("long").alias("high"), _joined(F.split(t, r"\."), 10).alias("low"))
        return F.when(t.rlike(_V4), four).when(t.contains(":"), v6(t))

    return let(F.col(ip) if isinstance(ip, str) else ip, any_version)


def unmapped(address: Column) -> Column:
    """A version 4 address mapped into version 6 as what it is."""
    mapped = (address["version"] == 6) & (address["high"] == 0) & (F.shiftrightunsigned(address["low"], 32) == 0xFFFF)
    return F.when(mapped, F.struct(F.lit(4).alias("version"), address["high"].alias("high"), address["low"].bitwiseAND(0xFFFFFFFF).alias("low"))).otherwise(address)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def in_blocks(address: Column, blocks: list[str]) -> Column:
    """Whether an address (a struct) lies in one of a few fixed blocks; null if it is null."""
    rows = []
    for net in map(ipaddress.ip_network, blocks):
        whole, low = (1 << 128) - 1, (1 << 64) - 1
        mask = whole ^ (whole >> (net.prefixlen + (96 if net.version == 4 else 0)))
        base = int(net.network_address)
        rows.append(F.struct(F.lit(net.version).alias("v"), *[F.lit(_signed(x)).cast("long").alias(n) for n, x in (("mh", mask >> 64), ("ml", mask & low), ("h", base >> 64), ("l", base & low))]))
    hit = lambda b: (b["v"] == address["version"]) & (address["high"].bitwiseAND(b["mh"]) == b["h"]) & (address["low"].bitwiseAND(b["ml"]) == b["l"])
    return F.when(address.isNotNull(), F.exists(F.array(*rows), hit))


def is_private(ip: str | Column) -> Column:
    """Whether an address is of a private block; false for what is no address."""
    return F.coalesce(let(parse(ip), lambda p: let(unmapped(p), lambda a: in_blocks(a, PRIVATE) & ~in_blocks(a, NOT_PRIVATE))), F.lit(False))


def is_global(ip: str | Column) -> Column:
    """Whether an address is public; false for what is no address.  Mapped shared addresses count as public."""
    return F.coalesce(let(parse(ip), lambda p: let(unmapped(p), lambda a: (~in_blocks(a, PRIVATE) | in_blocks(a, NOT_PRIVATE)) & ~in_blocks(p, SHARED))), F.lit(False))


def _masks(bits: Column) -> tuple[Column, Column]:
    """The halves of a mask of so many of 128 bits."""
    ones = F.lit(-1).cast("long")
    high = F.when(bits >= 64, ones).when(bits <= 0, 0).otherwise(_shift(ones, 64 - bits))
    low = F.when(bits >= 128, ones).when(bits <= 64, 0).otherwise(_shift(ones, 128 - bits))
    return high, low


def parsed_blocks(blocks: DataFrame, block: str) -> DataFrame:
    """Distinct ``block`` texts (address or address/bits) as version, high, low and bits of 128; others are left out.

    Bits of the address beyond the block's are cleared.
    """
    text = blocks.select(F.col(block).alias("block")).filter("block is not null").distinct()
    cut = text.select("block", parse(F.substring_index("block", "/", 1)).alias("a"), F.when(F.col("block").contains("/"), F.substring_index("block", "/", -1)).alias("_bits"))
    most = F.when(F.col("a.version") == 4, 32).otherwise(128)
    size = F.when(F.col("_bits").isNull(), most).otherwise(F.when(F.col("_bits").rlike(r"\A[0-9]{1,3}\z"), F.col("_bits").cast("int")))
    rows = cut.filter("a is not null").select("block", "a.*", (size + 128 - most).alias("bits"), size.alias("_size"), most.alias("_most")).filter("_size <= _most")
    high, low = _masks(F.col("bits"))
    return rows.select("block", "version", F.col("high").bitwiseAND(high).alias("high"), F.col("low").bitwiseAND(low).alias("low"), "bits")


def enclosing(blocks: DataFrame) -> DataFrame:
    """Pairs (block, outer) of ``parsed_blocks``: each block with all that hold it, itself included.

    A block meets the others by its address cut to each length that the list has, so the
    join has a row for every block and length.
    """
    lengths = blocks.select("version", F.col("bits").alias("_len")).distinct()
    inner = blocks.join(lengths, "version").filter("_len <= bits")
    high, low = _masks(F.col("_len"))
    cut = inner.select("block", "version", F.col("high").bitwiseAND(high).alias("high"), F.col("low").bitwiseAND(low).alias("low"), F.col("_len").alias("bits"))
    return cut.join(blocks.withColumnRenamed("block", "outer"), ["version", "high", "low", "bits"]).select("block", "outer", F.col("bits").alias("outer_bits"))


def longest_block(addresses: DataFrame, ip: str, blocks: DataFrame) -> DataFrame:
    """Distinct addresses with the longest of ``parsed_blocks`` that holds each, or null.

    Blocks become sorted ranges that do not overlap: a range begins with a block, and,
    where a block ends inside another one, with that other one again.  Each address takes
    the last range that begins at or before it, found by one ordered pass of a bucket's
    ranges and addresses.  A bucket is BUCKET_BITS of leading bits; the block that a bucket
    begins in is looked up by prefix.  Duplicate addresses are one row, so a frequent one
    is no hot key; mapped version 4 addresses are looked up as such.
    """
    bucket_bits = lambda: F.when(F.col("version") == 4, BUCKET_BITS[4]).otherwise(BUCKET_BITS[6])
    known = addresses.select(F.col(ip).alias("ip")).filter("ip is not null").distinct().select("ip", unmapped(parse("ip")).alias("a")).filter("a is not null").select("ip", "a.*")

    def bucketed(df: DataFrame) -> DataFrame:
        high, low = _masks(bucket_bits())
        return df.withColumn("bh", F.col("high").bitwiseAND(high)).withColumn("bl", F.col("low").bitwiseAND(low))

    known = bucketed(known)
    parents = enclosing(blocks).filter("block <> outer").groupBy("block").agg(F.max_by("outer", "outer_bits").alias("parent"))
    ranged = blocks.join(parents, "block", "left")
    inside = ranged.filter(F.col("bits") > bucket_bits())
    starts = inside.select("version", "high", "low", F.lit(1).alias("kind"), F.col("bits").alias("turn"), F.struct(F.col("block").alias("of")).alias("tag"))
    mh, ml = _masks(F.col("bits"))
    last = inside.select("version", F.col("high").bitwiseOR(F.bitwise_not(mh)).alias("high"), F.col("low").bitwiseOR(F.bitwise_not(ml)).alias("low"), "bits", "parent")
    carry = F.col("low") == -1
    after = last.select("version", F.when(carry, F.col("high") + 1).otherwise(F.col("high")).alias("high"), F.when(carry, 0).otherwise(F.col("low") + 1).cast("long").alias("low"), F.lit(0).alias("kind"), (-F.col("bits")).alias("turn"), F.struct(F.col("parent").alias("of")).alias("tag"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    after = bucketed(after)
    h, low_mask = _masks(bucket_bits())
    # an end beyond its block's bucket is not needed there: that bucket's own first range tells
    after = after.filter((F.col("bh") == F.col("_h").bitwiseAND(h)) & (F.col("bl") == F.col("_l").bitwiseAND(low_mask))).drop("_h", "_l")
    wide = blocks.filter(F.col("bits") <= bucket_bits())
    lengths = wide.select("version", F.col("bits").alias("bits")).distinct()
    firsts = known.select("version", "bh", "bl").distinct().join(lengths, "version")
    ch, cl = _masks(F.col("bits"))
    firsts = firsts.withColumn("high", F.col("bh").bitwiseAND(ch)).withColumn("low", F.col("bl").bitwiseAND(cl)).join(wide, ["version", "high", "low", "bits"])
    firsts = firsts.groupBy("version", "bh", "bl").agg(F.max_by("block", "bits").alias("block")).select("version", F.col("bh").alias("high"), F.col("bl").alias("low"), F.lit(-1).alias("kind"), F.lit(0).alias("turn"), F.struct(F.col("block").alias("of")).alias("tag"), "bh", "bl")
    ranges = bucketed(starts).unionByName(after).unionByName(firsts).withColumn("ip", F.lit(None).cast("string"))
    probes = known.select("version", "high", "low", F.lit(2).alias("kind"), F.lit(0).alias("turn"), F.lit(None).cast("struct<of:string>").alias("tag"), "bh", "bl", "ip")
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  unsigned order
    order = Window.partitionBy("version", "bh", "bl").orderBy(flip("high"), flip("low"), "kind", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = ranges.unionByName(probes).withColumn("at", F.last("tag", ignorenulls=True).over(order))
    return found.filter("ip is not null").select(F.col("ip").alias(ip), F.col("at.of").alias("block"))
