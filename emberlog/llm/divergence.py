"""Source divergence audit: how far each source's words are from its language's other sources.

Words are counted inside tasks over many texts at a time, then summed by language, source
and term; only terms of several documents of a language are kept.  A language's kept terms
are dealt by hash into blocks, and each block is a dense int64 tile of groups by terms, so
that the divergences of all pairs of groups over the block's terms are a few broadcast
operations.  A task adds up the pair matrices of its blocks and keeps, for every group, a
heap of its most overused terms; sums and heaps of the tasks are then merged.  All
arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches

#: Distinct terms of groups that a task counts before it hands them on.
HELD_TERMS = 400_000
#: Bytes of a text that are split into words at once.
WINDOW_BYTES = 1 << 20
#: Cells of a tile (groups times terms), and sums of pairs that a task adds up before it hands them on.
TILE_CELLS, PAIR_CELLS = 1 << 18, 1 << 21
#: ASCII letters as lower case, bytes of other letters as they are, all else as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, count long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def windows(text: bytes):
    """The words of a text, in lists of those of about WINDOW_BYTES."""
    at = 0
    while at < len(text):
        end = at + WINDOW_BYTES
        if end < len(text):
            cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        yield text[at:end].split()
        at = end


def _counted(batches):
    """Occurrences and documents of each term of each (lang, source), summed over many rows."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_on():
        for (lang, source), (count, docs) in groups.items():
            terms = list(count)
            for k in range(0, len(terms), 100_000):
                some = terms[k : k + 100_000]
                n = len(some)
                arrays = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(map(count.__getitem__, some), pa.int64()), pa.array(map(docs.__getitem__, some), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "count", "docs"])
        groups.clear()

    for batch in slices(batches, "text"):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            count, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in windows(text.translate(_TERM_BYTES)):
                count.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(c) for c, _ in groups.values()) > HELD_TERMS:
            yield from hand_on()
    yield from hand_on()


def scaled(count: np.ndarray, whole: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * count / whole) exactly, for counts up to ``whole``; a product beyond 64 bits is divided by digits."""
    if int(count.max(initial=0)) < (1 << 62) // scale:
        return count * scale // whole
    out, rest = np.zeros(np.broadcast_shapes(count.shape, whole.shape), np.int64), count
    while scale > 1:  # whole numbers of up to 9e15 times 1000 fit
        digit = min(scale, 1000)
        if scale % digit:
            raise ValueError("the scale must be a power of 1000")
        scale //= digit
        part = rest * digit
        out, rest = out * digit + part // whole, part % whole
    return out


class _Sums:
    """Of one language within a task: sums of pairs, and each group's terms of greatest value."""

    def __init__(self, groups: list[str], top: int):
        self.groups, self.top = groups, top
        self.pairs = np.zeros((len(groups), len(groups)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in groups]

    def add(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, v: int, scale: int) -> None:
        """A tile: terms in byte order, counts of groups by terms, words of each group, terms of the language."""
        p = 1 + scaled(counts + 1, (sizes + v)[:, None], scale)
        q = 1 + scaled(counts.sum(axis=0, keepdims=True) + 1, sizes.sum() + np.full((1, 1), v, np.int64), scale)
        for g in range(len(self.groups)):
            gap = p[g] - p
            self.pairs[g] += (gap * gap // p).sum(axis=1)
            over = np.flatnonzero((counts[g] > 0) & (p[g] > q[0]))
            value = (p[g, over] - q[0, over]) ** 2 // q[0, over]
            if len(over) > self.top:
                least = np.partition(value, -self.top)[-self.top]
                over, value = over[value >= least], value[value >= least]
            order = np.argsort(-value, kind="stable")[: self.top]  # of equal values the first term in byte order
            new = zip((-value[order]).tolist(), terms[over[order]].tolist(), strict=True)
            self.best[g] = list(islice(heapq.merge(self.best[g], new), self.top))

    def rows(self, lang: str):
        """Record batches of partial sums of pairs and of kept terms."""
        names = self.groups
        for g, name in enumerate(names):
            others = [h for h in range(len(names)) if h != g]
            items = [names[h] for h in others] + [t.decode() for _, t in self.best[g]]
            values = self.pairs[g, others].tolist() + [-x for x, _ in self.best[g]]
            if n := len(items):
                parts = ["pair"] * len(others) + ["term"] * len(self.best[g])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _tiles(top: int, scale: int):
    def run(batches):
        held: dict[str, _Sums] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                lang, known, v, tile = (batch.column(c)[k] for c in range(4))
                lang, v, known = lang.as_py(), v.as_py(), known.values
                sums = held.get(lang)
                if sums is None:
                    sums = held[lang] = _Sums(known.field("source").to_pylist(), top)
                if (tile := tile.values) is not None and len(tile):
                    terms, lists = tile.field("term").cast(pa.binary()), tile.field("groups")
                    order = pc.sort_indices(terms)
                    place = np.empty(len(order), np.int64)
                    place[order.to_numpy()] = np.arange(len(order))
                    entries = lists.flatten()
                    which = pc.index_in(entries.field("source"), value_set=known.field("source")).to_numpy()
                    counts = np.zeros((len(known), len(terms)), np.int64)
                    counts[which, np.repeat(place, pc.list_value_length(lists).to_numpy())] = entries.field("count").to_numpy()
                    sums.add(np.array(terms.take(order).to_pylist(), object), counts, known.field("size").to_numpy(), v, scale)
                if sum(s.pairs.size for s in held.values()) > PAIR_CELLS:
                    for name, s in held.items():
                        yield from s.rows(name)
                    held.clear()
        for name, s in held.items():
            yield from s.rows(name)

    return run


def audit(
    spark: SparkSession,
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = 3,
    top: int = 200,
    scale: int = 1_000_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Divergence of each source from the others of its language, and its most overused terms.

    Returns lang, source, part, item, value and rank.  Part ``pair``: each other source
    with the sum over kept terms of floor((p - q)^2 / q), p and q being the scaled shares
    of a term in the source and in the other one.  Part ``term``: the ``top`` terms that
    the source has more often than its language, q being the language's share.  Ranks go
    by value, then by item in byte order.

    Null texts, languages and sources count as ''; empty texts and groups without kept
    terms still make their pairs (value 0 in a language without kept terms); a language
    of one source has no pairs; repeated rows count each; an empty table gives no rows;
    other columns are not read.  A language's sources are one row of an array, as their
    pairs are asked for; counts are exact for up to 9e15 words a language.
    """
    scratch = scratch or Scratch(spark, "divergence")
    small_batches(spark)

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias({lang: "lang", source: "source", text: "text"}[c])

    rows = docs.select(plain(lang), plain(source), plain(text))
    counts = rows.mapInArrow(_counted, COUNTS)
    # one exchange serves both sums
    kept = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = kept.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("groups"))
    kept = scratch.save(kept.filter(F.col("docs") >= least_docs).select("lang", "term", "groups"), "kept")

    sizes = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.count").alias("size"))
    known = docs.select(plain(lang), plain(source)).distinct().join(sizes, ["lang", "source"], "left")
    known = known.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("size", F.lit(0)).alias("size")))).alias("known"))
    langs = known.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = scratch.save(langs.withColumn("tiles", F.ceil(F.col("v") * F.size("known") / TILE_CELLS)), "langs")

    dealt = kept.join(langs.filter("tiles > 0").select("lang", "tiles"), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "tiles"))
    tiles = dealt.groupBy("lang", "tile").agg(F.collect_list(F.struct("term", "groups")).alias("terms"))
    tiles = tiles.join(langs.select("lang", "known", "v"), "lang").select("lang", "known", "v", "terms")
    # an empty tile a language: pairs of languages without kept terms
    empty = langs.select("lang", "known", "v", F.lit(None).cast(tiles.schema["terms"].dataType).alias("terms"))
    found = tiles.unionByName(empty).mapInArrow(_tiles(top, scale), FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
