"""Approximate nearest neighbours by cosine: a graph built by NN-descent, searched greedily.

Rows of equal vectors are one node.  Random hyperplanes give each node a few places in
sorted order, and neighbours in these orders are its first neighbours.  Each round of
NN-descent then joins every node with its neighbours and those it is a neighbour of, lets
these meet, and keeps the best: a neighbour of a neighbour is likely a neighbour.  A
query keeps a beam of the best nodes seen and in each hop looks at the neighbours of the
best that it has not looked at.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Neighbours of a node, sampled reverse neighbours, candidates a node gets from one meeting.
NEIGHBOURS, REVERSE, OFFERS = 32, 32, 5
#: Sorted orders for first neighbours, hyperplanes of each, nodes that are compared in a run of an order.
ORDERS, PLANES, RUN = 6, 24, 256
#: Search: nodes kept a query, nodes looked at in a hop, starting nodes for all queries.  Of
#: more nodes than GROWN beam and pivots grow with the logarithm of their number.
BEAM, LOOKS, PIVOTS, GROWN = 160, 24, 256, 50_000


def grown(least: int, n: int) -> int:
    return math.ceil(least * max(1.0, math.log(max(n, 2)) / math.log(GROWN)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (vec_id, embedding) that can be compared: not null or zero, all components finite."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0))
    return rows.filter(~bad & F.exists(e, lambda x: x != 0))


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 1), kind)


def nodes(rows: DataFrame, held: int) -> DataFrame:
    """Distinct vectors (node, vec, ids) with the ``held`` smallest ids of each.

    Equal vectors are reduced within every batch before they are shuffled.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1)
            m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1) + np.float32(0)
            order = np.argsort(ids, kind="stable")
            found: dict[bytes, list[int]] = {}
            for i in order:
                mine = found.setdefault(m[i].tobytes(), [])
                if len(mine) < held and (not mine or mine[-1] != ids[i]):
                    mine.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["vec", "ids"])

    parts = rows.mapInArrow(run, "vec binary, ids array<long>")
    whole = parts.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, held).alias("ids"))
    return whole.select(F.xxhash64("vec").alias("node"), "vec", "ids")


def _coded(vec: np.ndarray) -> list[bytes]:
    """Directions with components in 8 bits: the components, then their scale."""
    v = vec.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scale = (np.abs(v).max(axis=1) / 127).astype(np.float32)
    bits = np.rint(v / scale[:, None]).astype(np.int8)
    return [x.tobytes() + y.tobytes() for x, y in zip(bits, scale, strict=True)]


def _uncoded(raw: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1)
    return both[:, :-4].astype(np.float32) * np.ascontiguousarray(both[:, -4:]).view(np.float32)


def _small(df: DataFrame) -> DataFrame:
    """Nodes (node, half): the direction of each vector in 8 bits a component."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_coded(_matrix(batch.column(1))), pa.binary())], names=["node", "half"])

    return df.select("node", "vec").mapInArrow(run, "node long, half binary")


def _best(ids: np.ndarray, sims: np.ndarray, allowed: np.ndarray, k: int):
    """Row and column numbers of the k largest allowed similarities of each row."""
    sims = np.where(allowed, sims, -9)
    k = min(k, sims.shape[-1])
    at = np.argpartition(-sims, k - 1, axis=-1)[..., :k]
    good = np.take_along_axis(sims, at, -1) > -9
    return at, good


def first_edges(small: DataFrame, parts: int) -> DataFrame:
    """Edges (node, nbr, sim) between nodes near in sorted orders of hyperplane signs."""

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            half = _uncoded(batch.column(1).to_pylist())
            for t in range(ORDERS):
                planes = np.random.default_rng(100 + t).standard_normal((half.shape[1], PLANES)).astype(np.float32)
                signs = (half @ planes > 0).astype(np.int64)
                code = signs @ (1 << np.arange(PLANES - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(code), *batch.columns], names=["t", "code", "node", "half"])

    def meet(batches):
        ids, vecs, order = [], [], []

        def done():
            n, m, t = np.concatenate(ids), np.concatenate(vecs), np.concatenate(order)
            for at in range(0, max(len(n) - RUN // 2, 1), RUN // 2):
                part, mine = n[at : at + RUN], m[at : at + RUN]
                sims = mine @ mine.T
                same = (t[at : at + RUN][:, None] == t[at : at + RUN][None, :]) & ~np.eye(len(part), dtype=bool)
                cols, good = _best(part, sims, same, NEIGHBOURS)
                rows = np.broadcast_to(np.arange(len(part))[:, None], cols.shape)[good]
                cols = cols[good]
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(part[cols]), pa.array(sims[rows, cols].astype(np.float32))], names=["node", "nbr", "sim"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                order.append(batch.column(0).to_numpy(zero_copy_only=False))
                ids.append(batch.column(2).to_numpy(zero_copy_only=False))
                vecs.append(_uncoded(batch.column(3).to_pylist()))
                size += batch.num_rows
            if size > 100_000:
                yield from done()
                # the last run's second half meets what follows
                ids, vecs, order = [ids[-1][-RUN:]], [vecs[-1][-RUN:]], [order[-1][-RUN:]]
                size = len(ids[0])
        if size:
            yield from done()

    placed = small.mapInArrow(keys, "t int, code long, node long, half binary")
    # the node's own number parts equal codes, so that no range is larger than the others
    placed = placed.repartitionByRange(parts, "t", "code", "node").sortWithinPartitions("t", "code", "node")
    return placed.mapInArrow(meet, "node long, nbr long, sim float")


def _keep(edges: DataFrame) -> DataFrame:
    """The NEIGHBOURS best edges of each node; a hub's are cut down before they meet in one task."""
    one = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), F.desc("nbr")))
    return one.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).select("node", "nbr", "sim")


def _reverse(edges: DataFrame, seed: int) -> DataFrame:
    """At most REVERSE nodes a node is a neighbour of: the best of each slot, so that no hub gathers all."""
    slot = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(REVERSE))
    return edges.groupBy("nbr", slot.alias("slot")).agg(F.max_by("node", F.struct("sim", "node")).alias("node")).select(F.col("nbr").alias("v"), F.col("node").alias("a"))


def _meetings(rows: DataFrame) -> DataFrame:
    """Offers (node, nbr, sim) among the members (v, a, half, least) of each v, better than ``least``."""

    def offers(groups: list[pa.RecordBatch]):
        t = pa.Table.from_batches(groups)
        v, a, least = (t[c].to_numpy() for c in ("v", "a", "least"))
        half = _uncoded(t["half"].to_pylist())
        starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(v)]]))
        for at in range(0, len(starts), 512):
            s, n = starts[at : at + 512], sizes[at : at + 512]
            width = int(n.max())
            index = s[:, None] + np.minimum(np.arange(width)[None, :], n[:, None] - 1)
            real = np.arange(width)[None, :] < n[:, None]
            m = half[index]
            sims = m @ m.transpose(0, 2, 1)
            allowed = real[:, :, None] & real[:, None, :] & ~np.eye(width, dtype=bool)[None] & (sims > least[index][:, :, None])
            cols, good = _best(index, sims, allowed, OFFERS)
            g, r, k = np.nonzero(good)
            c = cols[g, r, k]
            yield pa.RecordBatch.from_arrays([pa.array(a[index[g, r]]), pa.array(a[index[g, c]]), pa.array(sims[g, r, c])], names=["node", "nbr", "sim"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0).to_numpy(zero_copy_only=False)
            # all but the last v of the batch are whole
            cut = int(np.searchsorted(v, v[-1])) if np.all(v[:-1] <= v[1:]) else 0
            if cut:
                held.append(batch.slice(0, cut))
                yield from offers(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from offers(held)

    return rows.repartition("v").sortWithinPartitions("v").select("v", "a", "half", "least").mapInArrow(run, "node long, nbr long, sim float")


def build(spark: SparkSession, scratch: Scratch, small: DataFrame) -> DataFrame:
    """The graph: edges (node, nbr, sim), NEIGHBOURS of each node."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch.save(_keep(first_edges(small, parts)), "edges-0")
    before = 0.0
    for k in count(1):  # edges only get better, so this ends
        worst = edges.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n"))
        known = small.join(worst, "node", "left").select(F.col("node").alias("a"), "half", F.when(F.col("n") >= NEIGHBOURS, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        own = small.select(F.col("node").alias("v"), F.col("node").alias("a"))
        members = edges.select(F.col("node").alias("v"), F.col("nbr").alias("a")).union(_reverse(edges, k)).union(own).distinct()
        merged = edges.union(_meetings(members.join(known, "a")))
        edges = scratch.save(_keep(merged), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        scratch.release()
        now = edges.agg(F.sum("sim")).first()[0] or 0.0
        if now - before <= 0.001 * abs(now):
            break
        before = now
    return edges


def search(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose key is divisible by ``every``, by greedy search.

    Returns query_id, rank (from 1), vec_id and score, the cosine in double precision of
    the vectors as given (32-bit components).  Equal scores go to the smaller vec_id.  The
    query's own id is no candidate; if fewer than k candidates exist, all are found.  Rows
    with a null key, or a vector that is null, zero or not finite throughout, take no part;
    rows that repeat a key and vector count once.  Vectors of unlike length are not
    compared: each length has a graph of its own, one after the other, so lengths must be
    few.  Of a key with vectors of several lengths the nearest of all count.  Other columns
    are not read.
    """
    rows = usable(vectors, key, vector)
    lengths = [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]
    found = [_search(spark, rows.filter(F.size("embedding") == n), every, k) for n in sorted(lengths) or [0]]
    each = found[0]
    for more in found[1:]:
        each = each.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(spark: SparkSession, rows: DataFrame, every: int, k: int) -> DataFrame:
    """Candidates (query_id, vec_id, score) of the queries among ``rows`` (vec_id, embedding) of one length."""
    scratch = Scratch(spark, "nndescent")
    all_nodes = scratch.save(nodes(rows, k + 1), "nodes")
    small = scratch.save(_small(all_nodes), "small")
    edges = build(spark, scratch, small)
    graph = scratch.save(edges.select(F.col("node").alias("v"), F.col("nbr").alias("a")).union(_reverse(edges, 0)).distinct().groupBy("v").agg(F.collect_list("a").alias("near")), "graph")

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0)
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1) + np.float32(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in m], pa.binary())], names=["query_id", "vec"])

    asked = rows.filter(F.col("vec_id") % every == 0).distinct().mapInArrow(own, "query_id long, vec binary")
    asked = scratch.save(asked.withColumn("node", F.xxhash64("vec")).withColumn("q", F.xxhash64("query_id", "vec")), "asked")
    n = small.count()
    beam_size, n_pivots = grown(BEAM, n), grown(PIVOTS, n)
    pivots = small.orderBy(F.xxhash64("node", F.lit(3))).limit(n_pivots).collect()  # a few hundred rows
    if not pivots:
        return asked.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    shared = spark.sparkContext.broadcast((np.array([p["node"] for p in pivots]), [bytes(p["half"]) for p in pivots]))

    def start(batches):
        ids, raw = shared.value
        m = _uncoded(raw)
        for batch in batches:
            if not batch.num_rows:
                continue
            half = _coded(_matrix(batch.column(1)))
            sims = _uncoded(half) @ m.T
            top = np.argsort(-sims, axis=1, kind="stable")[:, :LOOKS]
            nodes_, beams = batch.column(2).to_pylist(), []
            for i, x in enumerate(nodes_):
                beam = {int(ids[j]): float(sims[i, j]) for j in top[i]} | {x: 1.0}
                beams.append([{"node": n, "sim": s, "seen": False} for n, s in beam.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(half, pa.binary()), pa.array(beams, _beam)], names=["q", "half", "beam"])

    beam_type = "array<struct<node: long, sim: double, seen: boolean>>"
    state = scratch.save(asked.select("q", "vec", "node").mapInArrow(start, f"q long, half binary, beam {beam_type}"), "beam-0")

    def hop(batches):
        for batch in batches:
            halves, beams, ids, news = (c.to_pylist() for c in batch.columns[1:5])
            out = []
            for half, beam, found, vecs in zip(halves, beams, ids, news, strict=True):
                looked = {b["node"] for b in _next(beam)}
                new = {b["node"]: (b["sim"], b["seen"] or b["node"] in looked) for b in beam}
                fresh = [i for i, f in enumerate(found or []) if f not in new]
                if fresh:
                    sims = _uncoded([vecs[i] for i in fresh]) @ _uncoded([half])[0]
                    new |= {found[i]: (float(s), False) for i, s in zip(fresh, sims, strict=True)}
                kept = sorted(new.items(), key=lambda x: (-x[1][0], x[0]))[:beam_size]
                out.append([{"node": n, "sim": s, "seen": seen} for n, (s, seen) in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _beam)], names=["q", "half", "beam"])

    halves = small.select(F.col("node").alias("a"), F.col("half").alias("near_half"))
    # what leaves a beam is worse than all that stays and never comes back, so each hop looks
    # at new nodes, and this ends when every node of every beam has been looked at
    for h in count(1):
        looks = F.slice(F.array_sort(F.filter("beam", lambda b: ~b["seen"]), lambda x, y: F.when(x["sim"] > y["sim"], -1).when(x["sim"] < y["sim"], 1).when(x["node"] < y["node"], -1).when(x["node"] > y["node"], 1).otherwise(0)), 1, LOOKS)
        wanted = state.select("q", F.explode(looks).alias("b")).select("q", F.col("b.node").alias("v"))
        met = wanted.join(graph, "v").select("q", F.explode("near").alias("a")).distinct().join(halves, "a")
        met = met.groupBy("q").agg(F.collect_list(F.struct("a", "near_half")).alias("m"))
        both = state.join(met, "q", "left").select("q", "half", "beam", F.col("m.a").alias("ids"), F.col("m.near_half").alias("vecs"))
        state = scratch.save(both.mapInArrow(hop, f"q long, half binary, beam {beam_type}"), f"beam-{h}")
        scratch.drop(f"beam-{h - 1}")
        scratch.release()
        if not state.filter(F.exists("beam", lambda b: ~b["seen"])).limit(1).count():
            break

    def rank(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = _matrix(batch.column(2)).astype(np.float64), _matrix(batch.column(3)).astype(np.float64)
            score = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1)) / np.sqrt((q * q).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(4)], names=["q", "query_id", "score", "ids"])

    pairs = state.select("q", F.explode("beam.node").alias("node")).join(asked.select("q", "query_id", F.col("vec").alias("query_vec")), "q").join(all_nodes, "node")
    scored = pairs.select("q", "query_id", "query_vec", "vec", "ids").mapInArrow(rank, "q long, query_id long, score double, ids array<long>")
    return scored.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


_beam = pa.list_(pa.struct([("node", pa.int64()), ("sim", pa.float64()), ("seen", pa.bool_())]))


def _next(beam: list[dict]) -> list[dict]:
    """The nodes of a beam that are looked at next."""
    return sorted((b for b in beam if not b["seen"]), key=lambda b: (-b["sim"], b["node"]))[:LOOKS]
