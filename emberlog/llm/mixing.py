"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a share of the words.  A document of a source that is to give ``r``
times its words is first taken ``floor(r * w)`` times for certain (``w``: its importance
over the mean, 1 by default).  What is left, ``p = r * w - floor(r * w)``, is its
inclusion probability in a Pareto order sample: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with a random ``u`` made from the key, and those of
the lowest rank are taken until the next one is longer than the source's left words.
Then the rows behind it are gone through in order of rank, and every one that still fits
is taken; at last the shortest row left, if it brings the source nearer to its target.

The ranks of a source are never sorted in one task: a histogram of the ranks finds the
cell in which the words run out, a second one the part of that cell, and only the rows of
that part are put in order; rows behind it are taken FILL at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: Cells of the histogram of ranks, for each source, and parts of the cell where words run
#: out; a window has the rows of one part, about a source's rows over the square of this.
CELLS = 4096
#: Rows behind the edge that one round goes through; rounds go on until nothing more fits.
FILL = 500


def word_count(text: Column) -> Column:
    """Number of words, by counting the positions where a word begins."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    # squeeze runs of spaces: what is left between words is one space each
    one = F.trim(F.regexp_replace(spaced, "  +", " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.translate(one, " ", "")) + 1).cast("long")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number above 0 and below 1 made from the key, or the text if the key is null: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, source: str, cap: float = 3.0, weights: int = 3) -> DataFrame:
    """Per source: its words and its target.

    Sources in code-point order, null last, weigh 1 to ``weights``, repeating.  Targets
    share all words by weight and stop at ``cap`` times the source's words; the excess is
    shared again by weight.  With sources ordered by words over weight, those up to some
    place stop at their cap and the rest share what is left: the first place at which the
    next source would not reach its cap.  One row a source is put in order in one task, so
    sources must be few beside documents.  A null source is one of its own; a source
    without words has the target 0; an empty table gives an empty one.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    with_weight = by_source.select("source", "source_size", ((rank - 1) % weights + 1).cast("double").alias("weight"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = with_weight.select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(order).alias("place"),
        F.sum("source_size").over(whole).cast("double").alias("all_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)).alias("capped"),
    ).withColumn("share", (F.col("all_words") - F.col("capped")) / F.col("weight_left"))
    below = F.col("share") * F.col("weight") <= F.col("source_size") * F.lit(cap)
    chosen = F.min_by("share", F.when(below, F.col("place"))).over(whole)
    return level.withColumn("chosen", chosen).select(
        "source",
        "source_size",
        F.when(F.col("chosen").isNull(), F.col("source_size") * F.lit(cap))
        .otherwise(F.least(F.col("chosen") * F.col("weight"), F.col("source_size") * F.lit(cap)))
        .alias("target"),
    )


def _scales(scratch: Scratch, rows: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """Per source the scale at which ``least(cap, scale * importance)`` copies of all rows make its target.

    Rows at the cap give cap times their size and the others share what is left by
    importance; that can bring others to the cap, so it is done again until none is.
    """
    now = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("importance")).alias("loose")).alias("s")
    now = now.join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("g.*", F.when(F.col("loose") > 0, F.col("target") / F.col("loose")).otherwise(0.0).alias("scale"), F.lit(0).cast("long").alias("at_cap"))
    now, k = scratch.save(now, "scales-0"), 0
    while True:
        known = rows.alias("r").join(now.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source"))).select("n.source", "r.size", "r.importance", "n.scale")
        full = F.col("scale") * F.col("importance") >= cap
        sums = known.groupBy("source").agg(F.sum(F.when(full, 1).otherwise(0)).alias("full"), F.sum(F.when(full, F.col("size")).otherwise(0)).alias("held"), F.sum(F.when(~full, F.col("size") * F.col("importance"))).alias("loose"))
        scale = F.when(F.col("loose") > 0, (F.col("target") - F.lit(float(cap)) * F.col("held")) / F.col("loose")).otherwise(F.col("scale"))
        before, k = now, k + 1
        now = before.alias("b").join(sums.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        now = scratch.save(now.select("b.source", "source_size", "target", scale.alias("scale"), F.col("full").alias("at_cap"), (F.col("full") > F.col("at_cap")).alias("more")), f"scales-{k}")
        if not now.filter("more").limit(1).count():
            return now.select("source", "source_size", "target", "scale")
        now = now.drop("more")


def _edge(scratch: Scratch, rows: DataFrame, cell: str, name: str) -> DataFrame:
    """Per source the cell in which ``left`` words run out, the words before it, and those left there."""
    sums = rows.filter(F.col(cell).isNotNull()).groupBy("source", cell).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    by_cell = Window.partitionBy("source").orderBy(cell)
    placed = sums.withColumn("before", F.sum("words").over(by_cell) - F.col("words"))
    at = (F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))
    return scratch.save(placed.groupBy("source").agg(F.max(F.when(at, F.col(cell))).alias("edge"), F.max(F.when(at, F.col("before"))).alias("edge_before")), name)


def _filled(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with ``extra`` 1 for those behind the edge that still fit, in order of rank.

    A round looks at the first FILL rows of each source that are no longer than what is
    missing; what it leaves is shorter than all of these, so rounds soon end.
    """
    rows = scratch.save(rows.withColumn("_id", F.monotonically_increasing_id()), "edge-taken")
    loose = F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("extra") * F.col("size"))), F.lit(0))
    missing = scratch.save(rows.groupBy("source").agg((F.first("left") - loose).alias("missing")), "missing-0")
    order = ["rank", "doc_key", "size", "_id"]
    spare = rows.filter("rank is not null and extra = 0").select("source", *order)
    picked, k = None, 0

    def fitting(now: DataFrame) -> DataFrame:
        free = spare if picked is None else spare.join(picked.select("_id"), "_id", "left_anti")
        return free.alias("r").join(now.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source"))).select("r.*", "m.missing")

    while True:
        near = fitting(missing).filter("size <= missing").withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("_n") <= FILL)
        lists = near.groupBy("source", "missing").agg(F.array_sort(F.collect_list(F.struct("_n", "size", "_id"))).alias("rows"))
        start = F.struct(F.col("missing").alias("missing"), F.array().cast("array<bigint>").alias("ids"))
        step = lambda s, r: F.when(r["size"] <= s["missing"], F.struct((s["missing"] - r["size"]).alias("missing"), F.array_append(s["ids"], r["_id"]).alias("ids"))).otherwise(s)
        done = scratch.save(lists.select("source", F.aggregate("rows", start, step).alias("a")).select("source", "a.*"), f"filled-{k}")
        k += 1
        if not done.limit(1).count():
            break
        new = done.select(F.explode("ids").alias("_id"))
        picked = scratch.save(new if picked is None else picked.unionByName(new), f"picked-{k}")
        missing = scratch.save(missing.alias("m").join(done.alias("d"), F.col("m.source").eqNullSafe(F.col("d.source")), "left").select("m.source", F.coalesce("d.missing", "m.missing").alias("missing")), f"missing-{k}")
    # nothing fits any more: the shortest row left is taken if that comes nearer to the target
    first = F.struct("size", "rank", "doc_key", "_id")
    nearest = fitting(missing).filter("missing > 0").groupBy("source", "missing").agg(F.min(first).alias("f")).filter("f.size - missing < missing").select("f._id")
    extra = nearest if picked is None else nearest.unionByName(picked)
    extra = scratch.save(extra.withColumn("_more", F.lit(1)), "extra")
    return rows.join(extra, "_id", "left").withColumn("extra", F.col("extra") + F.coalesce("_more", F.lit(0)))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cap: float = 3.0,
    seed: int = 7,
    importance: str | None = None,
    row: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """How many whole copies of each document the mix takes.

    Returns key, size, source_size, target, copies and taken (copies * size), a row for
    each row of ``docs``, and the column ``row`` of ``docs`` if one is named.  Null texts
    have size 0 and are never taken; null sources are a source of their own, the last;
    repeated rows are taken alike, but for the last few that use up a source's words.  No
    document gets more than ``ceil(cap)`` copies.  ``importance`` names a column of odds by
    which the documents of a source are taken; nulls count as 1, numbers below 0 as 0.
    """
    scratch = scratch or Scratch(spark, "mixing")
    carried = [F.col(row).alias("row")] if row else []
    slim = docs.select(
        F.col(key).alias("doc_key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        uniform(F.col(key), F.col(text), seed).alias("u"),
        (F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(1.0)), F.lit(0.0)) if importance else F.lit(1.0)).alias("importance"),
        *carried,
    )
    slim = scratch.save(slim, "sizes")  # the texts are read once
    goal = scratch.save(targets(slim, "source", cap), "targets")
    scale = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if importance:
        goal, scale = _scales(scratch, slim, goal, cap), F.col("scale")
    rows = slim.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", *(f"g.{c}" for c in goal.columns if c != "source"))
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), scale * F.col("importance"))).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("sure", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("sure"))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rank))
    # over the source's own odds ranks are spread evenly: as odds of a number between 0 and 1
    even = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    part = even - F.floor(even)
    odds = F.col("rank") * F.when((part > 0) & (part < 1), part / (1 - part)).otherwise(1.0)
    place = odds / (1 + odds) * CELLS
    rows = rows.withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(place)).cast("int"))
    rows = rows.withColumn("part", F.least(F.lit(CELLS - 1), F.floor((place - F.col("cell")) * CELLS)).cast("int"))
    rows = scratch.save(rows, "ranked")

    sure = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("left"))
    rows = rows.alias("r").join(scratch.save(sure, "left").alias("l"), F.col("r.source").eqNullSafe(F.col("l.source"))).select("r.*", "l.left")
    edge = _edge(scratch, rows, "cell", "edges")
    known = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left").select("r.*", "e.edge", F.coalesce("e.edge_before", F.lit(0)).alias("edge_before"))
    in_cell = known.filter("cell = edge").select("source", "size", "part", (F.col("left") - F.col("edge_before")).alias("left"))
    inner = _edge(scratch, in_cell, "part", "parts").select("source", F.col("edge").alias("last_part"), F.col("edge_before").alias("part_before"))
    known = known.alias("k").join(inner.alias("i"), F.col("k.source").eqNullSafe(F.col("i.source")), "left").select("k.*", "i.last_part", "i.part_before")
    on_edge = F.coalesce((F.col("cell") == F.col("edge")) & (F.col("part") == F.col("last_part")), F.lit(False))
    # without an edge either nothing is left to take or all loose rows are needed
    earlier = (F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & (F.col("part") < F.col("last_part")))
    loose = F.when(F.col("cell").isNull() | (F.col("left") <= 0), 0).when(F.col("edge").isNull(), 1).otherwise(earlier.cast("int"))
    plain = known.filter(~on_edge).withColumn("extra", loose.cast("long"))
    last = known.filter(on_edge)
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_key", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("edge_before") + F.col("part_before")
    last = last.withColumn("extra", (run <= F.col("left")).cast("long"))
    rows = _filled(scratch, plain.unionByName(last))
    copies = F.col("sure") + F.col("extra")
    return rows.select(
        F.col("doc_key").alias(key),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *([F.col("row").alias(row)] if row else []),
    )
