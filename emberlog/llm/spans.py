"""Removal of repeated passages by sliding spans of sentences.

Every run of two sentences that is not tiny and every run of three sentences is hashed;
longer runs are made of these.  A run that an earlier document has too, or that the
document itself has had before, is a repeat, and the sentences it covers go.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, small_batches

#: A run has at least so many sentences and words; one sentence more, and any words will do.
SENTENCES, WORDS = 2, 10
#: Letters of scripts that put no space between words; two of them count as a word.
_unspaced = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]").findall
_ends = re.compile(r"[.!?]+[\"')\]]*\s+|[。！？]+\s*|\n\s*").finditer
_MASK, _PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def sentences(text: str) -> list[str]:
    """Pieces that give the text when joined; each ends with a sentence and the space after it."""
    out, at = [], 0
    for m in _ends(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def size(words: list[str]) -> int:
    """Number of words, with words counted by letters where no spaces part them."""
    n = len(words)
    for w in words:
        if not w.isascii() and (found := len(_unspaced(w))) > 1:
            n += found // 2 - (found == len(w))
    return n


def runs(pieces: list[str], least: int = SENTENCES, words: int = WORDS) -> dict[tuple[int, int], int]:
    """Hash of each run (first, after its last), in order of its first sentence.

    Runs have ``least`` sentences and ``words`` words or more, or one sentence more than
    that.  Of the latter those are left out that two of the former make up, as both
    repeat where it does.  Sentences count as equal when their words are, apart from case.
    Pieces without a word belong to runs but are not counted as sentences.
    """
    places, names, sizes = [], [], []
    for i, p in enumerate(pieces):
        if cut := p.lower().split():
            places.append(i)
            names.append(xxhash.xxh3_64_intdigest(" ".join(cut).encode("utf-8", "surrogatepass")))
            sizes.append(size(cut))
    large = [sum(sizes[i : i + least]) >= words for i in range(len(places) - least + 1)]
    out = {}
    for i, whole in enumerate(large):
        h = 0
        for x in names[i : i + least]:
            h = ((h ^ x) * _PRIME + (h >> 29)) & _MASK
        if whole:
            out[places[i], places[i + least - 1] + 1] = h
        if i + 1 < len(large) and not (whole and large[i + 1]):
            out[places[i], places[i + least] + 1] = ((h ^ names[i + least]) * _PRIME + (h >> 29)) & _MASK
    return out


def _firsts(pieces: list[str], least: int, words: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """The first run of each hash, and the later runs of hashes that the document has had."""
    first: dict[int, tuple[int, int]] = {}
    again = []
    for run, h in runs(pieces, least, words).items():
        if h in first:
            again.append(run)
        else:
            first[h] = run
    return first, again


def dedup(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = SENTENCES,
    words: int = WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Cut sentences covered by repeats out of every text.

    Returns all columns of ``docs`` with the text cut, and n_sentences and n_removed (of
    the same names in ``docs`` nothing is left).  A text without repeats is unchanged to
    the byte; nulls stay null and have no sentences; a text with too few sentences
    or words for a run is never cut.  Every row is a document of its own.  The smallest key
    has a passage first; rows that repeat a key, and rows with a null key, which come
    last, follow in the order in which they are read, so of equal rows the first stays
    whole.  An empty table gives an empty one.
    """
    small_batches(spark)
    scratch = scratch or Scratch(spark, "spans")
    docs = docs.drop("n_sentences", "n_removed", "_span_row")
    # the row's number is written down, so that both passes mean the same row by it
    docs = scratch.save(docs.withColumn("_span_row", F.monotonically_increasing_id()), "rows")

    def hashes(batches):
        for batch in slices(batches, "text"):
            codes, froms, tos, ends = [], [], [], [0]
            for t in batch.column(2).to_pylist():
                first, _ = _firsts(sentences(t or ""), least, words)
                codes += [h - (1 << 64) if h >> 63 else h for h in first]
                froms += [r[0] for r in first.values()]
                tos += [r[1] for r in first.values()]
                ends.append(len(codes))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((codes, pa.int64()), (froms, pa.int32()), (tos, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "row", "code", "at", "to"])

    found = docs.select(F.col(key).cast("long").alias("id"), F.col("_span_row").alias("row"), F.col(text).alias("text"))
    found = scratch.save(found.mapInArrow(hashes, "id long, row long, code array<long>, at array<int>, to array<int>"), "spans")
    each = found.select("row", F.explode("code").alias("code"))
    repeated = each.groupBy("code").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high").select("code")
    placed = found.select("id", "row", F.explode(F.arrays_zip("code", "at", "to")).alias("e")).select("id", "row", "e.code", "e.at", "e.to")
    shared = scratch.save(placed.join(repeated, "code"), "shared")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = shared.groupBy("code").agg(F.min(order).getField("row").alias("first"))
    later = shared.join(first, "code").filter("row <> first")
    cuts = scratch.save(later.groupBy(F.col("row").alias("_span_row")).agg(F.collect_list(F.struct("at", "to")).alias("_cuts")), "cuts")
    for name in ("spans", "shared"):
        scratch.drop(name)
    scratch.release()

    names = [n for n in docs.columns if n != "_span_row"]
    at = names.index(text)
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])

    def cut(batches):
        for batch in slices(batches, text):
            out, counts, gone = [], [], []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                pieces = sentences(t or "")
                drop: set[int] = set()
                for r in found or []:
                    drop.update(range(r["at"], r["to"]))
                for a, b in _firsts(pieces, least, words)[1]:
                    drop.update(range(a, b))
                out.append("".join(p for i, p in enumerate(pieces) if i not in drop) if drop else t)
                counts.append(len(pieces))
                gone.append(len(drop))
            columns = [*batch.columns[: len(names)], pa.array(counts, pa.int32()), pa.array(gone, pa.int32())]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    # the texts move once, at any size of the table
    return docs.join(cuts.hint("shuffle_hash"), "_span_row", "left").select(*names, "_cuts").mapInArrow(cut, schema)
