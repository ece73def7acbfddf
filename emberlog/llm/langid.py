"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton holds bounded labelled text.  A text is parsed from
its first letter to its last into the longest pieces that occur somewhere in that labelled
text; the fewer pieces a letter, the closer the language (the cross-parsing estimate of
relative entropy).  Pieces run on over the ends of words.

Before that, texts are lower-cased and all between letters is one space.  The most
frequent letters of the labelled text keep a symbol of their own, others have that of
their block of the code table.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, slices, small_batches

#: Bounds of the labelled sample: rows a language, characters of a language and of all, languages.
SAMPLE_ROWS, LANGUAGE_CHARS, ALL_CHARS, LANGUAGES = 400, 40_000, 400_000, 1000
UNKNOWN = "und"
#: Texts that need more pieces than they have letters are in no known language.
REJECT_RATE = 1.0
#: Symbols: the space, letters of their own, and blocks of other letters.
SYMBOLS, OWN = 64, 48
#: Longer texts are parsed in stretches side by side; stretches overlap by so many symbols.
STRETCH, OVERLAP = 2048, 256
#: States that step side by side.
WIDE = 1 << 15


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the symbol of its block, or 0 if it is no letter (category L)."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, OWN + (points >> 7) % (SYMBOLS - OWN), 0).astype(np.uint8)


def automaton(text: Iterable) -> list[dict]:
    """Transitions of the suffix automaton of ``text``; from state 0 they spell its substrings."""
    moves: list[dict] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Labelled text by language, of bounded size, from rows that are not held out.

    Of each language about SAMPLE_ROWS rows are drawn by a hash of key and text, and of
    each its first characters, LANGUAGE_CHARS in all (fewer if ALL_CHARS are shared by more
    than ten languages).  Of more than LANGUAGES labels those of most rows are learned.
    Rows with a null or empty text or a null label are left out; equal rows count once;
    the order of rows does not matter; without rows nothing is learned.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("key")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    limit = min(LANGUAGE_CHARS, ALL_CHARS // len(counts))
    plan = [(r["lang"], min(1.0, SAMPLE_ROWS / r["count"]), 2 * limit // min(SAMPLE_ROWS, r["count"]) + 1) for r in counts]
    plan = docs.sparkSession.createDataFrame(plan, "lang string, rate double, chars int")
    draw = F.pmod(F.xxhash64(F.lit(9), "key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(plan), "lang").withColumn("draw", draw).filter("draw < rate")
    # equal rows have equal draws: one of them is sent to the driver
    drawn = drawn.groupBy("lang", "draw").agg(F.min(F.expr("substring(text, 1, chars)")).alias("part")).collect()
    out: dict[str, str] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["draw"])):
        out[r["lang"]] = (out.get(r["lang"], "") + "\n" + r["part"])[:limit]
    return out


class Parser:
    """Counts the pieces of texts in each language.

    The automata are one table of states by symbols.  An entry holds the next state, when
    need be that after a restart at the root, and a bit that tells whether a piece begins.
    Many texts, in all languages, step through the table side by side.
    """

    def __init__(self, samples: dict[str, str]):
        self.codes = _letters().copy()
        common = Counter(c for text in samples.values() for c in text.lower() if self.codes[ord(c)])
        for i, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[: OWN - 1], 1):
            self.codes[ord(c)] = i
        flat, starts, sizes, letters = self.symbols(list(samples.values()))
        learnt = [i for i in range(len(samples)) if letters[i]]
        self.names = [list(samples)[i] for i in learnt]
        tables, roots, at = [], [], 0
        for i in learnt:
            moves = automaton(flat[starts[i] : starts[i] + sizes[i]].tolist())
            grid = np.full((len(moves), SYMBOLS), -1, np.int32)
            for state, to in enumerate(moves):
                grid[state, list(to)] = list(to.values())
            begins = grid < 0
            begins[0] = True
            again = np.maximum(grid[0], 0)
            tables.append((np.where(grid < 0, again, grid) + at) * (2 * SYMBOLS) + begins)
            roots.append(at * SYMBOLS)
            at += len(moves)
        self.table = np.concatenate(tables).ravel().astype(np.int32) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in one array, and for each its first place, length and letters.

        A text begins with the space that ends the text before it.
        """
        cut = "".join(["\n" + t.lower() for t in texts]) + "\n"
        codes = self.codes[np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
        found = codes > 0
        kept = found.copy()
        kept[1:] |= found[:-1]  # a word and the first of what is between it and the next
        places = np.concatenate([np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)])
        flat = np.concatenate([np.zeros(1, np.uint8), codes[kept]])
        starts = places[bounds[:-1] + 1]
        sizes = places[bounds[1:] + 1] - starts + 1
        seen = np.concatenate([np.zeros(1, np.int32), np.cumsum(found, dtype=np.int32)])
        return flat, starts, sizes, seen[bounds[1:]] - seen[bounds[:-1]]

    def _walk(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, edges: bool = False):
        """Pieces by row and language; with ``edges`` those in the row's first STRETCH symbols, and where pieces begin in its first and last OVERLAP symbols."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, n = starts[order], sizes[order], len(starts)
        state = np.repeat(self.roots[:, None], n, axis=1)
        count = np.zeros(state.shape, np.int32)
        zones = np.zeros((2, len(self.roots), n, OVERLAP), bool) if edges else None
        live = n - np.searchsorted(sizes[::-1], np.arange(sizes[0] if n else 0), side="right")
        for j, m in enumerate(live.tolist()):
            to = self.table.take(state[:, :m] + flat[starts[:m] + j])
            begins = to & 1
            if not edges or j < STRETCH:
                count[:, :m] += begins
            state[:, :m] = to >> 1
            if edges and j < OVERLAP:
                zones[0, :, :m, j] = begins
            elif edges and j >= STRETCH:
                zones[1, :, :m, j - STRETCH] = begins
        back = np.argsort(order, kind="stable")
        return (count[:, back].T, zones[:, :, back]) if edges else count[:, back].T

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its pieces by language."""
        flat, starts, sizes, letters = self.symbols(texts)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not self.names:
            return letters, out
        long = np.flatnonzero(sizes > STRETCH + OVERLAP)
        plain = np.flatnonzero((sizes <= STRETCH + OVERLAP) & (letters > 0))
        plain = plain[np.argsort(-sizes[plain], kind="stable")]
        step = max(16, WIDE // len(self.names))
        for at in range(0, len(plain), step):
            some = plain[at : at + step]
            out[some] = self._walk(flat, starts[some], sizes[some])
        if len(long):
            out[long] = self._long(flat, starts[long], sizes[long])
        return letters, out

    def _long(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of long texts in each language, as one parse from the begin of each counts them.

        Each stretch is parsed as if the text began there.  Where a parse that runs on over
        the end of its stretch begins a piece at the same symbol as the parse of the next,
        both go on alike, so the counts are joined there.  A text with a stretch without
        such a symbol in the overlap is parsed in one go.
        """
        total = np.zeros((len(sizes), len(self.names)), np.int64)
        many = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), many)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
        apart = np.zeros(len(sizes), bool)
        step = max(16, WIDE // len(self.names))
        for at in range(0, len(owner), step - 1):  # the last row of a group is the first of the next
            own, rows = owner[at : at + step], place[at : at + step]
            count, (heads, tails) = self._walk(flat, starts[own] + rows, np.minimum(sizes[own] - rows, STRETCH + OVERLAP), edges=True)
            fresh = slice(at > 0, None)
            np.add.at(total, own[fresh], count[fresh])
            before, after = tails[:, :-1], heads[:, 1:]
            both, next_ = before & after, own[1:] == own[:-1]
            apart[own[1:][next_ & ~both.any(axis=2).all(axis=0)]] = True
            early = np.arange(OVERLAP)[None, None, :] < both.argmax(axis=2)[:, :, None]
            joined = (before & early).sum(axis=2) - (after & early).sum(axis=2)
            np.add.at(total, own[1:][next_], joined.T[next_])
        for i in np.flatnonzero(apart).tolist():
            total[i] = self._walk(flat, starts[i : i + 1], sizes[i : i + 1])[0]
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, confidence and pieces a letter of the best language."""
        letters, found = self.counts([t or "" for t in texts])
        out = []
        for n, counts in zip(letters.tolist(), found.tolist(), strict=True):
            if not n or not counts:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            ranked = sorted(zip(counts, self.names, strict=True))
            best, second = ranked[0][0], ranked[1][0] if len(ranked) > 1 else math.inf
            out.append((ranked[0][1], 1.0 if math.isinf(second) else second / (best + second), best / n))
        return out


def identify(
    spark: SparkSession,
    docs: DataFrame,
    samples: dict[str, str] | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    keep: bool = False,
) -> DataFrame:
    """Predict the language of every whole text, without a shuffle.

    Returns key, lang_pred, score (0 to 1, the runner-up's share of the pieces of both)
    and rate (pieces a letter), or with ``keep`` all columns of ``docs`` and these.  Texts
    that are null, empty or without a letter get ``und`` and 0; so does every text if no
    row is labelled.  Equal counts go to the first language by name.  Repeated rows each
    give a row; columns of ``docs`` named like the results are replaced.
    """
    small_batches(spark)
    samples = fit(docs, key, text, lang) if samples is None else samples
    shared = spark.sparkContext.broadcast(samples)  # at most ALL_CHARS characters
    ident = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)
    added = {"lang_pred": pa.string(), "score": pa.float64(), "rate": pa.float64()}
    source = docs if keep else docs.select(key, text)
    kept = [f for f in source.schema if f.name not in added and (keep or f.name == key)]

    def run(batches):
        parser = held(("langid", ident), lambda: Parser(shared.value))
        for batch in slices(batches, text, tables=True):
            found = parser.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + list(added))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rate", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(kept + fields))


def accepted(found: DataFrame) -> DataFrame:
    """Rows of ``identify(..., keep=True)`` that are in a known language.

    Null, empty and letterless texts and all rows of an unlabelled table go, as they are
    ``und``; of repeated rows all stay or all go.
    """
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("rate") <= REJECT_RATE))
