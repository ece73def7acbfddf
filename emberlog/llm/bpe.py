"""BPE encoding and decoding by speculation and verification.

A word is cut greedily into the longest vocabulary entries.  A cut is the BPE result
exactly when every entry encodes to itself and no merge of lower rank crosses the
boundary of any two neighbours, so neighbours are tested pair by pair, for all words of
a batch at once, with numpy.  Only words with a failing pair are merged exactly.

The check of a pair runs backward in time.  Merging two entries independently leaves, at
any rank, one symbol at the right end of the left entry and one at the left end of the
right entry.  If these two symbols form a merge whose rank lies in the time both exist,
that merge would have happened and the boundary would be gone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, replaced, slices, small_batches

#: Words that a worker remembers; the older half goes when it is full.
CACHE_WORDS = 160_000
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 64
#: Words of more symbols are merged with a heap.
LONG_WORD = 100
BIG = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE with a word-end mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *specials.values()]) + 1
        self.names = [""] * size
        for name, i in [*self.vocab.items(), *specials.items()]:
            self.names[i] = name
        self.specials = specials
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's engine doesn't count U+001C to U+001F as white space, as "regex" doesn't
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.symbols = byte_symbols()
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            self.rank.setdefault(tuple(pair.split(" ") if isinstance(pair, str) else pair), r)
        self._tables(size)
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.exact_words = self.proposed_words = 0

    def _tables(self, size: int) -> None:
        """Per entry: the rank that makes it and its two halves; merges as sorted keys."""
        v, self.size = self.vocab, size
        self.rank_of: dict[int, int] = {}
        self.made, pair_of = {}, {}
        for (a, b), r in self.rank.items():
            key = v[a] * size + v[b]
            self.rank_of[key], self.made[r], pair_of[r] = r, v[a + b], (v[a], v[b])
        self.keys = np.array(sorted(self.rank_of), np.int64)
        self.ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], np.int64)
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        #: Entries within a word, entries at its end without the mark, and what longer entries begin with.
        self.heads, self.tails, self.prefixes = {}, {}, set()
        for name, i in v.items():
            parts, used = self._merge(self._letters(name))
            if parts != [i]:
                continue  # never comes out of merging, so never proposed
            if used:
                self.born[i], (self.left[i], self.right[i]) = used[-1], pair_of[used[-1]]
            last = bool(self.end) and name.endswith(self.end) and len(name) > len(self.end)
            bare = name[: -len(self.end)] if last else name
            (self.tails if last or not self.end else self.heads)[bare] = i
            if not self.end:
                self.heads[bare] = i
            self.prefixes.update(bare[:k] for k in range(1, len(bare)))

    def _letters(self, name: str) -> list[int]:
        v, end = self.vocab, self.end
        if end and name.endswith(end) and len(name) > len(end):
            return [v[c] for c in name[: -len(end) - 1]] + [v[name[-len(end) - 1] + end]]
        return [v[c] for c in name]

    def _merge(self, parts: list[int]) -> tuple[list[int], list[int]]:
        """Exact merging: the lowest rank first, the leftmost of equals.  Also the ranks used."""
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made, size, used = self.rank_of, self.made, self.size, []
        ranks = [rank.get(a * size + b, BIG) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (r := min(ranks)) < BIG:
            i = ranks.index(r)
            used.append(r)
            parts[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] * size + parts[i], BIG)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] * size + parts[i + 1], BIG)
        return parts, used

    def _merge_long(self, parts: list[int]) -> tuple[list[int], list[int]]:
        """The same with a heap and linked symbols, for words of any length."""
        rank, size, n, used = self.rank_of, self.size, len(parts), []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            used.append(r)
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := rank.get(parts[k] * size + parts[after[k]])) is not None:
                    heapq.heappush(heap, (q, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0], used

    def _propose(self, word: str) -> list[int]:
        """The longest entry that encodes to itself, again and again."""
        heads, ends, more, n = self.heads, self.tails, self.prefixes, len(word)
        out, at = [], 0
        while at < n:
            got, to = None, at + 1
            while to < n:
                piece = word[at:to]
                if piece in heads:
                    got, stop = heads[piece], to
                if piece not in more:
                    break
                to += 1
            else:
                if (piece := word[at:]) in ends:
                    got, stop = ends[piece], n
            if got is None:
                raise ValueError(f"the vocabulary lacks {word[at]!r}")
            out.append(got)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of entries, whether merging their joined letters keeps the boundary."""
        x, y = a.copy(), b.copy()
        ends_x, ends_y = np.full(len(a), BIG), np.full(len(a), BIG)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            key = xs * self.size + ys
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            r = np.where(self.keys[at] == key, self.ranks[at], BIG)
            bx, by = self.born[xs], self.born[ys]
            # of equal ranks the leftmost goes first: before the boundary on the left, after it on the right
            crossed = (r < BIG) & (r > np.maximum(bx, by)) & (r < ends_x[live]) & (r <= ends_y[live])
            good[live[crossed]] = False
            older = bx > by
            step_x, step_y = live[older], live[~older & (by >= 0)]
            ends_x[step_x], x[step_x] = self.born[x[step_x]], self.right[x[step_x]]
            ends_y[step_y], y[step_y] = self.born[y[step_y]], self.left[y[step_y]]
            live = live[~crossed & ((bx >= 0) | (by >= 0))]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Entries of pre-tokenised words, given in byte symbols."""
        out = [self._propose(w) for w in words]
        sizes = np.array([len(x) for x in out])
        flat = np.fromiter((i for x in out for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        self.proposed_words += len(out)
        for i in np.unique(owner[inner[~good]]):
            self.exact_words += 1
            out[i] = self._merge(self._letters(words[i] + self.end))[0]
        return out

    def _words(self, chunk: str) -> list[str | int]:
        """A chunk without white space as words in byte symbols, and ids of special entries."""
        parts = self.special_cut.split(chunk) if self.special_cut and "<|" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            if part.isascii() and part.isprintable():
                low = part.lower()
                out += [low] if low.isalpha() else self.pieces(low)
                continue
            part = unicodedata.normalize("NFC", part)
            low = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += ["".join(map(self.symbols.__getitem__, p.encode())) for p in self.pieces(low)]
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Encode chunks together: one proposal each, one check of all their pairs."""
        new = list(dict.fromkeys(chunks))
        cut, pack = [self._words(c) for c in new], self.packed.__getitem__
        words = list(dict.fromkeys(w for ws in cut for w in ws if isinstance(w, str)))
        ids = {w: b"".join(map(pack, x)) for w, x in zip(words, self.encode_words(words), strict=True)} if words else {}
        return {c: b"".join([pack(w) if isinstance(w, int) else ids[w] for w in ws]) for c, ws in zip(new, cut, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        if len(self.fresh) > CACHE_WORDS // 2:
            self.aged, self.fresh = self.fresh, {}
        fresh, aged = self.fresh, self.aged
        missing = set()
        for cs in cut:
            missing.update(cs)
        for c in list(missing):
            if c in fresh:
                missing.discard(c)
            elif c in aged:
                fresh[c] = aged[c]
                missing.discard(c)
        known = self.learn(missing)
        fresh.update((c, b) for c, b in known.items() if len(c) <= CACHE_CHARS)
        long = {c: b for c, b in known.items() if len(c) > CACHE_CHARS}
        get = fresh.__getitem__ if not long else lambda c: fresh[c] if c in fresh else long[c]
        return [b"".join(map(get, cs)) for cs in cut]

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: entries are joined with spaces, special ones too."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str) -> Codec:
    """One codec a worker and file."""
    return held(("bpe", path), lambda: Codec(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, an array of token ids, to every row; a null or empty text has none.

    Rows stay where they are: no shuffle.  Other columns pass through; a column already
    called ``ids`` is replaced.
    """

    small_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in slices(batches, text, tables=True):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            coded = bpe.encode(texts)
            ends = np.cumsum([0] + [len(b) // 4 for b in coded]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            yield replaced(batch, [], {ids: pa.ListArray.from_arrays(pa.array(ends), flat)})

    schema = T.StructType([f for f in df.schema if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded string, to every row; null ids give an empty string."""

    small_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in slices(batches, ids, tables=True):
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = pa.array([bpe.decode(np.array(r or [], "<u4").tobytes()) for r in rows], pa.string())
            yield replaced(batch, [], {text: out})

    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text and keep only digests of both, in one pass.

    Returns key, n_tokens, ids_sha256 and decoded_sha256.  A null text counts as empty.
    Repeated rows each give a row.
    """

    small_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in slices(batches, text, tables=True):
            coded = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) // 4 for b in coded], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(b).encode()).hexdigest() for b in coded], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    fields = [df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(key, text).mapInArrow(run, T.StructType(fields))
