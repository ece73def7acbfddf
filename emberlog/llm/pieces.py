"""SentencePiece BPE encoding and decoding by a table of the last token of every prefix.

Joined by merging, a text's tokens are right exactly when each two neighbours are: no
merge of theirs crosses the boundary between them.  So the tokens of a prefix without its
last one are the tokens of that shorter prefix, and each prefix has one last token: the
only piece that ends there and is compatible with the last token of the prefix before it.
An automaton gives the pieces that end at each position; the table of last tokens is
filled from left to right and the ids are read off backwards.

Two pieces are compatible if merging their letters together leaves the boundary.  Merged
alone, the left piece has at any rank one symbol at its right end and the right piece one
at its left end; walking both back in time finds the ranks at which two such symbols meet.
A merge of theirs inside that time would have crossed.  Pieces of one score (runs of
spaces have that) merge from the left, so the left piece is finished with a rank before
its symbols meet the right piece's at that rank.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, replaced, slices, small_batches

#: Chunks that a worker remembers; the older half goes when it is full.
CACHE_CHUNKS = 400_000
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 64
#: Pairs of pieces whose test a worker remembers before it starts anew.
CACHE_PAIRS = 600_000
BIG = 1 << 30
SPACE = "▁"
# Fixed values of the file format: kinds of pieces, and field numbers of the messages.
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SUFFIX_SPACE, UNKNOWN_SURFACE = 3, 35, 24, 44
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1:
                at += 8
            case 2:
                size = varint()
                yield key >> 3, data[at : at + size]
                at += size
            case 5:
                yield key >> 3, struct.unpack_from("<f", data, at)[0]
                at += 4
            case wire:
                raise ValueError(f"not a model file: wire type {wire}")


class Model:
    """Encoder and decoder of one model file of merge type.

    Handles what such files use: identity normalisation, an optional leading space, spaces
    as marks, byte fallback or an unknown piece.  Other normalisers, other model types and
    pieces of a user's own are refused with an error.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = list(fields(f.read()))
        rows = [dict(fields(v)) for k, v in spec if k == PIECES]
        trainer = dict(fields(next((v for k, v in spec if k == TRAINER), b"")))
        normal = dict(fields(next((v for k, v in spec if k == NORMALIZER), b"")))
        if trainer.get(MODEL_TYPE, 1) != 2 or normal.get(CHARSMAP) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE_SPACES, 1) or trainer.get(SUFFIX_SPACE):
            raise ValueError("only merge-type models with identity normalisation are handled")
        self.names = [r[PIECE].decode() for r in rows]
        self.kinds = [r.get(KIND, NORMAL) for r in rows]
        if OWN in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not handled")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_surface = trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 ")
        self.byte_ids = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE} if trainer.get(BYTE_FALLBACK) else {}
        vocab = {self.names[i]: i for i, k in enumerate(self.kinds) if k == NORMAL}
        #: Letters without a piece of their own have numbers beyond the vocabulary while merging.
        self.letters = {c: vocab[c] for c in vocab if len(c) == 1}
        self.loose = sorted({c for name in vocab for c in name} - set(self.letters))
        self.size = len(self.names) + len(self.loose)
        self.letters |= {c: len(self.names) + k for k, c in enumerate(self.loose)}
        order = {s: r for r, s in enumerate(sorted({-rows[i].get(SCORE, 0.0) for i in vocab.values()}))}
        self._splits(vocab, {name: order[-rows[i].get(SCORE, 0.0)] for name, i in vocab.items()})
        self._surfaces()
        self.parting = next(c for c in map(chr, range(0x110000)) if c not in self.letters)
        # pieces with a space after another letter would join what is cut apart here
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in vocab)
        lone = "".join(c for c in "\n\t\r" if c not in self.letters)
        self.chunks = re.compile(f"[{lone}]+|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if cut and lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cut else r"(?s:.+)").findall
        self.pairs: dict[int, bool] = {}
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _splits(self, vocab: dict[str, int], rank: dict[str, int]) -> None:
        """Of each piece that merges to itself: the rank that makes it and its two halves."""
        self.text = dict(enumerate(self.names)) | {i: c for c, i in self.letters.items()}
        self.sizes = [len(self.text[i]) for i in range(self.size)]
        self.merges = {name: (rank[name], i) for name, i in vocab.items() if len(name) > 1}
        n = self.size
        self.born, self.left, self.right = [-1] * n, list(range(n)), list(range(n))
        self.joined: dict[int, int] = {}
        self.finder, self.ordered = ahocorasick.Automaton(), True
        for c, i in self.letters.items():
            self.finder.add_word(c, (i, 1))
        for name, (r, i) in sorted(self.merges.items(), key=lambda x: len(x[0])):
            parts, last = self.merge(name)
            if parts != [i]:
                continue  # never comes out of merging
            self.born[i], (self.left[i], self.right[i]) = r, last
            self.joined[last[0] * n + last[1]] = r
            self.ordered &= r >= max(self.born[last[0]], self.born[last[1]])
            self.finder.add_word(name, (i, len(name)))
        self.finder.make_automaton()

    def merge(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Plain merging of a text of known letters, best score first, leftmost of equals; also the last pair."""
        parts: list[int] = [self.letters[c] for c in text]
        n, last = len(parts), (-1, -1)
        starts, after, before = list(range(n)) + [n], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            end = starts[after[j]] if after[j] < n else n
            if found := self.merges.get(text[i:end]):
                heapq.heappush(heap, (found[0], i, end, found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, end, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or (after[j] if after[j] < n else n) != end:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p >= 0], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the letters of two pieces together leaves the boundary between them."""
        if not self.ordered:  # a merge may come before those that make its parts: merge them
            return self.merge(self.text[a] + self.text[b])[0] == [a, b]
        born, joined, n = self.born, self.joined, self.size
        ends_a = ends_b = BIG
        while True:
            r = joined.get(a * n + b)
            if r is not None and max(born[a], born[b]) <= r < ends_a and r <= ends_b:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[b] >= born[a]:  # of one rank, the left piece's merge came first
                ends_b, b = born[b], self.left[b]
            else:
                ends_a, a = born[a], self.right[a]

    def _last(self, text: str) -> list[int]:
        """The table: of every prefix the last token, -1 where it ends with a letter that no piece has."""
        pairs, n = self.pairs, self.size
        known = pairs.get
        last = [-1] * (len(text) + 1)
        to = 0
        for end, (piece, size) in self.finder.iter(text):
            if end < to:
                continue  # its last token is found
            if (before := last[end + 1 - size]) >= 0:
                ok = known(before * n + piece)
                if ok is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    ok = pairs[before * n + piece] = self.compatible(before, piece)
                if not ok:
                    continue
            to = end + 1
            last[to] = piece
        return last

    def _spelled(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, by one table for all of them: a letter that no piece has parts one from the next."""
        sizes, size, text = self.sizes, len(self.names), self.parting.join(chunks)
        last = self._last(text)
        out, end = [], len(text)
        for chunk in reversed(chunks):
            at, start, ids = end, end - len(chunk), array("I")
            while at > start:
                piece = last[at]
                if 0 <= piece < size:
                    ids.append(piece)
                    at -= sizes[piece]
                else:
                    at -= 1
                    ids.extend(reversed(self._spelled(text[at])))
            ids.reverse()
            out.append(ids.tobytes())
            end = start - 1
        return out[::-1]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new chunks are learnt together."""
        first = SPACE if self.prefix else ""
        cut = [self.chunks(first + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.fresh) > CACHE_CHUNKS // 2:
            self.aged, self.fresh = self.fresh, {}
        fresh, aged = self.fresh, self.aged
        new = set().union(*cut).difference(fresh)
        for chunk in new.intersection(aged):
            fresh[chunk] = aged[chunk]
        unseen = list(new.difference(aged))
        fresh.update(zip(unseen, self.learn(unseen), strict=True))
        found = [b"".join(map(fresh.__getitem__, chunks)) for chunks in cut]
        for chunk in unseen:
            if len(chunk) > CACHE_CHARS:
                del fresh[chunk]
        return found if self.byte_ids else list(map(self._squeezed, found))

    def _squeezed(self, ids: bytes) -> bytes:
        """Unknown letters in a row are one token."""
        a = np.frombuffer(ids, "<u4")
        return a[np.append(True, (a[1:] != self.unknown) | (a[:-1] != self.unknown))[: len(a)]].tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _surfaces(self) -> None:
        shown = {NORMAL: lambda s: s.replace(SPACE, " ").encode(), UNKNOWN: lambda s: self.unknown_surface, CONTROL: lambda s: b"", BYTE: lambda s: bytes([int(s[3:5], 16)])}
        self.shown = [shown[k](s) for s, k in zip(self.names, self.kinds, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first piece loses its leading space, bytes that form no letter become U+FFFD each."""
        kinds, parts = self.kinds, list(map(self.shown.__getitem__, ids))
        if self.prefix:
            k = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), None)
            if k is not None and kinds[ids[k]] == NORMAL:
                parts[k] = parts[k].removeprefix(b" ")
        raw = b"".join(parts)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out += [raw[at : at + e.start].decode(), "�"]
                    at += e.start + 1
            return "".join(out)


def model(path: str) -> Model:
    """One model a worker and file."""
    return held(("pieces", path), lambda: Model(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, an array of token ids, to every row; a null or empty text has none.

    Rows stay where they are: no shuffle.  Other columns pass through; a column already
    called ``ids`` is replaced; repeated rows are coded each; an empty table stays empty.
    """
    small_batches(df.sparkSession)

    def run(batches):
        coder = model(path)
        for batch in slices(batches, text, tables=True):
            coded = coder.encode_all([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            ends = np.cumsum([0] + [len(b) // 4 for b in coded]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            yield replaced(batch, [], {ids: pa.ListArray.from_arrays(pa.array(ends), flat)})

    schema = T.StructType([f for f in df.schema if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded string, to every row; null ids give an empty string, null entries nothing.

    A column already called ``text`` is replaced; repeated rows are decoded each.
    """
    small_batches(df.sparkSession)

    def run(batches):
        coder = model(path)
        for batch in slices(batches, ids, tables=True):
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = pa.array([coder.decode([i for i in r or [] if i is not None]) for r in rows], pa.string())
            yield replaced(batch, [], {text: out})

    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text and keep only digests of both, in one pass.

    Returns key, n_tokens, ids_sha256 (of decimal ids joined by commas) and
    decoded_sha256.  A null text counts as empty; a null key stays null; repeated rows
    each give a row; an empty table gives none; other columns are left out.
    """
    small_batches(df.sparkSession)

    def run(batches):
        coder = model(path)
        decimal = list(map(str, range(len(coder.names))))
        for batch in slices(batches, text, tables=True):
            count, ids_sum, text_sum = [], [], []
            for coded in coder.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(coded, "<u4").tolist()
                count.append(len(ids))
                ids_sum.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sum.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = [df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(key, text).mapInArrow(run, T.StructType(out))
