"""SentencePiece coding against the library, on the model file and on small files with other settings."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from emberlog.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string"
ODD = [None, "", " ", "  ", " a", "a ", "I'M here <s> don't</s> <0x41> ▁x▁▁ y\tz\r\n\n", "é ﬁ 漢字かな 😀 \x00\x01 1234", "ab" * 20000, " " * 3000 + "x", "the and of " * 300]


def texts(rng, names):
    letters = ["abehtions'1é漢 \n", "  ▁▁ab", "the and of  ", "\t\r\n \x00\x01", "😀é漢字ก🏽a b ", "ABCdef0123 .,"]
    for _ in range(700):
        yield "".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice([1, 2, 5, 20, 60])))
        yield "".join(rng.choice(names).replace("▁", rng.choice(" ▁")) for _ in range(rng.choice([1, 2, 4, 9])))
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(8))
    yield from (" " * n + "x" for n in range(60))


def test_codes_equal_library():
    ours, ref, rng = pieces.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(4)
    assert ours.ordered
    for t in texts(rng, ours.names[259:]):
        ids = list(struct.unpack(f"<{len(ours.encode(t)) // 4}I", ours.encode(t)))
        assert ids == ref.encode(t), t
        assert ours.decode(ids) == ref.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 28705]) for _ in range(rng.randrange(8))]
        assert ours.decode(ids) == ref.decode(ids), ids


def test_pair_tests_equal_plain_merging():
    ours, rng = pieces.Model(PATH), random.Random(5)
    common = [i for i, b in enumerate(ours.born) if b >= 0][:400]
    for _ in range(6000):
        a, b = rng.choice(common), rng.choice(common)
        assert ours.compatible(a, b) == (ours.merge(ours.text[a] + ours.text[b])[0] == [a, b])


def proto(items) -> bytes:
    out = b""
    for number, value in items:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("seed", range(4))
def test_small_models_equal_library(tmp_path, fallback, prefix, seed):
    """Random vocabularies: scores out of order and equal, letters without a piece, joins across spaces."""
    rng = random.Random(seed)
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    names = list(dict.fromkeys(["a", "b", "▁", *("".join(rng.choice("abc▁") for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(25))]))
    entries += [(n, float(-rng.randrange(12)), 1) for n in names]
    spec = [(1, proto([(1, n), (2, s), (3, k)])) for n, s, k in entries]
    spec += [(2, proto([(3, 2), (4, len(entries)), (35, fallback)])), (3, proto([(1, "identity"), (3, prefix), (4, 0)]))]
    path = tmp_path / "m.model"
    path.write_bytes(proto(spec))
    ours, ref = pieces.Model(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for _ in range(1500):
        t = "".join(rng.choice("aabbc z") for _ in range(rng.randrange(1, 14)))
        got = ours.encode(t)
        ids = list(struct.unpack(f"<{len(got) // 4}I", got))
        assert ids == ref.encode(t), t
        assert ours.decode(ids) == ref.decode(ids)


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(proto([(1, proto([(1, "<unk>"), (3, 2)])), (2, proto([(3, 1)]))]))
    with pytest.raises(ValueError):
        pieces.Model(str(path))


def test_digests_and_columns(spark):
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([*((i, t, "clash") for i, t in enumerate(ODD)), (0, "twice", "x"), (None, "no id", None)], DOCS)
    got = pieces.digests(docs, PATH).collect()
    want = []
    for r in docs.collect():
        ids = ref.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    out = pieces.decode(pieces.encode(docs.withColumn("decoded", docs.text), PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in out) == sorted((str(r.doc_id), ref.decode(ref.encode(r.text or ""))) for r in docs.collect())
    assert pieces.digests(docs.limit(0), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],), ([None, 330],)], "ids array<int>"), PATH).count() == 3
