"""The audit of sources against plain counting, and its exact division."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from emberlog.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, count long"


def plain(rows, top):
    """The same by dictionaries: rows of (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = {w for w, n in docs[lang].items() if n >= 3}
        of = {s: {w: count[lang, s][w] for w in kept} for g, s in groups if g == lang}
        whole = {w: sum(c[w] for c in of.values()) for w in kept}

        def share(c, w, v=len(kept)):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)

        mine = of[source]
        for other in of.keys() - {source}:
            out.append((lang, source, "pair", other, sum((share(mine, w) - (q := share(of[other], w))) ** 2 // q for w in kept)))
        for w in kept:
            p, q = share(mine, w), share(whole, w)
            if mine[w] and p > q:
                out.append((lang, source, "term", w, (p - q) ** 2 // q))
    ranked, seen = set(), Counter()
    for r in sorted(out, key=lambda r: (*r[:3], -r[4], r[3].encode())):
        seen[r[:3]] += 1
        if r[2] == "pair" or seen[r[:3]] <= top:
            ranked.add((*r, seen[r[:3]]))
    return ranked


def test_audit_equals_plain_counting(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "é", "Été", "naïve", "漢字", "😀", "x1y", "don't", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 80]))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ß", None])) for _ in range(150)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("once only", "fr", None), ("same same", "it", "lone")] + [rows[0]] * 3
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], DOCS).repartition(3)
    got = divergence.audit(spark, docs, top=5).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in got} == plain(rows, 5) and len(got) == len(plain(rows, 5))


def test_pieces_within_a_task(monkeypatch):
    """What a task counts does not depend on its bounds (Spark's workers do not see patched ones)."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.choice("ab"), " ".join(rng.choice(["Ab", "c", "é", "dd"]) for _ in range(rng.randrange(60)))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])

    def sums():
        out = Counter()
        for b in divergence._counted([batch, batch]):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["count"]
                out[r["lang"], r["source"], r["term"], "d"] += r["docs"]
        return out

    want = sums()
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    monkeypatch.setattr(divergence, "WINDOW_BYTES", 7)
    assert sums() == want and want["x", "a", "é", "n"] > 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert divergence.audit(spark, docs).count() == 0


def test_division_beyond_64_bits():
    rng = random.Random(10)
    for top in (10, 10**9, 10**15):
        count = np.array([rng.randrange(1, top + 1) for _ in range(200)], np.int64)
        whole = count + np.array([rng.randrange(top) for _ in range(200)], np.int64)
        assert divergence.scaled(count, whole, 10**9).tolist() == [10**9 * c // w for c, w in zip(count.tolist(), whole.tolist(), strict=True)]
