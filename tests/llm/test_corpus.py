"""Corpus operators against the libraries, brute force and round trips, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import bpe, chat, jaccard, langid, mixing, nndescent, spans, tiff, toxicity, warc
from emberlog.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


ODD_TEXTS = [None, "", " \n", "I'M here, don't <|endoftext|> stop!! ΑΣ İstanbul \x1c\x85 é ﬁ 漢字かな 😀 1234", "ab" * 20000, "the and of " * 300]


def test_bpe_equals_library(spark):
    ref = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice("abehtions'1é漢 \n") for _ in range(rng.choice([3, 40, 900]))) for _ in range(80)]
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_round_trip(spark):
    docs = documents(spark, ODD_TEXTS).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    ref = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.decoded for r in out} == {i: ref.decode(ref.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD_TEXTS)}
    assert bpe.digests(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("codec", list(tiff.CODES))
def test_tiff_codecs(codec):
    rng = random.Random(2)
    for n in (1, 2, 300, 5000, 40000):
        for letters in (1, 2, 30, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert tiff.unpack(codec, tiff.pack(codec, data), n)[:n] == data


def test_tiff_pages_and_digests(spark):
    texts = [*ODD_TEXTS, "x" * 576, "y" * 577]
    stored = tiff.encode_text(documents(spark, texts))
    got = {r.doc_id: r for r in tiff.digests(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-32:])
    pages = tiff.decode_pages(stored.union(spark.createDataFrame([(99, 0, bytearray(b"junk"))], stored.schema))).collect()
    whole = defaultdict(bytes)
    for r in sorted(pages, key=lambda r: (r.doc_id, r.page or 0)):
        whole[r.doc_id] += bytes(r.pixels or b"")
    assert hashlib.sha256(whole[4]).hexdigest() == got[4].payload_sha256
    assert [r.error for r in pages if r.doc_id == 99] == ["not a TIFF file"]


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, many=250):
    rng = random.Random(seed)
    bases = [words(rng, rng.choice([5, 9, 60, 160]), 5000) for _ in range(25)]
    texts = [None, "", "  ", "One two", "one TWO", "one two three"]
    passage = " ".join(words(rng, 40, 5000))
    for _ in range(many):
        w = list(rng.choice(bases if rng.random() < 0.5 else bases[:2]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(w) + (" " + passage if rng.random() < 0.1 else ""))
    return texts


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_equals_brute_force(spark, seed):
    docs = documents(spark, near_copies(seed)).withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark, docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    kept = jaccard.keep_first(docs, jaccard.link(spark, docs))
    assert kept.count() == len({c for _, c in got.values()})


def test_jaccard_null_and_repeated_ids(spark):
    rng = random.Random(14)
    a, b, c, d, e, f = (words(rng, 60, 10**6) for _ in range(6))
    near = lambda w: " ".join([*w[:-1], "end"])
    a_, b_, c_, d_, e_, f_ = (" ".join(w) for w in (a, b, c, d, e, f))
    # near copies with null ids alone; clean null ids; one id with texts of three kinds, one of them twice; a near copy of the larger kind
    rows = [(None, a_), (None, near(a)), (None, b_), (None, c_), (None, None), (None, ""), (7, d_), (7, e_), (7, f_), (7, f_), (7, None), (7, None), (9, near(e)), (10, near(d).upper()), (None, near(f))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = jaccard.link(spark, docs).collect()
    assert len(linked) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in linked if r.doc_id in (9, 10)) == [(9, 7), (10, 7)]
    assert len({r.first_code for r in linked if r.n_shingles}) == 6
    assert sorted(str(r.component_id) for r in linked if r.doc_id is None) == sorted(["None"] * 6 + ["7"])
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_first(docs, jaccard.link(spark, docs)).collect()), key=str)
    assert len(got) == 10 and len([r for r in got if r[0] is None and r[1] in (a_, near(a))]) == 1
    assert sorted([r for r in got if r[1] not in (a_, near(a))], key=str) == sorted([(None, b_), (None, c_), (None, None), (None, ""), (7, d_), (7, e_), (7, f_), (7, None), (7, None)], key=str)


def test_jaccard_empty(spark):
    assert jaccard.link(spark, documents(spark, [])).count() == 0


def test_tree_join_loses_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 4, (12, 256))
    points = np.maximum(0, base[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, 256)) * (rng.random((300, 256)) < 0.1)).astype(np.int32)
    sizes, marks = points.sum(axis=1), rng.integers(0, 40, 300)
    tree = jaccard.Tree(points, sizes, marks)
    got = {(min(a, b), max(a, b)) for p, q in jaccard.tree_join(tree, tree, 75, True) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if marks[i] != marks[j] and 175 * np.minimum(points[i], points[j]).sum() >= 75 * (sizes[i] + sizes[j]) and 100 * sizes[i] >= 75 * sizes[j] and 100 * sizes[j] >= 75 * sizes[i]}
    assert got == want


def toxic_corpus(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(words(rng, 6)) + "." for _ in range(rng.randrange(1, 9))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(['grumpel', 'snorfid', 'blatt'])}{rng.choice(['', 's', 'ish'])} " + sentences[at]
        rows.append((i, " ".join(sentences), "en", "s", 1))
        labels.append((i, 1, toxic))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (n, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(spark):
    docs, labels = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.score(spark, docs, toxicity.fit(spark, docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.filter("toxic is not null and doc_id is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[600].score == 0.0 and got[601].predicted == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = [(toxicity.sentences(texts[r.doc_id])[o.sentence]) for r in got.values() for o in r.offending]
    assert sum("you" in s.split() for s in bad) / len(bad) > 0.95


def test_toxicity_without_labels(spark):
    docs, _ = toxic_corpus(spark, 5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(spark, docs, toxicity.fit(spark, docs, none)).collect()} == {0}


def test_spans(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(words(rng, n, 10**6)).capitalize() + ". "
    passage = "".join(say(12) for _ in range(6))
    texts = [say(9) + passage + say(9), say(9) * 1 + "tail of a line, " + passage + say(9), say(30), None, "", "Hi. Hi. Hi.", passage + say(15) + passage, say(8) + say(8)]
    docs = documents(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: r for r in spans.dedup(spark, docs).collect()}
    for i in (0, 2, 3, 4, 5, 7):
        assert got[i].text == texts[i] and got[i].n_removed == 0
    assert passage[80:] not in got[1].text and got[1].text.endswith(texts[1][-30:]) and got[1].n_removed == 5
    assert got[6].n_removed == 12 and len(got[6].text.split()) == 15
    # against a plain scan in order of ids
    seen = set()
    for i, t in enumerate(texts):
        pieces = spans.sentences(t or "")
        gone, mine = set(), set()
        for a, b in spans.runs(pieces):
            k = tuple(" ".join(p.lower().split()) for p in pieces[a:b])
            if k in seen or k in mine:
                gone.update(range(a, b))
            mine.add(k)
        seen |= mine
        assert got[i].text == ("".join(p for j, p in enumerate(pieces) if j not in gone) if gone else t)
    assert spans.dedup(spark, documents(spark, [])).count() == 0


def test_spans_of_short_sentences(spark):
    passage = "Eashly berr. Thhesh on inthou hehaor. Ndst. Edan the. "
    unspaced = "今日は天気がとても良いです。明日は雨が降ると聞きました。"
    texts = [f"First of all this. {passage}And the end.", f"Another start here now, {passage}One more end.", f"起{unspaced}", f"別の文が前にあります。{unspaced}終わり。", "Hi. No.", "Hi. No. Yes we can.", "One line of five words. And now a second one of it.", "One line of five words. And now a second one of it."]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.dedup(spark, documents(spark, texts)).collect()}
    assert got[1] == ("Another start here now, Eashly berr. One more end.", 3)
    # the first sentence is glued to another, and one sentence is no run
    assert got[3] == (texts[3], 0)
    assert got[7] == ("", 2)
    assert all(got[i] == (texts[i], 0) for i in (0, 2, 4, 5, 6))
    both = [f"別の文が前にあります。{unspaced}", f"{unspaced}終わり。"]
    assert [r.text for r in spans.dedup(spark, documents(spark, both)).orderBy("doc_id").collect()] == [both[0], "終わり。"]
    assert spans.size("a bc 漢字 漢字かな x漢字 é".split()) == 8


def test_warc(spark, tmp_path):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>" + "z" * 30000, "<p>a</p>"])] + [(None, None, "<p>a</p>"), (9, None, "q"), (9, None, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write(Scratch(spark, "t"), df)
    got = sorted(((r.page_id if r.page_id is not None else -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(archives).collect())
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        last = max((q for q, _, g in pages if q is not None and (g or "") == (h or "")), default=None)
        revisit = p is not None and p < last
        want.append((p if p is not None else -1, "revisit" if revisit else "response", last if revisit else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert got == sorted(want)
    warc.export(archives, str(tmp_path))
    assert warc.scan_files(spark, str(tmp_path)).count() == len(pages)
    content = archives.first().content
    assert content[:4] == bytes.fromhex("5d2a4d18")
    # only larger payloads are shared when a least size is given
    kinds = {r.page_id: r.record_type for r in warc.round_trip(spark, df, least=100).collect()}
    assert set(kinds.values()) == {"response"}


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60))), "en", rng.choice(["a"] * 8 + ["b", "c", "é", None]), 0) for i in range(3000)] + [(5000, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    assert all(r.size == len((rows[r.doc_id][1] if r.doc_id < 3000 else "").split()) for r in got)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, want, open_ = sum(size.values()), {}, set(order)
    while open_:  # share, stop at three times, share the excess again
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= 60
    assert mixing.mix(spark, documents(spark, [])).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((1500, 16)).astype(np.float32)
    m[200:320] = m[7]  # copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] + [0.0] * 14), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = defaultdict(list)
    for r in nndescent.search(spark, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = m.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    queries = list(range(0, 1500, 50))
    assert sorted(got) == queries
    for q in queries:
        s = np.round(d @ d[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5].tolist()
        hits += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(d[v] @ d[q] - score) < 1e-12 for v, score in got[q])
    assert hits >= 0.95 * 5 * len(queries)
    few = nndescent.search(spark, df.filter("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert nndescent.search(spark, df.limit(0)).count() == 0


def test_neighbours_search_goes_on(spark, monkeypatch):
    # hops of two nodes: a beam of 18 takes 9 hops at least
    monkeypatch.setattr(nndescent, "LOOKS", 2)
    monkeypatch.setattr(nndescent, "BEAM", 18)
    kept = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: kept.append((name, save(self, df, name))) or kept[-1][1])
    m = np.random.default_rng(15).standard_normal((120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    assert nndescent.search(spark, df).count() == 15
    last = [d for name, d in kept if name.startswith("beam-")][-1]
    assert {b["seen"] for r in last.collect() for b in r.beam} == {True}
    assert nndescent.grown(160, 1000) == nndescent.grown(160, 50_000) == 160 < nndescent.grown(160, 10**6)


def test_language(spark):
    rng = random.Random(10)
    parts = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ver", "tz", "ung"], "cc": ["eau", "oi", "ent", "que"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang if i % 7 else None, "s", 1, lang))
    rows += [(900, None, "aa", None, None, None), (901, "123 !!", "aa", None, 3, None), (902, "", None, None, 0, None)]
    docs = spark.createDataFrame(rows, DOCS + ", truth string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    tested = [got[r[0]].lang_pred == r[5] for r in rows if r[5] and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(tested) / len(tested) > 0.97
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(langid.identify(spark, docs, keep=True))
    assert kept.count() == 300
    assert {r.lang_pred for r in langid.identify(spark, docs, samples={}).collect()} == {"und"}


def least_pieces(sample, text):
    """Longest matches from the left, by plain search of the sample."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while text[i:j] in sample and j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parse_equals_plain_search(monkeypatch):
    samples = {"a": "abracadabra, alakazam! " * 3, "b": "the quick brown fox jumps over 7 lazy dogs é", "c": "漢字かな 交じり文"}
    parser = langid.Parser(samples)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abrckdlzm  xthequ,漢字é²") for _ in range(rng.choice([1, 4, 30, 400, 9000]))) for _ in range(60)]

    def plain(t):
        words_ = re.findall(r"[^\W\d_²]+", t.lower())
        codes = {c: chr(int(parser.codes[ord(c)]) + 1000) for w in words_ for c in w}
        return " " + "".join("".join(map(codes.get, w)) + " " for w in words_)

    letters, got = parser.counts(texts)
    for t, n, row in zip(texts, letters.tolist(), got.tolist(), strict=True):
        assert n == len(plain(t)) - plain(t).count(" ")
        if n:
            assert row == [least_pieces(plain(s), plain(t)) for s in samples.values()]
    best = [min(zip(row, samples, strict=True))[1] for row in got.tolist()]
    assert [p[0] for p in parser.predict(texts)] == [b if n else "und" for b, n in zip(best, letters.tolist(), strict=True)]
    # stretches that never meet again are parsed in one go, with the same result
    monkeypatch.setattr(langid, "OVERLAP", 1)
    assert (parser.counts(texts)[1] == got).all()
    assert [p[0] for p in parser.predict(["² ½ Ⅷ ①", "", None])] == ["und"] * 3


def test_chat(spark):
    convs = {0: [("system", "s"), ("user", "q"), ("assistant", "good")], 1: [("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", None)], 2: [("user", "a")], 3: [("user", "a")], 4: [("user", "alone")]}
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sides = [chat.turns(df.filter(F.pmod("conv_id", F.lit(2)) == k), F.floor(F.col("conv_id") / 2)) for k in (0, 1)]
    got = {r.pair_id: r for r in chat.preferences(*sides).collect()}
    assert set(got) == {0, 1}
    p = got[0]
    assert p.n_prompt_turns == 2 and p.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert [p.chosen[m["from"] : m["to"]] for m in p.chosen_mask] == ["good<|im_end|>\n"]
    assert [p.rejected[m["from"] : m["to"]] for m in p.rejected_mask] == ["bad<|im_end|>\n"]
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (1, "", "", [])


def test_pipeline_stages_keep_columns_and_decisions(spark):
    import corpus_pipeline

    rng = random.Random(12)
    parts = ["ka", "to", "mi", "re", "schu", "ver"]
    say = lambda n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n)).capitalize() + ". "
    passage = "".join(say(13) for _ in range(5))
    texts = ["".join(say(10) for _ in range(8)) for _ in range(40)]
    texts += [texts[0], texts[1].replace(".", "!", 1), "12 34", None, texts[2] + passage, passage + texts[3] * 1]
    docs = documents(spark, texts)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        if k == 0:
            assert {r.doc_id for r in rows} == set(range(46)) - {42, 43}
        if k == 1:
            assert not {40, 41} & {r.doc_id for r in rows} and 0 in {r.doc_id for r in rows}
        if k == 2:
            both = [r for r in rows if passage[90:] in r.text]
            assert len(both) <= 1
        docs = spark.createDataFrame(rows, docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(final) == docs.count() and all(len(r.ids_sha256) == 64 for r in final)


def test_neighbours_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nndescent.search(spark, df).collect())
    assert got == [(0, 1, 1), (50, 1, 3)]


def test_mixing_goes_on_behind_a_row_that_does_not_fit(spark):
    """Few rows, some much longer than others: every source still comes within its shortest untaken row of its target."""
    rng = random.Random(12)
    texts = [" ".join(["w"] * rng.choice([1, 3, 9, 40, 2500])) for _ in range(90)] + [None, "", " "]
    docs = documents(spark, texts)
    got = mixing.mix(spark, docs).collect()
    by = defaultdict(list)
    for r in got:
        by[f"s{r.doc_id % 3}"].append(r)
    for rows in by.values():
        taken, target = sum(r.taken for r in rows), rows[0].target
        loose = [r.size for r in rows if r.size and r.copies <= target / r.source_size and r.copies < 3]
        assert abs(taken - target) <= max(1, min(loose, default=target) / 2), (taken, target)
    assert {(r.doc_id, r.taken) for r in mixing.mix(spark, docs.repartition(7)).collect()} == {(r.doc_id, r.taken) for r in got}


def test_mixing_by_importance(spark):
    rows = [(i, "w " * 10, "en", "a", 0, 1.0 + 20.0 * (i % 10 == 0)) for i in range(2000)] + [(5000 + i, "w " * 10, "en", "b", 0, None) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOCS + ", odds double")
    got = mixing.mix(spark, docs, importance="odds").collect()
    for ids, least in ((range(2000), 0), (range(5000, 6000), 5000)):
        part = [r for r in got if least <= r.doc_id < least + 5000]
        assert len(part) == len(ids)
        assert abs(sum(r.taken for r in part) - part[0].target) <= 10
    first = [r for r in got if r.doc_id < 2000]
    assert all(r.taken <= 30 for r in got)
    heavy, light = ([r.copies for r in first if (r.doc_id % 10 == 0) is k] for k in (True, False))
    assert set(heavy) == {3} and 0 < sum(light) / len(light) < 1
    again = mixing.mix(spark, docs.repartition(3), importance="odds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_row_and_null_ids(spark):
    docs = spark.createDataFrame([(None, f"t{i} x", "en", "s", 0, i) for i in range(300)], DOCS + ", row long")
    got = mixing.mix(spark, docs, row="row").collect()
    assert sorted(r.row for r in got) == list(range(300)) and all(r.taken == 2 for r in got)


def tiff_file(order, pages):
    """A file by hand: pages as lists of (tag, type, values) with cells of raw bytes for strips (273) or tiles (324)."""
    import struct

    out, link = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), 4
    for fields, cells in pages:
        where = []
        for c in cells:
            where.append(len(out))
            out += c
        tiled = any(t == 322 for t, _, _ in fields)
        fields = [*fields, (324 if tiled else 273, 4, where), (325 if tiled else 279, 4, [len(c) for c in cells])]
        body = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + body
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_reads_files_of_others(spark, order):
    rng = np.random.default_rng(16)
    grey = rng.integers(0, 65536, (5, 7)).astype(np.uint16)
    moved = np.diff(grey, axis=1, prepend=np.uint16(0)).astype(f"{order}u2")
    sixteen = ([(256, 3, [7]), (257, 3, [5]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (278, 3, [2]), (317, 3, [2])], [zlib.compress(moved[y : y + 2].tobytes()) for y in range(0, 5, 2)])
    colour = rng.integers(0, 256, (20, 33, 3)).astype(np.uint8)
    planar = ([(256, 3, [33]), (257, 3, [20]), (258, 3, [8, 8, 8]), (259, 3, [32773]), (277, 3, [3]), (284, 3, [2]), (278, 3, [20])], [tiff.pack_packbits(colour[:, :, k].tobytes()) for k in range(3)])
    padded = np.zeros((32, 48, 3), np.uint8)
    padded[:20, :33] = colour
    tiles = ([(256, 3, [33]), (257, 3, [20]), (258, 3, [8, 8, 8]), (259, 3, [5]), (277, 3, [3]), (322, 3, [16]), (323, 3, [16])], [tiff.pack_lzw(padded[y : y + 16, x : x + 16].tobytes()) for y in (0, 16) for x in (0, 16, 32)])
    media = tiff_file(order, [sixteen, planar, tiles])
    huge = tiff_file(order, [([(256, 4, [60000]), (257, 4, [60000]), (258, 3, [8]), (259, 3, [1])], [b"x"])])
    df = spark.createDataFrame([(1, bytearray(media), "clash"), (2, None, "a"), (3, bytearray(huge), "b"), (4, bytearray(media[:40]), "c")], "doc_id long, media binary, page string")
    got = sorted(tiff.decode_pages(df).collect(), key=lambda r: (r.doc_id, r.page or 0))
    assert [(r.doc_id, r.page) for r in got] == [(1, 0), (1, 1), (1, 2), (3, None), (4, None)]
    assert bytes(got[0].pixels) == grey.astype("<u2").tobytes() and got[0].bits == 16
    assert bytes(got[1].pixels) == bytes(got[2].pixels) == colour.tobytes() and got[2].tiled
    assert "cannot hold" in got[3].error and got[4].error


def test_tiff_of_a_text_in_tiles(spark):
    text = "".join(random.Random(17).choice("abcde \n") for _ in range(576 * 4100))
    stored = tiff.encode_text(documents(spark, [text, "short"]))
    assert [r.tiled for r in sorted(tiff.decode_pages(stored.filter("doc_id = 0")).collect(), key=lambda r: r.page)] == [True, False, False]
    got = {r.doc_id: r for r in tiff.digests(stored).collect()}
    assert got[0].payload_sha256 == hashlib.sha256(text.encode()).hexdigest()
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    found = np.flatnonzero(counts)
    assert got[0].feature == f"pages=576x4096d,576x3d,576x1p;sum={(counts * np.arange(256)).sum()};min={found[0]};max={found[-1]};distinct={len(found)}"
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert all(got[i].media_sha256 == hashlib.sha256(m).hexdigest() and got[i].media_bytes == len(m) for i, m in media.items())
    assert tiff.digests(tiff.encode_text(documents(spark, []))).count() == 0


def test_chat_marks_and_large_ids(spark):
    big = (1 << 60) + 4
    rows = [(big, 0, "user", "a<|im_end|>b"), (big, 1, "assistant", "yes"), (big + 1, 0, "user", "a<|im_end|>b"), (big + 1, 1, "assistant", "no"), (big + 2, 0, "user", "x"), (big + 3, 0, "user", "y"), (-2, 0, "user", "m"), (-1, 0, "user", "n"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sides = [chat.turns(df.filter(F.col("conv_id").bitwiseAND(1) == k), F.shiftright("conv_id", 1)) for k in (0, 1)]
    got = {r.pair_id: r for r in chat.preferences(*sides).collect()}
    assert set(got) == {big // 2, big // 2 + 1, -1}
    assert got[big // 2].prompt == "<|im_start|>user\na<\\|im_end|>b<|im_end|>\n"
    assert got[big // 2].chosen == "<|im_start|>assistant\nyes<|im_end|>\n"


def test_spans_rows_of_one_id_and_null_ids(spark):
    rng = random.Random(18)
    say = lambda n: " ".join(words(rng, n, 10**6)).capitalize() + ". "
    p, q, other = ("".join(say(12) for _ in range(3)) for _ in range(3))
    x = say(9)
    rows = [(1, p), (2, x + p), (2, other), (None, q + x), (None, q), (2, other), ((1 << 63) - 1, q)]
    got = spans.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, p), (2, x), (2, other), (2, ""), (None, x), (None, ""), ((1 << 63) - 1, q)], key=str)


def test_pipeline_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    parts = ["ka", "to", "mi", "re", "schu", "ver"]
    say = lambda n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n)).capitalize() + ". "
    passage = "".join(say(13) for _ in range(5))
    rows = [(i, "".join(say(10) for _ in range(8)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(60, rows[0][1], "en", "s0", 0), (None, rows[1][1] + passage, None, None, None), (None, passage + say(20), "en", "s1", 0), (7, say(40), "en", "s1", 0), (61, None, "en", "s1", 0), (62, "1 2 3", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {60, 61, 62} and all(r.n_tokens > 0 for r in out)
    ref = Tokenizer.from_file(PATH)
    known = {hashlib.sha256(np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for _, t, *_ in rows if t}
    assert {r.ids_sha256 for r in out if r.doc_id in range(1, 60) and r.doc_id != 7} <= known
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_target_mix_of_repeated_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(5, f"a{i} b", "en", "s", 4) for i in range(40)] + [(None, None, None, None, None)], DOCS)
    out = corpus_pipeline.target_mix(spark, docs, "").collect()
    assert len(out) == 40 and len({r.text for r in out}) == 40
