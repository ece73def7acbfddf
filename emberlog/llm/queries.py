"""The numbered queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, jaccard, langid, mixing, nndescent, pieces, spans, tiff, toxicity, warc, whitening
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.encode_text(table(spark, sf_dir, "documents")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(spark, docs, toxicity.fit(spark, docs, labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(spark, table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(spark, docs)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k are chosen over conversations 2k + 1.

    Rows of a null conversation and conversations without a counterpart give nothing;
    repeated rows are turns of their own; an empty table gives no pairs.
    """
    rows = table(spark, sf_dir, "conversations")
    pair = F.shiftright("conv_id", 1)
    sides = [chat.turns(rows.filter(F.col("conv_id").bitwiseAND(1) == k), pair) for k in (0, 1)]
    found = chat.preferences(*sides)
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", chat.spans_text(F.col("chosen_mask")).alias("chosen_mask"), chat.spans_text(F.col("rejected_mask")).alias("rejected_mask"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_tiff": op2_tiff,
    "op3_jaccard": op3_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_spans": op5_spans,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_nndescent": op8_nndescent,
    "op9_langid": op9_langid,
    "op10_preferences": op10_preferences,
    "op11_pieces": op11_pieces,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

PREFERENCES_SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT pair_id, max(k) FILTER (side = 0) AS nc, max(k) FILTER (side = 1) AS nr FROM t GROUP BY 1 HAVING nc IS NOT NULL AND nr IS NOT NULL),
other AS (
  SELECT c.pair_id, min(c.k) AS k FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.k = r.k AND c.side = 0 AND r.side = 1
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY 1),
cut AS (SELECT p.pair_id, coalesce(o.k - 1, least(nc, nr)) AS n FROM pairs p LEFT JOIN other o USING (pair_id)),
safe AS (
  SELECT pair_id, side, k, role, regexp_replace(role, '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') AS name,
         regexp_replace(text, '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') AS body FROM t),
made AS (
  SELECT safe.pair_id, side, k, n, role, name, '<|im_start|>' || name || chr(10) || body || '<|im_end|>' || chr(10) AS s FROM safe JOIN cut USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM made WHERE k > n),
done AS (
  SELECT pair_id, side, string_agg(s, '' ORDER BY k) AS body,
         string_agg((pos + 13 + length(name))::BIGINT || '-' || (pos + length(s))::BIGINT, ',' ORDER BY k) FILTER (role = 'assistant') AS mask
  FROM placed GROUP BY 1, 2)
SELECT cut.pair_id, cut.n::INTEGER AS n_prompt_turns,
  coalesce((SELECT string_agg(m.s, '' ORDER BY m.k) FROM made m WHERE m.pair_id = cut.pair_id AND m.side = 0 AND m.k <= m.n), '') AS prompt,
  coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM cut LEFT JOIN done c ON c.pair_id = cut.pair_id AND c.side = 0 LEFT JOIN done r ON r.pair_id = cut.pair_id AND r.side = 1
"""

MIXING_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (
  SELECT *, row_number() OVER o AS place, (sum(source_size) OVER ())::DOUBLE AS all_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3.0::DOUBLE AS capped
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST)),
h AS (SELECT *, (all_words - capped) / weight_left AS share FROM l),
c AS (SELECT *, (SELECT arg_min(share, place) FROM h WHERE share * weight <= source_size * 3.0::DOUBLE) AS chosen FROM h),
g AS (SELECT source, source_size, CASE WHEN chosen IS NULL THEN source_size * 3.0::DOUBLE ELSE least(chosen * weight, source_size * 3.0::DOUBLE) END AS target FROM c),
r AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, floor(rate)::BIGINT AS sure, rate - floor(rate)::BIGINT AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, target - sum(sure * size) OVER (PARTITION BY source) AS left_words FROM k),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size) AS pos, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q),
y AS (SELECT *, rank IS NOT NULL AND left_words > 0 AND run <= left_words AS early FROM x),
f AS (
  SELECT source, 0::BIGINT AS pos, min(left_words) - coalesce(sum(size) FILTER (early), 0) AS missing FROM y GROUP BY source
  UNION ALL
  SELECT f.source, min(y.pos), f.missing - arg_min(y.size, y.pos) FROM f JOIN y ON y.source IS NOT DISTINCT FROM f.source AND y.rank IS NOT NULL AND NOT y.early AND y.pos > f.pos AND y.size <= f.missing GROUP BY f.source, f.pos, f.missing),
e AS (SELECT source, min(missing) AS missing FROM f GROUP BY source),
z AS (SELECT y.*, early OR f.pos IS NOT NULL AS got FROM y LEFT JOIN f ON f.pos > 0 AND y.source IS NOT DISTINCT FROM f.source AND y.pos = f.pos),
n AS (SELECT z.source, min({'size': size, 'rank': rank, 'doc_id': doc_id, 'pos': pos}) AS s FROM z JOIN e ON e.source IS NOT DISTINCT FROM z.source WHERE rank IS NOT NULL AND NOT got AND missing > 0 GROUP BY z.source, missing HAVING min(size) - missing < missing)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN got OR n.s IS NOT NULL THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM z LEFT JOIN n ON n.source IS NOT DISTINCT FROM z.source AND n.s.pos = z.pos
"""

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
a AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM a GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS size FROM k GROUP BY ALL),
c AS (SELECT a.* FROM a JOIN k USING (lang, term)),
z AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(size, 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN z USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.size + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.size + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE: dict[str, str] = {"op7_mixing": MIXING_SQL, "op10_preferences": PREFERENCES_SQL, "op13_divergence": DIVERGENCE_SQL}
