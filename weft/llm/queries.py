"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licences, linededup, lm, mixing, negatives, ngramjoin, pieces, quality, rules, toxicity, turns
from .common import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents")).select("doc_id", "paragraph", "family", "probability", "unknown_probability", "coverage")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), heads AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS dropped FROM keyed k LEFT JOIN heads h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm.scored(docs, lm.fit(docs, labels.where("quality = 1")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighed by the square root of their size; the digest of every copy's text is taken after the shuffle."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.tempered(docs)).select("doc_id", "source", "copy", "order_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, range(0, 150) t(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM p),
u AS (SELECT doc_id, source, text, ('0x' || substr(sha256('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.source, any_value(u.text) AS text, count(*) FILTER (WHERE c.below <= u.u) AS n FROM u JOIN c USING (source) GROUP BY u.doc_id, u.source),
e AS (SELECT doc_id, source, text, unnest(range(n))::INTEGER AS copy FROM d)
SELECT doc_id, source, copy, ('0x' || substr(sha256('mix:' || doc_id || ':' || copy), 1, 15))::BIGINT AS order_key, sha256(coalesce(text, '')) AS text_sha256
FROM e
"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(r.y) FROM reach r WHERE r.x = s.doc_id) AS component_id FROM sets s
"""


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows gets the next label, so that labels and vectors disagree somewhere."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.usable(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding"), lambda vec_id: vec_id % 100 == 0)


OP11_SQL = """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.read_model(public_tokenizers.path(PIECE_FILE)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS harm
  FROM conversations, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM harmed, range(2) c(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)
), placed AS (
  SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS earlier,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), marked AS (
  SELECT *, n > min(n) OVER (PARTITION BY conv_id, role, text) AS again, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM marked GROUP BY conv_id
), walked AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 'o': ''} AS s0, {'c': 1000000, 'a': '', 'o': ''} AS s1,
         {'c': 2, 'a': 'I', 'o': chr(10) || 'user:'} AS u, {'c': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM counts
  UNION ALL
  SELECT conv_id, n, s0, s1, u, list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'}]) AS a
  FROM (
    SELECT conv_id, n, s0, s1, a, list_min([u, {'c': s0.c + 2, 'a': s0.a || 'I', 'o': s0.o || chr(10) || 'user:'}, {'c': s1.c + 2, 'a': s1.a || 'I', 'o': s1.o || chr(10) || 'user:'},
                                            {'c': a.c + 2, 'a': a.a || 'I', 'o': a.o || chr(10) || 'user:'}]) AS u
    FROM (
      SELECT conv_id, n, {'c': s0.c + 3, 'a': s0.a || 'D', 'o': s0.o} AS s0,
             list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 'o': s1.o}, {'c': s0.c + keep_s, 'a': s0.a || 'K', 'o': s0.o || kept}]) AS s1,
             list_min([{'c': u.c + 3, 'a': u.a || 'D', 'o': u.o}, {'c': s0.c + keep_u, 'a': s0.a || 'K', 'o': s0.o || kept}, {'c': s1.c + keep_u, 'a': s1.a || 'K', 'o': s1.o || kept},
                       {'c': a.c + keep_u, 'a': a.a || 'K', 'o': a.o || kept}, {'c': s0.c + other, 'a': s0.a || 'R', 'o': s0.o || as_user},
                       {'c': s1.c + other, 'a': s1.a || 'R', 'o': s1.o || as_user}, {'c': a.c + other, 'a': a.a || 'R', 'o': a.o || as_user}]) AS u,
             list_min([{'c': a.c + 3, 'a': a.a || 'D', 'o': a.o}, {'c': u.c + keep_a, 'a': u.a || 'K', 'o': u.o || kept}, {'c': u.c + other, 'a': u.a || 'R', 'o': u.o || as_assistant}]) AS a
      FROM (
        SELECT w.conv_id, w.n + 1 AS n, s0, s1, u, a, chr(10) || role || ':' || text AS kept, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant,
               CASE WHEN blank OR duplicate THEN 1000000 ELSE truncated::INTEGER END AS adds, adds + 2 AS other,
               adds + CASE initial WHEN 's' THEN 0 ELSE 1000000 END AS keep_s, adds + CASE initial WHEN 'u' THEN 0 ELSE 1000000 END AS keep_u, adds + CASE initial WHEN 'a' THEN 0 ELSE 1000000 END AS keep_a
        FROM walked w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
      )
    )
  )
), finished AS (
  SELECT c.*, list_min([w.s0, w.a]) AS best FROM counts c JOIN walked w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.n
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_qda, op2_licence_scan, op3_line_dedup, op4_quality_rules, op5_lm_scoring, op6_source_mixing, op7_ngram_jaccard, op8_hnsw, op9_toxicity, op10_byte_bpe, op11_hard_negatives, op12_sentencepiece, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op6_source_mixing": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_conversation_repair": OP13_SQL}
