"""The queries this subpackage registers: opN_<name>, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact, langid, merkle, mixing, pitman_yor, quality, secret_scan, sharding, simhash, toxicity, warc
from .common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents")).drop("at", "rank")


def op3_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read_table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return merkle.audit_manifest(docs, merkle.lower_cased_third(docs))


def op13_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pitman_yor.score_documents(docs, pitman_yor.held_out_tenth(docs["doc_id"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_source_mixing,
        op3_crf_language_id,
        op4_warc_round_trip,
        op5_byte_bpe,
        op6_extendible_sharding,
        op7_quality_rules,
        op8_compression_toxicity,
        op9_exact_dedup,
        op10_secret_scan,
        op11_source_divergence,
        op12_merkle_manifest,
        op13_pitman_yor_scoring,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": r"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY src),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(src)) - 1 AS r FROM per),
w AS (SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM ranked),
lev AS (SELECT *, cap / weight AS ratio,
               (total - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
        FROM w WINDOW b AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(level, ratio * 1000000 + r) AS free_level FROM lev WHERE ratio > level),
tgt AS (SELECT src, source_size, r,
               round(CASE WHEN ratio <= level OR free_level IS NULL THEN cap ELSE weight * free_level END, 6) AS target
        FROM lev CROSS JOIN free),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.r, CAST(floor(t.target) AS BIGINT) AS whole,
                  CAST(coalesce(sum(s.size) OVER (PARTITION BY s.src ORDER BY s.k, s.doc_id, s.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_at
           FROM sizes s JOIN tgt t USING (src)),
got AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM placed),
took AS (SELECT *, CAST(passes * size + greatest(0, least(size, whole - passes * source_size - w_at)) AS BIGINT) AS taken,
                CASE r % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS o,
                CASE r % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS slope FROM got)
SELECT doc_id, size, source_size, target, taken,
       round(CASE WHEN taken > 0 THEN CASE WHEN target <= 0 THEN 0.0
             ELSE 2 * (w_at / target) / (o + sqrt(greatest(o * o + 2 * slope * (w_at / target), 0.0))) END END, 6) AS position
FROM took""",
    "op4_warc_round_trip": r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS held FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR held = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR held = page_id THEN NULL ELSE held END AS refers_to, true AS complete
FROM h""",
    "op7_quality_rules": r"""
WITH b AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text IS NOT NULL AS has, length(t) AS n,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(regexp_split_to_array(lower(t), '[^\p{L}]+'), lambda x: x <> '') AS letters,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS dark,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) AS lo, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS up,
         length(t) - length(regexp_replace(t, '\p{Nd}', '', 'g')) AS nd, length(t) - length(regexp_replace(t, '[.,;:!?''"()\-]', '', 'g')) AS pu
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c AS (SELECT *, [lo / greatest(n, 1), up / greatest(n, 1), nd / greatest(n, 1), (n - dark) / greatest(n, 1), pu / greatest(n, 1),
                 (n - lo - up - nd - (n - dark) - pu) / greatest(n, 1)] AS cls FROM b),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
rep AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS times FROM win) WHERE times > 1) GROUP BY rid),
cnt AS (SELECT lang, count(*) AS n_lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
s AS (SELECT c.* FROM c JOIN cnt USING (lang)
      WHERE has AND CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < least(1.0, CAST(400 AS DOUBLE) / n_lang)
        AND len(w) >= 50),
med AS (SELECT lang, count(*) AS n_docs, sum(len(letters)) AS total, quantile_cont(cls[1], 0.5) AS a, quantile_cont(cls[2], 0.5) AS b, quantile_cont(cls[3], 0.5) AS c,
               quantile_cont(cls[4], 0.5) AS d, quantile_cont(cls[5], 0.5) AS e, quantile_cont(cls[6], 0.5) AS f FROM s GROUP BY lang),
wc AS (SELECT lang, word, count(*) AS k, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
       FROM (SELECT lang, unnest(letters) AS word FROM s) GROUP BY lang, word),
ref AS (SELECT lang, list(word ORDER BY place) AS words, list(round(k / total, 6) ORDER BY place) AS shares,
               any_value([round(a / (a + b + c + d + e + f), 6), round(b / (a + b + c + d + e + f), 6), round(c / (a + b + c + d + e + f), 6),
                          round(d / (a + b + c + d + e + f), 6), round(e / (a + b + c + d + e + f), 6), round(f / (a + b + c + d + e + f), 6)]) AS ref_cls
        FROM wc JOIN med USING (lang) WHERE place <= 20 AND n_docs >= 20 GROUP BY lang),
pq AS (SELECT rid, len(w) AS n_words, ref.lang, cls, ref_cls,
              list_transform(words, lambda x: len(list_filter(letters, lambda y: y = x)) / greatest(len(letters), 1)) AS p, shares AS q
       FROM c CROSS JOIN ref),
pr AS (SELECT rid, n_words, lang, cls, ref_cls, list_append(p, greatest(1 - list_sum(p), 0)) AS p, list_append(q, greatest(round(1 - list_sum(q), 6), 0)) AS q FROM pq),
dist AS (SELECT rid, n_words, lang,
    sqrt(greatest(list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN p[i] > 0 THEN p[i] * log2(p[i] / ((p[i] + q[i]) / 2)) ELSE 0 END
      + CASE WHEN q[i] > 0 THEN q[i] * log2(q[i] / ((p[i] + q[i]) / 2)) ELSE 0 END)) / 2, 0)) AS wd,
    sqrt(greatest(list_sum(list_transform(range(1, 7), lambda i: CASE WHEN cls[i] > 0 THEN cls[i] * log2(cls[i] / ((cls[i] + ref_cls[i]) / 2)) ELSE 0 END
      + CASE WHEN ref_cls[i] > 0 THEN ref_cls[i] * log2(ref_cls[i] / ((cls[i] + ref_cls[i]) / 2)) ELSE 0 END)) / 2, 0)) AS cd FROM pr),
near AS (SELECT *, wd * wd - 20.0 / (4.0 * n_words * ln(2.0)) AS excess
         FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY wd, cd, lang) AS place FROM dist) WHERE place = 1),
lim AS (SELECT round(quantile_cont(cd, 0.5) + 16 * (quantile_cont(cd, 0.75) - quantile_cont(cd, 0.25)), 6) AS class_limit,
               round(quantile_cont(excess, 0.5) + 3 * (quantile_cont(excess, 0.75) - quantile_cont(excess, 0.25)), 6) AS word_limit
        FROM near WHERE rid IN (SELECT rid FROM s)),
base AS (SELECT c.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(dark AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
         FROM c LEFT JOIN rep USING (rid))
SELECT doc_id, base.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base.n_words < 50 OR 100 * n_repeat_words > 50 * base.n_words AS base_failed,
       NOT (base.n_words < 50 OR 100 * n_repeat_words > 50 * base.n_words) AND NOT coalesce(cd > class_limit OR excess > word_limit, false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, near.lang AS language
FROM base LEFT JOIN near USING (rid) LEFT JOIN lim ON true""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
             CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, count(t.rid) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
       1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM c JOIN v USING (lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce((SELECT sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) FROM p a JOIN p b ON a.term = b.term
            WHERE a.lang = g.lang AND a.source = g.source AND b.lang = g.lang AND b.source = h.source), 0) AS BIGINT) AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
a AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM a
QUALIFY part = 'pair' OR rank <= 10""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(CAST(source AS VARCHAR))) || ':' || source, '-') || coalesce(octet_length(encode(CAST(lang AS VARCHAR))) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda c, b:
             list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 3 = 0 AS chosen FROM documents),
v AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(CAST(text AS VARCHAR))) || ':' || text, '-')) AS leaf,
             CASE WHEN chosen THEN sha256(head || coalesce(octet_length(encode(CAST(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS VARCHAR))) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM v),
nodes AS (SELECT lang, 0 AS lvl, pos AS idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT lang, lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, lvl, n, idx // 8),
subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, place AS idx, subroot AS digest, n FROM subs
  UNION ALL SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, n, idx // 8),
runs AS (SELECT lang, lvl, idx // 8 AS run, list(digest ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, idx // 8 AS run, list(digest ORDER BY idx) AS ds FROM tops WHERE n > 1 GROUP BY ALL),
low AS (SELECT l.lang, pos, lvl, (pos // (8 ** lvl)::BIGINT) % 8 AS k, ds FROM leaves l JOIN runs r ON l.lang IS NOT DISTINCT FROM r.lang AND r.run = pos // (8 ** (lvl + 1))::BIGINT),
high AS (SELECT lang, lvl, (place // (8 ** lvl)::BIGINT) % 8 AS k, ds FROM subs s JOIN top_runs r ON r.run = place // (8 ** (lvl + 1))::BIGINT),
below AS (SELECT lang, pos, list(array_to_string(ds[1:k], '') || '|' || array_to_string(ds[k + 2:], '') ORDER BY lvl) AS steps FROM low GROUP BY lang, pos),
above AS (SELECT lang, list(array_to_string(ds[1:k], '') || '|' || array_to_string(ds[k + 2:], '') ORDER BY lvl) AS steps FROM high GROUP BY lang),
told AS (SELECT l.doc_id, l.leaf, l.other, s.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS steps
  FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN below b ON l.lang IS NOT DISTINCT FROM b.lang AND l.pos = b.pos
  LEFT JOIN above a ON l.lang IS NOT DISTINCT FROM a.lang),
folded AS (SELECT *, list_reduce([coalesce(other, leaf)] || steps, lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM told)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
}
