"""The registered queries of this subpackage: name -> (query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import decontaminate, embedding_dedup, html_extract, langid, lexical, merkle, mixing, quality, repetition, simhash, substring_dedup, suffix_dedup, toxicity
from lurewatch.plans.registry import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_OP3_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 49], 'string_agg', ' ') AS s
  FROM words, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
hashed AS MATERIALIZED (SELECT doc_id, i, md5_number(s) AS h FROM windows),
seen AS (SELECT h, min(doc_id) AS first FROM hashed GROUP BY h),
late AS (SELECT doc_id, i FROM hashed JOIN seen USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, unnest(range(0, 50)) AS t(k)),
flagged AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
         CASE WHEN ps IS NULL THEN w ELSE
           list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN flagged ON words.doc_id = flagged.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


@query("op3_substring_dedup", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_OP4_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN counts ON counts.u = vec_id JOIN least ON least.u = vec_id
"""


@query("op4_embedding_dedup", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=1)


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


_OP11_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
positions AS MATERIALIZED (SELECT doc_id, i, length(w[i]) AS chars FROM words, unnest(range(1, len(w) + 1)) AS t(i)),
windows AS (
  SELECT doc_id, n, i, md5_number(list_aggregate(w[i:i + n - 1], 'string_agg', ' ')) AS h
  FROM words, (VALUES (3), (5), (6), (7), (8), (9), (10)) AS lengths(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
counted AS MATERIALIZED (
  SELECT doc_id, n, i, count(*) OVER same AS copies, row_number() OVER (same ORDER BY i) AS copy FROM windows WINDOW same AS (PARTITION BY doc_id, n, h)),
marked AS (
  SELECT DISTINCT doc_id, n, i + k AS i FROM counted, unnest(range(0, n)) AS t(k) WHERE copies > 1 AND (n = 3 OR copy > 1)),
covered AS (
  SELECT doc_id, count(*) FILTER (n = 3) AS repeated, COVERS
  FROM marked JOIN positions USING (doc_id, i) GROUP BY doc_id),
lines AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
by_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS dup_line_chars FROM lines GROUP BY doc_id),
measured AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
         MEASURES
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id LEFT JOIN by_line ON by_line.doc_id = words.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND NOT (LIMITS OR 100 * n_dup_lines > 30 * n_lines OR 100 * dup_line_chars > 20 * word_chars) AS kept FROM judged
""".replace("COVERS", ", ".join(f"coalesce(sum(chars) FILTER (n = {n}), 0) AS c{n}" for n in repetition.NGRAM_LIMITS)).replace(
    "MEASURES", ", ".join(f"CAST(coalesce(c{n}, 0) AS BIGINT) AS dup_{n}_chars" for n in repetition.NGRAM_LIMITS)).replace(
    "LIMITS", " OR ".join(f"100 * dup_{n}_chars > {limit} * word_chars" for n, limit in repetition.NGRAM_LIMITS.items()))


@query("op11_quality_rules", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


_OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tfs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(
           CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM wanted JOIN tfs USING (term) JOIN dfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_lexical_search", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP13_SQL = """
WITH RECURSIVE
crc_bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows AS MATERIALIZED (
  SELECT doc_id, lang, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM documents, crc_bytes),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS k, sha256(array_to_string(f, '')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(array_to_string(f[1:4], '') || lowered) ELSE sha256(array_to_string(f, '')) END AS given,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM rows),
nodes AS (
  SELECT 0 AS level, k, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT level + 1, k, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, k, pos // 8, n),
subroots AS MATERIALIZED (SELECT k, digest, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
segments AS MATERIALIZED (
  SELECT doc_id, a.level AS step, coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos > own), '') AS after
  FROM (SELECT doc_id, leaves.k, level, leaves.pos // CAST(pow(8, level) AS BIGINT) AS own FROM leaves JOIN (SELECT DISTINCT k, level FROM nodes WHERE n > 1) AS heights ON heights.k = leaves.k) AS a
  JOIN nodes AS s ON s.k = a.k AND s.level = a.level AND s.pos // 8 = own // 8 GROUP BY doc_id, a.level
  UNION ALL BY NAME
  SELECT doc_id, a.height + a.level AS step, coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos > own), '') AS after
  FROM (SELECT doc_id, heights.height, levels.level, subroots.pos // CAST(pow(8, levels.level) AS BIGINT) AS own
        FROM leaves JOIN subroots ON subroots.k = leaves.k JOIN (SELECT k, max(level) AS height FROM nodes GROUP BY k) AS heights ON heights.k = leaves.k, (SELECT DISTINCT level FROM tops WHERE n > 1) AS levels) AS a
  JOIN tops AS s ON s.level = a.level AND s.pos // 8 = own // 8 GROUP BY doc_id, a.height, a.level),
folds AS (
  SELECT doc_id, 0 AS step, given AS digest FROM leaves
  UNION ALL
  SELECT folds.doc_id, folds.step + 1, sha256(before || digest || after) FROM folds JOIN segments ON segments.doc_id = folds.doc_id AND segments.step = folds.step),
folded AS (SELECT doc_id, max_by(digest, step) AS folded_root FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM segments GROUP BY doc_id)
SELECT leaves.doc_id, leaf, subroots.digest AS subroot, tops.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = tops.digest AS verified
FROM leaves JOIN subroots ON subroots.k = leaves.k JOIN folded ON folded.doc_id = leaves.doc_id LEFT JOIN proofs ON proofs.doc_id = leaves.doc_id, tops WHERE tops.n = 1
"""


@query("op13_merkle_manifest", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
