"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm import bpe, decontam, langid, lines, mixing, nearest, simhash, suffixes, surrogates, topk, trie, warc, whitening
from inkplane.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_mix": op2_mix,
    "op3_topk": op3_topk,
    "op4_surrogates": op4_surrogates,
    "op5_simhash": op5_simhash,
    "op6_nearest": op6_nearest,
    "op7_lines": op7_lines,
    "op8_suffixes": op8_suffixes,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_whiten": op11_whiten,
    "op12_decontam": op12_decontam,
    "op13_trie": op13_trie,
}

OP2_SQL = """
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, '') AS source, (count(*) + 15) // 16 AS blocks, sqrt(CAST(count(*) AS DOUBLE)) AS weight FROM documents GROUP BY source),
named AS (
  SELECT source, blocks, greatest(CAST(floor(weight / max(weight) OVER () * 1e12 + 0.5) AS BIGINT), 1) AS units, row_number() OVER (ORDER BY source) AS i FROM counts),
lists AS (SELECT list(units ORDER BY i) AS w, list(blocks ORDER BY i) AS b, sum(blocks) AS slots FROM named),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS chosen, CAST(0 AS BIGINT) AS block, false AS last, CAST(0 AS BIGINT) AS start,
    list_transform(b, lambda x: CAST(0 AS BIGINT)) AS done, list_transform(b, lambda x: CAST(0 AS BIGINT)) AS begun FROM lists
  UNION ALL
  SELECT slot + 1, pick, done[pick], done[pick] + 1 = b[pick], CASE WHEN done[pick] + 1 = b[pick] THEN slot + 2 ELSE start END,
    list_transform(done, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END),
    CASE WHEN done[pick] + 1 = b[pick] THEN list_transform(done, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END) ELSE begun END
  FROM (
    SELECT slot, start, done, begun, b, list_sort(list_filter(list_transform(done, lambda k, i:
      CASE WHEN k < b[i] AND (CAST(k - begun[i] AS HUGEINT) * total) // w[i] <= slot + 1 - start
        THEN {'due': (CAST(k - begun[i] + 1 AS HUGEINT) * total + w[i] - 1) // w[i], 'i': CAST(i AS BIGINT)} END), lambda x: x IS NOT NULL))[1].i AS pick
    FROM (SELECT run.*, w, b, CAST(list_sum(list_transform(w, lambda x, i: CASE WHEN done[i] < b[i] THEN x ELSE 0 END)) AS HUGEINT) AS total
      FROM run, lists WHERE slot + 1 < slots))),
horizon AS (SELECT min(slot) AS first_out FROM run WHERE last),
numbers AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), CAST(doc_id AS VARCHAR) NULLS FIRST) - 1 AS n FROM documents)
SELECT doc_id, r.source, CAST(r.n // 16 AS BIGINT) AS mix_block, slot AS mix_slot, CAST(r.n % 16 AS INTEGER) AS mix_place, slot <= first_out AS mix_exact
FROM numbers r JOIN named s ON s.source = coalesce('=' || r.source, '') JOIN run ON chosen = s.i AND block = r.n // 16, horizon
"""

OP3_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ranked)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
"""

OP6_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
far AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS score
  FROM fine q JOIN fine c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM far)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 10
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
named AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best, sha1(h) AS x FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b FROM named),
coded AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    16 * CAST(substr(b, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS BIGINT)
    + 2 * CAST(substr(b, 5 * i + 4, 1) AS BIGINT) + CAST(substr(b, 5 * i + 5, 1) AS BIGINT) + 1 AS BIGINT), 1)), '') AS payload_digest FROM bits)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM coded
"""

#: Every window of 100 bytes, in hexadecimal; rows that repeat a doc_id are beyond it.
OP8_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
windows AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS digest FROM (SELECT doc_id, h, unnest(range(greatest(0, n_bytes - 99))) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS FIRST, i) AS place FROM windows) WHERE place > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) = 1 AS final FROM spans),
kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed,
    string_agg(substr(h, 2 * since + 1, 2 * (b - since)) || CASE WHEN final THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY b) AS h
  FROM gaps g JOIN texts t ON g.doc_id IS NOT DISTINCT FROM t.doc_id GROUP BY g.doc_id)
SELECT t.doc_id, t.n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id IS NOT DISTINCT FROM k.doc_id
"""

#: Windows and words as rows; a window is its words, joined by spaces.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT row, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (
  SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM tests) WHERE len(w) >= size)),
found AS (SELECT row, size, i, item_id FROM places JOIN tests USING (size, s)),
hits AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT row, size, i FROM found)) GROUP BY row),
owners AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN owners USING (row)
"""

#: Sequences as lists; a CRC-32 is a fold over bytes and bits.
OP13_SQL = """
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(turn ORDER BY pos) AS turns,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
      list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY conv_id),
made AS (
  SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS p FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM made)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
  FROM members GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids USING (d, p)),
sums AS (
  SELECT k AS d, p[1:k] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(d + 1)) AS k FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s USING (d, p) LEFT JOIN nodes q ON n.d > 0 AND q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]
"""

ORACLE_SQL: dict[str, str] = {"op2_mix": OP2_SQL, "op3_topk": OP3_SQL, "op6_nearest": OP6_SQL, "op8_suffixes": OP8_SQL, "op9_warc": OP9_SQL, "op12_decontam": OP12_SQL, "op13_trie": OP13_SQL}
