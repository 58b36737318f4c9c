"""One query for each operator: (spark, sf_dir) -> DataFrame over the whole table."""

from __future__ import annotations

from .common import read_table


def op1_url_filter(spark, sf_dir):
    from .url_filter import judge

    return judge(read_table(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    from .bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"))


def op3_top_k(spark, sf_dir):
    from .topk import search

    return search(read_table(spark, sf_dir, "embeddings")).drop("evaluated")


def op4_substring_dedup(spark, sf_dir):
    from .substring_dedup import dedup

    return dedup(read_table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    from .warc import fetch, index, write

    captures = write(read_table(spark, sf_dir, "pages"))
    found = fetch(index(captures), captures.select("key", "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_file(spark, sf_dir):
    from .token_file import read_all, write

    return read_all(write(read_table(spark, sf_dir, "documents")))


def op7_ngram_jaccard(spark, sf_dir):
    from .ngram_join import link

    return link(read_table(spark, sf_dir, "documents"), width=3, p=9, q=10)


def op8_merkle(spark, sf_dir):
    from .merkle import compare_with_next

    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), keep_ids=False)


def op10_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from .language_id import held_out, predict, train

    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_fim(spark, sf_dir):
    from pyspark.sql import functions as F

    from .fim import restore, transform

    out = restore(transform(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_prefix_trie(spark, sf_dir):
    from .prefix_trie import nodes, turn_lists, with_shared_starts

    return nodes(with_shared_starts(turn_lists(read_table(spark, sf_dir, "conversations"))))


def op13_simhash(spark, sf_dir):
    from .simhash import link

    return link(read_table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), m AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN CASE WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), pairs AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.size + y.size - both_have)
), edges AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
), least AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), k AS (
  SELECT *, CAST(len(lines) - CAST(lines[-1] = '' AS INTEGER) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM d
), u AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS p, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS m,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
), e AS (
  SELECT *, CASE p WHEN 0 THEN 0 WHEN n THEN length(text) ELSE length(array_to_string(lines[1:p], chr(10))) + 1 END AS p_end,
    CASE m WHEN 0 THEN 0 WHEN n THEN length(text) ELSE length(array_to_string(lines[1:m], chr(10))) + 1 END AS m_end FROM u
), x AS (
  SELECT *, substr(text, 1, p_end) AS prefix, substr(text, p_end + 1, m_end - p_end) AS middle, substr(text, m_end + 1) AS suffix FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(p_end AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m_end - p_end AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM x
"""


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op3_top_k": TOP_K_SQL, "op5_warc": WARC_SQL, "op7_ngram_jaccard": JACCARD_SQL, "op11_fim": FIM_SQL}
