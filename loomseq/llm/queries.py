"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, iblt, langid, linededup, media, mixing, recompress, simhash, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(name: str, op: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: op(table(spark, sf_dir, name))

    return {
        "op1_mix_knapsack": over("documents", mixing.op1_mix_knapsack),
        "op2_crf_language": over("documents", langid.op2_crf_language),
        "op3_warc_content_addressed": over("pages", warc.op3_warc_content_addressed),
        "op4_simhash_golay": over("documents", simhash.op4_simhash_golay),
        "op5_byte_bpe": over("documents", bpe.op5_byte_bpe),
        "op6_chat_columnar": over("conversations", chat.op6_chat_columnar),
        "op7_media_netpbm": over("documents", media.op7_media_netpbm),
        "op8_iblt_fingerprints": over("documents", iblt.op8_iblt_fingerprints),
        "op9_substring_recompression": over("documents", recompress.op9_substring_recompression),
        "op10_line_chunks": over("documents", linededup.op10_line_chunks),
    }


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
starts AS (
  SELECT rid, p, md5(array_to_string(ws[p:p + 34], ' ')) AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)),
again AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, p FROM starts SEMI JOIN again USING (k)),
word AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
marked AS (
  SELECT word.rid, i, word,
         max(CASE WHEN hit.p IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY word.rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON hit.rid = word.rid AND hit.p = word.i),
kept AS (
  SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept
  FROM marked GROUP BY rid)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""

OP10_SQL = r"""
WITH line AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM line),
rolled AS (
  SELECT *, (h * 257 + lead(h) OVER w) % 1000003 AS r
  FROM hashed WINDOW w AS (PARTITION BY rid ORDER BY i)),
begun AS (
  SELECT *, i >= 3 AND i < n AND r < lag(r) OVER w AND r < coalesce(lead(r) OVER w, 1000003) AS begins
  FROM rolled WINDOW w AS (PARTITION BY rid ORDER BY i)),
numbered AS (
  SELECT *, 1 + sum(CASE WHEN begins THEN 1 ELSE 0 END)
    OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j
  FROM begun),
chunk AS (
  SELECT rid, doc_id, j, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n,
         count(*) FILTER (regexp_matches(line, '\S')) >= 2 AS eligible
  FROM numbered GROUP BY rid, doc_id, j),
placed AS (SELECT *, row_number() OVER (PARTITION BY body, eligible ORDER BY doc_id, j) > 1 AND eligible AS gone FROM chunk)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM placed GROUP BY rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_content_addressed": warc.OP3_SQL,
        "op6_chat_columnar": chat.OP6_SQL,
        "op9_substring_recompression": OP9_SQL,
        "op10_line_chunks": OP10_SQL,
    }
