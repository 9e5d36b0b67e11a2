"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .langid import language_of_documents
from .lexical import benchmark_search
from .linededup import deduplicated_lines
from .matroska import media_features
from .mil import quality_of_documents, toxicity_of_documents
from .packing import pack_documents
from .pii import personal_data
from .runs import periodic_runs
from .sharding import shard_documents
from .simhash import near_duplicates
from .warc import deduplicated_archives


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _docs(shard_documents),
        "op2_media": _docs(media_features),
        "op3_toxicity": lambda spark, d: toxicity_of_documents(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_near_duplicates": _docs(near_duplicates),
        "op5_packing": _docs(pack_documents),
        "op6_quality": lambda spark, d: quality_of_documents(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_personal_data": _docs(personal_data),
        "op8_language": _docs(language_of_documents),
        "op9_warc": lambda spark, d: deduplicated_archives(table(spark, d, "pages")),
        "op10_contamination": lambda spark, d: contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op11_line_dedup": _docs(deduplicated_lines),
        "op12_periodic_runs": _docs(periodic_runs),
        "op13_lexical_search": lambda spark, d: benchmark_search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB has no CRC-32, XXH64, tokenizer or trained models, and its own hashes differ, so the archive records,
    the benchmark windows, the common lines and the ranked search are given in SQL; the others are tested against brute force."""
    return {"op9_warc": _WARC, "op10_contamination": _CONTAMINATION, "op11_line_dedup": _LINES, "op13_lexical_search": _SEARCH}


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""

_CONTAMINATION = """
WITH bw AS (
       SELECT CAST(item_id AS VARCHAR) AS item,
              list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
       FROM benchmark WHERE text IS NOT NULL),
     win AS (
       SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM bw, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
     dw AS (
       SELECT doc_id,
              list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
       FROM documents),
     ks AS (SELECT DISTINCT k FROM win),
     dg AS (
       SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
     hit AS (SELECT dg.doc_id, dg.i, dg.k, win.item FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_LINES = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
     c AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT l.*, c.top IS NOT NULL AND l.doc_id <> c.top AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_SEARCH = """
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
     bt AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS t FROM benchmark WHERE text IS NOT NULL),
     tot AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM dw WHERE len(w) > 0),
     tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM bt) GROUP BY doc_id, t),
     wt AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, tot GROUP BY t),
     m AS (SELECT doc_id, 10 + (90 * CAST(len(w) AS BIGINT) * nd) // l AS m FROM dw, tot WHERE len(w) > 0),
     s AS (SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM bt JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
     r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
