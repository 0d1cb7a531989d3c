"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op3_decontamination
from .ngram_join import op9_ngram_join
from .packing import op4_packing
from .quality_classifier import op6_quality_classifier
from .quality_rules import op10_quality_rules
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_store import op7_token_store
from .url_filter import op5_url_filter
from .warc import op1_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_substring_dedup, op3_decontamination, op4_packing, op5_url_filter,
        op6_quality_classifier, op7_token_store, op8_suffix_dedup, op9_ngram_join, op10_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM d LEFT JOIN m USING (digest)""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i,
             unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h
      FROM w WHERE len(ws) >= 50),
m AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
hit AS (SELECT doc_id, i FROM v JOIN m USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hit, (SELECT unnest(range(0, 50)) AS k)),
one AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY j)) AS h FROM one ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(h, sha256('')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) r USING (doc_id)""",
}
