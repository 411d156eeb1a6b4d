"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.idshards import op7_id_shards
from lumisift.llm.media import op2_media
from lumisift.llm.mixing import op9_mixing
from lumisift.llm.packing import op10_packing
from lumisift.llm.pii import op4_pii
from lumisift.llm.repeats import op8_repeats
from lumisift.llm.simhash import op3_simhash
from lumisift.llm.tokencount import op5_token_counts
from lumisift.llm.toxicity import op6_toxicity
from lumisift.llm.vectors import op1_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_vectors, op2_media, op3_simhash, op4_pii, op5_token_counts, op6_toxicity, op7_id_shards, op8_repeats, op9_mixing, op10_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op1_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.w, r.root FROM r JOIN l ON r.node = l.u),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id""",
    "op8_repeats": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p, len(words) AS n FROM w),
k AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= n THEN string_agg(word, ' ')
      OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS seq FROM t),
f AS (SELECT *, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) > 1 AS later FROM k),
c AS (SELECT doc_id, p, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
}
