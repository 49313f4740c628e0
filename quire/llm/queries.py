"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm import divergence
from quire.llm.balltree import op7_balltree
from quire.llm.divergence import op11_divergence
from quire.llm.langid import op6_langid
from quire.llm.licences import op12_licences
from quire.llm.packing import op3_packing
from quire.llm.periodic import op13_runs
from quire.llm.projection import op8_projection
from quire.llm.ring import op9_ring
from quire.llm.segmentation import op5_segmentation
from quire.llm.simhash import op4_simhash
from quire.llm.styletree import op1_styletree
from quire.llm.substring import op2_passages
from quire.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_styletree, op2_passages, op3_packing, op4_simhash, op5_segmentation, op6_langid, op7_balltree, op8_projection, op9_ring, op10_toxicity, op11_divergence, op12_licences, op13_runs)
}

ORACLE_SQL = {
    "op11_divergence": divergence.ORACLE,
    # Every page of the fixture tables marks its article, and its entities are those of XML (titles can be cut before the semicolon).
    "op1_styletree": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
        d AS (SELECT page_id, url, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '') AS text FROM a)
        SELECT page_id, url, text, length(text) AS n_chars FROM d
    """,
    # All pairs and a walk along the links: the brute force of the operator, for tables of a few thousand vectors.
    "op8_projection": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS g FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.g) = len(b.g) AND list_cosine_similarity(a.g, b.g) >= 0.9
        ), reach(a, c) AS (
            SELECT a, a FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.a WHERE r.c < l.b
        ), c AS (SELECT a, min(c) AS c FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
    """,
    # An exact search is a join of the stated query set with all rows; SQL takes it whole.
    "op7_balltree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS g FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.g, c.g)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.g) = len(c.g)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
