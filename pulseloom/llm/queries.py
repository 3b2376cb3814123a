"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import audit
from pulseloom.llm.audit import op12_filter_lattice
from pulseloom.llm.decontamination import op7_spaced_seeds
from pulseloom.llm.licences import op5_license_scan
from pulseloom.llm.mixing import op9_entropy_mix
from pulseloom.llm.near_dedup import op4_odd_sketches
from pulseloom.llm.pii import op6_pii_anchors
from pulseloom.llm.quality import op2_quality_trees
from pulseloom.llm.rules import op11_decision_list
from pulseloom.llm.sharding import op1_tiered_shards
from pulseloom.llm.tokens import op8_token_counts
from pulseloom.llm.topk import op10_block_topk
from pulseloom.llm.toxicity import op3_toxic_spans

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    every = (
        op1_tiered_shards, op2_quality_trees, op3_toxic_spans, op4_odd_sketches, op5_license_scan, op6_pii_anchors,
        op7_spaced_seeds, op8_token_counts, op9_entropy_mix, op10_block_topk, op11_decision_list, op12_filter_lattice,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_odd_sketches": COMPONENTS, "op10_block_topk": TOP_K, "op12_filter_lattice": audit.SQL}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

COMPONENTS = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id AND r.c < g.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""
