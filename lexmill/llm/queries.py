"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontam, language, licenses, neardup, pii, quality, repair, rules, secrets, suffix, topk, trie
from .common import read
from .sql import REPAIR_SQL, RULES_SQL, TRIE_SQL


def queries() -> dict:
    return {
        "op1_suffix": lambda spark, sf: suffix.digest(read(spark, sf, "documents")),
        "op2_topk": lambda spark, sf: topk.digest(read(spark, sf, "embeddings")),
        "op3_bpe": lambda spark, sf: bpe.digest(read(spark, sf, "documents")),
        "op4_licenses": lambda spark, sf: licenses.digest(read(spark, sf, "documents")),
        "op5_language": lambda spark, sf: language.digest(read(spark, sf, "documents")),
        "op6_quality": lambda spark, sf: quality.digest(read(spark, sf, "documents"), read(spark, sf, "labels")),
        "op7_decontam": lambda spark, sf: decontam.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
        "op8_secrets": lambda spark, sf: secrets.digest(read(spark, sf, "documents")),
        "op9_neardup": lambda spark, sf: neardup.digest(read(spark, sf, "documents")),
        "op10_pii": lambda spark, sf: pii.digest(read(spark, sf, "documents")),
        "op11_rules": lambda spark, sf: rules.digest(read(spark, sf, "documents")),
        "op12_trie": lambda spark, sf: trie.digest(read(spark, sf, "conversations")),
        "op13_repair": lambda spark, sf: repair.digest(read(spark, sf, "conversations")),
    }


#: SQL of the contracts.
TOPK_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.id AS q, c.id AS c, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.id <> c.id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK_SQL, "op11_rules": RULES_SQL, "op12_trie": TRIE_SQL, "op13_repair": REPAIR_SQL}
