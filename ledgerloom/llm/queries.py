"""Queries of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal

    return find_personal(read_table(spark, sf_dir, "documentos")).select("doc_id", "kind", "start_pos")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_personal

    return replace_personal(read_table(spark, sf_dir, "documentos").select("id", "raw_text")).select(F.col("id").alias("doc_id"), "safe_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linkage import repeated_documents

    return repeated_documents(read_table(spark, sf_dir, "documentos"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .names import supplier_names, variant_pairs

    return variant_pairs(supplier_names(read_table(spark, sf_dir, "transacoes"), read_table(spark, sf_dir, "golden_dataset")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .components import connected_groups

    return connected_groups(read_table(spark, sf_dir, "matches"), "parent_doc_id", "child_doc_id")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debts import match_debts

    return match_debts(*(read_table(spark, sf_dir, t) for t in ("transacoes", "duplicatas", "documentos")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("transacao_id", "duplicata_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_corpus

    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mistura_alvo"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mistura_alvo"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import same_looking_pairs

    return same_looking_pairs(read_table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import with_visual_form

    return with_visual_form(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "form")


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import same_looking_groups

    return same_looking_groups(read_table(spark, sf_dir, "documents"))


def p8_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import script_findings

    return script_findings(read_table(spark, sf_dir, "documents"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .names import name_groups, supplier_names

    return name_groups(supplier_names(read_table(spark, sf_dir, "transacoes"), read_table(spark, sf_dir, "golden_dataset")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_texts, p2_found, p3_found, p4_found, p5_found, p5_matches, p6_ids, p7_mix, p7_shares, p8_found, p8_forms, p3_groups, p8_groups, p8_scripts)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
WITH RECURSIVE e AS (
  SELECT parent_doc_id AS a, child_doc_id AS b FROM matches WHERE parent_doc_id IS NOT NULL AND child_doc_id IS NOT NULL
  UNION SELECT child_doc_id, parent_doc_id FROM matches WHERE parent_doc_id IS NOT NULL AND child_doc_id IS NOT NULL
), label(v, l) USING KEY (v) AS (
  SELECT a, min(least(a, b)) FROM e GROUP BY a
  UNION
  SELECT e.b AS v, min(s.l) AS l FROM label s JOIN e ON e.a = s.v JOIN recurring.label r ON r.v = e.b WHERE s.l < r.l GROUP BY e.b
)
SELECT v AS doc_id, l AS group_id FROM label""",
    }
