"""Queries over the record tables: orphan references and quantities (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import references as R
from paperloom.operators import units as U
from paperloom.session import table


def _status(spark: SparkSession, d: str) -> DataFrame:
    names = {"entities", "passages", "chunks", "papers"}
    return R.reference_status({n: table(spark, d, n) for n in names}, R.LITERATURE_REFERENCES, R.LITERATURE_PARENTS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_status(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_status(spark, d))


def p3_converted(spark: SparkSession, d: str) -> DataFrame:
    return U.convert_quantities(table(spark, d, "entity_payloads"), table(spark, d, "metric_units"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the converted payloads, those whose unit stands somewhere."""
    return p3_converted(spark, d).where("status = 'read'").select("payload_id", "common_unit", "amount")


def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often the unit model is right on payloads it has not seen, by metric and by confidence."""
    h = U.held_out(table(spark, d, "entity_payloads"), table(spark, d, "metric_units"))
    right = F.avg((F.col("written") == F.col("predicted")).cast("double"))
    return h.groupBy("metric_name", "confident").agg(F.count(F.lit(1)).alias("payloads"), F.round(right, 4).alias("share_right"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_converted": p3_converted, "p3_quality": p3_quality}

_KEY = r"nullif(lower(regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '')"
_REFS = f"""
refs AS (
    SELECT 'entities' AS table_name, 'source_chunk_id' AS field_name, record_id, 'chunks' AS parent, {_KEY.format('source_chunk_id')} AS k, created_at AS seen FROM entities
    UNION SELECT 'passages', 'chunk_id', passage_id, 'chunks', {_KEY.format('chunk_id')}, retrieved_at FROM passages
    UNION SELECT 'passages', 'paper_id', passage_id, 'papers', {_KEY.format('paper_id')}, retrieved_at FROM passages),
held AS (
    SELECT 'chunks' AS parent, {_KEY.format('chunk_id')} AS k, ingested_at AS a, deleted_at AS z FROM chunks
    UNION ALL SELECT 'papers', {_KEY.format('paper_id')}, ingested_at, deleted_at FROM papers),
judged AS (
    SELECT r.table_name, r.field_name, r.record_id, r.seen,
        count(h.a) FILTER (WHERE h.a <= r.seen AND (h.z IS NULL OR h.z > r.seen)) AS valid,
        count(h.a) FILTER (WHERE h.a <= r.seen) AS begun, count(h.a) AS rows_there
    FROM refs r LEFT JOIN held h ON h.parent = r.parent AND h.k = r.k
    WHERE r.k IS NOT NULL GROUP BY ALL)
"""
ORACLE = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT table_name, field_name, record_id FROM judged WHERE seen IS NOT NULL AND valid = 0",
    "p1_report": f"""WITH {_REFS}
        SELECT table_name, field_name, CAST(date_trunc('month', seen) AS DATE) AS period, count(*) AS "references",
            count(*) FILTER (WHERE seen IS NOT NULL AND valid = 0 AND rows_there = 0) AS missing,
            count(*) FILTER (WHERE seen IS NOT NULL AND valid = 0 AND rows_there > 0 AND begun = 0) AS late,
            count(*) FILTER (WHERE seen IS NOT NULL AND valid = 0 AND begun > 0) AS deleted,
            count(*) FILTER (WHERE seen IS NULL) AS undated
        FROM judged GROUP BY ALL""",
}
