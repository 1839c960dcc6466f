"""Operational tables: status log, checkpoints, caches, misses, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_status(log: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *[F.desc(t) for t in ties])
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def to_do(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a complete row of the same keys (path, content hash, model version)."""
    return inputs.join(done.where("status = 'complete'").select(*keys).distinct(), keys, "left_anti")


def quality_report(status: DataFrame, most: int, at: str = "last_attempted") -> DataFrame:
    """Counts by status and mean quality of the complete rows, over the last ``most`` rows."""
    recent = status.orderBy(F.desc_nulls_last(at), "paper_id").limit(most)
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("papers"), F.avg(F.when(F.col("status") == "complete", F.col("quality"))).alias("avg_quality"))


def ingestion_quality(confidence: Column, salience: Column, coverage: Column) -> Column:
    return F.bround(0.45 * F.coalesce(confidence, F.lit(0.0)) + 0.35 * F.coalesce(salience, F.lit(0.0)) + 0.20 * F.coalesce(coverage, F.lit(0.0)), 3)


def miss_report(misses: DataFrame, most: int) -> DataFrame:
    """Misses of one label, type and corpus summed; the ``most`` frequent ones, then the latest."""
    g = misses.groupBy("label", "entity_type", "preferred_corpus").agg(F.sum(F.coalesce("miss_count", F.lit(0))).alias("misses"), F.max("last_seen").alias("last_seen"))
    return g.orderBy(F.desc("misses"), F.desc_nulls_last("last_seen"), "label", F.asc_nulls_first("entity_type"), F.asc_nulls_first("preferred_corpus")).limit(most)


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], now: float, ttl: float) -> DataFrame:
    """Requests with the cached payload, null where there is none or its age is at least the ttl.

    A negative ttl never expires. The last entry of a key holds, of equally late ones the greater payload."""
    last = cache.groupBy(*keys).agg(F.max(F.struct("created_at", "payload")).alias("_c")).select(*keys, "_c.payload", "_c.created_at")
    if ttl >= 0:
        last = last.where(F.lit(now) - F.col("created_at") < ttl)
    return requests.join(last, keys, "left")


def breaker_states(log: DataFrame, threshold: int, cooldown: float, now: float) -> DataFrame:
    """(service, failures, open): from an event log (service, at epoch seconds, ok).

    Failures are those since the last success; a breaker opens at the threshold and closes by
    itself when the cool-down since the last failure is over."""
    last_ok = log.groupBy("service").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    failures = log.where(~F.col("ok")).join(last_ok, "service").where(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))
    f = failures.groupBy("service").agg(F.count(F.lit(1)).alias("failures"), F.max("at").alias("last_failure"))
    return last_ok.join(f, "service", "left").select(
        "service", F.coalesce("failures", F.lit(0)).alias("failures"),
        (F.coalesce(F.col("failures") >= threshold, F.lit(False)) & (F.lit(now) - F.col("last_failure") < cooldown)).alias("open"),
    )


def enrich(labels: DataFrame, terms: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """The first hit of each label in the ontologies its type is routed to.

    ``labels(label, entity_type)``, ``terms(label, ontology, external_id)``, ``routes`` in order."""
    spark = labels.sparkSession
    order = spark.createDataFrame([(t, o, i) for i, (t, o) in enumerate(routes)], "entity_type string, ontology string, priority int")
    wanted = labels.select("label", F.lower("entity_type").alias("entity_type"), F.lower(F.trim("label")).alias("key")).distinct()
    known = terms.select(F.lower(F.trim("label")).alias("key"), "ontology", "external_id")
    hits = wanted.join(known, "key").join(order, ["entity_type", "ontology"]).groupBy("label", "entity_type").agg(F.min_by(F.struct("ontology", "external_id"), F.struct("priority", "external_id")).alias("hit"))
    return wanted.select("label", "entity_type").join(hits, ["label", "entity_type"], "left").select("label", "entity_type", F.col("hit.ontology").alias("ontology"), F.col("hit.external_id").alias("external_id"))
