"""References to records that do not exist (at the time of the reference).

References and the validity intervals of their parents are hash-partitioned on the same
normalised key, sorted by (key, time) inside each partition, and read once in that order: a
running maximum of the interval ends seen so far tells, at each reference, whether some
interval that began no later is still open. That is a linear merge of two sorted streams; no
interval list per key is ever built, so a parent delivered any number of times costs nothing
extra.

Status of a reference at its own time ``t``:

* ``present`` – some parent row has start <= t and (end is null or end > t);
* ``missing`` – no parent row with that key exists at all (with a start time);
* ``late``    – parent rows exist, all begin after ``t``;
* ``deleted`` – parent rows began by ``t`` and all of those had ended by ``t``;
* ``undated`` – the reference carries no time, so nothing can be said.

Null, empty and blank keys are no references and do not come out. Keys that differ only in
letter case or surrounding white space (space, tab, newline, carriage return) are the same
key. A parent row without a start never began. Repeated reference rows come out once per
(table, field, record). Empty inputs give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more references than one part in so many of all references is salted; so at
#: most this many keys can be hot, which bounds the broadcast table of hot keys.
HOT_KEYS_AT_MOST = 4096
#: ... and never below this many references.
HOT_AT_LEAST = 50_000

_FAR = "9999-12-31 23:59:59"


@dataclass(frozen=True)
class Reference:
    """One referring column: ``table.field`` at ``at`` points to ``parent``."""

    table: str
    field: str
    record: str
    at: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """A keyed table whose rows are valid from ``start`` until ``end`` (null: still valid)."""

    key: str
    start: str
    end: str


def normal_key(c: Column) -> Column:
    """Lower case, without surrounding spaces, tabs and newlines; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), F.lit(""))


def _references(tables: dict[str, DataFrame], specs: list[Reference]) -> DataFrame:
    out = None
    for s in specs:
        df = tables[s.table]
        part = df.select(
            F.lit(s.parent).alias("parent"),
            normal_key(df[s.field].cast("string")).alias("key"),
            F.lit(s.table).alias("table_name"),
            F.lit(s.field).alias("field_name"),
            df[s.record].cast("bigint").alias("record_id"),
            df[s.at].cast("timestamp_ntz").alias("at"),
        ).where("key is not null")
        out = part if out is None else out.unionByName(part)
    return out


def _intervals(tables: dict[str, DataFrame], parents: dict[str, Parent]) -> DataFrame:
    out = None
    for name, p in parents.items():
        df = tables[name]
        part = df.select(
            F.lit(name).alias("parent"),
            normal_key(df[p.key].cast("string")).alias("key"),
            df[p.start].cast("timestamp_ntz").alias("at"),
            F.coalesce(df[p.end].cast("timestamp_ntz"), F.lit(_FAR).cast("timestamp_ntz")).alias("until"),
        ).where("key is not null and at is not null")
        out = part if out is None else out.unionByName(part)
    return out


def reference_status(
    tables: dict[str, DataFrame], specs: list[Reference], parents: dict[str, Parent],
    hot_at_least: int = HOT_AT_LEAST,
) -> DataFrame:
    """(table_name, field_name, record_id, parent, key, at, status), a row per reference row."""
    refs, spans = _references(tables, specs), _intervals(tables, parents)
    sizes = {t: tables[t].count() for t in {s.table for s in specs}}
    total = sum(sizes[s.table] for s in specs)
    hot_from = max(hot_at_least, total // HOT_KEYS_AT_MOST)
    salted, spread = refs.withColumn("salt", F.lit(0)), spans.withColumn("salt", F.lit(0))
    if total > hot_from:
        hot = (
            refs.groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from)
            # As many salts as keep each part of the key below the size of a key that is not hot.
            .select("parent", "key", F.ceil(F.col("n") / hot_from).cast("int").alias("salts"))
        )
        hot = F.broadcast(hot)  # at most HOT_KEYS_AT_MOST rows
        salted = refs.join(hot, ["parent", "key"], "left").withColumn(
            "salt", F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("salts")).cast("int"), F.lit(0))
        ).drop("salts")
        spread = (
            spans.join(hot, ["parent", "key"], "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
            .drop("salts")
        )
    events = salted.withColumn("side", F.lit(1)).unionByName(spread.withColumn("side", F.lit(0)), allowMissingColumns=True)
    key = Window.partitionBy("parent", "key", "salt")
    merge = key.orderBy(F.col("at").asc_nulls_first(), "side")
    so_far = merge.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A parent row later in the order is the first one to come only for references still
    # before it, so the total over the key is needed only to tell missing from late.
    merged = events.withColumn("open_until", F.max("until").over(so_far)).withColumn(
        "last_start", F.max(F.when(F.col("side") == 0, F.col("at"))).over(key)
    )
    status = (
        F.when(F.col("at").isNull(), "undated")
        .when(F.col("open_until") > F.col("at"), "present")
        .when(F.col("open_until").isNotNull(), "deleted")
        .when(F.col("last_start").isNotNull(), "late")
        .otherwise("missing")
    )
    return merged.where("side = 1").select("table_name", "field_name", "record_id", "parent", "key", "at", status.alias("status"))


def orphans(status: DataFrame) -> DataFrame:
    """The references that no parent row held at their time, each record once."""
    return (
        status.where(F.col("status").isin("missing", "late", "deleted"))
        .select("table_name", "field_name", "record_id").distinct()
    )


def orphan_report(status: DataFrame, period: str = "month") -> DataFrame:
    """Counts per table, field and period; ``references`` counts distinct records."""
    once = status.select(
        "table_name", "field_name", "record_id", "status", F.date_trunc(period, "at").cast("date").alias("period")
    ).distinct()
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return once.groupBy("table_name", "field_name", "period").agg(
        F.count(F.lit(1)).alias("references"), n("missing"), n("late"), n("deleted"), n("undated")
    )


LITERATURE_REFERENCES = [
    Reference("entities", "source_chunk_id", "record_id", "created_at", "chunks"),
    Reference("passages", "chunk_id", "passage_id", "retrieved_at", "chunks"),
    Reference("passages", "paper_id", "passage_id", "retrieved_at", "papers"),
]
LITERATURE_PARENTS = {
    "chunks": Parent("chunk_id", "ingested_at", "deleted_at"),
    "papers": Parent("paper_id", "ingested_at", "deleted_at"),
}
