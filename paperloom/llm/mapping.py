"""Mapping free-typed values to a canonical list.

Values are deduplicated, read into parts (:mod:`paperloom.llm.labels`), and each reading
retrieves candidates from an inverted index of the canonical entries' character n-grams (trigrams
and unordered near pairs of the name, weighted by inverse document frequency), inside the same
head noun, Greek letter, series word and number - entries that differ there are different things.
A reading without a head noun is held against the whole compact labels. The candidate of the
greatest weighted cosine is accepted at ``threshold`` (``whole`` for compact labels) if it leads the
next entry by ``margin``; an exact check of the letters (at most ``most_slips`` keyboard slips) follows.

Aliases are canonical strings too: a whole value, or a code in brackets with no other reading,
that equals an alias of exactly one entry means that entry.

Null, empty and blank values, and values that mean none of the entries, are unmatched (they come
out with a null entry). Repeated values are mapped once. Empty inputs give empty results. The
canonical list is a parameter table; its index is joined, never broadcast by force.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.grams import cosine_join, gram_weights
from paperloom.llm.labels import Label, Reader, fold, slips
from paperloom.session import cut, shuffle_width

#: Head nouns are read to the driver for the reader; more than this is an error.
NOUNS_AT_MOST = 10_000

_PARTS = "value string, reading int, greek string, name string, noun string, series string, number string, compact string, whole string, codes array<string>, key string, word string"


def squeeze(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", fold(text))


def _key(r: Label, noun: str) -> str:
    """What two labels must have in common to mean one thing."""
    return "|".join((r.greek, r.series, r.number, noun))


def _reader(nouns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(nouns)
        fields = [p.split(" ")[0] for p in _PARTS.split(", ")]
        for batch in batches:
            out: dict[str, list] = {f: [] for f in fields}
            for value in batch["value"].to_pylist():
                readings = reader.read(value)
                for k, r in enumerate(readings):
                    row = (value, k, r.greek, r.name, r.noun, r.series, r.number, r.compact, squeeze(value), list(r.codes), _key(r, r.noun), r.name if r.noun else r.compact)
                    for f, v in zip(fields, row):
                        out[f].append(v)
            types = [pa.string(), pa.int32(), *[pa.string()] * 7, pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(out[f], t) for f, t in zip(fields, types)], fields)

    return run


def map_values(values: DataFrame, canonical: DataFrame, threshold: float = 0.3, margin: float = 0.05, most_slips: int = 2, whole: float = 0.6) -> DataFrame:
    """``values(value)`` to (value, external_id, cosine, slips), one row per distinct value."""
    spark = values.sparkSession
    nouns = [r[0] for r in canonical.select(F.explode("parent_terms").alias("n")).where("n is not null").distinct().limit(NOUNS_AT_MOST + 1).collect()]
    if len(nouns) > NOUNS_AT_MOST:
        raise ValueError("too many head nouns for a parameter table")
    read = _reader(nouns)
    distinct = values.select("value").repartition(shuffle_width(spark), "value").distinct()
    mine = cut(distinct.where(F.length(F.trim("value")) > 0).mapInArrow(read, _PARTS))  # read once, used four times

    entries = canonical.select("external_id", F.col("label").alias("value")).where("value is not null and external_id is not null").distinct()
    entry_parts = entries.select("value").distinct().mapInArrow(read, _PARTS).where("reading = 0")
    entry = cut(entries.join(entry_parts, "value").select("external_id", "name", "compact", "key", "word", F.concat_ws("|", "greek", "series", "number", F.lit("")).alias("bare_key")))
    # The name stands under its noun, the whole compact label under none.
    terms = cut(entry.select("external_id", "key", "word").union(entry.select("external_id", F.col("bare_key").alias("key"), F.col("compact").alias("word"))).where("word <> ''").distinct())
    asked = mine.select("value", "reading", "key", "word", (F.col("noun") == "").alias("by_whole")).where("word <> ''")
    # A rival within the margin of the threshold counts too.
    pairs = cosine_join(asked.select("key", "word").distinct(), gram_weights(terms.select("word").distinct()), max(1e-3, threshold - margin), terms.select("key", "word").distinct())
    cosines = (
        asked.join(pairs.withColumnRenamed("a", "word"), ["key", "word"]).join(terms.select("external_id", "key", F.col("word").alias("b")), ["key", "b"])
        .groupBy("value", "external_id").agg(F.max(F.struct("cosine", "by_whole", -F.col("reading"))).alias("x"))
        .select("value", "external_id", "x.cosine", "x.by_whole", (-F.col("x.col3")).alias("reading"))
    )
    order = Window.partitionBy("value").orderBy(F.desc("cosine"), "external_id")
    led = (
        cosines.withColumn("k", F.row_number().over(order)).withColumn("next_cosine", F.coalesce(F.lead("cosine").over(order), F.lit(0.0))).where("k = 1")
        .where((F.col("cosine") >= F.when(F.col("by_whole"), whole).otherwise(threshold)) & (F.col("cosine") - F.col("next_cosine") >= margin))
    )
    facts = led.join(mine.select("value", "reading", "name", "compact"), ["value", "reading"]).join(
        entry.select("external_id", F.col("name").alias("e_name"), F.col("compact").alias("e_compact")), "external_id"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b[k].to_pylist() for k in ("by_whole", "name", "compact", "e_name", "e_compact")}
            out = []
            for by_whole, name, compact, e_name, e_compact in zip(*c.values()):
                if by_whole:
                    out.append(slips(compact, e_compact, most_slips))
                else:
                    out.append(slips(name, e_name, most_slips) if len(name) >= 3 * most_slips or name == e_name else most_slips + 1)
            yield pa.RecordBatch.from_arrays([b["value"], b["external_id"], b["cosine"], pa.array(out, pa.int32())], ["value", "external_id", "cosine", "slips"])

    named = facts.mapInArrow(check, "value string, external_id string, cosine double, slips int").where(F.col("slips") <= most_slips)

    # Aliases that belong to one entry only, compared without case and punctuation.
    squeeze_col = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    alias = (
        canonical.select("external_id", F.explode("aliases").alias("alias")).select("external_id", squeeze_col(F.col("alias")).alias("alias"))
        .where("alias <> ''").groupBy("alias").agg(F.count_distinct("external_id").alias("n"), F.min("external_id").alias("external_id")).where("n = 1")
    )
    coded = mine.where("reading = 0").select("value", F.explode(F.array_union(F.array("whole"), "codes")).alias("alias"), "whole")
    by_alias = (
        coded.join(alias, "alias").withColumn("is_whole", (F.col("alias") == F.col("whole")).cast("int"))
        .groupBy("value").agg(F.max_by("external_id", F.struct("is_whole", "external_id")).alias("a_id"), F.max("is_whole").alias("is_whole"), F.count_distinct("external_id").alias("ids"))
        .where("ids = 1 and is_whole = 1").select("value", "a_id")
    )
    return (
        distinct.join(named, "value", "left").join(by_alias, "value", "left")
        .select(
            "value", F.coalesce("external_id", "a_id").alias("external_id"),
            F.when(F.col("external_id").isNull() & F.col("a_id").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("cosine"),
            F.when(F.col("external_id").isNull() & F.col("a_id").isNotNull(), 0).otherwise(F.col("slips")).alias("slips"),
        )
    )


def map_misses(misses: DataFrame, canonical: DataFrame) -> DataFrame:
    """(miss_id, external_id) for every miss that means an entry."""
    mapped = map_values(misses.select(F.col("label").alias("value")), canonical).where("external_id is not null")
    return misses.select("miss_id", F.col("label").alias("value")).join(mapped, "value").select("miss_id", "external_id").distinct()


def mapping_report(misses: DataFrame, canonical: DataFrame) -> DataFrame:
    """Every distinct label with its weight and entry; unmatched labels have a null entry."""
    # The same miss delivered twice counts once.
    once = misses.groupBy("miss_id").agg(F.first("label").alias("label"), F.max("miss_count").alias("miss_count"))
    weight = once.groupBy(F.col("label").alias("value")).agg(F.sum(F.coalesce("miss_count", F.lit(0))).alias("misses"), F.count(F.lit(1)).alias("records"))
    mapped = map_values(once.select(F.col("label").alias("value")), canonical)
    return weight.join(mapped, weight["value"].eqNullSafe(mapped["value"]), "left").select(weight["value"].alias("label"), "misses", "records", "external_id", F.col("external_id").isNull().alias("unmatched"))
