"""Raw extraction replies to entities: validation, labels, ids and defaults, as projections.

``payloads(payload_id, chunk_id, type, name, text, value, unit, metric, dataset, condition,
confidence)`` become rows of the entity table. Replies of an unknown type or without a label are
none; exact repeats are one. A missing, zero or unreadable confidence is 0.5; others are cut to
[0, 1] and rounded to three digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import extraction as X

TYPES = ["concept", "method", "claim", "result", "equation", "dataset"]


def _text(c: str) -> Column:
    return T.collapse(F.coalesce(F.col(c), F.lit("")))


def label_of(kind: Column) -> Column:
    """The name of a named thing, the sentence of a claim or equation, value and metric of a result."""
    return (
        F.when(kind.isin("concept", "method", "dataset"), _text("name")).when(kind.isin("claim", "equation"), _text("text"))
        .when(kind == "result", F.trim(F.concat_ws(" ", F.nullif(_text("value"), F.lit("")), F.nullif(_text("metric"), F.lit("")))))
    )


def confidence_of(c: Column) -> Column:
    good = c.isNotNull() & ~F.isnan(c) & (c != 0)
    return F.when(good, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)).otherwise(F.lit(0.5))


def payload_entities(payloads: DataFrame, model_version: str = "") -> DataFrame:
    """(payload_id, chunk_id, entity_id, entity_type, label, confidence, properties, extractor_model)."""
    kind = F.lower(_text("type"))
    rows = payloads.select("payload_id", "chunk_id", "type", "name", "text", "value", "unit", "metric", "dataset", "condition", "confidence").distinct()
    named = rows.where(kind.isin(TYPES)).withColumn("entity_type", kind).withColumn("label", label_of(F.col("entity_type"))).where("label <> ''")
    number = F.coalesce(T.numeric_text(F.col("value")).try_cast("decimal(30,6)").cast("string"), F.lit("0.000000"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    result_id = T.stable_id("result", number, text("metric"), text("dataset"), text("condition"), F.col("chunk_id"))
    other_id = F.concat(F.col("entity_type"), F.lit("-"), F.substring(F.sha1(F.lower("label")), 1, 16))
    kept = {
        "claim": [("claim_type", X.claim_type(F.col("label"))), ("text", F.col("label"))],
        "result": [("value", text("value")), ("unit", text("unit")), ("metric", text("metric")), ("dataset", text("dataset")), ("condition", text("condition")), ("text", F.coalesce("text", "label"))],
        "equation": [("latex", F.col("label")), ("domain", F.lit("mathematics"))], "dataset": [("dataset_type", F.lit("experimental_group")), ("text", F.coalesce("text", "label"))],
    }
    properties = F.create_map(F.lit("ontology"), F.lit(""))
    for t, pairs in kept.items():
        properties = F.when(F.col("entity_type") == t, F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])).otherwise(properties)
    return named.select(
        "payload_id", "chunk_id", F.when(F.col("entity_type") == "result", result_id).otherwise(other_id).alias("entity_id"), "entity_type", "label", confidence_of(F.col("confidence")).alias("confidence"), properties.alias("properties"), F.lit(model_version).alias("extractor_model"),
    )


def chunk_quality(validated: DataFrame) -> DataFrame:
    """(chunk_id, payloads, valid, quality): the share of valid replies of each chunk, three digits."""
    return validated.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("payloads"), F.count_if("valid").alias("valid")).withColumn("quality", F.bround(F.col("valid") / F.col("payloads"), 3))


def prefer_replies(local: DataFrame, replies: DataFrame) -> DataFrame:
    """The entities of the replies for chunks that have any, else the local ones (same columns)."""
    answered = replies.select("chunk_id").distinct()
    return replies.unionByName(local.join(answered, "chunk_id", "left_anti"))


def model_version(model: str, domain: str, schema_version: str) -> str:
    return "::".join((model, domain, schema_version))


def text_aliases(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, term, alias): abbreviations and their expansions that stand beside a term.

    ``terms(paper_id, term)``, ``texts(paper_id, text)``: ``Full Name (ABC)`` gives each of the two
    as alias of the other. All such pairs of a text are taken out once; terms join them."""
    pair = r"([A-Za-z][A-Za-z0-9'/-]*(?:\s+[A-Za-z][A-Za-z0-9'/-]*){0,8})\s*\(\s*([A-Z][A-Z0-9α-]{1,12})\s*\)"
    met = texts.select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(pair), 0)).alias("m")).select(
        "paper_id", T.collapse(F.regexp_extract("m", pair, 1)).alias("full"), F.regexp_extract("m", pair, 2).alias("short")
    ).distinct()
    # The full name may be any last words before the bracket.
    words = F.split("full", " ")
    ends = met.select("paper_id", "short", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("end"))
    by_full = terms.join(ends, (terms["paper_id"] == ends["paper_id"]) & (F.lower(terms["term"]) == F.lower("end"))).select(terms["paper_id"], "term", F.col("short").alias("alias"))
    capital = ends.where(F.col("end").rlike(r"^[A-Z][A-Za-z0-9'/-]+(?: [A-Z][A-Za-z0-9'/-]+)+$"))
    longest = capital.groupBy("paper_id", "short").agg(F.max_by("end", F.struct(F.length("end"), "end")).alias("full"))
    by_short = terms.join(longest, (terms["paper_id"] == longest["paper_id"]) & (terms["term"] == F.col("short"))).select(terms["paper_id"], "term", F.col("full").alias("alias"))
    return by_full.unionByName(by_short).distinct()


def counted_hits(cache: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with each key's hits added to its counter; ``hits`` may repeat keys."""
    n = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_new"))
    return cache.join(n, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("_new", F.lit(0))).drop("_new")


def counted_misses(counters: DataFrame, misses: DataFrame, keys: list[str], at: str = "last_seen") -> DataFrame:
    """The counters (keys, miss_count, at) with the misses (keys, at) added; new keys begin at their number."""
    new = misses.groupBy(*keys).agg(F.count(F.lit(1)).alias("miss_count"), F.max(at).alias(at))
    return counters.select(*keys, "miss_count", at).unionByName(new).groupBy(*keys).agg(F.sum("miss_count").alias("miss_count"), F.max(at).alias(at))
