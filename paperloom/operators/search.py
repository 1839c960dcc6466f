"""Hybrid retrieval and the search bundle.

A request is a parameter, so each ranking of the chunks is one scan that ends in its first rows;
from there on at most ``3 k`` rows a ranking travel, and everything that enriches them is a join of
that small side (its size is bounded by ``k``) to a table that is read once, pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import ranking as R

#: Each ranking gives this many times the wanted number of passages to the fusion.
OVERFETCH = 3


@dataclass(frozen=True)
class Request:
    """A checked request: no blank query, 1 to 50 passages, 0 to 5 hops, 1 to 500 rows of a report."""

    query: str
    k: int = 10
    hops: int = 2
    limit: int = 100
    section_type: str | None = None

    def __post_init__(self) -> None:
        if not (self.query or "").strip():
            raise ValueError("the query is blank")
        for name, low, high in (("k", 1, 50), ("hops", 0, 5), ("limit", 1, 500)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


def missing(c: Column, default: Column) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def retrieve(rankings: dict[str, DataFrame], details: DataFrame, request: Request) -> DataFrame:
    """The fused passages: (chunk_id, paper_id, paper_title, chunk_type, rank, score, sources, source_scores).

    ``rankings[name](chunk_id, score)`` in the order of precedence, ``details(chunk_id, paper_id,
    paper_title, section_title, chunk_type)``. Ranks count before the guard on the section type,
    which lets chunks without a type pass."""
    most = OVERFETCH * request.k
    hits = None
    for name, rows in rankings.items():
        first = rows.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(most)
        part = first.select("chunk_id", "score", F.lit(name).alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
        hits = part if hits is None else hits.unionByName(part)
    # At most OVERFETCH * k rows a ranking: a side of proven size.
    known = details.join(F.broadcast(hits), "chunk_id")
    if request.section_type:
        known = known.where(F.col("chunk_type").isNull() | (F.col("chunk_type") == request.section_type))
    fused = known.groupBy("chunk_id").agg(
        *[F.first(c).alias(c) for c in ("paper_id", "paper_title", "section_title", "chunk_type")], F.sum(F.lit(1.0) / (R.RRF_K + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("sources"),
        F.max("score").alias("best_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("source_scores"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    order = [F.desc(F.round("rrf", 12)), F.desc("sources"), F.desc("best_score"), text("paper_title"), text("section_title"), F.col("chunk_id")]
    top = fused.orderBy(*order).limit(request.k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("score", F.round("rrf", 6)).drop("rrf", "best_score")


def passages(found: DataFrame, chunks: DataFrame, entities: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Found chunks with the texts around them, their entities, and whether the query's entities are mentioned.

    ``chunks(chunk_id, text, previous_text, next_text)``, ``entities(source_chunk_id, label)``,
    ``mentioned(chunk_id)``."""
    few = F.broadcast(found)  # at most k rows
    named = (
        entities.join(few.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_semi").select("source_chunk_id", F.lower(F.trim("label")).alias("label")).distinct()
        .groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list("label")).alias("entities"))
    )
    met = mentioned.join(few.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.lit(True).alias("in_graph")).distinct()
    around = chunks.join(few, "chunk_id")
    out = around.join(named, "chunk_id", "left").join(met, "chunk_id", "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))


def matched_papers(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, title, best_score, position): papers of any hit, the best first; ``hits(paper_id, score)``."""
    best = hits.groupBy("paper_id").agg(F.max("score").alias("best_score"))
    found = papers.select("paper_id", "title").join(F.broadcast(best), "paper_id")  # a few lists of k rows
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("best_score"), "paper_id")))


def entity_summaries(entities: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities with the paper's title, the section and the text they come from.

    ``papers(paper_id, paper_title)``, ``chunks(chunk_id, section_title, text)``; a section without
    a title goes by its id (:func:`section_titles`)."""
    rows = entities.join(papers, "paper_id")
    return rows.join(chunks.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left")


def section_titles(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, section_id, section_title): the section's title, else its id; ``sections(section_id, title)``."""
    one = sections.where("title <> ''").groupBy("section_id").agg(F.min("title").alias("title"))
    return chunks.select("chunk_id", "section_id").join(one, "section_id", "left").select("chunk_id", "section_id", F.coalesce("title", "section_id").alias("section_title"))


def by_confidence(entities: DataFrame) -> DataFrame:
    """``position`` of each entity within its type, the surest first."""
    w = Window.partitionBy("entity_type").orderBy(F.desc_nulls_last("confidence"), "entity_id", "paper_id", "label")
    return entities.withColumn("position", F.row_number().over(w))


def by_type_and_label(entities: DataFrame) -> DataFrame:
    """``position`` of each entity within its paper, by type and label."""
    w = Window.partitionBy("paper_id").orderBy("entity_type", F.lower("label"), "entity_id")
    return entities.withColumn("position", F.row_number().over(w))


def citation_summaries(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations with the titles of both ends, else the labels of the edge; ``papers(paper_id, title)``."""
    one = papers.groupBy("paper_id").agg(F.max("title").alias("title"))
    side = lambda s: one.select(F.col("paper_id").alias(f"{s}_node_id"), F.col("title").alias(f"{s}_title"))
    e = edges.join(side("source"), "source_node_id", "left").join(side("target"), "target_node_id", "left")
    return e.select(
        "relation_type", "confidence", "evidence", F.col("source_node_id").alias("source_paper_id"), F.coalesce("source_title", "source_label").alias("source_paper_title"),
        F.col("target_node_id").alias("target_paper_id"), F.coalesce("target_title", "target_label").alias("target_paper_title"),
    )


#: The bundle of a corpus without papers.
EMPTY_BUNDLE = {"text_hits": [], "table_hits": [], "figure_hits": [], "papers": [], "entities": {}, "citations": [], "stats": dict.fromkeys(("paper_count", "chunk_count", "table_count", "figure_count", "entity_count", "citation_count", "matched_papers"), 0)}


def bundle(query: str, parts: dict[str, DataFrame]) -> dict:
    """A bundle as plain values; every part is a short list (a few times k rows) by its construction.

    ``parts`` may hold text_hits, table_hits, figure_hits, papers, entities (with entity_type),
    citations and stats (one row). Without papers the bundle is empty."""
    rows = lambda name: [r.asDict(recursive=True) for r in parts[name].collect()] if name in parts else []
    stats = (rows("stats") or [EMPTY_BUNDLE["stats"]])[0]
    if not stats.get("paper_count", 0):
        return {"query": query, **EMPTY_BUNDLE}
    entities: dict[str, list] = {}
    for e in rows("entities"):
        entities.setdefault(e["entity_type"], []).append(e)
    return {"query": query, **{n: rows(n) for n in ("text_hits", "table_hits", "figure_hits", "papers", "citations")}, "entities": entities, "stats": stats}
