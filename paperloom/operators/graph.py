"""Property-graph operators on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut, shuffle_width


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) of the directed ``edges(src, dst)``; dangling mass is spread evenly.

    Edges with their source's out-degree are partitioned by source once and kept so; a round shuffles
    the ranks and the sums that flow to each target (map-side sums first, so a node of any in-degree
    is no hot key), never the edges. The dangling mass of a round is one row. Lineage is cut in
    reliable storage every round."""
    width = shuffle_width(edges.sparkSession)
    distinct = edges.select("src", "dst").distinct()
    degree = distinct.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = distinct.join(degree, "src").repartition(width, "src").persist()
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(degree.withColumnRenamed("src", "node"), "node", "left").repartition(width, "node").persist()
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"), F.col("degree").isNull().alias("dangling"))
    for _ in range(iterations):
        flow = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("inflow"))
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost")))  # one row
        ranks = nodes.join(flow, nodes["node"] == flow["dst"], "left").join(lost).select(
            "node", (F.lit((1 - damping) / n) + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), F.col("degree").isNull().alias("dangling")
        )
        ranks = cut(ranks)  # nodes only; the next round starts from storage
    for x in (links, nodes):
        x.unpersist()
    return ranks.select("node", "rank")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, distance): undirected, the least distance up to ``hops``; each round only new nodes go on.

    ``edges(src, dst)``, ``seeds(node)``; blank seeds are left out. The edges are read once."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct()
    if hops > 1:
        both = cut(both)
    found = cut(seeds.where(F.trim(F.col("node").cast("string")) != "").select("node").distinct().withColumn("distance", F.lit(0)))
    for h in range(1, max(0, hops) + 1):
        frontier = found.where(F.col("distance") == h - 1)
        fresh = both.join(frontier, both["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(h))
        found = cut(found.unionByName(fresh))
    return found


def traversed_edges(edges: DataFrame, found: DataFrame, hops: int) -> DataFrame:
    """Edges both of whose ends were found and one of them before the last hop."""
    a = found.select(F.col("node").alias("src"), F.col("distance").alias("da"))
    b = found.select(F.col("node").alias("dst"), F.col("distance").alias("db"))
    return edges.join(a, "src").join(b, "dst").where(F.least("da", "db") < hops).drop("da", "db")


def mentions(entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): distinct mentions."""
    return entities.select(F.explode("mention_chunk_ids").alias("chunk_id"), "entity_id").where("chunk_id is not null").distinct()


def mentioning_chunks(mention: DataFrame, chunks: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """(chunk_id, mention_count, salience) of the chunks that mention any of the entities."""
    m = mention.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("mention_count"))
    s = chunks.groupBy("chunk_id").agg(F.max(F.coalesce("salience_score", F.lit(0.0))).alias("salience"))
    return m.join(s, "chunk_id")


def claim_provenance(grounded: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Claim to chunk to section to paper."""
    c = chunks.groupBy("chunk_id").agg(F.max("section_id").alias("section_id"), F.max("paper_id").alias("paper_id"))
    p = papers.groupBy("paper_id").agg(F.max("title").alias("title"))
    return grounded.select(F.col("source_node_id").alias("claim_id"), F.col("target_node_id").alias("chunk_id")).join(c, "chunk_id").join(p, "paper_id").select("claim_id", "chunk_id", "section_id", "paper_id", "title")


def related_claims(edges: DataFrame, relation: str | None = None, most: int = 10) -> DataFrame:
    """(claim_id, related_id, relation_type, confidence): both directions, the strongest first."""
    e = edges.where(F.col("relation_type").isin([relation] if relation else ["SUPPORTS", "CONTRADICTS"]))
    one = e.select(F.col("source_node_id").alias("claim_id"), F.col("target_node_id").alias("related_id"), "relation_type", "confidence")
    both = one.unionByName(e.select(F.col("target_node_id").alias("claim_id"), F.col("source_node_id").alias("related_id"), "relation_type", "confidence"))
    r = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("confidence"), "related_id", "relation_type"))
    return both.withColumn("r", r).where(F.col("r") <= most).drop("r")


def node_tables(papers: DataFrame, chunks: DataFrame, entities: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """(node_id, node_type, label): papers, sections, chunks, journals, entities (datasets and the rest
    by their type) and, if given, authors; unique by id within a type, the last load wins."""
    p = papers.groupBy(F.col("paper_id").alias("node_id")).agg(F.lit("Paper").alias("node_type"), F.max_by("title", "ingested_at").alias("label"))
    s = chunks.groupBy(F.col("section_id").alias("node_id")).agg(F.lit("Section").alias("node_type"), F.max("section_id").alias("label"))
    c = chunks.groupBy(F.col("chunk_id").alias("node_id")).agg(F.lit("Chunk").alias("node_type"), F.max("chunk_id").alias("label"))
    j = papers.where("journal.journal_id is not null").groupBy(F.col("journal.journal_id").alias("node_id")).agg(F.lit("Journal").alias("node_type"), F.max("journal.name").alias("label"))
    e = entities.groupBy(F.col("entity_id").alias("node_id")).agg(F.initcap(F.min(F.lower(F.trim("entity_type")))).alias("node_type"), F.min(F.lower(F.trim("label"))).alias("label"))
    out = p.unionByName(s).unionByName(c).unionByName(j).unionByName(e)
    if authors is not None:
        out = out.unionByName(authors.where("author_id is not null").groupBy(F.col("author_id").alias("node_id")).agg(F.lit("Author").alias("node_type"), F.max("full_name").alias("label")))
    return out


def constraint_violations(nodes: DataFrame) -> DataFrame:
    """(node_type, nodes, violations): how many rows of a type share an id with another of it."""
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) - F.count_distinct("node_id")).alias("violations"))


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, label): targets of edges that no node stands for yet, once each."""
    known = nodes.select("node_id").distinct()
    ends = edges.select(F.col("target_node_id").alias("node_id"), F.col("target_node_type").alias("node_type"), F.col("target_label").alias("label")).where("node_id is not null")
    return ends.join(known, "node_id", "left_anti").groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"))


def structure_edges(chunks: DataFrame, papers: DataFrame, authors: DataFrame) -> DataFrame:
    """(src, relation, dst): HAS_SECTION, HAS_CHUNK, NEXT, PUBLISHED_IN and AUTHORED_BY."""
    pick = lambda df, a, rel, b: df.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("src"), F.lit(rel).alias("relation"), F.col(b).alias("dst"))
    j = papers.select("paper_id", F.col("journal.journal_id").alias("journal_id"))
    return (
        pick(chunks, "paper_id", "HAS_SECTION", "section_id").unionByName(pick(chunks, "section_id", "HAS_CHUNK", "chunk_id")).unionByName(pick(chunks, "chunk_id", "NEXT", "next_chunk_id"))
        .unionByName(pick(j, "paper_id", "PUBLISHED_IN", "journal_id")).unionByName(pick(authors, "paper_id", "AUTHORED_BY", "author_id")).distinct()
    )
