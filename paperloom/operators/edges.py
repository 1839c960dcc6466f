"""Citation and semantic edges between papers, claims, chunks, datasets and metrics.

Edges are (edge_id, relation_type, source_node_id, source_node_type, source_label,
target_node_id, target_node_type, target_label, confidence, source_chunk_id, evidence).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.session import dropped, settled, shuffle_width

# Cues looked for as parts of two claims' texts.
SUPPORT_CUES = ["support", "supports", "supported", "consistent with", "in line with", "confirms", "confirm", "demonstrates", "demonstrate", "indicates", "indicate", "improves", "improve", "increases", "increase", "higher", "better"]
CONTRADICT_CUES = ["contradict", "contradicts", "contradiction", "in contrast", "however", "yet", "but", "fails", "fail", "decreases", "decrease", "reduces", "reduce", "negative", "collapse", "limitation", "limited", "not"]


def edge(relation: str | Column, prefix: str, source: tuple, target: tuple, confidence: Column, chunk: Column, evidence: Column, *key: Column) -> list[Column]:
    """The columns of an edge; source and target are (id, type, label)."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        T.stable_id(prefix, *key).alias("edge_id"), c(relation).alias("relation_type"), source[0].alias("source_node_id"), c(source[1]).alias("source_node_type"), source[2].alias("source_label"),
        target[0].alias("target_node_id"), c(target[1]).alias("target_node_type"), target[2].alias("target_label"), confidence.alias("confidence"), chunk.alias("source_chunk_id"), evidence.alias("evidence"),
    ]


def citations(references: DataFrame, papers: DataFrame) -> DataFrame:
    """References to papers by DOI, else by title, else to a stub; no paper cites itself.

    ``references(reference_id, paper_id, title, doi, label, source_text)``,
    ``papers(paper_id, title, doi)``. Of several papers with one DOI or title the last id stands.
    Both lookups are equi-joins on aggregated keys, so a reference never multiplies."""
    doi = F.coalesce(F.nullif(F.lower(F.trim("doi")), F.lit("")), T.doi_in(F.col("source_text")))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.trim(F.substring_index("source_text", ".", 1)), F.lit("")))
    refs = references.select("reference_id", F.col("paper_id").alias("source_id"), doi.alias("r_doi"), title.alias("r_title"), "label", "source_text").withColumn("t_key", T.title_key(F.col("r_title")))
    by_doi = papers.where(F.trim("doi") != "").groupBy(F.lower("doi").alias("r_doi")).agg(F.max_by(F.struct("paper_id", "title", "doi"), "paper_id").alias("d"))
    by_title = papers.groupBy(T.title_key(F.col("title")).alias("t_key")).agg(F.max_by(F.struct("paper_id", "title", "doi"), "paper_id").alias("t"))
    names = papers.groupBy("paper_id").agg(F.max("title").alias("source_title"))
    m = refs.join(by_doi, "r_doi", "left").join(by_title, "t_key", "left").withColumn("hit", F.coalesce("d", "t")).join(names, F.col("source_id") == names["paper_id"], "left")
    m = m.where(F.col("hit").isNull() | (F.col("hit.paper_id") != F.col("source_id")))
    stub = T.stable_id("refpaper", F.coalesce("r_doi", F.nullif(F.col("t_key"), F.lit("")), T.title_key(F.col("reference_id"))))
    target = F.coalesce("hit.paper_id", stub)
    confidence = F.when(F.col("hit").isNull(), 0.72).when(F.col("hit.doi") == F.lower("hit.doi"), 0.99).otherwise(0.88)
    return m.select(
        *edge("CITES", "cite", (F.col("source_id"), "Paper", F.col("source_title")), (target, "Paper", F.coalesce("hit.title", "r_title", "label", target)), confidence, F.lit(""), F.coalesce("source_text", "r_title", F.lit("")), F.col("source_id"), target, F.col("reference_id")),
        F.col("hit").isNull().alias("is_stub_target"),
    )


def count_cues(text: Column, cues: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(text, c)))


def relation(left: Column, right: Column, similarity: Column) -> Column:
    """struct(relation, confidence) of two claim texts; null where there is none."""
    both = F.lower(F.concat_ws(" ", left, right))
    c, h = count_cues(both, CONTRADICT_CUES), count_cues(both, SUPPORT_CUES)
    clip = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)
    made = lambda name, x: F.struct(F.lit(name).alias("relation"), clip(x).alias("confidence"))
    return (
        F.when(similarity < 0.74, None).when(c > h, made("CONTRADICTS", 0.52 + 0.38 * similarity + 0.05 * c)).when(h > 0, made("SUPPORTS", 0.50 + 0.40 * similarity + 0.04 * h))
        .when(similarity >= 0.9, made("SUPPORTS", 0.45 + 0.45 * similarity))
    )


#: Vectors up to which every one meets every other; vectors of a cell.
ALL_MEET, CELL = 200_000, 20_000
#: Rows of hashed vectors that are moved at a time.
MOVED = 4_000_000
#: Seconds of a core to multiply two vectors and to move one, roughly.
_MULTIPLIED, _MOVED = 7e-9, 5e-6


def _agreement(rows: int, threshold: float) -> float:
    """The probability, a little less, that the largest of so many random projections is the same one
    with the same sign for two vectors with that cosine. It depends on nothing else."""
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 40_000, rows))
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
    top = np.abs(x).argmax(axis=1)
    at = np.arange(len(x))
    p = float(((top == np.abs(y).argmax(axis=1)) & ((x[at, top] > 0) == (y[at, top] > 0))).mean())
    return max(1e-3, p - 4 * np.sqrt(p * (1 - p) / len(x)))


def tables_for(n: int, threshold: float, miss: float = 1e-6) -> tuple[list[int], int]:
    """(projections of each part of a hash, number of hash tables): what costs least, so that a pair at
    the threshold is missed with probability ``miss``. No part: all meet in one table, none is missed."""
    if n <= ALL_MEET or threshold <= 0.1:
        return [], 1
    chance = {m: _agreement(m, threshold) for m in (4, 8, 16, 32, 64)}
    best: list[tuple[float, list[int], int]] = []
    for parts in [[*[64] * k, *last] for k in range(4) for last in ([], [4], [8], [16], [32])]:
        if parts:
            p = float(np.prod([chance[m] for m in parts]))
            tables = int(np.ceil(np.log(miss) / np.log1p(-p)))
            best.append((tables * (n / np.prod([2.0 * m for m in parts]) / 2 * _MULTIPLIED + _MOVED), parts, tables))
    return min(best)[1:]


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as half floats; all have one length."""
    for b in batches:
        if b.num_rows:
            x = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "half"])


def _floats(halves: pa.Array | list) -> np.ndarray:
    values = halves.to_pylist() if isinstance(halves, pa.Array) else halves
    return np.frombuffer(b"".join(values), dtype=np.float16).reshape(len(values), -1).astype(np.float32)


def _hashed(parts: list[int], tables: list[int], seed: int):
    """The bucket of each vector in each of these tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b["half"])
            for t in tables:
                if t not in planes:
                    planes[t] = np.random.default_rng([seed, t]).standard_normal((x.shape[1], sum(parts))).astype(np.float32)
                y, bucket, at = x @ planes[t], np.full(len(x), t, dtype=np.int64), 0
                for m in parts:
                    part = y[:, at : at + m]
                    top = np.abs(part).argmax(axis=1)
                    bucket = bucket * (2 * m) + 2 * top + (part[np.arange(len(x)), top] > 0)
                    at += m
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b["id"], b["half"]], ["bucket", "id", "half"])

    return run


def _meeting(threshold: float, kind: pa.DataType, block: int = 2048):
    """(a, b) of rows sorted by (bucket, low, high) that may have that dot product: the rows of the cells
    ``low`` and ``high`` of a bucket, each of one with each of the other."""
    # Two half floats of unit vectors are off by less than that.
    least = np.float32(threshold - 0.002)

    def pairs(ids: list, halves: list, cells: list, one: bool) -> Iterator[pa.RecordBatch]:
        cell = np.array(cells)
        of = (slice(None), slice(None)) if one else (cell == cell.min(), cell != cell.min())
        x, names = _floats(halves), np.arange(len(ids))
        (left, l_at), (right, r_at) = ((x[s], names[s]) for s in of)
        for i in range(0, len(left), block):
            for j in range(i if one else 0, len(right), block):
                # Not "at least": a product that is no number counts as the largest one in a comparison.
                p, q = np.nonzero(~(left[i : i + block] @ right[j : j + block].T < least))
                p, q = l_at[i + p], r_at[j + q]
                if one:
                    p, q = p[p < q], q[p < q]
                for s in range(0, len(p), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in p[s : s + 50_000]], kind), pa.array([ids[k] for k in q[s : s + 50_000]], kind)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        for b in batches:
            for bucket, low, high, *row in zip(*(b[c].to_pylist() for c in ("bucket", "low", "high", "id", "half", "cell"))):
                if (bucket, low, high) != at:
                    if len(held[0]) > 1:
                        yield from pairs(*held, at[1] == at[2])
                    at, held = (bucket, low, high), ([], [], [])
                for to, value in zip(held, row):
                    to.append(value)
        if len(held[0]) > 1:
            yield from pairs(*held, at[1] == at[2])

    return run


def similar_pairs(vectors: DataFrame, threshold: float, seed: int = 5) -> DataFrame:
    """(a, b, similarity) of ``vectors(id, vec)`` of unit length with at least that dot product, a < b.

    Up to ``ALL_MEET`` vectors every pair is looked at. More meet in the buckets of hash tables
    (:func:`tables_for`): a part of a hash is the largest of random projections with its sign. Vectors
    move as half floats, some tables at a time, whose files go when they are over, and a large bucket is
    dealt out in cells; the exact product of the whole vectors decides."""
    width, kind = shuffle_width(vectors.sparkSession), vectors.schema["id"].dataType
    rows = settled(vectors.select("id", "vec"))
    small = settled(rows.mapInArrow(_halved, f"id {kind.simpleString()}, half binary"))
    n = small.count()
    parts, tables = tables_for(n, threshold)
    # A few vectors are dealt out too, for the cores.
    all_cells = max(-(-n // CELL), min(4, -(-n // 2_000)), 1)
    found = []
    for at in range(0, tables, step := max(1, MOVED // max(n, 1))):
        if parts:
            keyed = small.mapInArrow(_hashed(parts, list(range(at, min(at + step, tables))), seed), f"bucket bigint, id {kind.simpleString()}, half binary")
            large = settled(keyed.groupBy(F.col("bucket").alias("big")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).where("cells > 1"))
            keyed = keyed.join(large, F.col("bucket") == F.col("big"), "left").drop("big") if large.limit(1).count() else keyed.withColumn("cells", F.lit(1))
        else:
            keyed = small.select(F.lit(0).cast("bigint").alias("bucket"), "id", "half", F.lit(all_cells).alias("cells"))
        dealt = keyed.withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
        other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        cells = other.select("bucket", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "id", "half")
        if parts:
            cells = cells.repartition(width, "bucket", "low", "high")
        else:
            # Two cells, or one, a task.
            cells = cells.repartitionById(all_cells * (all_cells + 1) // 2, (F.col("high") * (F.col("high") + 1) / 2).cast("int") + F.col("low"))
        met = cells.sortWithinPartitions("bucket", "low", "high").mapInArrow(_meeting(threshold, to_arrow_type(kind)), f"a {kind.simpleString()}, b {kind.simpleString()}")
        found.append(settled(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()))
        if parts:
            dropped(large)
    dropped(small)
    met = found[0] if len(found) == 1 else reduce(DataFrame.union, found).distinct()
    side = lambda s: rows.select(F.col("id").alias(s), F.col("vec").alias(f"vec_{s}"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", V.dot(F.col("vec_a"), F.col("vec_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def claim_edges(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """SUPPORTS and CONTRADICTS between claims of different papers.

    ``claims(id, paper_id, text, chunk_id)``, ``pairs(a, b, similarity)``."""
    side = lambda s: claims.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("paper_id", "text", "chunk_id")])
    m = pairs.join(side("a"), "a").join(side("b"), "b").where("a_paper_id <> b_paper_id").withColumn("r", relation(F.col("a_text"), F.col("b_text"), F.col("similarity"))).where("r is not null")
    s = lambda c: F.col(c).cast("string")
    return m.select(*edge(F.col("r.relation"), "claimrel", (s("a"), "Claim", F.col("a_text")), (s("b"), "Claim", F.col("b_text")), F.col("r.confidence"), F.col("a_chunk_id"), F.col("a_text"), F.col("r.relation"), s("a"), s("b")))


def is_a(entities: DataFrame, hierarchy: DataFrame, most: int = 3) -> DataFrame:
    """Entity to parent term in the same paper, by label or alias; the first ``most`` parents.

    ``entities(paper_id, entity_id, entity_type, label, aliases, confidence)``,
    ``hierarchy(term, ontology_rank, parents array)``."""
    rows = entities.where(~F.lower("entity_type").isin("claim", "result", "equation")).groupBy("paper_id", "entity_id").agg(F.min(F.lower("entity_type")).alias("entity_type"), F.min(T.collapse(F.lower("label"))).alias("label"), F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"))
    named = rows.select("paper_id", "entity_id", "entity_type", "label", F.explode(F.array_distinct(F.concat(F.array("label"), F.transform("aliases", lambda a: T.collapse(F.lower(a)))))).alias("name"))
    up = hierarchy.select(T.collapse(F.lower("term")).alias("term"), "ontology_rank", F.posexplode("parents").alias("position", "parent")).withColumn("parent", T.collapse(F.lower("parent"))).where("parent <> ''")
    first = up.groupBy("term", "parent").agg(F.min(F.struct("ontology_rank", "position")).alias("o"))
    r = F.row_number().over(Window.partitionBy("term").orderBy("o", "parent"))
    parents = first.withColumn("r", r).where(F.col("r") <= most).select("term", "parent")
    child = rows.join(parents, F.col("label") == F.col("term")).select("paper_id", F.col("entity_id").alias("c_id"), F.col("entity_type").alias("c_type"), F.col("label").alias("c_label"), "parent")
    target = named.select("paper_id", F.col("entity_id").alias("p_id"), F.col("entity_type").alias("p_type"), F.col("label").alias("p_label"), F.col("name").alias("parent"))
    m = child.join(target, ["paper_id", "parent"]).where("c_id <> p_id")
    e = m.select(*edge("IS_A", "isa", (F.col("c_id"), F.initcap("c_type"), F.col("c_label")), (F.col("p_id"), F.initcap("p_type"), F.col("p_label")), F.lit(0.8), F.lit(""), F.concat_ws(" is a ", "c_label", "parent"), F.col("c_id"), F.col("p_id")))
    return e.groupBy("edge_id").agg(*[F.min(c).alias(c) for c in e.columns if c != "edge_id"])


def grounded_in(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claim to the chunk it was taken from, in the same paper."""
    c = chunks.groupBy("paper_id", "chunk_id").agg(F.min("text").alias("c_text"))
    m = entities.where(F.lower("entity_type") == "claim").join(c, (entities["source_chunk_id"] == c["chunk_id"]) & (entities["paper_id"] == c["paper_id"]))
    e = m.select(*edge("GROUNDED_IN", "grounded", (F.col("entity_id"), "Claim", T.collapse(F.lower("label"))), (F.col("chunk_id"), "Chunk", F.col("chunk_id")), F.lit(1.0), F.col("chunk_id"), F.substring("c_text", 1, 200), F.col("entity_id"), F.col("chunk_id")))
    return e.groupBy("edge_id").agg(*[F.min(x).alias(x) for x in e.columns if x != "edge_id"])


def measured_on(results: DataFrame) -> DataFrame:
    """Result to each of its datasets (``dataset`` may list several, by ``;``)."""
    m = results.select("*", F.explode(F.filter(F.transform(F.split("dataset", ";"), lambda x: F.trim(x)), lambda d: d != "")).alias("d"))
    e = m.select(*edge("MEASURED_ON", "measured", (F.col("entity_id"), "Result", T.collapse(F.lower("label"))), (T.stable_id("dataset", F.lower("d")), "Dataset", F.lower("d")), F.lit(0.7), F.col("source_chunk_id"), F.coalesce("text", F.lit("")), F.col("entity_id"), F.lower("d")))
    return e.groupBy("edge_id").agg(*[F.min(x).alias(x) for x in e.columns if x != "edge_id"])


def using_metric(results: DataFrame) -> DataFrame:
    """Result to its metric; a metric's node id keeps the first 20 characters of its name."""
    m = results.where(F.trim("metric") != "")
    node = F.concat(F.lit("metric-"), T.slug(F.substring(F.lower("metric"), 1, 20)))
    e = m.select(*edge("USING_METRIC", "metric", (F.col("entity_id"), "Result", T.collapse(F.lower("label"))), (node, "Metric", F.lower("metric")), F.lit(0.7), F.col("source_chunk_id"), F.coalesce("text", F.lit("")), F.col("entity_id"), node))
    return e.groupBy("edge_id").agg(*[F.min(x).alias(x) for x in e.columns if x != "edge_id"])


def union_edges(*parts: DataFrame) -> DataFrame:
    keep = ["edge_id", "relation_type", "source_node_id", "source_node_type", "source_label", "target_node_id", "target_node_type", "target_label", "confidence", "source_chunk_id", "evidence"]
    return reduce(DataFrame.unionByName, [p.select(*keep) for p in parts])


def existing_ends(edges: DataFrame, nodes: DataFrame, source: bool = True, target: bool = True) -> DataFrame:
    """Edges whose ends are nodes; ``nodes(node_id)`` need not be distinct."""
    ids = nodes.select("node_id").distinct()
    if source:
        edges = edges.join(ids, edges["source_node_id"] == ids["node_id"], "left_semi")
    if target:
        edges = edges.join(ids, edges["target_node_id"] == ids["node_id"], "left_semi")
    return edges
