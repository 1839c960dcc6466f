"""Search over tables and figures, context texts, quality figures and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import ranking as R


def search_tables(tables: DataFrame, query: str, vector: list[float], k: int) -> DataFrame:
    """``tables(table_id, label, caption, text, vec)`` by vector, words, caption, exact label and size."""
    label_hit = F.contains(F.lit(f" {' '.join(_tokens(query))} "), F.concat(F.lit(" "), T.label_key(F.col("label")), F.lit(" "))) & (T.label_key(F.col("label")) != "")
    score = R.hybrid_table_score(V.dot(F.col("vec"), V.literal(vector)), T.lexical_overlap(query, F.col("text")), T.lexical_overlap(query, F.col("caption")), label_hit, T.word_count(F.coalesce("text", F.lit(""))))
    return R.top_k(tables.where(F.size("vec") == len(vector)).withColumn("score", score), k, "table_id")


def search_figures(figures: DataFrame, query: str, vector: list[float], k: int) -> DataFrame:
    """``figures(figure_id, label, caption, text, vec)``."""
    label_hit = F.contains(F.lit(f" {' '.join(_tokens(query))} "), F.concat(F.lit(" "), T.label_key(F.col("label")), F.lit(" "))) & (T.label_key(F.col("label")) != "")
    score = R.hybrid_figure_score(V.dot(F.col("vec"), V.literal(vector)), T.lexical_overlap(query, F.col("text")), T.lexical_overlap(query, F.col("caption")), label_hit)
    return R.top_k(figures.where(F.size("vec") == len(vector)).withColumn("score", score), k, "figure_id")


def _tokens(query: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall(T.TOKEN, query)]


def dataset_line(names: Column) -> Column:
    """One name as it is, two as a comparison, more as a list."""
    return F.when(F.size(names) == 2, F.array_join(names, " vs. ")).otherwise(F.array_join(names, "; "))


def graph_context(nodes: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, context): the first ``most`` nodes as ``label (type)``; ``nodes(key, label, node_type)``.

    A rank keeps the first ones before they are gathered, so no list grows."""
    r = F.row_number().over(Window.partitionBy(key).orderBy("label", "node_type"))
    first = nodes.withColumn("_r", r).where(F.col("_r") <= most)
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "node_type"))), lambda x: F.concat(x["label"], F.lit(" ("), x["node_type"], F.lit(")"))), ", ").alias("context"))


def base_confidence(passages: Column, most: int) -> Column:
    return F.bround(F.least(passages / most, F.lit(1.0)) * 0.8 + 0.2, 3)


def recall_at_k(ranked: DataFrame, relevant: DataFrame, group: str, k: int) -> DataFrame:
    """(group, recall): share of the relevant keys among the first k; ``ranked(group, key, rank)``."""
    top = ranked.where(F.col("rank") <= k).select(group, "key").distinct().withColumn("hit", F.lit(1))
    return relevant.select(group, "key").distinct().join(top, [group, "key"], "left").groupBy(group).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def merge_nodes(edges: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Edges with absorbed ids replaced by the kept ones; loops and repeats go.

    ``absorbed(old, kept)`` once an old id."""
    a, b = absorbed.select(F.col("old").alias("o1"), F.col("kept").alias("k1")), absorbed.select(F.col("old").alias("o2"), F.col("kept").alias("k2"))
    out = edges.join(a, edges["src"] == F.col("o1"), "left").join(b, edges["dst"] == F.col("o2"), "left")
    return out.select(F.coalesce("k1", "src").alias("src"), "relation", F.coalesce("k2", "dst").alias("dst")).where("src <> dst").distinct()


def authority(similarity: Column, rank: Column, citations: Column) -> Column:
    """Similarity weighted with graph rank and citations."""
    return 0.6 * similarity + 0.2 * F.coalesce(rank, F.lit(0.0)) + 0.2 * F.least(F.coalesce(citations, F.lit(0)) / 10.0, F.lit(1.0))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables as Parquet, split by type so that a reader of one type skips the rest."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
