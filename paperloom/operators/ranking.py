"""Lexical, vector and hybrid ranking, rank fusion, and the context budget.

Statistics cover all documents. A query is a parameter, so its terms are literals: scoring is one
scan with a map-side aggregate, and a top-k is ``TakeOrderedAndProject``. No ranking gathers more
than k rows a source anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V

K1, B, RRF_K = 1.5, 0.75, 60


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(T.ranking_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, idf) over all documents."""
    n = F.lit(float(max(1, docs.count())))
    df = docs.select(F.explode(F.array_distinct(T.ranking_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(query: str) -> list[str]:
    """The query's ranking tokens, repeated ones repeated."""
    import re

    return [t for t in (x.lower() for x in re.findall(T.TOKEN, query)) if len(t) > 2 and t not in T.RANKING_STOPWORDS]


def bm25_scores(docs: DataFrame, key: str, text: str, query: str, where: Column | None = None) -> DataFrame:
    """(key, score) of every document, 0 where no term occurs; repeated query terms add again.

    One pass gives document count, mean length and the frequencies of the query's terms; the
    second scores each row from its own tokens. ``where`` filters before ranking, after statistics."""
    terms = query_terms(query)
    toks = T.ranking_tokens(F.col(text))
    stats = docs.select(toks.alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("length"),
        *[F.count_if(F.array_contains("t", t)).alias(f"df{i}") for i, t in enumerate(dict.fromkeys(terms))],
    ).first()
    n = max(1, stats["n"])
    average = stats["length"] / n
    rows = docs.where(where) if where is not None else docs
    rows = rows.withColumn("_t", toks)
    score = F.lit(0.0)

    def count_of(term: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == term))

    for i, t in enumerate(dict.fromkeys(terms)):
        df = stats[f"df{i}"]
        idf = F.log(F.lit(1.0) + F.lit((n - df + 0.5) / (df + 0.5)))
        tf = count_of(t)
        length = F.size("_t") / F.lit(average or 1.0)
        score = score + terms.count(t) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    return rows.withColumn("score", score).drop("_t")


def build_postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of a corpus, to be kept: (term, key, tf, length, df), and one row (n, average).

    A query then reads the postings of its own terms only; written by :func:`write_index` they lie
    together by a hash of the term, sorted, so that a scan of a few terms skips the rest."""
    tokens = docs.select(F.col(key).alias("key"), T.ranking_tokens(F.col(text)).alias("t"))
    length = tokens.select("key", F.size("t").alias("length"), "t")
    tf = length.select("key", "length", F.explode("t").alias("term")).groupBy("term", "key", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("average"))
    return tf.join(df, "term"), stats


#: Files' worth of terms: postings are written in this many groups by a hash of the term.
TERM_GROUPS = 64


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    postings, stats = build_postings(docs, key, text)
    grouped = postings.withColumn("term_group", F.pmod(F.xxhash64("term"), F.lit(TERM_GROUPS)).cast("int"))
    # A frequent term is spread over several tasks of its group.
    dealt = grouped.repartition("term_group", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("term")
    dealt.write.mode("overwrite").partitionBy("term_group").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/statistics")


def read_index(spark, path: str, query: str) -> tuple[DataFrame, DataFrame]:
    """The postings of a query's terms (only their groups are read), and the statistics."""
    terms = list(dict.fromkeys(query_terms(query)))
    asked = [F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_GROUPS)).cast("int") for t in terms]
    postings = spark.read.parquet(f"{path}/postings")
    return (postings.where(F.col("term_group").isin(*asked)) if terms else postings.limit(0)), spark.read.parquet(f"{path}/statistics")


def bm25_from_postings(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(key, score) of the documents that hold a term of the query."""
    times = {t: query_terms(query).count(t) for t in query_terms(query)}
    if not times:
        return postings.select("key", F.lit(0.0).alias("score")).limit(0)
    weight = F.element_at(F.create_map(*[x for t, n in times.items() for x in (F.lit(t), F.lit(float(n)))]), F.col("term"))
    p = postings.where(F.col("term").isin(list(times))).join(F.broadcast(stats))  # one row
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("average"), F.lit(1e-9))))
    return p.groupBy("key").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, *ties: Column | str, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), *ties).limit(k)


def vector_scores(docs: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """Adds ``score``: the dot product with the query vector; rows of other lengths are left out."""
    same = F.size(vector) == len(query)  # asked again, as a filter on the score may be put before this one
    return docs.where(same).withColumn("score", F.when(same, V.dot(F.col(vector), V.literal(query))))


def hybrid_chunk_score(similarity: Column, overlap: Column, salience: Column) -> Column:
    return 0.65 * similarity + 0.25 * overlap + 0.10 * F.coalesce(salience, F.lit(0.0))


def hybrid_table_score(similarity: Column, overlap: Column, caption_overlap: Column, label_hit: Column, word_count: Column) -> Column:
    return 0.45 * similarity + 0.20 * overlap + 0.15 * caption_overlap + 0.25 * label_hit.cast("double") + 0.10 * F.least(word_count / 120.0, F.lit(1.0))


def hybrid_figure_score(similarity: Column, overlap: Column, caption_overlap: Column, label_hit: Column) -> Column:
    return 0.48 * similarity + 0.22 * overlap + 0.20 * caption_overlap + 0.25 * label_hit.cast("double")


def ranked(source: DataFrame, name: str, group: list[str], key: str, score: str, *ties: str, limit: int | None = None) -> DataFrame:
    """(group, key, source, rank, score) with ranks from 1."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *ties, key))
    out = source.select(*group, F.col(key).alias("key"), F.lit(name).alias("source"), r.alias("rank"), F.col(score).alias("score"))
    return out.where(F.col("rank") <= limit) if limit else out


def reciprocal_ranks(hits: DataFrame, group: list[str], k: int = RRF_K) -> DataFrame:
    """Fuse (group, key, source, rank, score): the sum of 1 / (k + rank), and each source's score.

    Union and one aggregation instead of full outer joins; partial sums run map-side."""
    return hits.groupBy(*group, "key").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("sources"), F.max("score").alias("best_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("source_scores"),
    )


def fused_order() -> list[Column]:
    """The order of fused passages: value, number of sources, best score, titles, key."""
    return [F.desc(F.round("rrf", 12)), F.desc("sources"), F.desc("best_score"), F.asc("paper_title"), F.asc("section_title"), F.asc("key")]


def context_budget(blocks: DataFrame, group: list[str], order: str, text: str, most: int) -> DataFrame:
    """Blocks in order until ``most`` words; the last one is cut, and nothing follows it."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = blocks.withColumn("_n", T.spaced_words(F.col(text))).withColumn("_before", before).where(F.col("_before") < most)
    left = F.lit(most) - F.col("_before")
    return counted.withColumn("kept_text", F.when(F.col("_n") <= left, F.col(text)).otherwise(T.cut_words(F.col(text), left.cast("int")))).withColumn("kept_words", F.least("_n", left)).drop("_n", "_before")
