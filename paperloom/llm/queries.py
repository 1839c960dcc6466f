"""Queries of the corpus problems, added by ``__spark_entry__`` where this package is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chunker, encode, forest, fuse, mapping, mixture, names, pii
from paperloom.session import cut, spread, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fuse.first_passages(table(spark, d, "passages"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fused_passages(table(spark, d, "passages")).select("query_id", "item", (F.round("value", 6) + 0.0).alias("value"), "returned_by")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunker.split_items(table(spark, d, "bm25_documents"), "chunk_id", "text", "profile", table(spark, d, "chunk_settings"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that the operator had to cut."""
    return _pieces(spark, d).where("piece > 0").select(F.col("item_id").alias("chunk_id")).distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p7_cover(spark: SparkSession, d: str) -> DataFrame:
    """The words of each item, told from its pieces: their words without the repeated ones."""
    rules = table(spark, d, "chunk_settings").select(F.lower(F.trim("profile")).alias("p"), "chunk_size_words", "chunk_overlap_words")
    overlap = F.least("chunk_overlap_words", F.col("chunk_size_words") - 1)
    rules = rules.select("p", overlap.alias("overlap"))
    default = rules.where("p = 'default'").select(F.col("overlap").alias("usual"))
    own = F.coalesce(F.nullif(F.lower(F.trim("profile")), F.lit("")), F.lit("default"))
    repeated = table(spark, d, "bm25_documents").select("chunk_id", own.alias("p")).distinct().join(rules, "p", "left").join(F.broadcast(default)).select(F.col("chunk_id").alias("item_id"), F.coalesce("overlap", "usual").alias("overlap"))  # one row
    n = _pieces(spark, d).groupBy("item_id").agg(F.sum("piece_words").alias("all_words"), F.count(F.lit(1)).alias("pieces"))
    return n.join(repeated, "item_id").select(F.col("item_id").alias("chunk_id"), (F.col("all_words") - (F.col("pieces") - 1) * F.col("overlap")).alias("words"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_misses(table(spark, d, "corpus_misses"), table(spark, d, "corpus_matches"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapping_report(table(spark, d, "corpus_misses"), table(spark, d, "corpus_matches"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p9_enlarged(spark: SparkSession, d: str) -> DataFrame:
    """Half as large again as every source can bear: shortages go to siblings, then to others."""
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), times=1.5).shares()


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    return encode.decode(p8_ids(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.mutual_neighbours(forest.literature_vectors(*(table(spark, d, t) for t in ("chunks", "entities", "papers"))))


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cut(forest.unit_vectors(forest.literature_vectors(*(table(spark, d, t) for t in ("chunks", "entities", "papers"))), 64))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return forest.nearest(_unit_vectors(spark, d), 64).select("kind", "of", "other", "rank", F.round("cosine", 5).alias("cosine"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    return forest.recall(_unit_vectors(spark, d), 64).select("kind", "queries", F.round("recall", 4).alias("recall"), F.round("looked", 4).alias("looked"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(table(spark, d, "authors"))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "authors"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p6_found": p6_found, "p6_entities": p6_entities, "p2_found": p2_found, "p2_report": p2_report, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p5_found": p5_found, "p5_ranking": p5_ranking, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_cover": p7_cover, "p8_ids": p8_ids, "p8_texts": p8_texts, "p9_enlarged": p9_enlarged}

def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


_TAIL = f"({_horner('t', fuse._C)} / ({_horner('t', fuse._D)} * t + 1.0))"
_FUSED = f"""
    WITH base AS (SELECT query_id, coalesce(nullif(lower(regexp_replace(chunk_id, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), ''), chr(1) || passage_id) AS item, chunk_id, lower(trim(retrieval_method, ' ')) AS m, score, source_scores FROM passages),
    sc AS (SELECT query_id, item, coalesce(m, '') AS ranking, score FROM base WHERE m <> 'fusion' OR m IS NULL
        UNION ALL SELECT query_id, item, lower(trim(e.key, ' ')), e.value FROM (SELECT query_id, item, unnest(map_entries(source_scores)) AS e FROM base WHERE m = 'fusion')),
    one AS (SELECT query_id, item, ranking, max(score) AS s FROM sc WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
    it AS (SELECT query_id, item, min(chunk_id) AS chunk_id FROM base GROUP BY ALL), rk AS (SELECT DISTINCT query_id, ranking FROM one),
    al AS (SELECT it.query_id, it.item, rk.ranking, coalesce(one.s, '-infinity'::DOUBLE) AS s FROM it JOIN rk USING (query_id) LEFT JOIN one ON one.query_id = it.query_id AND one.item = it.item AND one.ranking = rk.ranking),
    r AS (SELECT query_id, item, (rank() OVER (PARTITION BY query_id, ranking ORDER BY s) + (count(*) OVER (PARTITION BY query_id, ranking, s) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY query_id, ranking) AS p FROM al),
    z AS (SELECT query_id, item, p, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS u, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS t FROM r),
    v AS (SELECT query_id, item, avg(CASE WHEN p < 0.02425 THEN {_TAIL} WHEN p > 0.97575 THEN -{_TAIL} ELSE {_horner('u', fuse._A)} * q / ({_horner('u', fuse._B)} * u + 1.0) END) AS value FROM z GROUP BY ALL),
    f AS (SELECT v.query_id, v.item, it.chunk_id, v.value, n.returned_by FROM v JOIN it USING (query_id, item) JOIN (SELECT query_id, item, count(*) AS returned_by FROM one GROUP BY ALL) n USING (query_id, item))"""

ORACLE = {
    "p7_cover": r"""
        SELECT chunk_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM (SELECT DISTINCT chunk_id, text FROM bm25_documents) WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''""",
    # All pairs of a kind: the tables of the comparison are small.
    "p4_found": """
        WITH v AS (SELECT 'chunk' AS kind, chunk_id AS key, embedding AS e FROM chunks UNION ALL SELECT 'concept', entity_id, embedding FROM entities WHERE lower(trim(entity_type, ' ')) = 'concept' UNION ALL SELECT 'paper', paper_id, abstract_embedding FROM papers),
        g AS (SELECT kind, key, e::DOUBLE[] AS e, list_sum([x::DOUBLE * x for x in e]) AS n FROM v WHERE key IS NOT NULL AND len(e) = 64 AND list_count(e) = 64 AND NOT list_bool_or([isnan(x) OR isinf(x) for x in e])),
        u AS (SELECT kind, key, min([x / sqrt(n) for x in e])::DOUBLE[64] AS e FROM g WHERE n > 0 GROUP BY 1, 2),
        p AS (SELECT a.kind, a.key AS k1, b.key AS k2, array_inner_product(a.e, b.e) AS c FROM u a JOIN u b ON a.kind = b.kind AND a.key <> b.key),
        r AS (SELECT kind, k1, k2, c FROM p QUALIFY row_number() OVER (PARTITION BY kind, k1 ORDER BY round(c, 7) DESC, k2) <= 10)
        SELECT a.kind, a.k1 AS key_a, a.k2 AS key_b FROM r a JOIN r b ON a.kind = b.kind AND a.k1 = b.k2 AND a.k2 = b.k1 WHERE a.k1 < a.k2 AND a.c >= 0.9""",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": _FUSED + " SELECT query_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(value, 9) DESC, item) = 1",
    "p5_ranking": _FUSED + " SELECT query_id, item, round(value, 6) + 0.0::DOUBLE AS value, returned_by FROM f",
    "p7_found": r"""
        WITH items AS (SELECT DISTINCT chunk_id, text, coalesce(nullif(lower(trim(profile)), ''), 'default') AS p FROM bm25_documents),
        rules AS (SELECT lower(trim(profile)) AS p, chunk_size_words AS size FROM chunk_settings)
        SELECT DISTINCT i.chunk_id FROM items i LEFT JOIN rules r USING (p)
        WHERE len(regexp_extract_all(i.text, '[\p{L}\p{N}_]+')) > coalesce(r.size, (SELECT size FROM rules WHERE p = 'default'))""",
}
