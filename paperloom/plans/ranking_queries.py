"""Lexical, vector and hybrid ranking, fusion, context and the search bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import edges as E
from paperloom.operators import ranking as R
from paperloom.plans.text_queries import CUR, CURP, QUERY, STOP, TOKENS, current_chunks, current_papers
from paperloom.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A fixed query vector with an exact decimal form.
VECTOR = [((i * 37) % 19 - 9) / 16.0 for i in range(64)]
_V = "[" + ",".join(str(v) for v in VECTOR) + "]"
_DOT = "list_sum([{0}[i]::DOUBLE * " + _V + "[i] for i in range(1, 65)])"
_USABLE = "len({0}) = 64 AND list_count({0}) = 64 AND NOT list_bool_or([isnan(x) for x in {0}])"


def usable(c: str):
    return (F.size(c) == 64) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))


def _bm25(where: str) -> str:
    terms = R.query_terms(QUERY)
    values = ",".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    return f"""WITH {CUR}, tok AS (SELECT chunk_id, chunk_type, [x for x in {TOKENS.format('text')} if length(x) > 2 AND x NOT IN {STOP}] AS t FROM cur),
    st AS (SELECT greatest(count(*), 1) AS n, sum(len(t)) / greatest(count(*), 1) AS av FROM tok),
    q(term, times) AS (VALUES {values}), df AS (SELECT term, times, (SELECT count(*) FROM tok WHERE list_contains(t, q.term)) AS df FROM q),
    s AS (SELECT chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score
      FROM (SELECT chunk_id, len(t) AS dl, df.*, st.*, len([x for x in t if x = df.term]) AS tf FROM tok, df, st WHERE {where}) GROUP BY 1)
    SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY score DESC, chunk_id LIMIT 20"""


def bm25_rows(spark: SparkSession, d: str, where=None) -> DataFrame:
    return R.bm25_scores(current_chunks(spark, d), "chunk_id", "text", QUERY, where)


@query(_bm25("true"))
def bm25_topk(spark, d):
    return R.top_k(bm25_rows(spark, d), 20, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query(_bm25("chunk_type = 'results'"))
def bm25_topk_section_filter(spark, d):
    return R.top_k(bm25_rows(spark, d, F.col("chunk_type") == "results"), 20, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


def _vector_rows(spark, d):
    return R.vector_scores(current_chunks(spark, d).where(usable("embedding")), "embedding", VECTOR)


@query(f"WITH {CUR} SELECT chunk_id, round({_DOT.format('embedding')}, 5) AS score FROM cur WHERE {_USABLE.format('embedding')} ORDER BY {_DOT.format('embedding')} DESC, chunk_id LIMIT 20")
def vector_topk(spark, d):
    return R.top_k(_vector_rows(spark, d), 20, "chunk_id").select("chunk_id", F.round("score", 5).alias("score"))


@query(f"WITH {CURP} SELECT paper_id, round({_DOT.format('abstract_embedding')}, 5) AS score FROM curp WHERE {_USABLE.format('abstract_embedding')} ORDER BY {_DOT.format('abstract_embedding')} DESC, paper_id LIMIT 20")
def paper_vector_topk(spark, d):
    p = R.vector_scores(current_papers(spark, d).where(usable("abstract_embedding")), "abstract_embedding", VECTOR)
    return R.top_k(p, 20, "paper_id").select("paper_id", F.round("score", 5).alias("score"))


_UNIT = "u AS (SELECT chunk_id, paper_id, text, [x::DOUBLE / sqrt(list_sum([y::DOUBLE * y for y in embedding])) for x in embedding] AS e FROM cur WHERE " + _USABLE.format("embedding") + " AND list_sum([y::DOUBLE * y for y in embedding]) > 0)"
_SIM = "list_sum([a.e[i] * b.e[i] for i in range(1, 65)])"


def unit_chunks(spark: SparkSession, d: str) -> DataFrame:
    return current_chunks(spark, d).where(usable("embedding")).where(V.norm(F.col("embedding")) > 0).select("chunk_id", "paper_id", "text", V.unit(F.col("embedding")).alias("vec"))


@query(f"WITH {CUR}, {_UNIT} SELECT a.chunk_id AS a, b.chunk_id AS b, round({_SIM}, 4) AS similarity FROM u a JOIN u b ON a.chunk_id < b.chunk_id WHERE {_SIM} >= 0.8")
def vector_threshold_pairs(spark, d):
    return E.similar_pairs(unit_chunks(spark, d).select(F.col("chunk_id").alias("id"), "vec"), 0.8).select("a", "b", F.round("similarity", 4).alias("similarity"))


_Q = "['" + "','".join(dict.fromkeys(t for t in R.query_terms(QUERY) if t not in T.OVERLAP_STOPWORDS)) + "']"
_OVER = f"len(list_intersect({_Q}, {TOKENS.format('text')})) / len({_Q})"


def hybrid_rows(spark, d):
    return _vector_rows(spark, d).withColumn("score", R.hybrid_chunk_score(F.col("score"), T.lexical_overlap(QUERY, F.col("text")), F.col("salience_score")))


@query(f"WITH {CUR} SELECT chunk_id, round(0.65 * {_DOT.format('embedding')} + 0.25 * {_OVER} + 0.10 * coalesce(salience_score, 0), 5) AS score FROM cur WHERE {_USABLE.format('embedding')} ORDER BY 0.65 * {_DOT.format('embedding')} + 0.25 * {_OVER} + 0.10 * coalesce(salience_score, 0) DESC, chunk_id LIMIT 20")
def hybrid_score_topk(spark, d):
    return R.top_k(hybrid_rows(spark, d), 20, "chunk_id").select("chunk_id", F.round("score", 5).alias("score"))


@query(f"WITH {CURP} SELECT paper_id, title, substr(abstract, 1, 200) AS preview FROM curp ORDER BY paper_id LIMIT 25 OFFSET 10")
def paginate(spark, d):
    return current_papers(spark, d).orderBy("paper_id").offset(10).limit(25).select("paper_id", "title", F.substring("abstract", 1, 200).alias("preview"))


def _hits(spark, d):
    """Ranked hits of each query from the stored passages: one rank per query, source and chunk."""
    p = table(spark, d, "passages").where("lower(retrieval_method) <> 'fusion' and score is not null and not isnan(score) and trim(chunk_id) <> ''")
    h = p.groupBy("query_id", F.lower("retrieval_method").alias("source"), F.lower(F.trim("chunk_id")).alias("key")).agg(F.max("score").alias("score"), F.min("paper_title").alias("paper_title"), F.min("section_title").alias("section_title"))
    r = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "key"))
    return h.withColumn("rank", r)


_HITS = """h AS (SELECT query_id, lower(retrieval_method) AS source, lower(trim(chunk_id, ' ')) AS key, max(score) AS score, min(paper_title) AS paper_title, min(section_title) AS section_title FROM passages
  WHERE lower(retrieval_method) <> 'fusion' AND score IS NOT NULL AND NOT isnan(score) AND trim(chunk_id, ' ') <> '' GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, key) AS rank FROM h),
  f AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS sources, max(score) AS best_score, min(paper_title) AS paper_title, min(section_title) AS section_title FROM r GROUP BY 1, 2)"""


@query(f"WITH {_HITS} SELECT query_id, key, round(rrf, 8) AS rrf, sources FROM f")
def rrf_fusion(spark, d):
    return R.reciprocal_ranks(_hits(spark, d), ["query_id"]).select("query_id", "key", F.round("rrf", 8).alias("rrf"), "sources")


@query(f"WITH {_HITS} SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, sources DESC, best_score DESC, paper_title NULLS FIRST, section_title NULLS FIRST, key) AS rank FROM f QUALIFY rank <= 10")
def fused_rank_tiebreak(spark, d):
    h = _hits(spark, d)
    names = h.groupBy("query_id", "key").agg(F.min("paper_title").alias("paper_title"), F.min("section_title").alias("section_title"))
    f = R.reciprocal_ranks(h, ["query_id"]).join(names, ["query_id", "key"])
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(*R.fused_order()))
    return f.withColumn("rank", r).where("rank <= 10").select("query_id", "key", "rank")


_BLOCKS = "b AS (SELECT query_id, passage_id, trim(coalesce(text, '')) AS text, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END AS n FROM (SELECT DISTINCT query_id, passage_id, text FROM passages)), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)"


@query(f"WITH {_BLOCKS} SELECT query_id, passage_id, CASE WHEN n <= 60 - before THEN text ELSE array_to_string(regexp_split_to_array(text, '\\s+')[1:(60 - before)::INT], ' ') END AS kept_text, least(n, 60 - before)::BIGINT AS kept_words FROM c WHERE before < 60")
def context_budget(spark, d):
    p = table(spark, d, "passages").select("query_id", "passage_id", "text").distinct().withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    return R.context_budget(p, ["query_id"], "passage_id", "text", 60).select("query_id", "passage_id", "kept_text", "kept_words")


@query("SELECT query_id, passage_id, '[' || row_number() OVER (PARTITION BY query_id ORDER BY passage_id) || '] ' || concat_ws(' - ', paper_title, section_title) AS citation FROM (SELECT DISTINCT query_id, passage_id, paper_title, section_title FROM passages)")
def citation_lines(spark, d):
    p = table(spark, d, "passages").select("query_id", "passage_id", "paper_title", "section_title").distinct()
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("passage_id"))
    return p.select("query_id", "passage_id", F.concat(F.lit("["), r.cast("string"), F.lit("] "), F.concat_ws(" - ", "paper_title", "section_title")).alias("citation"))


@query("SELECT query_id, lower(trim(paper_id, ' ')) AS paper_id, max(score) AS best_score FROM passages WHERE trim(paper_id, ' ') <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2")
def best_score_per_key(spark, d):
    return table(spark, d, "passages").where("trim(paper_id) <> '' and score is not null and not isnan(score)").groupBy("query_id", F.lower(F.trim("paper_id")).alias("paper_id")).agg(F.max("score").alias("best_score"))


@query("SELECT DISTINCT entity_id, lower(trim(entity_type)) AS entity_type FROM entities e WHERE EXISTS (SELECT 1 FROM passages p WHERE p.query_id = 1 AND p.paper_id = e.paper_id)")
def matched_semi_join(spark, d):
    p = table(spark, d, "passages").where("query_id = 1").select("paper_id").distinct()
    return table(spark, d, "entities").join(p, "paper_id", "left_semi").select("entity_id", F.lower(F.trim("entity_type")).alias("entity_type")).distinct()


@query(f"""WITH {CUR}, {CURP} SELECT (SELECT count(*) FROM curp) AS papers, (SELECT count(*) FROM cur) AS chunks, (SELECT count(DISTINCT section_id) FROM cur) AS sections,
(SELECT count(DISTINCT entity_id) FROM entities) AS entities, (SELECT count(DISTINCT query_id) FROM passages) AS queries, (SELECT count(DISTINCT author_no) FROM authors) AS authors""")
def corpus_stats(spark, d):
    one = lambda t, c: table(spark, d, t).agg(F.count_distinct(c).alias("n")).select(F.lit(t).alias("t"), F.lit(c).alias("c"), "n")
    parts = [("papers", "paper_id", "papers"), ("chunks", "chunk_id", "chunks"), ("chunks", "section_id", "sections"), ("entities", "entity_id", "entities"), ("passages", "query_id", "queries"), ("authors", "author_no", "authors")]
    rows = None
    for t, c, _ in parts:
        rows = one(t, c) if rows is None else rows.unionByName(one(t, c))
    return rows.groupBy().agg(*[F.max(F.when((F.col("t") == t) & (F.col("c") == c), F.col("n"))).alias(a) for t, c, a in parts])


@query(f"""WITH {CUR}, {CURP}, s AS (SELECT chunk_id, paper_id, {_DOT.format('embedding')} AS score FROM cur WHERE {_USABLE.format('embedding')} ORDER BY score DESC, chunk_id LIMIT 30),
n AS (SELECT source_chunk_id, count(DISTINCT entity_id) AS entities FROM entities GROUP BY 1)
SELECT s.chunk_id, s.paper_id, curp.title, coalesce(n.entities, 0) AS entities, round(s.score, 5) AS score FROM s JOIN curp USING (paper_id) LEFT JOIN n ON n.source_chunk_id = s.chunk_id""")
def bundle_enrichment(spark, d):
    top = R.top_k(_vector_rows(spark, d), 30, "chunk_id").select("chunk_id", "paper_id", "score")
    top = F.broadcast(top)  # thirty rows
    n = table(spark, d, "entities").join(top.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_semi").groupBy("source_chunk_id").agg(F.count_distinct("entity_id").alias("entities"))
    return current_papers(spark, d).select("paper_id", "title").join(top, "paper_id").join(n, F.col("chunk_id") == F.col("source_chunk_id"), "left").select("chunk_id", "paper_id", "title", F.coalesce("entities", F.lit(0)).alias("entities"), F.round("score", 5).alias("score"))
