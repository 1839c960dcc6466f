"""Hybrid retrieval, the search bundle and the summaries around it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking as C
from paperloom.operators import edges as E
from paperloom.operators import entities as N
from paperloom.operators import graph as G
from paperloom.operators import ranking as R
from paperloom.operators import reports as P
from paperloom.operators import search as S
from paperloom.plans import ranking_queries as Q
from paperloom.plans.graph_queries import _REFS, references
from paperloom.plans.ranking_queries import _DOT, _OVER, _USABLE, VECTOR, usable
from paperloom.plans.report_queries import _FSCORE, _PSEUDO, _TSCORE, _pseudo
from paperloom.plans.text_queries import COLLAPSE, CUR, CURP, QUERY, STOP, TOKENS, current_chunks, current_papers
from paperloom.session import cut, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TERMS = R.query_terms(QUERY)
_LEX = f"""tok AS (SELECT chunk_id, [x for x in {TOKENS.format('text')} if length(x) > 2 AND x NOT IN {STOP}] AS t FROM cur),
st AS (SELECT greatest(count(*), 1) AS n, sum(len(t)) / greatest(count(*), 1) AS av FROM tok),
qt(term, times) AS (VALUES {",".join(f"('{t}', {_TERMS.count(t)})" for t in dict.fromkeys(_TERMS))}), df AS (SELECT term, times, (SELECT count(*) FROM tok WHERE list_contains(t, qt.term)) AS df FROM qt),
lex AS (SELECT chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM (SELECT chunk_id, len(t) AS dl, df.*, st.*, len([x for x in t if x = df.term]) AS tf FROM tok, df, st) GROUP BY 1)"""


def _retrieved(k: int, guard: str = "true") -> str:
    first = lambda name, rows: f"SELECT '{name}' AS source, chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM {rows} QUALIFY rank <= {3 * k}"
    return f"""{CUR}, {CURP}, {_LEX},
vec AS (SELECT chunk_id, {_DOT.format('embedding')} AS score FROM cur WHERE {_USABLE.format('embedding')}),
hyb AS (SELECT chunk_id, 0.65 * {_DOT.format('embedding')} + 0.25 * {_OVER} + 0.10 * coalesce(salience_score, 0) AS score FROM cur WHERE {_USABLE.format('embedding')}),
hits AS ({first('graph', 'vec')} UNION ALL {first('vector', 'hyb')} UNION ALL {first('bm25', 'lex')}),
kn AS (SELECT hits.*, cur.paper_id, cur.chunk_type, curp.title FROM hits JOIN cur USING (chunk_id) LEFT JOIN curp ON curp.paper_id = cur.paper_id WHERE {guard}),
fu AS (SELECT chunk_id, min(paper_id) AS paper_id, min(title) AS paper_title, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS sources, max(score) AS best FROM kn GROUP BY 1),
ret AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, sources DESC, best DESC, coalesce(paper_title, ''), chunk_id) AS rank FROM fu QUALIFY rank <= {k})"""


def _found(spark, d, request: S.Request):
    c = current_chunks(spark, d)
    rankings = {"graph": Q._vector_rows(spark, d), "vector": Q.hybrid_rows(spark, d), "bm25": Q.bm25_rows(spark, d)}
    titles = current_papers(spark, d).select("paper_id", F.col("title").alias("paper_title"))
    details = c.select("chunk_id", "paper_id", "chunk_type", F.lit(None).cast("string").alias("section_title")).join(titles, "paper_id", "left")
    return S.retrieve(rankings, details, request)


@query(f"WITH {_retrieved(10)} SELECT chunk_id, paper_id, paper_title, rank, round(rrf, 6) AS score, sources FROM ret")
def hybrid_retrieval(spark, d):
    """The whole retrieval: three rankings of the chunks for one query, fused."""
    return _found(spark, d, S.Request(QUERY, 10)).select("chunk_id", "paper_id", "paper_title", "rank", "score", "sources")


@query(f"WITH {_retrieved(10, chr(40) + 'chunk_type IS NULL OR chunk_type = ' + chr(39) + 'results' + chr(39) + chr(41))} SELECT chunk_id, paper_id, paper_title, rank, round(rrf, 6) AS score, sources FROM ret")
def hybrid_retrieval_section(spark, d):
    return _found(spark, d, S.Request(QUERY, 10, section_type="results")).select("chunk_id", "paper_id", "paper_title", "rank", "score", "sources")


_N = f"""nm AS (SELECT entity_id, {COLLAPSE.format('lower(label)')} AS n FROM entities UNION SELECT entity_id, {COLLAPSE.format('lower(a)')} FROM (SELECT entity_id, unnest(aliases) AS a FROM entities)),
seeds AS (SELECT entity_id FROM (SELECT entity_id, max(CASE WHEN n = '' OR n IS NULL THEN 0.0 WHEN contains('{QUERY}', n) THEN 4.0 + least(len(string_split(n, ' ')), 3) ELSE len(list_intersect(list_distinct(regexp_extract_all(n, '[A-Za-z0-9][A-Za-z0-9_+-]*')), list_distinct(string_split('{QUERY}', ' ')))) END)::DOUBLE AS score FROM nm GROUP BY 1) WHERE score > 0 ORDER BY score DESC, entity_id LIMIT 5),
men AS (SELECT DISTINCT unnest(mention_chunk_ids) AS chunk_id, entity_id FROM entities)"""


def _seeds(spark, d):
    return N.link_query(table(spark, d, "entities"), QUERY, 5).select("entity_id")


def _mentioned(spark, d):
    return G.mentions(table(spark, d, "entities")).join(F.broadcast(_seeds(spark, d)), "entity_id", "left_semi").select("chunk_id").distinct()  # five seeds


@query(f"""WITH {_retrieved(10)}, {_N}, ctx AS (SELECT chunk_id, text, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text, chunk_type FROM cur WINDOW w AS (PARTITION BY paper_id ORDER BY section_id, ordinal)),
es AS (SELECT source_chunk_id AS chunk_id, string_agg(label, '|' ORDER BY label) AS entities FROM (SELECT DISTINCT source_chunk_id, lower(trim(label, ' ')) AS label FROM entities) GROUP BY 1)
SELECT ret.chunk_id, rank, chunk_type, md5(coalesce(previous_text, '')) AS previous_text, md5(coalesce(next_text, '')) AS next_text, coalesce(es.entities, '') AS entities,
EXISTS (SELECT 1 FROM men JOIN seeds USING (entity_id) WHERE men.chunk_id = ret.chunk_id) AS in_graph FROM ret JOIN ctx USING (chunk_id) LEFT JOIN es USING (chunk_id)""")
def bundle_passages(spark, d):
    around = C.chunk_context(current_chunks(spark, d).select("chunk_id", "paper_id", "section_id", "ordinal", "text")).select("chunk_id", "text", "previous_text", "next_text")
    out = S.passages(_found(spark, d, S.Request(QUERY, 10)), around, table(spark, d, "entities"), _mentioned(spark, d))
    return out.select("chunk_id", "rank", "chunk_type", F.md5(F.coalesce("previous_text", F.lit(""))).alias("previous_text"), F.md5(F.coalesce("next_text", F.lit(""))).alias("next_text"), F.array_join("entities", "|").alias("entities"), "in_graph")


_MATCHED = f"""{_retrieved(5)}, {_PSEUDO},
ph AS (SELECT paper_id, {_DOT.format('abstract_embedding')} AS score FROM curp WHERE {_USABLE.format('abstract_embedding')} ORDER BY score DESC, paper_id LIMIT 5),
th AS (SELECT cur.paper_id, s.score FROM (SELECT id, {_TSCORE} AS score FROM lb ORDER BY {_TSCORE} DESC, id LIMIT 5) s JOIN cur ON cur.chunk_id = s.id),
fh AS (SELECT cur.paper_id, s.score FROM (SELECT id, {_FSCORE} AS score FROM lb ORDER BY {_FSCORE} DESC, id LIMIT 5) s JOIN cur ON cur.chunk_id = s.id),
mp AS (SELECT paper_id, max(score) AS best_score FROM (SELECT paper_id, round(rrf, 6) AS score FROM ret UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM th UNION ALL SELECT * FROM fh) GROUP BY 1)"""


def _paper_hits(spark, d):
    """(paper_id, score) of the text, table, figure and paper hits of the query."""
    own = current_chunks(spark, d).select("chunk_id", "paper_id")
    of = lambda hits, key: own.join(F.broadcast(hits.select(F.col(key).alias("chunk_id"), "score")), "chunk_id").select("paper_id", "score")
    papers = R.top_k(R.vector_scores(current_papers(spark, d).where(usable("abstract_embedding")), "abstract_embedding", VECTOR), 5, "paper_id")
    return (
        _found(spark, d, S.Request(QUERY, 5)).select("paper_id", "score").unionByName(of(P.search_tables(_pseudo(spark, d, "table_id"), QUERY, VECTOR, 5), "table_id"))
        .unionByName(of(P.search_figures(_pseudo(spark, d, "figure_id"), QUERY, VECTOR, 5), "figure_id")).unionByName(papers.select("paper_id", "score"))
    )


def _matched(spark, d):
    return S.matched_papers(_paper_hits(spark, d), current_papers(spark, d))


@query(f"WITH {_MATCHED} SELECT paper_id, title, round(best_score, 4) AS best_score, row_number() OVER (ORDER BY best_score DESC, paper_id) AS position FROM mp JOIN curp USING (paper_id)")
def bundle_papers(spark, d):
    return _matched(spark, d).select("paper_id", "title", F.round("best_score", 4).alias("best_score"), "position")


@query(f"""WITH {_MATCHED}, e AS (SELECT DISTINCT entity_id, lower(trim(entity_type, ' ')) AS entity_type, label, confidence, paper_id FROM entities WHERE paper_id IN (SELECT paper_id FROM mp JOIN curp USING (paper_id)))
SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY confidence DESC NULLS LAST, entity_id, paper_id, label) AS position FROM e""")
def bundle_entities(spark, d):
    few = F.broadcast(_matched(spark, d).select("paper_id"))  # at most four lists of five
    e = table(spark, d, "entities").join(few, "paper_id", "left_semi").select("entity_id", F.lower(F.trim("entity_type")).alias("entity_type"), "label", "confidence", "paper_id").distinct()
    return S.by_confidence(e)


@query(f"""WITH {_MATCHED}, {_REFS} SELECT source_id AS source_paper_id, s.title AS source_paper_title, target_id AS target_paper_id, t.title AS resolved_title, confidence::DOUBLE AS confidence FROM cites LEFT JOIN curp s ON s.paper_id = source_id LEFT JOIN curp t ON t.paper_id = target_id
WHERE source_id IN (SELECT paper_id FROM mp) OR target_id IN (SELECT paper_id FROM mp)""")
def bundle_citations(spark, d):
    p = current_papers(spark, d)
    few = F.broadcast(_matched(spark, d).select("paper_id"))
    edges = E.citations(references(spark, d), p)
    hit = edges.join(few.withColumnRenamed("paper_id", "source_node_id").withColumn("s", F.lit(1)), "source_node_id", "left").join(few.withColumnRenamed("paper_id", "target_node_id").withColumn("t", F.lit(1)), "target_node_id", "left").where("s = 1 or t = 1")
    stub = hit.withColumn("target_label", F.when(F.col("is_stub_target"), None).otherwise(F.col("target_label")))
    return S.citation_summaries(stub, p).select("source_paper_id", "source_paper_title", "target_paper_id", F.col("target_paper_title").alias("resolved_title"), "confidence")


@query(f"""WITH {_MATCHED}, {_REFS} SELECT (SELECT count(*) FROM curp) AS paper_count, (SELECT count(*) FROM cur) AS chunk_count, (SELECT count(*) FROM lb) AS table_count, (SELECT count(*) FROM lb) AS figure_count,
(SELECT count(DISTINCT entity_id) FROM entities) AS entity_count, (SELECT count(*) FROM cites) AS citation_count, (SELECT count(*) FROM mp JOIN curp USING (paper_id)) AS matched_papers""")
def bundle_stats(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")
    pseudo = _pseudo(spark, d, "id")
    rows = [
        n(current_papers(spark, d), "paper_count"), n(current_chunks(spark, d), "chunk_count"), n(pseudo, "table_count"), n(pseudo, "figure_count"), n(table(spark, d, "entities").select("entity_id").distinct(), "entity_count"),
        n(E.citations(references(spark, d), current_papers(spark, d)), "citation_count"), n(_matched(spark, d), "matched_papers"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("paper_count", "chunk_count", "table_count", "figure_count", "entity_count", "citation_count", "matched_papers")])


_EDGES = "ge AS (SELECT DISTINCT paper_id AS src, 'HAS_CHUNK' AS relation, chunk_id AS dst FROM cur UNION SELECT chunk_id, 'MENTIONS', entity_id FROM men WHERE chunk_id IS NOT NULL)"
_HOPS = f"""{CUR}, {_N}, {_EDGES}, b AS (SELECT src, dst FROM ge UNION SELECT dst, src FROM ge), h0 AS (SELECT entity_id AS node, 0 AS distance FROM seeds), h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT dst, 1 FROM b JOIN h0 ON src = node WHERE dst NOT IN (SELECT node FROM h0)),
h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT dst, 2 FROM b JOIN h1 ON src = node WHERE dst NOT IN (SELECT node FROM h1))"""


def _graph(spark, d):
    has = current_chunks(spark, d).select(F.col("paper_id").alias("src"), F.lit("HAS_CHUNK").alias("relation"), F.col("chunk_id").alias("dst"))
    return has.unionByName(G.mentions(table(spark, d, "entities")).select(F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("relation"), F.col("entity_id").alias("dst"))).distinct()


@query(f"WITH {_HOPS} SELECT node, distance, row_number() OVER (ORDER BY distance, node) AS position FROM h2")
def query_neighbourhood(spark, d):
    """The nodes within two hops of the query's entities, the nearest first."""
    found = G.neighbourhood(_graph(spark, d), _seeds(spark, d).select(F.col("entity_id").alias("node")), 2)
    return found.withColumn("position", F.row_number().over(Window.orderBy("distance", "node")))


@query(f"WITH {_HOPS} SELECT relation, src, dst FROM ge JOIN h2 a ON a.node = src JOIN h2 b ON b.node = dst WHERE least(a.distance, b.distance) < 2")
def query_neighbourhood_edges(spark, d):
    e = cut(_graph(spark, d))
    found = G.neighbourhood(e, _seeds(spark, d).select(F.col("entity_id").alias("node")), 2)
    return G.traversed_edges(e, found, 2).select("relation", "src", "dst")


@query(f"""WITH {CUR}, {CURP}, s AS (SELECT section_id, min(section_title) AS title FROM bm25_documents WHERE section_title <> '' GROUP BY 1)
SELECT DISTINCT e.record_id, e.entity_id, lower(trim(e.entity_type, ' ')) AS entity_type, curp.title AS paper_title, CASE WHEN cur.chunk_id IS NULL THEN NULL ELSE coalesce(s.title, cur.section_id) END AS section_title, md5(cur.text) AS chunk_text
FROM entities e JOIN curp USING (paper_id) LEFT JOIN cur ON cur.chunk_id = e.source_chunk_id LEFT JOIN s ON s.section_id = cur.section_id""")
def entity_summary(spark, d):
    c = current_chunks(spark, d)
    sections = table(spark, d, "bm25_documents").select("section_id", F.col("section_title").alias("title"))
    texts = c.select("chunk_id", "text").join(S.section_titles(c, sections), "chunk_id")
    e = table(spark, d, "entities").select("record_id", "entity_id", F.lower(F.trim("entity_type")).alias("entity_type"), "paper_id", "source_chunk_id")
    out = S.entity_summaries(e, current_papers(spark, d).select("paper_id", F.col("title").alias("paper_title")), texts)
    return out.select("record_id", "entity_id", "entity_type", "paper_title", "section_title", F.md5("text").alias("chunk_text")).distinct()


@query(f"WITH {CUR}, s AS (SELECT section_id, min(section_title) AS title FROM bm25_documents WHERE section_title <> '' GROUP BY 1) SELECT chunk_id, coalesce(title, section_id) AS section_title FROM cur LEFT JOIN s USING (section_id)")
def section_title_lookup(spark, d):
    sections = table(spark, d, "bm25_documents").select("section_id", F.col("section_title").alias("title"))
    return S.section_titles(current_chunks(spark, d), sections).select("chunk_id", "section_title")


@query("""WITH e AS (SELECT paper_id, entity_id, min(lower(trim(entity_type, ' '))) AS entity_type, min(trim(label, ' ')) AS label FROM entities GROUP BY 1, 2)
SELECT paper_id, entity_id, row_number() OVER (PARTITION BY paper_id ORDER BY entity_type, lower(label), entity_id) AS position FROM e""")
def document_entities(spark, d):
    e = table(spark, d, "entities").groupBy("paper_id", "entity_id").agg(F.min(F.lower(F.trim("entity_type"))).alias("entity_type"), F.min(F.trim("label")).alias("label"))
    return S.by_type_and_label(e).select("paper_id", "entity_id", "position")


@query("SELECT DISTINCT passage_id, coalesce(nullif(paper_title, ''), 'Untitled') AS paper_title, coalesce(nullif(section_title, ''), 'Section') AS section_title, coalesce(nullif(doi, ''), '') AS doi, coalesce(score, 0.0) AS score, coalesce(nullif(lower(retrieval_method), ''), 'fusion') AS method FROM passages")
def passage_projection(spark, d):
    p = table(spark, d, "passages")
    text = lambda c, default: S.missing(F.col(c), F.lit(default)).alias(c)
    return p.select("passage_id", text("paper_title", "Untitled"), text("section_title", "Section"), text("doi", ""), F.coalesce("score", F.lit(0.0)).alias("score"), S.missing(F.lower("retrieval_method"), F.lit("fusion")).alias("method")).distinct()


@query("SELECT query_id, passage_id, rank, coalesce(nullif(paper_title, ''), '') || ' - ' || coalesce(nullif(section_title, ''), '') AS citation FROM (SELECT query_id, passage_id, paper_title, section_title, row_number() OVER (PARTITION BY query_id ORDER BY passage_id) AS rank FROM (SELECT DISTINCT query_id, passage_id, paper_title, section_title FROM passages)) WHERE rank <= 5")
def structured_passages(spark, d):
    p = table(spark, d, "passages").select("query_id", "passage_id", "paper_title", "section_title").distinct()
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("passage_id"))
    cite = F.concat(F.coalesce("paper_title", F.lit("")), F.lit(" - "), F.coalesce("section_title", F.lit("")))
    return p.withColumn("rank", r).where("rank <= 5").select("query_id", "passage_id", "rank", cite.alias("citation"))


@query(f"""WITH v AS (SELECT entity_id, max({_DOT.format('embedding')}) AS score FROM entities WHERE lower(trim(entity_type, ' ')) = 'concept' AND {_USABLE.format('embedding')} GROUP BY 1)
SELECT entity_id, round(score, 5) AS score FROM v WHERE score >= 0.5 ORDER BY score DESC, entity_id LIMIT 20""")
def concept_search(spark, d):
    """Concepts by their vectors, those below the wanted similarity left out before the limit."""
    e = table(spark, d, "entities").where("lower(trim(entity_type)) = 'concept'").where(usable("embedding"))
    scored = R.vector_scores(e.select("entity_id", "embedding"), "embedding", VECTOR).groupBy("entity_id").agg(F.max("score").alias("score"))
    return R.top_k(scored.where("score >= 0.5"), 20, "entity_id").select("entity_id", F.round("score", 5).alias("score"))


@query(f"""WITH {CUR}, s AS (SELECT chunk_id, paper_id, embedding, unnest([trim(x) for x in string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1\x01', 'g'), '\x01') if trim(x) <> '']) AS label FROM cur WHERE {_USABLE.format('embedding')}),
e AS (SELECT DISTINCT chunk_id, {_DOT.format('embedding')} AS score FROM s WHERE regexp_matches(label, '[=≈≤≥]') AND regexp_matches(label, '[A-Za-z]') AND length({COLLAPSE.format('label')}) >= 8)
SELECT chunk_id, round(score, 5) AS score FROM e WHERE score >= 0.1 ORDER BY score DESC, chunk_id LIMIT 20""")
def equation_search(spark, d):
    """Chunks with an equation, by their vectors, above a threshold."""
    from paperloom.operators import extraction as X

    with_equation = X.equations(current_chunks(spark, d)).select("chunk_id").distinct()
    scored = Q._vector_rows(spark, d).select("chunk_id", "score").where("score >= 0.1").join(with_equation, "chunk_id", "left_semi")
    return R.top_k(scored, 20, "chunk_id").select("chunk_id", F.round("score", 5).alias("score"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS visible FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)")
def html_parse(spark, d):
    """What is left of a text without markup."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return t.select("doc_id", F.md5(T.without_markup(F.col("text"))).alias("visible"))


@query(Q.ORACLE["bm25_topk"])
def bm25_index_topk(spark, d):
    """The same ranking from an index: the postings are made once and a query reads its own terms."""
    postings, stats = R.build_postings(current_chunks(spark, d), "chunk_id", "text")
    scored = R.bm25_from_postings(cut(postings), stats, QUERY).withColumnRenamed("key", "chunk_id")
    return R.top_k(scored, 20, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))
