"""Tables, figures, context texts, quality and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import entities as N
from paperloom.operators import ranking as R
from paperloom.operators import reports as P
from paperloom.operators import state as S
from paperloom.plans.graph_queries import _REFS, references
from paperloom.plans.ranking_queries import _DOT, _HITS, _USABLE, VECTOR, _hits, usable
from paperloom.plans.text_queries import COLLAPSE, CUR, CURP, OSTOP, QUERY, TOKENS, W, current_chunks, current_papers
from paperloom.operators import edges as E
from paperloom.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_Q = "['" + "','".join(dict.fromkeys(t for t in R.query_terms(QUERY) if t not in T.OVERLAP_STOPWORDS)) + "']"
_OV = lambda c: f"len(list_intersect({_Q}, {TOKENS.format(c)})) / len({_Q})"
_PSEUDO = f"""tb AS (SELECT chunk_id AS id, split_part(trim(text, ' '), ' ', 1) AS label, substr(text, 1, 80) AS caption, text, embedding FROM cur WHERE {_USABLE.format('embedding')}),
lb AS (SELECT *, array_to_string({TOKENS.format('label')}, ' ') AS lk FROM tb)"""
_HIT = f"(CASE WHEN lk <> '' AND contains(' {' '.join(P._tokens(QUERY))} ', ' ' || lk || ' ') THEN 1.0::DOUBLE ELSE 0 END)"


def _pseudo(spark, d, key):
    """Chunks in the role of tables and figures: the first word as label, a prefix as caption."""
    c = current_chunks(spark, d).where(usable("embedding"))
    return c.select(F.col("chunk_id").alias(key), F.substring_index(F.trim("text"), " ", 1).alias("label"), F.substring("text", 1, 80).alias("caption"), "text", F.col("embedding").alias("vec"))


_TSCORE = f"0.45 * {_DOT.format('embedding')} + 0.20 * {_OV('text')} + 0.15 * {_OV('caption')} + 0.25 * {_HIT} + 0.10 * least(len(regexp_extract_all(coalesce(text, ''), '{W}')) / 120.0::DOUBLE, 1.0)"


@query(f"WITH {CUR}, {_PSEUDO} SELECT id AS table_id, round({_TSCORE}, 5) AS score FROM lb ORDER BY {_TSCORE} DESC, id LIMIT 20")
def table_search(spark, d):
    return P.search_tables(_pseudo(spark, d, "table_id"), QUERY, VECTOR, 20).select("table_id", F.round("score", 5).alias("score"))


_FSCORE = f"0.48 * {_DOT.format('embedding')} + 0.22 * {_OV('text')} + 0.20 * {_OV('caption')} + 0.25 * {_HIT}"


@query(f"WITH {CUR}, {_PSEUDO} SELECT id AS figure_id, round({_FSCORE}, 5) AS score FROM lb ORDER BY {_FSCORE} DESC, id LIMIT 20")
def figure_search(spark, d):
    return P.search_figures(_pseudo(spark, d, "figure_id"), QUERY, VECTOR, 20).select("figure_id", F.round("score", 5).alias("score"))


@query("SELECT payload_id, CASE WHEN len(n) = 2 THEN array_to_string(n, ' vs. ') ELSE array_to_string(n, '; ') END AS line FROM (SELECT DISTINCT payload_id, [x for x in string_split(dataset, ' ') if x <> ''] AS n FROM entity_payloads WHERE dataset IS NOT NULL)")
def dataset_lines(spark, d):
    p = table(spark, d, "entity_payloads").where("dataset is not null").select("payload_id", "dataset").distinct()
    return p.select("payload_id", P.dataset_line(F.filter(F.split("dataset", " "), lambda x: x != "")).alias("line"))


@query("""WITH n AS (SELECT DISTINCT source_chunk_id, lower(trim(label, ' ')) AS label, lower(trim(entity_type, ' ')) AS node_type FROM entities WHERE trim(source_chunk_id, ' ') <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY source_chunk_id ORDER BY label, node_type) AS k FROM n)
SELECT source_chunk_id, string_agg(label || ' (' || node_type || ')', ', ' ORDER BY label, node_type) AS context FROM r WHERE k <= 4 GROUP BY 1""")
def graph_context_text(spark, d):
    n = table(spark, d, "entities").where("trim(source_chunk_id) <> ''").select("source_chunk_id", F.lower(F.trim("label")).alias("label"), F.lower(F.trim("entity_type")).alias("node_type")).distinct()
    return P.graph_context(n, "source_chunk_id")


@query("SELECT query_id, round_even(least(count(DISTINCT passage_id) / 25.0::DOUBLE, 1.0) * 0.8 + 0.2, 3) AS confidence FROM passages GROUP BY 1")
def answer_confidence(spark, d):
    return table(spark, d, "passages").groupBy("query_id").agg(F.count_distinct("passage_id").alias("n")).select("query_id", P.base_confidence(F.col("n"), 25).alias("confidence"))


@query(f"WITH {_HITS}, rel AS (SELECT DISTINCT query_id, key FROM r WHERE source = 'vector' AND rank <= 3), top AS (SELECT DISTINCT query_id, key FROM r WHERE source = 'bm25' AND rank <= 5) SELECT rel.query_id, sum(CASE WHEN top.key IS NULL THEN 0 ELSE 1 END)::DOUBLE / count(*) AS recall FROM rel LEFT JOIN top ON rel.query_id = top.query_id AND rel.key = top.key GROUP BY 1")
def recall_at_k(spark, d):
    h = _hits(spark, d)
    return P.recall_at_k(h.where("source = 'bm25'"), h.where("source = 'vector' and rank <= 3"), "query_id", 5)


@query(f"""WITH {CUR}, e AS (SELECT paper_id, avg(confidence) FILTER (WHERE NOT isnan(confidence)) AS conf FROM entities GROUP BY 1), m AS (SELECT DISTINCT source_chunk_id AS chunk_id FROM entities),
c AS (SELECT paper_id, avg(salience_score) AS sal, sum(CASE WHEN m.chunk_id IS NULL THEN 0 ELSE 1 END)::DOUBLE / count(*) AS cov FROM cur LEFT JOIN m USING (chunk_id) GROUP BY 1)
SELECT c.paper_id, round(0.45::DOUBLE * coalesce(conf, 0) + 0.35::DOUBLE * coalesce(sal, 0) + 0.20::DOUBLE * cov, 2) AS quality FROM c LEFT JOIN e USING (paper_id)""")
def ingestion_quality(spark, d):
    entities, chunks = table(spark, d, "entities"), current_chunks(spark, d)
    e = entities.where(~F.isnan("confidence")).groupBy("paper_id").agg(F.avg("confidence").alias("conf"))
    m = entities.select(F.col("source_chunk_id").alias("chunk_id"), F.lit(1).alias("hit")).distinct()
    c = chunks.join(m, "chunk_id", "left").groupBy("paper_id").agg(F.avg("salience_score").alias("sal"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("cov"))
    raw = 0.45 * F.coalesce("conf", F.lit(0.0)) + 0.35 * F.coalesce("sal", F.lit(0.0)) + 0.20 * F.col("cov")
    return c.join(e, "paper_id", "left").select("paper_id", F.round(raw, 2).alias("quality"))


@query(f"WITH {CURP}, {_REFS}, n AS (SELECT target_id AS paper_id, count(*) AS cited FROM cites WHERE NOT stub GROUP BY 1) SELECT paper_id, round(0.6 * {_DOT.format('abstract_embedding')} + 0.2 * least(coalesce(cited, 0) / 10.0::DOUBLE, 1.0), 5) AS score FROM curp LEFT JOIN n USING (paper_id) WHERE {_USABLE.format('abstract_embedding')} ORDER BY 0.6 * {_DOT.format('abstract_embedding')} + 0.2 * least(coalesce(cited, 0) / 10.0::DOUBLE, 1.0) DESC, paper_id LIMIT 20")
def authority_ranking(spark, d):
    p = current_papers(spark, d)
    cited = E.citations(references(spark, d), p).where("not is_stub_target").groupBy(F.col("target_node_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("cited"))
    scored = R.vector_scores(p.where(usable("abstract_embedding")), "abstract_embedding", VECTOR).join(cited, "paper_id", "left")
    return R.top_k(scored.withColumn("score", P.authority(F.col("score"), F.lit(0.0), F.col("cited"))), 20, "paper_id").select("paper_id", F.round("score", 5).alias("score"))


@query("""WITH l AS (SELECT entity_id, min(lower(trim(label, ' '))) AS label FROM entities GROUP BY 1), g AS (SELECT label, min(entity_id) AS kept FROM l GROUP BY 1), ab AS (SELECT l.entity_id AS old, g.kept FROM l JOIN g USING (label) WHERE l.entity_id <> g.kept),
e AS (SELECT DISTINCT paper_id AS src, entity_id AS dst FROM entities) SELECT DISTINCT src, 'MENTIONS' AS relation, coalesce(kept, dst) AS dst FROM e LEFT JOIN ab ON ab.old = e.dst""")
def node_merge(spark, d):
    e = table(spark, d, "entities")
    names = e.groupBy("entity_id").agg(F.min(F.lower(F.trim("label"))).alias("label"))
    kept = names.groupBy("label").agg(F.min("entity_id").alias("kept"))
    absorbed = names.join(kept, "label").where("entity_id <> kept").select(F.col("entity_id").alias("old"), "kept")
    return P.merge_nodes(e.select(F.col("paper_id").alias("src"), F.lit("MENTIONS").alias("relation"), F.col("entity_id").alias("dst")).distinct(), absorbed)


@query("WITH q AS (SELECT DISTINCT label AS k FROM corpus_misses WHERE label IS NOT NULL), c AS (SELECT label AS k, max(last_seen) AS at FROM corpus_misses WHERE label IS NOT NULL AND last_seen IS NOT NULL GROUP BY 1) SELECT q.k, c.at IS NOT NULL AS hit FROM q LEFT JOIN c ON q.k = c.k AND 1760000000 - c.at < 10000000")
def cache_lookup(spark, d):
    m = table(spark, d, "corpus_misses").where("label is not null").select(F.col("label").alias("k"), "last_seen")
    cache = m.where("last_seen is not null").groupBy("k").agg(F.max("last_seen").alias("created_at")).withColumn("payload", F.col("k"))
    return S.cached(m.select("k").distinct(), cache, ["k"], 1_760_000_000.0, 10_000_000.0).select("k", F.col("created_at").isNotNull().alias("hit"))


@query("SELECT event_type, count(*) AS events, count(json_extract_string(props, '$.k')) AS with_key FROM events GROUP BY 1")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count(F.get_json_object("props", "$.k")).alias("with_key"))


@query("WITH a AS (SELECT DISTINCT author_no, paper_id, unnest(affiliations) AS place FROM authors) SELECT place, count(*) AS authors, count(DISTINCT paper_id) AS papers FROM a GROUP BY 1")
def author_affiliations(spark, d):
    a = table(spark, d, "authors").select("author_no", "paper_id", F.explode("affiliations").alias("place")).distinct()
    return a.groupBy("place").agg(F.count(F.lit(1)).alias("authors"), F.count_distinct("paper_id").alias("papers"))


@query(f"WITH {CURP} SELECT paper_id, title, len(keywords) AS keywords, (SELECT string_agg(full_name, '; ' ORDER BY ordinal, author_no) FROM (SELECT DISTINCT author_no, paper_id, ordinal, full_name FROM authors) a WHERE a.paper_id = curp.paper_id) AS author_names FROM curp")
def paper_summary(spark, d):
    a = table(spark, d, "authors").select("author_no", "paper_id", "ordinal", "full_name").distinct()
    names = a.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "author_no", "full_name"))).alias("l"))
    p = current_papers(spark, d).join(names, "paper_id", "left")
    return p.select("paper_id", "title", F.size("keywords").alias("keywords"), F.array_join(F.transform("l", lambda x: x["full_name"]), "; ").alias("author_names"))


@query(f"""WITH e AS (SELECT DISTINCT record_id, label, aliases FROM entities WHERE lower(trim(entity_type, ' ')) = 'method')
SELECT DISTINCT record_id, CASE WHEN lower({COLLAPSE.format('label')}) = 'linear fit' THEN 'regression' ELSE label END AS label, coalesce(array_to_string(list_sort(list_distinct(CASE WHEN lower({COLLAPSE.format('label')}) = 'linear fit' THEN list_append(coalesce(aliases, []), label) ELSE aliases END)), '|'), '') AS aliases FROM e""")
def canonical_labels(spark, d):
    e = table(spark, d, "entities").where("lower(trim(entity_type)) = 'method'")
    return N.canonicalize(e, {"linear fit": "regression"}).select("record_id", "label", F.coalesce(F.array_join(F.array_sort(F.array_distinct("aliases")), "|"), F.lit("")).alias("aliases")).distinct()
