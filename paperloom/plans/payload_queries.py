"""Replies to entities, counters, aliases, the extraction driver and the graph sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import edges as E
from paperloom.operators import extraction as X
from paperloom.operators import graph as G
from paperloom.operators import payloads as P
from paperloom.plans import graph_queries as Q
from paperloom.plans.graph_queries import _REFS, ID, SENT, references
from paperloom.plans.text_queries import COLLAPSE, CUR, CURP, current_chunks, current_papers
from paperloom.session import cut, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_C = lambda c: COLLAPSE.format(f"coalesce({c}, '')")
_ENT = f"""p AS (SELECT DISTINCT payload_id, chunk_id, lower({_C('type')}) AS t, {_C('name')} AS name, {_C('text')} AS tx, {_C('value')} AS vl, {_C('metric')} AS mt, value, metric, dataset, condition, confidence, unit, text FROM entity_payloads),
l AS (SELECT *, CASE WHEN t IN ('concept', 'method', 'dataset') THEN name WHEN t IN ('claim', 'equation') THEN tx WHEN t = 'result' THEN trim(concat_ws(' ', nullif(vl, ''), nullif(mt, '')), ' ') END AS label FROM p WHERE t IN ('concept', 'method', 'claim', 'result', 'equation', 'dataset')),
en AS (SELECT DISTINCT payload_id, t AS entity_type, label, CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence <> 0 THEN round_even(greatest(0.0, least(1.0, confidence)), 3) ELSE 0.5 END AS confidence,
CASE WHEN t = 'result' THEN {ID('result', "coalesce(try_cast(try_cast(regexp_extract(value, '(-?[0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS DECIMAL(30, 6))::VARCHAR, '0.000000')", 'metric', 'dataset', 'condition', 'chunk_id')} ELSE t || '-' || substr(sha1(lower(label)), 1, 16) END AS entity_id FROM l WHERE label <> '')"""


@query(f"WITH {_ENT} SELECT payload_id, entity_type, label, entity_id, round(confidence, 2) AS confidence FROM en")
def payload_entities(spark, d):
    return P.payload_entities(table(spark, d, "entity_payloads")).select("payload_id", "entity_type", "label", "entity_id", F.round("confidence", 2).alias("confidence")).distinct()


@query(f"WITH {_ENT} SELECT entity_type, count(DISTINCT entity_id) AS entities, count(*) AS replies FROM en GROUP BY 1")
def payload_entity_histogram(spark, d):
    return P.payload_entities(table(spark, d, "entity_payloads")).groupBy("entity_type").agg(F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("replies"))


@query(Q.ORACLE["validation_rules"].replace("SELECT payload_id, NOT (", "SELECT chunk_id, count(*) AS payloads, count(*) FILTER (WHERE ok) AS valid, round(round_even(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 3), 2) AS quality FROM (SELECT chunk_id, NOT (").replace(" AS valid FROM w", " AS ok FROM w) GROUP BY 1").replace("SELECT DISTINCT payload_id,", "SELECT DISTINCT payload_id, chunk_id,"))
def payload_quality(spark, d):
    of = table(spark, d, "entity_payloads").select("payload_id", "chunk_id").distinct()
    return P.chunk_quality(Q.validation_rules(spark, d).join(of, "payload_id")).select("chunk_id", "payloads", "valid", F.round("quality", 2).alias("quality"))


@query("""WITH c AS (SELECT label, entity_type, sum(coalesce(miss_count, 0)) AS n, max(last_seen) AS at FROM corpus_misses GROUP BY 1, 2), m AS (SELECT label, entity_type, count(*) AS n, max(last_seen) AS at FROM corpus_misses GROUP BY 1, 2)
SELECT label, entity_type, sum(n)::BIGINT AS miss_count FROM (SELECT * FROM c UNION ALL SELECT * FROM m) GROUP BY 1, 2""")
def miss_counters(spark, d):
    """Each record of a miss is a further miss of its label."""
    m = table(spark, d, "corpus_misses")
    held = m.groupBy("label", "entity_type").agg(F.sum(F.coalesce("miss_count", F.lit(0))).alias("miss_count"), F.max("last_seen").alias("last_seen"))
    return P.counted_misses(held, m, ["label", "entity_type"]).select("label", "entity_type", "miss_count")


@query("SELECT chunk_id, count(*) AS hits FROM (SELECT DISTINCT chunk_id, payload_id FROM entity_payloads WHERE chunk_id IS NOT NULL) GROUP BY 1")
def cache_hits(spark, d):
    """The replies' cache: every further reply of a chunk is a hit of its entry."""
    p = table(spark, d, "entity_payloads").where("chunk_id is not null").select("chunk_id", "payload_id").distinct()
    cache = p.select("chunk_id").distinct().withColumn("hits", F.lit(0))
    return P.counted_hits(cache, p, ["chunk_id"])


@query(f"""WITH {CUR}, {CURP}, x AS (SELECT paper_id AS s, 'HAS_SECTION' AS r, section_id AS o FROM cur UNION SELECT section_id, 'HAS_CHUNK', chunk_id FROM cur UNION SELECT chunk_id, 'NEXT', next_chunk_id FROM cur UNION SELECT paper_id, 'PUBLISHED_IN', journal.journal_id FROM curp UNION SELECT paper_id, 'AUTHORED_BY', author_id FROM authors
UNION SELECT c, 'MENTIONS', entity_id FROM (SELECT unnest(mention_chunk_ids) AS c, entity_id FROM entities)),
n AS (SELECT paper_id AS id FROM curp UNION SELECT section_id FROM cur UNION SELECT chunk_id FROM cur UNION SELECT journal.journal_id FROM curp UNION SELECT author_id FROM authors UNION SELECT entity_id FROM entities)
SELECT r AS relation, count(*) AS edges, count(*) FILTER (WHERE s NOT IN (SELECT id FROM n WHERE id IS NOT NULL)) AS stub_sources, count(*) FILTER (WHERE o NOT IN (SELECT id FROM n WHERE id IS NOT NULL)) AS stub_targets FROM x WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1""")
def graph_sink(spark, d):
    """All structure and mention edges, and how many of their ends had to be made as stubs."""
    c, p, a, e = current_chunks(spark, d), current_papers(spark, d), table(spark, d, "authors"), table(spark, d, "entities")
    edges = G.structure_edges(c, p, a).unionByName(G.mentions(e).select(F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("relation"), F.col("entity_id").alias("dst")))
    nodes = G.node_tables(p, c, e, a).select("node_id", F.lit(True).alias("known")).distinct()
    side = lambda s: nodes.select(F.col("node_id").alias(s), F.col("known").alias(f"known_{s}"))
    marked = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return marked.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("known_src").isNull()).alias("stub_sources"), F.count_if(F.col("known_dst").isNull()).alias("stub_targets"))


@query(f"""WITH {CUR}, {CURP}, n AS (SELECT 'Paper' AS node_type, paper_id AS id FROM curp UNION SELECT 'Section', section_id FROM cur UNION SELECT 'Chunk', chunk_id FROM cur UNION SELECT 'Journal', journal.journal_id FROM curp WHERE journal.journal_id IS NOT NULL UNION SELECT 'Author', author_id FROM authors WHERE author_id IS NOT NULL
UNION SELECT t, entity_id FROM (SELECT entity_id, upper(substr(min(lower(trim(entity_type, ' '))), 1, 1)) || substr(min(lower(trim(entity_type, ' '))), 2) AS t FROM entities GROUP BY 1)) SELECT node_type, count(*) AS nodes, count(*) - count(DISTINCT id) AS violations FROM n GROUP BY 1""")
def node_constraints(spark, d):
    """Nodes by type, and those that break the rule of one node an id."""
    n = G.node_tables(current_papers(spark, d), current_chunks(spark, d), table(spark, d, "entities"), table(spark, d, "authors"))
    return G.constraint_violations(n)


@query(f"WITH {CUR}, {CURP}, {_REFS}, k AS (SELECT paper_id FROM curp UNION SELECT source_id FROM cites) SELECT DISTINCT target_id AS node_id, 'Paper' AS node_type FROM cites WHERE target_id NOT IN (SELECT paper_id FROM curp)")
def stub_nodes(spark, d):
    p = current_papers(spark, d)
    edges = E.citations(references(spark, d), p)
    return G.stubs(edges, p.select(F.col("paper_id").alias("node_id"))).select("node_id", "node_type")


def extracted(spark, d):
    """All passes over all chunks, replies in the place of the local entities where a chunk has any."""
    c = current_chunks(spark, d).select("chunk_id", "paper_id", "text", "chunk_type", "word_count", "salience_score")
    local = X.all_passes(Q.with_keywords(spark, d, c), "keywords", Q.METRICS, Q.CONCEPT_ENDINGS, Q.METHODS, Q.DATASET_NOUNS, X.dataset_registry(current_papers(spark, d)))
    r = P.payload_entities(table(spark, d, "entity_payloads")).join(c.select("chunk_id", "paper_id"), "chunk_id").select("chunk_id", "paper_id", "entity_id", "entity_type", "label", "confidence", F.lit(0).alias("position"), "properties")
    return c, cut(P.prefer_replies(local, r))


@query()
def document_extraction(spark, d):
    """The driver: every entity of a document once, with its surest label and its chunks."""
    _, e = extracted(spark, d)
    return X.merge_document(e)


@query()
def updated_salience(spark, d):
    """Chunk salience after extraction: never below what it was."""
    c, e = extracted(spark, d)
    return X.updated_salience(c, X.salience(c, e))
