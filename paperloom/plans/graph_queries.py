"""Edges, graph analytics, entities, extraction and operational state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import edges as E
from paperloom.operators import entities as N
from paperloom.operators import extraction as X
from paperloom.operators import graph as G
from paperloom.operators import state as S
from paperloom.plans.ranking_queries import _SIM, _UNIT, unit_chunks, usable
from paperloom.plans.text_queries import COLLAPSE, CUR, CURP, current_chunks, current_papers
from paperloom.session import cut, table
from paperloom.streaming.ingest import windowed_counts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SENT = "[trim(x) for x in string_split(regexp_replace(trim({0}), '([.!?])\\s+', '\\1\x01', 'g'), '\x01') if trim(x) <> '']"
ID = lambda p, *xs: f"'{p}-' || substr(sha1(concat_ws('::', {', '.join(f'coalesce({x}, {chr(39)*2})' for x in xs)})), 1, 16)"


def references(spark, d):
    """A reference of the first-ranked paper of a query to each paper its passages speak of."""
    p = table(spark, d, "passages").where("trim(paper_id) <> ''").select("passage_id", "query_id", F.lower(F.trim("paper_id")).alias("paper_id"), "paper_title", "doi", "text").distinct()
    first = p.groupBy("query_id").agg(F.min_by("paper_id", "passage_id").alias("source"))
    doi = F.when(F.pmod("passage_id", F.lit(5)) == 0, F.concat(F.lit("10.99999/none."), F.col("passage_id").cast("string"))).when(F.pmod("passage_id", F.lit(3)) == 0, F.col("doi"))
    title = F.when((F.pmod("passage_id", F.lit(3)) == 1) & (F.pmod("passage_id", F.lit(5)) != 0), F.col("paper_title"))
    return p.join(first, "query_id").select(F.concat(F.lit("ref-"), F.col("passage_id").cast("string")).alias("reference_id"), F.col("source").alias("paper_id"), title.alias("title"), doi.alias("doi"), F.lit(None).cast("string").alias("label"), F.when(F.pmod("passage_id", F.lit(5)) != 0, F.concat(F.coalesce("paper_title", F.lit("")), F.lit(". "), F.coalesce("doi", F.lit("")))).alias("source_text"))


_REFS = r"""p0 AS (SELECT DISTINCT passage_id, query_id, lower(trim(paper_id, ' ')) AS paper_id, paper_title, doi, text FROM passages WHERE trim(paper_id, ' ') <> ''),
f0 AS (SELECT query_id, arg_min(paper_id, passage_id) AS source FROM p0 GROUP BY 1),
refs AS (SELECT 'ref-' || passage_id AS reference_id, source AS source_id, CASE WHEN passage_id % 3 = 1 AND passage_id % 5 <> 0 THEN paper_title END AS title, CASE WHEN passage_id % 5 = 0 THEN '10.99999/none.' || passage_id WHEN passage_id % 3 = 0 THEN doi END AS doi, CASE WHEN passage_id % 5 <> 0 THEN coalesce(paper_title, '') || '. ' || coalesce(doi, '') END AS source_text FROM p0 JOIN f0 USING (query_id)),
r1 AS (SELECT *, coalesce(nullif(lower(trim(doi, ' ')), ''), nullif(regexp_replace(lower(regexp_extract(source_text, '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b', 1)), '\.+$', ''), '')) AS r_doi, coalesce(nullif(title, ''), nullif(trim(split_part(source_text, '.', 1), ' '), '')) AS r_title FROM refs),
r2 AS (SELECT *, trim(regexp_replace(lower(r_title), '[^a-z0-9]+', ' ', 'g')) AS t_key FROM r1),
bd AS (SELECT lower(doi) AS r_doi, max(paper_id) AS d_id, arg_max(doi, paper_id) AS d_doi FROM curp WHERE trim(doi, ' ') <> '' GROUP BY 1),
bt AS (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t_key, max(paper_id) AS t_id, arg_max(doi, paper_id) AS t_doi FROM curp GROUP BY 1),
m AS (SELECT r2.*, coalesce(d_id, t_id) AS hit, CASE WHEN d_id IS NOT NULL THEN d_doi ELSE t_doi END AS hit_doi FROM r2 LEFT JOIN bd USING (r_doi) LEFT JOIN bt ON bt.t_key = r2.t_key),
cites AS (SELECT source_id, coalesce(hit, 'refpaper-' || substr(sha1(coalesce(r_doi, nullif(t_key, ''), trim(regexp_replace(lower(reference_id), '[^a-z0-9]+', ' ', 'g')))), 1, 16)) AS target_id, reference_id, CASE WHEN hit IS NULL THEN 0.72 WHEN hit_doi = lower(hit_doi) THEN 0.99 ELSE 0.88 END AS confidence, hit IS NULL AS stub FROM m WHERE hit IS NULL OR hit <> source_id)"""


@query(f"WITH {CURP}, {_REFS} SELECT {ID('cite', 'source_id', 'target_id', 'reference_id')} AS edge_id, source_id AS source_node_id, target_id AS target_node_id, confidence::DOUBLE AS confidence, stub AS is_stub_target FROM cites")
def citation_doi_title_match(spark, d):
    return E.citations(references(spark, d), current_papers(spark, d)).select("edge_id", "source_node_id", "target_node_id", "confidence", "is_stub_target")


@query(f"WITH {CURP}, {_REFS} SELECT target_id AS target_node_id, count(*) AS citations FROM cites WHERE stub GROUP BY 1")
def citation_stub_targets(spark, d):
    return E.citations(references(spark, d), current_papers(spark, d)).where("is_stub_target").groupBy("target_node_id").agg(F.count(F.lit(1)).alias("citations"))


@query(f"WITH {CURP}, {_REFS}, q AS (SELECT paper_id FROM curp WHERE published_year = 2020) SELECT reference_id, source_id, target_id FROM cites WHERE source_id IN (SELECT paper_id FROM q) OR target_id IN (SELECT paper_id FROM q)")
def citation_or_semi(spark, d):
    c = E.citations(references(spark, d), current_papers(spark, d)).withColumn("reference_id", F.col("edge_id"))
    refs = references(spark, d).select("reference_id", "paper_id")
    ids = current_papers(spark, d).where("published_year = 2020").select(F.col("paper_id").alias("pid"))
    hit = c.join(ids, c["source_node_id"] == ids["pid"], "left_semi").unionByName(c.join(ids, c["target_node_id"] == ids["pid"], "left_semi")).distinct()
    back = refs.select(F.col("reference_id").alias("rid"), "paper_id")
    keyed = hit.join(back, hit["source_node_id"] == back["paper_id"]).where(F.col("edge_id") == T.stable_id("cite", F.col("source_node_id"), F.col("target_node_id"), F.col("rid")))
    return keyed.select(F.col("rid").alias("reference_id"), F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"))


_CUES = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_VERB, _LIM, _HYP = (p.replace("(?i)", "").replace("'", "''") for p in (X.CLAIM_VERB, X.LIMITATION, X.HYPOTHESIS))
_KEYS = "|".join(X.CLAIM_KEYWORDS)
_CLAIMS = f"""s AS (SELECT chunk_id, paper_id, unnest({SENT.format('text')}) AS x FROM cur), s1 AS (SELECT chunk_id, paper_id, {COLLAPSE.format('x')} AS label FROM s),
s2 AS (SELECT *, regexp_matches(label, '{_VERB}', 'i') AS verb, regexp_matches(label, '{_LIM}', 'i') AS lim, regexp_matches(label, '{_HYP}', 'i') AS hyp, regexp_matches(lower(label), '{_KEYS}') AS kw FROM s1),
claims AS (SELECT DISTINCT chunk_id, label, CASE WHEN verb THEN 0.82 WHEN kw THEN 0.68 ELSE 0.55 END AS confidence, CASE WHEN lim THEN 'limitation' WHEN hyp THEN CASE WHEN contains(lower(label), 'future work') OR contains(lower(label), 'will') THEN 'future_work' ELSE 'hypothesis' END ELSE 'finding' END AS claim_type
 FROM s2 WHERE substr(label, 1, 1) = upper(substr(label, 1, 1)) AND substr(label, 1, 1) <> lower(substr(label, 1, 1)) AND (verb OR lim OR hyp OR kw) AND len(string_split(label, ' ')) >= 4)"""


@query(f"WITH {CUR}, {_CLAIMS} SELECT chunk_id, {ID('claim', 'label')} AS entity_id, label, confidence::DOUBLE AS confidence FROM claims")
def claim_extract(spark, d):
    return X.claims(current_chunks(spark, d)).select("chunk_id", "entity_id", "label", "confidence")


@query(f"WITH {CUR}, {_CLAIMS} SELECT claim_type, count(*) AS claims FROM claims GROUP BY 1")
def claim_type(spark, d):
    return X.claims(current_chunks(spark, d)).groupBy(F.col("properties")["claim_type"].alias("claim_type")).agg(F.count(F.lit(1)).alias("claims"))


def _claim_pairs(spark, d):
    """All claims of the chunks, each with its chunk's vector; pairs from the similarity 0.86."""
    u = cut(unit_chunks(spark, d))
    found = X.claims(u.select("chunk_id", "paper_id", "text"))
    claims = cut(found.select(F.concat_ws("@", "entity_id", "chunk_id").alias("id"), "paper_id", F.col("label").alias("text"), "chunk_id"))
    near = E.similar_pairs(u.select(F.col("chunk_id").alias("id"), "vec"), 0.86)
    of = lambda chunk, name: claims.select(F.col("chunk_id").alias(chunk), F.col("id").alias(name))
    pairs = near.withColumnsRenamed({"a": "chunk_a", "b": "chunk_b"}).join(of("chunk_a", "x"), "chunk_a").join(of("chunk_b", "y"), "chunk_b")
    return claims, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


_REL = f"""{CUR}, {_UNIT}, {_CLAIMS}, c AS (SELECT {ID('claim', 'label')} || '@' || chunk_id AS id, u.paper_id, label AS text, chunk_id, e FROM claims JOIN u USING (chunk_id)),
pr AS (SELECT a.id AS a, b.id AS b, lower(concat_ws(' ', a.text, b.text)) AS t, {_SIM} AS s FROM c a JOIN c b ON a.id < b.id AND a.paper_id <> b.paper_id WHERE {_SIM} >= 0.86),
cu AS (SELECT *, len([x for x in {_CUES(E.CONTRADICT_CUES)} if contains(t, x)]) AS cc, len([x for x in {_CUES(E.SUPPORT_CUES)} if contains(t, x)]) AS hh FROM pr)"""


@query(f"""WITH {_REL} SELECT a, b, CASE WHEN cc > hh THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS relation_type, round(round_even(greatest(0, least(1, CASE WHEN cc > hh THEN 0.52 + 0.38 * s + 0.05 * cc WHEN hh > 0 THEN 0.50 + 0.40 * s + 0.04 * hh ELSE 0.45 + 0.45 * s END)), 3), 2) AS confidence FROM cu WHERE cc > hh OR hh > 0 OR s >= 0.9""")
def claim_relation_edges(spark, d):
    claims, pairs = _claim_pairs(spark, d)
    return E.claim_edges(claims, pairs).select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"), "relation_type", F.round("confidence", 2).alias("confidence"))


@query(f"""WITH {CUR}, c AS (SELECT paper_id, chunk_id FROM cur GROUP BY 1, 2) SELECT DISTINCT {ID('grounded', 'entity_id', 'c.chunk_id')} AS edge_id, entity_id AS source_node_id, c.chunk_id AS target_node_id FROM entities e JOIN c ON e.source_chunk_id = c.chunk_id AND e.paper_id = c.paper_id WHERE lower(entity_type) = 'claim'""")
def grounded_in_edges(spark, d):
    return E.grounded_in(table(spark, d, "entities"), current_chunks(spark, d)).select("edge_id", "source_node_id", "target_node_id")


def result_rows(spark, d):
    p = table(spark, d, "entity_payloads").where("lower(trim(type)) = 'result'")
    return p.select(F.concat(F.lit("result-"), F.col("payload_id").cast("string")).alias("entity_id"), F.coalesce("name", "metric", F.lit("")).alias("label"), F.col("chunk_id").alias("source_chunk_id"), F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("metric", F.lit("")).alias("metric"), "text").distinct()


_RES = "r AS (SELECT DISTINCT 'result-' || payload_id AS entity_id, coalesce(dataset, '') AS dataset, coalesce(metric, '') AS metric FROM entity_payloads WHERE lower(trim(type, ' ')) = 'result')"


@query(f"WITH {_RES}, x AS (SELECT entity_id, unnest([trim(v, ' ') for v in string_split(dataset, ';')]) AS d FROM r) SELECT DISTINCT {ID('measured', 'entity_id', 'lower(d)')} AS edge_id, entity_id AS source_node_id, lower(d) AS target_label FROM x WHERE d <> ''")
def measured_on_edges(spark, d):
    return E.measured_on(result_rows(spark, d)).select("edge_id", "source_node_id", "target_label").distinct()


_MNODE = "'metric-' || coalesce(nullif(trim(regexp_replace(lower(substr(lower(metric), 1, 20)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"


@query(f"WITH {_RES} SELECT DISTINCT {ID('metric', 'entity_id', _MNODE)} AS edge_id, entity_id AS source_node_id, {_MNODE} AS target_node_id FROM r WHERE trim(metric, ' ') <> ''")
def using_metric_edges(spark, d):
    return E.using_metric(result_rows(spark, d)).select("edge_id", "source_node_id", "target_node_id")


def hierarchy(spark, d):
    """The canonical entries under their parent terms; and terms that share their first word under the
    first of them in the order of their spelling."""
    e = table(spark, d, "entities").where(~F.lower("entity_type").isin("claim", "result", "equation"))
    label = T.collapse(F.lower("label"))
    names = e.select(label.alias("term"), F.substring_index(label, " ", 1).alias("stem")).distinct()
    # The first three others are among the first four, so no family is gathered.
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("term"))).where("r <= 4").groupBy("stem").agg(F.sort_array(F.collect_list("term")).alias("first"))
    own = names.join(first, "stem").select("term", F.lit("go").alias("ontology_rank"), F.array_except("first", F.array("term")).alias("parents"))
    known = table(spark, d, "corpus_matches").where("label is not null and parent_terms is not null")
    return own.unionByName(known.select(F.lower("label").alias("term"), F.lit("mesh").alias("ontology_rank"), F.col("parent_terms").alias("parents")))


_L = COLLAPSE.format("lower(label)")


@query(f"""WITH base AS (SELECT * FROM entities WHERE lower(entity_type) NOT IN ('claim', 'result', 'equation')), r AS (SELECT paper_id, entity_id, min({_L}) AS label FROM base GROUP BY 1, 2),
al AS (SELECT DISTINCT paper_id, entity_id, {COLLAPSE.format('lower(a)')} AS name FROM (SELECT paper_id, entity_id, unnest(aliases) AS a FROM base)), nm AS (SELECT paper_id, entity_id, label AS name FROM r UNION SELECT * FROM al),
t AS (SELECT DISTINCT {_L} AS term FROM base), up AS (SELECT a.term, b.term AS parent, 'go' AS o, row_number() OVER (PARTITION BY a.term ORDER BY b.term) AS p FROM t a JOIN t b ON split_part(a.term, ' ', 1) = split_part(b.term, ' ', 1) AND a.term <> b.term QUALIFY p <= 3
UNION ALL SELECT {_L} AS term, {COLLAPSE.format('lower(parent_terms[i])')} AS parent, 'mesh', i AS p FROM corpus_matches, range(1, 50) r(i) WHERE label IS NOT NULL AND i <= len(parent_terms)),
h AS (SELECT term, parent, row_number() OVER (PARTITION BY term ORDER BY min((o, p)), parent) AS k FROM up WHERE parent <> '' GROUP BY 1, 2)
SELECT DISTINCT r.entity_id AS source_node_id, nm.entity_id AS target_node_id FROM r JOIN h ON h.term = r.label AND k <= 3 JOIN nm ON nm.paper_id = r.paper_id AND nm.name = h.parent WHERE r.entity_id <> nm.entity_id""")
def is_a_edges(spark, d):
    return E.is_a(table(spark, d, "entities"), hierarchy(spark, d)).select("source_node_id", "target_node_id").distinct()


@query(f"""WITH {CUR}, {CURP}, {_REFS}, {_RES}, g AS (SELECT DISTINCT entity_id, c.chunk_id FROM entities e JOIN (SELECT DISTINCT paper_id, chunk_id FROM cur) c ON e.source_chunk_id = c.chunk_id AND e.paper_id = c.paper_id WHERE lower(entity_type) = 'claim'),
x AS (SELECT entity_id, unnest([trim(v, ' ') for v in string_split(dataset, ';')]) AS d FROM r)
SELECT 'CITES' AS relation_type, (SELECT count(*) FROM cites) AS edges UNION ALL SELECT 'GROUNDED_IN', (SELECT count(*) FROM g) UNION ALL SELECT 'MEASURED_ON', (SELECT count(DISTINCT (entity_id, lower(d))) FROM x WHERE d <> '') UNION ALL SELECT 'USING_METRIC', (SELECT count(DISTINCT (entity_id, {_MNODE})) FROM r WHERE trim(metric, ' ') <> '')""")
def edge_union(spark, d):
    r = result_rows(spark, d)
    all_ = E.union_edges(E.citations(references(spark, d), current_papers(spark, d)), E.grounded_in(table(spark, d, "entities"), current_chunks(spark, d)), E.measured_on(r), E.using_metric(r))
    return all_.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))


_MERGED = f"e AS (SELECT DISTINCT record_id, entity_id, lower(trim(entity_type, ' ')) AS t, {COLLAPSE.format('label')} AS l, confidence, created_at, mention_chunk_ids AS mc, aliases AS al, embedding, properties FROM entities)"


@query(f"""WITH {_MERGED}, m AS (SELECT entity_id, count(DISTINCT x) AS n FROM (SELECT entity_id, unnest(mc) AS x FROM e) GROUP BY 1), a AS (SELECT entity_id, count(DISTINCT x) AS n FROM (SELECT entity_id, unnest(al) AS x FROM e) GROUP BY 1),
b AS (SELECT entity_id, min(t) AS entity_type, max(confidence) AS confidence, count(DISTINCT record_id) AS records, bool_or(embedding IS NOT NULL) AS has_embedding, arg_min(cardinality(properties), (created_at, record_id)) FILTER (WHERE properties IS NOT NULL) AS properties FROM e GROUP BY 1)
SELECT b.entity_id, entity_type, confidence, records, coalesce(m.n, 0) AS mentions, coalesce(a.n, 0) AS aliases, has_embedding, properties::INT AS properties FROM b LEFT JOIN m USING (entity_id) LEFT JOIN a USING (entity_id)""")
def entity_merge(spark, d):
    m = N.merge_entities(table(spark, d, "entities"), "entity_id")
    return m.select("entity_id", "entity_type", "confidence", "records", "mentions", "aliases", F.col("embedding").isNotNull().alias("has_embedding"), F.when(F.col("properties").isNotNull(), F.size("properties")).alias("properties"))


@query(f"WITH {_MERGED} SELECT DISTINCT entity_id, 'mention' AS role, x AS value FROM (SELECT entity_id, unnest(mc) AS x FROM e) WHERE x IS NOT NULL UNION ALL SELECT DISTINCT entity_id, 'alias', x FROM (SELECT entity_id, unnest(al) AS x FROM e) WHERE x IS NOT NULL")
def entity_members(spark, d):
    return N.members(table(spark, d, "entities"), "entity_id")


@query("SELECT lower(trim(entity_type, ' ')) AS entity_type, count(DISTINCT record_id) AS records, count(DISTINCT entity_id) AS entities FROM entities GROUP BY 1")
def entity_histogram(spark, d):
    return N.type_histogram(table(spark, d, "entities"))


@query()
def canonical_groups(spark, d):
    """Each entity with the leader of its group, all types, by vectors where both have one, else by labels."""
    m = N.merge_entities(table(spark, d, "entities"), "entity_id")
    return N.leader_groups(m.select("entity_id", "entity_type", "label", F.when(usable("embedding") & (V.norm(F.col("embedding")) > 0), V.unit(F.col("embedding"))).alias("vec"), F.col("first_seen").alias("seq")))


_ASK = "how does quirecosol gradient affect the membrane receptor"


@query(f"""WITH n AS (SELECT entity_id, {_L} AS n FROM entities UNION SELECT entity_id, {COLLAPSE.format('lower(a)')} FROM (SELECT entity_id, unnest(aliases) AS a FROM entities)),
s AS (SELECT entity_id, max(CASE WHEN n = '' OR n IS NULL THEN 0.0 WHEN contains('{_ASK}', n) THEN 4.0 + least(len(string_split(n, ' ')), 3) ELSE len(list_intersect(list_distinct(regexp_extract_all(n, '[A-Za-z0-9][A-Za-z0-9_+-]*')), list_distinct(string_split('{_ASK}', ' ')))) END)::DOUBLE AS score FROM n GROUP BY 1)
SELECT entity_id, score FROM s WHERE score > 0 ORDER BY score DESC, entity_id LIMIT 25""")
def query_entity_linking(spark, d):
    return N.link_query(table(spark, d, "entities"), _ASK, 25)


@query(f"""WITH {CUR}, ids AS (SELECT DISTINCT entity_id FROM entities WHERE lower(trim(entity_type, ' ')) = 'concept' AND contains(lower(label), 'membrane')), m AS (SELECT DISTINCT unnest(mention_chunk_ids) AS chunk_id, entity_id FROM entities)
SELECT m.chunk_id, count(DISTINCT m.entity_id) AS mention_count, max(coalesce(salience_score, 0)) AS salience FROM m JOIN ids USING (entity_id) JOIN cur ON cur.chunk_id = m.chunk_id GROUP BY 1""")
def mention_lookup(spark, d):
    e = table(spark, d, "entities")
    ids = e.where("lower(trim(entity_type)) = 'concept' and contains(lower(label), 'membrane')").select("entity_id")
    return G.mentioning_chunks(G.mentions(e), current_chunks(spark, d), ids)


def trade(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


_TRADE = "e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS k FROM e GROUP BY 1), c AS (SELECT count(*) AS n FROM n)"


def _rank_sql(rounds: int) -> str:
    parts = [_TRADE, "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM n, c)"]
    for i in range(rounds):
        parts.append(f"l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM deg))")
        parts.append(f"f{i} AS (SELECT dst, sum(rank / k) AS inflow FROM e JOIN r{i} ON node = e.src JOIN deg ON deg.src = e.src GROUP BY 1)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / c.n + 0.85 * (coalesce(inflow, 0) + lost / c.n) AS rank FROM n LEFT JOIN f{i} ON dst = n.node, c, l{i})")
    return "WITH " + ", ".join(parts) + f" SELECT node, round(rank, 10) AS rank FROM r{rounds}"


@query(_rank_sql(20))
def pagerank(spark, d):
    return G.pagerank(trade(spark, d)).select("node", F.round("rank", 10).alias("rank"))


@query(f"WITH {_TRADE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT DISTINCT src AS node, 0 AS distance FROM e WHERE src = (SELECT min(src) FROM e)), h1 AS (SELECT node, distance FROM h0 UNION ALL SELECT DISTINCT dst, 1 FROM b JOIN h0 ON src = node WHERE dst NOT IN (SELECT node FROM h0)), h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT dst, 2 FROM b JOIN h1 ON src = node WHERE dst NOT IN (SELECT node FROM h1)), h3 AS (SELECT * FROM h2 UNION ALL SELECT DISTINCT dst, 3 FROM b JOIN h2 ON src = node WHERE dst NOT IN (SELECT node FROM h2)) SELECT node, distance FROM h3")
def khop_neighborhood(spark, d):
    e = trade(spark, d)
    return G.neighbourhood(e, e.agg(F.min("src").alias("node")), 3)


@query(f"WITH {_REL}, q AS (SELECT a, b, CASE WHEN cc > hh THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS relation_type FROM cu WHERE cc > hh OR hh > 0 OR s >= 0.9) SELECT a AS claim_id, least(count(*), 10)::BIGINT AS related FROM (SELECT a, b FROM q UNION ALL SELECT b, a FROM q) GROUP BY 1")
def related_claims(spark, d):
    claims, pairs = _claim_pairs(spark, d)
    return G.related_claims(E.claim_edges(claims, pairs)).groupBy("claim_id").agg(F.count(F.lit(1)).alias("related"))


@query(f"""WITH {CUR}, {CURP} SELECT DISTINCT e.entity_id AS claim_id, cur.chunk_id, cur.section_id, cur.paper_id, curp.title FROM entities e JOIN cur ON e.source_chunk_id = cur.chunk_id AND e.paper_id = cur.paper_id JOIN curp ON curp.paper_id = cur.paper_id WHERE lower(entity_type) = 'claim'""")
def claim_provenance(spark, d):
    c = current_chunks(spark, d)
    return G.claim_provenance(E.grounded_in(table(spark, d, "entities"), c), c, current_papers(spark, d))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark, d):
    return S.latest_status(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_type AS status, count(*) AS papers, avg(CASE WHEN event_type = 'complete' THEN value END) AS avg_quality FROM (SELECT event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 500) GROUP BY 1")
def quality_report(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("paper_id"), F.col("event_type").alias("status"), F.col("value").alias("quality"), F.col("ts").alias("last_attempted"))
    return S.quality_report(log, 500)


@query("SELECT label, entity_type, preferred_corpus, sum(coalesce(miss_count, 0))::BIGINT AS misses FROM corpus_misses GROUP BY 1, 2, 3 ORDER BY misses DESC, max(last_seen) DESC NULLS LAST, label, entity_type NULLS FIRST, preferred_corpus NULLS FIRST LIMIT 50")
def miss_report(spark, d):
    return S.miss_report(table(spark, d, "corpus_misses"), 50).drop("last_seen")


@query("SELECT DISTINCT paper_id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.paper_id = p.paper_id AND lower(e.entity_type) = 'equation')")
def checkpoint_anti_join(spark, d):
    p = table(spark, d, "papers").select("paper_id").distinct()
    done = table(spark, d, "entities").where("lower(entity_type) = 'equation'").select("paper_id", F.lit("complete").alias("status"))
    return S.to_do(p, done, ["paper_id"])


@query("""WITH t AS (SELECT max(epoch_us(ts)) + 60000000 AS now FROM events), f AS (SELECT event_type AS service, count(*) FILTER (WHERE value < 20 AND epoch_us(ts) > coalesce(l, -1e18)) AS failures, max(epoch_us(ts)) FILTER (WHERE value < 20 AND epoch_us(ts) > coalesce(l, -1e18)) AS last_failure
FROM events LEFT JOIN (SELECT event_type AS et, max(epoch_us(ts)) FILTER (WHERE value >= 20) AS l FROM events GROUP BY 1) ON et = event_type GROUP BY 1)
SELECT service, failures, failures >= 2 AND coalesce(now - last_failure < 3600000000, false) AS open FROM f, t""")
def breaker_states(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("value") >= 20).alias("ok"))
    now = log.agg(F.max("at")).first()[0]
    return S.breaker_states(log, 2, 3.6e9, (now or 0.0) + 6e7)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("""SELECT 'chunks_without_paper' AS check_name, (SELECT count(DISTINCT chunk_id) FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM papers)) AS orphans UNION ALL
SELECT 'claims_without_chunk', (SELECT count(DISTINCT entity_id) FROM entities e WHERE lower(entity_type) = 'claim' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = e.source_chunk_id)) UNION ALL
SELECT 'papers_without_authors', (SELECT count(DISTINCT paper_id) FROM papers p WHERE NOT EXISTS (SELECT 1 FROM authors a WHERE a.paper_id = p.paper_id))""")
def orphan_checks(spark, d):
    chunks, papers, entities, authors = (table(spark, d, t) for t in ("chunks", "papers", "entities", "authors"))
    n = lambda name, df, key: df.agg(F.count_distinct(key).alias("orphans")).select(F.lit(name).alias("check_name"), "orphans")
    claims = entities.where("lower(entity_type) = 'claim'")
    return (
        n("chunks_without_paper", chunks.join(papers, "paper_id", "left_anti"), "chunk_id")
        .unionByName(n("claims_without_chunk", claims.join(chunks, claims["source_chunk_id"] == chunks["chunk_id"], "left_anti"), "entity_id"))
        .unionByName(n("papers_without_authors", papers.join(authors, "paper_id", "left_anti"), "paper_id"))
    )


SCHEMAS = {
    "base": X.Schema("base", {"result": ["metric"], "concept": ["name"], "method": ["name"], "claim": ["text"]}, (X.Rule("claim", "min_words", "text", 5), X.Rule("concept", "max_words", "name", 6))),
    "measured": X.Schema("measured", {"result": ["value"]}, (X.Rule("result", "numeric_value", "value"),), "base"),
}


@query("""WITH p AS (SELECT DISTINCT payload_id, lower(trim(type, ' ')) AS t, trim(coalesce(name, ''), ' ') AS name, trim(coalesce(text, ''), ' ') AS text, trim(coalesce(value, ''), ' ') AS value, trim(coalesce(metric, ''), ' ') AS metric, confidence FROM entity_payloads),
w AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\\s+')) END AS tw, CASE WHEN name = '' THEN 0 ELSE len(regexp_split_to_array(name, '\\s+')) END AS nw FROM p)
SELECT payload_id, NOT ((t = 'result' AND (metric = '' OR value = '' OR try_cast(value AS DOUBLE) IS NULL)) OR (t IN ('concept', 'method') AND name = '') OR (t = 'claim' AND (text = '' OR tw < 5)) OR (t = 'concept' AND nw > 6) OR t IS NULL OR t NOT IN ('result', 'concept', 'method', 'claim') OR confidence IS NULL OR isnan(confidence) OR confidence NOT BETWEEN 0 AND 1) AS valid FROM w""")
def validation_rules(spark, d):
    p = table(spark, d, "entity_payloads").select("payload_id", "type", "name", "text", "value", "metric", "confidence").distinct()
    # Java reads "1f" or "1d" as a number; the rule means plain ones.
    plain = p.withColumn("value", F.when(F.trim("value").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim("value")).otherwise(F.when(F.trim("value") == "", "").otherwise("x")))
    return X.validate(plain, X.resolve(SCHEMAS, "measured")).select("payload_id", "valid")


DOMAINS = {"biology": {2: ["receptor", "kinase", "plasmid", "tumour"], 1: ["cell", "staining"]}, "matter": {2: ["lattice", "oxide", "polymer"], 1: ["annealing", "spectroscopy"]}}
_DTEXT = "lower(concat_ws(' ', title, journal.name, array_to_string(keywords, ' '), abstract))"
_DSUM = lambda g: " + ".join(f"CASE WHEN contains(t, '{m}') THEN {p} ELSE 0 END" for p, ms in g.items() for m in ms)


@query(f"WITH {CURP}, t AS (SELECT paper_id, {_DTEXT} AS t FROM curp), s AS (SELECT paper_id, {_DSUM(DOMAINS['biology'])} AS b, {_DSUM(DOMAINS['matter'])} AS m FROM t) SELECT paper_id, greatest(b, m) AS domain_score, CASE WHEN m > b THEN 'matter' WHEN b > 0 THEN 'biology' ELSE 'general' END AS domain FROM s")
def domain_detect(spark, d):
    text = F.concat_ws(" ", "title", F.col("journal.name"), F.array_join("keywords", " "), "abstract")
    return X.detect_domain(current_papers(spark, d), text, DOMAINS).select("paper_id", "domain_score", "domain")


@query(f"WITH {CUR}, s AS (SELECT chunk_id, {COLLAPSE.format('x')} AS label FROM (SELECT chunk_id, unnest({SENT.format('text')}) AS x FROM cur)) SELECT DISTINCT chunk_id, {ID('equation', 'label')} AS entity_id, regexp_matches(label, '\\bloss\\b|cross-entropy|negative log likelihood', 'i') AS is_loss FROM s WHERE regexp_matches(label, '[=≈≤≥]') AND regexp_matches(label, '[A-Za-z]') AND length(label) >= 8")
def equation_extract(spark, d):
    return X.equations(current_chunks(spark, d)).select("chunk_id", "entity_id", (F.col("properties")["is_loss_fn"] == "true").alias("is_loss"))


METRICS = ["accuracy", "recovery", "baseline"]


@query()
def result_extract(spark, d):
    return X.results(current_chunks(spark, d), METRICS)


CONCEPT_ENDINGS = ["lattice", "membrane", "receptor", "kinase", "channel", "oxide", "polymer", "pathway", "plasmid", "isotope"]


def with_keywords(spark, d, chunks):
    return chunks.join(current_papers(spark, d).select("paper_id", "keywords"), "paper_id", "left")


_q = lambda p: p.replace("(?U)", "").replace("'", "''")
_VALID = "length(label) >= 2 AND NOT regexp_matches(label, '^[0-9]+$') AND lower(label) NOT IN (" + ", ".join(f"'{w}'" for w in X.COMMON_HEADS) + ") AND len(regexp_split_to_array(label, '\\s+')) <= 6"
_FOUND = lambda m: COLLAPSE.format(m)


_EACH = lambda pattern: f"(SELECT chunk_id, unnest(l) AS m, generate_subscripts(l, 1) AS pos FROM (SELECT chunk_id, regexp_extract_all(text, '{pattern}', 1) AS l FROM cur))"


@query(f"""WITH {CUR}, {CURP}, k AS (SELECT chunk_id, text, unnest(keywords) AS m, generate_subscripts(keywords, 1) AS pos FROM cur JOIN curp USING (paper_id)),
x AS (SELECT chunk_id, {_FOUND('m')} AS label, 0.92 AS confidence, pos FROM k WHERE trim(m, ' ') <> '' AND contains(lower(text), lower({_FOUND('m')}))
UNION ALL SELECT * FROM (SELECT chunk_id, {_FOUND('m')} AS label, 0.86, pos FROM {_EACH(_q(X.SYMBOL))}) WHERE {_VALID}
UNION ALL SELECT chunk_id, label, CASE WHEN upper(label) = label AND lower(label) <> label THEN 0.72 ELSE 0.62 END, pos FROM (SELECT chunk_id, pos, {_FOUND(f"regexp_replace(m, '{X.OPENERS}', '')")} AS label FROM {_EACH(_q(X.PHRASE))}) WHERE {_VALID}
UNION ALL SELECT * FROM (SELECT chunk_id, {_FOUND(f"regexp_replace(lower(m), '{X.ENDING_LEADS}', '')")} AS label, 0.6, pos FROM {_EACH(X.ending_pattern(CONCEPT_ENDINGS))}) WHERE {_VALID})
SELECT chunk_id, {ID('concept', 'lower(label)')} AS entity_id, arg_min(label, (-confidence, pos)) AS label, max(confidence)::DOUBLE AS confidence FROM x GROUP BY 1, 2""")
def concept_extract(spark, d):
    return X.concepts(with_keywords(spark, d, current_chunks(spark, d).select("chunk_id", "paper_id", "text")), "keywords", CONCEPT_ENDINGS).select("chunk_id", "entity_id", "label", "confidence")


METHODS = {"suffixes": ["metry", "scopy", "graphy", "ation"], "lexicon": ["linear fit"]}
_MLAB = f"regexp_replace({_FOUND('m')}, '{_q(X._LEAD)}', '')"


@query(f"""WITH {CUR}, x AS (SELECT chunk_id, {_FOUND(_MLAB)} AS label, CASE WHEN chunk_type = 'methods' THEN 0.68 ELSE 0.55 END AS confidence FROM (SELECT chunk_id, chunk_type, unnest(regexp_extract_all(text, '{_q(X.METHOD_PHRASE)}', 1)) AS m FROM cur)
UNION ALL SELECT chunk_id, {_FOUND(_MLAB)}, CASE WHEN chunk_type = 'methods' THEN 0.68 ELSE 0.55 END FROM (SELECT chunk_id, chunk_type, unnest(regexp_extract_all(text, '{_q(X.suffix_pattern(METHODS["suffixes"]))}', 1)) AS m FROM cur)
UNION ALL SELECT chunk_id, {_FOUND('lower(m)')}, CASE WHEN chunk_type = 'methods' THEN 0.88 ELSE 0.78 END FROM (SELECT chunk_id, chunk_type, unnest(regexp_extract_all(text, '(?i)\\b(linear fit)\\b', 1)) AS m FROM cur))
SELECT chunk_id, {ID('method', 'lower(label)')} AS entity_id, max(confidence)::DOUBLE AS confidence FROM x WHERE length(label) >= 5 AND contains(label, ' ') GROUP BY 1, 2""")
def method_extract(spark, d):
    return X.methods(current_chunks(spark, d), **METHODS).select("chunk_id", "entity_id", "confidence")


DATASET_NOUNS = ["survey", "cohort", "catalogue", "registry", "benchmark", "archive", "panel", "atlas"]


@query()
def dataset_extract(spark, d):
    return X.datasets(current_chunks(spark, d), DATASET_NOUNS, X.dataset_registry(current_papers(spark, d)))


@query()
def chunk_salience(spark, d):
    c = current_chunks(spark, d).select("chunk_id", "paper_id", "text", "chunk_type", "word_count")
    e = X.claims(c).unionByName(X.equations(c)).unionByName(X.concepts(with_keywords(spark, d, c), "keywords", CONCEPT_ENDINGS))
    e = e.unionByName(X.results(c, METRICS)).unionByName(X.methods(c, **METHODS)).unionByName(X.datasets(c, DATASET_NOUNS, X.dataset_registry(current_papers(spark, d))))
    return X.salience(c, e)


@query("SELECT label, entity_type, arg_min(ontology, p * 1000000 + row_no) AS ontology FROM (SELECT DISTINCT m.label, lower(m.entity_type) AS entity_type, c.ontology, r.p, row_number() OVER (ORDER BY c.external_id) AS row_no FROM corpus_misses m LEFT JOIN corpus_matches c ON lower(trim(m.label, ' ')) = lower(trim(c.label, ' ')) LEFT JOIN (VALUES ('concept', 'chem', 0), ('concept', 'matter', 1), ('method', 'mesh-like', 0), ('method', 'chem', 1), ('dataset', 'matter', 0)) r(t, o, p) ON r.t = lower(m.entity_type) AND r.o = c.ontology WHERE m.label IS NOT NULL AND m.entity_type IS NOT NULL) WHERE p IS NOT NULL OR ontology IS NULL GROUP BY 1, 2 HAVING arg_min(ontology, p * 1000000 + row_no) IS NOT NULL")
def ontology_enrichment(spark, d):
    labels = table(spark, d, "corpus_misses").where("label is not null and entity_type is not null")
    routes = [("concept", "chem"), ("concept", "matter"), ("method", "mesh-like"), ("method", "chem"), ("dataset", "matter")]
    return S.enrich(labels, table(spark, d, "corpus_matches"), routes).where("ontology is not null").select("label", "entity_type", "ontology")


@query(f"WITH {CUR}, {CURP}, x AS (SELECT paper_id AS s, 'HAS_SECTION' AS r, section_id AS o FROM cur UNION SELECT section_id, 'HAS_CHUNK', chunk_id FROM cur UNION SELECT chunk_id, 'NEXT', next_chunk_id FROM cur UNION SELECT paper_id, 'PUBLISHED_IN', journal.journal_id FROM curp UNION SELECT paper_id, 'AUTHORED_BY', author_id FROM authors) SELECT r AS relation, count(*) AS edges FROM x WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1")
def structure_edges(spark, d):
    return G.structure_edges(current_chunks(spark, d), current_papers(spark, d), table(spark, d, "authors")).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {CUR}, {CURP}, e AS (SELECT DISTINCT source_chunk_id AS s, entity_id AS t, paper_id FROM entities), p AS (SELECT DISTINCT paper_id, journal.journal_id AS j FROM papers)
SELECT 'chunk_to_entity' AS edge, (SELECT count(*) FROM (SELECT DISTINCT s, t FROM e) WHERE s IN (SELECT chunk_id FROM cur) AND t IN (SELECT entity_id FROM entities)) AS edges
UNION ALL SELECT 'paper_to_journal', (SELECT count(*) FROM p WHERE j IN (SELECT journal_id FROM documents))""")
def existing_endpoints(spark, d):
    """Edges with both ends there; and of another sort only the target asked for."""
    n = lambda name, e: e.agg(F.count(F.lit(1)).alias("edges")).select(F.lit(name).alias("edge"), "edges")
    entities = table(spark, d, "entities")
    e = entities.select(F.col("source_chunk_id").alias("source_node_id"), F.col("entity_id").alias("target_node_id")).distinct()
    nodes = current_chunks(spark, d).select(F.col("chunk_id").alias("node_id")).unionByName(entities.select(F.col("entity_id").alias("node_id")))
    p = table(spark, d, "papers").select(F.col("paper_id").alias("source_node_id"), F.col("journal.journal_id").alias("target_node_id")).distinct()
    journals = table(spark, d, "documents").select(F.col("journal_id").alias("node_id"))
    return n("chunk_to_entity", E.existing_ends(e, nodes)).unionByName(n("paper_to_journal", E.existing_ends(p, journals, source=False)))
