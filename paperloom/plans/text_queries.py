"""Scalar functions, chunk links and statistics over the literature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import chunking as C
from paperloom.operators import ranking as R
from paperloom.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once: its last load."""
    return C.latest(table(spark, d, "chunks"), "chunk_id", "ingested_at", "deleted_at", "word_count", "salience_score", "ordinal")


def current_papers(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "papers"), "paper_id", "ingested_at", "deleted_at", "source_path", "published_year")


#: The same in SQL.
CUR = """cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, deleted_at DESC NULLS LAST, word_count DESC NULLS LAST, salience_score DESC NULLS LAST, ordinal DESC NULLS LAST) = 1)"""
CURP = """curp AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC NULLS LAST, deleted_at DESC NULLS LAST, source_path DESC NULLS LAST, published_year DESC NULLS LAST) = 1)"""
W = r"[\p{L}\p{N}_]+"
TOK = r"[A-Za-z0-9][A-Za-z0-9_+-]*"
STOP = "('" + "','".join(T.RANKING_STOPWORDS) + "')"
OSTOP = "('" + "','".join(T.OVERLAP_STOPWORDS) + "')"
SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"
TOKENS = f"[lower(x) for x in regexp_extract_all(coalesce({{0}}, ''), '{TOK}')]"
COLLAPSE = r"trim(regexp_replace({0}, '[\s\x{{00a0}}\x{{2007}}\x{{202f}}\x{{2009}}]+', ' ', 'g'))"
SENTENCES = "[trim(x) for x in string_split(regexp_replace(trim({0}), '([.!?])\\s+', '\\1\x01', 'g'), '\x01') if trim(x) <> '']"


@query(f"SELECT DISTINCT title, {SLUG.format('title')} AS slug FROM papers WHERE title IS NOT NULL")
def slug_ids(spark, d):
    return table(spark, d, "papers").where("title is not null").select("title", T.slug(F.col("title")).alias("slug")).distinct()


@query("SELECT DISTINCT label, 'concept-' || substr(sha1('concept' || '::' || coalesce(lower(label), '')), 1, 16) AS id FROM entities WHERE lower(trim(entity_type)) = 'concept'")
def stable_ids_sha1(spark, d):
    e = table(spark, d, "entities").where(F.lower(F.trim("entity_type")) == "concept")
    return e.select("label", T.stable_id("concept", F.lit("concept"), F.lower("label")).alias("id")).distinct()


@query("SELECT DISTINCT paper_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM papers")
def title_normalize(spark, d):
    return table(spark, d, "papers").select("paper_id", T.title_key(F.col("title")).alias("title_key")).distinct()


@query(f"SELECT record_id, {COLLAPSE.format('label')} AS label FROM (SELECT DISTINCT record_id, label FROM entities)")
def whitespace_normalize(spark, d):
    return table(spark, d, "entities").select("record_id", "label").distinct().select("record_id", T.collapse(F.col("label")).alias("label"))


@query(f"""WITH {CUR}, t AS (SELECT chunk_id, {COLLAPSE.format('text')} AS x FROM cur)
SELECT chunk_id, CASE WHEN x = '' OR x IS NULL THEN NULL WHEN regexp_extract(x, '^(.+?[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(x, '^(.+?[.!?])(?:\\s|$)', 1)
ELSE array_to_string(string_split(x, ' ')[1:24], ' ') END AS first_sentence FROM t""")
def first_sentence(spark, d):
    return current_chunks(spark, d).select("chunk_id", T.first_sentence(F.col("text")).alias("first_sentence"))


_KIND = "CASE " + " ".join(f"WHEN contains(s, '{a}') THEN '{b}'" for a, b in T.SECTION_KINDS) + " ELSE 'body' END"


@query(f"SELECT DISTINCT section_title, {_KIND} AS section_type FROM (SELECT section_title, {SLUG.format('section_title')} AS s FROM passages WHERE section_title IS NOT NULL)")
def section_type_map(spark, d):
    return table(spark, d, "passages").where("section_title is not null").select("section_title").distinct().select("section_title", T.section_type(F.col("section_title")).alias("section_type"))


@query(r"SELECT DISTINCT passage_id, nullif(regexp_replace(lower(regexp_extract(doi, '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b', 1)), '\.+$', ''), '') AS doi FROM passages WHERE doi IS NOT NULL")
def doi_extract(spark, d):
    return table(spark, d, "passages").where("doi is not null").select("passage_id", T.doi_in(F.col("doi")).alias("doi")).distinct()


@query(f"WITH {CUR} SELECT chunk_id, i - 1 AS position, s[i] AS sentence FROM (SELECT chunk_id, {SENTENCES.format('text')} AS s FROM cur), range(1, 10000) r(i) WHERE i <= len(s)")
def sentence_split(spark, d):
    return current_chunks(spark, d).select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query(f"WITH {CUR} SELECT chunk_id, len(regexp_extract_all(text, '{W}')) AS words FROM cur WHERE text IS NOT NULL")
def word_count(spark, d):
    return current_chunks(spark, d).where("text is not null").select("chunk_id", T.word_count(F.col("text")).alias("words"))


@query(f"""WITH {CUR}, t AS (SELECT chunk_id, text, regexp_extract_all(text, '{W}') AS w FROM cur WHERE text IS NOT NULL),
n AS (SELECT chunk_id, greatest(len(w), 1) AS n, length(text) - length(replace(text, '[', '')) AS c, len([x for x in w if regexp_full_match(x, '\\d+')]) AS dg,
len([x for x in w if length(x) > 1 AND x = upper(x) AND x <> lower(x)]) AS up FROM t)
SELECT chunk_id, round_even(round_even(least(0.35::DOUBLE + least(c, 5) * 0.05::DOUBLE + least(dg / n, 0.2::DOUBLE) + least(up / n, 0.15::DOUBLE), 1.0::DOUBLE), 3), 1) AS salience FROM n""")
def base_salience(spark, d):
    # Rounded once more, as the last digit of a half depends on the engine.
    return current_chunks(spark, d).where("text is not null").select("chunk_id", F.bround(T.base_salience(F.col("text")), 1).alias("salience"))


@query(f"WITH {CUR} SELECT chunk_id, array_to_string(regexp_extract_all(text, '{W}')[-8:], ' ') AS tail FROM cur WHERE text IS NOT NULL")
def tail_words(spark, d):
    return current_chunks(spark, d).where("text is not null").select("chunk_id", T.tail_words(F.col("text"), 8).alias("tail"))


@query(f"WITH {CUR}, t AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM cur) SELECT chunk_id, term, count(*) AS tf FROM t WHERE length(term) > 2 AND term NOT IN {STOP} GROUP BY ALL")
def term_freq(spark, d):
    return R.term_frequencies(current_chunks(spark, d), "chunk_id", "text")


@query(f"WITH {CUR} SELECT chunk_id, len([x for x in {TOKENS.format('text')} if length(x) > 2 AND x NOT IN {STOP}]) AS kept, len({TOKENS.format('text')}) AS all_tokens FROM cur")
def token_filter(spark, d):
    return current_chunks(spark, d).select("chunk_id", F.size(T.ranking_tokens(F.col("text"))).alias("kept"), F.size(T.tokens(F.col("text"))).alias("all_tokens"))


@query(f"""WITH {CUR}, n AS (SELECT greatest(count(*), 1) AS n FROM cur), t AS (SELECT DISTINCT chunk_id, unnest({TOKENS.format('text')}) AS term FROM cur), f AS (SELECT term, count(*) AS df FROM t WHERE length(term) > 2 AND term NOT IN {STOP} GROUP BY 1)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n""")
def doc_freq_idf(spark, d):
    return R.document_frequencies(current_chunks(spark, d), "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CUR} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM cur WINDOW w AS (PARTITION BY section_id ORDER BY ordinal)")
def chunk_links_lag_lead(spark, d):
    return C.with_links(current_chunks(spark, d).select("chunk_id", "section_id", "ordinal")).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"WITH {CUR} SELECT chunk_id, md5(coalesce(lag(text) OVER w, '')) AS before, md5(coalesce(lead(text) OVER w, '')) AS after FROM cur WINDOW w AS (PARTITION BY paper_id ORDER BY section_id, ordinal)")
def chunk_context_window(spark, d):
    c = C.chunk_context(current_chunks(spark, d).select("chunk_id", "paper_id", "section_id", "ordinal", "text"))
    return c.select("chunk_id", F.md5(F.coalesce("previous_text", F.lit(""))).alias("before"), F.md5(F.coalesce("next_text", F.lit(""))).alias("after"))


@query()
def greedy_chunking(spark, d):
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("section_id"), F.col("source").alias("paper_id"), "text")
    return C.chunk_sections(docs, 60, 10)


@query("SELECT DISTINCT external_id, label, a AS alias, contains(lower(a), lower(label)) OR contains(lower(label), lower(a)) OR (array_to_string([upper(substr(w, 1, 1)) for w in regexp_split_to_array(label, '\\s+') if w <> ''], '') <> '' AND contains(array_to_string([upper(substr(w, 1, 1)) for w in regexp_split_to_array(a, '\\s+') if w <> ''], ''), array_to_string([upper(substr(w, 1, 1)) for w in regexp_split_to_array(label, '\\s+') if w <> ''], ''))) AS similar FROM (SELECT external_id, label, unnest(aliases) AS a FROM corpus_matches)")
def label_similarity_pairs(spark, d):
    m = table(spark, d, "corpus_matches").select("external_id", "label", F.explode("aliases").alias("alias")).distinct()
    return m.select("external_id", "label", "alias", T.label_similar(F.col("label"), F.col("alias")).alias("similar"))


QUERY = "spectroscopy of the lattice and the signal of the membrane"
_Q = "['" + "','".join(dict.fromkeys(t for t in R.query_terms(QUERY) if t not in T.OVERLAP_STOPWORDS)) + "']"


@query(f"WITH {CUR} SELECT chunk_id, round(len(list_intersect({_Q}, {TOKENS.format('text')})) / len({_Q}), 6) AS overlap FROM cur")
def lexical_overlap(spark, d):
    return current_chunks(spark, d).select("chunk_id", F.round(T.lexical_overlap(QUERY, F.col("text")), 6).alias("overlap"))


@query(f"SELECT DISTINCT label, array_to_string({TOKENS.format('label')}, ' ') AS label_key FROM corpus_matches")
def label_keys(spark, d):
    return table(spark, d, "corpus_matches").select("label", T.label_key(F.col("label")).alias("label_key")).distinct()


@query(r"SELECT payload_id, try_cast(regexp_extract(value, '(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS number FROM (SELECT DISTINCT payload_id, value FROM entity_payloads) WHERE value IS NOT NULL")
def numeric_coercion(spark, d):
    return table(spark, d, "entity_payloads").where("value is not null").select("payload_id", "value").distinct().select("payload_id", T.numeric_text(F.col("value")).alias("number"))


@query()
def hashing_embed(spark, d):
    e = V.hashing_embedder(64)
    p = current_papers(spark, d).select("paper_id", e(F.coalesce("title", F.lit(""))).alias("v"))
    return p.select("paper_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


@query("SELECT vec_id, round(sqrt(list_sum([x * x for x in embedding::DOUBLE[]])), 4) AS norm, round(list_sum((embedding::DOUBLE[])[1:32]), 4) AS half_sum FROM embeddings")
def vector_norms(spark, d):
    e = table(spark, d, "embeddings")
    half = V.resized(F.col("embedding"), 32)
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(F.aggregate(half, F.lit(0.0), lambda a, x: a + x), 4).alias("half_sum"))
