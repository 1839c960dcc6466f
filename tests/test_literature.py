"""Behaviour of the literature operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import chunking as C
from paperloom.operators import edges as E
from paperloom.operators import entities as N
from paperloom.operators import extraction as X
from paperloom.operators import graph as G
from paperloom.operators import ranking as R
from paperloom.operators import state as S
from paperloom.plans.graph_queries import QUERIES


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


def test_text_expressions(spark):
    c = F.col("t")
    assert one(spark, T.slug(c), t="  Größe & Co. ") == "gr-e-co"
    assert one(spark, T.slug(c), t="!!!") == "unknown"
    assert one(spark, T.tidy(c), t=" a \n b , c") == "a b, c"
    assert one(spark, T.sentences(c), t="One. 2 two! Three") == ["One.", "2 two!", "Three"]
    assert one(spark, T.word_count(c), t="naïve café_1 – αβγ") == 3
    assert one(spark, T.section_type(c), t="2. Materials and Methods") == "methods"
    assert one(spark, T.doi_in(c), t="see 10.1234/AB.c.") == "10.1234/ab.c"
    assert one(spark, T.tail_words(c, 2), t="a, b. c!") == "b c"
    assert one(spark, T.unfenced(c), t='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_chunks_overlap_and_cover(spark):
    text = "alpha beta gamma delta. epsilon zeta eta theta. iota kappa lambda mu."
    df = C.chunk_sections(spark.createDataFrame([("s", "p", text), ("e", "p", ""), ("n", "p", None)], "section_id string, paper_id string, text string"), 6, 2)
    rows = df.orderBy("ordinal").collect()
    assert len(rows) == 3
    assert rows[1].text.startswith("gamma delta")
    assert rows[0].next_chunk_id == rows[1].chunk_id and rows[2].next_chunk_id is None
    words = set(" ".join(r.text for r in rows).replace(".", "").split())
    assert words == set(text.replace(".", "").split())


def test_bm25_prefers_the_matching_document(spark):
    docs = spark.createDataFrame([("a", "membrane signal signal"), ("b", "other words here"), ("c", None)], "id string, text string")
    got = {r.id: r.score for r in R.bm25_scores(docs, "id", "text", "signal of membrane").collect()}
    assert got["a"] > 0 and got["b"] == 0 and got["c"] == 0


def test_rank_fusion_values(spark):
    hits = [("v", "a", 1), ("v", "b", 2), ("v", "c", 3), ("l", "b", 1), ("l", "a", 2), ("l", "c", 3), ("g", "a", 1), ("g", "b", 2), ("g", "c", 3)]
    df = spark.createDataFrame([(0, s, k, r, 1.0) for s, k, r in hits], "q int, source string, key string, rank int, score double")
    got = {r.key: r.rrf for r in R.reciprocal_ranks(df, ["q"]).collect()}
    assert got["a"] == pytest.approx(2 / 61 + 1 / 62) and got["b"] == pytest.approx(1 / 61 + 2 / 62) and got["c"] == pytest.approx(3 / 63)


def test_context_budget_cuts_the_last_block(spark):
    df = spark.createDataFrame([(0, 1, "a b c"), (0, 2, "d e f"), (0, 3, "g")], "q int, n int, t string")
    got = [(r.n, r.kept_text) for r in R.context_budget(df, ["q"], "n", "t", 5).orderBy("n").collect()]
    assert got == [(1, "a b c"), (2, "d e")]


def test_claims_types_and_relation(spark):
    ch = spark.createDataFrame([("c", "p", "This improves the yield much. however small words. We expect more signal here. It will fail later on.")], "chunk_id string, paper_id string, text string")
    got = {r.label: (r.confidence, r.properties["claim_type"]) for r in X.claims(ch).collect()}
    assert got["This improves the yield much."] == (0.82, "finding")
    assert got["We expect more signal here."][1] == "hypothesis" and got["It will fail later on."][1] == "future_work"
    rel = spark.createDataFrame([("it improves", "it improves more", 0.9), ("however not", "it fails", 0.8), ("x", "y", 0.95), ("x", "y", 0.8), ("improve", "improve", 0.5)], "a string, b string, s double").select(E.relation(F.col("a"), F.col("b"), F.col("s")).alias("r")).collect()
    assert [r.r and r.r.relation for r in rel] == ["SUPPORTS", "CONTRADICTS", "SUPPORTS", None, None]


def test_results_and_methods(spark):
    found = X.find_results("The accuracy was 92 % and 3.5 fold higher (p = 0.04) [12]. Fig. 3 shows 1,200 cells.", ["accuracy"])
    assert [(m, v) for m, v, *_ in found] == [("fold change", 3.5), ("accuracy", 92.0), ("p-value", 0.04), ("cells count", 1200.0)]
    ch = spark.createDataFrame([("c", "p", "We used flash imaging and mass spectrometry.", "methods")], "chunk_id string, paper_id string, text string, chunk_type string")
    labels = {r.label for r in X.methods(ch, suffixes=["metry"]).collect()}
    assert any(x.endswith("flash imaging") for x in labels) and any(x.endswith("mass spectrometry") for x in labels)


@pytest.fixture
def articles(spark, tmp_path):
    """A folder with chunks (chunk_id, text, chunk_type) of one paper."""

    def write(chunks, keywords=(), abstract=""):
        spark.createDataFrame([(c, "p", text, kind, 10, 1) for c, text, kind in chunks], "chunk_id string, paper_id string, text string, chunk_type string, word_count int, ingested_at int").write.parquet(f"{tmp_path}/chunks.parquet")
        spark.createDataFrame([("p", "Title", abstract, list(keywords), 1)], "paper_id string, title string, abstract string, keywords array<string>, ingested_at int").write.parquet(f"{tmp_path}/papers.parquet")
        return str(tmp_path)

    return write


def test_salience_counts_all_six_kinds(spark, articles):
    d = articles([("r", "recovery was 92 % and 3 fold.", "discussion"), ("m", "by flash imaging", "x"), ("n", "nothing here", "x")])
    got = {r.chunk_id: r.salience for r in QUERIES["chunk_salience"](spark, d).collect()}
    # 0.10 + 0.22 * 2/3 + 0.10 * 0.83 + 10/180 + 0.10; 0.10 + 0.15 * 1/2 + 0.10 * 0.55 + 10/180
    assert got == {"r": 0.49, "m": 0.29, "n": 0.15}


def test_concepts_of_keywords_capitals_and_titles(spark, articles):
    d = articles([("k", "seen in slow wexerucor flow", "x"), ("c", "the AB CD EF unit", "x")], ["Wexerucor", "absent"])
    got = {(r.chunk_id, r.label): r.confidence for r in QUERIES["concept_extract"](spark, d).collect()}
    assert got[("k", "Wexerucor")] == 0.92 and got[("c", "AB CD EF")] == 0.72 and ("k", "absent") not in got
    ch = spark.createDataFrame([("a", "p", "nothing here", "results", "Flow of  heat"), ("b", "p", "GABA rises", "results", "Other"), ("c", "p", "nothing", "methods", "Setup"), ("d", "p", "nothing", "abstract", "Abstract")], "chunk_id string, paper_id string, text string, chunk_type string, title string")
    assert {(r.chunk_id, r.label, r.confidence) for r in X.concepts(ch, title="title").collect()} == {("a", "Flow of heat", 0.48), ("b", "GABA", 0.86)}


def test_datasets_of_definitions_pairs_and_the_registry(spark, articles):
    d = articles([
        ("d", "we took the treated older mice (TOM) home", "x"), ("v", "effect of H1 vs. H22 here", "x"), ("p", "split between P53 and calm", "x"), ("r", "more weight in lhc, and  less", "x"), ("s", "in the late\nhelper  cohort too", "x"), ("n", "we saw slow things (ST) here", "x"),
    ], abstract="Late helper cohort (LHC) and others.")
    got = {(r.chunk_id, r.label) for r in QUERIES["dataset_extract"](spark, d).collect()}
    assert {x for x in got if x[0] in "vprsn"} == {("v", "H1"), ("v", "H22"), ("p", "P53"), ("r", "Late helper cohort (LHC)"), ("s", "Late helper cohort (LHC)")}
    assert all(x[1].endswith("treated older mice (TOM)") for x in got if x[0] == "d")


def test_schema_inheritance_and_validation(spark):
    schemas = {"a": X.Schema("a", {"claim": ["text"]}, (X.Rule("claim", "min_words", "text", 3),)), "b": X.Schema("b", {"claim": ["name"]}, (), "a"), "x": X.Schema("x", {}, (), "y"), "y": X.Schema("y", {}, (), "x")}
    assert X.resolve(schemas, "b").required == {"claim": ["text", "name"]}
    with pytest.raises(ValueError):
        X.resolve(schemas, "x")
    with pytest.raises(KeyError):
        X.resolve(schemas, "none")
    df = spark.createDataFrame([("claim", "one two three", "n", 0.5), ("claim", "one", "n", 0.5), ("other", "", "", 2.0), (None, None, None, None)], "type string, text string, name string, confidence double")
    assert [r.valid for r in X.validate(df, X.resolve(schemas, "b")).collect()] == [True, False, False, False]


def test_citations(spark):
    papers = spark.createDataFrame([("p1", "First Title", "10.1/a"), ("p2", "Second title", "10.1/B"), ("p3", "Third", None)], "paper_id string, title string, doi string")
    refs = spark.createDataFrame([("r1", "p1", None, "10.1/b", None, None), ("r2", "p1", "third!", None, None, None), ("r3", "p1", None, None, None, "Unknown work. 10.1234/zz."), ("r4", "p1", None, "10.1/A", None, None)], "reference_id string, paper_id string, title string, doi string, label string, source_text string")
    got = {r.target_label: (r.target_node_id, r.confidence, r.is_stub_target) for r in E.citations(refs, papers).collect()}
    assert got["Second title"] == ("p2", 0.88, False) and got["Third"][:2] == ("p3", 0.88)
    assert got["Unknown work"][0].startswith("refpaper-") and got["Unknown work"][1:] == (0.72, True)
    assert len(got) == 3


def test_is_a_uses_labels_and_aliases(spark):
    ents = spark.createDataFrame([("p", "e1", "concept", "Mouse model", []), ("p", "e2", "dataset", "Animal", ["model organism"]), ("q", "e3", "concept", "model organism", [])], "paper_id string, entity_id string, entity_type string, label string, aliases array<string>")
    h = spark.createDataFrame([("mouse model", 0, ["Model organism", ""])], "term string, ontology_rank int, parents array<string>")
    got = [(r.source_node_id, r.target_node_id, r.target_node_type) for r in E.is_a(ents, h).collect()]
    assert got == [("e1", "e2", "Dataset")]


def test_pagerank_sums_to_one_and_matches_a_loop(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e"), ("a", "e")]
    got = {r.node: r.rank for r in G.pagerank(spark.createDataFrame(edges, "src string, dst string"), 6).collect()}
    nodes = sorted({x for e in edges for x in e})
    out = {n: sorted({b for a, b in edges if a == n}) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / 5)
    for _ in range(6):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.03 + 0.85 * (sum(rank[m] / len(out[m]) for m in nodes if n in out[m]) + lost / 5) for n in nodes}
    assert sum(got.values()) == pytest.approx(1) and all(math.isclose(got[n], rank[n], rel_tol=1e-9) for n in nodes)


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("",)], "node string")
    assert {r.node: r.distance for r in G.neighbourhood(e, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert G.neighbourhood(e, seeds, 0).count() == 1


def test_leader_groups_are_the_greedy_ones(spark):
    """Against one pass over the entities in order, with and without vectors, for every way to be alike."""
    import numpy as np

    rng = np.random.default_rng(6)
    words = ["linear", "fit", "Lattice", "gene", "Flow", "of", "x", "Linear fit", "gas"]
    rows = []
    for i in range(90):
        label = " ".join(rng.choice(words, rng.integers(1, 4)))
        v = rng.standard_normal(8) + (3 if i % 5 else 0)
        vec = (v / np.linalg.norm(v)).tolist() if i % 3 else None
        rows.append((f"e{i:02d}", "concept" if i % 2 else "method", label, vec, f"{(i * 7) % 90:03d}"))
    rows += [("z1", "claim", "Bidirectional Encoder", None, "1"), ("z2", "claim", "BERT Base Encoder", None, "2"), ("z3", "claim", "", None, "3")]

    def alike(lead, own):
        if lead[3] is not None and own[3] is not None:
            return float(np.dot(lead[3], own[3])) >= 0.85
        x, y = lead[2].lower(), own[2].lower()
        k, o = ("".join(w[0].upper() for w in t.split()) for t in (lead[2], own[2]))
        return x == y or (x and y and (x in y or y in x)) or bool(k and o and k in o)

    want, leads = {}, []
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        hit = next((x for x in leads if x[1] == r[1] and alike(x, r)), None)
        if hit is None:
            leads.append(r)
        want[r[0]] = (hit or r)[0]
    got = N.leader_groups(spark.createDataFrame(rows, "entity_id string, entity_type string, label string, vec array<double>, seq string"))
    assert {r.entity_id: r.leader_id for r in got.collect()} == want
    assert N.leader_groups(spark.createDataFrame([], "entity_id string, entity_type string, label string, vec array<double>, seq string")).count() == 0


def test_state_tables(spark):
    log = spark.createDataFrame([("s", 1.0, False), ("s", 2.0, True), ("s", 3.0, False), ("s", 4.0, False), ("t", 1.0, True)], "service string, at double, ok boolean")
    got = {r.service: (r.failures, r.open) for r in S.breaker_states(log, 2, 10.0, 5.0).collect()}
    assert got == {"s": (2, True), "t": (0, False)}
    assert not S.breaker_states(log, 2, 10.0, 14.0).where("open").count()
    req = spark.createDataFrame([("a",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", "x", 1.0)], "k string, payload string, created_at double")
    assert {r.k: r.payload for r in S.cached(req, cache, ["k"], 5.0, 10.0).collect()} == {"a": "x", "b": None}
    assert {r.k: r.payload for r in S.cached(req, cache, ["k"], 5.0, 4.0).collect()} == {"a": None, "b": None}


def test_similar_pairs_lose_none(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:130] = x[:30] + 0.25 * rng.standard_normal((30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    s = x @ x.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.8}
    got = {(r.a, r.b) for r in E.similar_pairs(df, 0.8).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 20


def moved(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name, most", [("claim_relation_edges", 10_000), ("related_claims", 10_000), ("canonical_groups", 60_000)])
def test_queries_of_similar_pairs_move_little(spark, name, most):
    """1,248 rows of chunks and 1,844 entities: a band of signs moved each of them again."""
    import __spark_entry__ as entry

    before = moved(spark)
    assert entry.queries()[name](spark, "/root/testdata/sf0.01").count()
    assert moved(spark) - before < most


def test_similar_pairs_move_little(spark, monkeypatch):
    """A vector is moved a few times, not once a band; and in cells or in hash tables no pair is lost."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, 64))
    x[1_500:2_000] = x[:500] + 0.6 * rng.standard_normal((500, 64))
    x[-150:] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.8, 1)))}
    before = moved(spark)
    got = [(r.a, r.b) for r in E.similar_pairs(df, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Two cells, the vectors for the two ends, and the pairs found.
    assert moved(spark) - before < 12 * len(x) + 6 * len(want)
    for meet, cell in ((3_000, 700), (100, 20_000), (100, 90)):
        monkeypatch.setattr(E, "ALL_MEET", meet)
        monkeypatch.setattr(E, "CELL", cell)
        assert {(r.a, r.b) for r in E.similar_pairs(df, 0.8).collect()} == want


def test_vectors(spark):
    a = F.col("a")
    assert one(spark, V.dot(a, F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, V.unit(a), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, V.unit(a), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.bucket_means(a, 2), a=[1.0, 3.0, 5.0, 7.0]) == [2.0, 6.0]
    assert sum(v * v for v in V.hash_vector("some words here", 32)) == pytest.approx(1) and not any(V.hash_vector("", 8))


def test_query_links(spark):
    q = spark.createDataFrame([("1", "Flow Meter", ["FM"]), ("2", "other meter", None), ("3", "none", [])], "entity_id string, label string, aliases array<string>")
    assert [(r.entity_id, r.score) for r in N.link_query(q, "what does a flow meter do").collect()] == [("1", 6.0), ("2", 1.0)]
