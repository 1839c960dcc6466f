"""Replies to entities, counters, aliases, the graph sink and requests."""

import pytest

from paperloom.operators import extraction as X
from paperloom.operators import graph as G
from paperloom.operators import payloads as P
from paperloom.operators import search as S

REPLY = "payload_id bigint, chunk_id string, type string, name string, text string, value string, unit string, metric string, dataset string, condition string, confidence double, extra string"


def test_replies_to_entities(spark):
    rows = [
        (1, "c1", " Concept ", "Flow  Meter", None, None, None, None, None, None, 0.9, "x"), (1, "c1", " Concept ", "Flow  Meter", None, None, None, None, None, None, 0.9, "y"), (2, "c1", "result", None, None, "53-71", "%", "accuracy", None, None, None, None),
        (3, "c1", "claim", None, "This will help a lot.", None, None, None, None, None, 7.0, None), (4, "c1", "method", " ", "t", None, None, None, None, None, 0.2, None), (5, "c1", "rumour", "x", None, None, None, None, None, None, 0.2, None),
        (6, "c1", "equation", None, "a = b", None, None, None, None, None, float("nan"), None), (7, None, None, None, None, None, None, None, None, None, None, None), (8, "c1", "dataset", "Arm 2", None, None, None, None, None, None, 0.0, None),
    ]
    got = {r.payload_id: r for r in P.payload_entities(spark.createDataFrame(rows, REPLY), "m").collect()}
    assert {k: (r.entity_type, r.label, r.confidence) for k, r in got.items()} == {1: ("concept", "Flow Meter", 0.9), 2: ("result", "53-71 accuracy", 0.5), 3: ("claim", "This will help a lot.", 1.0), 6: ("equation", "a = b", 0.5), 8: ("dataset", "Arm 2", 0.5)}
    assert got[3].properties["claim_type"] == "future_work" and got[8].properties["dataset_type"] == "experimental_group" and got[2].entity_id.startswith("result-")
    assert P.payload_entities(spark.createDataFrame([], REPLY)).count() == 0


def test_replies_stand_for_local_entities_of_their_chunk(spark):
    e = "chunk_id string, label string"
    local, replies = spark.createDataFrame([("1", "a"), ("2", "b")], e), spark.createDataFrame([("2", "c")], e)
    assert {(r.chunk_id, r.label) for r in P.prefer_replies(local, replies).collect()} == {("1", "a"), ("2", "c")}


def test_aliases_in_texts(spark):
    terms = spark.createDataFrame([("p", "mean flow rate"), ("p", "MFR"), ("p", "rate"), ("q", "mean flow rate")], "paper_id string, term string")
    texts = spark.createDataFrame([("p", "We took the mean flow rate (MFR) of each. The Mean Flow Rate (MFR) rose."), ("p", None)], "paper_id string, text string")
    got = {(r.paper_id, r.term, r.alias) for r in P.text_aliases(terms, texts).collect()}
    assert got == {("p", "mean flow rate", "MFR"), ("p", "rate", "MFR"), ("p", "MFR", "The Mean Flow Rate")}


def test_counters(spark):
    cache = spark.createDataFrame([("a", 2), ("b", None)], "k string, hits bigint")
    assert {r.k: r.hits for r in P.counted_hits(cache, spark.createDataFrame([("a",), ("a",), ("z",)], "k string"), ["k"]).collect()} == {"a": 4, "b": 0}
    held = spark.createDataFrame([("a", 2, 1.0)], "k string, miss_count bigint, last_seen double")
    new = spark.createDataFrame([("a", 3.0), ("n", 2.0), ("n", 4.0)], "k string, last_seen double")
    assert {r.k: (r.miss_count, r.last_seen) for r in P.counted_misses(held, new, ["k"]).collect()} == {"a": (3, 3.0), "n": (2, 4.0)}


def test_stubs_and_constraints(spark):
    edges = spark.createDataFrame([("x", "Paper", "X"), ("x", "Paper", "W"), ("known", "Paper", "K"), (None, None, None)], "target_node_id string, target_node_type string, target_label string")
    assert [tuple(r) for r in G.stubs(edges, spark.createDataFrame([("known",)], "node_id string")).collect()] == [("x", "Paper", "W")]
    nodes = spark.createDataFrame([("1", "Paper"), ("1", "Paper"), ("1", "Chunk")], "node_id string, node_type string")
    assert {r.node_type: (r.nodes, r.violations) for r in G.constraint_violations(nodes).collect()} == {"Paper": (2, 1), "Chunk": (1, 0)}


def test_requests_are_checked():
    assert S.Request("x", 50, 5).k == 50
    for bad in ({"query": " "}, {"query": "x", "k": 0}, {"query": "x", "k": 51}, {"query": "x", "hops": 6}, {"query": "x", "limit": 501}):
        with pytest.raises(ValueError):
            S.Request(**bad)


def test_an_empty_bundle(spark):
    stats = spark.createDataFrame([(0,)], "paper_count int")
    b = S.bundle("q", {"stats": stats, "papers": spark.createDataFrame([("p",)], "paper_id string")})
    assert b["query"] == "q" and b["papers"] == [] and b["stats"]["paper_count"] == 0
    full = S.bundle("q", {"stats": spark.createDataFrame([(1,)], "paper_count int"), "entities": spark.createDataFrame([("concept", "a"), ("concept", "b")], "entity_type string, label string")})
    assert [e["label"] for e in full["entities"]["concept"]] == ["a", "b"]


def test_salience_never_falls(spark):
    old = spark.createDataFrame([("a", 0.9), ("b", None), ("c", 0.1)], "chunk_id string, salience_score double")
    new = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.3)], "chunk_id string, salience double")
    assert {r.chunk_id: r.salience for r in X.updated_salience(old, new).collect()} == {"a": 0.9, "b": 0.4, "c": 0.3}


def test_an_index_is_read_by_its_terms(spark, tmp_path):
    from paperloom.operators import ranking as R

    docs = spark.createDataFrame([("a", "lattice lattice flow"), ("b", "flow of the gas"), ("c", None), ("d", "")], "id string, text string")
    R.write_index(docs, "id", "text", str(tmp_path / "i"))
    for q in ("lattice flow", "flow", "nothing here", "of the"):
        postings, stats = R.read_index(spark, str(tmp_path / "i"), q)
        got = {r.key: round(r.score, 9) for r in R.bm25_from_postings(postings, stats, q).collect()}
        want = {r.id: round(r.score, 9) for r in R.bm25_scores(docs, "id", "text", q).collect() if r.score}
        assert got == want, q
    plan = R.read_index(spark, str(tmp_path / "i"), "flow")[0]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(term_group" in plan or "PartitionFilters: [term_group" in plan
