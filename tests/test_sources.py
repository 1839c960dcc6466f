import os

import pytest

from paperloom.operators import state as S
from paperloom.sources import articles as A
from paperloom.sources import lexicons, providers
from paperloom.streaming import ingest

PUBLISHER = b"""<article><item-info><jid>ABC</jid><ce:doi>10.1234/x.1</ce:doi><ce:copyright year="2021">C</ce:copyright></item-info>
<head><ce:title>On  flows</ce:title><ce:author-group><ce:author><ce:given-name>Ann</ce:given-name><ce:surname>Lee</ce:surname><ce:cross-ref refid="a1"/></ce:author>
<ce:affiliation id="a1"><ce:textfn>Dept of Flow</ce:textfn></ce:affiliation></ce:author-group>
<ce:abstract class="author"><ce:simple-para>Abstract: We look , closely.</ce:simple-para></ce:abstract><ce:keywords><ce:keyword>m <ce:sup>6</ce:sup> A</ce:keyword></ce:keywords></head>
<body><ce:sections><ce:section id="s1"><ce:section-title>Methods</ce:section-title><ce:para>First <mml:math>x=1</mml:math> step.</ce:para>
<ce:section id="s2"><ce:section-title>Inner</ce:section-title><ce:para>Deep.</ce:para></ce:section></ce:section></ce:sections>
<ce:table id="t1"><ce:label>Table 1</ce:label><row><entry>a</entry><entry>b</entry></row></ce:table></body>
<tail><ce:bib-reference id="b1"><ce:label>[1]</ce:label><ce:source-text>Old work. 10.1/y</ce:source-text></ce:bib-reference></tail></article>"""
JATS = b"""<article><front><article-meta><article-id pub-id-type="doi">10.9/J</article-id><title-group><article-title>Jats one</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Roe</surname><given-names>Bo</given-names></name></contrib></contrib-group><pub-date><year>2019</year></pub-date></article-meta></front>
<body><sec id="i"><title>Results</title><p>One.</p></sec></body></article>"""


def test_publisher_article():
    a = A.parse_article(PUBLISHER)
    assert (a["paper_id"], a["title"], a["year"], a["abstract"]) == ("10-1234-x-1", "On flows", 2021, "We look, closely.")
    assert a["keywords"] == ["m6A"] and a["authors"][0]["affiliations"] == ["Dept of Flow"]
    assert [(s["section_type"], s["level"], s["ordinal"]) for s in a["sections"]] == [("methods", 1, 0), ("body", 2, 1)]
    assert a["sections"][1]["parent_section_id"] == a["sections"][0]["section_id"] and "[Equation x=1]" in a["sections"][0]["text"]
    assert (a["tables"][0]["rows"], a["tables"][0]["columns"]) == (1, 2) and a["refs"][0]["label"] == "[1]"


def test_jats_and_unknown():
    j = A.parse_article(JATS)
    assert (j["paper_id"], j["format"], j["year"], j["authors"][0]["full_name"]) == ("10-9-j", "jats", 2019, "Bo Roe")
    with pytest.raises(ValueError):
        A.parse_article(b"<other/>")


def test_visible_text():
    assert A.visible_text("<p>a &amp; <b>b</b></p><script>x</script>") == "a & b" and A.visible_text(None) == ""


def test_read_ingest_and_skip(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    for n, data in (("a.xml", PUBLISHER), ("b.xml", JATS), ("bad.xml", b"<article><body>")):
        with open(f"{src}/{n}", "wb") as f:
            f.write(data)
    rows = A.read_articles(spark, src).collect()
    assert sorted(r.format or "bad" for r in rows) == ["bad", "jats", "publisher"]
    ingest.ingest(spark, src, out)
    st = {r.path.rsplit("/", 1)[1]: r.status for r in ingest.status(spark, out).collect()}
    assert st == {"a.xml": "complete", "b.xml": "complete", "bad.xml": "failed"}
    n = spark.read.parquet(f"{out}/chunks").count()
    with open(f"{src}/c.xml", "wb") as f:
        f.write(JATS)  # the same content under another name
    ingest.ingest(spark, src, out)
    assert spark.read.parquet(f"{out}/chunks").count() == n
    A.write_json(A.child_table(A.read_articles(spark, src), "sections"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_providers():
    now = [0.0]
    b = providers.Breaker(2, 10.0, lambda: now[0])

    def fail(_):
        raise RuntimeError

    assert providers.call(fail, "x", b) is None and not b.allows()
    now[0] = 11.0
    assert b.allows() and providers.call(lambda p: p + "!", "x", b) == "x!"
    assert providers.read_json('```json\n[1]\n```') == [1] and providers.read_json("no") is None
    replies = iter([[{"name": "method"}], [{"name": "flash imaging"}]])
    rows, quality = providers.extract_with_correction(lambda t, e: next(replies), lambda rs: ([r for r in rs if " " in r["name"]], [r["name"] for r in rs if " " not in r["name"]]), "t")
    assert rows == [{"name": "flash imaging"}] and quality == 1.0
    asked = []
    got = providers.answer("q", lambda q: asked.append(q) or [{"paper_title": "T"}], lambda q, p: ("a", 0.9), lambda t, p: (len(asked) > 1, 0.8))
    assert got.text == "a" and got.confidence == 0.8 and asked == ["q", "q T"]
    assert providers.answer("q", lambda q: []).degraded


def test_lexicons(tmp_path, monkeypatch):
    assert lexicons.merged({"a": [1], "b": {"x": 1}}, {"a": [1, 2], "b": {"y": 2}}) == {"a": [1, 2], "b": {"x": 1, "y": 2}}
    p = tmp_path / "l.json"
    p.write_text('{"terms": ["x"]}')
    assert lexicons.load(str(p)) == {"terms": ["x"]}


def test_a_registered_parser_reaches_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PARSERS", list(A.PARSERS))
    A.register(lambda r: r.tag == "note", lambda r: {"format": "note", "paper_id": "n1", "title": r.text()})
    (tmp_path / "n.xml").write_bytes(b"<note>Short  one</note>")
    row = A.read_articles(spark, str(tmp_path)).first()
    assert (row.format, row.paper_id, row.title, row.error) == ("note", "n1", "Short one", None)


def test_a_broken_log_is_an_error(spark, tmp_path):
    assert ingest.read_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "out/log/batch=0").mkdir(parents=True)
    (tmp_path / "out/log/batch=0/x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        ingest.read_log(spark, str(tmp_path / "out")).count()


def test_the_last_cache_entry_holds(spark):
    cache = spark.createDataFrame([("a", "old", 1.0), ("a", "new", 5.0), ("b", "x", 2.0), ("b", "y", 2.0), ("c", "stale", 0.0)], "k string, payload string, created_at double").repartition(5)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    got = {r.k: r.payload for r in S.cached(asked, cache, ["k"], 8.0, 7.0).collect()}
    assert got == {"a": "new", "b": "y", "c": None, "d": None}
    assert {r.k: r.payload for r in S.cached(asked, cache, ["k"], 8.0, -1).collect()}["c"] == "stale"


def test_rate_limit_prompt_groups_claims_and_embedders():
    now, slept = [0.0], []
    r = providers.RateLimit(0.4, lambda: now[0], slept.append)
    assert (r.wait("a"), r.wait("b"), round(r.wait("a"), 6)) == (0.0, 0.0, 0.4) and slept == [0.4]
    prompt = providers.extraction_prompt("T", {"result": ["metric"]}, {"claim": ["five words"]}, ["no metric"])
    assert "- result: metric" in prompt and "- claim: five words" in prompt and "no metric" in prompt and prompt.endswith("T")
    labels = [f"l{i}" for i in range(12)]
    assert providers.group_labels(labels, lambda p: '{"l1": ["l1", "l2", "other"], "l3": "x"}') == {"l2": "l1"}
    assert providers.group_labels(labels[:5], lambda p: "{}") == {} == providers.group_labels(labels, None)
    assert providers.claims_in("text", lambda p: '["A holds.", 3, " "]') == ["A holds."] and providers.claims_in("text", None) == [] == providers.claims_in(" ", lambda p: '["x"]')

    def broken(text):
        raise RuntimeError

    e = providers.Embedder([("far", broken), ("near", lambda t: [1.0])])
    assert e.embed("x", 3) == [1.0] and e.failed == {"far"} and e.embed(" ", 3) == [0.0, 0.0, 0.0] and e.probe() == {"far": False, "near": True}
    assert providers.Embedder([("far", broken)]).embed("x", 2) == [0.0, 0.0]


def test_command_line(spark, tmp_path, capsys):
    from paperloom.__main__ import main

    assert main(["queries"], spark) == 0 and "hybrid_retrieval" in capsys.readouterr().out
    assert main(["run", "nothing", "x"], spark) == 2
    assert main(["run", "entity_histogram", "/root/testdata/sf0.001", "--limit", "2"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["run", "entity_histogram", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")], spark) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_bytes(PUBLISHER)
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "db")], spark) == 0 and main(["status", str(tmp_path / "db")], spark) == 0
    assert '"status":"complete"' in capsys.readouterr().out
