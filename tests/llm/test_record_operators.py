"""Mapping, vectors, fusion and names."""

import math
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import forest, fuse, grams, mapping, names
from paperloom.llm.labels import Reader, slips

CANON = "external_id string, found boolean, label string, aliases array<string>, parent_terms array<string>, value string"
ENTRIES = [
    ("1", True, "zanadebar lattice", ["ZANL"], ["lattice"], "x"), ("2", True, "zanadebar lattice type 2", ["ZANL2"], ["lattice"], "x"), ("3", True, "alpha zanadebar lattice", None, ["lattice"], None),
    ("4", True, "Quiralom Registry", ["QUIR", "SAME"], ["registry"], None), ("5", True, "quiralom chromatography", ["SAME", "Tovumox 136f"], ["chromatography"], None), ("6", True, "velurin tumour 3", [], ["tumour"], None),
]


@pytest.fixture(scope="module")
def mapped(spark):
    labels = {
        "zanadebar lattice": "1", "ZANADEBAR-LATTICES": "1", "lattice of zanadebar": "1", "Lattice, Zanadebar": "1", "zanadbear lattice": "1", "zanadebarlattice": "1", "zanadébar lattice": "1", "zanadebar lat.": "1", "zanadebar lattice (ZANL)": "1",
        "zanadebar lattice type II": "2", "zanadebar_lattice type 2": "2", "α-zanadebar lattice": "3", "zanadebar lattice type 9": None, "omega zanadebar lattice": None, "zanadebar phosphatase": None, "zanadebar": None,
        "quiralom registries": "4", "quiralom chromatogr.": "5", "QUIR": "4", "SAME": None, "tovumox 136F": "5", "velurin tumor 3": "6", "velurin tumour 4": None, "n/a": None, "??": None, "": None, "   ": None, None: None, "x" * 3000: None,
    }
    df = spark.createDataFrame([(k, "clash") for k in labels] * 2, "value string, external_id string")
    got = {r.value: r.external_id for r in mapping.map_values(df, spark.createDataFrame(ENTRIES, CANON)).collect()}
    return labels, got


def test_mapping(mapped):
    labels, got = mapped
    assert {k: got.get(k) for k in labels} == labels


def test_mapping_empty(spark):
    c = spark.createDataFrame(ENTRIES, CANON)
    v = spark.createDataFrame([("zanadebar lattice",)], "value string")
    assert mapping.map_values(v.limit(0), c).count() == 0
    assert [r.external_id for r in mapping.map_values(v, c.limit(0)).collect()] == [None]


def test_mapping_report_weights(spark):
    m = spark.createDataFrame([(1, "zanadebar lattice", 3), (1, "zanadebar lattice", 3), (2, "zanadebar lattice", None), (3, None, 5)], "miss_id bigint, label string, miss_count bigint")
    c = spark.createDataFrame(ENTRIES, CANON)
    got = {r.label: (r.misses, r.records, r.external_id) for r in mapping.mapping_report(m, c).collect()}
    assert got == {"zanadebar lattice": (3, 2, "1"), None: (5, 1, None)}
    assert {(r.miss_id, r.external_id) for r in mapping.map_misses(m, c).collect()} == {(1, "1"), (2, "1")}


def test_slips_against_plain_definition():
    def osa(a, b):
        d = {}
        for i in range(-1, len(a) + 1):
            for j in range(-1, len(b) + 1):
                d[i, j] = max(i, j) + 1 if min(i, j) < 0 else None
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1] if a and b else max(len(a), len(b))

    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(2))
        assert slips(a, b, 9) == osa(a, b)
        assert slips(a, b, 2) == min(osa(a, b), 3)
    assert Reader(["lattice"]).read(None) == []


def test_inverse_normal(spark):
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(fuse.inverse_normal(F.col("p")).alias("z"))
    assert [r.z for r in df.collect()] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def brute(rows):
    """(group, item) to value, straight from the definition."""
    best = {}
    for g, i, r, s in rows:
        if s is not None and not math.isnan(s):
            best[g, r, i] = max(s, best.get((g, r, i), -math.inf))
    out = {}
    for g in {x[0] for x in rows}:
        items = {x[1] for x in rows if x[0] == g}
        ranks = sorted({r for gg, r, _ in best if gg == g})
        for i in items:
            zs = []
            for r in ranks:
                v = {j: best.get((g, r, j), -math.inf) for j in items}
                below, equal = sum(x < v[i] for x in v.values()), sum(x == v[i] for x in v.values())
                zs.append(NormalDist().inv_cdf((below + (equal + 1) / 2 - 0.5) / len(items)))
            if any((g, r, i) in best for r in ranks):
                out[g, i] = sum(zs) / len(zs)
    return out


def test_fusion_is_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        for r, scale in (("a", 1.0), ("b", 300.0), ("c", 1e-4)):
            for i in range(40):
                s = float(np.round(rng.standard_normal() * scale, 5 if scale < 1 else 1))
                rows.append((g, f"i{i}", r, [s, s, None, float("nan")][rng.integers(0, 4)] if i % 3 else s))
    rows += rows[:20]
    got = {(r.group_id, r.item): r.value for r in fuse.fuse_scores(spark.createDataFrame(rows, "group_id int, item string, ranking string, score double")).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


PASSAGES = "passage_id bigint, query_id bigint, chunk_id string, retrieval_method string, score double, source_scores map<string,double>, item string, value double"


def test_passage_layouts_nulls_and_ties(spark):
    rows = [
        (1, 1, " C1 ", "Vector", 0.9, None, "x", 1.0), (2, 1, "c1", "bm25", 9.0, {}, "x", 1.0), (3, 1, "c2", "vector", 0.1, None, "x", 1.0), (4, 1, "", "vector", 0.2, None, None, None), (5, 1, None, "vector", None, None, None, None),
        (6, 2, "a", "fusion", 1.0, {"VECTOR": 0.5, "bm25": float("nan")}, None, None), (7, 2, "b", "FUSION", 99.0, {"vector": 0.4, "bm25": None}, None, None), (7, 2, "b", "FUSION", 99.0, {"vector": 0.4, "bm25": None}, None, None),
        (8, 3, "z", "vector", 0.5, None, None, None), (9, 3, "y", "vector", 0.5, None, None, None), (10, 4, "q", "fusion", 1.0, None, None, None),
    ]
    got = {r.query_id: r.chunk_id for r in fuse.first_passages(spark.createDataFrame(rows, PASSAGES)).collect()}
    assert got == {1: " C1 ", 2: "a", 3: "y"}
    assert fuse.first_passages(spark.createDataFrame([], PASSAGES)).count() == 0


def vectors(spark, x, extra=()):
    rows = [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)] + list(extra)
    return {"t": spark.createDataFrame([(k, v, 1) for k, v in rows], "key string, vec array<float>, id int")}


def test_forest_finds_the_mutual_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[2000:2600] = x[:600] + 0.35 * rng.standard_normal((600, 64)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"k{i:04d}", f"k{j:04d}") for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)))}
    bad = [("null", None), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), ("k0000", (x[0] * 3).tolist()), (None, x[0].tolist())]
    got = {(r.key_a, r.key_b) for r in forest.mutual_neighbours(vectors(spark, x, bad)).collect()}
    assert got <= want | got and len(got & want) >= 0.97 * len(want) > 300
    assert len(got - want) <= 2  # rounding at the limit


def test_forest_in_a_dense_group(spark):
    """Many near, not equal, vectors: the ten nearest need not be next to each other in any tree."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((5500, 64)).astype(np.float32)
    x[:4000] = x[0] + 0.12 * rng.standard_normal((4000, 64)).astype(np.float32)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = np.zeros(s.shape, bool)
    np.put_along_axis(near, np.argsort(-s, axis=1)[:, :10], True, axis=1)
    want = {(f"k{i:04d}", f"k{j:04d}") for i, j in zip(*np.nonzero(np.triu(near & near.T & (s >= 0.9))))}
    got = {(r.key_a, r.key_b) for r in forest.mutual_neighbours(vectors(spark, x)).collect()}
    assert len(got & want) >= 0.999 * len(want) > 3000 and len(got - want) <= 0.001 * len(want)


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest, "QUERY_BLOCK", 20)
    monkeypatch.setattr(forest, "SIDE_BLOCK", 300)
    x = np.random.default_rng(2).standard_normal((900, 64)).astype(np.float32)
    v = forest.unit_vectors(vectors(spark, x), 64)
    got = {}
    for r in forest.exact_nearest(v, 64, 5, 10).collect():
        got.setdefault(r.of, []).append((r.rank, r.other))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert len(got) > 40
    for key, found in got.items():
        assert [o for _, o in sorted(found)] == [f"k{j:04d}" for j in np.argsort(-s[int(key[1:])])[:5]]


def test_nearest_by_the_forest(spark, monkeypatch):
    """Unrelated vectors, a near group and a crowded leaf with several cells: nine of ten at least, most of the vectors not met."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((9000, 64)).astype(np.float32)
    x[:1500] = x[0] + 0.05 * rng.standard_normal((1500, 64)).astype(np.float32)
    monkeypatch.setattr(forest, "SIDE_BLOCK", 500)
    v = forest.cut(forest.unit_vectors(vectors(spark, x), 64))
    (r,) = forest.recall(v, 64, 10, 25).collect()
    assert r.recall >= 0.9 and r.looked < 0.75 and r.queries > 250
    got = {}
    for r in forest.nearest(v, 64, 10, 25).collect():
        got.setdefault(r.of, []).append((r.rank, r.other, r.cosine))
    assert all([a for a, _, _ in sorted(g)] == list(range(1, 11)) and of not in {o for _, o, _ in g} for of, g in got.items())
    assert forest.nearest(v.limit(0), 64).count() == 0
    few = forest.nearest(v.where("id % 25 = 0").limit(4), 64, 10, 25).groupBy("of").count().collect()
    assert [r["count"] for r in few] == [3] * 4


def test_nearest_of_many_copies(spark):
    x = np.random.default_rng(1).standard_normal((80, 64)).astype(np.float32)
    x[:60] = x[0]
    got = {}
    for r in forest.nearest(forest.unit_vectors(vectors(spark, x), 64), 64, 5, 1).collect():
        got.setdefault(r.of, set()).add(r.other)
    assert len(got) == 80 and all(got[f"k{i:04d}"] == set([f"k{j:04d}" for j in range(60) if j != i][:5]) for i in range(60))


def test_likely_leaves_are_probabilities():
    rng = np.random.default_rng(4)
    tree = forest.Tree(*forest.split_prefixes(np.sort(rng.integers(0, 1 << 32, 4000, dtype=np.uint32)), 100), np.empty(0))
    q = rng.standard_normal((20, forest.BITS))
    for c in (0.0, 0.5, 0.95):
        p = forest.likely_leaves(q, tree, np.full(20, c))
        assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    # A simulated neighbour falls into the leaves as often as foretold.
    at = 0.8 * q[0] + np.sqrt(1 - 0.64) * rng.standard_normal((20_000, forest.BITS))
    strings = ((at > 0).astype(np.uint64) << np.arange(31, -1, -1).astype(np.uint64)).sum(axis=1).astype(np.uint32)
    seen = np.bincount(tree.leaf(strings), minlength=len(tree.starts)) / 20_000
    assert np.abs(seen - forest.likely_leaves(q[:1], tree, np.array([0.8]))[0]).max() < 0.015


def test_copies_beyond_k(spark):
    x = np.random.default_rng(1).standard_normal((50, 64)).astype(np.float32)
    x[:30] = x[0]
    got = forest.mutual_neighbours(vectors(spark, x)).collect()
    # Ties go to the smaller key: the eleven smallest copies are each other's ten nearest.
    keys = {f"k{i:04d}" for i in range(11)}
    assert {r.key_a for r in got} | {r.key_b for r in got} == keys and len(got) == 55


def test_forest_of_nothing(spark):
    assert forest.mutual_neighbours(vectors(spark, np.zeros((3, 64), np.float32))).count() == 0
    assert forest.mutual_neighbours(vectors(spark, np.zeros((0, 64), np.float32))).count() == 0


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("Dr. Helena F. Fasapovun",), ("person", "fasapovun", "helena", "f")), (("FASAPOVUN, Helena",), ("person", "fasapovun", "helena", "")), (("Fasapovun Helena",), ("person", "fasapovun", "helena", "")),
        (("H.F. Fasapovun Jr.",), ("person", "fasapovun", "h", "f")), (("Helena de Fasapovun",), ("person", "fasapovun", "helena", "")), (("Fasapovun, Al",), ("person", "fasapovun", "al", "")), (("FASAPOVUN AL",), ("person", "fasapovun", "a", "l")), (("Falmaz, PhD, François",), ("person", "falmaz", "francois", "")), ((None, "Zoë", "Lüst"), ("person", "lust", "zoe", "")),
        (("on behalf of the Lolkin Cohort Study Group (LCSG)",), ("group", "lolkin", "group", "")), (("Lolkin Cohort St. Group",), ("group", "lolkin", "group", "")), ((None, None, None), None), (("  ",), None), (("??",), None),
    ],
)
def test_read_name(args, want):
    assert names.read_name(*args) == want


AUTHORS = "author_no bigint, full_name string, given_name string, surname string, email string, affiliations array<string>, orcid string, kind string, entity string"


def author(no, full, orcid=None, uni=None, email=None):
    return (no, full, None, None, email, [f"University of {uni}"] if uni else [], orcid, "clash", None)


def test_names_are_linked(spark):
    a, b = "0000-0001-1111-1111", "0000-0002-2222-2222"
    rows = [
        author(1, "Katharina Falkunovin", a, "Ravgrad"), author(2, "Kathi Falkunovin", None, "Ravgrad"), author(3, "K. Falkunovin", None, None, "k.falkunovin@ravgrad.example"), author(4, "Falkunovni, Katharina", a), author(4, "Falkunovni, Katharina", a),
        author(5, "Katharina Falkunovin", b, "Bernlin"), author(6, "Robert Falkunovin", None, "Ravgrad"), author(7, "The Lolkin Imaging Consortium"), author(8, "Lolkin Imaging Consort."), author(9, None), author(10, "Robert Uniquesson"), author(11, "R. Uniquesson"),
    ]
    df = spark.createDataFrame(rows, AUTHORS)
    got = {(r.author_no_a, r.author_no_b) for r in names.linked_pairs(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (10, 11)}
    assert names.linked_pairs(df.limit(0)).count() == 0


def test_a_large_block_loses_no_pair(spark, monkeypatch):
    crowd = [author(n, f"Kenneth {'Falkunovin' if n % 3 else 'Falkunovni'}", f"0000-0003-{n:04}-1111", f"Town{'abcdefghij'[n // 10]}{'abcdefghij'[n % 10]}") for n in range(10, 90)]
    rows = [author(1, "Katharina Falkunovin"), author(2, "Katharina Falkunovin", None, None, "k@x.example"), author(3, "Katharina J. Falkunovni"), *crowd]
    pairs = lambda r: {(x.author_no_a, x.author_no_b) for x in names.linked_pairs(spark.createDataFrame(r, AUTHORS)).collect()}
    assert pairs(rows[:3]) == pairs(rows) == {(1, 2), (1, 3), (2, 3)}
    monkeypatch.setattr(names, "CELL", 7)
    assert pairs(rows) == {(1, 2), (1, 3), (2, 3)}
    profiles = spark.createDataFrame(rows, AUTHORS).mapInArrow(names._read, "author_no bigint, " + names._PROFILE).withColumnRenamed("author_no", "pid")
    all_ = [tuple(r) for r in profiles.collect()]
    weights = grams.gram_weights(spark.createDataFrame(sorted({(r[2],) for r in all_}), "word string"))
    of = {r[2]: grams.vector(r[2], weights) for r in all_}
    near = lambda a, b: 1.0 if a[2] == b[2] else min(0.9999, grams.cosine(of[a[2]], of[b[2]]))
    want = {(a[0], b[0]): round(s, 6) for a in all_ for b in all_ if a[0] < b[0] and near(a, b) >= names.FLOOR and (s := names.score(near(a, b), a[1:], b[1:])) >= names.NOUGHT}
    assert {(r.a, r.b): round(r.sim, 6) for r in names.scored_pairs(profiles).collect()} == want


def test_cosine_join_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdeo"), rng.integers(4, 9))) for _ in range(120)})
    df = spark.createDataFrame([(k, w) for w in words for k in ("p", "q") if k == "p" or len(w) < 6], "key string, word string")
    weights = grams.gram_weights(spark.createDataFrame([(w,) for w in words], "word string"))
    of = {w: grams.vector(w, weights) for w in words}
    for floor in (0.35, 0.6):
        got = {(r.key, r.a, r.b): round(r.cosine, 5) for r in grams.cosine_join(df, weights, floor).collect()}
        want = {(k, a, b): round(grams.cosine(of[a], of[b]), 5) for k in ("p", "q") for a in words for b in words if a < b and (k == "p" or max(len(a), len(b)) < 6) and grams.cosine(of[a], of[b]) >= floor}
        assert got == want


def test_cosine_join_shuffles_no_candidates(spark):
    df = spark.createDataFrame([("p", "falkunovin"), ("p", "falkunovni"), ("p", "brandstetter")], "key string, word string")
    plan = grams.cosine_join(df, np.ones(grams.BUCKETS, np.float32), 0.35)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_given_names_are_compared_once(monkeypatch):
    """What a token says as a given name is worked out once, not again for each row and pair."""
    calls, slips = [], names.slips
    monkeypatch.setattr(names, "slips", lambda *a: calls.append(a) or slips(*a))
    first = names.given_slips("Katharinq".lower()), names.formal("katharinq")
    n = len(calls)
    assert n and (names.given_slips("katharinq"), names.formal("katharinq")) == first and len(calls) == n


def test_pairing_leaves_no_files(spark, monkeypatch):
    """All pairs come out of several slices of the keys, and no shuffle file and one table stay behind."""
    rows = [author(n, f"{first} Falkunov{end}", None, town) for n, (first, end, town) in enumerate((f, e, t) for f in ("Katharina", "Kenneth", "Robert", "Bob", "J.", "") for e in ("in", "ni", "ina") for t in ("Ravgrad", None))]
    profiles = names.settled(spark.createDataFrame(rows, AUTHORS).mapInArrow(names._read, "author_no bigint, " + names._PROFILE).withColumnRenamed("author_no", "pid"))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    kept = lambda: {str(p) for p in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("rdd-*")}
    # The weights of the grams are collected, so their few files wait for the driver's garbage; they are no matter here.
    monkeypatch.setattr(names, "gram_weights", lambda words: np.ones(grams.BUCKETS, np.float32))
    got = {}
    for slice_ in (names.SLICE, 10):
        monkeypatch.setattr(names, "SLICE", slice_)
        files, tables = shuffles(), kept()
        pairs = names.scored_pairs(profiles)
        assert not shuffles() - files
        got[slice_] = {tuple(r) for r in pairs.collect()}
        assert len(kept() - tables) <= 2  # the profiles under their keys, and the pairs
    assert len(got[10]) > 50 and len(set(map(frozenset, got.values()))) == 1


def test_rounds_give_the_greedy_clusters(spark):
    rng = np.random.default_rng(11)
    pairs = [(i, j, float(rng.random())) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.3]
    one = names.average_linkage(40, pairs, [1] * 40, 0.3)
    got = {r.pid: r.entity for r in names.linkage_rounds(spark.createDataFrame(pairs, "a bigint, b bigint, sim double"), 0.3).collect()}
    assert all((one[i] == one[j]) == (got[i] == got[j]) for i in got for j in got) and len(set(got.values())) > 3


#: Spellings of persons, written for this test: one line a person.
PERSONS = """Johannes Brandstetter|Brandstetter, J.|Johannes Brandsteter|BRANDSTETTER Johannes
Margaret Whitcombe|Whitcombe, Peggy|Margaret Whitcomb|M. Whitcombe
William T. Okonkwo|Bill Okonkwo|Okonkwo W.T.|William Okonkow
Ana García-Velasco|Garcia-Velasco, Ana|A. Garcia Velasco|Ana Velasco
Stephen Quartermaine|Steve Quartermaine|Quartermain, Stephen
Elizabeth Hargreaves|Liz Hargreaves|Hargreaves, E.|Elizabeth Hargraves
Robert Hargrove|Hargrove, Bob
Thomas Lindqvist|Tom Lindqvist|Lindquist, Thomas
Jonathan Featherstone|Jon Featherstone|Featherstonehaugh, Gilbert
Michael Achterberg|Mike Achterberg|Achterbreg, Michael
Vladimir Kuznetsov|Kuznetzov, Vladimir|V. Kuznetsov
Priyanka Subramaniam|Subramanian, Priyanka|P. Subramaniam
Rebecca Thistlewood|Becky Thistlewood|Thistlwood, Rebecca
Daniel Abernathy|Abernethy, Daniel|Dan Abernathy
Dorothea Zimmermann|Zimmerman, Dorothea|D. Zimmermann
Lars Zimmerer|Zimmerer, L.
Giovanni Castellano|Castelano, Giovanni|G. Castellano
Maria Castellanos|Castellanos, Maria"""


def test_spellings_of_another_hand(spark):
    """A pair of one line is right; Gilbert Featherstonehaugh is on a line but nobody's variant."""
    rows, of = [], {}
    for line, text in enumerate(PERSONS.splitlines()):
        for name in text.split("|"):
            of[len(rows)] = -1 if name.startswith("Featherstonehaugh") else line
            rows.append(author(len(rows), name))
    got = {(r.author_no_a, r.author_no_b) for r in names.linked_pairs(spark.createDataFrame(rows, AUTHORS)).collect()}
    want = {(i, j) for i in of for j in of if i < j and of[i] == of[j]}
    found = len(got & want)
    assert found / len(want) >= 0.85 and found / len(got) >= 0.95, (sorted((rows[i][1], rows[j][1]) for i, j in want - got), sorted((rows[i][1], rows[j][1]) for i, j in got - want))


def test_average_linkage_is_greedy():
    """Always the most similar two clusters, the earliest of equals."""
    rng = np.random.default_rng(3)
    for n in (5, 12, 30):
        sims = {(i, j): float(s) for i in range(n) for j in range(i + 1, n) if (s := round(rng.random() ** 0.5, 1)) > 0.3}
        of = list(range(n))
        while True:
            mean = lambda a, b: sum(sims.get((min(x, y), max(x, y)), 0.0) for x in range(n) for y in range(n) if of[x] == a and of[y] == b) / (of.count(a) * of.count(b))
            s, i, j = min((-round(mean(a, b), 9), a, b) for a in set(of) for b in set(of) if a < b) if len(set(of)) > 1 else (0, 0, 0)
            if -s < 0.6:
                break
            of = [i if o == j else o for o in of]
        assert names.average_linkage(n, [(i, j, s) for (i, j), s in sims.items()], [1] * n, 0.6 - 1e-9) == of


def test_average_linkage_against_plain():
    sims = {(0, 1): 0.9, (1, 2): 0.6, (0, 2): 0.2, (2, 3): 0.8}
    own = names.average_linkage(4, [(i, j, s) for (i, j), s in sims.items()], [1] * 4, 0.5)
    assert own[0] == own[1] and own[2] == own[3] and own[0] != own[2]


def test_threshold_and_margin_decide(spark):
    """A distant spelling needs the low threshold, one between two entries falls to the margin."""
    c = spark.createDataFrame([(str(i), True, f"{w} lattice", None, ["lattice"], None) for i, w in enumerate(["zanadebar", "zanadebor", "velomirat", "quirosane"])], CANON)
    v = spark.createDataFrame([("vleomirta lattice",), ("zanadebir lattice",), ("zanadebar lattice",), ("type of lattice",), ("velomirat lattice tpye 2",)], "value string")
    run = lambda **k: {r.value.split()[0]: r.external_id for r in mapping.map_values(v.where("not value rlike 'type|tpye'"), c, **k).collect()}
    assert run() == {"vleomirta": "2", "zanadebir": None, "zanadebar": "0"}
    assert run(threshold=0.9)["vleomirta"] is None
    assert run(margin=0.0)["zanadebir"] is not None
    assert [r.external_id for r in mapping.map_values(v.where("value rlike 'type|tpye'"), c).collect()] == [None, None]
