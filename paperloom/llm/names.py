"""Linking variant spellings of names typed by people.

1. A row is read into a *profile*: kind (person or group), surname, first name, middle
   initials, and what stands beside it (ORCID digits, e-mail, universities). Rows with equal
   profiles are one profile with many members, so copies are never paired.
2. A name is a vector in blocks: surname, first name, initials. Surnames are vectors of letter
   trigrams and of unordered pairs of letters at most two places apart (so a swap of neighbours
   changes little), weighted by inverse document frequency over all distinct surnames. Those of
   people with a common initial are joined by a sparse cosine join (:func:`cosine_join`): only the
   rarest grams are joined, the ones that any pair at ``FLOOR`` must share, and the exact cosine
   decides. Every pair at the floor comes out; a number of partners is never the limit.
3. A profile meets those of its own surname and those of each near one, under an initial they may
   share; a large block is dealt out into cells, and every two cells meet.
4. :func:`score` turns the cosines of the blocks and the agreement of what stands beside the names
   into a similarity (a logistic model, :data:`WEIGHTS`); everyday short forms of first names
   enter the cosine of the first names only. Average-linkage clustering inside the connected
   components of pairs at or above the threshold gives the entities; components too large for one
   task are clustered by rounds of merging nearest neighbours (:func:`linkage_rounds`).

Null, empty and blank full names fall back to given name and surname; a row with no name at all
is linked to nothing. Missing fields say nothing either way. Repeated rows of one author_no
count once. Names of any script are compared by their letters. Empty input gives empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.grams import BUCKETS, cosine, cosine_join, gram_weights, vector
from paperloom.llm.labels import slips
from paperloom.session import dropped, settled, shuffle_width

#: Profiles of a cell of a block of equal surname and initial.
CELL = 512
#: Cosine from which two surnames may be spellings of one.
FLOOR = 0.35
#: What a half of a double surname counts for the whole.
HALF = 0.9
LINK = 0.5
#: Similarities below this count as none.
NOUGHT = 0.02
#: Pairs of a component up to which it is clustered in one task.
ONE_TASK = 200_000
#: Profiles under the keys that are paired at a time, and the parts into which the keys fall for that.
SLICE, SPOTS = 100_000, 64
#: A logistic model of two profiles being of one person: fitted on the pairs of people with an
#: ORCID each (sf0.1); those of the ORCID itself, and of what such pairs hardly show (an unlike first
#: or middle name), are set.
WEIGHTS = {
    "one": 2.4, "far": -2.5, "far2": -6.9, "whole": 0.4, "first": 0.3, "first2": -6.0, "no_first": -1.0, "middle": 0.3, "other_middle": -5.0, "email": 1.0,
    "place": 3.0, "other_place": -6.3, "orcid": 3.0, "other_orcid": -3.0, "other_orcid_alone": -6.0,
}

# Everyday short forms of given names, and words that are no part of a name.
SHORT_FORMS = {
    "abigail": "abby gail", "albert": "al bert", "alexander": "alex sandy sasha", "anthony": "tony ant", "barbara": "babs barb", "benjamin": "ben benny", "bernhard": "bernd",
    "catherine": "kate cathy cat", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "deborah": "debbie deb", "dorothea": "thea dora dot",
    "edward": "ed ted ned eddie", "elizabeth": "beth liz betty lizzie eliza", "emanuel": "manny", "frances": "fran fanny", "frederick": "fred freddy", "gabriel": "gabe",
    "gerald": "gerry", "gregory": "greg", "harold": "harry hal", "helena": "lena nell", "henrietta": "hattie etta", "ignacio": "nacho", "isabella": "bella izzy", "jacob": "jake",
    "jennifer": "jenny jen", "joseph": "joe", "katharina": "kathi kathy", "kenneth": "ken kenny", "konstantin": "kostya", "laurence": "larry", "leonard": "leo len",
    "magdalena": "magda lena", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick", "nathaniel": "nate nat", "nicholas": "nick nicky", "oliver": "ollie",
    "patricia": "pat tricia patty", "philippa": "pippa", "rebecca": "becky", "richard": "dick rick", "robert": "bob rob", "samuel": "sam", "stephanie": "steph", "susanna": "sue susie",
    "theodora": "dora thea", "thomas": "tom", "timothy": "tim", "valentina": "tina", "victoria": "vicky", "wilhelmina": "willa mina", "william": "bill will liam", "zacharias": "zach",
    "andrew": "andy drew", "james": "jim jimmy", "john": "jack johnny", "jonathan": "jon", "stephen": "steve", "peter": "pete", "david": "dave", "ursula": "ulla",
}
TITLES = frozenset("dr prof professor phd md msc bsc ba ma mba dphil jr sr ii iii iv mr mrs ms miss mme herr frau dipl ing med rer nat mag sir".split())
PARTICLES = frozenset("de del della di da do dos das du des la le el van von der den ter zu y".split())
GROUP_WORDS = {"consort": "consortium", "consortium": "consortium", "group": "group", "grp": "group", "invest": "investigators", "investigators": "investigators", "netw": "network", "network": "network", "collab": "collaboration", "collaboration": "collaboration"}
GROUP_EXTRA = frozenset("the on behalf of for and st study cohort imaging trial genome".split())
_FORMAL: dict[str, frozenset[str]] = {}
for _f, _s in SHORT_FORMS.items():
    for _x in [_f, *_s.split()]:
        _FORMAL[_x] = _FORMAL.get(_x, frozenset()) | {_f}
GIVEN = frozenset(_FORMAL) | {"francois", "jurgen", "juergen", "lucia", "rene", "soren", "zoe", "ottilie"}
_BY_LETTER: dict[int, list[str]] = {}
for _x in GIVEN:
    _BY_LETTER.setdefault(len(_x), []).append(_x)


def unaccented(text: str) -> str:
    text = text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def letters(text: str) -> str:
    return unaccented(text).casefold()


@lru_cache(1 << 16)
def given_slips(token: str) -> int:
    """Slips to the nearest known given name, 9 if none is near."""
    if token in GIVEN:
        return 0
    if len(token) < 3:
        return 9
    most = 1 if len(token) <= 5 else 2
    best = 9
    for n in range(len(token) - most, len(token) + most + 1):
        for x in _BY_LETTER.get(n, ()):
            if len(x) >= 3 and (s := slips(token, x, most)) <= most:
                best = min(best, s)
    return best


def read_name(full: str | None, given: str | None = None, surname: str | None = None) -> tuple[str, str, str, str] | None:
    """(kind, surname, first, middle initials); first is a whole name or a letter or empty."""
    text = (full or "").strip() or " ".join(x for x in ((given or "").strip(), (surname or "").strip()) if x)
    text = unaccented(re.sub(r"\s+", " ", text))
    text = re.sub(r"\([^()]*\)", " ", text)
    if not re.search(r"\w", text):
        return None
    words = re.findall(r"[^\W\d_]+", text.casefold())
    heads = [GROUP_WORDS[w] for w in words if w in GROUP_WORDS]
    if heads:
        own = [w for w in words if w not in GROUP_WORDS and w not in GROUP_EXTRA]
        return ("group", "".join(own), heads[0], "") if own else None
    parts = []
    for p in text.split(","):
        # A particle belongs to the surname but is left out by many hands; in capitals it is initials.
        tokens = [t for t in re.split(r"\s+", p.strip()) if t and t.strip(".").casefold() not in TITLES and (t.isupper() or t.casefold() not in PARTICLES)]
        if tokens:
            parts.append(tokens)
    if not parts:
        return None

    def split(tokens: list[str]) -> tuple[list[str], list[str]]:
        """Initials, and whole names."""
        short, whole = [], []
        for t in tokens:
            bare = re.sub(r"[^\w'-]", "", t.casefold())
            if re.fullmatch(r"(\w\.[ -]?)*\w\.?", t) and (len(bare.replace("-", "")) <= 1 or "." in t):
                short += [c for c in bare if c.isalpha()]
            elif len(bare) <= 2 and bare.isalpha() and (t.isupper() or (t.islower() and bare not in _FORMAL)):
                short += list(bare)
            elif bare:
                whole.append(bare.strip("-'"))
        return short, whole

    if len(parts) >= 2:
        last = "".join(split(parts[0])[1]) or "".join(parts[0]).casefold()
        short, whole = split([t for p in parts[1:] for t in p])
        if whole and len(whole) == 1 and len(parts[0]) == 1 and given_slips(whole[0]) > given_slips(last):
            last, whole = whole[0], [last]
    else:
        short, whole = split(parts[0])
        if not whole:
            return ("person", "".join(short), "", "")
        # The token least like a given name is the surname; the last one if none differs.
        order = [(given_slips(re.sub(r"[^a-z]", "", w)), i) for i, w in enumerate(whole)]
        at = max(order)[1] if len(whole) > 1 else 0
        if len(whole) > 1 and surname and (s := re.sub(r"[^\w]", "", letters(surname))) and len({g for g, _ in order}) == 1:
            at = next((i for i, w in enumerate(whole) if w == s), at)
        last = whole.pop(at)
    first = whole[0] if whole else (short.pop(0) if short else "")
    middle = [w[0] for w in whole[1:]] + short
    clean = lambda w: "".join(c for c in w if c.isalpha())
    double = "-".join(x for x in map(clean, re.split(r"[-‐–]", last)) if x)
    return ("person", double, clean(first), "".join(middle)[:3])


def read_orcid(text: str | None) -> str:
    digits = re.sub(r"[^0-9x]", "", re.sub(r"orcid|id", "", (text or "").lower()))
    return digits[-16:] if len(digits) >= 16 else ""


def read_universities(affiliations: list[str] | None, email: str | None = None) -> list[str]:
    """The names beside the word for university, in any of its wordings, and that of the e-mail's domain."""
    out = set()
    if m := re.search(r"@(?:[\w.-]+\.)?(?:uni-)?([^\W\d_]{3,})\.\w+$", letters((email or "").strip())):
        out.add(m[1])
    for a in affiliations or []:
        a = letters(a or "")
        m = re.search(r"\buniv(?:ersity|ersitat|ersite|ersidad|\.)?\s+(?:of\s+|de\s+)?([^\W\d_]{3,})", a) or re.search(r"([^\W\d_]{3,})\s+univ", a)
        if m:
            out.add(m[1])
        elif re.fullmatch(r"[^\W\d_]{3,}", a.strip()):
            out.add(a.strip())
    return sorted(out)


@lru_cache(1 << 16)
def formal(first: str) -> frozenset[str]:
    """The formal names a first name may stand for, typing slips allowed."""
    if first in _FORMAL:
        return _FORMAL[first]
    if len(first) >= 4:
        most = 1 if len(first) <= 5 else 2
        near = [(slips(first, x, most), x) for n in range(len(first) - most, len(first) + most + 1) for x in _BY_LETTER.get(n, ()) if len(x) >= 4]
        near = [(s, x) for s, x in near if s <= most]
        if near:
            least = min(near)[0]
            return frozenset().union(*[_FORMAL.get(x, frozenset({x})) for s, x in near if s == least])
    return frozenset({first})


def initials(first: str) -> set[str]:
    """The letters a first name may be abbreviated to."""
    return {x[0] for x in formal(first) | {first} if x}


_PROFILE = "kind string, surname string, first string, middle string, orcid string, email string, unis array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for no, full, given, surname, email, aff, orcid in zip(*(b[c].to_pylist() for c in ("author_no", "full_name", "given_name", "surname", "email", "affiliations", "orcid"))):
            r = read_name(full, given, surname)
            if r and r[1]:
                out.append((no, *r, read_orcid(orcid), (email or "").strip().lower(), read_universities(aff, email)))
        cols = list(zip(*out)) if out else [()] * 8
        types = [pa.int64(), *[pa.string()] * 6, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["author_no", "kind", "surname", "first", "middle", "orcid", "email", "unis"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The profiles under each key (kind and initial) by which they may be met."""
    for b in batches:
        letters_ = [sorted(initials(f)) if k == "person" and f else ([f] if f else ["?"]) for k, f in zip(b["kind"].to_pylist(), b["first"].to_pylist())]
        at = pa.array([i for i, ls in enumerate(letters_) for _ in ls], pa.int64())
        keys = pa.array([f"{k}|{x}" for k, ls in zip(b["kind"].to_pylist(), letters_) for x in ls], pa.string())
        yield pa.RecordBatch.from_arrays([keys, *(b[c].take(at) for c in ("pid", *_FIELDS))], ["key", "pid", *_FIELDS])


_EVEN = np.ones(BUCKETS, dtype=np.float32)


@lru_cache(1 << 14)
def _plain(word: str) -> dict[int, float]:
    return vector(word, _EVEN)


@lru_cache(1 << 16)
def first_cosine(f: str, g: str) -> float:
    """The cosine of two first names, or of the formal names they may stand for."""
    return max(cosine(_plain(x), _plain(y)) for x in {f, *_FORMAL.get(f, ())} for y in {g, *_FORMAL.get(g, ())})


def facts(near: float, a: tuple, b: tuple) -> dict[str, float] | None:
    """What two profiles (kind, surname, first, middle, orcid, email, unis) with surnames of that
    cosine have in common; nothing if they are of two kinds or their initials differ."""
    if a[0] != b[0]:
        return None
    far = 1.0 - near
    out = {"one": 1.0, "far": far, "far2": far * far}
    if a[0] == "group":
        return out if a[2] == b[2] else None
    if a[2] and b[2]:
        if len(a[2]) > 1 and len(b[2]) > 1:
            c = first_cosine(a[2], b[2])
            out |= {"whole": 1.0, "first": c, "first2": (1 - c) ** 2}
        elif not initials(a[2]) & initials(b[2]):
            return None
    else:
        out["no_first"] = 1.0
    if a[3] and b[3]:
        out["middle" if a[3][0] == b[3][0] else "other_middle"] = 1.0
    shared = bool(set(a[6]) & set(b[6]))
    same_email = bool(a[5]) and a[5] == b[5]
    if same_email:
        out["email"] = 1.0
    if shared:
        out["place"] = 1.0
    elif a[6] and b[6]:
        out["other_place"] = 1.0
    if a[4] and b[4]:
        # An ORCID is now and then a wrong one; a shared place speaks louder.
        out["orcid" if a[4] == b[4] else "other_orcid" if shared or same_email else "other_orcid_alone"] = 1.0
    return out


def score(near: float, a: tuple, b: tuple) -> float:
    """The similarity of two profiles whose surnames have the cosine ``near``, from 0 to 1."""
    got = facts(near, a, b)
    return 0.0 if got is None else 1.0 / (1.0 + exp(-sum(WEIGHTS[k] * v for k, v in got.items())))


_FIELDS = ("kind", "surname", "first", "middle", "orcid", "email", "unis")


def _met(rows: list[tuple], one: bool) -> Iterator[tuple[int, int, float]]:
    """(a, b, sim), a < b, of the rows (cell, near, pid, *profile) of two cells, or of one with itself.

    Those of the block's own surname (near = 1) meet one another and the visitors."""
    named: dict[tuple[float, str, str], list[tuple]] = {}
    for r in rows:
        named.setdefault((r[1], r[4], r[5]), []).append(r)
    own = [x for x in named if x[0] >= 1.0]
    for i, x in enumerate(own):
        for y in [*own[i:], *(v for v in named if v[0] < 1.0)]:
            near = y[0]
            if facts(near, named[x][0][3:], named[y][0][3:]) is None:
                continue
            for n, p in enumerate(named[x]):
                for q in named[x][n + 1 :] if x == y else named[y]:
                    if p[2] != q[2] and (one or p[0] != q[0]) and (s := score(near, p[3:], q[3:])) >= NOUGHT:
                        yield min(p[2], q[2]), max(p[2], q[2]), s


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored pairs of rows sorted by (key, low, high)."""

    def blocks() -> Iterator[tuple[list[tuple], bool]]:
        at, held = ("", 0, 0), []
        for b in batches:
            for key, low, high, *row in zip(*(b[c].to_pylist() for c in ("key", "low", "high", "cell", "near", "pid", *_FIELDS))):
                if (key, low, high) != at:
                    yield held, at[1] == at[2]
                    at, held = (key, low, high), []
                held.append(tuple(row))
        yield held, at[1] == at[2]

    batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["a", "b", "sim"])
    out: list[tuple] = []
    for held, one in blocks():
        if len(held) > 1:
            for r in _met(held, one):
                out.append(r)
                if len(out) == 50_000:
                    yield batch(out)
                    out = []
    yield batch(out)


def average_linkage(n: int, pairs: list[tuple[int, int, float]], weight: list[int], threshold: float) -> list[int]:
    """Cluster numbers; pairs not given have similarity 0. Weights count the members of a node."""
    sums: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, s in pairs:
        sums[i][j] = sums[j][i] = s * weight[i] * weight[j]
    size, owner = list(weight), list(range(n))
    mean = lambda i, j: sums[i][j] / (size[i] * size[j])
    # Only pairs at the threshold wait, the most similar first; one that has changed waits again.
    heap = [(-mean(i, j), i, j) for i in range(n) for j in sums[i] if i < j and mean(i, j) >= threshold]
    heapify(heap)
    while heap:
        s, i, j = heappop(heap)
        if j not in sums[i] or -s != mean(i, j):
            continue
        for k, s in sums[j].items():
            if k != i:
                sums[i][k] = sums[k][i] = sums[i].get(k, 0.0) + s
                del sums[k][j]
        sums[i].pop(j, None)
        sums[j] = {}
        size[i] += size[j]
        owner[j] = i
        for k in sums[i]:
            if mean(i, k) >= threshold:
                heappush(heap, (-mean(i, k), min(i, k), max(i, k)))
    # A node joins a smaller one only, so its owner is final when its turn comes.
    for i in range(n):
        owner[i] = owner[owner[i]]
    return owner


def _cluster(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The clusters of components whose rows (root, a, b, sim) follow one another."""

    def one(rows: list[tuple[int, int, float]]) -> tuple[list[int], list[int]]:
        ids = sorted({x for a, b, _ in rows for x in (a, b)})
        at = {v: i for i, v in enumerate(ids)}
        owner = average_linkage(len(ids), [(at[a], at[b], s) for a, b, s in rows], [1] * len(ids), threshold)
        return ids, [ids[o] for o in owner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, []
        for b in batches:
            pids, entities = [], []
            for r, *row in zip(*(b[c].to_pylist() for c in ("root", "a", "b", "sim"))):
                if r != root and held:
                    p, e = one(held)
                    pids += p
                    entities += e
                    held = []
                root = r
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(entities, pa.int64())], ["pid", "entity"])
        if held:
            p, e = one(held)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(e, pa.int64())], ["pid", "entity"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b).

    Each round a node takes the smallest root among itself and its neighbours, then the root of
    that root; lineage is cut every round, and only the tables of nodes travel."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    held = roots
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = roots.join(near, roots["node"] == near["a"], "left").select("node", F.least("root", F.coalesce("near", "root")).alias("new"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("j"), F.col("root").alias("j_root"))
        after = settled(stepped.join(jump, stepped["new"] == jump["j"], "left").select("node", F.least("new", F.coalesce("j_root", "new")).alias("root"), "old"))
        changed = after.where("root <> old").limit(1).count()
        dropped(held)
        held = after
        roots = after.drop("old")
        if not changed:
            dropped(both)
            return roots


def linkage_rounds(pairs: DataFrame, threshold: float) -> DataFrame:
    """(pid, entity): average linkage of ``pairs(a, b, sim)``, a < b, by rounds of joins.

    In each round every two clusters that are each other's nearest at the threshold merge; average
    linkage never makes a third one nearer than both were, so this is the order of the greedy one.
    Ties go to the smaller ids. Nothing is gathered; a round shuffles the pairs of clusters left."""
    ends = pairs.select(F.col("a").alias("pid")).union(pairs.select(F.col("b").alias("pid"))).distinct()
    member = settled(ends.select("pid", F.col("pid").alias("entity")))
    links = settled(pairs.select("a", "b", F.col("sim").alias("total")))
    while True:
        size = member.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
        of = lambda s: size.select(F.col("entity").alias(s), F.col("n").alias(f"n_{s}"))
        mean = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("mean")).where(F.col("mean") >= threshold)
        both = mean.select("a", "b", "mean").union(mean.select(F.col("b"), F.col("a"), "mean"))
        best = both.groupBy("a").agg(F.min_by(F.struct("b"), F.struct(-F.col("mean"), F.least("a", "b"), F.greatest("a", "b"))).alias("x")).select("a", F.col("x.b").alias("b"))
        mutual = settled(best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b"))
        if not mutual.limit(1).count():
            return member
        now = lambda s: mutual.select(F.col("b").alias(s), F.col("a").alias(f"now_{s}"))
        member = settled(member.join(now("entity"), "entity", "left").select("pid", F.coalesce("now_entity", "entity").alias("entity")))
        moved = links.join(now("a"), "a", "left").join(now("b"), "b", "left").select(F.coalesce("now_a", "a").alias("x"), F.coalesce("now_b", "b").alias("y"), "total").where("x <> y")
        links = settled(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("total").alias("total")))


def keyed_profiles(profiles: DataFrame) -> DataFrame:
    return settled(profiles.select("pid", *_FIELDS).mapInArrow(_keyed, "key string, pid bigint, " + _PROFILE))


def surname_words(keyed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The surnames (key, word) under each key, the halves (key, a, half) of double ones, and both as words."""
    own = keyed.select("key", F.col("surname").alias("word")).distinct()
    # A half of a double surname stands for the whole.
    halves = own.where(F.contains("word", F.lit("-"))).select("key", F.col("word").alias("a"), F.explode(F.split("word", "-")).alias("half")).where(F.length("half") >= 4)
    return own, halves, own.union(halves.select("key", F.col("half").alias("word"))).distinct()


def surname_visits(keyed: DataFrame, weights: np.ndarray, floor: float) -> DataFrame:
    """(key, a, b, near): the profiles of surname ``a`` stand in the block of ``b``: each in that of its
    own (near = 1), and in that of the greater of two near ones."""
    own, halves, every = surname_words(keyed)
    words = settled(every)
    near = settled(cosine_join(words, weights, floor))
    dropped(words)
    both = near.select("key", "a", "b", "cosine").union(near.select("key", F.col("b"), F.col("a"), "cosine"))
    by_half = halves.select("key", "a", F.col("half").alias("b"), F.lit(HALF).alias("cosine")).union(
        halves.join(both.select("key", F.col("a").alias("half"), "b", "cosine"), ["key", "half"]).where("b <> a").select("key", "a", "b", (HALF * F.col("cosine")).alias("cosine"))
    )
    visits = near.union(by_half.where(F.col("cosine") >= floor)).groupBy("key", "a", "b").agg(F.least(F.max("cosine"), F.lit(0.9999)).alias("near"))
    out = settled(own.select("key", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(1.0).alias("near")).union(visits))
    dropped(near)
    return out


def scored_slice(keyed: DataFrame, weights: np.ndarray, floor: float) -> DataFrame:
    """The scored pairs of all profiles of some keys. Blocks are counted and dealt out by surnames; the
    profiles themselves travel to their cells only."""
    visits = surname_visits(keyed, weights, floor)
    counts = keyed.groupBy("key", F.col("surname").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    sizes = visits.join(counts, ["key", "a"]).groupBy("key", "b").agg(F.sum("n").alias("n"), F.max("near").alias("top"))
    # A block without a profile of its own has no pair.
    places = settled(visits.join(sizes.where("top >= 1 and n > 1").select("key", "b", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), ["key", "b"]).withColumnRenamed("key", "under"))
    dropped(visits)
    dealt = keyed.join(places, (F.col("key") == F.col("under")) & (F.col("surname") == F.col("a"))).withColumn("cell", F.pmod("pid", F.col("cells")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = other.select(F.concat_ws("|", "key", "b").alias("key"), F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "near", "pid", *_FIELDS)
    sorted_ = cells.repartition(shuffle_width(keyed.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    out = settled(sorted_.mapInArrow(_scored, "a bigint, b bigint, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim")))
    dropped(places)
    return out


def scored_keyed(keyed: DataFrame, floor: float) -> DataFrame:
    """(a, b, sim) of all profiles under their keys, a < b.

    Pairs meet under one key only, so the keys are taken in slices of about ``SLICE`` profiles, one
    after another: the disk holds what one slice moves, and the pairs found so far."""
    words = settled(surname_words(keyed)[2].select("word").distinct())
    weights = gram_weights(words)
    dropped(words)
    spot = F.pmod(F.xxhash64("key"), F.lit(SPOTS))
    counts = sorted(((r["count"], r["spot"]) for r in keyed.groupBy(spot.alias("spot")).count().collect()), reverse=True)
    slices: list[tuple[int, list[int]]] = [(0, []) for _ in range(max(1, min(len(counts), -(-sum(n for n, _ in counts) // SLICE))))]
    for n, at in counts:
        least = min(range(len(slices)), key=lambda i: slices[i][0])
        slices[least] = (slices[least][0] + n, [*slices[least][1], at])
    if len(slices) == 1:
        return scored_slice(keyed, weights, floor)
    parts = [scored_slice(keyed.where(spot.isin(spots)), weights, floor) for _, spots in slices]
    # A pair may meet under several initials.
    out = settled(reduce(DataFrame.union, parts).groupBy("a", "b").agg(F.max("sim").alias("sim")))
    dropped(*parts)
    return out


def scored_pairs(profiles: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(a, b, sim): all profiles with a similarity whose surnames are near and whose initials may agree, a < b."""
    return scored_keyed(keyed_profiles(profiles), floor)


def link_names(authors: DataFrame, threshold: float = LINK, floor: float = FLOOR, one_task: int = ONE_TASK) -> DataFrame:
    """(author_no, entity): rows with the same entity name the same person or group."""
    once = authors.select("author_no", "full_name", "given_name", "surname", "email", "affiliations", "orcid").where("author_no is not null").repartition(shuffle_width(authors.sparkSession), "author_no").dropDuplicates(["author_no"])
    read = once.mapInArrow(_read, "author_no bigint, " + _PROFILE)
    hashed = read.withColumn("pid", F.xxhash64(*_FIELDS))
    wide = settled(hashed)
    keyed = keyed_profiles(wide.groupBy("pid").agg(*[F.first(f).alias(f) for f in _FIELDS]))
    rows = settled(wide.select("author_no", "pid"))
    dropped(wide)
    scored = scored_keyed(keyed, floor)
    dropped(keyed)
    strong = scored.where(F.col("sim") >= threshold)
    roots = components(strong)
    inside = (
        scored.join(roots.select(F.col("node").alias("a"), "root"), "a")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b").where("root = root_b")
    )
    inside = settled(inside.select("root", "a", "b", "sim"))
    dropped(scored)
    large = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_task).select("root")
    many = large.limit(1).count() > 0
    # The others are small and many: dealt out by number, as adaptive execution would join them in one task.
    small = inside.join(large, "root", "left_anti") if many else inside
    clusters = small.repartition(shuffle_width(authors.sparkSession), "root").sortWithinPartitions("root").mapInArrow(_cluster(threshold), "pid bigint, entity bigint")
    if many:
        clusters = clusters.unionByName(linkage_rounds(inside.join(large, "root", "left_semi"), threshold))
    return rows.join(clusters, "pid", "left").select("author_no", F.coalesce("entity", "pid").alias("entity"))


def linked_pairs(authors: DataFrame, threshold: float = LINK) -> DataFrame:
    """(author_no_a, author_no_b): all pairs of rows of one entity, a < b."""
    linked = settled(link_names(authors, threshold))
    return linked.select("entity", F.col("author_no").alias("author_no_a")).join(linked.select("entity", F.col("author_no").alias("author_no_b")), "entity").where("author_no_a < author_no_b").select("author_no_a", "author_no_b")
