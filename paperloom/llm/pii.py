"""Personal information inside free text: a skip-chain conditional random field.

Nodes are the spans of a text that could be an item: e-mail notations, runs of digits and codes,
street lines, and names (what follows a title; initials, given names or any capitalised words with a
capitalised word). A node's own potentials come from a log-linear model over its form and the words
around it; neighbouring nodes share a chain potential; and nodes anywhere in the document that hold
the same surname or number share a skip potential, those that hold a similar one (a surname within
one slip, a number with the same last seven digits) another. Loopy belief propagation passes
messages until they settle, so a clear mention decides an unclear one of the same person or number,
and of overlapping spans the likelier one stands.

All potentials are learnt, piecewise: the log-linear part by multinomial logistic regression, those
of chain and skip edges from the labels at both ends. Labels come from documents that are labelled by
construction (:mod:`paperloom.llm.pii_seeds`), then from the corpus itself: on at most ``TRAIN_DOCS``
documents, drawn by a hash of their id, the first model labels what it is sure of (``SURE``), at most
``NODES_AT_MOST`` nodes, and the second one learns from both. Features of context are left out at random
in training, so that the form of an item is learnt as well.

Positions count code points from 0. Null and empty texts have no items. Titles, labels and
``mailto:`` are not part of an item. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.labels import slips
from paperloom.llm import pii_seeds
from paperloom.llm.names import GIVEN, letters
from paperloom.session import spread

KINDS = ("none", "email", "phone", "id_number", "address", "name")
DIM = 1 << 15
TRAIN_DOCS, NODES_AT_MOST, SEED_DOCS = 20_000, 30_000, 6_000
#: Likelihood from which the first model's label of a node is taken for the second one.
SURE = 0.95
EDGES = ("chain", "equal", "similar")
ROUNDS, DAMPING = 12, 0.3

_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ][^\W\d_]+)*"
_INITIALS = r"(?:[A-ZÀ-ÖØ-Þ]\.[ \u00a0\u202f-]?){1,3}"
_S = r"[ \u00a0\u202f]"
# Words that stand before a name, a street or a number, in four languages.
_TITLE = r"(?:Dra?|Prof|Professor|Mrs?|Ms|Miss|Mme|Mlle|M|Pr|Sra?|Srta|Herrn?|Frau|Don|Doña)"
_TITLE_AFTER = _TITLE.replace("|M|", "|")  # after another title it is an initial
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE}\.?{_S}+)(?:{_TITLE_AFTER}\.?{_S}+|med\.{_S}+|rer\.{_S}+|nat\.{_S}+|Dipl\.-Ing\.{_S}+)*(?={_CAP}|[A-ZÀ-ÖØ-Þ]\.)")
_BODY = re.compile(rf"(?:{_INITIALS}{_S}*{_CAP}|{_CAP},{_S}{_CAP}|{_CAP},{_S}(?:[A-ZÀ-ÖØ-Þ]\.)(?:{_S}?[A-ZÀ-ÖØ-Þ]\.)*|{_CAP}(?:{_S}+{_INITIALS})?{_S}+{_CAP}|{_CAP})")
_NAME = re.compile(rf"(?<![\w.@-])(?:({_INITIALS}{_S}*{_CAP}(?:{_S}{_CAP})?)|({_CAP}),{_S}+({_CAP}|[A-ZÀ-ÖØ-Þ]\.(?:{_S}?[A-ZÀ-ÖØ-Þ]\.)*)|({_CAP})((?:{_S}+{_INITIALS})?{_S}+{_CAP}))")
_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w][\w.+%'-]*" + rf"(?:{_S}?@{_S}?|{_S}?[(\[]{_S}?at{_S}?[)\]]{_S}?)"
    + rf"[\w-]+(?:(?:\.|{_S}?[(\[]{_S}?dot{_S}?[)\]]{_S}?)[\w-]+)*(?:\.|{_S}?[(\[]{_S}?dot{_S}?[)\]]{_S}?)[^\W\d_]{{2,}}(?!\w)"
)
_DIGITS = re.compile(rf"(?<![\w,/@.-])(?:\+{_S}?)?\(?\d+\)?(?:(?:(?<=\))|[ \u00a0\u202f./-]|{_S}[/-]{_S}?)\(?\d+\)?)*(?![\w])(?!/\w)(?![.,]\d)(?:,?{_S}?(?:ext|extension|x|Durchwahl)\.?{_S}?\d{{1,5}})?", re.I)
_CODE = re.compile(r"(?<![\w/@.-])(?:[A-Z]{1,4}[- ]?\d{3,}(?:[-/ ]\d+)*|\d{6,}[A-Z]|(?:\d{4}-){3}\d{3}X)(?![\w])(?![-/]\w)")
_UPPER = rf"(?:{_CAP}|[NSEW]\.)"
_PLACE = rf"(?:,{_S}(?:(?:[A-Z]{{1,3}}-?)?\d{{4,5}}{_S})?{_CAP}(?:{_S}(?:[A-Z]{{2}}\d{{1,2}}{_S}\d[A-Z]{{2}}|\d{{5}}))?(?:,{_S}[A-Z]{{2}}{_S}\d{{5}})?)"
_ROAD = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Court|Ct\.?|Close|Avenue|Ave\.?|Drive|Dr\.?|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd\.?|Row|Hill|Gardens)"
_ADDRESS = [
    re.compile(rf"(?<![\w.,/-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room){_S}\w+,{_S})?\d+[A-Za-z]?,?{_S}(?:{_UPPER}{_S}){{1,3}}{_ROAD}(?!\w)(?:,{_S}(?:Flat|Apt\.?|Apartment|Unit|Suite|Room){_S}\w+)?{_PLACE}?"),
    re.compile(rf"(?<![\w-])(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur){_S})?[A-ZÄÖÜ][^\W\d_]*(?:-[A-ZÄÖÜ][^\W\d_]*)*(?:straße|strasse|str\.|platz|gasse|weg|allee|ring|ufer|damm){_S}\d+[a-z]?(?!\w){_PLACE}?"),
    re.compile(rf"(?<![\w.,/-])(?:\d+(?:{_S}?(?:bis|ter))?,?{_S})?(?:rue|avenue|boulevard|place|impasse|allée|chemin|quai|cours){_S}(?:(?:de|du|des|la|le|les|d'|l'|de{_S}la){_S}?)*{_CAP}(?:{_S}{_CAP})*{_PLACE}?"),
    re.compile(rf"(?<![\w.-])(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Carrera){_S}?(?:(?:de|del|la|las|los|el){_S})*{_CAP}(?:{_S}{_CAP})*,?{_S}(?:n\.?º{_S})?\d+[A-Za-z]?(?!\w)(?:,{_S}\d+\.?º{_S}?\w?)?{_PLACE}?"),
]
_NOT_NAME = frozenset("The A An This That These Those We Our In On At By For From With And Or But If Is Are Was Were Does Did Do No Not See Table Fig Figure Sect Section Data Values Version Street University Department Institute Die Der Das Ein Eine Für Wir Im Les Le La Un Une Nous El Los Las Una Por Para En Aún".split())

@dataclass
class Node:
    start: int
    end: int
    form: str
    key: str
    features: list[str]


@lru_cache(1 << 16)
def _given(word: str) -> bool:
    w = re.sub(r"[^a-z]", "", letters(word))
    return w in GIVEN or (len(w) >= 5 and any(abs(len(w) - len(x)) <= 1 and slips(w, x, 1) <= 1 for x in GIVEN if len(x) >= 5))


def _words_before(text: str, at: int, n: int = 4) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, at - 48) : at])][-n:][::-1]


def _words_after(text: str, at: int, n: int = 2) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text[at : at + 32])][:n]


def _mask(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", s)))


# What a text must hold for a pattern to match at all.
_AT = re.compile(r"@|[(\[][ \u00a0\u202f]?at[ \u00a0\u202f]?[)\]]")
_DIGIT = re.compile(r"\d")
_STREET_WORDS = [
    ("St", "Road", "Rd", "Lane", "Ln", "Court", "Ct", "Close", "Ave", "Dr", "Way", "Place", "Square", "Terrace", "Crescent", "Boulevard", "Blvd", "Row", "Hill", "Gardens"),
    ("straße", "strasse", "str.", "platz", "gasse", "weg", "allee", "ring", "ufer", "damm"),
    ("rue", "avenue", "boulevard", "place", "impasse", "allée", "chemin", "quai", "cours"),
    ("Calle", "C/", "Avda", "Avenida", "Plaza", "Pza", "Paseo", "Camino", "Ronda", "Carrera"),
]


def nodes_of(text: str) -> list[Node]:
    """The candidate spans of a text, in order; none overlaps another of its form."""
    out: list[Node] = []

    def add(start: int, end: int, form: str, key: str, *extra: str) -> None:
        before, after = _words_before(text, start), _words_after(text, end)
        # A label may stand inside the code itself, as in "ISSN 1234".
        if form == "code" and (head := re.match(r"[A-Za-z]{3,}", text[start:end])):
            before = [head[0].lower(), *before]
        # What stands between the last word and the span.
        gap = re.search(r"[^\w]*$", text[max(0, start - 6) : start])[0].strip()
        f = [f"form={form}", *extra, *(f"{form}|b{i}={w}" for i, w in enumerate(before[:3])), *(f"{form}|b={w}" for w in before), *(f"{form}|p={w[:6]}" for w in before), *(f"{form}|a{i}={w}" for i, w in enumerate(after)), f"{form}|gap={gap}"]
        out.append(Node(start, end, form, key, f))

    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            start = m.start() + (7 if m[0].lower().startswith("mailto:") else 0)
            add(start, m.end(), "email", m[0].lower(), f"at={'@' in m[0]}")
    if digit := bool(_DIGIT.search(text)):
        for m in _CODE.finditer(text):
            add(m.start(), m.end(), "code", re.sub(r"\W", "", m[0]), f"mask={_mask(m[0])}", f"len={len(re.sub(r'[^0-9]', '', m[0]))}")
        codes = [(n.start, n.end) for n in out]  # those of e-mails too
        for m in _DIGITS.finditer(text):
            s, e = m.start(), m.end()
            t = m[0]
            if t.count(")") > t.count("(") and t.endswith(")"):
                t, e = t[:-1], e - 1
            if t.count("(") > t.count(")") and t.startswith("("):
                t, s = t[1:], s + 1
            digits = re.sub(r"\D", "", t)
            if not 7 <= len(digits) <= 18 or any(a < e and s < b for a, b in codes):
                continue
            mask = _mask(t)
            add(s, e, "digits", digits, f"mask={mask}", f"len={len(digits)}", f"head={mask[:4]}", f"plus={t[0] in '+(0'}", f"seps={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', t))))}")
    for k, pattern in enumerate(_ADDRESS):
        # Only a French street may go without a number.
        for m in pattern.finditer(text) if (digit or k == 2) and any(w in text for w in _STREET_WORDS[k]) else ():
            add(m.start(), m.end(), "address", m[0].lower(), f"street={k}", f"number={bool(re.search(r'[0-9]', m[0]))}")
    fixed = [(n.start, n.end) for n in out if n.form in ("address", "email")]
    titled: dict[int, int] = {}
    for m in _TITLED.finditer(text):
        title = m[0].strip()
        # "M." before a name is a title only after a French word, else an initial.
        if title == "M." and not re.search(r"(?:à|demander|de|par|avec|chez|que|et|contacter|remercions|pour|voir|[:(])\s*$", text[max(0, m.start() - 14) : m.start()], re.I):
            continue
        if body := _BODY.match(text, m.end()):
            a, b = body.span()
            if "," in body[0]:
                head, _, rest = body[0].partition(",")
                if not (_given(rest) or re.fullmatch(r"\s*(?:[A-ZÀ-ÖØ-Þ]\.\s?)+", rest)):
                    b = a + len(head)
            elif (ws := body[0].split())[1:] and not any(_given(w) or w.endswith(".") for w in ws[:-1]) and ws[-1] in _NOT_NAME:
                b = a + len(ws[0])
            titled[a] = b
    for a, b in titled.items():
        if not any(x < b and a < y for x, y in fixed):
            add(a, b, "name", letters(re.findall(r"[^\W\d_]{3,}", text[a:b])[-1] if re.findall(r"[^\W\d_]{3,}", text[a:b]) else text[a:b]), "how=title")
    done = [*fixed, *titled.items()]
    pos = 0
    while m := _NAME.search(text, pos):
        a, b = m.span()
        how = ""
        if m[1]:
            body = re.sub(rf"^{_INITIALS}{_S}*", "", m[1]).split()
            how = "initials"
            if len(body) > 1 and not (_given(body[0]) and body[1] not in _NOT_NAME):
                b = a + m[1].rindex(body[-1])
                b = a + len(text[a:b].rstrip())
            # A point of the compass behind a number is no initial.
            if body[0] in _NOT_NAME or re.search(r"\d[ \u00a0\u202f]$", text[max(0, a - 2) : a]):
                how = ""
        elif m[2]:
            if (_given(m[3]) or m[3].endswith(".")) and m[2] not in _NOT_NAME and not _given(m[2]):
                how = "inverted" if _given(m[3]) else "inverted_initials"
        elif _given(m[4]) and m[4] not in _NOT_NAME and m[5].split()[-1] not in _NOT_NAME:
            how = "given"
        elif m[4] not in _NOT_NAME and "." not in m[5] and not (ws := m[5].split())[-1] in _NOT_NAME and not _given(ws[-1]) and min(len(m[4]), len(ws[-1])) > 2 and not (m[4].isupper() or ws[-1].isupper()):
            how = "pair"
        if how and not any(x < b and a < y for x, y in done):
            words = re.findall(r"[^\W\d_]{3,}", text[a:b]) or [text[a:b]]
            key = words[0] if how.startswith("inverted") else words[-1]
            head = re.match(r"[- ]?([^\W\d_]+)", text[b : b + 20])
            opens = not text[:a].rstrip() or text[:a].rstrip()[-1] in ".!?:\n" or "\n" in text[max(0, a - 2) : a]
            add(a, b, "name", letters(key), f"how={how}", f"how={how}|opens={opens}", f"how={how}|head={head[1].lower() if head else ''}", *(f"how={how}|last={letters(w)}" for w in words[-1:]), *(f"how={how}|end={letters(w)[-3:]}" for w in words), *(f"how={how}|b0={w}" for w in _words_before(text, a, 1)))
            # Of three capitalised words any two next to each other may be the name.
            pos = b if how != "pair" else a + len(m[4])
        else:
            # Go on behind the first word, as the next may begin a name.
            step = re.match(rf"(?:[A-ZÀ-ÖØ-Þ]\.|{_CAP})[, \u00a0\u202f-]*", text[m.start() :])
            pos = m.start() + max(1, step.end() if step else 1)
    return sorted(out, key=lambda n: (n.start, -n.end))


def _variants(key: str) -> list[str]:
    """What two keys within one slip of each other have in common."""
    return [key, *(key[:i] + key[i + 1 :] for i in range(len(key)))]


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(i, j, sort of edge): neighbours, and each node with the last one before it that holds the
    same or a similar thing; so their number grows with the nodes only."""
    out = [(i, i + 1, 0) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= 80]
    last: dict[str, int] = {}
    near: dict[str, int] = {}
    for j, x in enumerate(nodes):
        if len(x.key) < 4 or x.form in ("email", "address"):
            continue
        signs = [x.key[-7:]] if x.form != "name" else _variants(x.key) if len(x.key) >= 5 else []
        if x.key in last:
            out.append((last[x.key], j, 1))
        else:
            met = {near[v] for v in signs if v in near}
            for i in sorted(met):
                if x.form != "name" or slips(nodes[i].key, x.key, 1) <= 1:
                    out.append((i, j, 2))
        last[x.key] = j
        for v in signs:
            near[v] = j
    return out


#: Features of the context are told by their sign.
def _coded(features: list[str]) -> list[int]:
    return [~h if "|b" in f or "|a" in f or "|p=" in f else h for f in features for h in (zlib.crc32(f.encode()) % DIM,)]


def _index(coded: list[int]) -> np.ndarray:
    i = np.array(coded, dtype=np.int64)
    return np.where(i < 0, ~i, i)


@dataclass
class Model:
    unary: np.ndarray  # (DIM, kinds)
    pairs: np.ndarray  # (sorts of edges, kinds, kinds)

    def beliefs(self, nodes: list[Node], edges: list[tuple[int, int, int]] | None = None) -> np.ndarray:
        """(nodes, kinds) marginals by loopy belief propagation with damped max-normalised sum messages."""
        n, k = len(nodes), len(KINDS)
        own = np.stack([self.unary[_index(_coded(x.features))].sum(axis=0) for x in nodes]) if n else np.zeros((0, k))
        edges = edges_of(nodes) if edges is None else edges
        belief = own
        if edges:
            src = np.array([e[0] for e in edges] + [e[1] for e in edges])
            dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
            sort = np.array([e[2] for e in edges])
            table = np.concatenate([self.pairs[sort], self.pairs[sort].transpose(0, 2, 1)])
            half, messages = len(edges), np.zeros((2 * len(edges), k))
            back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, dst, messages)
                z = (belief[src] - messages[back])[:, :, None] + table
                top = z.max(axis=1)
                fresh = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
                fresh -= fresh.max(axis=1, keepdims=True)
                moved = float(np.abs(fresh - messages).max())
                messages = DAMPING * messages + (1 - DAMPING) * fresh
                if moved < 1e-3:
                    break
            belief = own.copy()
            np.add.at(belief, dst, messages)
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
        return p / p.sum(axis=1, keepdims=True) if n else p

    def label(self, nodes: list[Node]) -> list[str]:
        return [KINDS[j] for j in self.beliefs(nodes).argmax(axis=1)] if nodes else []


def train(groups: list[tuple[list[list[int]], list[str], list[tuple[int, int, int]]]], epochs: int = 7, seed: int = 3) -> Model:
    """``groups``: per document, the coded features of its nodes, their labels (empty: unknown), its edges."""
    rng = np.random.default_rng(seed)
    rows, ys = [], []
    pairs = np.full((len(EDGES), len(KINDS), len(KINDS)), 0.5)
    for features, labels, edges in groups:
        for f, y in zip(features, labels):
            if y:
                rows.append(f)
                ys.append(KINDS.index(y))
        for i, j, sort in edges:
            if labels[i] and labels[j]:
                pairs[sort, KINDS.index(labels[i]), KINDS.index(labels[j])] += 1
    y = np.array(ys)
    w = np.zeros((DIM, len(KINDS)))
    grad2 = np.full((DIM, len(KINDS)), 1e-6)
    # Rare labels count as much as frequent ones, up to a factor of ten.
    counts = np.bincount(y, minlength=len(KINDS)).astype(float)
    balance = np.clip(counts.max() / np.maximum(counts, 1), 1, 10) ** 0.5
    size = np.array([len(r) for r in rows])
    coded = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
    soft, flat = coded < 0, np.where(coded < 0, ~coded, coded)
    ends = np.cumsum(size)
    for _ in range(epochs):
        for block in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            # Context is left out for a third of the nodes.
            bare = rng.random(len(block)) < 0.33
            at = np.repeat(np.arange(len(block)), size[block])
            pick = np.concatenate([np.arange(ends[i] - size[i], ends[i]) for i in block])
            use = ~(soft[pick] & bare[at])
            pick, at = flat[pick[use]], at[use]
            z = np.zeros((len(block), len(KINDS)))
            np.add.at(z, at, w[pick])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(block)), y[block]] -= 1
            p *= balance[y[block]][:, None]
            touched, where = np.unique(pick, return_inverse=True)
            g = np.zeros((len(touched), len(KINDS)))
            np.add.at(g, where, p[at])
            g = g / len(block) + 1e-5 * w[touched]
            grad2[touched] += g * g
            w[touched] -= 0.5 * g / np.sqrt(grad2[touched])
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    pmi = np.log(joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))
    # A neighbour tells little that the words do not, so the chain counts half.
    return Model(w.astype(np.float32), np.clip(pmi, -3, 3) * np.array([0.5, 1.0, 1.0])[:, None, None])


def seed_groups(documents: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple]:
    """Training groups of documents with their items: a node is an item if it begins as one does, and
    if any capitalised words would do, ends no later; the label of a name inside another is not told."""
    out = []
    for text, items in documents:
        nodes = nodes_of(text)
        at = {a: (b, k) for a, b, k in items}
        inside = lambda n: n.form == "name" and any(k == "name" and a < n.start and n.end <= b for a, b, k in items)
        labels = [at[n.start][1] if n.start in at and not ("how=pair" in n.features and n.end > at[n.start][0]) else "" if inside(n) else "none" for n in nodes]
        out.append(([_coded(n.features) for n in nodes], labels, edges_of(nodes)))
    return out


@lru_cache(1)
def _constructed(documents: int) -> list[tuple]:
    return seed_groups(pii_seeds.documents(documents))


@lru_cache(1)
def first_model(documents: int = SEED_DOCS) -> Model:
    """The model of the constructed documents alone (the same in every run, so made once a process)."""
    return train(_constructed(documents))


_LABELLED = pa.struct([("features", pa.list_(pa.list_(pa.int32()))), ("labels", pa.list_(pa.string())), ("edges", pa.list_(pa.list_(pa.int32())))])


def _sure(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                nodes = nodes_of(t or "")
                if not nodes:
                    continue
                edges = edges_of(nodes)
                p = model.beliefs(nodes, edges)
                labels = [KINDS[j] if p[i, j] >= SURE else "" for i, j in enumerate(p.argmax(axis=1))]
                if any(labels):
                    out.append({"features": [_coded(n.features) for n in nodes], "labels": labels, "edges": [list(e) for e in edges]})
            yield pa.RecordBatch.from_arrays([pa.array(out, _LABELLED)], ["x"])

    return run


def fit(docs: DataFrame, most: int = TRAIN_DOCS, nodes_at_most: int = NODES_AT_MOST) -> Model:
    """The model of the constructed documents and of at most ``most`` of ``docs``, drawn by a hash of the id."""
    model = first_model(SEED_DOCS)
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = docs.where(draw < min(1.0, most / total)).where(F.length("text") > 0).select("text")
    got = spread(sample).mapInArrow(_sure(model), "x struct<features:array<array<int>>,labels:array<string>,edges:array<array<int>>>").limit(most).toArrow()
    groups, used = list(_constructed(SEED_DOCS)), 0
    for x in got["x"].to_pylist():
        if used < nodes_at_most:
            groups.append((x["features"], x["labels"], [tuple(e) for e in x["edges"]]))
            used += len(x["labels"])
    return train(groups)


_FORMS = {"email": {"email"}, "phone": {"digits"}, "id_number": {"digits", "code"}, "address": {"address"}, "name": {"name"}}


def items_of(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items of a text."""
    if not text:
        return []
    nodes = nodes_of(text)
    if not nodes:
        return []
    beliefs = model.beliefs(nodes)
    # Exact limits: an item of a form that cannot be of its kind is none; of two overlapping items
    # of different forms the longer stands, of two names the likelier.
    labelled = [(KINDS[j], n, float(p[j])) for n, p in zip(nodes, beliefs) for j in (int(p.argmax()),) if j and n.form in _FORMS[KINDS[j]]]
    kept: list[tuple[str, Node]] = []
    for k, n, _ in sorted(labelled, key=lambda x: (x[0] == "name", -x[2] if x[0] == "name" else x[1].start - x[1].end, x[1].start)):
        if not any(m.start < n.end and n.start < m.end for _, m in kept):
            kept.append((k, n))
    return sorted(((k, n.start, n.end) for k, n in kept), key=lambda x: x[1])


def redact(text: str | None, items: list[tuple[str, int, int]]) -> str | None:
    """The text with [KIND] in the place of each item, all else unchanged."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in items:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def _apply(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    item = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            found = [items_of(t, model) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string()), pa.array([[{"kind": k, "start_pos": s, "end_pos": e} for k, s, e in x] for x in found], item)],
                ["doc_id", "redacted", "items"],
            )

    return run


def find_personal(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, redacted, items) of every row of ``docs(doc_id, text)``."""
    own = docs.select("doc_id", "text")
    model = model or fit(own)
    return spread(own).mapInArrow(_apply(model), "doc_id bigint, redacted string, items array<struct<kind:string,start_pos:bigint,end_pos:bigint>>")


def personal_items(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, start_pos), each item once."""
    return find_personal(docs, model).select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.kind", "x.start_pos").distinct()
