"""Reading a free-typed label: its Greek letter, name, head noun, series word and number.

Pure text rules, shared by the mapping operator and its tests. A label is folded (accents,
case, compatibility forms), Greek letters are spelled, Roman numerals become digits where a
number may stand, ``noun of name`` and ``noun, name`` are put in order, and the head noun is
looked for as the last word, as the end of a run-together word, or as an abbreviation with a
point, allowing for plural forms and for slips of the keyboard.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Names of Greek letters and Roman numerals up to twelve.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: Words after a head noun that add nothing to what is meant.
FILLERS = frozenset(("technique", "techniques", "method", "methods", "procedure", "protocol", "protocols", "system", "systems", "component", "components", "signal", "signals", "dataset", "datasets", "data", "set", "sets"))
_GREEK_NAMES = frozenset(GREEK.values())


@dataclass(frozen=True)
class Label:
    greek: str
    name: str
    noun: str
    series: str
    number: str
    codes: tuple[str, ...]
    compact: str


def fold(text: str) -> str:
    """Lower case without accents; Greek letters spelled; spaces collapsed."""
    text = unicodedata.normalize("NFKC", text).replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ı", "i").replace("ł", "l")
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).casefold()
    for sign, name in GREEK.items():
        text = text.replace(sign, f" {name} ")
    return re.sub(r"\s+", " ", text).strip()


def slips(a: str, b: str, most: int = 3) -> int:
    """Edits, swaps of neighbours counting one, between two words; more than ``most`` is most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def forms(noun: str) -> set[str]:
    """The noun and its plural and spelling forms, as people type them."""
    out = {noun, noun + "s", noun + "es"}
    if noun.endswith("y"):
        out.add(noun[:-1] + "ies")
    if noun.endswith("is"):
        out.add(noun[:-2] + "es")
    for british, other in (("our", "or"), ("isation", "ization"), ("bre", "ber"), ("ogue", "og"), ("aem", "em"), ("lyse", "lyze"), ("ling", "ing")):
        if british in noun:
            w = noun.replace(british, other)
            out |= {w, w + "s"}
    return out


def _bigrams(word: str) -> set[str]:
    p = f"^{word}$"
    return {p[i : i + 2] for i in range(len(p) - 1)}


def _numeral(word: str) -> bool:
    bare = word.strip(".'\"!?")
    return bare.isdigit() or bare in ROMAN


class Reader:
    """Reads labels, given the head nouns that the canonical entries use."""

    def __init__(self, nouns: list[str]):
        self.nouns = sorted({fold(n) for n in nouns if n})
        self.form_of = {f: n for n in self.nouns for f in forms(n)}
        self._met: dict[str, str] = {}
        self._index: dict[str, list[str]] = {}
        for f in self.form_of:
            for g in _bigrams(f):
                self._index.setdefault(g, []).append(f)

    def noun(self, word: str) -> str:
        """The head noun meant by a word, or empty."""
        if word in self.form_of:
            return self.form_of[word]
        if len(word) < 5:
            return ""
        if word not in self._met:
            if len(self._met) > 100_000:
                self._met.clear()
            self._met[word] = self._near(word)
        return self._met[word]

    def _near(self, word: str) -> str:
        """The noun nearest by slips, if there is one. A slip changes at most three bigrams, so only
        forms with enough bigrams in common are compared."""
        shared: dict[str, int] = {}
        for g in _bigrams(word):
            for f in self._index.get(g, ()):
                shared[f] = shared.get(f, 0) + 1
        best: dict[str, int] = {}
        for f, k in shared.items():
            most = 2 if len(f) >= 6 else 1
            if k >= len(_bigrams(f)) - 3 * most and (s := slips(word, f, most)) <= most:
                n = self.form_of[f]
                best[n] = min(s, best.get(n, 9))
        if not best:
            return ""
        least = min(best.values())
        near = [n for n, s in best.items() if s == least]
        return near[0] if len(near) == 1 else ""

    def abbreviated(self, word: str) -> list[str]:
        """Head nouns that a word with a final point may stand for."""
        if len(word) < 3:
            return []
        exact = [n for n in self.nouns if n.startswith(word) and n != word]
        if exact or len(word) < 4:
            return exact
        return [n for n in self.nouns if len(n) > len(word) and any(slips(word, n[: len(word) + k], 1) <= 1 for k in (-1, 0, 1))]

    def read(self, text: str | None) -> list[Label]:
        """The readings of a label; none if it is blank."""
        folded = fold(text or "")
        codes = tuple(re.sub(r"[^a-z0-9]", "", c) for c in re.findall(r"\(([^()]*)\)", folded))
        folded = re.sub(r"\([^()]*\)", " ", folded)
        folded = re.sub(r"[\s_]+", " ", folded).strip()
        folded = re.sub(r"^(the|a|an)\s+", "", folded)
        if m := re.fullmatch(r"(\w[\w.]*) of (.+)", folded):
            folded = f"{m[2]} {m[1]}"
        elif m := re.fullmatch(r"([^,]+), ?([^,]+)", folded.rstrip(" ,;.:")):
            folded = f"{m[2]} {m[1]}"
        words = [w for w in re.split(r"[\s_\-‐–—/,;:]+", folded) if w.strip(".'\"!?")]
        if not words:
            return []
        greek = series = number = ""
        rest: list[str] = []
        for i, w in enumerate(words):
            bare = w.strip(".'\"!?")
            if bare in _GREEK_NAMES and not greek:
                greek = bare
            elif bare in ("type", "types") or (i + 1 < len(words) and _numeral(words[i + 1]) and slips(bare, "type", 1) <= 1):
                series = "type"
            elif re.fullmatch(r"\d+", bare):
                number = bare.lstrip("0") or "0"
            elif i and bare in ROMAN and i >= len(words) - 1:
                number = str(ROMAN[bare])
            elif m := re.fullmatch(r"(type)?([a-z]{4,}?)(type)?(\d+)", bare):
                rest.append(m[2])
                number = m[4]
                series = "type" if m[1] or m[3] else series
            else:
                rest.append(w.strip("'\"!?"))
        while len(rest) > 2 and rest[-1].strip(".") in FILLERS:
            rest.pop()
        if not rest:
            return []
        compact = "".join(re.sub(r"[^a-z0-9]", "", w) for w in rest)
        make = lambda name, noun: Label(greek, re.sub(r"[^a-z0-9]", "", name), noun, series, number, codes, compact)
        out = []
        order = [len(rest) - 1] + ([0] if len(rest) > 1 else [])
        for at in order:
            last = rest[at]
            other = "".join(rest[:at] + rest[at + 1 :])
            bare = last.strip(".")
            if len(rest) > 1 and last.endswith(".") and (ns := self.abbreviated(bare)):
                return [make(other, n) for n in ns]
            if len(rest) > 1 and (n := self.noun(bare)):
                out.append(make(other, n))
                return out
        if len(rest) == 1:
            word = rest[0].strip(".")
            if n := self.noun(word):
                return [make("", n)]  # a head noun alone names nothing
            if rest[0].endswith("."):
                for size in range(min(14, len(word) - 4), 3, -1):
                    if ns := self.abbreviated(word[-size:]):
                        return [make(word[:-size], n) for n in ns]
            for f, n in sorted(self.form_of.items(), key=lambda x: -len(x[0])):
                if word.endswith(f) and len(word) - len(f) >= 4:
                    return [make(word[: -len(f)], n)]
            for size in range(len(word) - 4, 3, -1):
                if (n := self.noun(word[-size:])):
                    out.append(make(word[:-size], n))
            if out:
                return out
        return [make("".join(rest), "")]
