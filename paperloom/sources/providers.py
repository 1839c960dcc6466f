"""Optional outside services, injected as functions: retries, breaker, and the two loops.

Nothing here opens a connection; a provider is any callable. Without one, the loops degrade.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Breaker:
    """Opens after ``threshold`` failures in a row, tries again after ``cooldown`` seconds."""

    threshold: int = 2
    cooldown: float = 300.0
    clock: Callable[[], float] = time.time
    failures: int = 0
    last_failure: float = 0.0

    def allows(self) -> bool:
        if self.failures < self.threshold:
            return True
        if self.clock() - self.last_failure >= self.cooldown:
            self.failures = 0
            return True
        return False

    def note(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        if not ok:
            self.last_failure = self.clock()


def call(provider: Callable[[str], str], prompt: str, breaker: Breaker | None = None, attempts: int = 2) -> str | None:
    """The provider's reply, or nothing after failures or with an open breaker."""
    for _ in range(attempts):
        if breaker and not breaker.allows():
            return None
        try:
            reply = provider(prompt)
        except Exception:  # noqa: BLE001
            if breaker:
                breaker.note(False)
            continue
        if breaker:
            breaker.note(True)
        return reply
    return None


def read_json(reply: str | None) -> object | None:
    """The JSON of a reply, with or without a code fence; nothing if it is none."""
    try:
        return json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", (reply or "").strip()))
    except ValueError:
        return None


def extract_with_correction(extract: Callable[[str, list[str]], list[dict]], check: Callable[[list[dict]], tuple[list[dict], list[str]]], text: str, corrections: int = 2, enough: float = 0.6) -> tuple[list[dict], float]:
    """Extract, validate, and ask again with the errors while quality is poor."""
    errors: list[str] = []
    best: tuple[list[dict], float] = ([], 0.0)
    for _ in range(corrections + 1):
        rows = extract(text, errors)
        valid, errors = check(rows)
        quality = round(len(valid) / len(rows), 3) if rows else 0.0
        if quality >= best[1]:
            best = (valid, quality)
        if valid and quality >= enough and len(errors) <= 1:
            break
    return best


@dataclass
class Answer:
    text: str
    confidence: float
    passages: list[dict] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)
    degraded: bool = False


def fallback_text(passages: list[dict]) -> str:
    if not passages:
        return "No passages were found."
    return "Most relevant passages: " + "; ".join(f"[{i}] {p.get('paper_title', '')}" for i, p in enumerate(passages[:3], 1))


def answer(question: str, search: Callable[[str], list[dict]], synthesize: Callable[[str, list[dict]], tuple[str, float]] | None = None, verify: Callable[[str, list[dict]], tuple[bool, float]] | None = None, refine: Callable[[str, list[dict]], str] | None = None, retries: int = 2, enough: float = 0.6) -> Answer:
    """Retrieve, synthesize, verify; refine the query while the answer is not grounded."""
    query, queries = question, []
    result = Answer("", 0.0)
    for attempt in range(retries + 1):
        queries.append(query)
        passages = search(query)
        base = round(min(len(passages) / 5, 1) * 0.8 + 0.2, 3) if passages else 0.0
        if synthesize is None:
            return Answer(fallback_text(passages), base, passages[:3], queries, True)
        text, confidence = synthesize(question, passages) if passages else ("No passages were found.", 0.0)
        grounded, sure = verify(text, passages) if verify and passages else (bool(passages), confidence)
        result = Answer(text, min(confidence, sure), passages[:3], queries)
        if passages and grounded and result.confidence >= enough:
            break
        if attempt < retries:
            terms = [p.get("paper_title", "") for p in passages[:2]]
            query = refine(query, passages) if refine else " ".join([question, *terms]).strip()
    return result


@dataclass
class RateLimit:
    """At least ``delay`` seconds between two calls of a service."""

    delay: float
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)

    def wait(self, service: str) -> float:
        """Waits as long as it must; the seconds waited."""
        now = self.clock()
        left = max(0.0, self.last.get(service, float("-inf")) + self.delay - now)
        if left:
            self.sleep(left)
        self.last[service] = now + left
        return left


def extraction_prompt(text: str, required: dict[str, list[str]], rules: dict[str, list[str]] | None = None, errors: list[str] | None = None, domain: str = "general") -> str:
    """What a provider is asked: the kinds of entities with their fields, the rules, the errors so far, the text."""
    kinds = [f"- {kind}: {', '.join(fields)}" for kind, fields in required.items()]
    asked = [f"- {kind}: {r}" for kind, rs in (rules or {}).items() for r in rs]
    parts = [f"Extract entities of these kinds from a text of the domain {domain}, as a JSON list of objects with a field \"type\".", *kinds]
    if asked:
        parts += ["Rules:", *asked]
    if errors:
        parts += ["The last reply was wrong:", *(f"- {e}" for e in errors)]
    return "\n".join([*parts, "Text:", text])


#: Labels given to a provider at once, and how many there must be before it is worth asking.
GROUP_AT_MOST, GROUP_FROM = 50, 10


def group_labels(labels: list[str], provider: Callable[[str], str] | None) -> dict[str, str]:
    """Label to canonical label by a provider, in blocks; none without a provider or with few labels.

    Only labels that were asked for are taken from a reply."""
    out: dict[str, str] = {}
    unique = list(dict.fromkeys(labels))
    if provider is None or len(unique) <= GROUP_FROM:
        return out
    for i in range(0, len(unique), GROUP_AT_MOST):
        block = unique[i : i + GROUP_AT_MOST]
        reply = read_json(call(provider, "Group labels that mean the same; reply with a JSON object of canonical label to its variants.\n" + "\n".join(block)))
        for canonical, variants in (reply.items() if isinstance(reply, dict) else ()):
            for v in variants if isinstance(variants, list) else ():
                if v in block and v != canonical:
                    out.setdefault(v, canonical)
    return out


def claims_in(text: str, provider: Callable[[str], str] | None) -> list[str]:
    """The claims of a free text by a provider; none offline or for a blank text."""
    if provider is None or not text.strip():
        return []
    reply = read_json(call(provider, "List the factual claims of this text as a JSON list of strings.\n" + text))
    return [c.strip() for c in reply if isinstance(c, str) and c.strip()] if isinstance(reply, list) else []


@dataclass
class Embedder:
    """The first of several embedders that answers; one that fails is not asked again."""

    backends: list[tuple[str, Callable[[str], list[float]]]]
    failed: set[str] = field(default_factory=set)

    def probe(self) -> dict[str, bool]:
        """Which backends answer a short text with numbers."""
        out = {}
        for name, f in self.backends:
            try:
                out[name] = len(f("probe")) > 0
            except Exception:  # noqa: BLE001
                out[name] = False
        self.failed |= {n for n, ok in out.items() if not ok}
        return out

    def embed(self, text: str, dim: int) -> list[float]:
        """The text's vector; zeros for a blank text, or if no backend answers."""
        if text.strip():
            for name, f in self.backends:
                if name not in self.failed:
                    try:
                        return list(f(text))
                    except Exception:  # noqa: BLE001
                        self.failed.add(name)
        return [0.0] * dim
