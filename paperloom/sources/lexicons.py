"""Lexicons and extraction schemas from JSON or YAML files, as parameters of the operators."""

from __future__ import annotations

import json
import os
from functools import lru_cache

#: The environment variable that names a lexicon file of one's own.
VARIABLE = "PAPERLOOM_LEXICON"


@lru_cache(maxsize=8)
def load(path: str | None = None) -> dict:
    """The lexicon of a file, else of the one the environment names, else an empty one."""
    path = path or os.environ.get(VARIABLE)
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML lexicons need the yaml package") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def merged(base: dict, child: dict) -> dict:
    """Maps merge, lists join without repeats, anything else is the child's."""
    out = dict(base)
    for k, v in child.items():
        old = out.get(k)
        if isinstance(old, dict) and isinstance(v, dict):
            out[k] = merged(old, v)
        elif isinstance(old, list) and isinstance(v, list):
            out[k] = [*old, *(x for x in v if x not in old)]
        else:
            out[k] = v
    return out
