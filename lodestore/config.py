"""Options: defaults, what a file says over them, what the environment says over both; and checks of arguments."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "searchMode": "hybrid",
    "bm25": {"k1": 1.2, "b": 0.75},
    "fusion": {"k": 60, "candidates": 20, "limit": 10},
    "graph": {"expansionDepth": 2},
    "history": {"keep": 50, "gapSeconds": 90, "checkpointEvery": 40},
    "cache": {"ttlHours": 24, "minCosine": 0.92},
}
MAX_TEXT, MAX_STRING, MAX_ITEMS, MAX_KEYS, MAX_DEPTH = 64 * 1024, 4 * 1024, 256, 64, 6
LONG_KEYS = frozenset(("finding", "decision", "rationale", "content", "text"))


def merged(given: Mapping[str, Any], defaults: Mapping[str, Any] = DEFAULTS) -> dict[str, Any]:
    """``given``, with what it lacks filled from the defaults at every level."""
    out = dict(given)
    for key, value in defaults.items():
        if isinstance(value, Mapping):
            out[key] = merged(out.get(key) if isinstance(out.get(key), Mapping) else {}, value)
        elif out.get(key) is None:
            out[key] = value
    return out


def from_environment(options: Mapping[str, Any], prefix: str = "LODESTORE_", env: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """Options of which a variable of the prefix and the name in capitals is set, converted to the option's own type."""
    out = dict(options)
    for key, value in options.items():
        raw = env.get(prefix + re.sub(r"(?<=[a-z])(?=[A-Z])", "_", key).upper())
        if raw is None or isinstance(value, Mapping):
            continue
        if isinstance(value, bool):
            out[key] = raw.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(value, int | float):
            try:
                out[key] = type(value)(raw)
            except ValueError:
                continue
        else:
            out[key] = raw
    return out


def checked(args: Any, depth: int = 0, key: str = "") -> Any:
    """The arguments, or ValueError where a string, list, mapping or nesting is beyond its bound."""
    if depth > MAX_DEPTH:
        raise ValueError("arguments are nested too deeply")
    if isinstance(args, str):
        if len(args) > (MAX_TEXT if key in LONG_KEYS else MAX_STRING):
            raise ValueError(f"{key or 'a string'} is too long")
    elif isinstance(args, list | tuple):
        if len(args) > MAX_ITEMS:
            raise ValueError(f"{key or 'a list'} has too many items")
        return [checked(x, depth + 1, key) for x in args]
    elif isinstance(args, Mapping):
        if len(args) > MAX_KEYS:
            raise ValueError("too many keys")
        return {k: checked(v, depth + 1, k) for k, v in args.items()}
    return args
