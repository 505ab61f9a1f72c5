"""Settings as nested dictionaries: finding, setting and overriding by key or path."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from typing import Any


def paths_of(settings: dict, key: str, before: str = "") -> list[str]:
    """Dotted paths of every place where the key occurs."""
    out = []
    for k, v in settings.items():
        path = f"{before}.{k}" if before else k
        if k == key:
            out.append(path)
        if isinstance(v, dict):
            out += paths_of(v, key, path)
    return out


def with_value(settings: dict, path: str, value: Any) -> dict:
    """A copy with the value at a dotted path that exists."""
    out = deepcopy(settings)
    *way, last = path.split(".")
    at = out
    for k in way:
        at = at[k]
    if last not in at:
        raise KeyError(path)
    at[last] = value
    return out


def typed(text: str) -> Any:
    """JSON where it is JSON, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return {"True": True, "False": False, "None": None}.get(text, text)


def overridden(settings: dict, pairs: list[str]) -> dict:
    """With ``key=value`` pairs; a key that occurs in several places needs its path."""
    for pair in pairs:
        key, _, value = pair.partition("=")
        found = [key] if "." in key else paths_of(settings, key)
        if len(found) != 1:
            raise KeyError(f"{key}: {len(found)} places")
        settings = with_value(settings, found[0], typed(value))
    return settings


def digest(settings: dict) -> str:
    """Hash that doesn't depend on the order of keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def blocks_equal(a: dict, b: dict, ignore: tuple[str, ...] = ()) -> bool:
    """Equality but for ignored keys, at the top level only."""
    drop = lambda d: {k: v for k, v in d.items() if k not in ignore}
    return digest(drop(a)) == digest(drop(b))


RESERVED = ("_input_metadata", "_run_metadata", "_selection_metadata", "_consolidation_metadata")


def attach(payload: dict, **blocks: dict) -> dict:
    """The payload with provenance blocks under reserved names; others, or ones it has, raise."""
    for name in blocks:
        if name not in RESERVED or name in payload:
            raise ValueError(f"block {name} can't be attached")
    return {**payload, **blocks}


def detach(payload: dict) -> tuple[dict, dict]:
    """The payload and its provenance blocks."""
    return {k: v for k, v in payload.items() if k not in RESERVED}, {k: v for k, v in payload.items() if k in RESERVED}
