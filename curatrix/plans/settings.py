"""Settings from a JSON file and the environment."""

from __future__ import annotations

import json
import os
import random
import re
import string
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

PREFIX = "CURATRIX_"


def parse_value(text: str) -> int | float | bool | None | list | str:
    """Integer, number, boolean, nothing, comma list or text, in this order."""
    text = text.strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null", ""):
        return None
    if "," in text:
        return [parse_value(x) for x in text.split(",")]
    return text


def names(given: str | list[str] | None, builtin: list[str]) -> list[str]:
    """Names in effect: those given, ``*`` standing for all built-in ones."""
    if given is None:
        return list(builtin)
    out: list[str] = []
    for x in [given] if isinstance(given, str) else given:
        out += builtin if x == "*" else [x]
    return list(dict.fromkeys(out))


@dataclass
class Settings:
    similarity_backend: str = "exact"
    similarity_backends: list[str] = field(default_factory=list)
    visualization_method: str = "pca"
    parameters: dict = field(default_factory=dict)


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from ``path``, each overridden by ``CURATRIX_<NAME>``; backends' parameters by ``CURATRIX_<BACKEND>_<NAME>``."""
    from curatrix.plans.profiles import PROFILES

    env = os.environ if env is None else env
    data: dict = {}
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    for key in ("similarity_backend", "similarity_backends", "visualization_method"):
        if (v := env.get(PREFIX + key.upper())) is not None:
            data[key] = parse_value(v)
    out = Settings(**{k: v for k, v in data.items() if k in Settings.__dataclass_fields__})
    out.similarity_backends = names(out.similarity_backends or None, list(PROFILES))
    for backend in out.similarity_backends:
        start = f"{PREFIX}{backend.upper()}_"
        out.parameters.setdefault(backend, {}).update({k[len(start) :].lower(): parse_value(v) for k, v in env.items() if k.startswith(start)})
    return out


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def unique_name(name: str, taken: list[str] | Callable[[str], bool], max_len: int | None = None, rng: random.Random | None = None) -> str:
    """``name``, or ``name`` with six random characters if it is taken, within ``max_len``."""
    exists = taken if callable(taken) else set(taken).__contains__
    name = name[:max_len] if max_len else name
    rng, out = rng or random.Random(), name
    while exists(out):
        tail = "-" + "".join(rng.choices(string.ascii_lowercase + string.digits, k=6))
        out = (name[: max_len - len(tail)] if max_len else name) + tail
    return out
