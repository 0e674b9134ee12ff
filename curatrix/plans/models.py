"""A registry of embedding models in a folder that the driver can read.

``manifest.json`` lists models with a version and the function that loads them
(``module:function``); artifacts lie beside it, one folder a model.  Nothing is
downloaded: an artifact is a file that the caller has.
"""

from __future__ import annotations

import importlib
import json
import os
import shutil
from collections.abc import Callable
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class ModelEntry:
    name: str
    version: str
    loader: str
    file: str | None = None

    @property
    def full_name(self) -> str:
        return f"{self.name}-v{self.version}"


def _order(version: str) -> tuple:
    return tuple(int(x) if x.isdigit() else x for x in version.split("."))


class Models:
    """Models below ``root``."""

    def __init__(self, root: str) -> None:
        self.root = root
        self._manifest = os.path.join(root, "manifest.json")

    def entries(self) -> list[ModelEntry]:
        if not os.path.isfile(self._manifest):
            return []
        with open(self._manifest, encoding="utf-8") as f:
            return [ModelEntry(**x) for x in json.load(f)]

    def _write(self, entries: list[ModelEntry]) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(self._manifest + ".new", "w", encoding="utf-8") as f:
            json.dump([asdict(e) for e in entries], f, indent=1)
        os.replace(self._manifest + ".new", self._manifest)

    def names(self) -> list[str]:
        return sorted({e.name for e in self.entries()})

    def add(self, name: str, version: str, loader: str, file: str | None = None) -> ModelEntry:
        """Register a version; ``file`` is copied into the registry."""
        known = self.entries()
        if any((e.name, e.version) == (name, version) for e in known):
            raise ValueError(f"{name} {version} exists")
        kept = None
        if file is not None:
            kept = os.path.join(f"{name}-v{version}", os.path.basename(file))
            os.makedirs(os.path.join(self.root, f"{name}-v{version}"), exist_ok=True)
            shutil.copyfile(file, os.path.join(self.root, kept))
        entry = ModelEntry(name, version, loader, kept)
        self._write([*known, entry])
        return entry

    def find(self, name: str, version: str | None = None) -> ModelEntry:
        """The given version, or the newest one."""
        found = [e for e in self.entries() if e.name == name and version in (None, e.version)]
        if not found:
            raise ValueError(f"no model {name!r}; there are {', '.join(self.names()) or 'none'}")
        return max(found, key=lambda e: _order(e.version))

    def load(self, name: str, version: str | None = None) -> Callable:
        """What the entry's loader gives for its artifact's path."""
        entry = self.find(name, version)
        module, function = entry.loader.split(":")
        path = None if entry.file is None else os.path.join(self.root, entry.file)
        return getattr(importlib.import_module(module), function)(path)

    def delete(self, name: str, version: str | None = None) -> None:
        gone = [e for e in self.entries() if e.name == name and version in (None, e.version)]
        self._write([e for e in self.entries() if e not in gone])
        for e in gone:
            shutil.rmtree(os.path.join(self.root, e.full_name), ignore_errors=True)
