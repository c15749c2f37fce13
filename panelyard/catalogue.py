"""Named stages."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    """Names to callables: a name registers once, an unknown name gives None."""

    def __init__(self):
        self._stages: dict[str, Callable] = {}

    def register(self, name: str, stage: Callable) -> None:
        if name in self._stages:
            raise ValueError(f"stage {name} is registered already")
        self._stages[name] = stage

    def get(self, name: str) -> Callable | None:
        return self._stages.get(name)

    def names(self, prefix: str = "") -> list[str]:
        return [n for n in self._stages if n.startswith(prefix)]
