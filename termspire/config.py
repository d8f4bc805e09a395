"""Typed properties with defaults that are stored when they're first read."""

from __future__ import annotations

import os
from pathlib import Path


class Config:
    def __init__(self, path: str | None = None):
        self.path = path
        self.values: dict[str, str] = {}
        if path and os.path.exists(path):
            for line in Path(path).read_text(encoding="utf-8").splitlines():
                if line.strip() and not line.lstrip().startswith(("#", "!")):
                    key, _, value = line.partition("=")
                    self.values[key.strip()] = value.strip()

    def get(self, key: str, default):
        """The value as the default's type; the default is stored if there's none."""
        if key not in self.values:
            self.values[key] = str(default)
        value = self.values[key]
        return value.lower() == "true" if isinstance(default, bool) else type(default)(value)

    def set(self, key: str, value) -> None:
        self.values[key] = str(value)

    def save(self) -> None:
        if self.path:
            Path(self.path).write_text("".join(f"{k}={v}\n" for k, v in sorted(self.values.items())), encoding="utf-8")
